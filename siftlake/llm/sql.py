"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from siftlake.llm.licenses import KNOWN, KNOWN_RULES, normalise, triggers
from siftlake.llm.urls import DEPTH, DIGITS, KIN, PRIOR, Z
from siftlake.llm.urls import RULES as URL_RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source AS host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM f GROUP BY source),
p AS (SELECT avg(failed / n) AS mu, var_pop(failed / n) AS v FROM h),
s AS (SELECT mu, CASE WHEN v IS NULL OR v = 0 THEN 10.0 ELSE least(1000.0, greatest(1.0, mu * (1 - mu) / v - 1)) END AS total FROM p),
r AS (SELECT host, (failed + mu * total) / (n + total) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(rate, 6) AS host_rate, NOT base_failed AND round(rate, 6) <= 0.8 AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.host
"""


def _op3() -> str:
    known = ", ".join(f"('{normalise(s)}', '{name}')" for name, s in KNOWN.items())
    most = max(len(normalise(s).split()) for s in KNOWN.values())
    held = lambda c: " OR ".join(f"contains({c}, '{t}')" for t in triggers(KNOWN))
    steps, last = "", "r"
    for k, (name, ids) in enumerate(KNOWN_RULES):
        rule = "".join(f"<{x}>" for x in ids)
        steps += f",\nr{k} AS (SELECT * REPLACE (replace(chain, '{rule}', '|') AS chain, CASE WHEN contains(chain, '{rule}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found) FROM {last})"
        last = f"r{k}"
    # sentences end at punctuation and at lines without letters; runs of lines, the longest first
    return rf"""
WITH RECURSIVE known(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS x FROM documents),
c AS (SELECT rid, unnest(parts) AS seg, generate_subscripts(parts, 1) AS c FROM (SELECT rid, string_split(regexp_replace(regexp_replace(x, '([.;:!?])[ \t\r\n]+', '\1' || chr(1), 'g'), '\n[^a-z0-9\x01]*\n', chr(1), 'g'), chr(1)) AS parts FROM d WHERE {held("x")})),
l AS (SELECT rid, c, list_filter(list_transform(string_split(seg, chr(10)), lambda y: trim(regexp_replace(y, '[^a-z0-9]+', ' ', 'g'))), lambda y: y <> '') AS lines FROM c WHERE {held("seg")}),
n AS (SELECT rid, c, lines, i, unnest(range(1, least({most}, len(lines) - i + 1) + 1)) AS n FROM (SELECT rid, c, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
f AS (SELECT rid, c, i, max(n) AS n, arg_max(id, n) AS id FROM n JOIN known ON array_to_string(lines[i:i + n - 1], ' ') = known.s GROUP BY rid, c, i),
b AS (SELECT rid, c, i, id, (SELECT min(z.i) FROM f z WHERE z.rid = f.rid AND z.c = f.c AND z.i >= f.i + f.n) AS next FROM f),
g(rid, c, i, id, next) AS (SELECT b.* FROM b WHERE i = (SELECT min(z.i) FROM f z WHERE z.rid = b.rid AND z.c = b.c)
  UNION ALL SELECT b.* FROM g JOIN b ON g.rid = b.rid AND g.c = b.c AND g.next = b.i),
k AS (SELECT rid, list(id ORDER BY c, i) AS ids FROM g GROUP BY rid),
r AS (SELECT doc_id, coalesce(ids, []) AS ids, coalesce(list_aggregate(list_transform(coalesce(ids, []), lambda x: '<' || x || '>'), 'string_agg', ''), '') AS chain, CAST([] AS VARCHAR[]) AS found FROM d LEFT JOIN k ON d.rid = k.rid){steps}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids, coalesce(list_aggregate(found, 'string_agg', ','), '') AS licenses FROM {last}
"""


def _op4() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)
    smoothed = lambda total, n, before, weight: f"round(({total} + {weight} * {before}) / ({n} + {weight}), {DIGITS})"
    levels = ""
    for d in range(DEPTH + 1):
        rate = f"CASE WHEN c_lab > 0 THEN round(c_blk / c_lab, {DIGITS}) END"
        levels += f"""
a{d} AS (SELECT *, coalesce(parts[{d + 1}], '') AS s, array_to_string(parts[1:{d + 1}], '/') AS pre FROM t{d} WHERE NOT over),
s{d} AS (SELECT pre, sum(lab) AS s_lab, sum(blk) AS s_blk FROM a{d} GROUP BY pre),
k{d} AS (SELECT host, template, s, sum(lab) AS c_lab, sum(blk) AS c_blk, count(*) AS c_rows FROM a{d} GROUP BY ALL),
w{d} AS (SELECT host, template, sum(c_lab) AS p_lab, sum(c_blk) AS p_blk, sum(c_rows) AS p_rows, coalesce(sum({rate}), 0.0) AS rates, count({rate}) AS rated FROM k{d} GROUP BY ALL),
e{d} AS (SELECT a.* EXCLUDE (s, pre), a.s, s_lab, s_blk, c_lab, c_blk, p_lab, p_blk, rates, rated, p_rows = 1 AS alone, len(parts) <= {d} AS last
      FROM a{d} a JOIN s{d} ON a.pre = s{d}.pre JOIN k{d} ON a.host = k{d}.host AND a.template = k{d}.template AND a.s = k{d}.s
      JOIN w{d} ON a.host = w{d}.host AND a.template = w{d}.template),
t{d + 1} AS (SELECT host, general, parts, lab, blk,
      template || CASE WHEN alone THEN array_to_string(list_transform(parts[{d + 1}:], lambda x: '/' || x), '')
         WHEN s = '' THEN '' WHEN coalesce(round(abs(c_blk / nullif(c_lab, 0) - p_blk / nullif(p_lab, 0)), {DIGITS})
           <= round({Z} * sqrt((p_blk / nullif(p_lab, 0)) * (1 - p_blk / nullif(p_lab, 0)) / nullif(c_lab, 0)), {DIGITS}), false) THEN '/*'
         WHEN c_lab = 0 AND s_lab = 0 THEN '/?' ELSE '/' || s END AS template,
      CASE WHEN last THEN shape ELSE {smoothed("s_blk", "s_lab", "shape", PRIOR)} END AS shape,
      CASE WHEN last THEN kin ELSE {smoothed("rates", "rated", "kin", KIN)} END AS kin, alone OR last AS over FROM e{d}),"""
    ready = " UNION ALL ".join(f"SELECT host, general, template, lab, blk, shape, kin FROM t{d + 1} WHERE over" for d in range(DEPTH + 1))
    host_rate = f"CASE WHEN lab > 0 THEN round(blk / lab, {DIGITS}) END"
    return rf"""
WITH rules(verdict, rule, name, start) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), '{_UP}', '{_LOW}') AS host,
             regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
f AS (SELECT rid, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM p JOIN rules
      ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY rid),
g AS (SELECT p.*, f.rule, f.verdict, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-f]{{12,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g'), '/'), lambda x: x <> '') AS parts
      FROM p LEFT JOIN f ON p.rid = f.rid),
c AS (SELECT host, parts, array_to_string(parts, '/') AS general, count(verdict) AS lab, count(*) FILTER (WHERE verdict = 'block') AS blk FROM g GROUP BY ALL),
z AS (SELECT round(coalesce(sum(blk) / nullif(sum(lab), 0), 0.0), {DIGITS}) AS share FROM c),
h AS (SELECT host, CASE WHEN contains(host, '.') THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS site, sum(lab) AS lab, sum(blk) AS blk FROM c GROUP BY ALL),
v AS (SELECT site, coalesce(sum({host_rate}), 0.0) AS rates, count({host_rate}) AS rated FROM h GROUP BY site),
t0 AS (SELECT c.*, '' AS template, share AS shape, {smoothed("rates", "rated", "share", KIN)} AS kin, false AS over
      FROM c JOIN h ON c.host = h.host JOIN v ON h.site = v.site, z),{levels}
j AS ({ready}),
q AS (SELECT host, template, {smoothed("sum(blk)", "sum(lab)", "((avg(shape) + max(kin)) / 2)", PRIOR)} AS purity FROM j GROUP BY ALL)
SELECT g.page_id, g.host, g.path, g.rule, coalesce(g.verdict, CASE WHEN q.purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, j.template
FROM g JOIN j ON g.host = j.host AND array_to_string(g.parts, '/') = j.general JOIN q ON j.host = q.host AND j.template = q.template
"""


OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, contains(text, '\\') OR contains(text, '###') OR contains(text, '</turn>') AS conflict,
             regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS escaped,
             regexp_replace(role, '(\\|###|</turn>|:|\n)', '\\\1', 'g') AS escaped_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(escaped_role) + 2 + length(CASE WHEN conflict THEN escaped ELSE text END) + 9) AS BIGINT) AS formatted_chars,
       CAST(max(CASE WHEN conflict THEN 1 ELSE 0 END) AS BIGINT) AS escape_level, true AS round_trip
FROM e GROUP BY conv_id
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, ws[i:i + size - 1] AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, i, ws[i:i + size - 1] AS win FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hit AS (SELECT dw.rid, dw.i, dw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM hit WHERE item_id IS NOT NULL GROUP BY rid),
tok AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
wt AS (SELECT win, unnest(win) AS w, generate_subscripts(win, 1) AS off FROM (SELECT DISTINCT win FROM iw)),
rare AS (SELECT win, w, off FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY freq, off) AS k FROM wt JOIN (SELECT w, count(*) AS freq FROM tok GROUP BY w) USING (w)) WHERE k = 1),
near AS (SELECT rid, count(*) AS n_near FROM (SELECT rid, win FROM (
    SELECT d.rid, win, len(list_filter(range(1, len(win) + 1), lambda k: list_contains(ws[greatest(first + k - 1, 1):first + k + 1], win[k]))) = len(win) AS all_near, first >= 0 AND ws[greatest(first + 1, 1):first + len(win)] = win AS same
    FROM (SELECT rare.win, tok.rid, tok.p - rare.off AS first FROM tok JOIN rare ON tok.w = rare.w) c JOIN d ON c.rid = d.rid WHERE first >= -1)
  GROUP BY rid, win HAVING bool_or(all_near) AND NOT bool_or(same)) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(list_aggregate(list_sort(items), 'string_agg', ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN cov ON d.rid = cov.rid LEFT JOIN it ON d.rid = it.rid LEFT JOIN near ON d.rid = near.rid
"""

ORACLE_SQL = {"op2_quality_rules": OP2, "op3_license_scan": _op3(), "op4_url_filter": _op4(), "op5_chat_format": OP5, "op8_decontaminate": OP8}
