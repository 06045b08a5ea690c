"""Queries over made-up source files and findings, which are built from tables so that what they hold is
known: SQL states the planted values themselves, not the patterns that find them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import analytics, decode, extract, ml, post, rules
from siftlake.plans import oracle as O
from siftlake.plans import reports
from siftlake.sources.store import history_filter

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FROM, _TO = _AZ + _AZ.lower(), _AZ[13:] + _AZ[:13] + _AZ.lower()[13:] + _AZ.lower()[:13]

_HASH = re.compile(r"#\d+")
#: A prefix that is known.
LIVE = "sk_live_"


def _sql(expression: str, h: str) -> str:
    """SQL of a planted expression: parts joined by |, each a literal, #n (n hex digits of the hash), or
    a function of such a list, as reverse(..), rot13(..), base64(..)."""
    return " || ".join(_part_sql(p, h) for p in _parts(expression))


def _parts(expression: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in expression:
        depth += (c == "\x01") - (c == "\x02")
        if c == "|" and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def f(name: str, inner: str) -> str:
    return f"{name}\x01{inner}\x02"


def _split(part: str) -> tuple[str, str] | None:
    return tuple(part[:-1].split("\x01", 1)) if part.endswith("\x02") else None


def _part_sql(part: str, h: str) -> str:
    if found := _split(part):
        inner = _sql(found[1], h)
        return {"reverse": f"reverse({inner})", "rot13": f"translate({inner}, '{_FROM}', '{_TO}')", "base64": f"base64(encode({inner}))"}[found[0]]
    return f"substr({h}, 1, {part[1:]})" if _HASH.fullmatch(part) else O.q(part)


def _column(expression: str, h: Column) -> Column:
    parts = []
    for part in _parts(expression):
        if found := _split(part):
            inner = _column(found[1], h)
            parts.append({"reverse": F.reverse, "rot13": T.rot13, "base64": lambda x: F.base64(x.cast("binary"))}[found[0]](inner))
        else:
            parts.append(F.substring(h, 1, int(part[1:])) if _HASH.fullmatch(part) else F.lit(part))
    return F.concat(*parts)


#: Lines of a planted file, and what they hide: (line, variable, value). A null character is a bar.
_ROT, _REV = f("rot13", f"{LIVE}|#12"), f("reverse", f"{LIVE}|#24")
LINES = [
    ('a1 = "sk_li" + "ve_|#16|"', "a1", f"{LIVE}|#16"),
    (f'reversed_key = "|{_REV}|"', "reversed_key_reversed", f"{LIVE}|#24"),
    (f'p = "{LIVE}"', None, None),
    ('q = p + "|#12|"', "q", f"{LIVE}|#12"),
    ("parts = [", None, None),
    ('"ab|#10|",', None, None),
    ('"cd|#11|",', None, None),
    ("]", None, None),
    ('j = "".join(parts)', "j", "ab|#10|cd|#11"),
    (f'r = "|{f("reverse", "#20")}|"[::-1]', "r", "#20"),
    ("Authorization: Bearer |#32", "bearer_token", "#32"),
    ("mysql -u root -p|#10|X", "mysql_password", "#10|X"),
    ("b = bytes([115, 107, 95, 108, 105, 118, 101, 95])", "b", LIVE),
    ("password: \x00", None, None),
    ("  block-|#12", "password", "block-|#12"),
    ("h = b'\\x73\\x6b\\x5f\\x6c\\x69\\x76\\x65\\x5f'", "h", LIVE),
    ("d = {'password': 'pw|#12|'}", "password", "pw|#12"),
    ("u = postgres://u:p%40|#8|@host/db", "connection_string", "postgres://u:p@|#8|@host/db"),
    (f'enc = "|{f("base64", f"{LIVE}|#12")}|"', None, None),
    ("v = base64.b64decode(enc)", "enc_b64decoded", f"{LIVE}|#12"),
    ('f = f"{p}tail|#8|"', "f", f"{LIVE}tail|#8"),
    (f'fmt = "{LIVE}%s"', None, None),
    ('g = fmt % "|#10|"', "g", f"{LIVE}|#10"),
    (f'encrypted_key = "|{_ROT}|"', "encrypted_key_rot13", f"{LIVE}|#12"),
    (f'w = codecs.decode("|{_ROT}|", "rot_13")', "w", f"{LIVE}|#12"),
    ("k = ''.join(['ab|#8|', 'cd|#9|'])", "k", "ab|#8|cd|#9"),
    ('# <?xml version="1.0"?>', None, None),
    ("<token>tk|#12|</token>", "token", "tk|#12"),
    ("aws_secret_access_key = |#20", "aws_secret_access_key", "#20"),
]


def planted(spark, sf_dir: str) -> DataFrame:
    """One file for each supplier."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.sha2(F.col("s_suppkey").cast("string"), 256).alias("h"))
    body = F.concat_ws("\n", *[F.replace(_column(line, F.col("h")), F.lit("\x00"), F.lit("|")) for line, _, _ in LINES])
    return rows.select(F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"), "h")


_HASHED = "SELECT 'src/s' || s_suppkey || '.py' AS path, sha256(CAST(s_suppkey AS VARCHAR)) AS h FROM supplier"
#: What the heuristics find in planted files.
HIDDEN = " UNION ALL ".join(f"SELECT path, {n} AS line_no, {O.q(var)} AS var_name, {_sql(value, 'h')} AS value FROM ({_HASHED})" for n, (_, var, value) in enumerate(LINES, 1) if var)


_B, _A = "api_key=|#20", f"token=|{f('base64', 'api_key=|#20')}"
#: (kind of file, its content, [(encoding, depth, decoded content)])
CHAINS = [
    ("chain", f"data = |{f('base64', _A)}", [("base64", 1, _A), ("base64", 2, _B)]),
    ("hex", "key \\x74\\x6f\\x6b |#9", [("hex_escape", 1, "key tok |#9")]),
    ("unicode", "key \\u0074\\u006f |#9", [("unicode_escape", 1, "key to |#9")]),
    ("plain", "nothing here", []),
]


def planted_decode(spark, sf_dir):
    """Decoded variants of files with encoded contents, to the full depth."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.sha2(F.col("s_suppkey").cast("string"), 256).alias("h"))
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), _column(content, F.col("h")).alias("content")) for kind, content, _ in CHAINS]))
    files = rows.select("s_suppkey", kinds.alias("k")).select(F.concat("k.kind", F.lit("/"), F.col("s_suppkey").cast("string")).alias("path"), "k.content")
    return decode.chain(files).where("depth > 0").select("path", "encoding", "depth", F.sha2("content", 256).alias("sha256"))


_DECODED = " UNION ALL ".join(f"SELECT '{kind}/' || s_suppkey AS path, '{encoding}' AS encoding, {depth} AS depth, sha256({_sql(content, 'h')}) AS sha256 FROM (SELECT s_suppkey, sha256(CAST(s_suppkey AS VARCHAR)) AS h FROM supplier)" for kind, _, found in CHAINS for encoding, depth, content in found)

# Orders stand for classified candidates.
_PROV = ["AUTH_CREDENTIAL", "UNCERTAIN", "HUMAN_AUTHORED", "DOC_EXAMPLE"]
_FPS = [0.0, -0.3, -0.6, -0.7, -0.9, -1.7]
_PROV_SQL = f"(['{"', '".join(_PROV)}'])[1 + o_orderkey % 4]"
_CONF_SQL = "CAST(o_custkey % 101 AS DOUBLE) / 100"
_FP_SQL = f"([{', '.join(f'CAST({x} AS DOUBLE)' for x in _FPS)}])[1 + o_orderkey % 6]"


def _judged(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % len(xs)).cast("int"))
    return o.select(
        "o_orderkey", F.col("o_orderpriority").alias("path"), F.lit(1).alias("line_no"), F.concat(F.lit("Clerk#0000000"), F.col("o_custkey").cast("string")).alias("value"), F.col("o_orderstatus").alias("detector"), pick(_PROV).alias("provenance"),
        ((F.col("o_custkey") % 101).cast("double") / 100).alias("confidence"), pick(_FPS).alias("fp_adj"), F.array().cast("array<struct<name:string,value:string,confidence:double,reasoning:string>>").alias("signals"),
    )


_CLERK = "('Clerk#0000000' || o_custkey)"
_ORG = f"(CASE WHEN contains({_CLERK}, '7') THEN CAST(-0.3 AS DOUBLE) ELSE 0 END + CASE WHEN contains(o_orderpriority, 'URGENT') THEN CAST(0.2 AS DOUBLE) ELSE 0 END)"
_VERDICTS = f"""
SELECT *, CASE WHEN final < 0.1 THEN 'SUPPRESSED' WHEN total <= -0.8 THEN 'LIKELY_FALSE_POSITIVE' WHEN p = 'AUTH_CREDENTIAL' THEN 'LIKELY_TRUE_POSITIVE' WHEN p = 'UNCERTAIN' THEN 'NEEDS_VERIFICATION' ELSE 'LIKELY_FALSE_POSITIVE' END AS verdict
FROM (SELECT *, least(greatest(c + total, 0), 1) AS final FROM (SELECT o_orderkey, {_PROV_SQL} AS p, {_CONF_SQL} AS c, {_FP_SQL} + CAST({_ORG} AS DOUBLE) AS total, * EXCLUDE (o_orderkey) FROM orders))
"""
_RISK = "CASE WHEN verdict IN ('SUPPRESSED', 'LIKELY_FALSE_POSITIVE') THEN CASE WHEN final >= 0.5 THEN 'low' ELSE 'none' END WHEN final >= 0.9 THEN 'critical' WHEN final >= 0.7 THEN 'high' WHEN final >= 0.4 THEN 'medium' WHEN final >= 0.2 THEN 'low' ELSE 'none' END"
_SECRET = "verdict = 'LIKELY_TRUE_POSITIVE'"


def _analyzed(spark, sf_dir) -> DataFrame:
    return rules.analyze(_judged(spark, sf_dir), fp_patterns=["7"], tp_files=["URGENT"])


def verdicts(spark, sf_dir):
    """Verdicts, risks and flags of classified candidates."""
    t = _analyzed(spark, sf_dir)
    return t.select("o_orderkey", F.round("final_confidence", 6).alias("final_confidence"), "verdict", "verify", "notify", "is_secret", "block", "alert", "risk")


VERDICTS = f"""
SELECT o_orderkey, round(final, 6) AS final_confidence, verdict, p IN ('AUTH_CREDENTIAL', 'UNCERTAIN') AND final >= 0.1 AND total > -0.8 AS verify,
  p = 'AUTH_CREDENTIAL' AND final >= 0.3 AND total > -0.8 AS notify, {_SECRET} AS is_secret, {_SECRET} AND final >= 0.8 AS block, {_SECRET} AS alert, {_RISK} AS risk FROM ({_VERDICTS})
"""


def verification(spark, sf_dir):
    """The phases after the context: a table of verifications confirms or drops what was to be verified."""
    t = _analyzed(spark, sf_dir).withColumns({"line_no": F.col("o_orderkey").cast("int")})
    status = F.when(F.col("o_orderkey") % 3 == 0, "VERIFIED").otherwise("INACTIVE")
    known = t.where("o_orderkey % 5 <> 0").select("path", "line_no", "value", status.alias("status"))
    return rules.verify_phase(t, known).select("o_orderkey", "verdict", "verification", "is_secret", "blast_radius", "remediate")


VERIFICATION = f"""
SELECT o_orderkey, CASE WHEN asked AND s = 'VERIFIED' THEN 'CONFIRMED' WHEN asked THEN 'DROPPED' ELSE verdict END AS verdict, s AS verification,
  CASE WHEN asked THEN s = 'VERIFIED' ELSE {_SECRET} END AS is_secret, asked AND s = 'VERIFIED' AND final >= 0.7 AS blast_radius, asked AND s = 'VERIFIED' AND final >= 0.9 AS remediate
FROM (SELECT *, p IN ('AUTH_CREDENTIAL', 'UNCERTAIN') AND final >= 0.1 AND total > -0.8 AND s IS NOT NULL AS asked
  FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'VERIFIED' ELSE 'INACTIVE' END END AS s FROM ({_VERDICTS})))
"""


def ml_refinement(spark, sf_dir):
    """Uncertain candidates moved by a classifier's label and score."""
    t = _judged(spark, sf_dir).withColumns({"ml_label": (F.col("o_orderkey") % 2).cast("int"), "ml_score": (F.col("o_orderkey") % 101).cast("double") / 100})
    return rules.refine_with_score(t).select("o_orderkey", "provenance", F.round("confidence", 6).alias("confidence"))


_MOVED = [("l = 1 AND s >= 0.7", "'AUTH_CREDENTIAL'", "greatest(c, s * 0.85)"), ("l = 0 AND s >= 0.8", "'DOC_EXAMPLE'", "1 - s"), ("l = 1 AND s >= 0.55", "p", "least(c + (s - 0.5) * 0.4, 0.95)"), ("l = 0 AND s >= 0.6", "p", "greatest(c - (s - 0.5) * 0.3, 0.05)")]
ML_REFINEMENT = f"""
SELECT o_orderkey, CASE WHEN p <> 'UNCERTAIN' THEN p {" ".join(f"WHEN {w} THEN {a}" for w, a, _ in _MOVED)} ELSE p END AS provenance,
  round(CASE WHEN p <> 'UNCERTAIN' THEN c {" ".join(f"WHEN {w} THEN {b}" for w, _, b in _MOVED)} ELSE c END, 6) AS confidence
FROM (SELECT o_orderkey, {_PROV_SQL} AS p, {_CONF_SQL} AS c, o_orderkey % 2 AS l, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS s FROM orders)
"""


def scan_counters(spark, sf_dir):
    return analytics.scan_counters(_analyzed(spark, sf_dir))


SCAN_COUNTERS = f"SELECT count(*) AS candidates, count(*) FILTER (WHERE verdict IN ('SUPPRESSED', 'LIKELY_FALSE_POSITIVE')) AS suppressed, count(*) FILTER (WHERE {_SECRET}) AS found FROM ({_VERDICTS})"


def modes(spark, sf_dir):
    """What each mode of a scan shows."""
    t = _analyzed(spark, sf_dir)
    return post.by_mode(t, "raw").select(F.lit("raw").alias("mode"), "o_orderkey").unionByName(post.by_mode(t).select(F.lit("default").alias("mode"), "o_orderkey"))


MODES = f"SELECT 'raw' AS mode, o_orderkey FROM ({_VERDICTS}) WHERE {_SECRET} OR verdict = 'NEEDS_VERIFICATION' UNION ALL SELECT 'default', o_orderkey FROM ({_VERDICTS}) WHERE {_SECRET}"


def policy_report(spark, sf_dir):
    """Candidates that a policy reports, with its severities."""
    p = post.Policy(min_confidence=0.5, ignore_provenance=["DOC_EXAMPLE"], severity_map={"F": "low", "UNCERTAIN": "medium"}, allow_list=[{"pattern": "99"}, {"pattern": "1", "expires_at": "2001-01-01 00:00:00"}])
    return post.should_report(_judged(spark, sf_dir), p).select("o_orderkey", "severity")


POLICY_REPORT = f"SELECT o_orderkey, CASE WHEN p = 'UNCERTAIN' THEN 'medium' WHEN o_orderstatus = 'F' THEN 'low' ELSE {O.severity('c')} END AS severity FROM (SELECT *, {_PROV_SQL} AS p, {_CONF_SQL} AS c FROM orders) WHERE c >= 0.5 AND p <> 'DOC_EXAMPLE' AND NOT contains({_CLERK}, '99')"


def redact_levels(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_name").alias("v"))
    c = c.withColumn("v", F.expr("substring(v, 1, c_custkey % 19)"))
    return c.select("c_custkey", *[T.redact_level(F.col("v"), n).alias(f"at_{n}") for n in (0, 5, 50, 90, 100)])


def _level(n: int) -> str:
    shown = f"least(greatest(length(v) * {100 - n} // 100, 2), length(v) - 1)"
    return f"CASE WHEN {n} <= 0 THEN v WHEN {n} >= 100 OR length(v) <= 8 THEN '****' ELSE substr(v, 1, {shown}) || repeat('*', length(v) - {shown}) END AS at_{n}"


REDACT_LEVELS = f"SELECT c_custkey, {', '.join(_level(n) for n in (0, 5, 50, 90, 100))} FROM (SELECT c_custkey, substr(c_name, 1, c_custkey % 19) AS v FROM customer)"


def path_globs(spark, sf_dir):
    """Pages' urls by policy and history patterns."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"://(.*)", 1).alias("path"))
    return p.select("page_id", post.policy_glob(F.col("path"), "*[0-4]").alias("base"), post.policy_glob(F.col("path"), "/fr/").alias("part"), post.git_glob(F.col("path"), "blog.**").alias("without_stars"), post.git_glob(F.col("path"), "**/5").alias("ends"), post.path_filter(F.col("path"), ["www.**"], ["*.9"]).alias("kept"), post.inline_allowed(F.concat("path", F.lit(" # SIFTLAKE:allow "))).alias("inline"))


_BASE = "regexp_extract(path, '([^/]*)$', 1)"
PATH_GLOBS = f"SELECT page_id, regexp_matches({_BASE}, '^[^/]*[0-4]$') AS base, contains(path, '/fr/') AS part, contains(path, 'blog.') AS without_stars, ends_with(path, '5') AS ends, contains(path, 'www.') AND NOT ends_with(path, '.9') AS kept, true AS inline FROM (SELECT page_id, regexp_extract(url, '://(.*)', 1) AS path FROM pages)"


def candidate_lines(spark, sf_dir):
    """Lines of planted files that are candidates for training, by file."""
    rows = extract.lines(planted(spark, sf_dir))
    return rows.where(ml.candidate_line(F.col("line"))).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").cast("long").alias("places"))


#: By reading the eight patterns: quoted values of 8 and more, and a connection string.
_CANDIDATE_LINES = [2, 3, 10, 18, 19, 22, 24]
CANDIDATE_LINES = f"SELECT path, CAST({len(_CANDIDATE_LINES)} AS BIGINT) AS n, CAST({sum(_CANDIDATE_LINES)} AS BIGINT) AS places FROM ({_HASHED})"


# Events stand for stored scans, audit entries and metrics.
def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def audit_since(spark, sf_dir):
    """Audit entries from a time on, by time."""
    e = _events(spark, sf_dir)
    since = e.agg(F.max("ts")).first()[0]
    entries = e.select("ts", F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"), F.col("event_id").cast("string").alias("resource"), F.lit("success").alias("outcome"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("details"))
    return reports.audit_export(reports.entries_since(entries, since.replace(hour=0, minute=0, second=0, microsecond=0)), "csv").drop("details")


AUDIT_SINCE = "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_type AS action, CAST(user_id AS VARCHAR) AS actor, CAST(event_id AS VARCHAR) AS resource, 'success' AS outcome FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events)"


def metric_totals(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("labels")).agg(F.count(F.lit(1)).alias("value"))
    return analytics.metric_totals(e)


METRIC_TOTALS = "SELECT event_type AS name, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY 1"


def bars(spark, sf_dir):
    """Bars of a chart, the largest first, with their shares of the total."""
    e = _events(spark, sf_dir).groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return analytics.bars(e)


BARS = "SELECT event_type AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 4) AS share FROM events GROUP BY 1"


def history(spark, sf_dir):
    """Stored scans of a kind with a text, in any case."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.concat(F.lit("User_"), F.col("user_id").cast("string")).alias("target"), F.lit("done").alias("status"))
    return history_filter(e, "click", "USER_1").select("id", "target")


HISTORY = "SELECT event_id AS id, 'User_' || user_id AS target FROM events WHERE event_type = 'click' AND contains(lower(event_id || ' User_' || user_id || ' done'), 'user_1')"


def ui_findings(spark, sf_dir):
    """Findings by severity, provenance and text, as a list shows them."""
    t = _judged(spark, sf_dir).withColumns({"severity": T.severity(F.col("confidence")), "var_name": F.col("o_orderkey").cast("string")})
    return post.ui_filter(t, "high", "UNCERTAIN", "CLERK#0000000").select("o_orderkey", "path")


UI_FINDINGS = f"SELECT o_orderkey, o_orderpriority AS path FROM (SELECT *, {_PROV_SQL} AS p, {_CONF_SQL} AS c FROM orders) WHERE c >= 0.7 AND c < 0.9 AND p = 'UNCERTAIN' AND contains(lower(o_orderpriority || ' ' || o_orderkey || ' ' || {_CLERK} || ' ' || o_orderstatus), 'clerk#0000000')"


def scan_totals(spark, sf_dir):
    """Totals of stored scans and the mean duration of the completed ones."""
    e = _events(spark, sf_dir)
    scans = e.select(F.col("value").alias("duration"), (F.col("event_id") % 7).alias("total_findings"), F.when(F.col("event_type") == "click", "completed").otherwise("failed").alias("status"))
    return analytics.scan_totals(scans).select("scans", F.col("findings").cast("long").alias("findings"), F.round("avg_duration", 6).alias("avg_duration"))


SCAN_TOTALS = "SELECT count(*) AS scans, CAST(sum(event_id % 7) AS BIGINT) AS findings, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS avg_duration FROM events"


def baseline_changes(spark, sf_dir):
    """Fingerprints that are new, gone or kept between two scans."""
    o = _judged(spark, sf_dir).withColumn("fingerprint", F.sha2(F.col("o_orderkey").cast("string"), 256))
    return post.baseline_diff(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 <> 0"))


BASELINE_CHANGES = "SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS fingerprint, CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 4 = 0 THEN 'removed' ELSE 'kept' END AS change FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0"


def durations(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", analytics.duration_text((F.col("event_id") % 9973).cast("double") / F.when(F.col("event_id") % 3 == 0, 20000).otherwise(2)).alias("took"))


DURATIONS = """
SELECT event_id, CASE WHEN s < 1 THEN CAST(CAST(round(s * 1000) AS BIGINT) AS VARCHAR) || 'ms' WHEN s < 60 THEN printf('%.1fs', s)
  WHEN s < 3600 THEN (CAST(floor(s) AS BIGINT) // 60) || 'm ' || (CAST(floor(s) AS BIGINT) % 60) || 's'
  ELSE (CAST(floor(s) AS BIGINT) // 3600) || 'h ' || (CAST(floor(s) AS BIGINT) // 60 % 60) || 'm ' || (CAST(floor(s) AS BIGINT) % 60) || 's' END AS took
FROM (SELECT event_id, CAST(event_id % 9973 AS DOUBLE) / CASE WHEN event_id % 3 = 0 THEN 20000 ELSE 2 END AS s FROM events)
"""

SQL = {
    planted_decode: _DECODED, verdicts: VERDICTS, verification: VERIFICATION, ml_refinement: ML_REFINEMENT, scan_counters: SCAN_COUNTERS, modes: MODES,
    policy_report: POLICY_REPORT, redact_levels: REDACT_LEVELS, path_globs: PATH_GLOBS, candidate_lines: CANDIDATE_LINES, audit_since: AUDIT_SINCE, metric_totals: METRIC_TOTALS, bars: BARS,
    history: HISTORY, ui_findings: UI_FINDINGS, scan_totals: SCAN_TOTALS, baseline_changes: BASELINE_CHANGES, durations: DURATIONS,
}
