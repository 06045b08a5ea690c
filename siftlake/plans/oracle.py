"""DuckDB expressions that mirror the Column builders, for the queries' SQL."""

from __future__ import annotations


from siftlake.functions import vocab as V


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(p: str) -> str:
    """A pattern of ours as an RE2 literal; Java's \\z is RE2's too."""
    return q(p)


def words(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def tuple_of(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def contains_any(col: str, xs) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(x)})" for x in xs) + ")"


def starts_any(col: str, xs) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {q(x)})" for x in xs) + ")"


def matches(col: str, p: str) -> str:
    return f"regexp_matches({col}, {pattern(p)})"


def extract(col: str, p: str, g: int) -> str:
    return f"regexp_extract({col}, {pattern(p)}, {g})"


def extract_all(col: str, p: str, g: int = 0) -> str:
    return f"regexp_extract_all({col}, {pattern(p)}, {g})"


def split_name(col: str) -> str:
    s = f"regexp_replace({col}, '^[^A-Za-z0-9]+', '')"
    s = f"regexp_replace(regexp_replace({s}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')"
    return f"list_filter(list_transform(string_split_regex({s}, '[-_./\\\\ \\t]+'), lambda x: lower(x)), lambda x: x <> '')"


def entropy(col: str) -> str:
    b = f"regexp_extract_all(hex({col}), '..')"
    return f"coalesce(list_sum(list_transform(list_sort(list_distinct({b})), lambda c: -(len(list_filter({b}, lambda y: y = c)) / len({b})) * log2(len(list_filter({b}, lambda y: y = c)) / len({b})))), 0.0)"


def unique_ratio(col: str) -> str:
    b = f"regexp_extract_all(hex({col}), '..')"
    return f"(len(list_distinct({b})) / greatest(len({b}), 1))"


def screen(col: str) -> str:
    r, n = unique_ratio(col), f"strlen({col})"
    return f"CASE WHEN {n} < 16 OR {r} <= 0.25 THEN false WHEN {r} > 0.85 AND {n} > 20 THEN true WHEN {r} < 0.35 AND {n} < 30 THEN false ELSE true END"


def charset(col: str) -> str:
    return f"CASE WHEN {matches(col, '^[0-9A-Fa-f]+$')} THEN 'hex' WHEN {matches(col, '^[0-9A-Za-z+/=]*[+/=][0-9A-Za-z+/=]*$')} THEN 'base64' WHEN {matches(col, '^[0-9A-Za-z]*$')} THEN 'alphanum' ELSE 'mixed' END"


def prefix(col: str) -> str:
    rows = sorted(V.PREFIXES, key=len, reverse=True)
    return "CASE " + " ".join(f"WHEN starts_with({col}, {q(p)}) THEN {q(p)}" for p in rows) + " END"


def ecosystem(col: str) -> str:
    rows = sorted(V.PREFIXES, key=len, reverse=True)
    return "CASE " + " ".join(f"WHEN starts_with({col}, {q(p)}) THEN {q(V.PREFIXES[p])}" for p in rows) + " END"


def identifier(col: str) -> str:
    low = f"lower({col})"
    known = words(V.IDENTIFIER_WORDS)
    parts = f"len(list_filter(string_split({low}, '_'), lambda p: length(p) > 2 AND NOT list_contains({known}, p))) = 0"
    return f"(strlen({col}) >= 3 AND {matches(col, '^(?:[a-z0-9_]+|[A-Z0-9_]+)$')} AND CASE WHEN contains({col}, '_') THEN {parts} ELSE list_contains({known}, {low}) END)"


def not_secret(v: str) -> str:
    tests = [
        f"contains({v}, '${{') OR contains({v}, '$(')",
        f"length({v}) - length(replace({v}, '%', '')) >= 2",
        f"contains({v}, '{{{{')",
        f"(starts_with({v}, '`') AND ends_with({v}, '`'))",
        f"contains({v}, '</') OR contains({v}, '/>')",
        f"{v} IN {tuple_of(V.WELL_KNOWN_DEFAULTS)}",
        f"starts_with({v}, '$')",
        starts_any(v, V.ENV_READS),
        f"({matches(v, '^(?:[a-z0-9_]{8,}|[A-Z0-9_]{8,})$')} AND {matches(v, '_.*_')})",
    ]
    return f"(strlen({v}) >= 8 AND ({' OR '.join(tests)}))"


def has_signal(col: str) -> str:
    return f"(strlen({col}) >= 10 AND (contains({col}, '=') OR contains({col}, ':') OR contains({col}, '-') OR (contains({col}, '\"') AND {contains_any(col, V.PREFIXES)})))"


def trim_quotes(col: str) -> str:
    return f"regexp_replace({col}, {q(chr(94) + '[' + chr(34) + chr(39) + ']+|[' + chr(34) + chr(39) + ']+$')}, '', 'g')"


def candidates(line: str) -> str:
    """List of (var_name, value) of a line, with repeats."""
    g = {k: extract_all(line, V.ASSIGNMENTS, k) for k in range(1, 11)}
    at = lambda k: f"{g[k]}[i]"
    trimmed = trim_quotes(f"regexp_replace({at(6)}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')")
    name = f"CASE WHEN {at(1)} <> '' THEN {at(1)} WHEN {at(3)} <> '' THEN {at(3)} WHEN {at(5)} <> '' THEN {at(5)} WHEN {at(7)} <> '' THEN {at(7)} WHEN {at(9)} <> '' THEN 'private_key_header' ELSE 'connection_string' END"
    value = f"CASE WHEN {at(1)} <> '' THEN {at(2)} WHEN {at(3)} <> '' THEN {at(4)} WHEN {at(5)} <> '' THEN {trimmed} WHEN {at(7)} <> '' THEN {at(8)} WHEN {at(9)} <> '' THEN {at(9)} ELSE {at(10)} END"
    keep = lambda xs: f"list_filter({xs}, lambda c: c.value <> '' AND NOT {not_secret('c.value')})"
    one = lambda n, v, ok="true": f"CASE WHEN {ok} THEN [{{'var_name': {n}, 'value': {v}}}] ELSE [] END"
    ado = f"regexp_replace({extract(line, V.ADO, 1)}, {q('[;' + chr(34) + chr(39) + ']+$')}, '')"
    url = extract(line, V.URL_TOKEN, 1)
    quoted = extract_all(line, V.QUOTED_PREFIX, 1)
    plain = lambda xs, n: f"list_transform({xs}, lambda v: {{'var_name': {q(n)}, 'value': v}})"
    parts = [
        keep(f"list_transform(range(1, len({g[1]}) + 1), lambda i: {{'var_name': {name}, 'value': {value}}})"),
        one(extract(line, V.YAML, 1), extract(line, V.YAML, 2), f"{extract(line, V.YAML, 2)} <> ''"),
        *[keep(one(extract(line, p, 1), extract(line, p, 2))) for p in (V.DOCKER_ENV, V.LIST_ENV)],
        keep(one("'_authToken'", extract(line, V.NPM, 1))),
        keep(one("'password'", ado, f"strlen({ado}) >= 8")),
        keep(one("'url_embedded_token'", url, starts_any(url, V.PREFIXES))),
        keep(plain(quoted, "credential_value")),
        keep(one("'cli_arg_credential'", extract(line, V.CLI_PREFIX, 1))),
        f"CASE WHEN len({quoted}) > 0 THEN " + keep(plain(f"list_filter({extract_all(line, V.ARGUMENT, 1)}, lambda v: NOT {starts_any('v', V.PREFIXES)})", "credential_secret")) + " ELSE [] END",
    ]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def role(col: str) -> str:
    a = split_name(col)
    c, n = (f"len(list_filter({a}, lambda x: list_contains({words(ws)}, x)))" for ws in (V.CREDENTIAL_ATOMS, V.ANTI_ATOMS))
    return (
        f"CASE WHEN {col} = '' THEN 'neutral' WHEN lower(replace({col}, '-', '_')) IN {tuple_of(V.CREDENTIAL_NAMES)} THEN 'strong_credential' "
        f"WHEN {c} > 0 AND {n} = 0 THEN 'strong_credential' WHEN {c} > 0 THEN 'neutral' WHEN {n} > 0 THEN 'anti_credential' WHEN list_contains({a}, 'api') THEN 'weak_credential' ELSE 'neutral' END"
    )


def repeats(v: str) -> str:
    return "(" + " OR ".join(f"(length({v}) >= {2 * k} AND length({v}) % {k} = 0 AND repeat(left({v}, {k}), length({v}) // {k}) = {v})" for k in range(8, 17)) + ")"


def base64_binary(v: str) -> str:
    strict = matches(v, "^(?:[A-Za-z0-9+/]{4})+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$|^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)$")
    b = f"regexp_extract_all(hex(from_base64({v})), '..')"
    return f"CASE WHEN strlen({v}) >= 16 AND strlen({v}) % 4 = 0 AND {strict} THEN len(list_filter({b}, lambda x: x >= '20' AND x <= '7E')) / len({b}) < 0.7 ELSE false END"


def morphology(v: str, r: str) -> str:
    """'kind' or 'kind/subtype' of a value."""
    p = prefix(v)
    rest = f"lower(substr({v}, length({p}) + 1))"
    base, ext = extract(rest, r"(?s)^(.+)(\.[^.]*)$", 1), extract(rest, r"(?s)^(.+)(\.[^.]*)$", 2)
    pw = extract(v, V.DB_PASSWORD, 1)
    cred = f"{r} IN ('strong_credential', 'weak_credential')"
    hashed = f"strlen({v}) IN ({', '.join(map(str, V.HASH_LENGTHS))}) AND {matches(v, '^[0-9A-Fa-f]+$')}"
    dots = f"(length({v}) - length(replace({v}, '.', '')))"
    space = f"contains({v}, ' ')"
    jwt_part = "(?:[A-Za-z0-9_-]+={0,2})?"
    cases = [
        (f"{p} IS NOT NULL AND {contains_any(rest, V.PLACEHOLDER_STEMS)}", "template_placeholder"),
        (f"{p} IS NOT NULL AND ({identifier(rest)} OR ({ext} IN {tuple_of(V.IDENTIFIER_FILE_EXTENSIONS)} AND {identifier(base)}))", "human_typed"),
        (f"{p} IS NOT NULL", "prefixed_random"),
        (starts_any(v, ["ssh-rsa ", "ssh-ed25519 ", "ssh-dss ", "ecdsa-sha2-"]), "human_typed"),
        (contains_any(v, ["-----BEGIN PUBLIC KEY", "-----BEGIN CERTIFICATE"]), "human_typed"),
        (f"contains({v}, '-----BEGIN') AND contains({v}, 'PRIVATE KEY')", "private_key"),
        (f"contains({v}, '://') AND {matches(v, V.DB_SCHEME)} AND {pw} <> '' AND lower({pw}) NOT IN {tuple_of(V.PLACEHOLDER_PASSWORDS)}", "connection_string/real"),
        (f"contains({v}, '://') AND {matches(v, V.DB_SCHEME)} AND {pw} <> ''", "connection_string"),
        (f"{dots} = 2 AND starts_with({v}, 'eyJ') AND {matches(v, '^' + jwt_part + chr(92) + '.' + jwt_part + chr(92) + '.' + jwt_part + '$')}", "jwt"),
        (f"lower({trim_quotes(v)}) IN {tuple_of(V.PLACEHOLDER_WORDS)}", "template_placeholder"),
        (matches(v, "^(?:[xX]{4,}|[.]{4,})$"), "template_placeholder"),
        (matches(v, r"(?i)^your[_-][^\n]*[_-]here$"), "template_placeholder"),
        (matches(v, "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"), "structured_random/uuid"),
        (f"{hashed} AND {repeats(v)}", "structured_random/repeating_pattern"),
        (f"{hashed} AND {cred}", "machine_random"),
        (hashed, "structured_random/hash"),
        (f"strlen({v}) > 1 AND starts_with({v}, '/') AND NOT {space} AND NOT contains({v}, '://')", "human_typed"),
        (starts_any(v, ["./", "../", "http://", "https://"]), "human_typed"),
        (f"{dots} >= 2 AND {matches(v, r'^[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+$')}", "human_typed"),
        (f"{matches(v, r'(?s)^[^/]*[.][^/]*/.+$')} AND NOT {space}", "human_typed"),
        (f"strpos({v}, '@') > 1 AND strlen(split_part({v}, '@', 1)) < strlen({v}) - 3 AND contains(substr({v}, strpos({v}, '@') + 1), '.') AND NOT {space}", "human_typed"),
        (f"length({v}) - length(replace({v}, ':', '')) >= 4 AND NOT {space}", "human_typed"),
        (f"{base64_binary(v)} AND {cred}", "machine_random"),
        (base64_binary(v), "encoded_payload"),
        (f"strlen({v}) BETWEEN 16 AND 512 AND {screen(v)} AND {entropy(v)} > 3.5", "machine_random"),
        (f"strlen({v}) BETWEEN 8 AND 20 AND {r} = 'strong_credential' AND {matches(v, '[@!#$%&*]')}", "machine_random"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {q(k)}" for c, k in cases) + " ELSE 'human_typed' END"


def file_kind(path: str) -> str:
    low = f"lower({path})"
    name = extract(low, r"([^/]*)$", 1)
    ends = lambda xs: "(" + " OR ".join(f"ends_with({name}, {q(x)})" for x in xs) + ")"
    cases = [
        (f"{name} IN {tuple_of(V.LOCK_FILES)}", "build_artifact"),
        (contains_any(name, [".example", ".sample", ".template", ".dist", ".default"]), "example_config"),
        (matches(path, V.TEST_PATH), "test"),
        (ends([".md", ".rst", ".txt", ".adoc"]), "documentation"),
        (f"{matches(low, V.DOCS_PATH)} OR {starts_any(name, ['readme', 'contributing', 'changelog'])}", "documentation"),
        (matches(low, V.BUILD_PATH), "build_artifact"),
        (f"({name} = '.env' OR {matches(name, '^[.]env[.][a-z]+$')}) AND NOT {contains_any(name, ['example', 'sample'])}", "env_config"),
        (f"{name} IN ('docker-compose.yml', 'docker-compose.yaml')", "env_config"),
        (ends([".tf", ".tfvars", ".hcl"]), "iac"),
        (matches(low, V.CI_PATH), "cicd"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {q(k)}" for c, k in cases) + " ELSE 'source' END"


def _bounded(low: str, w: str) -> str:
    at = f"strpos({low}, {q(w)})"
    return f"({at} > 0 AND NOT regexp_matches(substr({low}, greatest({at} - 1, 1), CASE WHEN {at} = 1 THEN 0 ELSE 1 END), '[a-z]') AND NOT regexp_matches(substr({low}, {at} + {len(w)}, 1), '[a-z]'))"


def line_adjustment(line: str) -> str:
    s = f"regexp_replace({line}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')"
    low = f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    comment = f"CASE WHEN {starts_any(s, V.COMMENT_MARKS)} THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END"
    word = f"CASE WHEN {' OR '.join(_bounded(low, w) for w in V.REVOKE_WORDS)} THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END"
    rest = f"substr({low}, strpos({low}, 'do') + 2)"
    use = f"({_bounded(low, 'do')} AND strpos({rest}, 'not') > 0 AND contains(substr({rest}, strpos({rest}, 'not') + 3), 'use'))"
    at = f"strpos({low}, 'old')"
    old = f"({at} > 0 AND substr({low}, {at} + 3, 1) IN ('_', ' ', chr(9)) AND NOT regexp_matches(substr({low}, greatest({at} - 1, 1), CASE WHEN {at} = 1 THEN 0 ELSE 1 END), '[a-z]'))"
    env = f"({contains_any(s, V.ENV_IN_LINE)} OR regexp_matches({s}, '[$][A-Z]'))"
    return (
        f"(SELECT a3 + CASE WHEN a3 > -0.5 AND {env} THEN -0.8::DOUBLE ELSE 0.0::DOUBLE END FROM (SELECT a2 + CASE WHEN a2 > -0.5 AND {old} THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS a3 FROM "
        f"(SELECT a1 + CASE WHEN a1 > -0.5 AND {use} THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS a2 FROM (SELECT {comment} + {word} AS a1))))"
    )


def decide(role_: str, m: str, f: str, adj: str) -> tuple[str, str]:
    """(provenance/rule, confidence) expressions; m is 'kind/subtype'."""
    kind = f"split_part({m}, '/', 1)"
    tdx = f"{f} IN ('test', 'documentation', 'example_config')"
    rnd = f"{kind} = 'machine_random'"
    cases = [
        (f"{kind} = 'prefixed_random'", "AUTH_CREDENTIAL", f"greatest(0.1, CASE WHEN {tdx} THEN 0.6 ELSE 0.95 END - CASE WHEN {adj} < -0.3::DOUBLE THEN 0.3 ELSE 0 END)"),
        (f"{kind} = 'private_key'", "AUTH_CREDENTIAL", f"CASE WHEN {tdx} THEN 0.5 ELSE 0.9 END"),
        (f"{m} = 'connection_string/real'", "AUTH_CREDENTIAL", f"greatest(0.1, CASE WHEN {f} = 'test' THEN 0.55 WHEN {f} IN ('documentation', 'example_config') THEN 0.2 ELSE 0.85 END + {adj} * 0.3)"),
        (f"{m} = 'connection_string'", "DOC_EXAMPLE", "0.9"),
        (f"{kind} = 'jwt'", "AUTH_CREDENTIAL", f"greatest(0.1, CASE WHEN {f} IN ('test', 'documentation') THEN 0.4 ELSE 0.8 END + {adj} * 0.3)"),
        (f"{role_} = 'strong_credential' AND {rnd}", "AUTH_CREDENTIAL", f"greatest(0.1, CASE WHEN {f} IN ('test', 'example_config') THEN 0.5 WHEN {f} = 'documentation' THEN 0.3 ELSE 0.85 END + {adj} * 0.3)"),
        (f"{kind} = 'template_placeholder'", "DOC_EXAMPLE", "0.95"),
        (f"{m} = 'structured_random/uuid'", "BUILD_GENERATED", "0.95"),
        (f"{m} = 'structured_random/hash'", "BUILD_GENERATED", "0.9"),
        (f"{kind} = 'encoded_payload'", "DERIVED_VALUE", "0.85"),
        (f"{f} IN ('test', 'documentation', 'example_config', 'build_artifact') AND {role_} NOT IN ('strong_credential', 'weak_credential')", "DOC_EXAMPLE", "0.8"),
        (f"{role_} = 'weak_credential' AND {rnd}", "UNCERTAIN", "0.5"),
        (f"{rnd} AND {f} IN ('env_config', 'iac', 'cicd')", "UNCERTAIN", "0.5"),
        (f"{kind} = 'human_typed'", "HUMAN_AUTHORED", "0.9"),
        (f"{rnd} AND {role_} = 'anti_credential'", "BUILD_GENERATED", "0.7"),
        (rnd, "UNCERTAIN", "0.4"),
    ]
    p = "CASE " + " ".join(f"WHEN {c} THEN {q(x)}" for c, x, _ in cases) + " ELSE 'HUMAN_AUTHORED' END"
    n = "CASE " + " ".join(f"WHEN {c} THEN ({x})::DOUBLE" for c, _, x in cases) + " ELSE 0.85 END"
    return p, f"round({n}, 4)"


def severity(c: str) -> str:
    return f"CASE WHEN {c} >= 0.9 THEN 'critical' WHEN {c} >= 0.7 THEN 'high' WHEN {c} >= 0.5 THEN 'medium' WHEN {c} >= 0.3 THEN 'low' ELSE 'info' END"


def redact(v: str) -> str:
    return f"CASE WHEN length({v}) > 16 THEN left({v}, 6) || '...' || right({v}, 4) WHEN length({v}) > 8 THEN left({v}, 4) || '****' ELSE '****' END"


def keyword_score(w: str) -> str:
    low = f"lower({w})"
    s = "0.5::DOUBLE + (0.0::DOUBLE" + "".join(f" + CASE WHEN contains({low}, {q(x)}) THEN 0.15 ELSE 0 END" for x in V.ML_POSITIVE) + "".join(f" - CASE WHEN contains({low}, {q(x)}) THEN 0.2 ELSE 0 END" for x in V.ML_NEGATIVE) + ")"
    return f"round(least(1.0, greatest(0.0, {s})), 4)"


