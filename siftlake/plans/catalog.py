"""Registered queries of the engine, each over its whole table, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import vocab as V
from siftlake.operators import analytics, decode, extract, fp, ml, post, rules, signals
from siftlake.plans import oracle as O
from siftlake.plans import pipeline, planted
from siftlake.sources import files as sources
from siftlake.sources.store import cut

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents stand for source files.
_PATH_SQL = "'src/' || source || '/doc_' || doc_id || '.py'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return sources.table_as_files(d, F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")))


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def _values_sql(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(O.q(x) for x in r) + ')' for r in rows)}) AS t({', '.join(names.split())}))"


_LINES = f"SELECT path, i AS line_no, parts[i] AS line FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT {_PATH_SQL} AS path, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))"
_CANDIDATES = f"""
SELECT path, line_no, line, j - 1 AS ord, cs[j].var_name AS var_name, cs[j].value AS value
FROM (SELECT path, line_no, line, cs, unnest(range(1, len(cs) + 1)) AS j FROM (SELECT path, line_no, line, {O.candidates('line')} AS cs FROM (SELECT * FROM ({_LINES}) WHERE {O.has_signal('line')})))
WHERE NOT list_contains(list_transform(cs[1:j - 1], lambda c: c.value), cs[j].value)
"""


@query(f"SELECT path, CAST(line_no AS INT) AS line_no, strlen(line) AS n_bytes FROM ({_LINES}) WHERE {O.has_signal('line')}")
def lines_prefilter(spark, sf_dir):
    return extract.lines(_docs(spark, sf_dir)).where(extract.has_signal(F.col("line"))).select("path", "line_no", F.octet_length("line").cast("long").alias("n_bytes"))


@query(f"SELECT path, CAST(line_no AS INT) AS line_no, CAST(row_number() OVER (PARTITION BY path, line_no ORDER BY ord) - 1 AS INT) AS ord, var_name, value FROM ({_CANDIDATES})")
def extract_base(spark, sf_dir):
    return extract.extract(_docs(spark, sf_dir)).select("path", "line_no", "ord", "var_name", "value")


_p, _c = O.decide("role", "m", "'source'", "adj")
_CLASSIFIED = f"""
SELECT path, CAST(line_no AS INT) AS line_no, line, var_name, value, role, split_part(m, '/', 1) AS morphology, round(adj, 2) AS line_adj, {_p} AS provenance, {_c} AS confidence
FROM (SELECT *, {O.morphology('value', 'role')} AS m, {O.line_adjustment('line')} AS adj FROM (SELECT *, {O.role('var_name')} AS role FROM ({_CANDIDATES})))
"""


@query(f"SELECT path, line_no, var_name, {O.redact('value')} AS value_redacted, role, morphology, line_adj, provenance, confidence FROM ({_CLASSIFIED})")
def classify_tokens(spark, sf_dir):
    t = rules.classify(pipeline.candidates(_docs(spark, sf_dir)))
    return t.select("path", "line_no", "var_name", T.redact(F.col("value")).alias("value_redacted"), "role", "morphology", F.round("line_adj", 2).alias("line_adj"), "provenance", F.round("confidence", 4).alias("confidence"))


@query(f"SELECT provenance, role, morphology, count(*) AS n, round(avg(confidence), 4) AS avg_confidence FROM ({_CLASSIFIED}) GROUP BY ALL")
def classify_summary(spark, sf_dir):
    t = rules.classify(pipeline.candidates(_docs(spark, sf_dir)))
    return t.groupBy("provenance", "role", "morphology").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round("confidence", 4)), 4).alias("avg_confidence"))


@query(f"SELECT path, line_no, {O.severity('confidence')} AS severity, substr(sha256(path || ':' || line_no || ':' || morphology || ':' || value), 1, 32) AS fingerprint FROM ({_CLASSIFIED}) WHERE provenance = 'AUTH_CREDENTIAL'")
def fingerprints(spark, sf_dir):
    t = rules.classify(pipeline.candidates(_docs(spark, sf_dir))).where("provenance = 'AUTH_CREDENTIAL'").withColumn("detector", F.col("morphology"))
    return post.with_fingerprint(t).select("path", "line_no", T.severity(F.round("confidence", 4)).alias("severity"), "fingerprint")


@query(f"""
SELECT value_hash, path, line_no FROM (SELECT sha256(value) AS value_hash, path, line_no,
  row_number() OVER (PARTITION BY sha256(value), var_name ORDER BY doc, path, line_no) AS k
  FROM (SELECT *, CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) AS doc FROM ({_CLASSIFIED}))) WHERE k = 1
""")
def dedup_earliest(spark, sf_dir):
    t = pipeline.candidates(_docs(spark, sf_dir)).withColumns({"value_hash": F.sha2("value", 256), "doc": F.regexp_extract("path", "doc_([0-9]+)", 1).cast("long")})
    return post.earliest(t, ["value_hash", "var_name"], "doc").select("value_hash", "path", "line_no")


@query(f"SELECT path, line_no, morphology FROM ({_CLASSIFIED}) WHERE CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) % 2 = 1")
def baseline_anti(spark, sf_dir):
    """Findings that are new against a baseline of the documents of even id."""
    t = rules.classify(pipeline.candidates(_docs(spark, sf_dir))).withColumn("detector", F.col("morphology"))
    t = cut(post.with_fingerprint(t).select("path", "line_no", "morphology", "detector", "fingerprint"))
    old = t.where(F.regexp_extract("path", "doc_([0-9]+)", 1).cast("long") % 2 == 0)
    return post.new_findings(t, post.baseline_of(old)).select("path", "line_no", "morphology")


@query(f"SELECT path, line_no, var_name FROM ({_CANDIDATES}) WHERE NOT contains(value, 'a1') AND NOT contains(value, 'example.com')")
def allowlist_anti(spark, sf_dir):
    allow = spark.createDataFrame([("a1", None), ("example.com", "2999-01-01 00:00:00"), ("b2", "2001-01-01 00:00:00")], "pattern string, expires_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
    return post.allow_listed(pipeline.candidates(_docs(spark, sf_dir)), allow).select("path", "line_no", "var_name")


_WINDOW = """trim(list_aggregate(list_transform(range(greatest(line_no - 10, 1), least(line_no + 10, len(parts)) + 1),
  lambda k: CASE WHEN k = line_no THEN '>>> LINE ' || line_no || ' <<<' || chr(10) || parts[k] ELSE parts[k] END), 'string_agg', chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"""
_WINDOWS = f"SELECT c.path, c.line_no, c.value, {_WINDOW} AS w FROM ({_CANDIDATES}) c JOIN (SELECT {_PATH_SQL} AS path, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d ON c.path = d.path"


@query(f"SELECT path, CAST(line_no AS INT) AS line_no, md5(w) AS window_md5, {O.keyword_score('w')} AS score FROM ({_WINDOWS})")
def heuristic_score(spark, sf_dir):
    """Context windows of all candidates and their keyword scores."""
    docs = _docs(spark, sf_dir)
    t = extract.extract(docs).select("path", "line_no").join(docs, "path")
    t = t.withColumn("w", ml.context_window(F.col("content"), F.col("line_no")))
    return t.select("path", "line_no", F.md5("w").alias("window_md5"), ml.keyword_score(F.col("w"))["confidence"].alias("score"))


@query(f"SELECT c.path, CAST(c.line_no AS INT) AS line_no, l.quality, l.toxic FROM ({_CANDIDATES}) c LEFT JOIN labels l ON CAST(regexp_extract(c.path, 'doc_([0-9]+)', 1) AS BIGINT) = l.doc_id")
def label_join(spark, sf_dir):
    t = extract.extract(_docs(spark, sf_dir)).withColumn("doc_id", F.regexp_extract("path", "doc_([0-9]+)", 1).cast("long"))
    return t.join(_read(spark, sf_dir, "labels"), "doc_id", "left").select("path", "line_no", "quality", "toxic")


_LOW = "lower(line)"
_FP = f"""
SELECT path, CAST(line_no AS INT) AS line_no, var_name, round(CASE WHEN {O.matches('value', '^[$][A-Z0-9_]+$')} OR (contains(value, '${{') AND contains(value, '}}')) OR {O.contains_any('value', ["os.Getenv", "os.LookupEnv", "process.env.", "process.env[", "os.environ", "os.getenv", "System.getenv"])} OR {O.starts_any('value', ["ENV[", "ENV.fetch"])} THEN -1.0
  WHEN value IN {O.tuple_of(V.DEAD_VALUES)} OR {O.starts_any('value', V.TEST_PREFIXES)} OR {O.starts_any('lower(value)', V.PLACEHOLDER_PREFIXES)} OR (NOT contains(value, '://') AND contains(lower(value), 'example') AND strlen(value) >= 16) THEN -1.0
  ELSE CASE WHEN {O.contains_any(_LOW, V.EXTERNAL_LOADS)} THEN -0.8 ELSE 0 END + CASE WHEN {O.contains_any(_LOW, V.INSTRUCTIONS)} THEN -0.7 ELSE 0 END
   + CASE WHEN {O.contains_any('lower(var_name)', V.ALLOWLIST_KEYS)} OR {O.contains_any(_LOW, [f'{a}{k}{a}' for k in V.ALLOWLIST_KEYS for a in (chr(34), chr(39))] + ['scan_exception', 'approved_by'])} OR {O.contains_any('lower(path)', V.ALLOWLIST_PATHS)} THEN -0.9 ELSE 0 END
   + CASE WHEN {O.contains_any('lower(path)', V.SUPPRESSED_DIRS)} THEN -0.6 ELSE 0 END
   + CASE WHEN {O.contains_any('lower(path)', ['revok', 'rotat', 'deprecat'])} OR {O.contains_any('content', ['key rotation', 'credential rotation', 'revoked keys', 'deprecated credentials'])} THEN -0.9 ELSE 0 END END, 2) AS fp_adj
FROM (SELECT c.*, lower(coalesce(d.text, '')) AS content FROM ({_CANDIDATES}) c JOIN documents d ON c.path = {_PATH_SQL})
WHERE NOT (lower(var_name) = 'key' OR ends_with(lower(var_name), '_key') OR starts_with(lower(var_name), 'key_') OR {O.contains_any('lower(var_name)', ["nist", "test_vector", "test_key", "test_iv", "test_tag", "test_nonce"])} OR {O.contains_any(_LOW, ["fromhex", "from_hex", "hex_decode", "unhexlify"])})
"""


@query(_FP)
def fp_signals(spark, sf_dir):
    """Adjustments of the candidates that aren't named like cryptographic keys."""
    docs = _docs(spark, sf_dir)
    t = extract.extract(docs).drop("ord")
    n = F.lower("var_name")
    crypto = (n == "key") | n.endswith("_key") | n.startswith("key_") | T.contains_any(n, ["nist", "test_vector", "test_key", "test_iv", "test_tag", "test_nonce"]) | T.contains_any(F.lower("line"), ["fromhex", "from_hex", "hex_decode", "unhexlify"])
    return fp.apply(t.where(~crypto), fp.file_context(docs)).select("path", "line_no", "var_name", F.round("fp_adj", 2).alias("fp_adj"))


_CRYPTO = f"""({O.contains_any('lower(var_name)', ["nist", "test_vector", "test_key", "test_iv", "test_tag", "test_nonce"])}
  OR ({O.contains_any(_LOW, ["fromhex", "from_hex", "hex_decode", "unhexlify"])} AND {O.contains_any('lower(var_name)', ["key", "iv", "nonce", "tag", "cipher", "plain"])})
  OR ((lower(var_name) = 'key' OR ends_with(lower(var_name), '_key') OR starts_with(lower(var_name), 'key_')) AND regexp_matches(value, '^[0-9a-fA-F]+$') AND strlen(value) IN ({', '.join(map(str, V.CRYPTO_KEY_LENGTHS))})
    AND ({O.contains_any('content', V.CRYPTO_IMPORTS)} OR coalesce(list_bool_or(list_transform(parts[greatest(first - 5, 1):first + 4], lambda x: {O.contains_any('lower(x)', [y for s in V.CRYPTO_SIBLINGS for y in (f'"{s}"', f"'{s}'", f"{s}:", f"{s} =")])})), false))))"""
_ADJUSTMENT = _FP[_FP.index("round(CASE") + 6 : _FP.index(", 2) AS fp_adj")].replace("  ELSE CASE", f"  WHEN {_CRYPTO} THEN -1.0 ELSE CASE")
_SCANNED = f"""
SELECT *, least(greatest(confidence + adj, 0), 1) AS final FROM (SELECT * EXCLUDE (provenance, confidence), CAST({_ADJUSTMENT} AS DOUBLE) AS adj,
  CASE WHEN provenance = 'UNCERTAIN' AND s >= 0.7 THEN 'AUTH_CREDENTIAL' WHEN provenance = 'UNCERTAIN' AND s < 0.55 AND s >= 0.8 THEN 'DOC_EXAMPLE' ELSE provenance END AS provenance,
  CASE WHEN provenance = 'UNCERTAIN' THEN CASE WHEN s >= 0.7 THEN greatest(confidence, s * 0.85) WHEN s < 0.55 AND s >= 0.8 THEN 1 - s WHEN s >= 0.55 THEN least(confidence + (s - 0.5) * 0.4, 0.95)
    WHEN s < 0.55 AND s >= 0.6 THEN greatest(confidence - (s - 0.5) * 0.3, 0.05) ELSE confidence END ELSE confidence END AS confidence
  FROM (SELECT c.*, d.parts, d.content, list_position(list_transform(d.parts, lambda x: contains(x, c.value)), true) AS first, w.s FROM ({_CLASSIFIED}) c
    JOIN (SELECT {_PATH_SQL} AS path, string_split(coalesce(text, ''), chr(10)) AS parts, lower(coalesce(text, '')) AS content FROM documents) d ON c.path = d.path
    JOIN (SELECT DISTINCT path, line_no, {O.keyword_score('w')} AS s FROM ({_WINDOWS})) w ON c.path = w.path AND c.line_no = w.line_no
    WHERE c.provenance IN ('AUTH_CREDENTIAL', 'UNCERTAIN') AND NOT {O.not_secret('value')} AND NOT contains(lower(line), 'siftlake:allow') AND NOT contains(lower(line), 'siftlake:ignore')))
"""
_FINDINGS = f"""
SELECT *, CASE WHEN verdict IN ('SUPPRESSED', 'LIKELY_FALSE_POSITIVE') THEN CASE WHEN final >= 0.5 THEN 'low' ELSE 'none' END WHEN final >= 0.9 THEN 'critical' WHEN final >= 0.7 THEN 'high' WHEN final >= 0.4 THEN 'medium' WHEN final >= 0.2 THEN 'low' ELSE 'none' END AS risk
FROM (SELECT *, coalesce({O.ecosystem('value')}, morphology) AS detector, CASE WHEN final < 0.1 THEN 'SUPPRESSED' WHEN adj <= -0.8 THEN 'LIKELY_FALSE_POSITIVE' WHEN provenance = 'AUTH_CREDENTIAL' THEN 'LIKELY_TRUE_POSITIVE'
  WHEN provenance = 'UNCERTAIN' THEN 'NEEDS_VERIFICATION' ELSE 'LIKELY_FALSE_POSITIVE' END AS verdict FROM ({_SCANNED})) WHERE final >= 0.3 AND verdict IN ('LIKELY_TRUE_POSITIVE', 'NEEDS_VERIFICATION')
"""


@query(f"SELECT path, line_no, detector, {O.redact('value')} AS matched_value, round(final, 4) AS confidence, verdict, risk, {O.severity('final')} AS severity, substr(sha256(path || ':' || line_no || ':' || detector || ':' || value), 1, 32) AS fingerprint FROM ({_FINDINGS})")
def scan_findings(spark, sf_dir):
    """The default scan of all documents at threshold 0.3."""
    t = pipeline.scan(_docs(spark, sf_dir), 0.3, "raw")
    return t.select("path", "line_no", "detector", T.redact(F.col("value")).alias("matched_value"), F.round("confidence", 4).alias("confidence"), "verdict", "risk", "severity", "fingerprint")


@query(planted.HIDDEN)
def heuristic_candidates(spark, sf_dir):
    """Heuristic candidates of all documents and of files in which they are planted. The SQL states the planted
    ones only; documents with a line such as token=.. at its start add their own."""
    files = _docs(spark, sf_dir).unionByName(planted.planted(spark, sf_dir).select("path", "content"))
    return extract.extract_heuristic(files).select("path", F.col("line_no").cast("int").alias("line_no"), "var_name", "value").distinct()


@query()
def planted_scan(spark, sf_dir):
    """The scan of the planted files with the heuristics, at threshold 0.3."""
    t = pipeline.scan(planted.planted(spark, sf_dir).select("path", "content"), 0.3, "raw", heuristics=True)
    return t.select("path", "line_no", "var_name", "detector", T.redact(F.col("value")).alias("matched_value"), F.round("confidence", 4).alias("confidence"), "verdict", "risk", "severity", "fingerprint")


@query("SELECT p_partkey, list_aggregate(atoms, 'string_agg', ',') AS atoms FROM (SELECT p_partkey, " + O.split_name("p_name") + " AS atoms FROM part)")
def split_identifiers(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_name(F.col("p_name")), ",").alias("atoms"))


@query(f"SELECT c_custkey, round({O.entropy('c_name')}, 4) AS entropy, {O.charset('c_name')} AS charset, {O.screen('c_name')} AS passes FROM customer")
def entropy_charset(spark, sf_dir):
    n = F.col("c_name")
    return _read(spark, sf_dir, "customer").select("c_custkey", F.round(T.entropy(n), 4).alias("entropy"), T.charset(n).alias("charset"), T.fast_entropy_screen(n).alias("passes"))


@query(f"SELECT page_id, {O.file_kind('url')} AS file_kind, split_part({O.morphology('url', chr(39) + 'neutral' + chr(39))}, '/', 1) AS morphology FROM pages")
def file_provenance(spark, sf_dir):
    u = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", signals.file_provenance(u)["value"].alias("file_kind"), signals.morphology(u, F.lit("neutral"))["value"].alias("morphology"))


@query(f"SELECT path, CAST(line_no AS INT) AS line_no, round({O.line_adjustment('line')}, 2) AS adjustment FROM (SELECT * FROM ({_LINES}) WHERE {O.has_signal('line')})")
def line_context(spark, sf_dir):
    return extract.lines(_docs(spark, sf_dir)).where(extract.has_signal(F.col("line"))).select("path", "line_no", F.round(signals.line_context(F.col("line"))["adjustment"], 2).alias("adjustment"))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Made-up values by construction: (name, value, path, line).
FIXTURE = [
    ("GITHUB_TOKEN", "ghp_" + _AZ + "abcdefgh", "src/github.py", "x"), ("STRIPE_LIVE_KEY", "sk_live_" + "4eC39HqLyjWD" * 2, "src/payments.py", "x"),
    ("AWS_ACCESS_KEY_ID", "AKIA" + "Q7" * 6 + "EXAMPLE1", "src/config.py", "x"), ("DATABASE_URL", "postgres://u:Zx9kQ2@h/db", "src/database.py", "x"),
    ("DATABASE_URL", "postgres://u:password@h/db", "tests/db.py", "x"), ("AUTH_TOKEN", "eyJhbGciOi.eyJzdWIiOi.c2ln", "src/auth.py", "# old token"),
    ("api_key", "a1b2c3d4e5f60718293a4b5c6d7e8f90", "src/api.py", "x"), ("api_key", "abcdef0123456789" * 2, "src/app.py", "x"), ("file_hash", "a" * 64, "src/app.py", "x"),
    ("file_hash", "a1b2c3d4e5f60718293a4b5c6d7e8f90" * 2, "src/integrity.py", "x"), ("request_id", "123e4567-e89b-12d3-a456-426614174000", "src/ids.py", "x"),
    ("api_key", "changeme", "src/placeholder.py", "x"), ("api_key", "XXXXXXXX", "docs/placeholder.md", "x"), ("description", "a plain sentence of prose that says nothing", "src/normal.py", "x"),
    ("session_data", "xK9mP2vQ7nR4tY8wZ3bC6dF1gH5jL0s", "src/random_val.py", "x"), ("session_data", "xK9mP2vQ7nR4tY8wZ3bC6dF1gH5jL0s", "deploy/.env", "x"),
    ("db_password", "P@ssw0rd!", "src/a.py", "do not use"), ("api", "xK9mP2vQ7nR4tY8wZ3bC6dF1gH5jL0s", "infra/main.tf", "x"), ("payload", "3q2+796tvu/erb7v3q2+796tvu8=", "src/b.py", "x"),
    ("token", "hf_model_name", "src/c.py", "x"), ("key", "/usr/local/bin/thing", "src/d.py", "revoked key"), ("host", "db.internal.example.org", "vendor/x.py", "x"),
    ("urn", "arn:aws:iam::123:role/x", ".github/workflows/ci.yml", "x"), ("mail", "someone@example.org", "src/e.py", "x"), ("password", "$DB_PASSWORD", "src/f.py", "$DB_PASSWORD"),
]
_NAMES = "var_name value path line"
_fp, _fc = O.decide("role", "m", "kind", "adj")


@query(f"SELECT var_name, value, path, role, m AS morphology, kind AS file_kind, round(adj, 2) AS line_adj, {_fp} AS provenance, {_fc} AS confidence FROM (SELECT *, {O.morphology('value', 'role')} AS m, {O.file_kind('path')} AS kind, {O.line_adjustment('line')} AS adj FROM (SELECT *, {O.role('var_name')} AS role FROM {_values_sql(FIXTURE, _NAMES)}))".replace("m AS morphology", "split_part(m, '/', 1) AS morphology"))
def decision_tree(spark, sf_dir):
    t = rules.classify(_values(spark, FIXTURE, _NAMES))
    return t.select("var_name", "value", "path", "role", "morphology", "file_kind", F.round("line_adj", 2).alias("line_adj"), "provenance", F.round("confidence", 4).alias("confidence"))


@query(f"SELECT value, {O.prefix('value')} AS prefix, {O.ecosystem('value')} AS ecosystem, {O.identifier('value')} AS identifier, {O.not_secret('value')} AS dropped FROM {_values_sql(FIXTURE, _NAMES)}")
def prefix_match(spark, sf_dir):
    v = F.col("value")
    return _values(spark, FIXTURE, _NAMES).select("value", T.known_prefix(v)["prefix"].alias("prefix"), T.known_prefix(v)["ecosystem"].alias("ecosystem"), T.looks_like_identifier(v).alias("identifier"), T.not_secret(v).alias("dropped"))


@query(f"SELECT value, {O.redact('value')} AS redacted, translate(value, '{_AZ}{_AZ.lower()}', '{_AZ[13:] + _AZ[:13] + _AZ.lower()[13:] + _AZ.lower()[:13]}') AS rot13, reverse(value) AS reversed, sha256(value) AS sha256 FROM {_values_sql(FIXTURE, _NAMES)}")
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    return _values(spark, FIXTURE, _NAMES).select("value", T.redact(v).alias("redacted"), T.rot13(v).alias("rot13"), F.reverse(v).alias("reversed"), F.sha2(v, 256).alias("sha256"))


# Events stand for stored scans and findings.
_SEV = "CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'info' END"


def _events(spark, sf_dir):
    v = F.col("value")
    sev = F.when(v >= 90, "critical").when(v >= 70, "high").when(v >= 40, "medium").when(v >= 10, "low").otherwise("info")
    return _read(spark, sf_dir, "events").withColumns({"severity": sev, "file": F.concat(F.lit("file_"), F.col("user_id").cast("string"))})


@query(f"SELECT 'event_type' AS dimension, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'severity', {_SEV}, count(*) FROM events GROUP BY 2")
def dashboard_counts(spark, sf_dir):
    return analytics.counts(_events(spark, sf_dir), ["event_type", "severity"])


@query(f"""
SELECT file, n, CASE r WHEN 0 THEN '' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity FROM (
  SELECT 'file_' || user_id AS file, count(*) AS n, max(list_position(['info', 'low', 'medium', 'high', 'critical'], {_SEV}) - 1) AS r FROM events GROUP BY 1 ORDER BY n DESC, file LIMIT 10)
""")
def hotspots(spark, sf_dir):
    return analytics.hotspots(_events(spark, sf_dir))


@query("""
WITH last AS (SELECT max(CAST(ts AS DATE)) AS d FROM events), spine AS (SELECT CAST(unnest(generate_series(d - 29, d, INTERVAL 1 DAY)) AS DATE) AS day FROM last)
SELECT day, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = day AND event_type = 'click') AS scans, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = day) AS findings FROM spine
""")
def daily_trend(spark, sf_dir):
    e = _events(spark, sf_dir)
    last = e.agg(F.max(F.to_date("ts"))).first()[0]
    return analytics.daily_trend(e.where("event_type = 'click'"), e, str(last), 30, "ts", "ts")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_scans(spark, sf_dir):
    return analytics.recent(_read(spark, sf_dir, "events").withColumn("id", F.col("event_id")), 10, "ts").select("event_id", "ts", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def page_2(spark, sf_dir):
    return post.page(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 2, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT CAST(row_number() OVER (ORDER BY first_id) - 1 AS INT) AS rule_index, event_type AS detector, CASE WHEN c >= 0.8 THEN 'error' WHEN c >= 0.5 THEN 'warning' ELSE 'note' END AS level, p AS provenance FROM (SELECT event_type, min(event_id) AS first_id, arg_min(value / 100, event_id) AS c, arg_min('AUTH_CREDENTIAL', event_id) AS p FROM events GROUP BY 1)")
def sarif_rules(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("detector"), (F.col("value") / 100).alias("confidence"), F.lit("AUTH_CREDENTIAL").alias("provenance"), "event_id")
    return analytics.sarif_rules(e, ["event_id"])


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE value >= 90) AS BIGINT) AS critical, CAST(count(*) FILTER (WHERE value >= 70 AND value < 90) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS auth, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS uncertain FROM events")
def run_summary(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    p = F.when(F.col("event_type") == "click", "AUTH_CREDENTIAL").when(F.col("event_type") == "view", "UNCERTAIN")
    return analytics.run_summary(e.select((F.col("value") / 100).alias("confidence"), p.alias("provenance")))


# Published figures of benchmark runs: (category, repo, tool, findings, duration_s).
_BENCH = [("database", "clickhouse", "a", "166", "61.54"), ("database", "postgres", "a", "100", "19.283"), ("crypto", "go-ethereum", "a", "28", "16.591"), ("crypto", "aztec", "a", "546", "97.133"), ("popular", "home-assistant", "a", "7000", "29.991")]
_BN = "category repo tool findings duration_s"


@query(f"WITH b AS (SELECT category, tool, CAST(findings AS BIGINT) AS f, CAST(duration_s AS DOUBLE) AS s FROM {_values_sql(_BENCH, _BN)}) SELECT category, tool, count(*) AS repos, CAST(sum(f) AS BIGINT) AS findings, round(sum(s), 3) AS total_s, round(sum(s) / count(*), 3) AS avg_s FROM b GROUP BY ALL UNION ALL SELECT 'all', tool, count(*), CAST(sum(f) AS BIGINT), round(sum(s), 3), round(sum(s) / count(*), 3) FROM b GROUP BY tool")
def benchmark_rollup(spark, sf_dir):
    b = _values(spark, _BENCH, _BN).select("category", "repo", "tool", F.col("findings").cast("long").alias("findings"), F.col("duration_s").cast("double").alias("duration_s"), F.lit(0).alias("memory_kb"), F.lit(False).alias("timed_out"))
    return analytics.benchmark_rollup(b).select("category", "tool", "repos", "findings", F.round("total_s", 3).alias("total_s"), F.round("avg_s", 3).alias("avg_s"))


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,3 +10,4 @@ def f():
 keep
-gone
+token = "a1b2c3d4e5f60718293a4b5c6d7e8f90a1b2c3d4"
+plain
 keep
@@ -20 +30 @@
+last
diff --git a/y.bin b/y.bin
Binary files differ
diff --git a/z.txt b/z.txt
--- a/z.txt
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


@query("SELECT * FROM (VALUES ('c1', 'x.py', 11, 'token = \"a1b2c3d4e5f60718293a4b5c6d7e8f90a1b2c3d4\"'), ('c1', 'x.py', 12, 'plain'), ('c1', 'x.py', 30, 'last')) AS t(\"commit\", path, number, content)")
def git_diff_lines(spark, sf_dir):
    return sources.diff_lines(_values(spark, [("c1", DIFF)], "commit diff"))


@query()
def decode_chain(spark, sf_dir):
    """Decoded variants, to the full depth of decode.chain, of the documents."""
    return decode.chain(_docs(spark, sf_dir)).where("depth > 0").select("path", "encoding", "depth", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT path, CAST(count(*) AS BIGINT) AS n_vars FROM (SELECT DISTINCT path, regexp_extract(line, {O.q(extract.VARIABLE)}, 1) AS var FROM ({_LINES})) WHERE var <> '' GROUP BY path")
def variable_maps(spark, sf_dir):
    return extract.variables(_docs(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n_vars"))


@query(f"SELECT conv_id, turn, CAST(len({O.candidates('line')}) AS BIGINT) AS n FROM (SELECT conv_id, turn, coalesce(text, '') AS line FROM conversations)")
def conversation_candidates(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(extract.base_candidates(t)).cast("long").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | {f.__name__: f for f in planted.SQL}


def oracle_sql() -> dict[str, str]:
    return _SQL | {f.__name__: sql for f, sql in planted.SQL.items()}
