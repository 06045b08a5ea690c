"""Reports, stores, readers, composed scans, detectors and the planted queries."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import analytics, extract, ml, post
from siftlake.plans import catalog, pipeline, planted, reports, service
from siftlake.sources import readers
from siftlake.sources.store import ScanStore, history_filter

TOKEN = "a1b2c3d4e5f60718293a4b5c6d7e8f90"
SIGNALS = "array<struct<name:string,value:string,confidence:double,reasoning:string>>"


@pytest.fixture(scope="module")
def findings(spark):
    rows = [("b.py", 2, 0.95, "AUTH_CREDENTIAL", "LIKELY_TRUE_POSITIVE", "critical", True), ("a.py", 1, 0.95, "AUTH_CREDENTIAL", "LIKELY_TRUE_POSITIVE", "critical", True), ('c"<.py', 3, 0.4, "UNCERTAIN", "NEEDS_VERIFICATION", "medium", False)]
    t = spark.createDataFrame(rows, "path string, line_no int, confidence double, provenance string, verdict string, risk string, block boolean")
    t = t.withColumns({"value": F.lit(TOKEN), "detector": F.lit("hex"), "alert": F.col("block"), "is_secret": F.col("block"), "reasoning": F.lit("because"), "signals": F.array().cast(SIGNALS), "evidence": F.array(F.struct(F.lit("path_suppression").alias("type"), F.lit(-0.6).alias("impact")))})
    return post.with_fingerprint(t)


def test_documents(spark, findings, tmp_path):
    cli = json.loads(reports.as_text(reports.cli_json(findings, 9, 4, "raw", 1.5)))
    assert [f["file"] for f in cli["findings"]] == ["a.py", "b.py", 'c"<.py'] and (cli["mode"], cli["candidates_evaluated"], cli["suppressed_unverified"], cli["total_findings"]) == ("raw", 9, 4, 3)
    assert cli["findings"][0]["matched_value"] == "****" and cli["findings"][0]["description"] == "path_suppression" and len(cli["findings"][0]) == 13
    assert json.loads(reports.as_text(reports.engine_json(findings)))["total"] == 3
    assert json.loads(reports.as_text(reports.cli_json(findings.limit(0), 0, 0)))["findings"] == []
    sarif = json.loads(reports.as_text(reports.sarif_json(findings)))
    assert len(sarif["runs"][0]["results"]) == 3 and [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["hex"]
    import xml.etree.ElementTree as ET

    suite = ET.fromstring(reports.as_text(reports.junit_xml(findings)).split("\n", 1)[1])[0]
    assert (suite.get("tests"), suite[2].get("name"), suite[0].get("classname")) == ("3", 'c"<.py:3', "hex") and "Description: because" in suite[0][0].text
    text = reports.as_text(reports.text_report(findings, 9, 4)).split("\n")
    assert text[0] == "3 confirmed secrets (scanned in 0.000s)" and text[2].startswith("  [█████████░] 95%  LIKELY_TRUE_POSITIVE  (critical risk)") and text[-1] == "Summary: 3 findings (2 critical, 0 high) in 0.000s"
    assert "9 candidates evaluated" in reports.as_text(reports.text_report(findings.limit(0), 9, 4))
    git = findings.withColumns({"commit": F.lit("0123456789abcdef"), "author": F.lit("n"), "date": F.lit("2024-01-01")})
    assert json.loads(reports.as_text(reports.git_json(git)))["findings"][0]["commit_hash"] == "0123456789abcdef" and "Commit: 0123456789ab\n" in reports.as_text(reports.git_text(git))
    base = reports.baseline_json(findings.unionByName(findings), "known", datetime(2024, 1, 2))
    reports.lines(base, str(tmp_path / "baseline"))
    held = json.loads(reports.as_text(base))
    prints = [f["fingerprint"] for f in held["findings"]]
    assert held["created_at"] == "2024-01-02T00:00:00Z" and prints == sorted(prints) and len(prints) == 3
    read = reports.read_baseline(spark, str(tmp_path / "baseline"))
    assert read.where("reason = 'known'").count() == 3 and post.new_findings(findings, read).count() == 0
    assert reports.exit_code(findings) == 1 and reports.exit_code(findings.limit(0)) == 0 and reports.exit_code(findings, False) == 0


def test_audit(spark):
    rows = [(datetime(2024, 1, 2), "scan_started", "me", "r", "success", {"b": "2", "a": "1"}), (datetime(2024, 1, 1), "config_changed", "me", "r", "failure", None)]
    entries = spark.createDataFrame(rows, reports.AUDIT)
    assert [r.value for r in reports.audit_lines(entries).collect()][0] == "[2024-01-02T00:00:00Z] action=scan_started actor=me resource=r outcome=success"
    assert reports.entries_since(entries, datetime(2024, 1, 2)).count() == 1
    assert [(r.action, r.details) for r in reports.audit_export(entries, "csv").collect()] == [("config_changed", ""), ("scan_started", "a=1; b=2")]
    assert json.loads(reports.audit_export(entries, "json").collect()[1].value)["details"] == {"a": "1", "b": "2"}
    with pytest.raises(ValueError):
        reports.audit_export(entries, "xml")


def test_store(spark, findings, tmp_path):
    store = ScanStore(spark, str(tmp_path / "store"))
    scan = lambda k, status, day: spark.createDataFrame([(k, "dir", f"/Repo{k}", status, datetime(2024, 1, day), 2.0, 3)], "id string, kind string, target string, status string, started_at timestamp, duration double, total_findings long")
    store.save_scan(scan("a", "running", 1))
    store.save_scan(scan("b", "completed", 2))
    store.save_scan(scan("a", "completed", 1))
    named = findings.withColumn("severity", T.severity(F.col("confidence"))).select("path", "line_no", "severity", "provenance")
    store.save_findings("a", named)
    store.save_findings("b", named.limit(1))
    store.save_findings("b", named.limit(1))
    assert [(r.id, r.status) for r in store.scans().collect()] == [("b", "completed"), ("a", "completed")] and store.scans(1).count() == 1
    assert store.findings("b").count() == 2 and store.findings("a").count() == 3 and store.scan("a")["status"] == "completed"
    board = store.dashboard()
    assert board["totals"]["scans"] == 2 and board["counts"]["severity"]["critical"] == 4 and board["recent"][0]["id"] == "b"
    assert [r.id for r in history_filter(store.scans(0), "dir", "REPOB").collect()] == ["b"]
    store.delete("a")
    assert [r.id for r in store.scans(0).collect()] == ["b"] and store.findings("a").count() == 0
    for gone in (store.scan, store.delete):
        with pytest.raises(KeyError):
            gone("a")


def test_directories(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"src/a.py": f'token = "{TOKEN}"\n', "src/allowed.py": f'token = "{TOKEN}"  # siftlake:allow\n', "node_modules/x.js": f'token = "{TOKEN}"', "src/no.skip": f'token = "{TOKEN}"', "src/own.py": 'opaque = "zz_live_Q7x9K2mP4vL8"'}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    with zipfile.ZipFile(root / "src/z.zip", "w") as z:
        z.writestr("in/b.py", f'token = "{TOKEN}"\n')
    (root / "src/broken.zip").write_bytes(b"PK broken")
    import base64

    (root / "src/enc.py").write_text('data = "' + base64.b64encode(f'api_key = "{TOKEN}"'.encode()).decode() + '"')
    policy = post.Policy(custom_prefixes={"zz_live_": "zz"}, exclude_patterns=["*.skip"])
    got = {r.path for r in pipeline.scan_directory(spark, str(root), 0.7, policy).collect()}
    assert got == {"src/a.py", "src/z.zip:in/b.py", "src/own.py"}
    assert {r.path for r in pipeline.scan_directory(spark, str(root), 0.7, ignore=["*.zip", "own.py", "enc.py"]).collect()} == {"src/a.py", "src/no.skip"}
    deep = {r.path for r in pipeline.deep_scan_directory(spark, str(root)).collect()}
    assert {"src/a.py", "src/z.zip:in/b.py", "src/enc.py#base64"} <= deep and not any("node_modules" in p for p in deep)


def test_readers_and_samples(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"true_positives": [{"file": "a.py", "line": 1}, {"file": "a.py"}], "true_negatives": [{"file": "b.py"}]}))
    (tmp_path / "s.json").write_text(json.dumps({"secrets": [{"file": "a.py", "line": 2}], "fp_traps": [{"file": "b.py"}], "tn_files": ["n.py"]}))
    rows = lambda t: sorted(((r.path, r.line_no, r.label) for r in t.collect()), key=str)
    assert rows(readers.labelled_lines(spark, str(tmp_path / "c.json"))) == [("a.py", 1, 1), ("b.py", None, 0)]
    assert rows(readers.scale_truth(spark, str(tmp_path / "s.json"))) == [("a.py", 2, 1), ("b.py", 1, 0), ("n.py", None, 0)]
    (tmp_path / "r.csv").write_text("category,repo,findings,duration_s\ndb,x,3,1.5\n")
    (tmp_path / "r.json").write_text(json.dumps({"repo": "x", "findings": 4, "timed_out": True}))
    both = readers.benchmark_results(spark, str(tmp_path / "r.csv"), "a").unionByName(readers.benchmark_results(spark, str(tmp_path / "r.json"), "b"))
    assert sorted((r.tool, r.category, r.findings, r.timed_out) for r in both.collect()) == [("a", "db", 3, False), ("b", "none", 4, True)]
    assert analytics.by_tool(both.withColumn("category", F.lit("db")), ["a", "b"]).first().b_findings == 4
    files = spark.createDataFrame([("a.py", f'token = "{TOKEN}"\nx = 1\nexport FOO=abcdefgh\npw = "longer value"\nq: "12345678"')], "path string, content string")
    truth = spark.createDataFrame([("a.py", 1, 1)], readers.TRUTH)
    made = ml.training_samples(files, truth, "one", most_negatives=2)
    assert sorted((r.line, r.label) for r in made.collect())[0] == (1, 1) and made.count() == 3
    every = ml.training_samples(files, truth, "one")
    assert {r.line for r in every.collect()} == {1, 3, 4, 5}
    a, b = ([r.line for r in ml.dataset(every, made, seed=s).collect()] for s in (1, 1))
    assert a == b and sorted(a) == [1, 3, 4, 5]
    readers.write_json_lines(made, str(tmp_path / "train"))
    readers.write_json_lines(made, str(tmp_path / "train"), append=True)
    assert readers.json_lines(spark, str(tmp_path / "train")).count() == 6
    assert ml.training_gate(made) == ["3 samples, 50 are needed"] and ml.training_gate(made, ["/no/such"], 2) == ["/no/such is missing"]
    (tmp_path / "model").mkdir()
    (tmp_path / "model/vocab.txt").write_text("a\n")
    model = ml.load_model(str(tmp_path / "model"))
    assert model["mode"] == "heuristic"
    assert ml.predict_lines(files, truth.select("path", "line_no"), model).first().ml_label in (0, 1)


def test_detectors_health_and_cache(spark):
    chunks = spark.createDataFrame([("s1", "", "l1", f'token = "{TOKEN}"'), ("s2", "f.py", "l2", f'api_key = "{TOKEN}"'), ("s3", None, "l3", "nothing")], "source string, file string, link string, data string")
    got = {(r.source_file, r.link, r.verified, r.extra["var_name"]) for r in service.run_detectors(chunks, ["classification"]).collect()}
    assert got == {("s1", "l1", True, "token"), ("f.py", "l2", True, "api_key")}
    service.register_detector("none", ["nothing"], lambda c: service.classification_detector(c).withColumn("detector", F.lit("none")))
    assert service.run_detectors(chunks, ["none"]).count() == 0
    with pytest.raises(KeyError):
        service.run_detectors(chunks, ["unknown"])
    service.register_health_check("ok", lambda: "healthy")
    assert service.health()["status"] == "healthy"
    service.register_health_check("bad", lambda: 1 / 0)
    assert service.health()["status"] == "degraded" and "unhealthy" in service.health()["checks"]["bad"]
    cache = spark.createDataFrame([("x", "VERIFIED", datetime(2024, 1, 1, 11, 30)), ("x", "INACTIVE", datetime(2024, 1, 1, 11, 50)), ("y", "VERIFIED", datetime(2024, 1, 1, 9))], "v string, status string, at timestamp").select(F.sha2("v", 256).alias("hash"), "status", "at")
    hits, misses = service.cached_verifications(spark.createDataFrame([("x",), ("y",), ("z",)], "value string"), cache, datetime(2024, 1, 1, 12))
    assert [(r.value, r.status) for r in hits.collect()] == [("x", "INACTIVE")] and {r.value for r in misses.collect()} == {"y", "z"}
    tokens = service.extract_tokens(spark, f'token = "{TOKEN}"\nk = "sk_li" + "ve_0123456789"', deep=True).collect()
    assert {r.var_name for r in tokens} >= {"token", "k"} and all(TOKEN not in r.value for r in tokens)


def test_metrics_sorts_and_levels(spark, findings):
    files = spark.createDataFrame([(True, 10), (True, 5), (False, 7)], "scanned boolean, length long")
    m = analytics.scan_metrics(files, findings, findings.withColumn("severity", T.severity(F.col("confidence")))).first()
    assert (m.files_scanned, m.files_skipped, m.bytes_processed, m.tokens_extracted, m.findings_total) == (2, 1, 15, 3, 3) and m.by_provenance == {"AUTH_CREDENTIAL": 2, "UNCERTAIN": 1} and m.by_severity == {"critical": 2, "low": 1}
    rows = spark.createDataFrame([("b", 1), ("A", 3), (None, 2), ("a", 4)], "s string, n int")
    assert [r.n for r in post.sort_by(rows, "s").collect()] == [2, 3, 4, 1] and [r.n for r in post.sort_by(rows, "s", True).collect()] == [1, 3, 4, 2]
    values = spark.createDataFrame([("short",), ("ninechars",), ("x" * 100,)], "v string")
    level = lambda n: [r[0] for r in values.select(T.redact_level(F.col("v"), n)).collect()]
    assert level(0)[0] == "short" and level(100) == ["****"] * 3 and level(90) == ["****", "ni" + "*" * 7, "x" * 10 + "*" * 90] and level(1)[1] == "ninechar*"


def test_templates_take_values_of_four_characters_on(spark):
    content = "p = \"abc\"\nx = f\"{p}defghijkl\"\nlong = \"" + "y" * 600 + "\"\nz = f\"{long}tail\"\np4 = \"abcd\"\nw = f\"{p4}efghijkl\""
    got = {(r.var_name, len(r.value)) for r in extract.extract_heuristic(spark.createDataFrame([("a.py", content)], "path string, content string")).collect()}
    assert ("z", 604) in got and ("w", 12) in got and not any(n == "x" for n, _ in got)


def test_planted_lines_are_whole(spark):
    got = planted.planted(spark, "/root/testdata/sf0.001").first()
    text = got.content.split("\n")
    assert len(text) == len(planted.LINES) and text[13] == "password: |" and text[11] == f"mysql -u root -p{got.h[:10]}X"


def test_heuristic_candidates_of_documents_stay_beside_the_planted(spark, tmp_path):
    # the reference takes these lines at their start only, with the quote in front
    texts = ["password=61cfd3300259e4653f By it.", f'Prose.\ntoken = "{TOKEN}" and more', f'Prose, token = "{TOKEN}"', "token = short", None]
    spark.createDataFrame([(k, x, "s") for k, x in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (2,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.heuristic_candidates(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got if "/doc_" in r.path} == {("src/s/doc_0.py", 1, "password", "61cfd3300259e4653f"), ("src/s/doc_1.py", 2, "token", f'"{TOKEN}')}
    assert sum("/doc_" not in r.path for r in got) == 2 * sum(1 for _, name, _ in planted.LINES if name)
