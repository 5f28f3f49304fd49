"""Documents, audit chain, checks, changes, metrics and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from terralith import vocab
from terralith.functions import text
from terralith.operators import audit, changes, checks, layout, metrics, notifications, rules, search
from terralith.sources import cadastral, documents
from terralith.streaming import jobs
from tests.test_rules import table


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_units(spark):
    got = values(spark, lambda c: text.to_hectare(F.lit(1.0), c), ["ha", "acre", "bigha", "katha", "guntha", "kanal", "marla", "smoots", "Acres.", "  HA ", "एकड़"])
    assert got == pytest.approx([1, .404686, .101172, .005059, .010117, .050586, .002529, 0, .404686, 1, .404686], abs=1e-6)
    assert values(spark, text.normalize_unit, ["Acres.", "  HA "]) == ["acres", "ha"]


def test_dates_titles_and_names(spark):
    got = values(spark, lambda c: text.parse_date(c).cast("string"), [
        "04/01/2020", "4-1-2020", "04/01/70", "04-01-20", "2020-01-04", "4 January 2020", "4 Jan 2020", "32/13/2021", "30/02/2020"])
    assert got == ["2020-01-04", "2020-01-04", "1970-01-04"] + ["2020-01-04"] * 4 + [None, None]
    assert values(spark, text.title_case, ["st/ab o'neil", "saheed NAGAR"]) == ["St/Ab O'Neil", "Saheed Nagar"]
    assert values(spark, text.looks_like_name, ["Sunita Pradhan", "123/4", "??", "Ram Das 15/07/2024"]) == [True, False, False, False]
    assert values(spark, text.canonical_classification, ["Old dry land", "krishi", "st/ab"]) == ["Unirrigated land", "Agricultural land", "St/Ab"]


def test_dedup(spark):
    uploads = spark.createDataFrame([("n1", 1, "h1"), ("n2", 2, "h1"), ("n3", 3, "h2"), ("n4", 4, "h3")], "doc_id string, seq int, file_hash string")
    stored = spark.createDataFrame([("s2", "h2", "completed", "approved"), ("s3", "h3", "completed", "rejected"), ("s4", "h3", "failed", None)],
                                   "doc_id string, file_hash string, status string, record_status string")
    fresh, skipped = documents.deduplicate(uploads, stored)
    assert {r.doc_id for r in fresh.collect()} == {"n1", "n4"}
    assert {(r.doc_id, r.existing_doc_id) for r in skipped.collect()} == {("n2", "n1"), ("n3", "s2")}


def test_inventory_and_geojson(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    found = documents.read_inventory(spark, str(tmp_path))
    # an empty file has no content to scan, so the reader leaves it out; listings can still carry one
    empty = spark.createDataFrame([("c.pdf", "pdf", 0)], "filename string, ext string, size_bytes long")
    ok, bad = documents.split_accepted(found.select("filename", "ext", "size_bytes").unionByName(empty))
    assert [r.filename for r in ok.collect()] == ["a.png"]
    assert {(r.filename, r.reason) for r in bad.collect()} == {("b.txt", "unsupported extension"), ("c.pdf", "empty file")}
    ring = [[85.0, 20.0], [85.001, 20.0], [85.001, 20.001], [85.0, 20.001], [85.0, 20.0]]
    feature = {"properties": {"plot_key": "P", "khasra_no": "1/1", "area_ha": 1.1}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "layer.geojson").write_text(json.dumps({"features": [feature]}, indent=1))
    row = cadastral.read_geojson(spark, str(tmp_path / "layer.geojson")).first()
    assert row.plot_key == "P" and row.rings[0][2].lat == 20.001


def entries(spark, n):
    return spark.range(1, n + 1).select(
        "id", F.format_string("AUD-%d", "id").alias("log_id"), F.lit(None).cast("string").alias("user_id"),
        *[F.lit(x).alias(c) for c, x in (("actor_label", "a"), ("action", "upload"), ("entity_type", "record"), ("entity_id", "E"),
                                         ("field_name", ""), ("old_value", ""), ("new_value", "v"))],
        F.lit(0.0).alias("ai_confidence"), F.lit("d").alias("detail"), F.timestamp_seconds(F.col("id")).alias("created_at"))


def test_audit_chain(spark):
    log = audit.append(entries(spark, 80)).cache()
    good = audit.verify(log).first()
    assert good.chain_intact and good.entries_checked == 80
    more = audit.append(entries(spark, 90).where("id > 80"), good.head_hash)
    assert audit.verify(log.unionByName(more)).first().chain_intact
    bad = log.withColumn("new_value", F.when(F.col("id") == 7, "x").otherwise(F.col("new_value")))
    assert audit.verify(bad).first().broken_at == 7
    assert audit.verify(log.where("id <> 30")).first().broken_at == 31


def test_chain_across_chunks(spark):
    log = audit.append(entries(spark, 80))
    linked = audit.with_predecessor(log, "entry_hash", "expected", audit.GENESIS_HASH, chunk=7)
    assert linked.where("expected <> prev_hash").count() == 0
    parts = audit.append_segments(entries(spark, 80), 10)
    assert audit.verify(parts, 10).first().chain_intact and audit.segment_heads(parts, 10).count() == 9


def test_checks(spark):
    rows = table(spark, {"ok": {}, "other": {"owner_name": "Bhagaban Nayak", "khasra_no": "118/4"}, "none": {"khasra_no": "1", "registration_no": "9 of 1999"}})
    out = checks.all_checks(rows, cadastral.sample_ledger(spark), cadastral.sample_layer(spark), cadastral.sample_deeds(spark)).cache()
    got = {(r.record_id[3:], r.source_system): r.match_status for r in out.collect()}
    assert [got["ok", s] for s in checks.SYSTEMS] == ["matched"] * 5
    assert got["other", "bhulekh"] == "mismatch" and got["none", "igr"] == "not_found"
    status = {r.record_id[3:]: r.cross_db_status for r in checks.check_status(out).collect()}
    assert status["ok"] == "all_matched" and status["none"] == "3_mismatch"


def test_corrections_then_approval(spark):
    rows = table(spark, {"bad": {"owner_name": "", "area_raw": "", "area_hectare": 0.0, "land_classification": ""}, "fine": {"khasra_no": "5"}})
    rows = rows.withColumns({"area_value": F.lit(0.0), "area_unit": F.lit(""), "record_confidence": F.lit(50.0), "guardian_name": F.lit(""),
                             "address": F.lit(""), "mutation_no": F.lit("")})
    ext = spark.createDataFrame([("LR-bad", "village", "Balarampur", "Balarampur", 60.0), ("LR-bad", "owner_name", "", "", 0.0), ("LR-bad", "area", "", "", 0.0)],
                                "record_id string, field_name string, value string, normalized_value string, confidence double").withColumn(
        "corrected_value", F.lit(None).cast("string"))
    found = rules.run_rules(rows, rules.LOCAL_RULES, rules.Context(as_of="2024-01-01"))
    asked = spark.createDataFrame([("LR-bad", "approve", "")], "record_id string, decision string, comment string")
    now = F.current_timestamp()
    assert [r.record_id for r in changes.decide(rows, found, asked, now)["refused"].collect()] == ["LR-bad"]
    fixes = spark.createDataFrame([("LR-bad", "owner_name", "Sunita Pradhan"), ("LR-bad", "area", "1 acre"), ("LR-bad", "land_classification", "Irrigated land"),
                                   ("LR-bad", "status", "approved"), ("LR-bad", "village", "Balarampur")], "record_id string, field_name string, new_value string")
    out = changes.apply_corrections(rows, ext, fixes)
    row = out["changed"].first()
    assert (row.owner_name, row.area_hectare, row.area_raw) == ("Sunita Pradhan", 0.404686, "1.0 acre")
    # the owner cell stays empty in the field table, the area cell is filled and trusted
    assert row.record_confidence == pytest.approx((60 + 95) / 2)
    assert {r.field_name for r in out["applied"].collect()} == {"owner_name", "area", "land_classification"}
    assert [r.field_name for r in out["rejected"].collect()] == ["status"]
    fresh = changes.revalidate(out["records"], out["changed"], found, rules.Context(as_of="2024-01-01"), rules.LOCAL_RULES)
    assert fresh.where("record_id = 'LR-bad'").count() == 0
    done = changes.decide(out["records"], fresh, asked, now)
    assert done["refused"].count() == 0
    assert done["records"].where("record_id = 'LR-bad'").first().status == "approved"


def test_suggestions(spark):
    ext = spark.createDataFrame([("r", "khasra_no", "", "", 0.0, vocab.FORM_39A), ("g", "khasra_no", "", "", 0.0, "generic"),
                                 ("g", "village", "", "", 0.0, "generic"), ("h", "village", "Balarampur", "Balarampur", 95.0, "generic")],
                                "record_id string, field_name string, value string, normalized_value string, confidence double, profile string").withColumn("source", F.lit("regex"))
    sug = spark.createDataFrame([("r", "khasra_no", "417"), ("g", "khasra_no", "not-a-number-xyz"), ("g", "village", "Balarampur"), ("h", "village", "Jatni")],
                                "record_id string, field_name string, suggestion string")
    got = {(r.record_id, r.field_name): (r.normalized_value, r.confidence) for r in changes.merge_suggestions(ext, sug).collect()}
    assert got["r", "khasra_no"][0] == "" and got["g", "khasra_no"][0] == "" and got["h", "village"] == ("Balarampur", 95.0)
    assert got["g", "village"] == ("Balarampur", pytest.approx(.45 * 55 + 22.5 + 4.5 + 7))


def test_metrics_on_empty_and_alerts(spark):
    rows = table(spark, {"a": {}}).withColumns({"discrepancy_count": F.lit(0), "record_confidence": F.lit(0.0), "gis_linked": F.lit(False)})
    docs = spark.createDataFrame([], "status string, total_latency_ms long, ocr_latency_ms long")
    found = spark.createDataFrame([], "status string, severity string, occurrences long")
    snap = metrics.snapshot(rows.limit(0), docs, found, spark.createDataFrame([], "field_name string"), spark.createDataFrame([], "id long"))
    got = {(r.section, r.metric): r.value for r in snap.collect()}
    assert got["records", "total"] == "0" and got["performance", "within_budget"] == "true" and got["validation", "discrepancies_total"] == "0"
    late = rows.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert metrics.pending_alerts(late, "2024-01-03 02:00:00").first().hours_pending == 50.0
    assert metrics.pending_alerts(late, "2024-01-02 23:00:00").count() == 0


def test_search_notifications_layout(spark):
    rows = table(spark, {"a": {}, "b": {"owner_name": "100% Das"}}).withColumn("created_at", F.current_timestamp())
    assert [r.record_id for r in search.search(rows, q="100%").collect()] == ["LR-b"]
    users = spark.createDataFrame([(1, "reviewer"), (2, "reviewer"), (3, "admin")], "id long, role string")
    rolled = rows.withColumns({"highest_severity": F.lit("critical"), "discrepancy_count": F.lit(2)})
    sent = notifications.fan_out(notifications.high_severity_events(rolled), users)
    assert sent.count() == 4
    boxes = spark.createDataFrame([("d", 1, "table", 0, 0, 100, 100), ("d", 1, "printed_text", 10, 10, 20, 20), ("d", 1, "printed_text", 90, 90, 40, 40)],
                                  "doc_id string, page int, label string, x int, y int, w int, h int")
    assert layout.drop_text_in_tables(boxes).where("label = 'printed_text'").count() == 1
    assert layout.layout_counts(boxes).first().printed_text == 2


def test_record_detail(spark):
    rows = table(spark, {"a": {}})
    found = rules.run_rules(rows, ["BR-10"])
    ext = spark.createDataFrame([("LR-a", "village", "Balarampur", 90.0)], "record_id string, field_name string, value string, confidence double")
    chk = checks.admin_check(rows)
    links = spark.createDataFrame([("LR-a", "khasra_no", "P")], "record_id string, match_type string, plot_key string")
    log = entries(spark, 70).withColumn("entity_id", F.lit("LR-a"))
    row = search.record_detail(rows, ext, found, chk, links, log).first()
    assert len(row.audit) == 60 and row.fields[0].value == "Balarampur" and row.cross_checks[0].match_status == "matched"


def test_streams(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "doc_id string, seq int, file_hash string, status string, record_status string, created_at timestamp"
    def put(rows):
        spark.createDataFrame(rows, "doc_id string, seq int, file_hash string, status string, record_status string, t string").select(
            "doc_id", "seq", "file_hash", "status", "record_status", F.col("t").cast("timestamp").alias("created_at")).coalesce(1).write.mode("append").parquet(source)
    def run():
        jobs.ingest(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
        return {r.doc_id for r in spark.read.parquet(store).collect()}
    put([("a", 1, "h1", "completed", "approved", "2024-01-01"), ("b", 2, "h1", "completed", "approved", "2024-01-01")])
    assert len(run()) == 1
    put([("c", 3, "h1", "completed", "approved", "2024-01-02"), ("d", 4, "h2", "completed", "approved", "2024-01-02")])
    assert {"d"} < run() and len(run()) == 2
    log = str(tmp_path / "log")
    entries(spark, 5).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    jobs.append_audit(stream, log, str(tmp_path / "cp2")).awaitTermination()
    assert audit.verify(spark.read.parquet(log)).first().chain_intact
