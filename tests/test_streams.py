"""Streams over several batches: ingest from keyed state, alerts by timers, announcements, replays."""
from pyspark.sql import functions as F

from terralith.operators import rules
from terralith.streaming import jobs
from tests.test_rules import table

UPLOADS = "doc_id string, seq int, file_hash string, status string, record_status string"


def run(spark, tmp_path, name, schema, rows, start):
    """Add rows as one file and let the job take them."""
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    start(spark.readStream.schema(schema).parquet(str(tmp_path / name)))


def test_ingest_needs_no_earlier_batch(spark, tmp_path):
    store, skipped = str(tmp_path / "store"), str(tmp_path / "skipped")
    start = lambda s: jobs.ingest(s, store, str(tmp_path / "cp"), skipped=skipped).awaitTermination()
    for i in range(4):
        run(spark, tmp_path, "in", UPLOADS, [(f"d{i}", i, f"h{i}", "completed", "approved"), (f"x{i}", 50 + i, "h0", "completed", None),
                                             (f"f{i}", 90 + i, "bad", "failed", None)], start)
    # what the first batches stored is out of reach, and still known
    for batch in range(3):
        (tmp_path / "store" / f"batch_no={batch}").rename(tmp_path / f"moved-{batch}")
    run(spark, tmp_path, "in", UPLOADS, [("late", 7, "h1", "completed", "approved"), ("new", 8, "h9", "completed", None),
                                         ("ok", 9, "bad", "completed", None), ("ok2", 10, "bad", "completed", None)], start)
    rows = {(r.batch_no, r.doc_id) for r in spark.read.parquet(store).collect()}
    assert rows == {(3, "d3"), (3, "f3"), (4, "new"), (4, "ok")}
    gone = {r.doc_id: r.existing_doc_id for r in spark.read.parquet(skipped).collect()}
    assert gone == {"x0": "d0", "x1": "d0", "x2": "d0", "x3": "d0", "late": "d1", "ok2": "ok"}
    assert {r.reason for r in spark.read.parquet(skipped).collect()} == {"duplicate_file_hash"}
    jobs.compact(spark, store, 4, str(tmp_path / "compact"))
    assert {(r.batch_no, r.doc_id) for r in spark.read.parquet(str(tmp_path / "compact")).collect()} == {
        (-1, "d3"), (-1, "f3"), (4, "new"), (4, "ok")}


CHANGES = "record_id string, status string, ts timestamp"


def alerts_of(spark, tmp_path, name, batches):
    import datetime as dt
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    out = str(tmp_path / f"{name}-out")

    def start(stream):
        jobs.pending_alerts(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()

    for batch in batches:
        run(spark, tmp_path, name, CHANGES, [(r, s, at(h)) for r, s, h in batch], start)
    return sorted((r.record_id, int((r.pending_since - at(0)).total_seconds() // 3600)) for r in spark.read.parquet(out).collect())


def test_alerts_do_not_depend_on_batches(spark, tmp_path):
    p, a = "pending_review", "approved"
    events = [("open", p, 0), ("closed", p, 1), ("short", p, 2), ("closed", a, 60), ("short", a, 20), ("again", p, 3), ("again", a, 10),
              ("again", p, 12), ("open", p, 30), ("tick", a, 70), ("again", a, 90), ("again", p, 91), ("tick", a, 200)]
    ordered = sorted(events, key=lambda e: e[2])
    want = [("again", 12), ("again", 91), ("closed", 1), ("open", 0)]
    assert alerts_of(spark, tmp_path, "one", [ordered]) == want
    assert alerts_of(spark, tmp_path, "three", [ordered[:5], ordered[5:9], ordered[9:]]) == want


def test_announcements(spark, tmp_path):
    rows = table(spark, {"a": {"owner_name": ""}, "b": {}, "c": {"registration_no": "REG-X-99-13"}})
    found = rules.run_rules(rows, ["BR-1", "BR-10"])
    stream, store = str(tmp_path / "found"), str(tmp_path / "store")
    found.coalesce(1).write.parquet(stream)

    def start(checkpoint):
        jobs.severe_alerts(spark.readStream.schema(found.schema).parquet(stream), rows, store, str(tmp_path / checkpoint)).awaitTermination()

    start("cp")
    first = [tuple(r) for r in spark.read.parquet(store).collect()]
    assert len(first) == 1 and "LR-a" in first[0][0]
    start("cp")                                                       # nothing new
    start("cp-lost")                                                  # the same batch once more replaces itself
    assert [tuple(r) for r in spark.read.parquet(store).collect()] == first
    found.where("record_id = 'LR-a'").withColumn("severity", F.lit("critical")).coalesce(1).write.mode("append").parquet(stream)
    start("cp")
    assert spark.read.parquet(store).count() == 2
