"""Streams over tables that are folders of part files, and changes that fall into one moment."""
import datetime as dt
import os

from terralith.plans import streams
from tests.test_streams import run
from terralith.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_tables_in_part_files(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    os.symlink(f"{SF}/labels.parquet", tmp_path / "labels.parquet")
    for query in (streams.daily, streams.ingested, streams.waiting):
        want, got = (sorted(query(spark, sf).collect()) for sf in (SF, str(tmp_path)))
        assert got == want and want


def test_changes_of_one_millisecond_follow_their_ids(spark, tmp_path):
    schema, at = "record_id string, status string, ts timestamp, seq long", dt.datetime(2024, 1, 1)
    out = str(tmp_path / "out")

    def start(stream):
        jobs.pending_alerts(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    us = lambda n: at + dt.timedelta(microseconds=n)
    run(spark, tmp_path, "in", schema, [("a", "approved", us(900), 1), ("a", "pending_review", us(100), 2), ("b", "approved", us(100), 4),
                                        ("b", "pending_review", us(900), 3), ("tick", "approved", at + dt.timedelta(hours=60), 5)], start)
    assert [(r.record_id, r.pending_since) for r in spark.read.parquet(out).collect()] == [("a", at)]
