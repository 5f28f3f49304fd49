"""The n-gram join on disk: rows that go through its shuffles, and shuffle files that a write leaves behind."""
import glob
import time

from pyspark.sql import functions as F

from terralith import config
from terralith.llm import ngram_join


def left(folders):
    return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    before = left(folders)
    rows = spark.range(20_000).groupBy((F.col("id") * 7919 % 5_000).alias("k")).agg(F.collect_list("id").alias("ids"))
    config.write_table(rows, str(tmp_path / "out"))
    for _ in range(50):
        if left(folders) <= before:
            break
        time.sleep(0.1)
    assert left(folders) <= before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5_000
    assert spark.conf.get(config.SHUFFLE_CLEANUP) == "false"


def test_reach_counts_shingles_of_other_components(spark):
    features = spark.createDataFrame([(1, [-3, 10, 11, 12]), (2, [10, 11, 13]), (3, [-3, 12, 99])], "set_id long, features array<bigint>")
    members = spark.createDataFrame([(7, 1, 1), (8, 1, 1), (7, 2, 1), (7, 3, 3)], "signature long, set_id long, component long")
    assert sorted(map(tuple, ngram_join._reach(members, features).collect())) == [(1, 2), (3, 2)]


def test_crossing_pairs_come_out_once(spark):
    words = [(i, list(range(20)) + [100 + i]) for i in (1, 2)]
    features = spark.createDataFrame(words, "set_id long, features array<bigint>")
    members = spark.createDataFrame([(s, i, i) for s in range(30) for i in (1, 2)], "signature long, set_id long, component long")
    sets = spark.createDataFrame([(i, 21, [0] * ngram_join.PARITY_LONGS) for i in (1, 2)], "set_id long, n_shingles long, parity array<bigint>")
    pairs = ngram_join._crossing(members, sets, features, 8, 10)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "signatures" not in plan
