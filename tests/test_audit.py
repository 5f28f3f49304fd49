"""Two-level audit chain against damage of every kind, and appends that read one row."""
import hashlib

import pytest
from pyspark.sql import functions as F

from terralith.operators import audit
from terralith.streaming import jobs
from tests.test_flows import entries


@pytest.fixture(scope="module")
def sealed(spark):
    log = audit.append_segments(entries(spark, 95), 10).cache()
    return log, audit.seal(log, 10).cache()


def verdict(log, heads, kept=None):
    return audit.verify_sealed(log, heads, 10, kept).first()


def test_chain_as_written(spark, sealed):
    log, heads = sealed
    good = verdict(log, heads, audit.anchor(heads))
    assert good.chain_intact and (good.entries_checked, good.segments_checked, good.entries_missing) == (95, 10, 0)
    rows = heads.orderBy("segment").collect()
    prev = audit.GENESIS_HASH
    for r in rows:
        assert r.prev_hash == prev
        prev = hashlib.sha256(f"{r.segment}|{r.entries}|{r.last_id}|{r.head_hash}|{prev}".encode()).hexdigest()
        assert r.entry_hash == prev
    assert good.head_hash == prev
    empty = audit.append_segments(entries(spark, 0), 10)
    assert verdict(empty, audit.seal(empty, 10)).chain_intact


@pytest.mark.parametrize("damage, segment, missing", [
    (lambda log: log.where("id DIV 10 <> 4"), 4, 10),                       # a whole segment
    (lambda log: log.where("id DIV 10 NOT IN (2, 6)"), 2, 20),
    (lambda log: log.where("NOT (id DIV 10 = 3 AND id % 10 > 6)"), 3, 3),   # the tail of a segment
    (lambda log: log.where("id <> 55"), 5, 1),                              # one entry
    (lambda log: log.where("id < 90"), 9, 6),                               # the end of the log
    (lambda log: log.withColumn("detail", F.when(F.col("id") == 71, "x").otherwise(F.col("detail"))), 7, 0),
    (lambda log: log.withColumn("id", F.when(F.col("id") == 80, 81).when(F.col("id") == 81, 80).otherwise(F.col("id"))), 8, 0),
])
def test_damage_is_found(sealed, damage, segment, missing):
    log, heads = sealed
    row = verdict(damage(log), heads)
    assert not row.chain_intact and row.broken_segment == segment and row.entries_missing == missing


def test_heads_are_guarded_too(sealed):
    log, heads = sealed
    kept = audit.anchor(heads)
    gone = "id DIV 10 <> 4"
    row = verdict(log.where(gone), heads.where("segment <> 4"))              # segment and head gone together
    assert not row.chain_intact and row.broken_segment == 5
    forged = heads.withColumn("entries", F.when(F.col("segment") == 3, 7).otherwise(F.col("entries")))
    assert verdict(log, forged).broken_segment == 3
    cut = verdict(log.where("id < 80"), heads.where("segment < 8"))
    assert cut.chain_intact                                                  # nothing left points at what is gone …
    assert not verdict(log.where("id < 80"), heads.where("segment < 8"), kept).chain_intact      # … but the anchor does


def test_sealing_goes_on_where_it_ended(spark, sealed):
    log, heads = sealed
    more = audit.append_segments(entries(spark, 130).where("id >= 100"), 10)
    after = audit.anchor(heads).first().link
    both = heads.unionByName(audit.seal(more, 10, after))
    assert verdict(log.unionByName(more), both, audit.anchor(heads)).chain_intact
    unsealed = verdict(log.unionByName(more), heads)
    assert unsealed.chain_intact and unsealed.segments_checked == 14


def test_appends_read_the_head_of_the_batch_before(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "log")
    schema = entries(spark, 1).schema

    def put(low, high):
        entries(spark, high).where(f"id > {low}").coalesce(1).write.mode("append").parquet(source)
        jobs.append_audit(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()

    for low in range(0, 60, 10):
        put(low, low + 10)
    log = spark.read.parquet(store)
    assert audit.verify(log).first().chain_intact and log.count() == 60
    heads = spark.read.parquet(jobs.heads_of(store))
    assert heads.count() == 6 and {r.batch_no: r.id for r in heads.collect()} == {i: 10 * i + 10 for i in range(6)}
    # only the last head is read: an append goes on although every earlier batch and head is unreadable
    for kind in (store, jobs.heads_of(store)):
        for batch in range(5):
            (tmp_path / kind.split("/")[-1] / f"batch_no={batch}").rename(tmp_path / f"{kind.split('/')[-1]}-{batch}")
    put(60, 70)
    tail = spark.read.parquet(store).where("batch_no >= 5")
    links = {r.id: (r.prev_hash, r.entry_hash) for r in tail.collect()}
    assert links[61][0] == links[60][1] and tail.count() == 20
