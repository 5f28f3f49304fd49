"""Hash-chained audit log: one chain for micro-batches, two levels of chains for bulk loads.

Verification of one chain needs each row's predecessor. Ids are unique, so cutting the log into
ranges of ``CHUNK`` ids bounds every window group; the last row of each range is carried to the
next one through a second, CHUNK-times smaller pass of the same kind.

A bulk load is chained in two levels. Entries are chained inside segments, ranges of ids, side by
side. Each segment then has a head: its number, how many entries it holds and its last hash; the
heads are chained in turn, in the order of the segments. Whatever is changed, moved or taken away
breaks a link, a count or a head; the last link is the anchor that a reader keeps elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.config import AUDIT_LOG, GENESIS_HASH
from terralith.functions.text import canonical_timestamp

CHUNK = 100_000
#: Ids in a segment of a bulk load.
SEGMENT = 10_000
PAYLOAD_COLUMNS = ["log_id", "user_id", "actor_label", "action", "entity_type", "entity_id", "field_name",
                   "old_value", "new_value"]


def payload() -> Column:
    """The text of a row up to, but without, the hash of its predecessor."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PAYLOAD_COLUMNS]
    parts.append(F.format_string("%.4f", F.coalesce("ai_confidence", F.lit(0.0))))
    parts.append(F.coalesce("detail", F.lit("")))
    parts.append(canonical_timestamp(F.col("created_at")))
    return F.concat_ws("|", *parts)


def row_hash(prev_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", payload(), F.coalesce(prev_hash, F.lit(""))), 256)


def with_predecessor(df: DataFrame, column: str, out: str, default: str, chunk: int = CHUNK, levels: int = 2) -> DataFrame:
    """Value of ``column`` on the row with the next smaller id, without a global window."""
    base = df.withColumn("_chunk", F.floor(F.col("id") / chunk))
    inside = Window.partitionBy("_chunk").orderBy("id")
    own = base.withColumn("_lag", F.lag(column).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    lasts = base.groupBy("_chunk").agg(F.max_by(column, "id").alias("_last"))
    if levels > 1:
        carried = with_predecessor(lasts.select(F.col("_chunk").alias("id"), "_last"), "_last", "carried", default,
                                   chunk, levels - 1).select(F.col("id").alias("_chunk"), F.col("carried").alias("_carry"))
    else:
        # one row per chunk * chunk ids is left here
        carried = lasts.withColumn("_carry", F.coalesce(F.lag("_last").over(
            Window.partitionBy(F.lit(0)).orderBy("_chunk")), F.lit(default))).drop("_last")
    return (own.join(carried, "_chunk", "left")
            .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_chunk", "_lag", "_first", "_carry"))


def broken_links(log: DataFrame, segment: int | None = None) -> DataFrame:
    """Every row with its two checks: the link to the predecessor and its own hash."""
    if segment is None:
        linked = with_predecessor(log, "entry_hash", "expected_prev", GENESIS_HASH)
    else:
        inside = Window.partitionBy(F.floor(F.col("id") / segment)).orderBy("id")
        linked = log.withColumn("expected_prev", F.coalesce(F.lag("entry_hash").over(inside), F.lit(GENESIS_HASH)))
    return linked.withColumns({
        "link_ok": F.col("prev_hash") == F.col("expected_prev"),
        "hash_ok": row_hash(F.col("prev_hash")) == F.col("entry_hash")})


def verify(log: DataFrame, segment: int | None = None) -> DataFrame:
    """One row: entries_checked, chain_intact, broken_at (first broken id), head_hash.

    ``segment``: the log is chained inside ranges of that many ids (see ``append_segments``)
    instead of from its first row to its last.
    """
    bad = ~(F.col("link_ok") & F.col("hash_ok"))
    return broken_links(log, segment).agg(
        F.count("*").alias("entries_checked"), F.min(F.when(bad, F.col("id"))).alias("broken_at"),
        F.coalesce(F.max_by("entry_hash", "id"), F.lit(GENESIS_HASH)).alias("head_hash"),
    ).select("entries_checked", F.col("broken_at").isNull().alias("chain_intact"), "broken_at", "head_hash")


def chained(df: DataFrame, text: Column, order: str, start: str = GENESIS_HASH, group: Column | None = None) -> DataFrame:
    """df with prev_hash and entry_hash: sha256 of ``text``, a bar and the hash before, in ``order``.

    With ``group`` every group is a chain of its own from ``start``. Rows stream through the fold with all their columns,
    so neither a group nor the table is ever held; without a group all rows pass through one task, one after the other.
    """
    rows = df.drop("prev_hash", "entry_hash").withColumns({
        "_text": text, "_group": F.lit(0).cast("long") if group is None else group.cast("long")})
    dealt = rows.repartition(1) if group is None else rows.repartition("_group")
    plain = [c for c in df.columns if c not in ("prev_hash", "entry_hash")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prev = None, start
        for batch in batches:
            before, after = [], []
            for segment, entry in zip(batch.column("_group").to_pylist(), batch.column("_text").to_pylist()):
                if segment != at:
                    at, prev = segment, start
                before.append(prev)
                prev = hashlib.sha256(f"{entry}|{prev}".encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in plain), pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=[*plain, "prev_hash", "entry_hash"])

    schema = T.StructType([*rows.select(*plain).schema.fields, T.StructField("prev_hash", T.StringType()),
                           T.StructField("entry_hash", T.StringType())])
    return dealt.sortWithinPartitions("_group", order).mapInArrow(fold, schema)


def append(entries: DataFrame, head_hash: str = GENESIS_HASH) -> DataFrame:
    """Chain one micro-batch of entries, in id order, after ``head_hash``.

    Each hash covers the one before it, so one chain is sequential by nature; the caller bounds the batch
    (``maxFilesPerTrigger`` when streaming) or takes ``append_segments``.
    """
    return chained(entries, payload(), "id", head_hash).select(*[F.col(f.name) for f in AUDIT_LOG.fields])


def segment_of(segment: int) -> Column:
    return F.floor(F.col("id") / segment).cast("long")


def append_segments(entries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Chain a large load in parallel: one chain per range of ``segment`` ids, each from the genesis hash."""
    return chained(entries, payload(), "id", group=segment_of(segment)).select(*[F.col(f.name) for f in AUDIT_LOG.fields])


def segment_heads(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """segment, entries, last_id, head_hash of every segment of the log as it stands."""
    return log.groupBy(segment_of(segment).alias("segment")).agg(
        F.count("*").alias("entries"), F.max("id").alias("last_id"), F.max_by("entry_hash", "id").alias("head_hash"))


def _head_text() -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in ("segment", "entries", "last_id", "head_hash")))


def seal(log: DataFrame, segment: int = SEGMENT, after: str = GENESIS_HASH) -> DataFrame:
    """The heads of a log's segments, chained in the order of the segments after the link ``after``.

    Columns of ``segment_heads``, prev_hash and entry_hash (the link). This is ``segment`` times smaller than the log
    and chained by one task. New segments are sealed by themselves, after the last link of the table so far.
    """
    return chained(segment_heads(log, segment), _head_text(), "segment", after)


def anchor(heads: DataFrame) -> DataFrame:
    """One row: segments, entries and last link of sealed heads. Kept apart from log and heads, it shows a cut tail of both."""
    return heads.agg(F.count("*").alias("segments"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
                     F.coalesce(F.max_by("entry_hash", "segment"), F.lit(GENESIS_HASH)).alias("link"))


def segment_report(log: DataFrame, heads: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per segment that the log or the heads know: what is sealed against what is there.

    segment, sealed, found (entries; null where there are none), first_broken (first id whose link or hash is wrong),
    links_broken, hashes_broken, head_ok (count, last id and hash as sealed), link_ok (the head's own place in the chain
    of heads). Entries without a sealed head have sealed, head_ok and link_ok null: they are not sealed yet.
    """
    wrong = broken_links(log, segment)
    off = ~(F.col("link_ok") & F.col("hash_ok"))
    there = wrong.groupBy(segment_of(segment).alias("segment")).agg(
        F.count("*").alias("found"), F.max("id").alias("last_found"), F.max_by("entry_hash", "id").alias("hash_found"),
        F.min(F.when(off, F.col("id"))).alias("first_broken"), F.count_if(~F.col("link_ok")).alias("links_broken"),
        F.count_if(~F.col("hash_ok")).alias("hashes_broken"))
    ordered = with_predecessor(heads.withColumn("id", F.col("segment")), "entry_hash", "expected_prev", GENESIS_HASH)
    own = F.sha2(F.concat_ws("|", _head_text(), "prev_hash"), 256)
    links = ordered.select(
        "segment", F.col("entries").alias("sealed"), "last_id", "head_hash",
        ((F.col("prev_hash") == F.col("expected_prev")) & (own == F.col("entry_hash"))).alias("link_ok"))
    head_ok = ((F.col("sealed") == F.coalesce("found", F.lit(0))) & F.coalesce(F.col("last_id") == F.col("last_found"), F.lit(False))
               & F.coalesce(F.col("head_hash") == F.col("hash_found"), F.lit(False)))
    return there.join(links, "segment", "full").select(
        "segment", "sealed", "found", "first_broken", F.coalesce("links_broken", F.lit(0)).alias("links_broken"),
        F.coalesce("hashes_broken", F.lit(0)).alias("hashes_broken"),
        F.when(F.col("sealed").isNotNull(), head_ok).alias("head_ok"), "link_ok")


def verify_sealed(log: DataFrame, heads: DataFrame, segment: int = SEGMENT, kept: DataFrame | None = None) -> DataFrame:
    """One row: entries_checked, chain_intact, broken_at, head_hash, segments_checked, broken_segment, entries_missing.

    broken_at is the first entry that does not fit; broken_segment the first segment with such an entry, fewer or other
    entries than sealed, or a head out of its chain. ``kept`` is an earlier ``anchor``: if heads up to it are gone or
    changed, the chain is not intact either.
    """
    report = segment_report(log, heads, segment)
    bad = F.col("first_broken").isNotNull() | ~F.coalesce("head_ok", F.lit(True)) | ~F.coalesce("link_ok", F.lit(True))
    total = report.agg(
        F.coalesce(F.sum("found"), F.lit(0)).alias("entries_checked"), F.min("first_broken").alias("broken_at"),
        F.count("*").alias("segments_checked"), F.min(F.when(bad, F.col("segment"))).alias("broken_segment"),
        F.coalesce(F.sum(F.greatest(F.col("sealed") - F.coalesce("found", F.lit(0)), F.lit(0))), F.lit(0)).alias("entries_missing"))
    total = total.crossJoin(anchor(heads).select(F.col("link").alias("head_hash")))      # one row each
    held = F.lit(True)
    if kept is not None:
        links = heads.select(F.col("entry_hash").alias("link"))
        total = total.crossJoin(kept.join(links, "link", "left_semi").agg(F.count("*").alias("_known"))).crossJoin(
            kept.select(F.col("segments").alias("_segments")))
        held = (F.col("_known") > 0) | (F.col("_segments") == 0)
    return total.select("entries_checked", (F.col("broken_segment").isNull() & held).alias("chain_intact"), "broken_at",
                        "head_hash", "segments_checked", "broken_segment", "entries_missing")
