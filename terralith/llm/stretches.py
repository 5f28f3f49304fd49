"""Runs of tokens that occur more than once, found with one row per stretch instead of one per run.

A run of `size` tokens is represented by the smallest hash among the shorter runs in it (its anchor); equal runs have
equal anchors. Neighbouring runs of a text with one anchor form a stretch. Runs of one stretch all differ, so a run
repeats if its whole stretch has a copy, or if it also stands in a different stretch with the same anchor. The first is
a count in Spark; for the second only one of each distinct stretch, of anchors that have several, is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import Powers, minimum_places, rolling, spans, stored, text_chunks

#: Prefix sums of the Rabin-Karp hashes of each text's tokens.
Sums = Callable[[list[bytes]], list[np.ndarray]]
#: From distinct stretches (anchor, content, in_group, tokens as bytes) to the repeats in them (anchor, content, runs).
Within = Callable[[DataFrame], DataFrame]

RUNS = "array<struct<begin:bigint,end:bigint>>"
RUNS_TYPE = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def stretches(sums: np.ndarray, size: int, short: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first run and number of runs of every stretch of a text."""
    runs = rolling(sums, short, powers)
    at = minimum_places(runs, size - short + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=len(at))
    return runs[at[first]], spans(sums, first, first + count + size - 1, powers), first, count


def _rows(token_sums: Sums, size: int, short: int, powers: Powers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            parts, rows = [], []
            for row, sums in zip(batch.column("row_id").to_numpy(), token_sums(texts)):
                if len(sums) > size:
                    parts.append(stretches(sums, size, short, powers))
                    rows.append(np.full(len(parts[-1][0]), row, dtype=np.int64))
            if parts:
                anchor, content, first, count = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(np.concatenate(rows)),
                    pa.array(first.astype(np.int64)), pa.array(count.astype(np.int32))],
                    names=["anchor", "content", "row_id", "first", "count"])
    return run


def intervals(starts: np.ndarray) -> list[dict[str, int]]:
    """Sorted run numbers as maximal intervals [begin, end)."""
    cut = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return [{"begin": int(starts[a]), "end": int(starts[b - 1]) + 1}
            for a, b in zip(cut, np.append(cut[1:], len(starts)))]


def covered(runs, length: int, size: int) -> np.ndarray:
    """Which of `length` tokens the runs [begin, end) of a text cover; runs is an Arrow list or null."""
    gone = np.zeros(length + 1, dtype=np.int32)
    if runs.is_valid and len(runs.values):
        np.add.at(gone, runs.values.field("begin").to_numpy(), 1)
        np.add.at(gone, runs.values.field("end").to_numpy() + size - 1, -1)
    return np.cumsum(gone)[:-1] > 0


def with_repeats(texts: DataFrame, token_sums: Sums, size: int, short: int, powers: Powers, cut: Callable,
                 within: Within) -> DataFrame:
    """texts (row_id, doc_id, text) with `runs`: intervals of the numbers of those runs that start anywhere else too.

    `cut` is an Arrow function from (…, text, stretches) to distinct stretches, which `within` takes. The texts are
    dealt out by row_id once, for cutting stretches and for the result.
    """
    found = texts.select("row_id", "text").mapInArrow(
        _rows(token_sums, size, short, powers), "anchor long, content long, row_id long, first long, count int")
    several = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    rows = stored(found.join(several, "anchor", "left_semi"), "stretches")
    copies = stored(rows.groupBy("anchor", "content").agg(F.count("*").alias("copies")), "copies")
    groups = copies.groupBy("anchor").agg(F.count("*").alias("in_group")).where("in_group > 1")
    chosen = rows.join(groups, "anchor").groupBy("anchor", "content").agg(
        *(F.first(c).alias(c) for c in ("row_id", "first", "count", "in_group")))
    chosen = stored(chosen.groupBy("row_id").agg(F.collect_list(F.struct(
        "anchor", "content", "first", "count", "in_group")).alias("stretches")), "chosen")
    # A left join here and below: both then read the same exchange of the texts.
    partial = within(texts.join(chosen, "row_id", "left").mapInArrow(
        cut, "anchor long, content long, in_group long, tokens binary"))
    decided = copies.join(partial, ["anchor", "content"], "left").where("copies > 1 OR runs IS NOT NULL").select(
        "anchor", "content", F.when(F.col("copies") == 1, F.col("runs")).alias("runs"))
    begin, end = F.col("first"), F.col("first") + F.col("count")
    runs = rows.join(decided, ["anchor", "content"]).select("row_id", F.when(F.col("runs").isNull(), F.array(F.struct(
        begin.alias("begin"), end.alias("end")))).otherwise(F.transform("runs", lambda r: F.struct(
            (r["begin"] + begin).alias("begin"), (r["end"] + begin).alias("end")))).alias("runs"))
    runs = runs.groupBy("row_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return texts.join(runs, "row_id", "left")


def cut_stretches(slices: Callable[[list[bytes], list[list[tuple[int, int]]]], list[list[bytes]]]):
    """An Arrow function for `cut`: `slices` gives the tokens, as bytes, of the stretches (first run, number of runs) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            wanted = [w or [] for w in batch.column("stretches").to_pylist()]
            if not any(wanted):
                continue
            cuts = slices(texts, [[(w["first"], w["count"]) for w in each] for each in wanted])
            out = [(w["anchor"], w["content"], w["in_group"], c) for each, cut in zip(wanted, cuts)
                   for w, c in zip(each, cut)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["anchor", "content", "in_group", "tokens"])
    return run


def counted_runs(distinct: DataFrame, hashes: Callable[[bytes], np.ndarray], limit: int = 1 << 18) -> DataFrame:
    """Repeats between distinct stretches by counting all their runs: rows, one per run, pre-aggregated by hash."""
    def table(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(h) for _, _, h in held]
        return pa.RecordBatch.from_arrays([
            *(pa.array(np.repeat(np.array([x[k] for x in held], dtype=np.int64), sizes)) for k in (0, 1)),
            pa.array(np.concatenate([np.arange(n) for n in sizes])),
            pa.array(np.concatenate([h for _, _, h in held]).view(np.int64))],
            names=["anchor", "content", "run", "hash"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for anchor, content, tokens in zip(*(batch.column(c).to_pylist() for c in (
                    "anchor", "content", "tokens"))):
                held.append((anchor, content, hashes(tokens)))
                size += len(held[-1][2])
                if size > limit:
                    yield table(held)
                    held, size = [], 0
        if held:
            yield table(held)

    runs = distinct.select("anchor", "content", "tokens").mapInArrow(
        each, "anchor long, content long, run long, hash long")
    several = runs.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "hash")
    starts = runs.join(several, ["anchor", "hash"], "left_semi").groupBy("anchor", "content").agg(
        F.collect_list("run").alias("runs"))
    return starts.select("anchor", "content", F.transform("runs", lambda r: F.struct(
        r.alias("begin"), (r + 1).alias("end"))).alias("runs"))
