"""Byte-exact substring dedup with suffix arrays of collections, built column by column.

Equal strings of `size` bytes are brought together first (see `stretches`): those of one anchor form stretches, and the
distinct stretches of an anchor that has several are the documents of bounded collections.
In each collection the suffixes are sorted as in the column-wise construction: every round takes one more symbol of
every document, from the right, puts the longer suffixes into the sorted columns (first symbol, preceding symbol or
Burrows-Wheeler transform, place of the tail, common prefix, document), and updates the common prefixes. A symbol is
40 bytes under an integer name, so a stretch counts as 40 documents, one per phase; a common prefix of size / 40
symbols is a repeat. Collections are bounded, so the columns of a round stay in memory instead of in external files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import BYTE_POWERS, keyed, prefix, rolling, text_chunks
from terralith.llm.stretches import RUNS, RUNS_TYPE, counted_runs, covered, cut_stretches, intervals, with_repeats

STRING_BYTES = 400
SYMBOL_BYTES = 40
#: Distinct stretches of one anchor that a collection takes; larger groups are counted string by string.
GROUP_LIMIT = 2048
#: Stretches in a collection: whole groups are added until it holds so many.
COLLECTION = 512


def _sums(raw: bytes) -> np.ndarray:
    return prefix(np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1), BYTE_POWERS)


def _slices(size: int):
    return lambda texts, wanted: [[t[f:f + n + size - 1] for f, n in each] for t, each in zip(texts, wanted)]


# --- the collection's suffix array ---

def _named(*parts: np.ndarray) -> np.ndarray:
    """Equal integers for equal tuples, smaller ones for smaller tuples."""
    out = parts[0]
    for part in parts[1:]:
        out = np.unique(out, return_inverse=True)[1].astype(np.int64) * (int(part.max(initial=0)) + 1) + part
    return np.unique(out, return_inverse=True)[1].astype(np.int64)


def _symbols(strings: list[bytes]) -> np.ndarray:
    """The name of the symbol that starts at each byte of the strings, end to end. Names sort as the bytes do."""
    flat = np.frombuffer(b"".join(strings) + bytes(SYMBOL_BYTES), dtype=np.uint8)
    eight = _named(np.ndarray((len(flat) - 7,), dtype=">u8", buffer=flat, strides=(1,)).astype(np.uint64))
    n = len(flat) - SYMBOL_BYTES
    return _named(*(eight[k:k + n] for k in range(0, SYMBOL_BYTES, 8)))


def collection_suffixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of a collection: string number, first byte, common prefix with the one before (in symbols), and
    Burrows-Wheeler transform (names of the preceding symbols, -1 before a document's first)."""
    names = _symbols(strings)
    origin = np.cumsum([0] + [len(s) for s in strings])[:-1]
    phases = np.arange(SYMBOL_BYTES)
    lengths = np.maximum(0, np.array([len(s) for s in strings])[:, None] - phases) // SYMBOL_BYTES
    ends = (origin[:, None] + phases + lengths * SYMBOL_BYTES).ravel()
    lengths = lengths.ravel()
    docs = len(lengths)
    base = np.int64(int(lengths.sum()) + docs + 1)
    # Round 0: the empty suffixes, in document order. A document's own end differs from all others'.
    doc = np.arange(docs, dtype=np.int32)
    size = np.zeros(docs, dtype=np.int16)
    common = np.zeros(docs, dtype=np.int16)
    preceding = np.where(lengths > 0, names[np.maximum(ends - SYMBOL_BYTES, 0)] if len(names) else -1, -1)
    key = np.arange(-docs, 0, dtype=np.int64)   # first symbol and place of the tail in one number; ends come first
    tail = np.full(docs, -1, dtype=np.int64)
    place = np.arange(docs, dtype=np.int64)     # of every document's longest suffix so far
    for j in range(1, int(lengths.max(initial=0)) + 1):
        live = np.flatnonzero(lengths >= j)
        new_tail = place[live]
        new_key = preceding[new_tail] * base + new_tail
        sort = np.argsort(new_key)
        live, new_tail, new_key = live[sort], new_tail[sort], new_key[sort]
        at = np.searchsorted(key, new_key)
        # Common prefix with the suffix before and after: one more than that of the tails, if first symbols agree.
        follows = np.append(False, at[1:] == at[:-1])
        before = np.where(follows, np.roll(new_key, 1), np.where(at > 0, key[at - 1], -1))
        last = np.append(~follows[1:], True) & (at < len(key))
        with_before = _tail_prefix(common, before, new_key, base)
        with_after = _tail_prefix(common, new_key[last], key[at[last]], base)
        common[at[last]] = with_after
        # Sequential pass over the columns: rows move down by the suffixes put before them, tails likewise.
        target = at + np.arange(len(at))
        old = np.ones(len(key) + len(at), dtype=bool)
        old[target] = False
        moved = np.cumsum(np.bincount(at, minlength=len(key) + 1))[:-1]
        shift = np.where(tail >= 0, moved[tail], 0)
        key, tail = key + shift, tail + shift
        step = moved[new_tail]
        further = ends[live] - (j + 1) * SYMBOL_BYTES
        new = (with_before, live, np.int16(j), np.where(lengths[live] > j, names[np.maximum(further, 0)], -1),
               new_key + step, new_tail + step)
        common, doc, size, preceding, key, tail = (
            _put(column, old, target, values) for column, values in zip((common, doc, size, preceding, key, tail), new))
        place[live] = target
    start = ends[doc] - size.astype(np.int64) * SYMBOL_BYTES - origin[doc // SYMBOL_BYTES]
    return doc // SYMBOL_BYTES, start, common, preceding


def _put(column: np.ndarray, old: np.ndarray, target: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(old), dtype=column.dtype)
    out[old], out[target] = column, values
    return out


def _tail_prefix(common: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.int64) -> np.ndarray:
    """Common prefix of neighbouring suffixes given by (first symbol, tail): 0 where first symbols differ, else one
    more than the smallest common prefix between the tails."""
    same = np.flatnonzero((low >= 0) & (high >= 0) & (low // base == high // base))
    out = np.zeros(len(low), dtype=np.int16)
    if len(same):
        begin, end = low[same] % base + 1, high[same] % base + 1
        order = np.argsort(begin)                       # in sequence, so that the columns are read once
        bounds = np.column_stack([begin[order], end[order]]).ravel()
        out[same[order]] = 1 + np.minimum.reduceat(np.append(common, np.int16(0)), bounds)[0::2]
    return out


def _repeats(size: int):
    """Per distinct stretch, the strings in it that also stand in another stretch of its collection."""
    def collection(group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        number, start, common, _ = collection_suffixes([b for _, _, b in group])
        enough = common >= size // SYMBOL_BYTES
        hit = enough | np.append(enough[1:], False)
        number, start = number[hit], start[hit]
        order = np.lexsort((start, number))
        number, start = number[order], start[order]
        cut = np.flatnonzero(np.diff(number, prepend=-1))
        which = number[cut]
        return pa.RecordBatch.from_arrays([
            pa.array([group[k][0] for k in which], pa.int64()), pa.array([group[k][1] for k in which], pa.int64()),
            pa.array([intervals(s) for s in np.split(start, cut[1:])] if len(cut) else [], RUNS_TYPE)],
            names=["anchor", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "tokens"))):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    yield collection(held)
                    held = []
                held.append(row)
        if held:
            yield collection(held)
    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            runs, out = batch.column("runs"), []
            for i, raw in enumerate(texts):
                gone = covered(runs[i], len(raw), size)
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), len(edge) // 2, edge[0::2].tolist(), edge[1::2].tolist(), kept,
                            hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
                     pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "span_start", "span_end", "kept", "kept_sha256"])
    return run


def remove_repeated_bytes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = STRING_BYTES,
                          group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, span_start, span_end, kept, kept_sha256.

    A byte of the UTF-8 text goes if a string of `size` bytes (a multiple of 40) that covers it also starts anywhere
    else, in this row or another. Spans are the maximal removed runs [span_start, span_end). Null counts as empty;
    shorter texts keep all. Rows that repeat doc_id are texts of their own. Other columns are ignored.
    """
    if size % SYMBOL_BYTES:
        raise ValueError(f"size must be a multiple of {SYMBOL_BYTES}")
    ids = df.schema[doc_id].dataType.simpleString()
    texts = keyed(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")

    def within(distinct: DataFrame) -> DataFrame:
        """Suffix arrays of whole groups; groups over the limit by counts of their strings, which splits them."""
        small = distinct.where(F.col("in_group") <= group_limit).repartition("anchor").sortWithinPartitions("anchor")
        found = small.mapInArrow(_repeats(size), f"anchor long, content long, runs {RUNS}")
        large = distinct.where(F.col("in_group") > group_limit)
        return found.unionByName(counted_runs(large, lambda raw: rolling(_sums(raw), size, BYTE_POWERS)))

    marked = with_repeats(texts, lambda raws: [_sums(r) for r in raws], size, max(1, size // 12), BYTE_POWERS,
                          cut_stretches(_slices(size)), within)
    return marked.select("doc_id", "text", "runs").mapInArrow(
        _cut(size), f"doc_id {ids}, n_bytes long, n_removed long, n_spans long, span_start array<bigint>, "
        "span_end array<bigint>, kept binary, kept_sha256 string")
