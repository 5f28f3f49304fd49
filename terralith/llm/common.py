"""Helpers shared by the operators: shared-folder tables, ASCII lower case, rolling hashes, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.config import checkpoint_dir, write_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a task hashes at once; longer texts are hashed alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is (lower() alone would change other letters)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique number per row. Only for tables that are stored before the number is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def keyed(df: DataFrame, doc_id: str) -> DataFrame:
    """df with a unique long `row_id` that later passes over df see alike.

    That is doc_id itself where it is an integer, unique and never null; else the rows are numbered and stored once.
    """
    if df.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long"):
        taken = df.groupBy(doc_id).agg(F.count("*").alias("n"))
        if taken.where((F.col("n") > 1) | F.col(doc_id).isNull()).isEmpty():
            return df.withColumn("row_id", F.col(doc_id).cast("long"))
    return stored(numbered(df), "rows")


# --- rolling hashes over bytes and words, modulo 2^64 ---

class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = self._powers(self.base, size), self._powers(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp prefix sums: prefix[i] covers values[:i]."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of values[start:end], equal for equal content wherever it stands."""
    _, down = powers.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def rolling(sums: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Hashes of every run of `size` values."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    _, down = powers.upto(len(sums))
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


class Words:
    """Words of several texts laid end to end: hashes, byte places, and the first word of each text."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        gap = _SPACE[raw]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        self.start, self.end = edge[0::2], edge[1::2]
        sums = prefix(raw.astype(np.uint64) + np.uint64(1), BYTE_POWERS)
        self.hash = spans(sums, self.start, self.end, BYTE_POWERS)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(self.start, offsets)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i]:self.first[i + 1]]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; a shorter text is one shingle; none without words."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(rolling(prefix(words, WORD_POWERS), min(size, len(words)), WORD_POWERS))


def minimum_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of its smallest one (the last of equals)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    # The upper half of a value decides, the lower half holds the place in reverse: one minimum gives both.
    low = np.uint64(0xFFFFFFFF)
    keyed_values = (values & ~low) | (low - np.arange(len(values), dtype=np.uint64))
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = keyed_values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (low - (np.minimum(back[:n], ahead[width - 1:width - 1 + n]) & low)).astype(np.int64)


def text_chunks(batches: Iterable[pa.RecordBatch], lower: bool = False, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches holding about `limit` bytes in one column, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        at = 0
        while at < batch.num_rows:
            texts, size, to = [], 0, at
            while to < batch.num_rows and (size < limit or to == at):
                value = values[to].as_buffer()
                raw = value.to_pybytes() if value is not None else b""
                texts.append(raw.lower() if lower else raw)
                size += len(raw) + 1
                to += 1
            yield batch.slice(at, to - at), texts
            at = to


# --- connected components ---

def components(links: DataFrame, name: str = "component", limit: int = 64) -> DataFrame:
    """Smallest node reachable from each node of `links` (a, b); columns node, component.

    Alternates two steps over the table of links until it stops changing: every node hands its smallest neighbour to
    its larger ones, then to its smaller ones. Each node keeps one row per link, never a list of its component.
    """
    both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = stored(both, f"{name}-links"), None
    for _ in range(limit):
        mirrored = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = mirrored.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = mirrored.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, f"{name}-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
