"""N-gram Jaccard join with PartEnum signatures.

Texts become sets of word shingles. Sets are grouped in size bands so narrow that similar sets lie in the same band or
in neighbouring ones, and each set signs for its own band and for the next. In a band, similar sets differ in at most k
shingles. The shingle domain is cut into n1 * n2 partitions by hash: of the n1 first-level parts, one at least holds at
most k2 of the differences, so of its n2 partitions some n2 - k2 are free of them. Every such choice of partitions gives
a signature, and two similar sets share at least one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import Words, components, keyed, mix, shingle_set, stored, text_chunks

SHINGLE_WORDS = 5
SIMILARITY = (8, 10)
#: Longs of the parity map that goes with a set.
PARITY_LONGS = 16
#: Slices of the shingles that are counted one after the other; the disk holds the rows of one or two.
REACH_SLICES = 8


@dataclass(frozen=True)
class Instance:
    """PartEnum parameters of a band."""
    band: int
    n1: int
    n2: int
    k2: int
    slack: int
    subsets: tuple[tuple[int, ...], ...]


class Bands:
    """Size bands and their parameters for Jaccard >= num / den, made as sizes come up."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        self.made: dict[int, Instance | None] = {}

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self._grow()
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def _grow(self) -> None:
        self.low.append(self.low[-1] * self.den // self.num + 1)

    def instance(self, band: int) -> Instance | None:
        """Parameters for sets of this band and the one below; None where only equal sets are similar."""
        if band not in self.made:
            while len(self.low) <= band + 1:
                self._grow()
            k = 2 * (self.low[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            self.made[band] = self._choose(band, k, self.low[max(0, band - 1)]) if k else None
        return self.made[band]

    @staticmethod
    def _choose(band: int, k: int, smallest: int) -> Instance:
        if k <= 3:
            n1, n2, k2, slack = 1, max(3, 2 * k), k, 0
        else:
            # Parts with an empty choice of partitions say nothing; `slack` more parts make up for those to expect.
            n2, k2, slack = 3, 1, 0
            for _ in range(4):
                n1 = k // (k2 + 1) + 1 + slack
                weak = n1 * min(1.0, 3 * math.exp(-2 * smallest / (n1 * n2)))
                slack = math.ceil(weak + 2 * math.sqrt(weak))
            n1 = k // (k2 + 1) + 1 + slack
        return Instance(band, n1, n2, k2, slack, tuple(combinations(range(n2), n2 - k2)))


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set of hashed shingles."""
    own, out, values = bands.of(len(features)), [], mix(features)
    for band in (own, own + 1):
        inst = bands.instance(band)
        if inst is None:
            continue
        cells = inst.n1 * inst.n2
        part = ((values >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
        sums = np.zeros(cells, dtype=np.uint64)
        np.add.at(sums, part, mix(values + np.uint64(1)))
        sums = sums.reshape(inst.n1, inst.n2)
        filled = np.bincount(part, minlength=cells).reshape(inst.n1, inst.n2) > 0
        value = np.stack([sums[:, s].sum(axis=1) for s in inst.subsets], axis=1)
        some = np.stack([filled[:, s].any(axis=1) for s in inst.subsets], axis=1)
        tag = mix(np.uint64(band) << np.uint64(40) | np.arange(value.size, dtype=np.uint64)).reshape(value.shape)
        value = mix(value + tag)
        # An empty choice is left out while enough full parts remain to hold one that similar sets share.
        if (~some.all(axis=1)).sum() <= inst.slack:
            value = value[some]
        out.append(value.ravel())
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _set_id(features: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(features.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(features: np.ndarray) -> np.ndarray:
    bits = 64 * PARITY_LONGS
    odd = np.bincount((features % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _each_set(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, texts in text_chunks(batches, lower=True):
        words = Words(texts)
        yield batch, [shingle_set(words.of(i), size) for i in range(len(texts))]


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_set(batches, size):
            parity = [_parity(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("row_id"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_set_id(s) for s in sets], pa.int64()), pa.array(parity, pa.list_(pa.int64()))],
                names=["row_id", "doc_id", "n_shingles", "set_id", "parity"])
    return run


def _signature_rows(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for _, sets in _each_set(batches, size):
            values, owners = [], []
            for s in sets:
                if len(s) and (key := _set_id(s)) not in seen:
                    seen.add(key)
                    values.append(signatures(s, bands))
                    owners.append(np.full(len(values[-1]), key, dtype=np.int64))
            if values:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(owners))],
                    names=["signature", "set_id"])
    return run


def _feature_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_set(batches, size):
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["set_id", "features"])
    return run


def _similar(common: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return den * common >= num * (a + b - common)


def _differ(a: str, b: str) -> Column:
    """Bits in which two parity maps differ: no more than the shingles in which the sets differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _links(pairs: DataFrame, sets: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set_ids whose sets are similar.

    Sizes and parity maps first: a shingle in one set only changes at most one bit, so maps that differ in more bits
    than similar sets differ in shingles rule a pair out. What remains is decided on the sets themselves.
    """
    side = lambda df, name, *cols: df.select(F.col("set_id").alias(name), *(
        F.col(c).alias(f"{c}_{name}") for c in cols))
    near = pairs.join(side(sets, "a", "n_shingles", "parity"), "a").join(side(sets, "b", "n_shingles", "parity"), "b")
    size_a, size_b = F.col("n_shingles_a"), F.col("n_shingles_b")
    near = near.where((F.least(size_a, size_b) * den >= F.greatest(size_a, size_b) * num) & (
        _differ("parity_a", "parity_b") * (den + num) <= (size_a + size_b) * (den - num))).select("a", "b")
    both = near.join(side(features, "a", "features"), "a").join(side(features, "b", "features"), "b")
    common = F.size(F.array_intersect("features_a", "features_b"))
    return both.where(_similar(common, F.size("features_a"), F.size("features_b"), num, den)).select("a", "b")


def _open_members(groups: DataFrame, reached: DataFrame) -> DataFrame:
    """(signature, set_id, component) of the groups that lie in several components."""
    members = groups.join(reached.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    split = members.groupBy("signature").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("signature")
    return stored(members.join(split, "signature", "left_semi"), "open-groups")


def _reach(members: DataFrame, features: DataFrame) -> DataFrame:
    """set_id, reach: how many shingles of a set occur in a set of another component, for sets that have some.

    A row per shingle is several times the texts, so slices of the shingles are counted one after the other.
    """
    held = features.join(members.select("set_id", "component").distinct(), "set_id").select(
        "set_id", "component", F.explode("features").alias("shingle"))
    counted = []
    for i in range(REACH_SLICES):
        part = held.where(F.pmod("shingle", F.lit(REACH_SLICES)) == i)
        shared = part.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(
            "x <> y").select("shingle")
        counted.append(stored(part.select("set_id", "shingle").join(shared, "shingle", "left_semi").groupBy(
            "set_id").agg(F.count("*").alias("reach")), "reach"))
    return reduce(DataFrame.unionByName, counted).groupBy("set_id").agg(F.sum("reach").alias("reach"))


def _crossing(members: DataFrame, sets: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b) of sets in different components that share a signature and may be similar.

    What a set can have in common with sets of other components is at most the number of its shingles that occur in
    one. Sets for which that is too few for any partner in their group are left out before the join, pairs for which
    it is too few, or whose parity maps differ too much, in the join's condition. What is left of the pairs is made
    distinct: rows that carry all signatures of their set, to tell the first one a pair shares, grow with their square.
    """
    sized = members.join(_reach(members, features), "set_id").join(
        sets.select("set_id", F.col("n_shingles").alias("n")), "set_id")
    smallest = sized.groupBy("signature").agg(F.min("n").alias("smallest"))
    able = stored(sized.join(smallest, "signature").where(
        (F.col("reach") * den >= F.col("n") * num)
        & (F.col("reach") * (den + num) >= (F.col("n") + F.col("smallest")) * num)), "able")
    able = able.drop("smallest").join(sets.select("set_id", "parity"), "set_id")
    side = lambda name: able.select("signature", *(F.col(c).alias(f"{c}_{name}") for c in (
        "set_id", "component", "n", "reach", "parity")))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return side("a").join(side("b"), "signature").where(
        (F.col("component_a") < F.col("component_b")) & (small * den >= large * num)
        & (F.least("reach_a", "reach_b") * (den + num) >= (small + large) * num)
        & (_differ("parity_a", "parity_b") * (den + num) <= (small + large) * (den - num))).select(
        F.least("set_id_a", "set_id_b").alias("a"), F.greatest("set_id_a", "set_id_b").alias("b")).distinct()


def _grouped(texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """For (row_id, doc_id, text): row_id, doc_id, n_shingles, component_id, kept."""
    num, den = similarity
    ids = texts.schema["doc_id"].dataType.simpleString()
    rows = stored(texts.mapInArrow(_set_rows(shingle), f"row_id long, doc_id {ids}, n_shingles long, set_id long, "
                                   "parity array<bigint>"), "sets")
    sets = rows.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("row_id").alias("row_id"), F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"),
        F.min(F.struct("doc_id", "row_id")).alias("least"))

    # Sets that share a signature with another one. Equal sets count once.
    signed = texts.select("text").mapInArrow(_signature_rows(shingle, num, den), "signature long, set_id long")
    same = Window.partitionBy("signature")
    groups = stored(signed.withColumn("low", F.min("set_id").over(same)).withColumn(
        "high", F.max("set_id").over(same)).where("low <> high").select("signature", "set_id").distinct(), "groups")
    chosen = groups.select("set_id").distinct().join(sets.select("set_id", "row_id"), "set_id")
    features = stored(texts.select("row_id", "text").join(chosen, "row_id").select("set_id", "text").mapInArrow(
        _feature_rows(shingle), "set_id long, features array<bigint>"), "features")

    # First every set is compared with the smallest one of each of its groups. Sets that this puts in one component
    # need no further comparison; where a group lies in several, its sets are compared across them.
    pivots = groups.groupBy("signature").agg(F.min("set_id").alias("a"))
    stars = stored(groups.join(pivots, "signature").where("set_id <> a").select(
        "a", F.col("set_id").alias("b")).distinct(), "stars")
    links = stored(_links(stars, sets, features, num, den), "links")
    reached = components(links)
    crossing = _crossing(_open_members(groups, reached), sets, features, num, den).join(stars, ["a", "b"], "left_anti")
    more = stored(_links(stored(crossing, "crossing"), sets, features, num, den), "more-links")
    if not more.isEmpty():
        reached = components(links.unionByName(more))

    least = sets.select("set_id", "least").join(
        reached.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    first = least.groupBy("component").agg(F.min("least").alias("first"))
    named = least.select("set_id", "component").join(first, "component").select("set_id", "first")
    linked = rows.drop("parity").join(named, "set_id", "left")
    alone = F.col("n_shingles") == 0
    return linked.select(
        "row_id", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias(
            "component_id"), (alone | (F.col("row_id") == F.col("first.row_id"))).alias("kept"))


def near_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE_WORDS,
                similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept.

    Sets are distinct runs of `shingle` words (split at ASCII white space, A-Z lower-cased); a shorter text is one run,
    a text without words (or null) has none and is linked with nothing. Sets link when their Jaccard similarity is
    similarity[0] / similarity[1] or more; component_id is the smallest doc_id that links lead to (null is smaller than
    any). One row of each component is kept, one with that doc_id. Rows that repeat doc_id are texts of their own. Other columns are ignored.
    """
    texts = keyed(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    return _grouped(texts, shingle, similarity).drop("row_id")


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE_WORDS,
                         similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """df with one row of each component of `near_groups`; its columns may have any names."""
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = keyed(packed, "doc_id")
    kept = _grouped(rows.select("row_id", "doc_id", "text"), shingle, similarity).where("kept").select("row_id")
    return rows.join(kept, "row_id", "left_semi").select("row.*")
