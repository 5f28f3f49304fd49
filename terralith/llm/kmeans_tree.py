"""Approximate nearest neighbours by a hierarchical k-means tree.

A bounded sample gives a tree of cluster centres. Every row goes down to one leaf. A query visits leaves best bin first:
a priority queue over the nodes met so far yields the nearest one next. How many leaves it must visit is calibrated: for
a bounded set of rows the exact neighbours are found by brute force over all rows, and visits are widened until the
wanted share of these lies in visited leaves. Distances to the rows of a visited leaf are worked out for blocks of rows
and queries, each pair of blocks by itself, however full a leaf is.

Rows with one vector tell each other apart by their ids alone, so only the smallest ids of a vector can be found; a
common vector is one entry of its leaf and one query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import stored

#: Rows that the tree is fitted on at most, rows that visits are calibrated with: those with the smallest hashes.
SAMPLE_ROWS, CALIBRATION_ROWS = 16384, 128
BRANCHES, LEAF_ROWS, ROUNDS = 16, 256, 8
#: Share of the calibration rows' neighbours that must lie in visited leaves.
WANTED_RECALL = 0.95
#: Vectors in a block of a leaf, and queries in one.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 256


@dataclass(frozen=True)
class Tree:
    """Centres of all nodes; children of node i are children[i] to children[i + 1] - 1; leaf numbers, -1 inside."""
    centres: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector: down to the nearest child at each node, the first of equals."""
        node = np.zeros(len(vectors), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            for parent in np.unique(node[inner]):
                rows = inner[node[inner] == parent]
                node[rows] = self.first[parent] + nearest(vectors[rows], self.centres[self.first[parent]:self.last[parent]])

    def visits(self, vector: np.ndarray, limit: int) -> list[int]:
        """The first `limit` leaves of a best-bin-first traversal."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < limit:
            _, node = heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                continue
            a, b = self.first[node], self.last[node]
            for k, d in enumerate(np.square(self.centres[a:b] - vector).sum(axis=1).tolist()):
                heappush(queue, (d, int(a) + k))
        return out

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.square(centres).sum(axis=1) - 2 * vectors @ centres.T, axis=1)


def k_means(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k distinct centres. The first ones are spread: each next one is far from those before it."""
    distinct = np.unique(vectors, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(len(vectors))
    centres = distinct[rng.integers(len(distinct))][None]
    gap = np.square(distinct - centres[0]).sum(axis=1)
    while len(centres) < k and gap.sum() > 0:
        centres = np.append(centres, distinct[rng.choice(len(distinct), p=gap / gap.sum())][None], axis=0)
        gap = np.minimum(gap, np.square(distinct - centres[-1]).sum(axis=1))
    for _ in range(rounds):
        of = nearest(vectors, centres)
        size = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, vectors)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def grow(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over the sample: nodes of more than leaf_rows distinct rows are split. An empty sample gives one leaf."""
    centres, first, last, leaf = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [0], [0], [-1]
    waiting, leaves = [(0, sample)], 0
    for node, rows in waiting:                     # grows while it is read
        found = k_means(rows, branches) if len(np.unique(rows, axis=0)) > leaf_rows else None
        if found is None or len(found) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        of = nearest(rows, found)
        first[node], last[node] = len(centres), len(centres) + len(found)
        for k, centre in enumerate(found):
            waiting.append((len(centres), rows[of == k]))
            centres.append(centre)
            first.append(0)
            last.append(0)
            leaf.append(-1)
    return Tree(np.array(centres), np.array(first), np.array(last), np.array(leaf))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def valid_vectors(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """id, vector (doubles) of the rows with an id and a vector that is not zero and holds finite numbers only."""
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def sampled(rows: DataFrame, size: int, of: int, seed: int) -> DataFrame:
    """The `size` rows, of about `of`, with the smallest hashes; most others are left out before they are sorted."""
    key = F.xxhash64(F.lit(seed), "id", "vector")
    share = min(1.0, 2 * size / max(of, 1) + 0.001)
    return rows.withColumn("key", key).where(F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(
        "key", "id").limit(size).drop("key")


def to_matrix(rows: DataFrame, width: int) -> np.ndarray:
    """Vectors of a bounded table on the driver."""
    return matrix(rows.select("vector").toArrow().column(0).combine_chunks(), width)


def entries_of(rows: DataFrame, tree: Tree, keep: int) -> DataFrame:
    """leaf, ids, vector: one row for each distinct vector, with the `keep` smallest ids that have it.

    Ids beyond these are dropped before the shuffle, so a common vector costs each task a few rows.
    """
    order = Window.partitionBy("hash", "vector").orderBy("id")
    few = rows.withColumn("hash", F.xxhash64("vector")).withColumn("place", F.dense_rank().over(order)).where(
        F.col("place") <= keep)
    distinct = few.groupBy("hash", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids", "vector")
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column(1), shared.value.centres.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *batch.columns],
                                             names=["leaf", "ids", "vector"])

    return distinct.mapInArrow(run, "leaf long, ids array<bigint>, vector array<double>")


def blocks_of(rows: DataFrame, size: int, *named: str) -> DataFrame:
    """Blocks of about `size` rows (leaf, a, vector) of one leaf: leaf and, under the names given, the lists of a and
    the vectors end to end. How many parts a leaf is dealt into follows from its count, so no task gathers a leaf."""
    parts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("parts"))     # at most one row per leaf
    placed = rows.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")))
    return placed.groupBy("leaf", "part").agg(F.collect_list(F.struct("a", "vector")).alias("rows")).select(
        "leaf", F.col("rows.a").alias(named[0]), F.flatten("rows.vector").alias(named[1]))


def best(rough: np.ndarray, q: np.ndarray, vectors: np.ndarray, room: float, first_id: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k vectors nearest to q, ties to the smaller first_id.

    `rough` orders them by products, right but for rounding errors below `room`; distances come from differences.
    """
    at = np.arange(len(rough))
    if len(rough) > k:
        at = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + room)
    far = np.sqrt(np.square(vectors[at] - q).sum(axis=1))
    order = np.lexsort((first_id[at], far))[:k]
    return at[order], far[order]


def first_ids(entries: pa.Array) -> np.ndarray:
    ends = np.cumsum(pc.list_value_length(entries).to_numpy(zero_copy_only=False))
    return entries.flatten().to_numpy(zero_copy_only=False)[np.append(0, ends)[:-1]]


def nearest_rows(queries: tuple[np.ndarray, np.ndarray], vectors: np.ndarray, entries: pa.Array, width: int,
                 k: int) -> pa.RecordBatch:
    """For numbered query vectors, the nearest entries as a batch of (query, score, ids)."""
    numbers, qs, vs = queries[0], queries[1].reshape(-1, width), vectors.reshape(-1, width)
    norms, first_id = np.square(vs).sum(axis=1), first_ids(entries)
    room = 1e-9 * (np.square(qs).sum(axis=1) + norms.max())
    rough = norms - 2 * (qs @ vs.T)
    found = [best(r, q, vs, e, first_id, k) for r, q, e in zip(rough, qs, room)]
    at = np.concatenate([a for a, _ in found])
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(numbers, [len(a) for a, _ in found])), pa.array(np.concatenate([d for _, d in found])),
        entries.take(pa.array(at))], names=["query", "score", "ids"])


def nearest_so_far(found: Iterator[pa.RecordBatch], k: int, held: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The batches of a task with only the k nearest entries of each query, as far as `held` rows reach."""
    kept, rows = [], 0

    def cut() -> pa.RecordBatch:
        batch = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        query, score = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.lexsort((first_ids(batch.column(2)), score, query))
        new = np.flatnonzero(np.diff(query[order], prepend=query[order[0]] - 1))
        place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        return batch.take(pa.array(order[place < k]))

    for batch in found:
        if batch.num_rows:
            kept.append(batch)
            rows += batch.num_rows
        if rows > held:
            kept = [cut()]
            rows = kept[0].num_rows
            if rows > held // 2:            # more queries than can be held back
                yield kept.pop()
                rows = 0
    if kept:
        yield cut()


FOUND = "query long, score double, ids array<bigint>"


def top(found: DataFrame, k: int) -> DataFrame:
    """query, rows: the k nearest rows (score, id) of each query, nearest first, from its nearest entries."""
    order = Window.partitionBy("query").orderBy("score", F.col("ids")[0])
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    rows = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("id")))))
    return first.groupBy("query").agg(F.slice(F.array_sort(rows), 1, k).alias("rows"))


def parts_of(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, size) for at in range(0, batch.num_rows, size))


def brute_force(entries: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """query (its number), rows: the k nearest rows of a bounded set of vectors, compared with every entry in blocks."""
    shared, width = entries.sparkSession.sparkContext.broadcast(queries), queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(len(shared.value))
        yield from nearest_so_far((nearest_rows((numbers, shared.value), matrix(part.column(1), width), part.column(0),
                                                width, k)
                                   for batch in batches for part in parts_of(batch, BLOCK_ROWS)), k)

    return top(entries.select("ids", "vector").mapInArrow(run, FOUND), k)


def calibrated_visits(entries: DataFrame, tree: Tree, queries: np.ndarray, k: int, wanted: float) -> int:
    """Leaves to visit so that a share of at least `wanted` of the queries' k nearest rows (and themselves) is found.

    Visited leaves are searched exactly, so a row is found if its leaf is visited; visits are widened leaf by leaf.
    """
    if tree.leaves == 1 or not len(queries):
        return tree.leaves
    truth = brute_force(entries, queries, k).select("query", F.explode("rows.id").alias("id"))
    homes = entries.select("leaf", F.explode("ids").alias("id"))
    near = truth.join(homes, "id").select("query", "leaf").toArrow()       # bounded: k rows for each query
    ranks = [{leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves))} for q in queries]
    rank = np.array([ranks[q][leaf] for q, leaf in zip(near.column(0).to_pylist(), near.column(1).to_pylist())])
    found = np.cumsum(np.bincount(rank, minlength=tree.leaves)) / len(rank)
    return int(np.argmax(found >= wanted)) + 1


def numbered_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors as (query, vector), and (id, query) for each distinct row; both stored."""
    hashed = queries.withColumn("hash", F.xxhash64("vector"))
    distinct = stored(hashed.groupBy("hash", "vector").agg(F.min("id").alias("least")).select(
        F.monotonically_increasing_id().alias("query"), "hash", "vector"), "queries")
    return distinct.select("query", "vector"), stored(
        hashed.join(distinct, ["hash", "vector"]).select("id", "query"), "query-rows")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "vec_id", vector: str = "embedding",
           wanted: float = WANTED_RECALL, sample_rows: int = SAMPLE_ROWS, branches: int = BRANCHES,
           leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of `queries` the k nearest rows of `rows` by Euclidean
    distance, nearest first, ties to the smaller id; all candidates where there are fewer.

    A query's own row (its id and its vector) is no candidate. Rows without an id, or whose vector is null, zero, or
    holds null or non-finite components take no part, nor do those whose length is not the most frequent one (of
    equally frequent lengths, the greatest). Repeated rows, with one id and one vector, count once; one id on different
    vectors makes different rows and, if asked for, queries. Other columns are not looked at. The tree is fitted on at
    most `sample_rows` rows, and fewer if they were over 64 MB.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = valid_vectors(rows, row_id, vector)
    sizes = good.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if sizes is None:
        return empty
    width, n = sizes
    good = good.where(F.size("vector") == width)
    asked = valid_vectors(queries, row_id, vector).where(F.size("vector") == width)
    bound = max(1, min(sample_rows, (64 << 20) // (8 * width)))
    tree = grow(to_matrix(sampled(good, bound, n, 1), width), branches, leaf_rows)
    entries = stored(entries_of(good, tree, k + 1), "entries")
    calibration = to_matrix(sampled(good, min(CALIBRATION_ROWS, bound), n, 2), width)
    limit = calibrated_visits(entries, tree, calibration, k + 1, wanted)
    distinct, asked_rows = numbered_queries(asked)
    shared = spark.sparkContext.broadcast(tree)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [shared.value.visits(q, limit) for q in matrix(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))],
                                             names=["a", "vector", "leaves"])

    visited = distinct.mapInArrow(visits, "a long, vector array<double>, leaves array<bigint>").select(
        "a", "vector", F.explode("leaves").alias("leaf"))
    query_blocks = stored(blocks_of(visited, BLOCK_QUERIES, "queries", "query_vectors"), "query-blocks")
    entry_blocks = stored(blocks_of(entries.withColumnRenamed("ids", "a"), BLOCK_ROWS, "ids", "vectors"), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for part in (part for batch in batches for part in parts_of(batch, 1)):
                q, qv, v = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(3))
                yield nearest_rows((q, qv), v, part.column(3).flatten(), width, k + 1)

        yield from nearest_so_far(found(), k + 1)

    found = query_blocks.join(entry_blocks, "leaf").select("queries", "query_vectors", "vectors", "ids").mapInArrow(
        compare, FOUND)
    results = stored(top(found, k + 1), "results")
    near = F.filter("rows", lambda r: (r["id"] != F.col("query_id")) | (r["score"] > 0))
    return asked_rows.join(results, "query").withColumnRenamed("id", "query_id").select(
        "query_id", F.posexplode(F.slice(near, 1, k)).alias("place", "row")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("row.id").alias("vec_id"), F.col("row.score").alias("score"))
