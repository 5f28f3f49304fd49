"""Quality classifier: similarity-weighted voting of labelled nearest neighbours in a latent-semantic space.

A bounded sample of labelled texts gives the space (a truncated singular value decomposition of their weighted
character-pair counts) and the labelled vectors. Both are of fixed size, whatever the corpus, and go to the tasks; each
document is compared with every labelled vector in blocks of exact cosine products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.llm.common import text_chunks

#: Labelled rows that the classifier may learn from at most: those with the smallest hash of their id.
SAMPLE_ROWS = 4096
DIMENSIONS = 48
NEIGHBOURS = 7
THRESHOLD = 0.3
BLOCK_ROWS = 256
#: Bytes fall into classes; a text's features are its pairs of neighbouring classes and its repeated words.
CLASSES = 64


def _byte_classes() -> np.ndarray:
    """White space, line ends, digits, A-Z and bytes of other letters are a class each; a-z and signs stand alone."""
    out = np.full(256, 4, dtype=np.int64)            # beyond ASCII
    out[:128] = 0                                    # white space and control characters
    out[0x0A], out[0x30:0x3A], out[0x41:0x5B] = 1, 2, 3
    signs = [b for b in range(0x21, 0x7F) if not (chr(b).isalnum())]
    out[0x61:0x7B] = np.arange(5, 31)
    out[signs] = np.arange(31, 31 + len(signs))
    return out


_CLASS = _byte_classes()


def features(texts: list[bytes]) -> np.ndarray:
    """Counts of neighbouring byte classes, and bytes in words that repeat the word before; a row per text."""
    out = np.zeros((len(texts), CLASSES * CLASSES), dtype=np.float32)
    for i, text in enumerate(texts):
        kinds = _CLASS[np.frombuffer(text, dtype=np.uint8)]
        if len(kinds) > 1:
            out[i] = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        words = text.split()
        out[i, -1] = sum(len(b) for a, b in zip(words, words[1:]) if a == b)   # the last class is no byte's
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


@dataclass(frozen=True)
class Model:
    """Weights of the features, the projection, the labelled vectors, their labels, and the share of label 1."""
    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.sqrt(counts) * self.weights) @ self.projection)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(texts), BLOCK_ROWS):
            cosine = self.embed(features(texts[at:at + BLOCK_ROWS])) @ self.vectors.T
            # Ties at the edge: the sum over all neighbours as close as the k-th one.
            edge = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k][:, None]
            votes = np.where(cosine >= edge, np.maximum(cosine, 0), 0).astype(np.float64)
            total = votes.sum(axis=1)
            out[at:at + BLOCK_ROWS] = np.where(
                total > 0, votes @ self.labels / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def _leading_axes(rows: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).standard_normal((rows.shape[1], dimensions + 8)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    if not len(rows):
        return basis[:, :dimensions]
    _, _, axes = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ axes.T)[:, :dimensions])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        counts = features(texts)
        places = [np.flatnonzero(row) for row in counts]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("label"), pa.array([p.astype(np.int32) for p in places],
                                                                pa.list_(pa.int32())),
            pa.array([row[p] for row, p in zip(counts, places)], pa.list_(pa.float32()))],
            names=["id", "label", "places", "counts"])


def is_held_out(doc_id) -> F.Column:
    """Rows kept for the test: crc32 of the id as text, modulo 5, is 0. A null id is in no training set either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from at most `sample_rows` labelled texts that are not held out; null labels are left out.

    Without labelled texts every score is 0.5.
    """
    chosen = labels.where(F.col(label).isNotNull() & ~is_held_out(F.col(doc_id))).groupBy(doc_id).agg(
        F.max(label).cast("int").alias("label")).orderBy(F.xxhash64(doc_id), doc_id).limit(sample_rows)
    sample = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(chosen.withColumnRenamed(doc_id, "id")), "id").dropDuplicates(["id"])
    kind = df.schema[doc_id].dataType.simpleString()
    rows = sample.select("id", "label", "text").mapInArrow(
        _feature_rows, f"id {kind}, label int, places array<int>, counts array<float>").orderBy("id").toArrow()
    n = rows.num_rows
    counts, marks = np.zeros((n, CLASSES * CLASSES), dtype=np.float32), rows.column("label").to_numpy().astype(float)
    for i, (places, values) in enumerate(zip(rows.column("places"), rows.column("counts"))):
        counts[i, places.values.to_numpy()] = values.values.to_numpy()
    weights = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    weighted = _unit(np.sqrt(counts) * weights)
    projection = _leading_axes(weighted, dimensions)
    embedded = _unit(weighted @ projection)
    return Model(weights, projection, embedded, marks, neighbours, float(marks.mean()) if n else 0.5)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """df with the column `into`: 0 to 1. Null counts as empty; texts under two bytes get the share of label 1."""
    if into in df.columns:
        raise ValueError(f"{into} is a column already")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, column=text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts))],
                                             names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())]))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score `threshold` or more; its columns may have any names."""
    into = "score"
    while into in df.columns:
        into += "_"
    return score(df, fit(df, labels, text, doc_id), text, into).where(F.col(into) >= threshold).select(*df.columns)
