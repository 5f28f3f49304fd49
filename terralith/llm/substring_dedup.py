"""Substring dedup over words: every window of fixed length is hashed by Rabin-Karp and counted in Spark.

Neighbouring windows that go by the same anchor are counted as one stretch, and one by one only where stretches with
that anchor differ (see `stretches`): the counts are those of all windows, with a tenth of the rows shuffled. Repeated
windows merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import WORD_POWERS, Words, keyed, prefix, rolling, text_chunks
from terralith.llm.stretches import counted_runs, covered, cut_stretches, with_repeats

WINDOW_WORDS = 35


def _sums(texts: list[bytes]) -> list[np.ndarray]:
    words = Words(texts)
    return [prefix(words.of(i), WORD_POWERS) for i in range(len(texts))]


def _slices(window: int):
    def run(texts: list[bytes], wanted: list[list[tuple[int, int]]]) -> list[list[bytes]]:
        words = Words(texts)
        return [[words.of(i)[f:f + n + window - 1].tobytes() for f, n in each] for i, each in enumerate(wanted)]
    return run


def _windows(window: int):
    return lambda tokens: rolling(prefix(np.frombuffer(tokens, dtype=np.uint64), WORD_POWERS), window, WORD_POWERS)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            runs = batch.column("runs")
            out = []
            for i, text in enumerate(texts):
                words = text.split()
                gone = covered(runs[i], len(words), window)
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((len(words), int(gone.sum()), edge[0::2].tolist(), edge[1::2].tolist(), kept.decode(),
                            hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_removed", "span_start", "span_end", "kept_text", "kept_sha256"])
    return run


def remove_repeated_windows(df: DataFrame, text: str = "text", doc_id: str = "doc_id",
                            window: int = WINDOW_WORDS) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, span_start, span_end, kept_text, kept_sha256.

    A word goes if a run of `window` words that covers it also starts anywhere else. The removed words are the maximal
    intervals [span_start, span_end) of word numbers. Null and empty texts have no words; texts shorter than the window
    keep all. Rows that repeat doc_id are texts of their own. Other columns are ignored.
    """
    ids = df.schema[doc_id].dataType.simpleString()
    texts = keyed(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    marked = with_repeats(texts, _sums, window, max(1, window // 5), WORD_POWERS, cut_stretches(_slices(window)),
                          lambda distinct: counted_runs(distinct, _windows(window)))
    return marked.select("doc_id", "text", "runs").mapInArrow(
        _cut(window), f"doc_id {ids}, n_words long, n_removed long, span_start array<int>, span_end array<int>, "
        "kept_text string, kept_sha256 string")
