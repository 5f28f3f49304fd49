"""Periodic runs of words, found by catching squares over dyadic blocks as words are appended.

A catcher belongs to a completed block of 2^k words that starts at a multiple of 2^k. It waits for the block to come
again at a distance p of 2^(k+1) up to 2^(k+2) - 1 words. A square of period p holds such a block of its level in its
first half, so every square is caught. Catches of one period in neighbouring blocks are one stretch; comparing suffixes
before it and words behind it gives the maximal run. Words come in portions of any size: each one is compared with the
catchers that wait for it, and runs can be read after any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import WORD_POWERS, Powers, spans, text_chunks

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words that are appended at once.
PORTION = 1 << 16
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SquareCatcher:
    """Appended words (as numbers) and the squares caught among them."""

    def __init__(self, powers: Powers = WORD_POWERS):
        self.powers = powers
        self.words = np.empty(0, dtype=np.int64)
        self.sums = np.zeros(1, dtype=np.uint64)
        self.size = 0
        self.seen: list[int] = []                            # by level: windows that were compared
        self.catches: list[list[np.ndarray]] = []            # by level: rows (period, block start)

    def _room(self, n: int) -> None:
        if n > len(self.words):
            space = max(n, 2 * len(self.words))
            self.words = np.append(self.words, np.zeros(space - len(self.words), dtype=np.int64))
            self.sums = np.append(self.sums, np.zeros(space + 1 - len(self.sums), dtype=np.uint64))

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Compare new words with the waiting catchers; no period over half of `longest` words is looked for."""
        old, new = self.size, self.size + len(words)
        self._room(new)
        self.words[old:new] = words
        up, _ = self.powers.upto(new + 1)
        terms = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        terms ^= terms >> np.uint64(29)
        np.cumsum(np.append(self.sums[old:old + 1], terms * up[old:new]), out=self.sums[old:new + 1])
        self.size = new
        level = 0
        while 2 << level <= min(new, longest or new) // 2 or level == 0:
            if level == len(self.seen):
                self.seen.append(0)
                self.catches.append([])
            self._advance(level)
            level += 1

    def _advance(self, level: int) -> None:
        """Compare every window of 2^level words completed since last time with the catchers two and three blocks back."""
        block, begin, end = 1 << level, self.seen[level], self.size - (1 << level) + 1
        if end <= begin:
            return
        at = np.arange(begin, end)
        names = self.words[begin:end] if level == 0 else self._names(at, block)
        for back in (1, 2, 3) if level == 0 else (2, 3):
            start = (at >> level << level) - back * block
            first = int(np.searchsorted(at, back * block))    # before it there is no such block
            if first == len(at):
                continue
            blocks = start[first::1]
            same = (self.words[blocks] if level == 0 else self._block_names(blocks, block)) == names[first:]
            hit = np.flatnonzero(same)
            if len(hit):
                b = blocks[hit]
                self.catches[level].append(np.stack([at[first:][hit] - b, b]))
        self.seen[level] = end

    def _names(self, start: np.ndarray, length: int) -> np.ndarray:
        return spans(self.sums, start, start + length, self.powers)

    def _block_names(self, blocks: np.ndarray, block: int) -> np.ndarray:
        """Names of aligned blocks, each worked out once."""
        first = int(blocks[0])
        names = self._names(np.arange(first, int(blocks[-1]) + 1, block), block)
        return names[(blocks - first) // block]

    def _alike(self, a: np.ndarray, b: np.ndarray, limit: int, step: int) -> np.ndarray:
        """How many words, under `limit`, from a and b on (step 1) or before them (step -1) are equal; b > a."""
        n, length = self.size, np.zeros(len(a), dtype=np.int64)
        room = n - b if step > 0 else a
        part = limit // 2
        while part:
            more = length + part
            can = more <= room
            x, y = (a + length, b + length) if step > 0 else (a - more, b - more)
            same = np.zeros(len(a), dtype=bool)
            same[can] = self._names(x[can], part) == self._names(y[can], part)
            length[same] += part
            part //= 2
        return length

    def runs(self, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
        """Rows (start, length, period) of the runs so far, by start, then period: maximal stretches with that smallest
        period and at least max(min_length, min_exponent * period) words; min_exponent is at least 2."""
        if min_exponent < 2:
            raise ValueError("a run holds a square: min_exponent is at least 2")
        found = [np.empty((3, 0), dtype=np.int64)]
        for level, catches in enumerate(self.catches):
            if not catches:
                continue
            block = 1 << level
            period, start = np.concatenate(catches, axis=1)
            order = np.lexsort((start, period))
            period, start = period[order], start[order]
            new = np.flatnonzero((np.diff(period, prepend=0) != 0) | (np.diff(start, prepend=0) != block))
            last = np.append(new[1:], len(period)) - 1
            p, begin, end = period[new], start[new], start[last] + block
            long = end - begin + 2 * block + p >= np.maximum(min_length, min_exponent * p)
            p, begin, end = p[long], begin[long], end[long]
            begin = begin - self._alike(begin, begin + p, block, -1)
            end = end + self._alike(end, end + p, block, 1)
            found.append(np.stack([begin, end + p - begin, p]))
        start, length, period = np.concatenate(found, axis=1)
        keep = length >= np.maximum(min_length, min_exponent * period)
        start, length, period = start[keep], length[keep], period[keep]
        # A stretch that is known under two periods is a run of the smaller one.
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        once = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
        out = [row for s, n, p in zip(start[once].tolist(), length[once].tolist(), period[once].tolist())
               for row in self._exact(s, n, p) if row[1] >= max(min_length, min_exponent * p)]
        return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)

    def _exact(self, start: int, length: int, period: int) -> list[tuple[int, int, int]]:
        """The run itself, compared word by word; parts of it where equal names belonged to unequal words."""
        a = self.words[start:start + length - period]
        wrong = np.flatnonzero(a != self.words[start + period:start + length])
        if not len(wrong):
            return [(start, length, period)]
        cuts = np.concatenate(([-1], wrong, [len(a)]))
        return [(start + i + 1, j - i - 1 + period, period) for i, j in zip(cuts, cuts[1:]) if j - i > 1]


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Runs of every text, given as words. The texts are appended one after the other, with a word of its own between
    two of them, which no square can hold."""
    catcher, numbers = SquareCatcher(), {}
    longest = max(map(len, texts), default=0)
    flat = [numbers.setdefault(w, len(numbers)) for words in texts for w in words]
    ids = np.array(flat, dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    ids = np.insert(ids, ends, len(numbers) + np.arange(len(texts)))
    for at in range(0, len(ids), PORTION):
        catcher.append(ids[at:at + PORTION], longest)
    found = catcher.runs(min_length, min_exponent)
    first = ends - sizes + np.arange(len(texts))
    cut = np.searchsorted(found[:, 0], np.append(first, len(ids)))
    return [found[a:b] - [f, 0, 0] for a, b, f in zip(cut, cut[1:], first)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist()) if not g)


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of df: doc_id, n_words, runs (array of start, length, period), collapsed (text).

    Words are separated by the ASCII white space 0x20 and 0x09-0x0D. `collapsed` holds the words that no run contains
    after its first period, joined by one space. Runs come by start, then period. Null and empty texts have no words,
    no runs and an empty collapsed text. Repeated and null ids stay rows of their own; other columns are not looked at.
    Nothing is shuffled; a task holds about 1 MB of text at once, or one longer text.
    """
    kind = df.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words = [t.split() for t in texts]
            found = runs_of(words, min_length, min_exponent)
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            rows = np.concatenate(found)
            values = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], fields=list(RUNS.value_type))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(list(map(len, words)), pa.int64()),
                pa.ListArray.from_arrays(pa.array(sizes), values, type=RUNS),
                pa.array([collapsed(w, r).decode() for w, r in zip(words, found)], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    out = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_words long, "
             "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("doc_id", doc_id)


def with_repeats_planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where a tenth of the rows, chosen by crc32 of their id, repeat a stretch up to their end.

    With h that crc32 and g = h div 10, rows with h % 10 = 0 and n > 0 words hold, from word a = g % n on, the p words
    there over and over, p = 1 + (n - a) div (3 + g % 8). Rows with a null id stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = df.select(F.col(doc_id), F.col(text), F.when(h % 10 == 0, words).alias("w"), g.alias("g"))
    sized = chosen.withColumn("n", F.size("w"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rest = F.col("n") - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    copies = F.ceil(rest / F.col("p")).cast("int")
    repeated = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(unit, copies))),
                       F.lit(1), F.col("n"))
    return placed.select(doc_id, F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col(text)).alias(text))


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the number of runs, the one with the greatest exponent, and digests of the runs and collapsed texts."""
    empty = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best: Column, r: Column) -> Column:      # runs come by start, period: of equals the first stays
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = found.withColumn("best", F.aggregate("runs", empty, better))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(
        r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    return best.select(
        doc_id, F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in (
            "start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
