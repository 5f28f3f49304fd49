"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked.

Places where a token of A and a token of B both end cut a text into groups; tokens of one group are linked. Most groups
are one token of each side with the same bytes. An array from each id of A to the id of B with the same bytes tells
these at once; how many documents hold them is counted in one vector of the vocabulary's length per task. Only what is
left, links of irregular groups, is shuffled as pairs.

Neither tokenizer reaches over a place where a space follows something other than white space, so texts are cut there,
and each spelling between two cuts is aligned once.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.llm.common import keyed, stored, text_chunks
from terralith.llm.token_counts import PATTERN

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the formats: the mark for a space, the form of a byte piece, and the printable bytes that stand for
#: themselves in a byte-level vocabulary (the others follow from U+0100 on, in their order).
SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Spellings, and characters in them, that a task remembers.
REMEMBERED, REMEMBERED_CHARS = 500_000, 16_000_000
#: Where a text is cut: at its start, and at each space behind anything but white space.
UNITS = re.compile(r" \s*(?:\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*$)?)?")
INSIDE = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The characters of a byte-level vocabulary and the bytes that they stand for."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True)
class Models:
    """The files of both tokenizers, the bytes of their ids, and for each id of A that of B with the same bytes (or -1)."""
    a_file: str
    b_file: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    same: np.ndarray
    ranked: bool

    @staticmethod
    def load(model_a: str = MODEL_A, model_b: str = MODEL_B) -> Models:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(model_a, encoding="utf-8") as f:
            a_file = f.read()
        with open(model_b, "rb") as f:
            b_file = f.read()
        letters = byte_letters()
        vocabulary = Tokenizer.from_str(a_file).get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            if all(c in letters for c in piece):
                a_bytes[i] = bytes(letters[c] for c in piece)
        pieces = SentencePieceProcessor(model_proto=b_file)
        b_bytes = []
        for i in range(pieces.get_piece_size()):
            piece = pieces.id_to_piece(i)
            if re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError(f"piece {piece!r} reaches over the start of a space run")
            byte = BYTE_PIECE.fullmatch(piece) if pieces.is_byte(i) else None
            b_bytes.append(b"" if pieces.is_control(i) or pieces.is_unknown(i) else
                           bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode())
        place: dict[bytes, int] = {}
        for i in sorted(range(len(b_bytes)), key=lambda i: (pieces.is_byte(i), i)):
            place.setdefault(b_bytes[i], i)
        place.pop(b"", None)
        return Models(a_file, b_file, a_bytes, b_bytes, np.array([place.get(x, -1) for x in a_bytes]),
                      merged_by_id(json.loads(a_file)))


def merged_by_id(tokenizer: dict) -> bool:
    """Whether a tokenizer's file asks for nothing but the byte-level split and merges in the order of their ids.

    The ids are ranks then, and a faster encoder of the same kind gives the same tokens.
    """
    model, split = tokenizer["model"], tokenizer.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    first = [model["vocab"].get("".join(m), -1) for m in merges]
    return bool(merges and model["type"] == "BPE" and not tokenizer.get("normalizer") and split.get("type") == "ByteLevel"
                and not split.get("add_prefix_space") and split.get("use_regex", True) and first == sorted(set(first))
                and first[0] == 256 and not model.get("ignore_merges"))


class Column:
    """A growing array."""

    def __init__(self, kind: type = np.int64):
        self.data, self.size = np.empty(1024, dtype=kind), 0

    def extend(self, values: list) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.resize(self.data, max(end, 2 * len(self.data)))
        self.data[self.size:end] = values
        self.size = end


class Aligner:
    """Aligned spellings: counts, groups as text, identical ids and irregular pairs (a * size of B + b) of each."""

    def __init__(self, models: Models):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # a task has one core
        self.models, self.width = models, len(models.b_bytes)
        self.same = models.same.tolist()
        self.a_size, self.b_size = ([len(x) for x in y] for y in (models.a_bytes, models.b_bytes))
        self.one = [f"{a}|{b}" for a, b in enumerate(self.same)]
        self.b = SentencePieceProcessor(model_proto=models.b_file)
        if models.ranked:
            special = {t["id"] for t in json.loads(models.a_file).get("added_tokens", [])}
            ranks = {x: i for i, x in enumerate(models.a_bytes) if x and i not in special}
            ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode_a = lambda texts: [ranked.encode_ordinary(t) for t in texts]
        else:
            plain = Tokenizer.from_str(models.a_file)
            plain.encode_special_tokens = True
            self.encode_a = lambda texts: [x.ids for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
        self.space = [self.b.piece_to_id(SPACE)]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.numbers = [Column() for _ in range(5)]      # alike, n_a, n_b, n_groups, n_links
        self.same_end, self.pair_end = Column(), Column()
        self.same_id, self.same_count, self.pair_id, self.pair_count = (Column() for _ in range(4))
        self.same_end.extend([0])
        self.pair_end.extend([0])

    def units(self, text: str) -> list[str]:
        """The text cut into spellings, each without the space that it starts with."""
        spaced = " " + text
        return [u[1:] for u in UNITS.findall(spaced)] if INSIDE.search(spaced) else text.split(" ")

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], int, list[int], list[int], dict[int, int]]:
        """Groups as text, number of links, ids linked to the identical one and how often, irregular pairs and how often."""
        a_size, b_size, same_of, width, one = self.a_size, self.b_size, self.same, self.width, self.one
        texts, links, same, often, pairs = [], 0, [], [], {}
        i = j = at_a = at_b = first_a = first_b = 0
        n = len(a)
        while i < n:
            if at_a <= at_b:
                at_a += a_size[a[i]]
                i += 1
            while at_b < at_a:
                at_b += b_size[b[j]]
                j += 1
            if at_a != at_b:
                continue
            if i - first_a == 1 and j - first_b == 1 and same_of[a[first_a]] == b[first_b]:
                texts.append(one[a[first_a]])
                same.append(a[first_a])
                often.append(1)
                links += 1
            else:
                left, right = a[first_a:i], b[first_b:j]
                texts.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
                links += len(left) * len(right)
                few = len(left) * len(right) <= 64          # long groups are told by their distinct ids
                for x, k in (((x, 1) for x in left) if few else Counter(left).items()):
                    for y, m in (((y, 1) for y in right) if few else Counter(right).items()):
                        if same_of[x] == y:
                            same.append(x)
                            often.append(k * m)
                        else:
                            pair = x * width + y
                            pairs[pair] = pairs.get(pair, 0) + k * m
            first_a, first_b = i, j
        return texts, links, same, often, pairs

    def learn(self, units: list[str]) -> None:
        """Align spellings that are not known yet."""
        a_bytes, b_bytes = self.models.a_bytes.__getitem__, self.models.b_bytes.__getitem__
        same_of, one = self.same.__getitem__, self.one.__getitem__
        numbers: list[tuple[int, ...]] = []
        same_end, pair_end, same_id, same_count, pair_id, pair_count = [], [], [], [], [], []
        known_same, known_pairs = self.same_id.size, self.pair_id.size
        for at in range(0, len(units), 4096):
            some = units[at:at + 4096]
            spaced = [" " + u for u in some]
            for unit, a, b in zip(spaced, self.encode_a(spaced), self.b.encode(some, num_threads=1)):
                b, raw = b or self.space, unit.encode()
                groups, row = "", (0,) * 5
                if b"".join(map(a_bytes, a)) == raw:
                    if list(map(same_of, a)) == b:
                        groups, n = ";".join(map(one, a)), len(a)
                        row = (1, n, n, n, n)
                        same_id += a
                        same_count += [1] * n
                    elif b"".join(map(b_bytes, b)) == raw:
                        texts, links, same, often, pairs = self.align(a, b)
                        groups, row = ";".join(texts), (1, len(a), len(b), len(texts), links)
                        same_id += same
                        same_count += often
                        pair_id += pairs
                        pair_count += pairs.values()
                numbers.append(row)
                self.groups.append(groups)
                same_end.append(known_same + len(same_id))
                pair_end.append(known_pairs + len(pair_id))
        for column, values in zip(self.numbers, zip(*numbers)):
            column.extend(values)
        for column, values in ((self.same_end, same_end), (self.pair_end, pair_end), (self.same_id, same_id),
                               (self.same_count, same_count), (self.pair_id, pair_id), (self.pair_count, pair_count)):
            column.extend(values)
        self.chars += sum(map(len, units))

    def places(self, units: list[str]) -> np.ndarray:
        """Where each spelling stands among the aligned ones."""
        index = self.index
        known = len(index)
        out = [index.setdefault(u, len(index)) for u in units]
        if len(index) > known:
            self.learn(list(index)[known:] if known else list(index))
        return np.array(out, dtype=np.int64)


def _summed(texts: np.ndarray, places: np.ndarray, end: Column, ids: Column, counts: Column,
            n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Per text, the distinct ids of its spellings and how often they occur."""
    begin, size = end.data[places], end.data[places + 1] - end.data[places]
    total = int(size.sum())
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(total)
    width = int(ids.data[:ids.size].max(initial=0)) + 1
    if width >= (1 << 62) // (n + 1):
        raise OverflowError("vocabularies too large for one chunk of texts")
    key = np.repeat(texts, size) * width + ids.data[at]
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(counts.data[at][order], new) if total else np.empty(0, dtype=np.int64)
    key = key[new]
    offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * width).astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array(key % width)), pa.ListArray.from_arrays(offsets, pa.array(sums)))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
LISTS = ("same", "same_count", "pairs", "pair_count")


def _rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        for batch, raw in text_chunks(batches):
            if len(aligner.index) > REMEMBERED or aligner.chars > REMEMBERED_CHARS:
                aligner.forget()
            units = [aligner.units(t.decode()) if t else [] for t in raw]
            n, size = len(units), np.array([len(u) for u in units])
            places = aligner.places([u for each in units for u in each])
            texts = np.repeat(np.arange(n), size)
            alike = np.bincount(texts, weights=aligner.numbers[0].data[places], minlength=n) == size
            groups, at = [], 0
            for k, ok in zip(size.tolist(), alike.tolist()):
                groups.append(";".join([aligner.groups[p] for p in places[at:at + k].tolist()]) if ok else "")
                at += k
            kept = alike[texts]
            texts, places = texts[kept], places[kept]
            numbers = [np.bincount(texts, weights=c.data[places], minlength=n).astype(np.int64)
                       for c in aligner.numbers[1:]]
            lists = (*_summed(texts, places, aligner.same_end, aligner.same_id, aligner.same_count, n),
                     *_summed(texts, places, aligner.pair_end, aligner.pair_id, aligner.pair_count, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), *map(pa.array, numbers),
                 pa.array(groups, pa.string()), *lists],
                names=["row_id", "doc_id", *NUMBERS, "groups", *LISTS])
    return run


def align(df: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: row_id (unique), doc_id, n_a, n_b, n_groups, n_links, groups, and what the row links.

    `groups` is `a1,a2|b1;a3|b2,b3`. `same` holds ids of A linked to the id of B with the same bytes, `pairs` the other
    links as a * (size of B) + b; `same_count` and `pair_count` say how often. Texts that are null, empty, or whose
    tokens of A or B do not give the space and the text again have no tokens: zeros, an empty string, empty lists.
    Null and repeated ids stay rows of their own; other columns are not looked at.
    """
    rows = keyed(df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id")
    shared = df.sparkSession.sparkContext.broadcast(models)
    lists = ", ".join(f"{c} array<bigint>" for c in LISTS)
    numbers = ", ".join(f"{c} long" for c in NUMBERS)
    return rows.select("row_id", "doc_id", "text").mapInArrow(
        _rows(shared), f"row_id long, doc_id {df.schema[doc_id].dataType.simpleString()}, {numbers}, groups string, "
                       + lists)


def same_counts(aligned: DataFrame, same: np.ndarray) -> DataFrame:
    """a, b, docs: how many rows link each id of A to the id of B with the same bytes, counted in one vector per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(same), dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("same").flatten().to_numpy(zero_copy_only=False), minlength=len(same))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(same[found]), pa.array(counts[found])],
                                         names=["a", "b", "docs"])

    return aligned.select("same").mapInArrow(run, "a long, b long, docs long").groupBy("a", "b").agg(
        F.sum("docs").alias("docs"))


def link_counts(aligned: DataFrame, models: Models) -> DataFrame:
    """a, b, docs, best, same: how many rows of the stored table `aligned` hold a and b linked, whether no other b is
    linked to a in more rows, and whether both have the same bytes."""
    width = len(models.b_bytes)
    other = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = same_counts(aligned, models.same).withColumn("same", F.lit(True)).union(other.select(
        F.expr(f"pair div {width}"), F.col("pair") % width, "docs", F.lit(False)))
    most = F.max("docs").over(Window.partitionBy("a"))      # at most as many rows as B has ids
    return counts.withColumn("best", F.col("docs") == most)


def link_scores(aligned: DataFrame, counts: DataFrame, models: Models) -> DataFrame:
    """aligned (stored) with n_best, the links whose count is the highest of their id of A, and count_sum over links.

    Counts of identical ids, at most as many as A has ids, go to the tasks as vectors; those of other pairs are joined.
    """
    docs, best = np.zeros(len(models.same), dtype=np.int64), np.zeros(len(models.same), dtype=np.int64)
    known = counts.where("same").select("a", "docs", "best").toArrow()
    at = known.column("a").to_numpy()
    docs[at], best[at] = known.column("docs").to_numpy(), known.column("best").to_numpy()
    shared = aligned.sparkSession.sparkContext.broadcast((docs, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("same")
            at = lists.flatten().to_numpy(zero_copy_only=False)
            often = batch.column("same_count").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sums = [np.diff(np.append(0, np.cumsum(often * vector[at]))[ends], prepend=0) for vector in
                    (shared.value[1], shared.value[0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums)],
                                             names=[*batch.schema.names[:-2], "same_best", "same_sum"])

    plain = [c for c in aligned.columns if c not in LISTS]
    fields = T.StructType([*aligned.select(*plain).schema.fields, T.StructField("same_best", T.LongType()),
                           T.StructField("same_sum", T.LongType())])
    rows = aligned.select(*plain, "same", "same_count").mapInArrow(run, fields)
    links = aligned.select("row_id", F.explode(F.arrays_zip("pairs", "pair_count")).alias("l")).select(
        "row_id", F.col("l.pairs").alias("pair"), F.col("l.pair_count").alias("n"))
    width = len(models.b_bytes)
    irregular = counts.where("NOT same").select(
        (F.col("a") * width + F.col("b")).alias("pair"), "docs", "best")
    sums = links.join(irregular.hint("merge"), "pair").groupBy("row_id").agg(
        F.sum(F.col("n") * F.col("docs")).alias("pair_sum"), F.sum(F.when(F.col("best"), F.col("n"))).alias("pair_best"))
    return rows.join(sums, "row_id", "left").select(
        *plain, (F.col("same_best") + F.coalesce("pair_best", F.lit(0))).alias("n_best"),
        (F.col("same_sum") + F.coalesce("pair_sum", F.lit(0))).alias("count_sum"))


def aligned_with_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model_a: str = MODEL_A,
                        model_b: str = MODEL_B) -> DataFrame:
    """align(df) with the digest of `groups` in their place, n_best and count_sum; ids repeat as they do in df."""
    models = Models.load(model_a, model_b)
    found = align(df, models, doc_id, text)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = stored(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = stored(link_counts(aligned, models), "link-counts")
    return link_scores(aligned, counts, models).drop("row_id").withColumnRenamed("doc_id", doc_id)
