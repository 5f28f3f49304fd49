"""SentencePiece encoding and decoding with N-best segmentations.

The pieces of a vocabulary that occur in a text form a lattice over its characters. A forward Viterbi pass gives the
best score from the start to every place; these are exact heuristics for an A* search backward from the end, which
therefore finds the segmentations in order of their scores. No piece reaches over the start of a space run, so the
lattice falls apart there: units between those places are searched once per spelling, and the N best of the whole text
are the N best sums over its units. Each of the N comes out with its ids.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush, nlargest, nsmallest
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the mark for a space, and how far an unknown character scores below the lowest piece.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
N_BEST = 4
#: Spellings, and their characters, whose segmentations a worker remembers while it works for one table.
REMEMBERED, REMEMBERED_CHARS = 1_500_000, 24_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores, ids of the 256 byte pieces, and the ids that take part in the lattice."""
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    normal: tuple[int, ...]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = tuple(model.id_to_piece(i) for i in ids)
        place = {p: i for i, p in enumerate(pieces)}
        return Vocabulary(
            pieces, tuple(model.get_score(i) for i in ids), tuple(place[f"<0x{b:02X}>"] for b in range(256)),
            tuple(i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                         or model.is_unused(i))))


class Segmenter:
    """N-best segmentation with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, n_best: int = N_BEST, remembered: int = REMEMBERED):
        import ahocorasick

        self.vocabulary, self.n_best, self.remembered = vocabulary, n_best, remembered
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.normal:
            piece = vocabulary.pieces[i]
            self.automaton.add_word(piece, (len(piece), vocabulary.scores[i], (i,)))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.scores[i] for i in vocabulary.normal) - UNKNOWN_PENALTY
        words = [vocabulary.pieces[i] for i in vocabulary.normal]
        self.single = {w for w in words if len(w) == 1}
        # Cutting before a space run needs that no piece goes on into one, cutting at line ends that none holds one.
        lines = "" if any("\n" in w and len(w) > 1 for w in words) else "\n"
        whole = any(SPACE in w.lstrip(SPACE) for w in words)
        units = f" *[^ {lines}]+| +" + ("|\n" if lines else "")
        self.units = re.compile(".+" if whole else units, re.DOTALL)
        self._forget()

    def _forget(self) -> None:
        """Nothing is known: the number of each spelling, and by number its best ids, best score, and loss of the
        second best."""
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)
        self.scores, self.losses = np.empty(0), np.empty(0)
        self.others: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def search(self, unit: str, n_best: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of a unit: scores and ids. Equal scores come in a fixed order."""
        n_best = n_best or self.n_best
        n = len(unit)
        # Forward: the pieces that end at each place, and the best score up to there.
        edges: list[list] = [[] for _ in range(n + 1)]
        for at, match in self.automaton.iter(unit):
            edges[at + 1].append(match)
        best = [0.0]
        for at, char in enumerate(unit):
            here = edges[at + 1]
            if char not in self.single:
                raw = char.encode("utf-8", "surrogatepass")
                here.append((1, self.unknown, tuple(self.vocabulary.byte_ids[b] for b in raw)))
            best.append(max([best[at + 1 - size] + score for size, score, _ in here]))
        # Backward: a state is a place, the score and ids behind it, and the next edge to try there. The best score up
        # to the place makes its value exact, so the first edge is followed at once and the others wait in the heap.
        found: list[tuple[float, tuple[int, ...]]] = []
        ordered: dict[int, list[tuple[float, int, float, tuple[int, ...]]]] = {}
        heap: list[tuple[float, int, int, int, float, tuple]] = [(-best[n], 0, n, 0, 0.0, ())]
        order = 0
        while heap and len(found) < n_best:
            _, _, end, k, done, path = heappop(heap)
            while end:
                here = ordered.get(end)
                if here is None:
                    here = ordered[end] = sorted([(best[end - size] + score, end - size, score, ids)
                                                  for size, score, ids in edges[end]], reverse=True)
                if k + 1 < len(here):
                    order += 1
                    heappush(heap, (-(done + here[k + 1][0]), order, end, k + 1, done, path))
                _, end, score, ids = here[k]
                done, path, k = done + score, ids + path, 0
            found.append((done, path))
        return found

    def _learn(self, units: list[str]) -> None:
        """Numbers for spellings that have none."""
        found = [self.search(u.replace(" ", SPACE), min(2, self.n_best)) for u in units]
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        self.chars += sum(map(len, units))
        sizes = np.array([len(f[0][1]) for f in found], dtype=np.int64)
        start, ends = self.ends[-1], self.ends[-1] + np.cumsum(sizes)
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(int(ends[-1]), dtype=np.int32)])
        self.ids[start:ends[-1]] = [i for f in found for i in f[0][1]]
        self.ends = np.concatenate([self.ends, ends])
        self.scores = np.concatenate([self.scores, [f[0][0] for f in found]])
        self.losses = np.concatenate(
            [self.losses, [f[0][0] - f[1][0] if len(f) > 1 else float("inf") for f in found]])

    def _others(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        if unit not in self.others:
            if len(self.others) > self.remembered // 16:
                self.others = {}
            self.others[unit] = self.search(unit.replace(" ", SPACE))
        return self.others[unit]

    def encode_all(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its n_best segmentations: scores and ids. An empty text has none."""
        units = [self.units.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.number) > self.remembered or self.chars > REMEMBERED_CHARS:
            self._forget()
        if new := {u for row in units for u in row if u not in self.number}:
            self._learn(list(new))
        return [self._segmentations(row) for row in units]

    def _segmentations(self, units: list[str]) -> list[tuple[float, np.ndarray]]:
        if not units:
            return []
        numbers = np.fromiter(map(self.number.__getitem__, units), dtype=np.int64, count=len(units))
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        places = np.concatenate(([0], np.cumsum(sizes)))
        best = self.ids[np.repeat(starts - places[:-1], sizes) + np.arange(places[-1])]
        total = float(self.scores[numbers].sum())
        # Only the units whose second best loses least can differ from their best in one of the n_best.
        loss, few = self.losses[numbers], min(self.n_best - 1, len(units))
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        for at in (np.argsort(loss)[:few] if len(loss) <= 8 * few else np.argpartition(loss, few)[:few]).tolist():
            found = self._others(units[at])
            top = found[0][0]
            choices = nsmallest(self.n_best, [
                (lost + top - score, (*picked, (at, ids)) if k else picked)
                for lost, picked in choices for k, (score, ids) in enumerate(found)], key=itemgetter(0))
        out = []
        for lost, picked in choices:
            parts, after = [], 0
            for at, ids in sorted(picked):
                parts += [best[after:places[at]], np.array(ids, dtype=np.int32)]
                after = places[at + 1]
            out.append((total - lost, np.concatenate([*parts, best[after:]]) if parts else best))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, list[float]]:
        """Ids of the best segmentation, and the scores of the n_best ones."""
        found = self.encode_all([text])[0]
        return found[0][1] if found else np.empty(0, dtype=np.int32), [score for score, _ in found]

    def encode_paths(self, text: str) -> list[tuple[float, list[int]]]:
        """The n_best segmentations of a whole text with their ids."""
        if not text:
            return []
        paths: list[tuple[float, list[int]]] = [(0.0, [])]
        for unit in self.units.findall(" " + text.replace(SPACE, " ")):
            found = self.search(unit.replace(" ", SPACE))
            paths = nlargest(self.n_best, ((a + b, ids + list(more)) for a, ids in paths for b, more in found),
                                   key=itemgetter(0))
        return paths


class Decoder:
    """Texts of ids: the bytes of the pieces put together, marks as spaces, without the leading one."""

    def __init__(self, vocabulary: Vocabulary):
        table = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
        for value, i in enumerate(vocabulary.byte_ids):
            table[i] = bytes([value])
        self.table = pa.array(table, pa.large_binary())

    def raw(self, ids: pa.Array, ends: np.ndarray) -> list[bytes]:
        """The bytes of several lists laid end to end, without the leading one of each; `ends` has 0 and their ends."""
        if not len(ids):
            return [b""] * (len(ends) - 1)
        taken = self.table.take(ids)
        at = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(ids) + 1)[ends].tolist()
        data = memoryview(taken.buffers()[2])
        return [bytes(data[a + 1:b]) for a, b in zip(at, at[1:])]

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        return self.raw(pa.array(ids, pa.int32()), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text of one list of ids."""
    return Decoder(vocabulary).decode(ids)


FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("nbest_scores", T.ArrayType(T.DoubleType())),
          T.StructField("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType()))),
          T.StructField("round_trip", T.BooleanType())]
#: The segmenter of the table that this worker works for: its tasks share what they learn, other tables begin anew.
_KEPT: dict[str, Segmenter] = {}


def _segmenter(table: str, vocabulary: Vocabulary, n_best: int) -> Segmenter:
    if table not in _KEPT:
        _KEPT.clear()
        _KEPT[table] = Segmenter(vocabulary, n_best)
    return _KEPT[table]


def encode(df: DataFrame, text: str = "text", model: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """df with ids, nbest_scores, nbest_ids, and round_trip: whether decoding each segmentation gives the text again.

    The n_best segmentations come best first, the first one is ids as well. Null and empty texts have no ids and no
    scores. A text that holds the space mark itself decodes to a space there. df must not have columns of these names.
    """
    if clash := {f.name for f in FIELDS} & set(df.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    shared, table = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, decoder = _segmenter(table, shared.value, n_best), Decoder(shared.value)
        ends = lambda sizes: np.cumsum([0, *sizes], dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                coded = segmenter.encode_all(texts)
                rows = [ids for found in coded for _, ids in found]
                inner, outer = ends(map(len, rows)), ends(map(len, coded))
                flat = pa.array(np.concatenate([np.empty(0, dtype=np.int32), *rows]))
                spelt = decoder.raw(flat, inner)
                same = [all(s == t for s in spelt[a:b]) for t, a, b in zip(
                    (t.encode("utf-8", "surrogatepass") for t in texts), outer, outer[1:])]
                best = [found[0][1] if found else np.empty(0, dtype=np.int32) for found in coded]
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.ListArray.from_arrays(ends(map(len, best)), np.concatenate(best)),
                    pa.ListArray.from_arrays(outer, pa.array([x for found in coded for x, _ in found], pa.float64())),
                    pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, flat)), pa.array(same)],
                    names=[*part.schema.names, *(f.name for f in FIELDS)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *FIELDS]))


def decoded(df: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the texts of a column of ids; null where the ids are null."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in
                     batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))
