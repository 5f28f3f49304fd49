"""Exact, word-window and byte-string dedup against brute force."""
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terralith.llm.exact_dedup import drop_duplicates, exact_groups, identities
from terralith.llm.substring_dedup import remove_repeated_windows
from terralith.llm.suffix_dedup import collection_suffixes, remove_repeated_bytes
import terralith.llm.suffix_dedup as suffix_dedup

EXTRA = "doc_id long, text string, place string, name int, runs int, content string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def with_extras(spark, rows):
    return spark.createDataFrame([(d, t, "p", 1, None, "c") for d, t in rows], EXTRA)


def texts(seed, n=60, alphabet="abc", words=False):
    rng, out = random.Random(seed), []
    shared = "".join(rng.choice(alphabet) for _ in range(300))
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            out.append(rng.choice(out))
        elif out and kind < 0.5:
            t = list(rng.choice(out)) or ["x"]
            t[rng.randrange(len(t))] = "Z"
            out.append("".join(t))
        else:
            t = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 30, 120, 400])))
            a = rng.randrange(200)
            out.append(t + shared[a:a + rng.randrange(100)] + t[:rng.randrange(60)] if kind < 0.8 else t)
    return [" ".join(t) if words else t for t in out]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.xxhash64(c) % 2])
def test_identities_are_equal_exactly_for_equal_texts(spark, hashed):
    rows = list(enumerate(["", None, "a", "A", "É", "é", "ab" * 50, "ab" * 50 + "c", "x" * 7, "X" * 7, "x" * 8, "𝒳y" * 9,
                           "𝒳Y" * 9, *(t for t in texts(3, 40))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = identities(df, block_chars=7, keep=("doc_id",), block_hash=hashed).collect()
    name = {r.doc_id: (r.n_blocks, r.name) for r in got}
    assert len(got) == len(rows) and len(name) == len(rows)
    for d, t in rows:
        for e, u in rows:
            assert (name[d] == name[e]) == (low(t) == low(u))


def test_exact_groups_and_edge_cases(spark):
    rows = [(5, "Aa"), (9, "aa"), (9, "aa"), (1, None), (2, ""), (None, "aa"), (None, "q"), (3, "b" * 50_000),
            (4, "B" * 50_000), (7, "É"), (8, "é")]
    df = with_extras(spark, rows)
    got = exact_groups(df)
    table = sorted(((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got.collect()), key=repr)
    assert table == sorted([(5, 9, 4, False), (9, 9, 4, True), (9, 9, 4, False), (1, 2, 2, False), (2, 2, 2, True),
                            (-1, 9, 4, False), (-1, -1, 1, True), (3, 4, 2, False), (4, 4, 2, True), (7, 7, 1, True),
                            (8, 8, 1, True)], key=repr)
    assert {r.text_sha256 for r in got.where("doc_id = 5").collect()} == {hashlib.sha256(b"aa").hexdigest()}
    kept = drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 4, 7, 8, 9]
    empty = with_extras(spark, [])
    assert exact_groups(empty).count() == 0 and drop_duplicates(empty).count() == 0


def cut(tokens_of, rows, size):
    where = Counter(tuple(t[i:i + size]) for _, t in rows for i in range(len(t) - size + 1))
    out = []
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if where[tuple(t[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((d, t, gone))
    return out


def spans(gone):
    return sum(g and not p for g, p in zip(gone, [False, *gone]))


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows_match_brute_force(spark, seed):
    rows = list(enumerate(texts(seed, 50, "abcdefgh", words=True)))
    rows += [(100, None), (101, ""), (102, " \t"), (103, "a\x0bb\x1cc " * 40), (104, "a\x0bb\x1cc " * 3), (105, "É é " * 900)]
    want = {d: (len(t), sum(g), hashlib.sha256(" ".join(w for w, x in zip(t, g) if not x).encode()).hexdigest(),
                spans(g)) for d, t, g in cut(None, [(d, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t in rows], 35)}
    got = remove_repeated_windows(with_extras(spark, rows).repartition(3)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, len(r.span_start)) for r in got} == want
    assert any(w[1] for w in want.values())


@pytest.mark.parametrize("limit", [2048, 2])
def test_byte_strings_match_brute_force(spark, limit):
    rows = list(enumerate(texts(5, 50, "ab")))
    rows += [(100, None), (101, ""), (102, "é" * 300), (103, "xé" * 200), (104, "y" * 5000)]
    want = {d: (len(t), sum(g), spans(g), hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest())
            for d, t, g in cut(None, [(d, (t or "").encode()) for d, t in rows], 80)}
    got = remove_repeated_bytes(with_extras(spark, rows).repartition(3), size=80, group_limit=limit).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_repeated_ids_and_empty_tables(spark):
    same = "one two three four five six seven " * 6
    df = with_extras(spark, [(1, same), (1, same), (None, "alone"), (2, None)])
    got = remove_repeated_windows(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 1, 0), (1, 42, 42), (1, 42, 42), (2, 0, 0)]
    got = remove_repeated_bytes(df, size=40).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 204), (1, 204), (2, 0)]
    empty = with_extras(spark, [])
    assert remove_repeated_windows(empty).count() == 0 and remove_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("width", [8, 16, 40])
def test_collection_suffixes_are_sorted_with_common_prefixes_and_bwt(monkeypatch, width):
    monkeypatch.setattr(suffix_dedup, "SYMBOL_BYTES", width)
    rng = random.Random(width)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    strings = [base[a:a + rng.randrange(1, 150)] for a in (rng.randrange(250) for _ in range(8))]
    number, start, common, bwt = collection_suffixes(strings)
    suffix = [[strings[n][p + width * t:p + width * (t + 1)] for t in range((len(strings[n]) - p) // width)]
              for n, p in zip(number, start)]
    for k in range(1, len(suffix)):
        assert suffix[k - 1] <= suffix[k]
        both = 0
        while both < min(len(suffix[k - 1]), len(suffix[k])) and suffix[k - 1][both] == suffix[k][both]:
            both += 1
        assert both == common[k]
    named = {}
    for n, p, b in zip(number, start, bwt):
        before = strings[n][p - width:p] if p >= width else None
        assert (b == -1) == (before is None)
        if before is not None:
            assert named.setdefault(before, b) == b
