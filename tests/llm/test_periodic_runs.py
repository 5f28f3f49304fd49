"""Periodic runs against a comparison of every word with every other one."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from terralith.llm import periodic_runs as pr
from terralith.llm.queries import op13_periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(words, min_length, min_exponent):
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, min_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def some_texts(rng):
    for _ in range(rng.randrange(5)):
        n, letters = rng.randrange(90), rng.choice([1, 2, 3])
        words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n and rng.random() < 0.5:
            p = rng.randrange(1, 20)
            words = [words[i % min(p, n)] for i in range(n)]
            if rng.random() < 0.5:
                words[rng.randrange(n)] = b"z"
        yield words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        length, exponent, texts = rng.choice([2, 3, 24]), rng.choice([2, 3]), list(some_texts(rng))
        for words, runs in zip(texts, pr.runs_of(texts, length, exponent)):
            assert [tuple(r) for r in runs.tolist()] == brute(words, length, exponent)


def test_portions_do_not_matter():
    """Words appended one by one, in portions, or at once give the same runs, and runs can be read in between."""
    rng = np.random.default_rng(5)
    for words in (rng.integers(0, 2, 300), np.tile(rng.integers(0, 50, 37), 9), np.zeros(257, dtype=np.int64)):
        for step in (1, 7, 64, 1000):
            catcher = pr.SquareCatcher()
            for at in range(0, len(words), step):
                catcher.append(words[at:at + step])
                if at % 5 == 0:
                    want = brute(words[:at + step].tolist(), 6, 2)
                    assert [tuple(r) for r in catcher.runs(6, 2).tolist()] == want


def test_equal_names_of_unequal_words_are_told_apart():
    """Sequences whose rolling hashes modulo 2^64 agree, although the words differ."""
    a = [0]
    for _ in range(11):
        a += [1 - x for x in a]
    words = [bytes([97 + x]) for x in a[:2500]]
    assert [tuple(r) for r in pr.runs_of([words], 2, 2)[0].tolist()] == brute(words, 2, 2)


def test_long_repeats_stay_cheap():
    assert pr.runs_of([[b"a"] * 50000, [b"a", b"b"] * 30000])[0].tolist() == [[0, 50000, 1]]
    with pytest.raises(ValueError):
        pr.SquareCatcher().runs(2, 1)


def test_operator_on_odd_rows(spark):
    texts = ["a b " * 20, None, "", " \t\n", "x y z", "a b " * 20, "q r s " * 30, "word " * 60000]
    rows = [(i if i != 4 else None, t, "r", 1.0, "w") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed double, n_words string")
    got = {r.doc_id: r for r in pr.periodic_runs(df).collect()}
    assert got[0].runs == [(0, 40, 2)] and got[0].collapsed == "a b" and got[5].collapsed == "a b"
    assert [got[i].runs for i in (1, 2, 3, None)] == [[]] * 4 and got[None].collapsed == "x y z"
    assert got[6].runs == [(0, 30, 1)] and got[6].collapsed == "q r s" and got[7].collapsed == "word"
    assert pr.periodic_runs(df.limit(0)).count() == 0
    named = df.select("text", df["doc_id"].cast("string").alias("name"))
    assert pr.periodic_runs(named, doc_id="name").columns[0] == "name"


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op13_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys() and any(r.n_runs for r in got.values())
    for doc_id, text in docs.items():
        words = WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = brute(words, 24, 3)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
