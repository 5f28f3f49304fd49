import random
import re

import numpy as np
import pytest

from terralith.llm.ngram_join import Bands, drop_near_duplicates, near_groups, signatures


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, num, den):
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=160):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    line = "a shared first line that many texts begin with"
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.55:
            text = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 12, 20, 40, 90, 300])))
            text = f"{line}\n{text}" if rng.random() < 0.3 else text
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "café É"), (n + 4, "Café é")]


@pytest.mark.parametrize("size,num,den", [(3, 9, 10), (5, 8, 10)])
def test_components_match_brute_force(spark, size, num, den):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id)
               for r in near_groups(df, shingle=size, similarity=(num, den)).collect()}
        assert got == brute(rows, size, num, den)


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10), (1, 2)])
def test_similar_sets_always_share_a_signature(num, den):
    rng, bands = np.random.default_rng(3), Bands(num, den)
    for n in [2, 4, 9, 10, 11, 15, 19, 24, 31, 47, 80, 200, 700] * 6:
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        most = (n * (den - num)) // den
        drop = int(rng.integers(0, most + 1))
        other = base[drop:]
        spare = len(other) * den // num - n if num else 0
        other = np.concatenate([other, rng.integers(0, 2**63, max(0, int(spare)), dtype=np.uint64)])
        both, union = n - drop, n + len(other) - (n - drop)
        if both * den < num * union:
            other, both, union = base[drop:], n - drop, n
        assert both * den >= num * union
        a, b = np.unique(base), np.unique(other)
        if len(a) != len(b) or (a != b).any():
            assert np.intersect1d(signatures(a, bands), signatures(b, bands)).size


def test_edge_cases(spark):
    schema = "doc_id long, text string, component string, row_id int, n int"
    empty = spark.createDataFrame([], schema)
    assert near_groups(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    rows = [(1, "a b c", "x", 1, 1), (1, "a b c", "x", 1, 1), (None, "a b c", None, None, None), (2, None, "y", 2, 2),
            (3, None, "z", 3, 3), (4, "x y " * 30000, "v", 4, 4)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_groups(df).collect())
    # A null doc_id counts as smaller than any: it names the component and its row stays.
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False), (2, 0, 2, True), (3, 0, 3, True),
                   (4, 2, 4, True)]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 4
