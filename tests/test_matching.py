"""Candidate joins and scores against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import similarity as sim
from terralith.operators import matching


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial(a, b):
    def one(s, t):
        m, n = len(s), len(t)
        windows = [t[i:i + m] for i in range(n - m + 1)] + [t[:i] for i in range(1, m)] + [t[n - i:] for i in range(1, m)]
        return max(ratio(s, w) for w in windows)
    if len(a) == len(b):
        return max(one(a, b), one(b, a))
    return one(a, b) if len(a) < len(b) else one(b, a)


def ordered(name):
    return " ".join(sorted(name.lower().split()))


@pytest.fixture(scope="module")
def people():
    rng = random.Random(7)
    base = ["Prafulla Kumar Sahoo", "Sunita Pradhan", "Minati Sahu", "Om Das", "Bhagaban Nayak", "Ram", "Sarat Kumar Das"]
    rows = []
    for i in range(160):
        name = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(name))
            if rng.random() < 0.5 and len(name) > 3:
                name.pop(at)
            else:
                name.insert(at, rng.choice("abcdeiou"))
        words = "".join(name).split()
        if rng.random() < 0.2:
            words.reverse()
        if rng.random() < 0.2:
            words = words[:1]
        rows.append((i, f"LR-{i}", " ".join(words), rng.choice(["P", "Q"]), str(rng.randrange(6)), rng.choice(["", "9"])))
    return rows


@pytest.fixture(scope="module")
def records(spark, people):
    return spark.createDataFrame(people, "id long, record_id string, owner_name string, village string, khasra_no string, survey_no string").cache()


def test_scores_match_definition(people):
    names = [p[2].lower() for p in people]
    a, b = np.array(names[:80], dtype=object), np.array(names[80:], dtype=object)
    assert np.allclose(sim.indel_ratio(a, b), [ratio(x, y) for x, y in zip(a, b)])
    assert np.allclose(sim.partial_ratio(a, b), [partial(x, y) for x, y in zip(a, b)])
    long = np.array(["ab" * 50], dtype=object)
    assert sim.lcs_lengths(long, np.array(["ba" * 50], dtype=object))[0] == lcs("ab" * 50, "ba" * 50)


def test_variants_equal_brute_force(records, people):
    names = {(p[3], p[2].lower()) for p in people if p[2]}
    expected = set()
    for v, a in names:
        for w, b in names:
            if v == w and a != b:
                score = max(ratio(ordered(a), ordered(b)), 0.95 * partial(a, b))
                if 0.80 - 1e-9 <= score < 0.98 - 1e-9:
                    expected.add((v, a, b))
    got = {(r.village, r.a, r.b) for r in matching.owner_variant_scores(records).collect()}
    assert got == expected and len(expected) > 50


def test_first_three_variants(records, people):
    got = {}
    for r in matching.owner_variants(records).collect():
        got.setdefault((r.village, r.name), []).append((r["rank"], r.other_id))
    for (village, name), items in got.items():
        firsts = {}
        for p in people:
            firsts.setdefault((p[3], p[2].lower()), p[0])
        options = sorted(i for (v, other), i in firsts.items() if v == village and other != name and other
                         and 0.80 - 1e-9 <= max(ratio(ordered(name), ordered(other)), 0.95 * partial(name, other)) < 0.98 - 1e-9)
        assert [i for _, i in sorted(items)] == options[:3]


def test_duplicate_stats_equal_brute_force(records, people):
    got = {r.id: (r.dup_total, r.dup_same) for r in matching.duplicate_plot_stats(records).collect()}
    for p in people:
        others = [o for o in people if o[4] == p[4] and o[0] != p[0]]
        same = sum(ratio(ordered(p[2]), ordered(o[2])) >= 0.92 - 1e-9 for o in others)
        assert got[p[0]] == (len(others), same)


def test_scan_counts_equal_report_form(records):
    counts = {(r.id, r.type): r.n for r in matching.duplicate_scan_counts(records).collect()}
    listed = matching.duplicates_of(records, records.where("id < 20")).groupBy("subject", "type").count().collect()
    assert listed
    for r in listed:
        assert counts[int(r.subject[3:]), r.type] == r["count"]
    assert {k for k in counts if k[0] < 20} == {(int(r.subject[3:]), r.type) for r in listed}


def test_hot_village_is_not_enumerated(spark):
    """Most records share one village and one name: only distinct names are compared."""
    rows = spark.range(20_000).select(
        "id", F.concat(F.lit("LR-"), F.col("id").cast("string")).alias("record_id"), F.lit("P").alias("village"),
        F.when(F.col("id") % 1000 == 0, "Sunita Pradhan").when(F.col("id") % 1000 == 1, "Sunitta Pradhan").otherwise("Om Das").alias("owner_name"),
        F.lit("1").alias("khasra_no"), F.lit("").alias("survey_no"))
    stats = matching.duplicate_plot_stats(rows).groupBy("dup_total", "dup_same").count().collect()
    assert {(r.dup_total, r.dup_same, r["count"]) for r in stats} == {(19999, 39, 40), (19999, 19959, 19960)}
