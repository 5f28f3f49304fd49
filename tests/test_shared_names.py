"""Names that large scopes share are compared once for all of them, with the pairs of each scope as result."""
from terralith.functions.similarity import letters_of
from terralith.operators import matching

NAMES = ["asha devi", "asha devy", "aasha devi", "bina rao", "bina raao", "chitra sen", "chitra seen", "dhana nag",
         "dhana naag", "ekla das", "ekla daas", "fakira jena"]


def _pairs(df):
    return sorted((r.village, r.a, r.b, round(r.score, 9)) for r in df.collect())


def test_shared_names_are_compared_once(spark, monkeypatch):
    villages = [f"V{i}" for i in range(5)]
    names = spark.createDataFrame([(v, n) for v in villages for n in NAMES], "village string, sorted string")
    want = _pairs(matching.similar_names(names, ["village"], 0.8))
    assert want and len({w[0] for w in want}) == 5
    monkeypatch.setattr(matching, "TILE", 4)
    compared, scored = [], matching._scored
    monkeypatch.setattr(matching, "_scored", lambda pairs, low, high: compared.append(pairs.count()) or scored(pairs, low, high))
    assert _pairs(matching.similar_names(names, ["village"], 0.8)) == want
    assert sum(compared) * 2 * len(villages) < 2 * len(want)


def test_each_pair_meets_once(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 3)
    names = spark.createDataFrame([("V", n, len(NAMES)) for n in NAMES], "village string, name string, size int")
    met = matching._tiled(names, ["village"], "name", ["name"]).select("x.name", "y.name").collect()
    assert len(met) == len({frozenset(r) for r in met}) == len(NAMES) * (len(NAMES) - 1) // 2


def test_letters_of_long_and_short_texts(spark):
    short, long = "abca", "abca" * 30
    lo = {r.t: (r.s.lo, r.s.hi) for r in spark.createDataFrame([(short,), (long,)], "t string").select("t", letters_of("t").alias("s")).collect()}
    assert all(a & ~b == 0 for a, b in zip(lo[short], lo[long])) and lo[short] != lo[long]


def test_pooled_variants_equal_those_by_village(spark, monkeypatch):
    rows = [(i * 100 + k, f"LR-{i}-{k}", n, f"V{i}", "", "") for i in range(5) for k, n in enumerate(NAMES)]
    records = spark.createDataFrame(rows, "id long, record_id string, owner_name string, village string, khasra_no string, survey_no string")
    want = sorted(map(tuple, matching.owner_variants(records).collect()))
    monkeypatch.setattr(matching, "PREFIXES", (4, 8))
    monkeypatch.setattr(matching, "_near_pairs", None)   # shared names ask nothing village by village
    assert want and sorted(map(tuple, matching.owner_variants(records).collect())) == want
