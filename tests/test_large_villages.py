"""The names of a large village find the same variants, whatever the steps in which they ask."""
from terralith.operators import matching
from tests.test_matching import people  # noqa: F401 - a fixture

SCHEMA = "id long, record_id string, owner_name string, village string, khasra_no string, survey_no string"


def test_steps_do_not_show(spark, people, monkeypatch):  # noqa: F811
    records = spark.createDataFrame(people, SCHEMA)
    scores = matching.owner_variant_scores(records)
    names = {(r.village, r.name): r.first for r in matching._village_names(records).collect()}
    want = {}
    for r in scores.collect():
        if len(r.a) >= 4:
            want.setdefault((r.village, r.a), []).append((names[r.village, r.b].id, round(r.score, 9)))
    want = {k: sorted(v)[:3] for k, v in want.items()}
    for prefixes in ((512,), (2, 8, 20), (1,)):
        monkeypatch.setattr(matching, "PREFIXES", prefixes)
        got = {}
        for r in matching.owner_variants(records).orderBy("village", "name", "rank").collect():
            got.setdefault((r.village, r.name), []).append((r.other_id, round(r.score, 9)))
        assert got == want, prefixes


def test_a_large_village_is_not_enumerated(spark, people, monkeypatch):  # noqa: F811
    """Names that have their answers ask no further: the second step gets fewer names than the first."""
    asked, near = [], matching._near_pairs
    monkeypatch.setattr(matching, "PREFIXES", (8, 16))
    monkeypatch.setattr(matching, "_near_pairs", lambda x, y: asked.append((x.count(), y.select("village", "name").distinct().count())) or near(x, y))
    matching.owner_variants(spark.createDataFrame(people, SCHEMA))
    assert len(asked) == 2 and asked[1][0] < asked[0][0] and asked[0][1] < asked[0][0]
