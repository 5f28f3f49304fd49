"""Fire / do-not-fire cases of the ten rules, all variants of one valid record in one run."""

import pytest
from pyspark.sql import functions as F

from terralith.operators import parcels, rules
from terralith.sources.cadastral import sample_layer

BASE = dict(
    owner_name="Prafulla Kumar Sahoo", khasra_no="118/2", khata_no="204", survey_no="", plot_no="",
    village="Balarampur", tehsil="Khordha Sadar", district="Khordha", area_raw="1.14 acre", area_hectare=0.461342,
    land_classification="Irrigated land", mutation_date="04/01/2020", registration_no="1234 of 2019",
    previous_owner="", new_owner="", document_type_label="record_of_rights", parent_khasra_no="", status="pending_review")
CASES = {
    "base": {}, "no_owner": {"owner_name": ""}, "no_class": {"land_classification": ""},
    "bad_date": {"mutation_date": "not-a-date"}, "future": {"mutation_date": "01/01/2999"},
    "order": {"mutation_date": "04/01/2018"}, "short_year": {"mutation_date": "4-1-98", "registration_no": ""},
    "self_mutation": {"previous_owner": "A Das", "new_owner": "Totally Different Person"},
    "unknown_unit": {"area_raw": "5 smoots"}, "no_unit": {"area_raw": "5"}, "huge": {"area_raw": "500 hectare"},
    "no_village": {"village": "Janakpur"}, "wrong_tehsil": {"tehsil": "Jankia"},
    "indic": {"village": "बलरामपुर", "tehsil": "खुर्दा सदर", "district": "खुर्दा"},
    "last_wins": {"village": "Golabai", "tehsil": "Nirakarpur"}, "puri": {"district": "Puri"},
    "bbsr": {"registration_no": "BBSR-2311-2019"}, "blank_reg": {"registration_no": ""},
    "bad_reg": {"registration_no": "REG-X-99-13"}, "slash_reg": {"registration_no": "876/2019"},
}


def table(spark, rows):
    names = ["id", "record_id", *BASE]
    data = [(i, f"LR-{key}", *[{**BASE, **change}[c] for c in BASE]) for i, (key, change) in enumerate(rows.items())]
    kinds = {"area_hectare": "double"}
    return spark.createDataFrame(data, ", ".join(f"{n} {'long' if n == 'id' else kinds.get(n, 'string')}" for n in names))


@pytest.fixture(scope="module")
def local(spark):
    found = rules.run_rules(table(spark, CASES), [*rules.LOCAL_RULES, "BR-5"], rules.Context(as_of="2024-01-01"))
    out = {}
    for r in found.collect():
        out.setdefault((r.record_id[3:], r.rule_id), []).append((r.severity, r.message))
    return out


@pytest.mark.parametrize("case,rule,severities", [
    ("base", "BR-1", []), ("base", "BR-4", []), ("base", "BR-6", []), ("base", "BR-7", []), ("base", "BR-10", []),
    ("no_owner", "BR-1", ["critical"]), ("no_class", "BR-1", ["high"]),
    ("bad_date", "BR-4", ["high"]), ("future", "BR-4", ["high"]), ("order", "BR-4", ["high"]), ("short_year", "BR-4", []),
    ("self_mutation", "BR-5", ["high", "medium"]), ("unknown_unit", "BR-6", ["medium"]), ("no_unit", "BR-6", ["medium"]),
    ("huge", "BR-6", ["low"]), ("no_village", "BR-7", ["medium"]), ("wrong_tehsil", "BR-7", ["medium"]),
    ("indic", "BR-7", []), ("last_wins", "BR-7", ["medium"]), ("puri", "BR-7", ["low"]),
    ("bbsr", "BR-10", []), ("blank_reg", "BR-10", []), ("bad_reg", "BR-10", ["medium"]), ("slash_reg", "BR-10", ["medium"]),
])
def test_row_rules(local, case, rule, severities):
    assert sorted(s for s, _ in local.get((case, rule), [])) == severities


def test_messages(local):
    assert "belongs to tehsil 'Khordha Sadar'" in local["wrong_tehsil", "BR-7"][0][1]
    assert local["bad_date", "BR-4"][0][1] == "Mutation date 'not-a-date' is not a parseable date."


def test_sub_plots(spark):
    rows = table(spark, {"off": {"area_hectare": 1.0}, "fits": {"area_hectare": 0.4856}, "zero": {"area_hectare": 0.0}})
    subs = spark.createDataFrame([(f"LR-{k}", a) for k in ("off", "fits", "zero") for a in (0.2428, 0.2428)],
                                 "record_id string, area_hectare double")
    found = rules.run_rules(rows, ["BR-2"], rules.Context(sub_plots=subs)).collect()
    assert [(r.record_id, r.severity) for r in found] == [("LR-off", "high")]


def test_children_and_duplicates(spark):
    rows = table(spark, {
        "parent": {"khasra_no": "340", "area_hectare": 1.0, "village": "Jankia"},
        "child": {"khasra_no": "340/1", "parent_khasra_no": "340", "area_hectare": 0.5, "owner_name": "Someone Else"},
        "gone": {"khasra_no": "340/2", "parent_khasra_no": "340", "area_hectare": 9.0, "status": "rejected"},
        "a": {"khasra_no": "7"}, "b": {"khasra_no": "7"}, "c": {"khasra_no": "7", "owner_name": "Bhagaban Nayak"},
        "alone": {"khasra_no": "999/9", "owner_name": "X Y"}, "d": {"khasra_no": "7", "owner_name": "Prafula Kumar Sahoo"}})
    found = rules.run_rules(rows, ["BR-2", "BR-3"]).collect()
    got = {(r.record_id[3:], r.rule_id, r.severity): r.occurrences for r in found}
    assert got[("parent", "BR-2", "high")] == 1
    assert got[("a", "BR-3", "medium")] == 2 and got[("a", "BR-3", "critical")] == 1
    assert got[("c", "BR-3", "critical")] == 3 and ("c", "BR-3", "medium") not in got
    assert not any(k[0] == "alone" for k in got)
    top = {r.record_id[3:]: (r.discrepancy_count, r.highest_severity) for r in rules.rollup(
        rules.run_rules(rows, ["BR-3"])).collect()}
    assert top["a"] == (3, "critical")


def test_candidates_against_stored(spark):
    stored = table(spark, {"s1": {}, "s2": {"owner_name": "Someone Else"}})
    new = table(spark, {"x": {}}).withColumn("id", F.lit(100).cast("long"))
    found = rules.run_rules(new, ["BR-3"], rules.Context(stored=stored)).collect()
    assert {(r.record_id, r.severity, r.occurrences) for r in found} == {("LR-x", "medium", 1), ("LR-x", "critical", 1)}


def test_parcels(spark):
    rows = table(spark, {"ok": {}, "none": {"khasra_no": "000/0"}, "far": {"area_hectare": 0.10},
                         "survey": {"khasra_no": "", "survey_no": "340", "area_hectare": 1.2141}})
    layer = sample_layer(spark)
    links = {r.record_id[3:]: r for r in parcels.link_records(rows, layer).collect()}
    assert links["ok"].match_type == "khasra_no" and abs(links["ok"].area_delta_pct) < 15
    assert links["none"].match_type == "none" and not links["none"].gis_linked
    assert links["far"].spatial_mismatch and links["survey"].plot_key == "JNK-340"
    found = rules.run_rules(rows, ["BR-9"], rules.Context(cadastral=layer)).collect()
    assert [(r.record_id, r.severity) for r in found] == [("LR-far", "high")]
    areas = parcels.measure(layer).collect()
    assert all(abs(r.polygon_area_ha - r.area_ha) / r.area_ha < 0.05 for r in areas)
    near = parcels.neighbours(layer, targets=spark.createDataFrame([("BLR-118-2",)], "plot_key string")).collect()
    assert near and all(r.distance_m <= 400 and r.neighbour != "BLR-118-2" for r in near)
