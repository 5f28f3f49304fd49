"""Long values, repeated changes, partial revalidation, late uploads."""

from pyspark.sql import functions as F

from terralith.operators import changes, matching, notifications, rules, search
from terralith.streaming import jobs
from tests.test_matching import ordered, ratio
from tests.test_rules import table


def test_names_of_any_length_in_small_and_crowded_places(spark):
    long = "Prafulla Kumar " * 33 + "Sahoo"
    names = [long, long.replace("Sahoo", "Sahu"), *(f"Person {chr(97 + i)}{chr(110 - i)} Das" for i in range(22)), "Om Das"]
    rows = [(i, f"LR-{i}", n, "Crowded", "1", "") for i, n in enumerate(names)]
    rows += [(100 + i, f"LR-{100 + i}", n, "Small", "2", "") for i, n in enumerate(names[:2])]
    records = spark.createDataFrame(
        rows, "id long, record_id string, owner_name string, village string, khasra_no string, survey_no string")
    got = {r.id: (r.dup_same, r.dup_conflict) for r in matching.duplicate_plot_stats(records).collect()}
    for i, _, name, village, _, _ in rows:
        others = [n for j, _, n, v, _, _ in rows if v == village and j != i]
        same = sum(ratio(ordered(name), ordered(n)) >= 0.92 for n in others)
        assert got[i] == (same, len(others) - same)
    found = {(r.village, r.name) for r in matching.owner_variants(records).collect()}
    assert ("Small", long.lower()) not in found or ratio(long.lower(), names[1].lower()) < 0.98


def test_limits_are_the_callers(spark):
    rows = table(spark, {f"r{i}": {} for i in range(230)}).withColumns({
        "created_at": F.current_timestamp(), "status": F.lit("pending_review"), "highest_severity": F.lit("high"),
        "discrepancy_count": F.lit(1), "record_confidence": F.lit(50.0)})
    assert search.review_queue(rows, limit=220).count() == 220
    assert search.search(rows, limit=230).count() == 230


def test_only_rules_that_run_again_are_replaced(spark):
    rows = table(spark, {"a": {"registration_no": "REG-X-99-13", "mutation_date": "not-a-date"}, "b": {}})
    found = rules.run_rules(rows, ["BR-4", "BR-10"])
    changed = rows.where("record_id = 'LR-a'").withColumn("mutation_date", F.lit("04/01/2020"))
    after = changes.revalidate(rows, changed, found, rules.Context(), ["BR-4"])
    assert [(r.record_id, r.rule_id) for r in after.collect()] == [("LR-a", "BR-10")]
    assert changes.revalidate(rows, changed, found, rules.Context(), ["BR-10"]).count() == found.count()


def test_one_change_per_key(spark):
    rows = table(spark, {"a": {}, "b": {}}).withColumn("status", F.lit("pending_review"))
    found = rules.run_rules(rows, ["BR-10"])
    twice = spark.createDataFrame([("LR-a", "approve", "x", 1), ("LR-a", "reject", "y", 2)],
                                  "record_id string, decision string, comment string, seq int")
    out = changes.decide(rows, found, twice, F.current_timestamp())
    assert {r.record_id: r.status for r in out["records"].collect()} == {"LR-a": "rejected", "LR-b": "pending_review"}
    assert out["records"].count() == 2
    fixes = spark.createDataFrame([("LR-a", "village", "One", 2), ("LR-a", "village", "Two", 1)],
                                  "record_id string, field_name string, new_value string, seq int")
    assert changes.latest(fixes, "record_id", "field_name").first().new_value == "One"
    assert changes.latest(fixes.drop("seq"), "record_id", "field_name").first().new_value == "Two"


def test_matrix_has_the_rules_that_ran(spark):
    rows = table(spark, {"a": {"registration_no": "REG-X-99-13"}})
    got = rules.rule_matrix(rows, rules.run_rules(rows, ["BR-4", "BR-10"]), ["BR-4", "BR-10"]).collect()
    assert {(r.rule_id, r.passed) for r in got} == {("BR-4", True), ("BR-10", False)}


def test_counts_of_notifications(spark):
    users = spark.createDataFrame([(1, "reviewer"), (2, "reviewer"), (3, "admin")], "id long, role string")
    events = spark.createDataFrame([("t", "m", "reviewer", None), ("t", "m", "reviewer", None), ("t", "m", None, 3),
                                    ("t", "m", "nobody", None)], "title string, message string, role string, user_id long"
                                   ).withColumns({"level": F.lit("high"), "link": F.lit("#")})
    sent = {r.user_id: r.n for r in notifications.fan_out(events, users).groupBy("user_id").agg(
        F.count("*").alias("n")).collect()}
    assert {r.user_id: r.unread for r in notifications.fan_out_counts(events, users).collect()} == sent == {1: 2, 2: 2, 3: 1}


def test_no_upload_is_lost(spark, tmp_path):
    source, store, skipped = (str(tmp_path / n) for n in ("in", "store", "skipped"))
    schema = "doc_id string, seq int, file_hash string, status string, record_status string, created_at timestamp"

    def batch(*rows):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn(
            "created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp"),
                    skipped=skipped).awaitTermination()

    batch(("a", 1, "h1", "completed", "approved", "2024-03-01"), ("f", 2, "h9", "failed", None, "2024-03-01"))
    batch(("b", 3, "h2", "completed", "approved", "2024-03-20"), ("c", 4, "h1", "completed", "approved", "2024-03-20"))
    batch(("late", 5, "h3", "completed", "approved", "2023-01-01"), ("again", 6, "h9", "completed", "approved", "2024-03-02"),
          ("d", 7, "h3", "completed", "approved", "2024-03-21"))
    assert {r.doc_id for r in spark.read.parquet(store).collect()} == {"a", "f", "b", "late", "again"}
    assert {(r.doc_id, r.existing_doc_id) for r in spark.read.parquet(skipped).collect()} == {("c", "a"), ("d", "late")}
