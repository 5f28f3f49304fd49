"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith import vocab
from terralith.functions import text
from terralith.operators import (assembly, audit, chains, changes, checks, extraction, form39a, layout, matching, metrics,
                                 notifications, parcels, revalidation, rules, search)
from terralith.plans import streams
from terralith.sources import derived as d
from terralith.sources import documents as docs
from terralith.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CTX = rules.Context(as_of=d.AS_OF[:10])
AUDIT_SEGMENT = 100
#: Rules behind queue, matrix, rollups, decisions and alerts: all ten.
RULES_RUN = list(rules.REGISTRY)
DOC_AS_OF = "2024-01-31 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _findings(spark, sf, rule_ids, **tables) -> DataFrame:
    return rules.run_rules(d.records(spark, sf), rule_ids, rules.Context(as_of=CTX.as_of, **tables))


def _found(spark, sf) -> DataFrame:
    """Stored findings of RULES_RUN, which every consumer reads."""
    return d.stored(spark, sf, "findings", lambda: _findings(
        spark, sf, RULES_RUN, sub_plots=d.sub_plots(spark, sf), cadastral=d.cadastral(spark, sf), brief=True))


def _brief(found: DataFrame) -> DataFrame:
    return found.select("id", "rule_id", "severity", "expected", "actual", "message", "occurrences")


# ------------------------------------------------------------------ queue and search
@query
def review_queue(spark, sf):
    """Rules, rollup and the reviewers' queue."""
    records = d.records(spark, sf)
    out = search.review_queue(rules.with_rollup(records, _found(spark, sf)), limit=200)
    return out.select("record_id", "khasra_no", "village", "discrepancy_count", "highest_severity", "record_confidence", "priority")


@query
def record_search(spark, sf):
    return search.search(d.records(spark, sf), q="sahoo", limit=500).select("record_id", "owner_name", "village", "created_at")


@query
def search_filters(spark, sf):
    return search.search(d.records(spark, sf), status="pending_review", low_confidence_only=True, limit=None,
                         village="mouza", khata_no="1").select("record_id", "village", "khata_no", "record_confidence")


@query
def search_by_rule(spark, sf):
    return search.search(d.records(spark, sf), findings=_findings(spark, sf, ["BR-10"]), rule_id="BR-10", limit=500).select(
        "record_id", "registration_no")


@query
def confidence_bands(spark, sf):
    fields = d.extractions(spark, sf)
    return (fields.groupBy("field_name", search.confidence_band(F.col("confidence")).alias("band"))
            .agg(F.count("*").alias("n"),
                 F.count_if(search.low_confidence_flag(F.col("value"), F.col("confidence"))).alias("low_confidence")))


@query
def document_list(spark, sf):
    return search.document_list(d.documents(spark, sf), status="completed", limit=200).select("doc_id", "batch_id", "created_at")


@query
def audit_trail(spark, sf):
    return search.audit_trail(d.audit_entries(spark, sf), action="error", actor="USER1", limit=1000).select(
        "id", "actor_label", "created_at")


@query
def batch_listing(spark, sf):
    return docs.batches(d.documents(spark, sf))


# ------------------------------------------------------------------ documents
@query
def file_dedup(spark, sf):
    """Uploads against a stored set: half of the documents are stored, all of them are uploaded."""
    uploads = d.documents(spark, sf)
    stored = uploads.where("doc_id % 2 = 0")
    fresh, skipped = docs.deduplicate(uploads.select("doc_id", "seq", "file_hash"), stored)
    return (fresh.select("doc_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("long").alias("existing_doc_id"))
            .unionByName(skipped.select("doc_id", F.lit("skipped").alias("outcome"), "existing_doc_id")))


@query
def page_lines(spark, sf):
    return docs.page_lines(d.text_pages(spark, sf)).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").cast("long").alias("last_line"))


@query
def script_tags(spark, sf):
    return (d.text_words(spark, sf).groupBy(text.script_of(F.col("text")).alias("script"))
            .agg(F.count("*").alias("words"), F.countDistinct("doc_id").alias("documents")))


@query
def word_stats(spark, sf):
    return metrics.word_stats(d.text_words(spark, sf), "doc_id")


@query
def union_box(spark, sf):
    return metrics.union_box(d.text_words(spark, sf), "doc_id")


@query
def classify_docs(spark, sf):
    return extraction.classify_documents(d.text_pages(spark, sf)).groupBy("document_type_label", "score").agg(
        F.count("*").alias("documents"))


@query
def second_pass_lines(spark, sf):
    """Lines of a second reading (the lower-case text) that the first lacks are appended."""
    first = d.text_pages(spark, sf)
    second = first.withColumn("text", F.lower("text"))
    merged = docs.merge_second_pass(first, second)
    return merged.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"))


@query
def best_reading(spark, sf):
    readings = d.text_words(spark, sf).groupBy("doc_id", (F.col("seq") % 3).alias("candidate")).agg(
        F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return docs.best_reading(readings, "doc_id")


@query
def layout_counts(spark, sf):
    return layout.layout_counts(d.boxes(spark, sf))


@query
def box_containment(spark, sf):
    return layout.drop_text_in_tables(d.boxes(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ rules
@query
def br1_mandatory(spark, sf):
    return _brief(_findings(spark, sf, ["BR-1"]))


@query
def br2_sub_plots(spark, sf):
    values = F.col("conflicting_values")
    return _findings(spark, sf, ["BR-2"], sub_plots=d.sub_plots(spark, sf)).select(
        "id", "rule_id", "severity", values["parent_area_ha"].cast("double").alias("parent_area_ha"),
        values["difference_ha"].cast("double").alias("difference_ha"),
        F.coalesce(values["child_records"], values["sub_plots"]).cast("long").alias("children"))


@query
def br3_duplicates(spark, sf):
    return _findings(spark, sf, ["BR-3"]).select(
        "id", "rule_id", "severity", "occurrences", F.col("conflicting_values")["identifier"].alias("identifier"))


@query
def br4_chronology(spark, sf):
    return _brief(_findings(spark, sf, ["BR-4"]))


@query
def br5_chain(spark, sf):
    return _findings(spark, sf, ["BR-5"]).select("id", "rule_id", "severity", "expected", "actual", "occurrences")


@query
def br6_units(spark, sf):
    return _brief(_findings(spark, sf, ["BR-6"]))


@query
def br7_admin(spark, sf):
    return _brief(_findings(spark, sf, ["BR-7"]))


@query
def br8_variants(spark, sf):
    values = F.col("conflicting_values")
    return _findings(spark, sf, ["BR-8"]).select(
        "id", "rule_id", "severity", values["other_record"].alias("other_record"),
        values["similarity"].cast("double").alias("similarity"))


@query
def br9_boundary(spark, sf):
    return _findings(spark, sf, ["BR-9"], cadastral=d.cadastral(spark, sf)).select(
        "id", "rule_id", "severity", F.col("conflicting_values")["plot_key"].alias("plot_key"),
        F.col("conflicting_values")["delta_pct"].cast("double").alias("delta_pct"))


@query
def br10_registration(spark, sf):
    return _brief(_findings(spark, sf, ["BR-10"]))


@query
def rule_matrix(spark, sf):
    matrix = rules.rule_matrix(d.records(spark, sf), _found(spark, sf), RULES_RUN)
    return matrix.groupBy("rule_id", "passed").agg(F.count("*").alias("records"), F.sum("findings").alias("findings"))


@query
def all_rules(spark, sf):
    """All ten rules over all records, counted by rule and severity."""
    found = _findings(spark, sf, None, sub_plots=d.sub_plots(spark, sf), cadastral=d.cadastral(spark, sf), brief=True)
    return metrics.rule_severity(found)


@query
def rule_outcomes(spark, sf):
    """All ten rules on records of which some have an area that is no number: findings, passes and errors by rule."""
    bad = F.when(F.col("id") % 101 == 0, F.lit("NaN").cast("double")).otherwise(F.col("area_hectare"))
    records = d.stored(spark, sf, "records-with-faults", lambda: d.records(spark, sf).withColumn("area_hectare", bad))
    outcome = d.stored(spark, sf, "outcomes", lambda: rules.judged(records, RULES_RUN, rules.Context(
        as_of=CTX.as_of, brief=True, sub_plots=d.sub_plots(spark, sf), cadastral=d.cadastral(spark, sf))))
    matrix = rules.rule_matrix(records, rules.findings_of(outcome), RULES_RUN, rules.rule_errors(outcome))
    return matrix.groupBy("rule_id", "passed", "detail").agg(F.count("*").alias("records"), F.sum("findings").alias("findings"))


@query
def evidence(spark, sf):
    found = _findings(spark, sf, RULES_RUN, sub_plots=d.sub_plots(spark, sf), cadastral=d.cadastral(spark, sf))
    found = rules.attach_evidence(found.select("id", "record_id", "rule_id", "severity", "evidence_fields"), d.extractions(spark, sf))
    return found.select("id", "rule_id", "severity", F.explode_outer("evidence_refs").alias("field_name", "ref")).groupBy(
        "rule_id", "field_name").agg(F.count("*").alias("n"), F.round(F.sum("ref.confidence"), 2).alias("confidence"))


@query
def finding_rollup(spark, sf):
    return rules.rollup(_found(spark, sf))


@query
def duplicate_scan(spark, sf):
    return matching.duplicate_scan_counts(d.records(spark, sf))


@query
def mutation_chain(spark, sf):
    return chains.mutation_chain(d.records(spark, sf))


@query
def chain_gap(spark, sf):
    return chains.chain_gaps(d.records(spark, sf))


@query
def sub_plot_sum(spark, sf):
    return rules.sub_plot_sums(d.sub_plots(spark, sf))


@query
def child_sum(spark, sf):
    sums = rules.child_sums(d.records(spark, sf))
    return sums.select("khasra_no", text.half_up(F.col("child_sum"), 4).alias("child_sum"), "child_count")


@query
def parent_area(spark, sf):
    return chains.parent_areas(d.records(spark, sf))


# ------------------------------------------------------------------ parcels
@query
def parcel_link(spark, sf):
    return parcels.link_records(d.records(spark, sf), d.cadastral(spark, sf)).select(
        "record_id", "match_type", "plot_key", "area_delta_pct", "spatial_mismatch")


@query
def parcel_area(spark, sf):
    return parcels.measure(d.cadastral(spark, sf)).select(
        "plot_key", text.half_up(F.col("polygon_area_ha"), 4).alias("polygon_area_ha"), text.half_up(F.col("centroid.lon"), 5).alias("lon"),
        text.half_up(F.col("centroid.lat"), 5).alias("lat"))


@query
def parcel_neighbours(spark, sf):
    return parcels.neighbours(d.cadastral(spark, sf)).select("plot_key", "neighbour", "distance_m")


@query
def map_summary(spark, sf):
    return parcels.layer_summary(d.cadastral(spark, sf), d.records(spark, sf))


# ------------------------------------------------------------------ external registers
@query
def ledger_check(spark, sf):
    return checks.ledger_check(d.records(spark, sf), d.ledger(spark, sf)).drop("detail")


@query
def map_check(spark, sf):
    return checks.map_check(d.records(spark, sf), d.cadastral(spark, sf))


@query
def deed_check(spark, sf):
    return checks.deed_check(d.records(spark, sf), d.deeds(spark, sf)).drop("detail")


@query
def admin_check(spark, sf):
    return checks.admin_check(d.records(spark, sf))


def _checks(spark, sf):
    return checks.all_checks(d.records(spark, sf), d.ledger(spark, sf), d.cadastral(spark, sf), d.deeds(spark, sf))


@query
def cross_checks(spark, sf):
    return _checks(spark, sf).groupBy("source_system", "match_status", "severity").agg(F.count("*").alias("n"))


@query
def cross_status(spark, sf):
    return checks.check_status(_checks(spark, sf))


# ------------------------------------------------------------------ metrics
@query
def mis_snapshot(spark, sf):
    records, found = d.records(spark, sf), _found(spark, sf)
    linked = parcels.link_records(rules.with_rollup(records, found), d.cadastral(spark, sf))
    return metrics.snapshot(linked, d.documents(spark, sf), found, d.corrections(spark, sf), d.audit_entries(spark, sf),
                            as_of=DOC_AS_OF)


@query
def rule_severity(spark, sf):
    return metrics.rule_severity(_found(spark, sf))


@query
def district_rollup(spark, sf):
    return metrics.area_rollup(d.records(spark, sf))


@query
def tehsil_counts(spark, sf):
    return metrics.count_by(d.records(spark, sf), "tehsil")


@query
def record_status_counts(spark, sf):
    return metrics.status_counts(d.records(spark, sf))


@query
def workload(spark, sf):
    return metrics.reviewer_workload(d.records(spark, sf))


@query
def daily_throughput(spark, sf):
    return metrics.daily_throughput(d.documents(spark, sf), DOC_AS_OF)


@query
def pending_alerts(spark, sf):
    return metrics.pending_alerts(d.records(spark, sf), d.AS_OF)


@query
def headline(spark, sf):
    return metrics.headline(documents=d.documents(spark, sf), records=d.records(spark, sf), audit=d.audit_entries(spark, sf))


# ------------------------------------------------------------------ audit
def _log(spark, sf):
    return d.stored(spark, sf, "audit-log", lambda: audit.append_segments(d.audit_entries(spark, sf), AUDIT_SEGMENT))


def _heads(spark, sf):
    return d.stored(spark, sf, "audit-heads", lambda: audit.seal(_log(spark, sf), AUDIT_SEGMENT))


@query
def audit_verify(spark, sf):
    """The log as it was written: both levels of chains hold."""
    return audit.verify_sealed(_log(spark, sf), _heads(spark, sf), AUDIT_SEGMENT)


@query
def audit_tampered(spark, sf):
    """Every 97th entry was altered after the fact: which rows no longer fit?"""
    altered = _log(spark, sf).withColumn("new_value", F.when(F.col("id") % 97 == 0, "changed").otherwise(F.col("new_value")))
    bad = audit.broken_links(altered, AUDIT_SEGMENT).where("not link_ok or not hash_ok")
    return bad.select("id", "link_ok", "hash_ok")


def _damaged(spark, sf):
    """A log that lost whole segments and tails of segments, with entries exchanged and entries edited."""
    part, place = F.floor(F.col("id") / AUDIT_SEGMENT) % 7, F.col("id") % AUDIT_SEGMENT
    log = _log(spark, sf).where(~((part == 3) | ((part == 5) & (place >= AUDIT_SEGMENT - 10))))
    swapped = F.when((part == 1) & (place == 20), F.col("id") + 1).when((part == 1) & (place == 21), F.col("id") - 1)
    edited = F.when((part == 2) & (place == 30), "changed").otherwise(F.col("new_value"))
    return log.withColumns({"id": F.coalesce(swapped, F.col("id")), "new_value": edited})


@query
def audit_deleted(spark, sf):
    """Segments of the damaged log that no longer fit, with what is wrong in each."""
    report = audit.segment_report(_damaged(spark, sf), _heads(spark, sf), AUDIT_SEGMENT)
    return report.where("first_broken IS NOT NULL OR NOT head_ok OR NOT link_ok")


@query
def audit_damage(spark, sf):
    """The damaged log in one row."""
    return audit.verify_sealed(_damaged(spark, sf), _heads(spark, sf), AUDIT_SEGMENT)


@query
def audit_heads(spark, sf):
    """Sealed heads of the segments, with their links."""
    return _heads(spark, sf)


@query
def audit_stats(spark, sf):
    return metrics.audit_stats(d.audit_entries(spark, sf))


# ------------------------------------------------------------------ changes
def _corrected(spark, sf):
    return changes.apply_corrections(d.records(spark, sf), d.extractions(spark, sf), d.corrections(spark, sf))


@query
def apply_corrections(spark, sf):
    return _corrected(spark, sf)["changed"].select(
        "record_id", "village", F.round("area_value", 2).alias("area_value"), "area_unit", "area_hectare", "record_confidence")


@query
def correction_pairs(spark, sf):
    return _corrected(spark, sf)["applied"].select("record_id", "field_name", "corrected_value", "ai_confidence")


@query
def rejected_corrections(spark, sf):
    return _corrected(spark, sf)["rejected"].groupBy("field_name", "reason").agg(F.count("*").alias("n"))


@query
def corrections_per_field(spark, sf):
    return sinks.corrections_per_field(_corrected(spark, sf)["applied"])


def _revalidated(spark, sf):
    """Findings of all ten rules after the corrections, made again only where a correction can alter them."""
    result = _corrected(spark, sf)
    changed = d.stored(spark, sf, "changed-records", lambda: result["changed"])
    after = d.stored(spark, sf, "corrected-records", lambda: changes.replace_rows(d.records(spark, sf), changed))
    return revalidation.revalidate(d.records(spark, sf), after, changed, _found(spark, sf), rules.Context(
        as_of=CTX.as_of, brief=True, sub_plots=d.sub_plots(spark, sf), cadastral=d.cadastral(spark, sf)))


@query
def revalidate(spark, sf):
    """Findings after the corrections, by rule and severity."""
    return metrics.rule_severity(_revalidated(spark, sf))


@query
def revalidated_rollup(spark, sf):
    """Findings after the corrections, by record."""
    return rules.rollup(_revalidated(spark, sf))


@query
def decide(spark, sf):
    records = d.records(spark, sf)
    found = _found(spark, sf)
    return changes.decide(records, found, d.decisions(spark, sf), F.lit(d.AS_OF).cast("timestamp"))["records"].select(
        "record_id", "status", "document_status")


@query
def refused_approvals(spark, sf):
    return changes.decide(d.records(spark, sf), _found(spark, sf), d.decisions(spark, sf),
                          F.lit(d.AS_OF).cast("timestamp"))["refused"]


@query
def merge_suggestions(spark, sf):
    profile = d.records(spark, sf).select("record_id", F.when(
        F.col("document_type_label") == vocab.FORM_39A, vocab.FORM_39A).otherwise(vocab.GENERIC).alias("profile"))
    merged = changes.merge_suggestions(d.extractions(spark, sf).join(profile, "record_id"), d.suggestions(spark, sf))
    return merged.where("source = 'suggestion'").select("record_id", "field_name", "normalized_value", "confidence")


@query
def notify_fanout(spark, sf):
    rolled = rules.with_rollup(d.records(spark, sf), _found(spark, sf))
    return notifications.fan_out_counts(notifications.high_severity_events(rolled), d.users(spark, sf))


# ------------------------------------------------------------------ extraction
def _fields(spark, sf):
    return extraction.extract_pages(d.register_pages(spark, sf))


@query
def extract_records(spark, sf):
    """Register pages back to records: the identifiers and areas must come back as they were written."""
    out = extraction.to_records(_fields(spark, sf))
    return out.select(F.col("doc_id").alias("record_id"), "khasra_no", "khata_no", "survey_no", "owner_name",
                      "district", "mutation_no", "area_value", "area_hectare")


def _assembled(spark, sf):
    """Records and parcels of the form's pages, each written once."""
    tables = []

    def part(i: int) -> DataFrame:
        if not tables:
            tables.extend(assembly.assemble(d.form_pages(spark, sf)))
        return tables[i]

    return d.stored(spark, sf, "form-records", lambda: part(0)), d.stored(spark, sf, "form-parcels", lambda: part(1))


@query
def form_records(spark, sf):
    """Pages of the form back to records: persons, boundary and class must come back as they were written."""
    records, _ = _assembled(spark, sf)
    owner = F.get("owners", F.lit(0))
    return records.select(F.col("doc_id").alias("record_id"), "owner_name", "guardian_name", "document_type_label", F.size("owners").alias("persons"),
                          owner["name"].alias("first_person"), owner["relation_name"].alias("father"),
                          *[F.col(f"boundary.{side}").alias(side) for side in assembly.SIDES])


@query
def form_parcels(spark, sf):
    """Parcels read off the form, summed per record."""
    _, parcels = _assembled(spark, sf)
    return rules.sub_plot_sums(parcels)


@query
def field_status(spark, sf):
    read = _fields(spark, sf).select("doc_id", "page", "field_name", "normalized_value", "confidence", "status", "area_unit", "area_hectare")
    return extraction.merge_pages(read).groupBy("field_name", "status").agg(F.count("*").alias("n"))


@query
def sub_plot_rows(spark, sf):
    return extraction.sub_plot_rows(d.register_pages(spark, sf)).select(
        F.col("doc_id").alias("record_id"), "khasra_no", "area_value", "area_unit", "area_hectare")


@query
def extraction_accuracy(spark, sf):
    """Share of khasra, khata and owner values read back correctly."""
    wanted = ["khasra_no", "khata_no", "owner_name"]
    expected = d.records(spark, sf).select(F.col("record_id").alias("doc_id"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.col(f).alias("expected_value")) for f in wanted])))
    return metrics.extraction_accuracy(expected.where("expected_value <> ''"), extraction.merge_pages(_fields(spark, sf)))


@query
def person_list(spark, sf):
    """Person-list parser over the documents' lines, each under a person-list header."""
    pages = d.text_pages(spark, sf).withColumn("text", F.concat(F.lit("praja "), "text"))
    lines = extraction.lines_of(pages)
    return form39a.person_lists(lines).select("doc_id", F.size("owners").cast("long").alias("persons"), "residence")


# ------------------------------------------------------------------ streams
@query
def stream_ingest(spark, sf):
    return streams.ingested(spark, sf)


@query
def stream_daily(spark, sf):
    return streams.daily(spark, sf)


@query
def stream_pending(spark, sf):
    """Records that waited 48 hours for a decision, from the stream of their status changes."""
    return streams.waiting(spark, sf)


@query
def stream_alerts(spark, sf):
    """Unread alerts per reviewer from the alert stream."""
    events = streams.announced(spark, sf, _found(spark, sf), d.records(spark, sf))
    return notifications.fan_out_counts(events, d.users(spark, sf))
