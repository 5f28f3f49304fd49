"""Search, review queue, filters and record detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith import config
from terralith.functions.text import is_set

FREE_TEXT_COLUMNS = ["owner_name", "khasra_no", "khata_no", "survey_no", "plot_no", "village", "tehsil",
                     "district", "record_id"]
COLUMN_FILTERS = ["owner_name", "khasra_no", "khata_no", "survey_no", "plot_no", "village", "tehsil", "district"]


def contains_text(col: Column, needle: str) -> Column:
    """Case-insensitive contains; % and _ are ordinary characters."""
    return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lit(needle.lower()))


def search(records: DataFrame, q: str | None = None, status: str | None = None, low_confidence_only: bool = False,
           findings: DataFrame | None = None, rule_id: str | None = None, limit: int | None = 50,
           **columns: str) -> DataFrame:
    """Newest first. A record that breaks the rule several times appears once."""
    out = records
    if q:
        out = out.where(reduce(lambda a, b: a | b, [contains_text(F.col(c), q) for c in FREE_TEXT_COLUMNS]))
    for name, value in columns.items():
        if name not in COLUMN_FILTERS:
            raise ValueError(f"no filter on {name}")
        out = out.where(contains_text(F.col(name), value))
    if status:
        out = out.where(F.col("status") == status)
    if low_confidence_only:
        out = out.where(F.col("record_confidence") < config.CONFIDENCE_MEDIUM)
    if rule_id:
        out = out.join(findings.where(F.col("rule_id") == rule_id).select("record_id"), "record_id", "left_semi")
    if limit is None:
        return out
    return out.orderBy(F.col("created_at").desc(), "record_id").limit(limit)


def priority(col: Column) -> Column:
    return F.when(col == "critical", "critical").when(col == "high", "high").otherwise("normal")


def confidence_band(col: Column) -> Column:
    return (F.when(col >= config.CONFIDENCE_HIGH, "high").when(col >= config.CONFIDENCE_MEDIUM, "medium")
            .otherwise("low"))


def low_confidence_flag(value: Column, confidence: Column) -> Column:
    return is_set(value) & (confidence < config.CONFIDENCE_MEDIUM)


def review_queue(records: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    """Pending and escalated records, most findings first, least confident first among equals."""
    out = records.where(F.col("status").isin("pending_review", "escalated"))
    if severity:
        out = out.where(F.col("highest_severity") == severity)
    return (out.withColumn("priority", priority(F.col("highest_severity")))
            .orderBy(F.col("discrepancy_count").desc(), F.col("record_confidence").asc(), "record_id")
            .limit(limit))


def document_list(documents: DataFrame, status: str | None = None, batch_id: str | None = None,
                  limit: int = 100) -> DataFrame:
    for name, value in (("status", status), ("batch_id", batch_id)):
        if value:
            documents = documents.where(F.col(name) == value)
    return documents.orderBy(F.col("created_at").desc(), "doc_id").limit(limit)


def audit_trail(log: DataFrame, entity_id: str | None = None, action: str | None = None,
                actor: str | None = None, limit: int = 100) -> DataFrame:
    if entity_id:
        log = log.where(F.col("entity_id") == entity_id)
    if action:
        log = log.where(F.col("action") == action)
    if actor:
        log = log.where(contains_text(F.col("actor_label"), actor))
    return log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def by_key(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def record_detail(record: DataFrame, extractions: DataFrame, findings: DataFrame, checks: DataFrame,
                  links: DataFrame, log: DataFrame, audit_rows: int | None = 60) -> DataFrame:
    """The named records with their fields, findings, checks, parcel and newest audit rows (None: all) as arrays.

    ``record`` is a short selection; every other table is first cut down to it by a semi join.
    """
    keys = record.select("record_id")

    def nested(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return (df.join(keys, "record_id", "left_semi").groupBy("record_id")
                .agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)))

    from pyspark.sql import Window

    newest = Window.partitionBy("entity_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    recent = (log.join(keys, log["entity_id"] == keys["record_id"], "left_semi")
              .withColumn("rn", F.row_number().over(newest))
              .withColumn("record_id", F.col("entity_id")))
    if audit_rows is not None:
        recent = recent.where(F.col("rn") <= audit_rows)
    return (record.join(nested(extractions, "fields", "field_name", "value", "confidence"), "record_id", "left")
            .join(nested(findings, "discrepancies", "rule_id", "severity", "message", "occurrences"), "record_id", "left")
            .join(nested(checks, "cross_checks", "source_system", "match_status", "detail"), "record_id", "left")
            .join(links.select("record_id", "match_type", F.col("plot_key").alias("linked_plot")), "record_id", "left")
            .join(nested(recent, "audit", "rn", "action", "actor_label", "created_at"), "record_id", "left"))
