"""The streaming jobs run to completion over the given tables (available-now)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith import config
from terralith.sources import derived as d
from terralith.streaming import jobs


def _work(spark: SparkSession, name: str) -> str:
    return f"{config.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A table as a file stream, be it one file or a folder of part files (the pattern matches the table's own path)."""
    schema = d.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a file stream, with the columns of the inventory."""
    stream = _stream(spark, sf_dir, "documents", maxFilesPerTrigger=100)
    return stream.selectExpr(*[f"{e} as {n}" for n, e in d.DOCUMENT_COLUMNS.items()], "sha2(text, 256) as file_hash")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes stored by the ingest job, per language."""
    work = _work(spark, "ingest")
    store = f"{work}/store"
    uploads = _documents(spark, sf_dir).select("doc_id", "seq", "language", "file_hash", "created_at",
                                               "status", "record_status")
    jobs.ingest(uploads, store, f"{work}/checkpoint").awaitTermination()
    stored = spark.read.parquet(store)
    return stored.agg(F.count("*").alias("stored"), F.countDistinct("file_hash").alias("hashes"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final daily counts; update mode rewrites the touched days of each batch."""
    work = _work(spark, "daily")
    store = f"{work}/store"

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(store)

    query = (jobs.daily_counts(_documents(spark, sf_dir)).writeStream.outputMode("update").foreachBatch(handle)
             .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(store).groupBy("day").agg(F.max_by("documents", "batch_no").alias("documents"))


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of status changes of one record per user; changes of one moment in order of their ids."""
    stream = _stream(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("signup", "purchase"), "approved").otherwise("pending_review")
    return stream.select(F.concat(F.lit("LR-"), F.col("user_id").cast("string")).alias("record_id"), status.alias("status"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wait of 48 hours and more, alerted by timers or by the event that ended it."""
    work = _work(spark, "pending")
    store = f"{work}/store"
    alerts = jobs.pending_alerts(status_changes(spark, sf_dir))
    alerts.writeStream.format("parquet").option("path", store).option("checkpointLocation", f"{work}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(store)


def announced(spark: SparkSession, sf_dir: str, findings: DataFrame, records: DataFrame) -> DataFrame:
    """Events that the alert job writes for a table of findings, read as a stream of its files."""
    work = _work(spark, "severe")
    findings.write.parquet(f"{work}/findings")
    stream = spark.readStream.schema(findings.schema).parquet(f"{work}/findings")
    jobs.severe_alerts(stream, records, f"{work}/store", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/store")
