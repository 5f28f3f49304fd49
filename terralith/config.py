"""Thresholds, schemas and session settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Confidence bands, tolerances and scope of the data model.
CONFIDENCE_HIGH = 90.0
CONFIDENCE_MEDIUM = 70.0
CORRECTED_CONFIDENCE = 95.0
SUGGESTION_CONFIDENCE_CAP = 75.0
GIS_TOLERANCE_PCT = 15.0
GIS_HIGH_PCT = 25.0
PENDING_ALERT_HOURS = 48
LATENCY_BUDGET_MS = 10_000
DISTRICT = "Khordha"
STATE = "Odisha"
GENESIS_HASH = "0" * 64
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
ALLOWED_EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "tif", "tiff", "bmp")
SAME_OWNER_SIMILARITY = 0.92
VARIANT_LOW, VARIANT_HIGH = 0.80, 0.98
PARTIAL_WEIGHT = 0.95
NEIGHBOUR_RADIUS_M = 400.0
M_PER_DEG_LAT = 111_320.0
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BBOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "w", "h")])

WORD = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", BBOX),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("script", T.StringType()),
])

OCR_PAGE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("words", T.ArrayType(WORD)),
])

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])

AUDIT_LOG = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in (
        "log_id", "user_id", "actor_label", "action", "entity_type", "entity_id",
        "field_name", "old_value", "new_value")]
    + [T.StructField("ai_confidence", T.DoubleType()),
       T.StructField("detail", T.StringType()),
       T.StructField("created_at", T.TimestampType()),
       T.StructField("prev_hash", T.StringType()),
       T.StructField("entry_hash", T.StringType())]
)


def build_session(app_name: str = "terralith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew-join splitting)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a fresh local one only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def write_table(df: DataFrame, path: str) -> None:
    """df as Parquet files under path. Its shuffle files go with the write; else they stay until the driver happens to
    collect its garbage, and the steps of a query add up on disk."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def tune(spark: SparkSession) -> None:
    """Session settings the operators rely on, where they can be set at run time."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # the JVM does not compile methods beyond 8000 bytes: such stages run faster as many small projections
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }.items():
        spark.conf.set(key, value)
