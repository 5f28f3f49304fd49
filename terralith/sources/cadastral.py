"""Cadastral layers (GeoJSON) and reference ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith import vocab
from terralith.functions.geo import box_ring

_PROPERTIES = "plot_key string, khasra_no string, survey_no string, plot_no string, village string, " \
              "tehsil string, area_ha double, owner_hint string"
_FEATURES = f"features array<struct<properties: struct<{_PROPERTIES.replace(' string', ': string').replace(' double', ': double')}>, " \
            "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of polygon layers, in file order, with rings as arrays of (lon, lat)."""
    layer = spark.read.schema(_FEATURES).option("multiLine", True).json(path)
    features = layer.select(F.posexplode("features").alias("ord", "f"))
    rings = F.transform("f.geometry.coordinates", lambda ring: F.transform(
        ring, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat"))))
    return features.select("ord", "f.properties.*", rings.alias("rings"))


def sample_layer(spark: SparkSession) -> DataFrame:
    """The twelve sample plots as boxes on a grid."""
    schema = "plot_key string, khasra_no string, survey_no string, plot_no string, village string, " \
             "tehsil string, area_ha double, owner_hint string, gx int, gy int"
    plots = spark.createDataFrame(vocab.SAMPLE_PLOTS, schema)
    lon = (F.lit(vocab.GRID_ORIGIN_LON) + F.col("gx") * vocab.GRID_STEP_LON
           + F.when(F.col("gy") % 2 == 1, vocab.GRID_ODD_ROW_SHIFT).otherwise(0.0))
    lat = F.lit(vocab.GRID_ORIGIN_LAT) + F.col("gy") * vocab.GRID_STEP_LAT
    return plots.select("*", (F.col("gy") * 10 + F.col("gx")).alias("ord"),
                        F.array(box_ring(F.col("area_ha"), lon, lat, vocab.PLOT_ASPECT)).alias("rings")).drop("gx", "gy")


def sample_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        vocab.OWNERSHIP_LEDGER,
        "khasra_no string, owner string, khata string, area_ha double, classification string, village string")


def sample_deeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        vocab.DEED_REGISTER,
        "deed_key string, parties array<string>, year int, consideration_lakh double, sro string, status string")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "khasra_no string, owner string, khata string, area_ha double, classification string, village string"
    return spark.read.schema(schema).option("header", True).csv(path)
