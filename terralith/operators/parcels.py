"""Records and the cadastral polygon layer: linking, area deltas, neighbours, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith import config
from terralith.functions import geo
from terralith.functions.text import half_up, is_set

KEY_ORDER = ["khasra_no", "survey_no", "plot_no"]


def measure(cadastral: DataFrame) -> DataFrame:
    """Add centroid and polygon area."""
    centred = cadastral.withColumn("centroid", geo.polygon_centroid(F.col("rings")))
    return centred.withColumn("polygon_area_ha", geo.polygon_area_ha(F.col("rings"), F.col("centroid")))


def plot_keys(cadastral: DataFrame) -> DataFrame:
    """(key_type, key, ord): the first feature of each key wins."""
    entries = F.array(*[F.struct(F.lit(k).alias("key_type"), F.trim(k).alias("key")) for k in KEY_ORDER])
    return (cadastral.select("ord", F.inline(entries)).where(is_set(F.col("key")))
            .groupBy("key_type", "key").agg(F.min("ord").alias("ord")))


def link_records(records: DataFrame, cadastral: DataFrame) -> DataFrame:
    """Match each record on khasra, else survey, else plot number, and compare areas.

    One row per record: match_type, plot_key, polygon_area_ha, area_delta_pct, spatial_mismatch.
    The record's keys are looked up as rows of one join, so the key table is scanned once.
    """
    wanted = F.array(*[F.struct(F.lit(i).alias("precedence"), F.lit(k).alias("key_type"), F.col(k).alias("key"))
                       for i, k in enumerate(KEY_ORDER)])
    probes = records.select("id", F.inline(wanted)).where(is_set(F.col("key")))
    hit = (probes.join(plot_keys(cadastral), ["key_type", "key"])
           .groupBy("id").agg(F.min(F.struct("precedence", "key_type", "ord")).alias("m"))
           .select("id", F.col("m.key_type").alias("match_type"), F.col("m.ord").alias("ord")))
    plots = measure(cadastral).select("ord", "plot_key", "polygon_area_ha")
    linked = records.drop("plot_key", "polygon_area_ha", "match_type").join(
        hit.join(plots, "ord").drop("ord"), "id", "left")
    area = F.coalesce("area_hectare", F.lit(0.0))
    delta = F.when(F.col("match_type").isNotNull() & (area > 0),
                   (F.col("polygon_area_ha") - area) / area * 100).otherwise(0.0)
    return linked.withColumns({
        "gis_linked": F.col("match_type").isNotNull(),
        "area_delta_pct": half_up(delta, 2),
        "spatial_mismatch": F.abs(delta) > config.GIS_TOLERANCE_PCT,
        "match_type": F.coalesce("match_type", F.lit("none")),
        "plot_key": F.coalesce("plot_key", F.lit("")),
        "polygon_area_ha": F.coalesce("polygon_area_ha", F.lit(0.0))})


def neighbours(cadastral: DataFrame, radius_m: float = config.NEIGHBOUR_RADIUS_M,
               targets: DataFrame | None = None) -> DataFrame:
    """Plots whose centroid lies within ``radius_m`` of another plot's: (plot_key, neighbour, distance_m).

    Centroids are put on a grid of cells at least one radius wide; a plot only meets the plots of
    its own and the eight surrounding cells. ``targets`` restricts the left side.
    """
    points = cadastral.select("plot_key", "khasra_no", "owner_hint",
                              geo.polygon_centroid(F.col("rings")).alias("c"))
    # Dealt out here, so that the geometry is computed once and not again in every expression below.
    points = points.repartition("plot_key")
    lat_step = radius_m / config.M_PER_DEG_LAT * 1.001
    row = F.floor(F.col("c.lat") / lat_step)

    def column(lon: Column, band: Column) -> Column:
        # width of a cell in this band of latitude, wide enough for the band's poleward edge
        edge = (F.abs(band.cast("double")) + 3) * lat_step
        return F.floor(lon / (lat_step / F.cos(F.radians(F.least(edge, F.lit(89.0))))))

    cells = points.withColumns({"row": row, "col": column(F.col("c.lon"), row)})
    left = cells if targets is None else cells.join(targets.select("plot_key"), "plot_key", "left_semi")
    # a neighbour's column is computed with the target band's width
    around = cells.select("plot_key", "khasra_no", "owner_hint", "c",
                          F.explode(F.array(*[F.col("row") + d for d in (-1, 0, 1)])).alias("row"))
    around = around.withColumn("col", column(F.col("c.lon"), F.col("row")))
    reach = left.select(F.col("plot_key").alias("target"), F.col("c").alias("t"), "row",
                        F.explode(F.array(*[F.col("col") + d for d in (-1, 0, 1)])).alias("col"))
    dx = (F.col("c.lon") - F.col("t.lon")) * geo.metres_per_lon(F.col("t.lat"))
    dy = (F.col("c.lat") - F.col("t.lat")) * config.M_PER_DEG_LAT
    distance = F.hypot(dx, dy)
    return (reach.join(around, ["row", "col"])
            .where((F.col("target") != F.col("plot_key")) & (distance <= radius_m))
            .select(F.col("target").alias("plot_key"), F.col("plot_key").alias("neighbour"),
                    "khasra_no", F.col("owner_hint").alias("owner"), F.round(distance, 1).alias("distance_m")))


def layer_summary(cadastral: DataFrame, records: DataFrame) -> DataFrame:
    """One row: features, indexed keys, villages, linked and total records."""
    features = cadastral.agg(F.count("*").alias("feature_count"), F.countDistinct("village").alias("villages"))
    keys = plot_keys(cadastral).agg(F.count("*").alias("indexed_keys"))
    linked = link_records(records, cadastral).agg(
        F.count("*").alias("records"), F.count_if("gis_linked").alias("linked_records"))
    long = [df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("long"))]))
                      .alias("metric", "value")) for df in (features, keys, linked)]
    return long[0].unionByName(long[1]).unionByName(long[2])


def record_of_plot(links: DataFrame, plot_key: str) -> DataFrame:
    return links.where(F.col("plot_key") == plot_key)
