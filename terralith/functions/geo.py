"""Planar geometry on lon/lat rings with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.config import M_PER_DEG_LAT
from terralith.functions.text import half_up


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _moments(ring: Column) -> Column:
    """Doubled signed area and first moments of a closed ring, shifted to its first vertex for precision, in one pass."""
    first, zero = F.element_at(ring, 1), F.lit(0.0)
    start = F.struct(first["lon"].alias("lon"), first["lat"].alias("lat"), *[zero.alias(n) for n in ("x", "y", "twice", "cx", "cy")])

    def step(acc, p):
        x, y = p["lon"] - acc["lon"], p["lat"] - acc["lat"]
        cross = acc["x"] * y - x * acc["y"]
        return F.struct(acc["lon"].alias("lon"), acc["lat"].alias("lat"), x.alias("x"), y.alias("y"), (acc["twice"] + cross).alias("twice"),
                        (acc["cx"] + (acc["x"] + x) * cross).alias("cx"), (acc["cy"] + (acc["y"] + y) * cross).alias("cy"))

    return F.aggregate(F.slice(ring, 2, F.size(ring) - 1), start, step)


def ring_area_deg(ring: Column) -> Column:
    """Unsigned shoelace area in square degrees."""
    return F.abs(_moments(ring)["twice"]) / 2


def _centre(m: Column, axis: str, moment: str) -> Column:
    scale = F.when(m["twice"] != 0, m["twice"] * 3)
    return m[axis] + F.coalesce(m[moment] / scale, F.lit(0.0))


def polygon_centroid(rings: Column) -> Column:
    """Area-weighted centroid: outer ring minus holes. Each ring is walked once, its moments are a variable of the next step."""
    parts = F.transform(F.transform(rings, _moments), lambda m, i: F.struct(
        (F.when(i == 0, 1.0).otherwise(-1.0) * (F.abs(m["twice"]) / 2)).alias("w"),
        _centre(m, "lon", "cx").alias("lon"), _centre(m, "lat", "cy").alias("lat")))

    def finish(acc):
        total = F.when(acc["w"] != 0, acc["w"])
        return F.struct((acc["lon"] / total).alias("lon"), (acc["lat"] / total).alias("lat"))

    return F.aggregate(parts, F.struct(*[F.lit(0.0).alias(n) for n in ("w", "lon", "lat")]), lambda acc, p: F.struct(
        (acc["w"] + p["w"]).alias("w"), (acc["lon"] + p["w"] * p["lon"]).alias("lon"), (acc["lat"] + p["w"] * p["lat"]).alias("lat")), finish)


def metres_per_lon(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * M_PER_DEG_LAT


def polygon_area_ha(rings: Column, centroid: Column) -> Column:
    """Hectares on a local equirectangular projection at the centroid's latitude; holes subtracted."""
    degrees = _sum(F.transform(rings, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * ring_area_deg(r)))
    area = degrees * metres_per_lon(centroid["lat"]) * M_PER_DEG_LAT / 10_000.0
    return F.coalesce(half_up(area, 6), F.lit(0.0))


def box_ring(target_ha: Column, lon: Column, lat: Column, aspect: float = 1.25) -> Column:
    """Closed rectangle of the given size with its south-west corner at (lon, lat)."""
    sqm = target_ha * 10_000.0
    height = F.sqrt(sqm / aspect)
    dlat = height / M_PER_DEG_LAT
    dlon = sqm / height / metres_per_lon(lat)

    def point(x, y):
        return F.struct(F.round(x, 7).alias("lon"), F.round(y, 7).alias("lat"))

    return F.array(point(lon, lat), point(lon + dlon, lat), point(lon + dlon, lat + dlat),
                   point(lon, lat + dlat), point(lon, lat))
