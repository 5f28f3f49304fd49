"""A ring is walked once for its centroid, and the centroid is that of the outer ring minus its holes."""
import pytest

from pyspark.sql import functions as F

from terralith.functions import geo


def _square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_one_pass_over_a_ring(spark):
    rows = spark.createDataFrame([([_square(0.0, 0.0, 4.0), _square(0.0, 0.0, 2.0)],), ([_square(1.0, 1.0, 0.0)],)],
                                 "rings array<array<struct<lon:double,lat:double>>>")
    found = rows.select(geo.polygon_centroid(F.col("rings")).alias("c"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2
    whole, empty = [r.c for r in found.collect()]
    assert (whole.lon, whole.lat) == pytest.approx(((16 * 2 - 4 * 1) / 12,) * 2)
    assert empty.lon is None and empty.lat is None
