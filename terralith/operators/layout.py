"""Page layout boxes: containment and counts (the boxes come from an external detector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ["table", "printed_text", "handwritten_text", "stamp", "map"]


def overlap_share(outer: str, inner: str) -> Column:
    def side(axis, size):
        hi = F.least(F.col(f"{outer}.{axis}") + F.col(f"{outer}.{size}"), F.col(f"{inner}.{axis}") + F.col(f"{inner}.{size}"))
        lo = F.greatest(F.col(f"{outer}.{axis}"), F.col(f"{inner}.{axis}"))
        return F.greatest(F.lit(0), hi - lo)

    area = F.col(f"{inner}.w") * F.col(f"{inner}.h")
    return side("x", "w") * side("y", "h") / F.when(area > 0, area)


def drop_text_in_tables(boxes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Remove text boxes that lie (to the threshold) inside a table box of the same page."""
    is_text = F.col("label").isin("printed_text", "handwritten_text")
    texts, tables = boxes.where(is_text).alias("t"), boxes.where("label = 'table'").alias("b")
    kept = texts.join(tables, (F.col("t.doc_id") == F.col("b.doc_id")) & (F.col("t.page") == F.col("b.page"))
                      & (overlap_share("b", "t") >= threshold), "left_anti")
    return kept.unionByName(boxes.where(~is_text))


def layout_counts(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("doc_id", "page").pivot("label", LABELS).agg(F.count("x")).na.fill(0, LABELS)
