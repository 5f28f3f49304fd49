"""Ownership chains per plot and parent lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions import text
from terralith.operators.rules import has_other_holder, plot_holders


def mutation_chain(records: DataFrame) -> DataFrame:
    """Mutations of each plot in date order with the holder the one before left behind.

    Plot and day make a window group; a plot's days are linked through one summary row per
    (plot, day), so a plot with very many mutations is never sorted in one task.
    """
    moves = (records.withColumn("day", text.parse_date(F.col("mutation_date")))
             .where(text.is_set(F.col("khasra_no")) & F.col("day").isNotNull()
                    & (text.is_set(F.col("previous_owner")) | text.is_set(F.col("new_owner"))))
             .select("id", "record_id", "khasra_no", "day", "previous_owner", "new_owner"))
    within = Window.partitionBy("khasra_no", "day").orderBy("id")
    across = Window.partitionBy("khasra_no").orderBy("day")
    days = (moves.groupBy("khasra_no", "day").agg(F.max_by("new_owner", "id").alias("last"))
            .withColumn("before", F.lag("last").over(across)).drop("last"))
    linked = moves.withColumn("same_day", F.lag("new_owner").over(within)).withColumn(
        "opens_day", F.row_number().over(within) == 1).join(days, ["khasra_no", "day"])
    prior = F.when(F.col("opens_day"), F.col("before")).otherwise(F.col("same_day"))
    return linked.select(
        "record_id", "khasra_no", "day", "previous_owner", "new_owner", prior.alias("prior_new_owner"),
        F.when(prior.isNull(), "first").when(F.lower(prior) == F.lower("previous_owner"), "continuous")
        .otherwise("broken").alias("link"))


def chain_gaps(records: DataFrame) -> DataFrame:
    """Records whose previous owner holds the plot in no other record."""
    claims = records.where(text.is_set(F.trim("previous_owner")) & text.is_set(F.col("khasra_no"))).withColumn(
        "_holder", F.lower(F.trim("previous_owner")))
    return (claims.join(plot_holders(records), ["khasra_no", "_holder"], "left")
            .where(~has_other_holder()).select("record_id", "khasra_no", "previous_owner"))


def parent_areas(records: DataFrame) -> DataFrame:
    """Area of the first record of each child's parent plot."""
    parents = (records.where(text.is_set(F.col("khasra_no"))).groupBy(F.col("khasra_no").alias("parent_khasra_no"))
               .agg(F.min_by("area_hectare", "id").alias("parent_area_hectare")))
    return (records.where(text.is_set(F.col("parent_khasra_no"))).select("record_id", "parent_khasra_no", "area_hectare")
            .join(parents, "parent_khasra_no", "left"))
