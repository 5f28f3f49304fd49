"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate, target share over actual share. A document's number of copies is the Poisson
quantile, with that mean, of a uniform number hashed from the seed and the document's id: reproducible, independent of
partitioning, and equal in expectation to the target. Copies are spread over the whole output by a hashed sort key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
#: Hex digits of an md5 that make a uniform number (52 bits).
DIGITS = 13


def poisson_steps(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, … copies, until they are 1 for a 52-bit number."""
    out, k, total = [], 0, 0.0
    while rate > 0 and (k <= rate or 1 - total > 2.0 ** -52):
        step = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        total += step
        out.append(min(total, 1.0))
        k += 1
        if k > 20 * rate + 200 or k > rate and step < 2.0 ** -60:
            break
    return out


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16 ** DIGITS))


def rates(df: DataFrame, weights: Mapping[str, float], source: str = "source", size: Column | None = None,
          total: float | None = None, default: float | None = None) -> dict[str | None, float]:
    """Mean repetitions per weighted source. Weights are scaled to sum 1; `total` is the output's size (default: the
    size of all weighted sources). `default` is the weight of every source found that `weights` does not name, null
    being one of them; without it they have no weight. Reads one sum per source; one without rows gets no rate."""
    if any(w < 0 for w in [*weights.values(), default or 0]) or not sum(weights.values()) + (default or 0) > 0:
        raise ValueError("weights must be 0 or more and not all 0")
    size = F.lit(1) if size is None else size
    wanted = df if default is not None else df.where(F.col(source).isin(*weights))
    found = wanted.groupBy(source).agg(F.sum(size).cast("double").alias("n"))
    sizes = {r[0]: r[1] for r in found.collect() if r[1]}
    weight = {s: weights.get(s, default) for s in sizes}
    whole = sum(sizes.values()) if total is None else total
    share = sum(weight.values())
    return {s: weight[s] / share * whole / n for s, n in sizes.items()} if share else {}


def mix(df: DataFrame, weights: Mapping[str, float], source: str = "source", doc_id: str = "doc_id",
        size: Column | None = None, total: float | None = None, seed: str = SEED,
        default: float | None = None) -> DataFrame:
    """df's rows, each as often as drawn, with `copy` (from 0) and `shuffle_key`, in the order of the shuffle key.

    Documents of sources without a weight (see `rates` for those not named, and null) are left out, as are those that
    draw 0. A null id counts as empty; rows that repeat an id draw the same number. A row's size is 1 unless `size` is
    given.
    """
    steps = {s: poisson_steps(r) for s, r in rates(df, weights, source, size, total, default).items()}
    steps = {s: c for s, c in steps.items() if c}
    if not steps:
        return df.limit(0).withColumns({"copy": F.lit(0), "shuffle_key": F.lit("")})
    table = df.sparkSession.createDataFrame(
        [(s if s is None else str(s), c) for s, c in steps.items()], "__source string, __steps array<double>")
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    drawn = uniform(F.lit(seed), name)
    count = F.aggregate("__steps", F.lit(0), lambda n, c: n + F.when(drawn >= c, 1).otherwise(0))
    weighted = df.join(F.broadcast(table), F.col(source).cast("string").eqNullSafe(F.col("__source")))
    copies = weighted.withColumn("__n", count).drop("__source", "__steps").where(F.col("__n") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    return copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), name, F.col("copy")))).orderBy(
        "shuffle_key")


def mixed_rows(df: DataFrame, weights: Mapping[str, float], source: str = "source", doc_id: str = "doc_id",
               total: float | None = None, seed: str = SEED, default: float | None = None) -> DataFrame:
    """The rows of `mix` with the columns of df alone, whatever their names: a `copy` or `shuffle_key` of df stays."""
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"))
    return mix(packed, weights, total=total, seed=seed, default=default).select("row.*")
