"""Duplicate plots and owner-name variants.

Names are reduced to distinct (scope, name) rows first, candidate pairs come from an equi-join
on shared name segments (an exact filter, see ``_segments``), and only candidates are scored.
Nothing enumerates the pairs of a plot or a village: batch results carry counts per record,
and the list form (`duplicates_of`) is for named records, where it is linear in the table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.config import (PARTIAL_WEIGHT, SAME_OWNER_SIMILARITY, VARIANT_HIGH, VARIANT_LOW, checkpoint_dir,
                              write_table)
from terralith.functions.similarity import letters_of, ratio_of_sorted, token_sort, variant_score_udf
from terralith.functions.text import is_set

EPS = 1e-9
PREFIXES = (512, 4096, 32_768)  # how many names of a large village answer first; the result is the same with any numbers
TILE = 1024  # names of a block that meet those of another; the result is the same with any number
LARGE_SCOPE = 131_072  # scopes of more names ask through segments; the result is the same either way


# ------------------------------------------------------------------ candidate generation
def _segments(text: Column, parts: Column) -> Column:
    """Cut a text into ``parts`` consecutive pieces of nearly equal length, with positions.

    If two texts differ by at most d inserted or deleted characters, each such edit touches at
    most one piece, so with d+1 pieces at least one occurs unchanged in the other text.
    """
    size, n = F.length(text), parts

    def piece(i):
        lo = F.floor(i * size / n).cast("int")
        hi = F.floor((i + 1) * size / n).cast("int")
        return F.struct(F.substring(text, lo + 1, hi - lo).alias("piece"), lo.alias("pos"))

    return F.filter(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), piece),
                    lambda p: p["piece"] != "")


def _grams(text: Column, sizes: Column) -> Column:
    """Every substring of the given sizes, with positions."""
    return F.flatten(F.transform(sizes, lambda q: F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(text) - q, F.lit(0))),
        lambda p: F.struct(F.substring(text, p + 1, q).alias("piece"), p.alias("pos")))))


def _max_edits(short: Column, long: Column, floor: float) -> Column:
    """Most insertions plus deletions a pair of these lengths may have at this ratio."""
    d = F.floor((1 - floor) * (short + long) + EPS)
    return (d - (d + short + long) % 2).cast("int")


def _scoped_join(left: DataFrame, right: DataFrame, scope: list[str], condition: Column) -> DataFrame:
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in scope + ["piece"]]
    for extra in on:
        condition = condition & extra
    return left.alias("l").join(right.alias("r"), condition)


def _piece_counts(n: Column, floor: float) -> Column:
    """All piece counts a name of length n is cut into: one per edit budget with an equal or longer name."""
    longest = F.floor(n * (2 - floor) / floor + EPS).cast("int")
    return F.array_distinct(F.transform(F.sequence(n, longest), lambda w: _max_edits(n, w, floor) + 1))


def _gram_sizes(n: Column, floor: float) -> Column:
    """Sizes of the pieces of all shorter or equal names that may reach a name of length n."""
    shortest = F.greatest(F.lit(1), F.ceil(n * floor / (2 - floor) - EPS).cast("int"))

    def sizes(m):
        k = _max_edits(m, n, floor) + 1
        return F.array(F.floor(m / k).cast("int"), F.ceil(m / k).cast("int"))

    found = F.flatten(F.transform(F.sequence(F.least(shortest, n), n), sizes))
    return F.filter(F.array_distinct(found), lambda g: (g > 0) & (g <= n))


def _lacking(a: str, b: str) -> Column:
    """How many letters of one signature the other lacks (a lower bound)."""
    def part(half):
        return F.bit_count(F.col(f"{a}.{half}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{half}"))))

    return part("lo") + part("hi")


def _spread(names: DataFrame, scope: list[str], text: str) -> DataFrame:
    """Non-blank names, evenly spread: expanding a name costs the same whatever its village or plot."""
    width = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (names.where(F.length(text) > 0).select(*scope, F.col(text).alias("name"))
            .repartition(width, *scope, "name").withColumn("letters", letters_of("name")))


def whole_candidates(names: DataFrame, scope: list[str], text: str, floor: float,
                     others: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), |a| <= |b|, that can reach ``floor`` on the Indel ratio of ``text``; with repeats.

    With ``others``, a comes from ``names`` and b from there. Names may be of any length: piece counts and gram sizes follow from it.
    """
    base = _spread(names, scope, text)
    pool = base if others is None else _spread(others, scope, text)
    n = F.length("name")
    probe = (base.select(*scope, "name", "letters", F.explode(_piece_counts(n, floor)).alias("parts"))
             .select(*scope, "name", "letters", "parts", F.inline(_segments(F.col("name"), F.col("parts")))))
    index = pool.select(*scope, "name", "letters", F.inline(_grams(F.col("name"), _gram_sizes(n, floor))))
    la, lb = F.length("l.name"), F.length("r.name")
    edits = _max_edits(la, lb, floor)
    shift = F.col("r.pos") - F.col("l.pos")
    condition = ((la <= lb) & (F.col("l.name") != F.col("r.name"))
                 & (F.col("l.parts") == edits + 1)
                 & (shift <= (edits + lb - la) / 2) & (shift >= -(edits - lb + la) / 2)
                 & (_lacking("l.letters", "r.letters") <= (edits + la - lb) / 2)
                 & (_lacking("r.letters", "l.letters") <= (edits + lb - la) / 2)
                 & (F.call_function("levenshtein", F.col("l.name"), F.col("r.name"), edits) >= 0))
    return (_scoped_join(probe, index, scope, condition)
            .select(*[F.col(f"l.{c}") for c in scope], F.col("l.name").alias("a"), F.col("r.name").alias("b")))


def window_candidates(names: DataFrame, scope: list[str], text: str, floor: float,
                      others: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), |a| <= |b|, where some window of b can reach ``floor`` against a; with repeats."""
    base = _spread(names, scope, text)
    pool = base if others is None else _spread(others, scope, text)

    def parts(m: Column) -> Column:
        return F.least(F.floor((1 - floor) * 2 * m + EPS).cast("int") + 1, m)

    n = F.length("name")
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda m: F.array(
        F.floor(m / parts(m)).cast("int"), F.ceil(m / parts(m)).cast("int")))))
    pieces = parts(n)
    probe = base.select(*scope, "name", "letters", F.inline(_segments(F.col("name"), pieces))).drop("pos")
    grams = F.array_distinct(F.transform(_grams(F.col("name"), sizes),
                                         lambda g: g["piece"]))
    index = pool.select(*scope, "name", "letters", F.explode(grams).alias("piece"))
    # letters of a that a window of b may lack, whatever the window's length
    loss = F.floor(F.length("l.name") * (1 - floor / (2 - floor)) + EPS)
    condition = ((F.length("l.name") <= F.length("r.name")) & (F.col("l.name") != F.col("r.name"))
                 & (_lacking("l.letters", "r.letters") <= loss))
    return (_scoped_join(probe, index, scope, condition)
            .select(*[F.col(f"l.{c}") for c in scope], F.col("l.name").alias("a"), F.col("r.name").alias("b")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair seen from both of its names."""
    others = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(*others, F.inline(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _tiled(names: DataFrame, scope: list[str], by: str, columns: list) -> DataFrame:
    """(scope, x, y): each unordered pair of a scope's names once, as two structs of ``columns``.

    ``names`` has the scope's ``size``. Names of a scope are dealt into blocks of about TILE, and blocks meet pairwise, so no
    task holds a whole large scope. The filters of the caller run inside the join.
    """
    cut = (names.withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int"))
           .withColumn("block", F.pmod(F.hash(by), F.col("blocks"))).select(*scope, "blocks", "block", F.struct(*columns).alias("name")))
    x = cut.select(*scope, F.col("block").alias("row"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("column"), F.col("name").alias("x"))
    y = cut.select(*scope, F.explode(F.sequence(F.lit(0), F.col("block"))).alias("row"), F.col("block").alias("column"), F.col("name").alias("y"))
    return x.join(y, [*scope, "row", "column"]).where((F.col("row") < F.col("column")) | (F.col(f"x.{by}") < F.col(f"y.{by}")))


def _tiled_pairs(names: DataFrame, scope: list[str], low: float) -> DataFrame:
    """(scope, a, b), each unordered pair once, that can reach ``low`` on the Indel ratio, by enumeration in the scope.

    Lengths, letters and a bounded Levenshtein distance are exact filters.
    """
    met = _tiled(names, scope, "sorted", ["sorted", F.length("sorted").alias("n"), "letters"])
    a, b, la, lb = F.col("x.sorted"), F.col("y.sorted"), F.col("x.n"), F.col("y.n")
    edits = F.floor((1 - low) * (la + lb) + EPS).cast("int")
    met = met.where((_lacking("x.letters", "y.letters") * 2 <= edits + la - lb) & (_lacking("y.letters", "x.letters") * 2 <= edits + lb - la)
                    & (F.call_function("levenshtein", a, b, edits) >= 0))
    return met.select(*scope, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def similar_names(names: DataFrame, scope: list[str], low: float, high: float | None = None) -> DataFrame:
    """(scope, a, b, score) for token-sorted names with low <= ratio (< high), both directions, a <> b.

    Names of large scopes are compared once for all of these scopes where that is less work than scope by scope; scopes
    beyond LARGE_SCOPE names ask through segments.
    """
    named = names.where(F.col("sorted") != "").select(*scope, "sorted")
    sizes = named.groupBy(*scope).agg(F.count("*").alias("size"))
    sized = kept(named.join(sizes.where("size > 1"), scope).withColumn("letters", letters_of("sorted")), "sized-names")
    direct = _tiled_pairs(sized.where(F.col("size") <= TILE), scope, low)
    parts = [_scored(direct, low, high)]
    large = sized.where(F.col("size") > TILE)
    work = large.agg(F.sum("size").alias("apart"), F.approx_count_distinct("sorted").alias("names"), F.max("size").alias("most")).first()
    if work["apart"]:
        together = large.groupBy("sorted").agg(F.first("letters").alias("letters"))
        if work["names"] ** 2 <= work["apart"] and work["names"] <= LARGE_SCOPE:
            pooled = together.withColumns({"size": F.lit(work["names"]), "_all": F.lit(0)})
            pairs = kept(_scored(_tiled_pairs(pooled, ["_all"], low), low, high), "pooled-pairs")
            there = large.select(*scope, F.col("sorted").alias("a")).join(pairs.select("a", "b", "score"), "a")
            parts.append(there.join(large.select(*scope, F.col("sorted").alias("b")), [*scope, "b"]))
        else:
            parts.append(_scored(_tiled_pairs(large.where(F.col("size") <= LARGE_SCOPE), scope, low), low, high))
            if work["most"] > LARGE_SCOPE:
                ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
                huge = large.where(F.col("size") > LARGE_SCOPE)
                parts.append(_scored(whole_candidates(huge, scope, "sorted", low).select(*scope, *ordered).distinct(), low, high))
    return _both_ways(reduce(DataFrame.unionByName, [p.select(*scope, "a", "b", "score") for p in parts]))


def _scored(pairs: DataFrame, low: float, high: float | None) -> DataFrame:
    scored = pairs.withColumn("score", ratio_of_sorted("a", "b")).where(F.col("score") >= low - EPS)
    return scored if high is None else scored.where(F.col("score") < high - EPS)


# ------------------------------------------------------------------ duplicate plots
def _plot_pool(records: DataFrame) -> DataFrame:
    """Every record under each plot key it can be found by; ``asks`` marks its own key, one per record."""
    base = records.select("id", "record_id", "khasra_no", "survey_no", F.trim("owner_name").alias("owner"),
                          token_sort(F.col("owner_name")).alias("sorted"))
    by_khasra = base.where(is_set(F.col("khasra_no"))).withColumns(
        {"kind": F.lit("khasra"), "key": F.col("khasra_no"), "asks": F.lit(True)})
    wanted = (records.where(~is_set(F.col("khasra_no")) & is_set(F.col("survey_no")))
              .select(F.col("survey_no").alias("key")).distinct())
    by_survey = (base.where(is_set(F.col("survey_no")))
                 .withColumns({"kind": F.lit("survey"), "key": F.col("survey_no"), "asks": ~is_set(F.col("khasra_no"))})
                 .join(wanted, "key", "left_semi"))
    return by_khasra.unionByName(by_survey).select("kind", "key", "id", "record_id", "owner", "sorted", "asks")


def duplicate_plot_stats(records: DataFrame) -> DataFrame:
    """Per record: how many other records share its plot, split by same / conflicting owner.

    Columns: id, key, dup_total, dup_same, dup_conflict, same_example, conflict_example, conflict_owner.
    Examples are the first such record by id.
    """
    scope = ["kind", "key"]
    pool = _plot_pool(records)
    names = kept(pool.groupBy(*scope, "sorted").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "record_id", "owner")).alias("first")), "plot-names")
    firsts = F.struct(F.col("first.id").alias("id"), F.col("sorted"), F.col("first.record_id").alias("record_id"),
                      F.col("first.owner").alias("owner"))
    totals = names.groupBy(*scope).agg(
        F.sum("n").alias("total"), F.count("*").alias("n_all"), F.count(F.when(F.col("sorted") != "", 1)).alias("n_names"),
        F.min(firsts).alias("first_name"))
    totals = kept(totals, "plot-totals")
    crowded = names.join(totals.where("n_names > 1").select(*scope), scope, "left_semi")
    pairs = similar_names(crowded, scope, SAME_OWNER_SIMILARITY)
    near = (pairs.join(names.withColumnRenamed("sorted", "b"), [*scope, "b"])
            .groupBy(*scope, F.col("a").alias("sorted"))
            .agg(F.sum("n").alias("near_n"), F.min("first").alias("near_first")))
    # per distinct name: totals, near names and the first record of another name
    second = names.join(totals.where("n_all > 1").select(*scope, F.col("first_name.sorted").alias("lead")), scope)
    runner_up = (second.where(F.col("sorted") != F.col("lead")).groupBy(*scope)
                 .agg(F.min(firsts).alias("second_name")))
    per_name = (names.select(*scope, "sorted", "n", F.col("first").alias("self_first"))
                .join(totals.where("total > 1"), scope).join(runner_up, scope, "left")
                .join(near, [*scope, "sorted"], "left"))
    joined = pool.where("asks").select("id", *scope, "sorted").join(per_name, [*scope, "sorted"], "left")
    named = F.col("sorted") != ""
    alone = F.col("total").isNull()                      # the only record of its plot
    total = F.coalesce("total", F.lit(1))
    same = F.when(named & ~alone, F.col("n") - 1 + F.coalesce("near_n", F.lit(0))).otherwise(F.lit(0))
    other_lead = F.when(F.col("first_name.sorted") != F.col("sorted"), F.col("first_name")).otherwise(F.col("second_name"))
    return joined.select(
        "id", "key", (total - 1).alias("dup_total"), same.alias("dup_same"),
        (total - 1 - same).alias("dup_conflict"),
        F.when(F.col("self_first.id") != F.col("id"), F.col("self_first.record_id"))
         .otherwise(F.col("near_first.record_id")).alias("same_example"),
        other_lead["record_id"].alias("conflict_example"), other_lead["owner"].alias("conflict_owner"),
    )


# ------------------------------------------------------------------ owner variants
def _village_names(records: DataFrame) -> DataFrame:
    """Distinct lower-case owner names per village, with record count and first record."""
    return (records.where(is_set(F.col("village")) & is_set(F.trim("owner_name")))
            .select("village", "id", "record_id", F.trim("owner_name").alias("owner"),
                    F.lower(F.trim("owner_name")).alias("name"))
            .groupBy("village", "name")
            .agg(F.count("*").alias("n"), F.min(F.struct("id", "record_id", "owner")).alias("first"))
            .withColumn("sorted", token_sort(F.col("name"))))


def owner_variant_scores(records: DataFrame) -> DataFrame:
    """(village, a, b, score): owner names of one village that look like spellings of one another."""
    names = _village_names(records)
    window = window_candidates(names, ["village"], "name", VARIANT_LOW / PARTIAL_WEIGHT)
    by_sorted = names.select("village", "name", "sorted")
    whole = whole_candidates(names.select("village", "sorted").distinct(), ["village"], "sorted",
                             VARIANT_LOW).distinct()
    # sorted names that coincide differ only in token order
    whole = (whole.join(by_sorted.select("village", F.col("sorted").alias("a"), F.col("name").alias("a_name")),
                        ["village", "a"])
             .join(by_sorted.select("village", F.col("sorted").alias("b"), F.col("name").alias("b_name")),
                   ["village", "b"])
             .select("village", F.col("a_name").alias("a"), F.col("b_name").alias("b")))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    candidates = (window.select("village", *ordered).unionByName(whole.select("village", *ordered))
                  .where("a <> b").distinct())
    score = variant_score_udf(PARTIAL_WEIGHT, VARIANT_LOW)
    scored = candidates.withColumn("score", score("a", "b", token_sort(F.col("a")), token_sort(F.col("b"))))
    kept = scored.where((F.col("score") >= VARIANT_LOW - EPS) & (F.col("score") < VARIANT_HIGH - EPS))
    return _both_ways(kept)


def _close() -> Column:
    """May the names x and y be variants? Lengths, letters and bounded Levenshtein distances (never above the Indel ones)."""
    lx, ly, sx, sy = F.col("x.n"), F.col("y.n"), F.col("x.sn"), F.col("y.sn")
    floor = VARIANT_LOW / PARTIAL_WEIGHT
    share = floor / (2 - floor)
    x_lacks, y_lacks = _lacking("x.letters", "y.letters"), _lacking("y.letters", "x.letters")
    window = (((lx <= ly) & (x_lacks <= lx * (1 - share) + EPS)) | ((ly <= lx) & (y_lacks <= ly * (1 - share) + EPS)))
    half = VARIANT_LOW / 2
    whole = (x_lacks <= sx - half * (sx + sy) + EPS) & (y_lacks <= sy - half * (sx + sy) + EPS)
    far = F.floor(lx + ly - 2 * share * F.least(lx, ly) + EPS).cast("int")
    edits = F.floor((1 - VARIANT_LOW) * (sx + sy) + EPS).cast("int")
    return ((window & (F.call_function("levenshtein", F.col("x.name"), F.col("y.name"), far) >= 0))
             | (whole & (F.call_function("levenshtein", F.col("x.sorted"), F.col("y.sorted"), edits) >= 0)))


def _variants_of(pairs: DataFrame) -> DataFrame:
    """(…, a, b, score) of the scored variants among pairs of structs x and y, both ways."""
    score = variant_score_udf(PARTIAL_WEIGHT, VARIANT_LOW)
    named = pairs.select(*[c for c in pairs.columns if c not in ("x", "y")], F.col("x.name").alias("a"), F.col("y.name").alias("b"),
                         F.col("x.sorted").alias("a_sorted"), F.col("y.sorted").alias("b_sorted"))
    scored = named.withColumn("score", score("a", "b", "a_sorted", "b_sorted")).drop("a_sorted", "b_sorted")
    return _both_ways(scored.where((F.col("score") >= VARIANT_LOW - EPS) & (F.col("score") < VARIANT_HIGH - EPS)))


def _pooled_answers(large: DataFrame, count: int, first: int) -> DataFrame:
    """(village, name, answers) in large villages that share names: each two of the ``count`` distinct names are compared once."""
    columns = ["name", "sorted", "letters", "n", "sn"]
    together = large.groupBy("name").agg(*[F.first(c).alias(c) for c in columns[1:]]).withColumns({"size": F.lit(count), "_all": F.lit(0)})
    pairs = kept(_variants_of(_tiled(together, ["_all"], "name", columns).where(_close()).drop("_all", "row", "column")), "pooled-variants")
    there = large.where(F.col("n") >= 4).select("village", F.col("name").alias("a")).join(pairs, "a")
    named = there.join(large.select("village", F.col("name").alias("b"), F.col("first.id").alias("other_id")), ["village", "b"])
    chosen = named.groupBy("village", "a").agg(F.slice(F.array_sort(F.collect_list(F.struct("other_id", "score"))), 1, first).alias("o"))
    return _answers(chosen.select("village", "a", F.inline("o")).join(
        large.select("village", F.col("name").alias("b"), F.col("first.id").alias("other_id")), ["village", "other_id"]), large, first)


def _near_pairs(asking: DataFrame, answering: DataFrame) -> DataFrame:
    """(village, a, b, score): each name of ``asking`` with its variants among ``answering``, by enumeration in the village.

    Lengths, letters and bounded Levenshtein distances decide in the join which pairs are scored; all are exact filters (the
    Levenshtein distance is never above the Indel distance). ``answering`` is short per (village, salt), which spreads a
    large village over tasks.
    """
    x, y = asking.alias("x"), answering.alias("y")
    on = (F.col("x.village") == F.col("y.village")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.name") != F.col("y.name"))
    pairs = x.join(y, on & _close()).select(
        F.col("x.village").alias("village"), F.col("x.name").alias("a"), F.col("y.name").alias("b"),
        F.col("x.sorted").alias("a_sorted"), F.col("y.sorted").alias("b_sorted"))
    score = variant_score_udf(PARTIAL_WEIGHT, VARIANT_LOW)
    scored = pairs.select("village", "a", "b", score("a", "b", "a_sorted", "b_sorted").alias("score"))
    return scored.where((F.col("score") >= VARIANT_LOW - EPS) & (F.col("score") < VARIANT_HIGH - EPS))


def _answers(pairs: DataFrame, names: DataFrame, first: int) -> DataFrame:
    """(village, name, answers): the first variants of each name by record id, at most ``first``."""
    named = pairs.join(names.select("village", F.col("name").alias("b"), "first"), ["village", "b"])
    rows = F.struct(F.col("first.id").alias("other_id"), "score", F.col("first.record_id").alias("other_record"),
                    F.col("first.owner").alias("other_owner"))
    return (named.groupBy("village", F.col("a").alias("name"))
            .agg(F.slice(F.array_sort(F.collect_list(rows)), 1, first).alias("answers")))


def owner_variants(records: DataFrame, first: int = 3) -> DataFrame:
    """Per (village, name): the first variants by record id, as (rank, score, other owner and record).

    Names of a village answer in order of their first records. The names of a large village ask the first of PREFIXES
    answers, then those that still lack some ask up to the next, and so on; who lacks some in the end asks all others,
    through segments. The result is that of asking all names, while the pairs of a large village are not enumerated. Where
    large villages share so many names that it is less work, their distinct names are compared once for all of them.
    """
    spark = records.sparkSession
    names = kept(_village_names(records).withColumns({
        "letters": letters_of(F.regexp_replace("name", r"\s+", "")), "n": F.length("name"), "sn": F.length("sorted")}), "variant-names")
    parts = [2.0 ** -k for k in range(1, 31)]
    cuts = names.groupBy("village").agg(
        F.count("*").alias("size"), F.percentile_approx("first.id", parts, 100_000).alias("ids"))

    def cut(prefix: int) -> Column:                      # the id of about the prefix-th name; any id is right
        k = F.floor(F.log2(F.col("size") / prefix)).cast("int")
        return F.when(k >= 1, F.get("ids", F.least(k, F.lit(len(parts))) - 1))

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = [f"mark_{i}" for i in range(len(PREFIXES))]
    sizes = cuts.select("village", "size", *[cut(p).alias(m) for p, m in zip(PREFIXES, marks)])
    sized = names.join(sizes, "village")
    few = sized.where(F.col("size") <= PREFIXES[0])
    met = _tiled(few, ["village"], "name", ["name", "sorted", "letters", "n", "sn"]).where(_close()).drop("row", "column")
    small = _answers(_variants_of(met).where(F.length("a") >= 4), names, first)
    placed = sized.where(F.col("size") > PREFIXES[0])
    work = placed.agg(F.count("*").alias("names"), F.approx_count_distinct("name").alias("distinct")).first()
    if not work["names"]:
        return _ranked(small)
    if work["distinct"] <= LARGE_SCOPE and work["distinct"] ** 2 <= work["names"] * PREFIXES[min(1, len(PREFIXES) - 1)]:
        return _ranked(small.unionByName(_pooled_answers(kept(placed.select(*names.columns), "large-names"), work["distinct"], first)))
    placed = placed.withColumn("salts", F.when(F.col(marks[0]).isNull(), 1).otherwise(width))
    asking = placed.where(F.col("n") >= 4).withColumn("salt", F.pmod(F.hash("name"), F.col("salts")))
    at, salts = F.col("first.id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    found = None
    for low, high in zip([None, *marks], [*marks, None]):
        asked, lacking = placed, asking
        if low:                                          # villages with names beyond the last mark, names that lack answers
            asked = placed.where(at > F.col(low))
            if not asked.head(1):
                break
            lacking = asking.where(F.col(low).isNotNull()).join(
                found.where(F.size("answers") >= first).select("village", "name"), ["village", "name"], "left_anti")
        if high:
            asked = asked.where(F.col(high).isNull() | (at <= F.col(high)))
            pairs = _near_pairs(lacking, asked.select("village", "name", "sorted", "letters", "n", "sn", salts))
        else:
            pairs = _indexed_pairs(lacking, asked)
        more = _answers(pairs, names, first)
        if found is not None:
            more = found.unionByName(more).groupBy("village", "name").agg(
                F.slice(F.array_sort(F.flatten(F.collect_list("answers"))), 1, first).alias("answers"))
        found = kept(more, "variants")
    return _ranked(small.unionByName(found))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("village", "name", F.posexplode("answers").alias("rank", "o")).select(
        "village", "name", (F.col("rank") + 1).alias("rank"), "o.score", "o.other_id", "o.other_record", "o.other_owner")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written once under the checkpoint folder and read from there."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def _indexed_pairs(asking: DataFrame, answering: DataFrame) -> DataFrame:
    """As ``_near_pairs``, with candidates from shared segments: for few names that ask and many that may answer."""
    def candidates(find, text: str, floor: float) -> DataFrame:
        one, other = (t.select("village", text).distinct() for t in (asking, answering))
        there = find(one, ["village"], text, floor, other).select("village", "a", "b")
        back = find(other, ["village"], text, floor, one).select("village", F.col("b").alias("a"), F.col("a").alias("b"))
        return there.unionByName(back).distinct()

    x = asking.select("village", F.col("name").alias("a"), F.col("sorted").alias("a_sorted"))
    y = answering.select("village", F.col("name").alias("b"), F.col("sorted").alias("b_sorted"))
    window = candidates(window_candidates, "name", VARIANT_LOW / PARTIAL_WEIGHT)
    whole = candidates(whole_candidates, "sorted", VARIANT_LOW).select("village", F.col("a").alias("a_sorted"), F.col("b").alias("b_sorted"))
    whole = whole.join(x, ["village", "a_sorted"]).join(y, ["village", "b_sorted"]).select("village", "a", "b")
    pairs = window.unionByName(whole).distinct().where("a <> b").join(x, ["village", "a"]).join(y, ["village", "b"])
    score = variant_score_udf(PARTIAL_WEIGHT, VARIANT_LOW)
    scored = pairs.select("village", "a", "b", score("a", "b", "a_sorted", "b_sorted").alias("score"))
    return scored.where((F.col("score") >= VARIANT_LOW - EPS) & (F.col("score") < VARIANT_HIGH - EPS))


# ------------------------------------------------------------------ duplicate scan
def duplicate_scan_counts(records: DataFrame) -> DataFrame:
    """Whole-table duplicate scan: (id, type, severity, n) with n other records per type.

    Types: duplicate_khasra / repeat_digitisation (same khasra, owner similarity below / from .92),
    duplicate_survey, owner_name_variant (token-sorted similarity in [.80, .98) inside a village).
    """
    base = records.select("id", "khasra_no", "survey_no", "village", F.trim("owner_name").alias("owner"),
                          token_sort(F.col("owner_name")).alias("sorted"))
    with_khasra = base.where(is_set(F.col("khasra_no")))
    k_names = kept(with_khasra.groupBy("khasra_no", "sorted").agg(F.count("*").alias("n")), "khasra-names")
    k_totals = k_names.groupBy("khasra_no").agg(
        F.sum("n").alias("total"), F.count(F.when(F.col("sorted") != "", 1)).alias("n_names"))
    crowded = k_names.join(k_totals.where("n_names > 1"), "khasra_no", "left_semi")
    near = (similar_names(crowded, ["khasra_no"], SAME_OWNER_SIMILARITY)
            .join(k_names.withColumnRenamed("sorted", "b"), ["khasra_no", "b"])
            .groupBy("khasra_no", F.col("a").alias("sorted")).agg(F.sum("n").alias("near_n")))
    per_name = k_names.join(k_totals, "khasra_no").join(near, ["khasra_no", "sorted"], "left")
    same = F.when(F.col("sorted") != "", F.col("n") - 1 + F.coalesce("near_n", F.lit(0))).otherwise(F.lit(0))
    khasra = (with_khasra.join(per_name, ["khasra_no", "sorted"])
              .select("id", F.inline(F.array(
                  F.struct(F.lit("duplicate_khasra").alias("type"), F.lit("critical").alias("severity"),
                           (F.col("total") - 1 - same).alias("n")),
                  F.struct(F.lit("repeat_digitisation").alias("type"), F.lit("medium").alias("severity"),
                           same.alias("n"))))))
    s_totals = base.where(is_set(F.col("survey_no"))).groupBy("survey_no").agg(F.count("*").alias("total"))
    survey = (base.where(is_set(F.col("survey_no"))).join(s_totals, "survey_no")
              .select("id", F.lit("duplicate_survey").alias("type"), F.lit("high").alias("severity"),
                      (F.col("total") - 1).alias("n")))
    named = base.where(is_set(F.col("village")) & (F.col("sorted") != ""))
    v_names = kept(named.groupBy("village", "sorted").agg(F.count("*").alias("n")), "village-names")
    v_counts = (similar_names(v_names, ["village"], VARIANT_LOW, VARIANT_HIGH)
                .join(v_names.withColumnRenamed("sorted", "b"), ["village", "b"])
                .groupBy("village", F.col("a").alias("sorted")).agg(F.sum("n").alias("n")))
    variants = named.join(v_counts, ["village", "sorted"]).select(
        "id", F.lit("owner_name_variant").alias("type"), F.lit("medium").alias("severity"), "n")
    return khasra.unionByName(survey).unionByName(variants).where("n > 0")


def duplicates_of(records: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every duplicate of the named subject records, one row per other record (report form).

    ``subjects`` has the record columns and is meant to be short (the records on screen).
    """
    s = subjects.select(F.col("id").alias("subject_id"), F.col("record_id").alias("subject"),
                        F.col("khasra_no").alias("s_khasra"), F.col("survey_no").alias("s_survey"),
                        F.col("village").alias("s_village"), token_sort(F.col("owner_name")).alias("s_sorted"))
    o = records.select("id", "record_id", "khasra_no", "survey_no", "village", "owner_name",
                       token_sort(F.col("owner_name")).alias("o_sorted"))

    def joined(on: Column) -> DataFrame:
        return (s.join(o, on & (F.col("id") != F.col("subject_id")))
                .withColumn("similarity", ratio_of_sorted("s_sorted", "o_sorted")))

    def shaped(df: DataFrame, kind: Column, identifier: Column, severity: Column, with_score=True) -> DataFrame:
        score = F.round("similarity", 3) if with_score else F.lit(None).cast("double")
        return df.select("subject", kind.alias("type"), identifier.alias("identifier"), "record_id",
                         F.col("owner_name").alias("owner"), score.alias("similarity"), severity.alias("severity"))

    close = F.col("similarity") >= SAME_OWNER_SIMILARITY - EPS
    khasra = shaped(joined((F.col("s_khasra") == F.col("khasra_no")) & is_set(F.col("s_khasra"))),
                    F.when(close, "repeat_digitisation").otherwise("duplicate_khasra"),
                    F.concat(F.lit("khasra "), "s_khasra"), F.when(close, "medium").otherwise("critical"))
    survey = shaped(joined((F.col("s_survey") == F.col("survey_no")) & is_set(F.col("s_survey"))),
                    F.lit("duplicate_survey"), F.concat(F.lit("survey "), "s_survey"), F.lit("high"), False)
    near = joined((F.col("s_village") == F.col("village")) & is_set(F.col("s_village")) & (F.col("s_sorted") != ""))
    near = near.where((F.col("similarity") >= VARIANT_LOW - EPS) & (F.col("similarity") < VARIANT_HIGH - EPS))
    variant = shaped(near, F.lit("owner_name_variant"), F.col("owner_name"), F.lit("medium"))
    return khasra.unionByName(survey).unionByName(variant)
