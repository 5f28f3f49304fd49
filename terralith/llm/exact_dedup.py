"""Exact dedup by deterministic block naming.

Every text is cut into blocks of fixed size. The distinct blocks are sorted and numbered, so a block's name is an
integer. Adjacent names are paired, the distinct pairs are sorted and numbered again, and so on until each document
has one name: with the number of its blocks, its collision-free identity. All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import ascii_lower, numbered, stored

BLOCK_CHARS = 4096


def _blocks(text: Column, size: int) -> Column:
    """A text in blocks of `size` characters, cut in one pass; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _name_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of blocks (h, block), in the order (hash, content).

    One aggregation by hash keeps the smallest and largest content; where they agree, the hash stands for one block and
    its rank is the name. Where contents share a hash, the (hash, content) pairs are ranked instead.
    """
    by_hash = blocks.groupBy("h").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    by_hash = stored(_ranked(by_hash.select("h", (F.col("low") != F.col("high")).alias("clash")), "h"), "block-names")
    contents = blocks.join(by_hash.where("clash").select("h"), "h", "left_semi").distinct()
    return by_hash, contents


def _ranked(df: DataFrame, *order: str) -> DataFrame:
    """Distinct rows sorted and numbered from 1, in ranges, without one task seeing them all."""
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), "name").withColumn(
        "name", F.col("name") + 1)


def identities(df: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = (),
               block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of df: row_id, text_sha256, n_blocks, name, and the columns `keep`.

    Two rows have the same (n_blocks, name) exactly when their texts are equal after lower-casing A-Z, whatever
    `block_hash` is: it only orders the blocks. Null counts as empty. Repeated rows get a row each.
    """
    lowered = df.select(*keep, ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("__text")).select(
        *keep, F.sha2("__text", 256).alias("text_sha256"), _blocks(F.col("__text"), block_chars).alias("blocks"))
    names, clashing = _name_blocks(lowered.select(F.explode("blocks").alias("block")).select(
        block_hash(F.col("block")).alias("h"), "block"))
    rows = stored(numbered(lowered.select(*keep, "text_sha256", F.size("blocks").alias("n_blocks"), F.transform(
        "blocks", lambda b: block_hash(b)).alias("hashes"))), "block-rows")
    placed = rows.select("row_id", "text_sha256", F.posexplode("hashes").alias("place", "h")).join(names, "h")
    level = placed.where("NOT clash").select("row_id", "place", "name")
    if not names.where("clash").isEmpty():
        # Different blocks with one hash: named by content, below zero, so that they differ from all others.
        exact = stored(_ranked(clashing, "h", "block"), "clashing-names")
        contents = lowered.select("text_sha256", F.posexplode("blocks").alias("place", "block")).select(
            "text_sha256", "place", "block", block_hash(F.col("block")).alias("h")).join(exact, ["h", "block"]).select(
            "text_sha256", "place", (-F.col("name")).alias("name")).distinct()
        level = level.unionByName(placed.where("clash").select("row_id", "text_sha256", "place").join(
            contents, ["text_sha256", "place"]).select("row_id", "place", "name"))
    level, height = stored(level, "level"), rows.agg(F.max("n_blocks")).first()[0] or 1
    while height > 1:
        level, height = _next_level(level), -(-height // 2)
    return rows.drop("hashes").join(level.select("row_id", "name"), "row_id")


def _next_level(level: DataFrame) -> DataFrame:
    """Adjacent names become pairs, distinct pairs get names; a last name without partner is paired with nothing."""
    half = F.floor(F.col("place") / 2)
    pairs = level.groupBy("row_id", half.alias("place")).agg(
        F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"))
    pairs = stored(pairs, "pairs")
    names = stored(_ranked(pairs.select("left", "right").distinct(), "left", "right"), "pair-names")
    return stored(pairs.join(names, ["left", "right"]).select("row_id", "place", "name"), "level")


def exact_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept (a null doc_id is smaller than any); of rows that repeat
    doc_id and text, exactly one. An empty table gives no rows; other columns are ignored.
    """
    named = identities(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", block_chars,
                       keep=("doc_id",))
    best = named.groupBy("n_blocks", "name").agg(
        F.max_by("row_id", F.struct("doc_id", "row_id")).alias("keep_row"), F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"))
    return named.join(best, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """df with one row of each group of equal texts, the one that `exact_groups` keeps; its columns may have any names."""
    groups = exact_groups(df, text, doc_id, block_chars)
    keys = groups.where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    repeats = groups.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("__n")).where("__n > 1").select(
        F.col("doc_id").alias("__id2"), F.col("text_sha256").alias("__sha2"), "__n")
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)
    marked = df.select(F.struct(*df.columns).alias("row"), F.col(doc_id).alias("__own"), sha.alias("__s")).join(
        keys, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__s") == F.col("__sha")), "left_semi").join(
        repeats, F.col("__own").eqNullSafe(F.col("__id2")) & (F.col("__s") == F.col("__sha2")), "left")
    once = marked.where(F.col("__n").isNull())
    several = marked.where(F.col("__n").isNotNull()).dropDuplicates(["__id2", "__sha2"])
    return once.unionByName(several).select("row.*")
