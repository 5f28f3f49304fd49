"""From raw documents to encoded training data, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last one adds the ids of the best segmentation, the
scores of the best ones, and whether decoding gives the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralith.config import tune
from terralith.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_nbest
from terralith.llm.common import documents, stored
from terralith.llm.queries import MIX_WEIGHTS, OTHER_WEIGHT


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of those that came in."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on runs of five words."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares of their sources, in shuffled order."""
    return mixing.mixed_rows(docs, MIX_WEIGHTS, default=OTHER_WEIGHT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces. Columns of docs with the names of the results give way to these."""
    return sentencepiece_nbest.encode(docs.drop(*(f.name for f in sentencepiece_nbest.FIELDS)))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The trained classifier and the pieces have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
