"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import documents
from terralith.llm.exact_dedup import exact_groups
from terralith.llm.fingerprints import with_edits
from terralith.llm.kmeans_tree import search
from terralith.llm.license_scan import scan
from terralith.llm.mixing import DIGITS, SEED, mix
from terralith.llm.ngram_join import near_groups
from terralith.llm.periodic_runs import digests, periodic_runs, with_repeats_planted
from terralith.llm.quality import THRESHOLD, fit, is_held_out, score
from terralith.llm.sentencepiece_nbest import encode
from terralith.llm.substring_dedup import remove_repeated_windows
from terralith.llm.suffix_dedup import remove_repeated_bytes
from terralith.llm.token_alignment import aligned_with_counts
from terralith.llm.token_counts import document_tokens


#: Target shares: the largest source of a crawl is held down, the others share evenly.
MIX_WEIGHTS = {f"src{i}": 2.0 if i == 0 else 1.0 for i in range(20)}
#: Any other source that is found, and a null one, weighs as much as most of those named.
OTHER_WEIGHT = 1.0


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.size("ids").alias("n_pieces"), "nbest_scores", "nbest_ids", "ids", "round_trip")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), MIX_WEIGHTS, default=OTHER_WEIGHT)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), shingle=3, similarity=(9, 10)).select(
        "doc_id", "n_shingles", "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_with_counts(documents(spark, sf_dir)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_repeats_planted(documents(spark, sf_dir))))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_mix_sources, op3_ngram_join, op4_license_scan, op5_exact_dedup, op6_substring_dedup,
    op7_token_counts, op8_fingerprints, op9_quality, op10_suffix_dedup,
    op11_nearest_vectors, op12_token_alignment, op13_periodic_runs)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_mix_sources": f"""
WITH RECURSIVE weights AS (
  SELECT 'src' || i AS source, CASE WHEN i = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM range(20) r(i)),
sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents JOIN weights USING (source) GROUP BY source),
rates AS (
  SELECT source, w / (SELECT sum(w) FROM weights JOIN sizes USING (source)) * (SELECT sum(n) FROM sizes) / n AS r
  FROM sizes JOIN weights USING (source)),
steps AS (
  SELECT source, k, sum(exp(k * ln(r) - r - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, range(0, 200) t(k)),
drawn AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id), 1, {DIGITS}))::BIGINT / 16.0::DOUBLE ** {DIGITS} AS u
  FROM documents),
counted AS (
  SELECT doc_id, count(*) AS n FROM drawn JOIN steps USING (source) WHERE u >= p GROUP BY doc_id)
SELECT documents.*, c::INT AS copy, md5('{SEED}:' || doc_id || ':' || c) AS shuffle_key
FROM documents JOIN counted USING (doc_id), range(0, n) t(c)""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)""",
    "op6_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
each AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 399)) AS p, x FROM b WHERE len(x) >= 800),
h AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS h FROM s),
r AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
f AS (SELECT doc_id, p, p > coalesce(max(p + 400) OVER (
  PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM r),
k AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f),
runs AS (SELECT doc_id, k, min(p) AS a, max(p) + 400 AS z FROM k GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, k, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, a AS z, z - a AS n FROM runs),
cut AS (
  SELECT doc_id, sum(n) AS removed, count(*) AS n_spans, max(gaps.z + n) AS last,
    string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY k) AS kept FROM gaps JOIN b USING (doc_id)
  GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)""",
}
