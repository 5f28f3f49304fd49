"""Quality, fingerprints, mixing and licences."""
import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralith.llm.fingerprints import SAMPLES, _unit, fingerprints, likeness, with_edits
from terralith.llm.license_scan import rules, scan
from terralith.llm.mixing import mix, poisson_steps, rates
from terralith.llm.quality import fit, is_held_out, keep_good, score
from terralith.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).join(labels, "doc_id").where(
        is_held_out(F.col("doc_id"))).select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in scored)
    good, bad = [r.score for r in scored if r.quality], [r.score for r in scored if not r.quality]
    assert sum(s >= 0.3 for s in good) >= 0.98 * len(good) and sum(s < 0.3 for s in bad) >= 0.8 * len(bad)
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good plain text", 1), (2, None, 2), (3, "", 3), (None, "x", None), (3, "", 3)],
                                 "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    nothing = fit(docs, labels.limit(0))
    assert {r.score for r in score(docs, nothing).collect()} == {0.5}
    assert score(docs.limit(0), model).count() == 0
    assert keep_good(docs, labels).columns == docs.columns
    with pytest.raises(ValueError):
        score(docs, model, into="label")


def generalised_jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / max(1, sum(max(a[w], b[w]) for w in words))


def test_fingerprints_estimate_generalised_jaccard(spark):
    pairs = []
    for i in range(60):
        left = [f"{i}w{(i * 7 + k * k) % 50}" for k in range(80)]     # words of its own: independent errors
        right = left[: 80 - i] + [f"{i}v{k}" for k in range(i)]
        pairs.append((i, " ".join(left), " ".join(right)))
    flat = [(2 * i, a) for i, a, _ in pairs] + [(2 * i + 1, b) for i, _, b in pairs]
    made = {r.doc_id: r.fingerprint for r in fingerprints(
        spark.createDataFrame(flat, "doc_id long, text string"), samples=64).collect()}
    rows = spark.createDataFrame([(i, made[2 * i], made[2 * i + 1]) for i, _, _ in pairs], "i int, a string, b string")
    near = {r.i: r.n for r in rows.select("i", likeness(F.col("a"), F.col("b"), 64).alias("n")).collect()}
    error = [near[i] - generalised_jaccard(a, b) for i, a, b in pairs]
    print('mean error', sum(error) / len(error), 'largest', max(map(abs, error)))
    assert near[0] == 1.0 and abs(sum(error) / len(error)) < 0.03 and max(map(abs, error)) < 0.25


def test_fingerprints_at_the_default_keep_their_error_bound(spark):
    """Root mean square error of 300 independent pairs below 0.06 (expected 0.049 at 64 samples, 0.08 at 24)."""
    pairs = []
    for i in range(300):
        left, k = [f"{i}w{j % 50}" for j in range(80)], i % 60 + 10
        pairs.append((" ".join(left), " ".join(left[:80 - k] + [f"{i}v{j}" for j in range(k)])))
    flat = [(2 * i + side, text) for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    made = {r.doc_id: r.fingerprint for r in fingerprints(
        spark.createDataFrame(flat, "doc_id long, text string")).collect()}
    rows = spark.createDataFrame([(i, made[2 * i], made[2 * i + 1]) for i in range(300)], "i int, a string, b string")
    near = {r.i: r.n for r in rows.select("i", likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    errors = [near[i] - generalised_jaccard(a, b) for i, (a, b) in enumerate(pairs)]
    assert len(made[0]) == 8 * SAMPLES and abs(sum(errors) / 300) < 0.015
    assert (sum(e * e for e in errors) / 300) ** 0.5 < 0.06


def test_fingerprint_draws_are_fine(spark):
    draws = spark.range(200000).select(*(_unit(F.xxhash64("id"), part).alias(f"u{part}") for part in range(3)))
    distinct = draws.agg(*(F.countDistinct(c) for c in draws.columns)).first()
    assert min(distinct) > 180000


def test_edits_match_brute_force(spark):
    rows = [(10, "a b c d"), (7, None), (3, "É" * 9), (20, "x y"), (1, ""), (15, "x y"), (40, "w " * 20000)]
    extra = spark.createDataFrame([(d, t, 1, "s", True) for d, t in rows], "doc_id long, text string, bucket int, next string, guest boolean")
    got = {r.doc_id: r for r in with_edits(extra.repartition(3), samples=16).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[20].fingerprint == got[15].fingerprint and got[20].near_next == 1.0 and got[1].fingerprint == ""
    assert with_edits(extra.limit(0)).count() == 0
    repeated = extra.unionByName(extra).unionByName(spark.createDataFrame([(None, "n", 1, "s", True)], extra.schema))
    assert with_edits(repeated, samples=4).count() == 15


def test_mixing(spark):
    assert abs(sum(poisson_steps(2.5)[-1:]) - 1) < 1e-9 and poisson_steps(0.0) == []
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "b").when(
        F.col("id") % 7 == 0, F.lit(None)).otherwise("a").alias("source"), F.lit("t").alias("text"))
    weights = {"a": 1.0, "b": 3.0, "gone": 5.0, "none": 0.0}
    rate = rates(docs, weights)
    assert set(rate) == {"a", "b"}
    out = mix(docs, weights).collect()
    n, listed = Counter(r.source for r in out), docs.where("source IS NOT NULL").count()
    assert abs(n["b"] / len(out) - 0.75) < 0.03 and abs(len(out) - listed) < 0.06 * listed
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    per = Counter(r.doc_id for r in out)
    for r in docs.where("source = 'b'").collect()[:200]:
        u = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16 ** 13
        assert per[r.doc_id] == sum(u >= c for c in poisson_steps(rate["b"]))
    assert mix(docs.limit(0), weights).count() == 0 and mix(docs, {"gone": 1.0}).count() == 0
    with pytest.raises(ValueError):
        rates(docs, {"a": 0.0})


def test_sources_not_named_are_mixed_too(spark, tmp_path):
    source = F.when(F.col("id") % 5 == 0, "new").when(F.col("id") % 5 == 1, F.lit(None)).when(
        F.col("id") % 5 == 2, "src0").otherwise("src1")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit("t").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op2_mix_sources"](spark, str(tmp_path))
    staged = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert out.columns == [*docs.columns, "copy", "shuffle_key"] and staged.columns == docs.columns
    for mixed in (out, staged):
        n = Counter(r.source for r in mixed.collect())
        assert set(n) == {"new", None, "src0", "src1"} and abs(sum(n.values()) - 6000) < 400
        assert all(abs(n[s] / sum(n.values()) - w / 5) < 0.03 for s, w in (("src0", 2), ("src1", 1), ("new", 1), (None, 1)))
    large = poisson_steps(50000.0)
    assert 50000 < len(large) < 60000 and abs(large[-1] - 1) < 1e-6


def test_licence_base_phrases_match_brute_force(spark):
    rows = [(1, "Licensed under CC-BY; cc by cc by"), (2, None), (3, ""), (4, "all rights. Reserved! ALL RIGHTS RESERVED"),
            (5, "the GNU General\nPublic\tLicense, version 3"), (6, "occ byte général publiç"), (7, "x " * 30000 + "cc by"),
            (8, "Émit License expat license"), (9, "éall rights reserved")]
    df = spark.createDataFrame([(d, t, "l", 1) for d, t in rows], "doc_id long, text string, labels string, level int")
    for r in scan(df).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        found = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"),
                                                  ("all rights reserved", "reserved"))
                 for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(words) and r.n_base == len(found)
        assert (r.first_word, r.last_word) == (min(found)[0] if found else None, max(found)[0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert scan(df.limit(0)).count() == 0


def test_licence_rules_suppress_what_lies_inside(spark):
    assert len(rules()) > 200
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "Licensed under the Apache License, Version 2.0"), (3, "see MIT License file"),
            (4, "GNU General Public License, version 3 and the GNU General Public License")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "cc-by,cc-by-nc" and got[2].labels == "apache" and got[2].score == 0.85
    assert got[3].labels == "mit" and got[3].score == 0.65 and got[4].labels == "gpl,gpl-3"
