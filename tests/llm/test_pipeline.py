"""The pipeline against a plain version of its stages."""
import hashlib
from collections import Counter

import corpus_pipeline
from terralith.llm.mixing import poisson_steps
from terralith.llm.quality import THRESHOLD, fit
from terralith.llm.queries import MIX_WEIGHTS
from terralith.llm.sentencepiece_nbest import Vocabulary, decode
from tests.llm.test_dedup import low
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows, model = docs.collect(), fit(docs, labels)
    scores = model.score([(r.text or "").encode() for r in rows])
    good = [r for r, s in zip(rows, scores) if s >= THRESHOLD]
    last = {}
    for r in good:
        key = low(r.text)
        last[key] = max(last.get(key, -1), r.doc_id)
    once = [r for r in good if last[low(r.text)] == r.doc_id]
    groups = brute([(r.doc_id, r.text) for r in once], 5, 8, 10)
    kept = [r for r in once if groups[r.doc_id][1] == r.doc_id]
    n = Counter(r.source for r in kept if r.source in MIX_WEIGHTS)
    share, total, want = sum(MIX_WEIGHTS[s] for s in n), sum(n.values()), Counter()
    for r in kept:
        if r.source in n:
            steps = poisson_steps(MIX_WEIGHTS[r.source] / share * total / n[r.source])
            u = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16 ** 13
            want[r.doc_id] = sum(u >= c for c in steps)
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:len(docs.columns)] == docs.columns
    got, vocabulary = out.collect(), Vocabulary.load()
    assert Counter(r.doc_id for r in got) == +want and len(kept) < len(once) <= len(good) < len(rows)
    assert all(r.round_trip and decode(r.ids, vocabulary) == r.text for r in got)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
