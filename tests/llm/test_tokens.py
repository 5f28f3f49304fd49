"""Token files and SentencePiece segmentation against brute force."""
import numpy as np
import pytest

from terralith.llm.sentencepiece_nbest import Segmenter, Vocabulary, decode, decoded, encode
from terralith.llm.token_counts import END_OF_DOCUMENT, document_tokens, token_counts, write_token_files


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_over_block_boundaries(spark, tmp_path, block):
    rng, want = np.random.default_rng(4), set()
    for name in ("a.bin", "b.bin", "empty.bin", "open.bin"):
        lengths = [] if name == "empty.bin" else [0, 0, *rng.integers(0, 40, 25).tolist(), 0]
        ids = [np.append(rng.integers(0, 50000, n), END_OF_DOCUMENT) for n in lengths]
        flat = np.concatenate(ids).astype("<u2") if ids else np.empty(0, "<u2")
        if name == "open.bin":
            flat = np.append(flat, np.array([1, 2, 3], "<u2"))
            lengths.append(3)
        flat.tofile(tmp_path / name)
        at = 0
        for k, n in enumerate(lengths):
            want.add((name, k, at, n, not (name == "open.bin" and k == len(lengths) - 1)))
            at += n + 1
    got = token_counts(spark, str(tmp_path), block_bytes=block)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_written_files_hold_every_text(spark, tmp_path):
    import tiktoken  # noqa: F401
    texts = ["one two", None, "", "é\n\n" * 50, "<|endoftext|>", "x " * 30000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").coalesce(1)
    write_token_files(df, str(tmp_path / "t"))
    rows = sorted(token_counts(spark, str(tmp_path / "t"), block_bytes=1024).collect(), key=lambda r: r.doc_no)
    assert len(rows) == 6 and [r.n_tokens for r in rows][1:3] == [0, 0] and all(r.terminated for r in rows)
    assert rows[0].n_tokens == 2 and rows[4].n_tokens > 1 and rows[5].n_tokens >= 30000
    assert document_tokens(df.limit(0)).count() == 0


def test_width_must_fit(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a file"):
        token_counts(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        token_counts(spark, str(tmp_path), block_bytes=3)


def every_path(text, table, unknown, byte_ids):
    if not text:
        return [(0.0, ())]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in table:
            score, i = table[text[:n]]
            out += [(score + s, (i, *p)) for s, p in every_path(text[n:], table, unknown, byte_ids)]
    if text[0] not in table:
        ids = tuple(byte_ids[b] for b in text[0].encode())
        out += [(unknown + s, (*ids, *p)) for s, p in every_path(text[1:], table, unknown, byte_ids)]
    return out


def small_vocabulary():
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "ca"]
    scores = [-3.0, -2.0, -2.5, -4.0, -3.25, -3.5, -5.0, -2.75, -4.5, -9.0, -4.25]
    pieces = tuple(f"<0x{b:02X}>" for b in range(256)) + tuple(words)
    return Vocabulary(pieces, (0.0,) * 256 + tuple(scores), tuple(range(256)), tuple(range(256, 256 + len(words))))


def test_n_best_match_all_paths():
    v = small_vocabulary()
    s = Segmenter(v, n_best=5)
    table = {v.pieces[i]: (v.scores[i], i) for i in v.normal}
    for text in ["abc", "a b", "  abca bc", "éa", "a\nb", "abcabc", "\n", " ", "ab  c"]:
        want = sorted(every_path("▁" + text.replace(" ", "▁"), table, s.unknown, v.byte_ids), key=lambda x: -x[0])
        ids, scores = s.encode(text)
        assert np.allclose(scores, [x for x, _ in want[:5]])
        assert (scores[0], tuple(ids)) in [(x, p) for x, p in want]
        paths = s.encode_paths(text)
        assert np.allclose([x for x, _ in paths], scores) and paths[0][1] == ids.tolist()
        assert len({tuple(p) for _, p in paths}) == len(paths) and decode(ids.tolist(), v) == text


def test_encoding_round_trip(spark):
    texts = ["The café\n\tis  open ", None, "", "\U0001F600\x00 ñ", "a" * 20000, "word " * 20000, "plain"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    out = encode(df, n_best=3)
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.round_trip for r in rows.values()) and rows[1].ids == [] and rows[2].nbest_scores == []
    assert len(rows[0].nbest_scores) == 3 and rows[0].nbest_scores == sorted(rows[0].nbest_scores, reverse=True)
    assert {r.doc_id: r.decoded for r in decoded(out).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode(out)


def test_all_segmentations_come_with_their_ids(spark):
    texts = ["abca bc  ab", None, "", "The café\n is open", "a", "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = Vocabulary.load()
    s = Segmenter(v)
    for r in encode(df).collect():
        paths = s.encode_paths(r.text or "")
        assert r.nbest_ids == [] if not r.text else r.nbest_ids[0] == r.ids
        assert len(r.nbest_ids) == len(r.nbest_scores) == len(paths) == len(set(map(tuple, r.nbest_ids)))
        assert np.allclose(r.nbest_scores, [x for x, _ in paths])
        for ids, score in zip(r.nbest_ids, r.nbest_scores):
            assert decode(ids, v) == r.text and (r.text[:3] == "The" or np.isclose(sum(v.scores[i] for i in ids), score))
    v = small_vocabulary()
    table = {v.pieces[i]: (v.scores[i], i) for i in v.normal}
    s = Segmenter(v, n_best=6, remembered=1)
    for text in ["abc a", "a b", "  abca bc", "éa ab", "ab  c\nab"]:
        every = dict((p, x) for x, p in every_path("▁" + text.replace(" ", "▁"), table, s.unknown, v.byte_ids))
        for score, ids in s.encode_all([text])[0]:
            assert np.isclose(every[tuple(ids.tolist())], score)
