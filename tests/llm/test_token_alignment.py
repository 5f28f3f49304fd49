"""Alignment and pair counts against the tokenizers on whole texts and plain loops."""
import hashlib
from collections import Counter, defaultdict
from dataclasses import replace

from terralith.llm import token_alignment as ta
from terralith.llm.queries import op12_token_alignment

SF = "/root/testdata/sf0.001"


def plain(texts):
    """For each text: ids of A, of B, groups as pairs of lists; from whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(ta.MODEL_A), SentencePieceProcessor(model_file=ta.MODEL_B)
    a.encode_special_tokens = True
    letters = ta.byte_letters()
    out = []
    for text in texts:
        if not text:
            out.append([])
            continue
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x = [bytes(letters[c] for c in a.id_to_token(i)) for i in left]
        y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
             for i in right]
        raw = b" " + text.encode()
        if b"".join(x) != raw or b"".join(y) != raw:
            out.append([])
            continue
        ends = []
        for z in (x, y):
            at, places = 0, []
            for t in z:
                at += len(t)
                places.append(at)
            ends.append(places)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for cut in cuts:
            m, n = i, j
            while m < len(left) and ends[0][m] <= cut:
                m += 1
            while n < len(right) and ends[1][n] <= cut:
                n += 1
            groups.append((left[i:m], right[j:n]))
            i, j = m, n
        out.append(groups)
    return out


def expected(texts):
    every = plain(texts)
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for groups in every]
    docs = Counter(pair for each in links for pair in each)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for groups, each in zip(every, links):
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(each.values()),
                    sum(n for p, n in each.items() if docs[p] == most[p[0]]),
                    sum(n * docs[p] for p, n in each.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["The café  \n\tis  open ", None, "", " ", "  ", "a ", "\n", "\n \n x", "x　 y", "x\x1c y", "a▁b", "<|endoftext|> <s>",
       "\U0001F600\x00 ñ 東京都", "word " * 3000, "=" * 5000 + " " + "ab" * 4000, "The café  \n\tis  open ", "don't 123456 ünïcödé",
       "<0x41> ▁", "  a  b", "tail\n", "tail \n", "1 000 000"]


def test_odd_texts_equal_whole_text_tokenizers(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string")
    want = expected(ODD)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.aligned_with_counts(df).collect()}
    assert [got[i] for i in range(len(ODD))] == want and want[10] == (0,) * 6 + ("",)
    assert ta.aligned_with_counts(df.limit(0)).count() == 0


def test_both_encoders_of_the_byte_level_side_agree():
    models = ta.Models.load()
    assert models.ranked
    fast, plain = ta.Aligner(models), ta.Aligner(replace(models, ranked=False))
    units = [" " + u for t in ODD if t for u in fast.units(t)]
    assert fast.encode_a(units) == plain.encode_a(units)
    assert [fast.places(fast.units(t)).tolist() for t in ODD if t] == [plain.places(plain.units(t)).tolist() for t in ODD if t]
    assert fast.groups == plain.groups


def test_ids_may_repeat_or_be_null(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one three")], "k int, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in ta.aligned_with_counts(df, doc_id="k").collect())
    assert got == sorted(expected(["one two", "one two", "one three"]))


def test_remembered_spellings_can_be_forgotten(spark, monkeypatch):
    texts = [f"text number {i} of łańcuch" for i in range(40)]
    aligner = ta.Aligner(ta.Models.load())
    first = aligner.places(aligner.units(texts[0]))
    aligner.forget()
    assert aligner.places(aligner.units(texts[0])).tolist() == first.tolist()
    assert aligner.places(aligner.units(texts[1])).tolist()[:2] == first.tolist()[:2]


def test_query_equals_whole_text_tokenizers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in docs), expected([r.text for r in docs])))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op12_token_alignment(spark, SF).collect()} == want
