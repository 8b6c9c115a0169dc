import random

import pytest

from corpusloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [None, "", " ", "Hello  world's\n\n\tx", "<|endoftext|> is ordinary", "日本語のテキスト" * 40, "a" * 3000, "ab" * 2500, "😀👍🏽 naïve ß  　 \x1c\x1d y", "x = {1: 'y'}  # code\r\n"]


def texts():
    r = random.Random(4)
    span = [(32, 126), (160, 0x24F), (0x400, 0x4FF), (0x900, 0x97F), (0x3040, 0x30FF), (0x1F300, 0x1F64F), (9, 13)]
    return TEXTS + ["".join(chr(r.randint(*r.choice(span))) for _ in range(r.randint(1, 80))) for _ in range(300)]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_same_ids(spark, reference):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got == {i: reference(t) for i, t, _ in rows}
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_heap_agrees_with_matrices(reference, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 4)
    monkeypatch.setattr(bpe, "CACHE", 20)
    coder = bpe.NumpyBpe(open(bpe.VOCABULARY, "rb").read())
    for t in texts():
        ids, n = coder.encode([t, t])
        assert ids.tolist() == reference(t) * 2 and n.tolist() == [len(reference(t))] * 2


def test_empty_table_and_null_key(spark):
    s = "doc_id long, text string"
    assert bpe.encode_corpus(spark.createDataFrame([], s)).collect() == []
    assert [tuple(r) for r in bpe.encode_corpus(spark.createDataFrame([(None, None), (None, None)], s)).collect()] == [(None, []), (None, [])]
