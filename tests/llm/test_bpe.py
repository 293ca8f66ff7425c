import hashlib
import random

import public_tokenizers
import pytest
from conftest_rows import ODD
from tokenizers import Tokenizer

from verbaline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def fuzzed(n=3000, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "Zb", "é", "ÿ", "ʼ", "ⅷ", "中", "😀", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "﻿", "'s", "'ll", "'LL", "'", "...", "9", "²", "½", "<|endoftext|>", "<", "|>", "_", "-", "http://x", "\x00", "\x7f"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_words_are_encoded_by_themselves(tok):
    texts = fuzzed() + [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}9 " for c in [*range(0xD800), *range(0xE000, 0x20000)]]
    words = [bpe.WORD.findall(t) for t in texts]
    assert all("".join(w) == t for w, t in zip(words, texts, strict=True))
    distinct = sorted({x for w in words for x in w})
    ids = dict(zip(distinct, (e.ids for e in tok.encode_batch(distinct, add_special_tokens=False)), strict=True))
    for t, w, e in zip(texts, words, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for x in w for i in ids[x]] == e.ids, t


@pytest.mark.parametrize("sent", [0, 50, bpe.SENT])
def test_against_tokenizers(spark, docs_of, tok, sent, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_DOCS", 40)
    rows = [(i, t, "s") for i, t in enumerate(fuzzed(400, 2))] + ODD + [(9, "wörter " * 20000 + "ab9" * 30000, "c")]
    got = bpe.encode_and_decode(docs_of(rows), sent_words=sent).collect()
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.text) for r in got) == sorted((i is None, i or 0, x, tok.decode(x, skip_special_tokens=False)) for i, x in want)


def test_decode_any_ids(spark, tok):
    rows = [(1, [0, 255, 50256, 200]), (1, [0, 255, 50256, 200]), (2, []), (3, None), (None, [13, 13])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"))
    assert sorted(bytes(r.piece).decode("utf-8", "replace") for r in got.collect()) == sorted(tok.decode(x or [], skip_special_tokens=False) for _, x in rows)
    with pytest.raises(Exception, match="no piece for id 60000"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")).collect()


def test_all_documents(spark, tok):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op11(spark, sf).collect())) == sorted(want)


def test_empty(spark, docs_of):
    assert bpe.encode_and_decode(docs_of([]).limit(0)).count() == 0
