import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_rows import ODD
from tokenizers import Tokenizer

from verbaline.llm import packing


def used(runs):
    out = Counter()
    for n, items in runs:
        assert n > 0 and sum(a * m for a, m in items) <= 1024
        for a, m in items:
            out[a] += n * m
    return out


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rnd = random.Random(seed)
    c = Counter(min(1024, int(rnd.lognormvariate(5.5, 1)) + 1) for _ in range(4000))
    runs = packing.plan(dict(c), groups=40)
    assert used(runs) == c
    n, least = sum(n for n, _ in runs), max(sum(v for k, v in c.items() if k > 512), -(-sum(k * v for k, v in c.items()) // 1024))
    assert n <= 1.02 * least + 1


def test_plan_of_few():
    assert packing.plan({}) == [] and used(packing.plan({1: 1})) == {1: 1} and used(packing.plan({1024: 3, 600: 1, 424: 1, 2: 5})) == {1024: 3, 600: 1, 424: 1, 2: 5}
    assert sum(n for n, _ in packing.plan({512: 1000})) == 500
    with pytest.raises(ValueError, match="capacity"):
        packing.plan({1025: 1})


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = {i: [*e.ids, 2] for i, e in zip(texts, tok.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    p = packing.op3(spark, sf).toPandas()
    for i, g in p.sort_values("piece").groupby("doc_id"):
        assert g.piece.tolist() == list(range(len(g))) and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids[i])
        assert (g.length.iloc[1:] == 1024).all() and g.length.iloc[0] <= 1024
        assert all(zlib.crc32(np.array(ids[i][s : s + n], "<u4").tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    least = max((p.length > 512).sum(), -(-p.length.sum() // 1024))
    assert p.sequence_id.nunique() <= 1.01 * least and p.sequence_id.nunique() == p.sequence_id.max() + 1


def test_odd_rows(docs_of):
    p = packing.pack(packing.pieces(docs_of(ODD))).collect()
    empty = [r for r in p if r.doc_id in (1, 2)]
    assert [r.length for r in empty] == [1, 1] and all(bytes(r.ids) == (2).to_bytes(4, "little") for r in empty)
    assert sum(r.doc_id == 5 for r in p) == 2 and any(r.doc_id is None for r in p)
    places = {(r.sequence_id, r.offset) for r in p}
    assert len(places) == len(p)
    assert packing.pack(packing.pieces(docs_of([]))).count() == 0


def test_added_token(spark, docs_of):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>\n<|endoftext|><|endoftext|>é  \n", "<|endoftext| >", " <|endoftext|" + "x" * 3000 + "<|endoftext|>", None]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.pieces(docs_of([(i, t, "a") for i, t in enumerate(texts)])).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
