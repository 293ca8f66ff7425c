import random
import re

import xxhash
from conftest_rows import ODD

from verbaline.llm import simhash


def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    pieces = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, most):
    ids = sorted(prints, key=lambda i: (i is None, i))
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if bin(prints[a] ^ prints[b]).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_all_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text, 3) for r in docs.collect()}
    want = plain_classes(prints, 2)
    got = simhash.op6(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(prints)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_lose_nothing(spark):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    fps = {0, 1, 3, 7} | set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for _ in range(rnd.randrange(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for most in (0, 1, 2):
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= most}
        assert got == want


def test_odd_rows(docs_of):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(ODD), shingle=3).collect()}
    assert got[1].fp == got[2].fp == got[3].fp == 0 and got[3].component_id == 1
    assert got[5].component_id == 4 and got[7].component_id == 7
    assert simhash.near_duplicates(docs_of(ODD), shingle=3).count() == len(ODD)
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.near_duplicates(docs_of([(None, "a b", "s"), (None, "a b", "s")])).where("component_id is null").count() == 2


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stage_catches_copies_and_leaves_the_rest(spark, docs_of):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, i = [], 0
    for _ in range(40):
        text = [word() for _ in range(300)]
        rows.append((i, " ".join(text), "a"))
        for k in range(5):
            copy = list(text)
            for _ in range(k):
                copy[rnd.randrange(300)] = word()
            rows.append((i + k + 1, " ".join(copy), "a"))
        i += 6
    rows += [(10000 + k, " ".join(word() for _ in range(100)), "b") for k in range(100)]
    docs = docs_of(rows)
    out = simhash.stage(spark, docs, "")
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and {10000 + k for k in range(100)} <= kept and {6 * g for g in range(40)} <= kept
    text = {i: t for i, t, _ in rows}
    missed = [i for i in kept if i < 10000 and i % 6 and similarity(text[i], text[i // 6 * 6]) >= 0.8]
    assert len(missed) <= 10  # of 200; two bits alone would leave most
    odd = simhash.stage(spark, docs_of(ODD), "").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in odd if r.doc_id in (1, 2, 3, 4, 5)) == [(False, 1), (False, 4)]


def test_stage_misses_no_pair_at_the_threshold(spark, docs_of):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(300):
        text = [word() for _ in range(rnd.randrange(60, 200))]
        copy = list(text)
        while similarity(" ".join(text), " ".join(copy)) > 0.9:
            copy[rnd.randrange(len(copy))] = word()
        rows += [(2 * g, " ".join(text), "a"), (2 * g + 1, " ".join(copy), "a")]
    need = {2 * g + 1 for g in range(300) if similarity(rows[2 * g][1], rows[2 * g + 1][1]) >= 0.8}
    kept = {r.doc_id for r in simhash.stage(spark, docs_of(rows), "").collect()}
    assert len(need) > 200 and not need & kept and kept == {r[0] for r in rows} - need


def test_stage_tells_equal_and_null_ids_apart(spark, docs_of):
    rnd = random.Random(9)
    text = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(40)) for _ in range(6)]
    rows = [(1, text[0], "a"), (1, text[1], "a"), (1, text[1], "a"), (2, text[2], "a"), (None, text[2], "a"), (None, text[3], "a"), (None, text[4], "a"), (None, text[4], "a"), (None, text[5], "a")]
    out = sorted((r.text, r.doc_id) for r in simhash.stage(spark, docs_of(rows), "").collect())
    assert out == sorted([(text[0], 1), (text[1], 1), (text[2], 2), *((t, None) for t in text[3:])])


def test_joined_equals_brute_force_on_hubs_and_shared_passages(spark, docs_of):
    """Altered copies of one text that are like it but not like each other, and texts that share a passage but are unlike."""
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base, passage, texts = [word() for _ in range(150)], [word() for _ in range(90)], []
    texts.append(" ".join(base))
    for _ in range(60):
        copy = list(base)
        for _ in range(rnd.randrange(1, 6)):
            copy[rnd.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(rnd.randrange(15, 40)))]) for _ in range(60)]
    root = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    keyed = docs_of([(i, t, "a") for i, t in enumerate(texts)]).selectExpr("doc_id AS key", "text")
    roots = simhash.written(keyed.selectExpr("key", "key AS root"), "roots")
    got = {r.key: r.root for r in simhash.joined(keyed, roots, 5, 0.8).collect()}
    assert got == dict(enumerate(root)) and 30 < len(set(root)) < 100 and len(near) < 120 * 119 / 4


def test_few_pairs_are_compared_in_dense_lists(spark, docs_of, monkeypatch):
    """Texts of 18 out of 26 words, whose lists of rare shingles hold most texts: few pairs reach the comparison of whole sets."""
    compared, plain = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, sets, least: compared.append(pairs.count()) or plain(pairs, sets, least))
    for n in (300, 900):
        rnd = random.Random(11)
        texts = list({" ".join(sorted(rnd.sample("abcdefghijklmnopqrstuvwxyz", 18))) for _ in range(n)})
        keyed = docs_of([(i, t, "a") for i, t in enumerate(texts)]).selectExpr("doc_id AS key", "text")
        roots = simhash.written(keyed.selectExpr("key", "key AS root"), "roots")
        compared.clear()
        got = {r.key: r.root for r in simhash.joined(keyed, roots, 1, 0.8).collect()}
        sets = [set(t.split()) for t in texts]
        root = list(range(len(texts)))
        near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 16]
        while any(root[i] != root[j] for i, j in near):
            for i, j in near:
                root[i] = root[j] = min(root[i], root[j])
        assert got == dict(enumerate(root)) and compared[-1] <= 2 * len(near) + len(texts)


def test_a_group_of_copies_costs_a_row_a_task(spark, docs_of):
    text = " ".join("abcdefghij"[i % 7] * (i % 5 + 1) + str(i) for i in range(60))
    docs = docs_of([(i, text, "a") for i in range(2000)] + [(5000, text + " more", "a")]).repartition(4)
    keyed = docs.selectExpr("named_struct('hi', xxhash64(text), 'lo', 0L) AS key", "text")
    rows = simhash.prefixes(keyed, 5, 0.8).groupBy("key", "token").count().agg({"count": "max"}).first()[0]
    assert rows <= 4
    assert [r.doc_id for r in simhash.stage(spark, docs, "").collect()] == [0]
