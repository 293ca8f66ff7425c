import random
import zlib
from collections import Counter

import pytest
from compare import same, tables
from conftest_rows import ODD

from verbaline.llm import spelling


def edited(u, v):
    """By the definition: exactly one code point inserted, deleted or replaced."""
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(counts, ratio=5):
    near = {w: sorted((-counts[v], v) for v in counts if v != w and edited(w, v)) for w in counts}
    form = {w: x[0][1] if x and -x[0][0] >= ratio * counts[w] else None for w, x in near.items()}
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize(("seed", "letters", "longest"), [(0, "ab", 7), (1, "abcß", 5), (2, "abcdefgh", 4), (3, "aé", 9)])
def test_against_brute_force(spark, seed, letters, longest):
    rnd = random.Random(seed)
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))): rnd.choice([5, 6, 25, 30, 125, 700, 4000]) for _ in range(400)}
    got = spelling.variants(frame(spark, counts))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(counts) and set(rows) == plain(counts)


def test_pairs_come_once(spark):
    rnd = random.Random(5)
    counts = {"".join(rnd.choice("aab") for _ in range(rnd.randint(1, 6))): 5 for _ in range(300)}
    pairs, grouped = spelling.merged(frame(spark, counts))
    found = [frozenset((r.word, r.near)) for r in pairs.collect()]
    assert len(found) == len(set(found))
    want = {frozenset((u, v)) for u in counts for v in counts if u < v and edited(u, v)}
    assert set(found) <= want and 2 * (len(want) - len(found)) == sum(r.n_near for r in grouped.collect())


def test_words(spark, docs_of):
    texts = [(i, f"Wörter ÉTÉ×÷ Hausfrau{chr(97 + i % 26)} straßen123abcdefgh" * 3, "s") for i in range(300)] + ODD
    counts = Counter()
    for i, t, _ in texts:
        run = ""
        for c in (t or "") + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                counts[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in spelling.words_of(docs_of(texts)).collect()} == want and "x" * 50000 not in want


def test_nothing(spark, docs_of):
    assert spelling.variants(spelling.words_of(docs_of([]).limit(0))).count() == 0
    assert [tuple(r) for r in spelling.variants(frame(spark, {"a": 7})).collect()] == [("a", None, "a", 7, 0, None)]


def test_long_shared_heads(spark):
    counts = {f"{'x' * 60}{i:03d}": 5 + i for i in range(400)} | {"x" * 60: 9, "x" * 59: 50}
    assert {tuple(r) for r in spelling.variants(frame(spark, counts)).collect()} == plain(counts)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = spelling.op12(spark, sf).toPandas()
    assert len(got) > 1000 and got.form.notna().sum() > 10
    same(got, tables(sf).sql(spelling.OP12_SQL).df())
