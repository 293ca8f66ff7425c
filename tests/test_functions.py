import random

import pytest
from pyspark.sql import functions as F

from verbaline.functions import hashing, tags

GOLDEN = {
    "": (14313749767032693980, 1540447798, 3995324853, 15969484588125803080), "apple": (8566208034543834098, 2875453755, 3629774311, 5994204618533360404),
    "internationalization": (13482343820443705570, 492125038, 1439191882, 3736903875625031291),
}
MORE = {"a": 11901859001352538922, "coffee": 3197928453018144401, "The": 5059648917813135842, "café": 32833993555699147}


def test_hashes():
    raw = [w.encode() for w in GOLDEN]
    for k, fn in enumerate((hashing.murmur64a, hashing.murmur2, hashing.murmur2a, hashing.murmur64b)):
        assert [int(x) for x in fn(raw)] == [v[k] for v in GOLDEN.values()]
    assert [int(x) for x in hashing.murmur64a([w.encode() for w in MORE])] == list(MORE.values())


def test_hash_columns(spark):
    df = spark.createDataFrame([("apple",), ("",), (None,)], "w string").select("w", hashing.hash_udf("murmur64a")("w").alias("h"))
    got = {r.w: (r.h, r.u) for r in df.select("w", "h", hashing.unsigned(F.col("h")).alias("u")).collect()}
    assert got["apple"] == (8566208034543834098, 8566208034543834098) and got[""][0] == -4132994306676857636 and int(got[""][1]) == 14313749767032693980 and got[None] == (None, None)


@pytest.mark.parametrize(("tag", "dep", "want"), [("VB", "AUX", "AUX"), ("MD", "ROOT", "AUX"), ("DT", "NSUBJ", "PRON"), ("DT", "DET", "DET"), ("DT", "QUANTMOD", "DET"), ("WDT", "NSUBJ", "PRON"), ("IN", "MARK", "ADP"), ("GW", "DEP", "X"), ("??", "DEP", None)])
def test_upos(spark, tag, dep, want):
    r = spark.createDataFrame([(tag, dep)], "tag string, dep string").select(tags.resolve_upos(F.col("tag"), F.col("dep")).alias("u")).first()
    assert r.u == want


def test_raw_upos_differs_where_it_should(spark):
    cells = spark.range(50).select(F.col("id").alias("label")).crossJoin(spark.range(46).select(F.col("id").alias("dep")))
    d = cells.select("label", "dep", tags.resolve_upos_raw(F.col("label"), F.col("dep")).alias("raw"), tags.resolve_upos(tags.pick(F.col("label"), [t for t, _ in tags.LABELS]), tags.pick(F.col("dep"), tags.DEPS)).alias("own"))
    assert d.count() == 2300 and d.where("raw <> own").count() == 90


def test_dimensions(spark):
    dim = {r.tag: r for r in tags.dim_tag(spark).collect()}
    assert len(dim) == 51 and dim["HYPH"].label_idx == 14 and dim["HYPH"].json_id == 15 and dim["GW"].json_id == 14 and dim["``"].json_id == 48 and dim["XX"].json_id is None
    assert tags.dim_upos(spark).count() == 19 and tags.dim_dep(spark).count() == 46


def test_murmur2a_in_parts():
    from verbaline.functions.hashing import Murmur2A, murmur2a

    for parts in ([], [b""], [b"a"], [b"ab", b"", b"cde"], [b"abcd", b"efgh"], [bytes(range(250)), b"xyz", b"1234567"]):
        m = Murmur2A(7)
        for p in parts:
            m.add(p)
        assert m.end() == murmur2a([b"".join(parts)], 7)[0]


def test_parts_hash_of_many_rows(spark):
    rnd = random.Random(3)
    odd = ["", "a", "ab", "abc", "abcd", "héllo", "漢字かな", "😀", "x" * 1001, "ÿ" * 7, None]
    for n in (3, 400):  # states of their own, and blocks of all rows at once before them
        rows = [[rnd.choice(odd) for _ in range(rnd.randrange(9))] for _ in range(n)] + [None, [], [None], ["y" * 100_000, "z"]]
        df = spark.createDataFrame(list(enumerate(rows)), "i int, p array<string>").coalesce(1)
        got = {r.i: r.h for r in df.select("i", hashing.parts_hash_udf(5)("p").alias("h")).collect()}
        for i, r in enumerate(rows):
            assert got[i] == (None if r is None else int(hashing.murmur2a(["".join(x for x in r if x).encode()], 5)[0]))
