import random
import time

from pyspark.sql import functions as F

from verbaline.llm.common import count_words, first_by_hash, fold, hash32, hash_bucket, lower_ascii, ranked, written
from verbaline.llm.components import components


def test_ranks(spark):
    rnd = random.Random(1)
    rows = [(None if rnd.random() < 0.2 else rnd.choice("ab"), i, rnd.randrange(5)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, i long, n long").withColumn("h", hash32(F.col("i")))
    got = ranked(df, ["g"], hash_bucket(F.col("h"), 5000), [F.col("h"), F.col("i")], {"rank": None, "start": F.col("n")}).collect()
    for g in (None, "a", "b"):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.h, r.i))
        total = 0
        for k, r in enumerate(own):
            assert r["rank"] == k and r.start == total
            total += r.n


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(300)] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == want
    assert components(df.limit(0), "a", "b").count() == 0


def test_columns(spark):
    r = spark.createDataFrame([(" a\tB c\nÄ ", None)], "t string, n long").select(count_words(F.col("t")).alias("w"), count_words(F.col("n").cast("string")).alias("z"), lower_ascii(F.col("t")).alias("l"), fold(F.col("n"), 7).alias("f")).first()
    assert r.w == 3 and r.z == 0 and r.l == " a\tb c\nÄ " and r.f == 0


def test_first_by_hash_at_any_spread(spark):
    df = spark.range(20000).withColumn("h", hash32(F.col("id")))
    rows = sorted((r.h, r.id) for r in df.collect())
    assert [(r.h, r.id) for r in first_by_hash(df, "h", 300, "id").collect()] == rows[:300]
    one = df.withColumn("h", F.lit(4 * 10**9))  # all rows share a hash
    assert [r.id for r in first_by_hash(one, "h", 300, "id").collect()] == list(range(300))
    assert first_by_hash(df.limit(7), "h", 300, "id").count() == 7 and first_by_hash(df.limit(0), "h", 300, "id").count() == 0


def test_written_leaves_no_shuffle_behind(spark):
    shuffles = lambda: sum(1 for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f)
    before = shuffles()
    t = written(spark.range(20000).groupBy((F.col("id") % 1000).alias("g")).count())
    until = time.time() + 20
    while shuffles() > before and time.time() < until:  # files are deleted in the background
        time.sleep(0.2)
    assert shuffles() <= before
    assert t.count() == 1000 and t.agg(F.sum("count")).first()[0] == 20000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
