import random

import pytest
from pyspark.sql import functions as F
from test_rules import GOLDEN

from verbaline.functions import rule_columns, rules

SIGNS = [*"ab.A'-,:/+$5…\" \n\té€😀()!s§%=°CKUS—–~#\x01\x02\x03", "US$", "'s", "...", "……", "http://", "--", "’S", "word", "word."]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 12))) for _ in range(15000)]
    return [t for t, _ in GOLDEN] + made + ["!" * 5000, "." * 30000, "(.)" * 2000, "a!" * 20000, "x" * 50000, "word, " * 20000, None]


@pytest.mark.parametrize("currency", [False, True])
def test_columns_equal_the_function(spark, texts, currency):
    t = F.col("t")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(8)
    got = df.select("id", rule_columns.rule_tokens(t, currency).alias("p"), rule_columns.count(t, currency).alias("n"), rule_columns.spaced(t).alias("s"))
    for r in got.collect():
        text = texts[r.id]
        if text is None:
            assert r.p is None and r.n is None and r.s is None
            continue
        want = [(text[a:b], c) for a, b, c in rules.tokenize(text, {}, currency)]
        assert [tuple(x) for x in r.p] == want and r.n == len(want) and r.s == sum(c for _, c in want), text[:80]


def test_peeling_equals_the_function(spark, texts):
    chunks = sorted({c for t in texts if t for c in t.split() if len(c) < 40})
    got = spark.createDataFrame([(c,) for c in chunks], "c string").select("c", rule_columns.peeled(F.col("c")).alias("p")).collect()
    assert all((r.p.front, r.p.core, r.p.back) == rules.peel(r.c) for r in got)


def test_counting_starts_no_python(spark, sf_dir):
    from verbaline.plans import catalogue

    for q in (catalogue.rule_token_counts, catalogue.spacy_flags, catalogue.affix_peel):
        plan = q(spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
