from verbaline.functions import registry


def test_sql_names(spark):
    registry.register(spark)
    spark.createDataFrame([(1, "Hello, it's"), (2, None), (3, "")], "id long, t string").createOrReplaceTempView("texts")
    got = {r.id: r for r in spark.sql("SELECT id, web_tokens(t) AS w, size(rule_tokens(t)) AS n, murmur64a(t) AS h, murmur2(t) AS h2 FROM texts").collect()}
    assert got[1].w == ["hello", ",", "it", "'", "s"] and got[1].n == 4 and got[2].w is None and got[2].h is None and got[3].h == -4132994306676857636 and got[3].h2 == 1540447798
    rows = spark.sql("SELECT id, x.token, x.spacy FROM texts, LATERAL rule_tokenize(t) AS x ORDER BY id, x.tok_idx").collect()
    assert [(r.token, r.spacy) for r in rows] == [("Hello", False), (",", True), ("it", False), ("'s", False)]
    u = spark.sql("SELECT resolve_upos('VB', 'AUX') AS a, resolve_upos('DT', 'NSUBJ') AS b, resolve_upos('``', 'DEP') AS c, resolve_upos('\\'\\'', 'DEP') AS d").first()
    assert tuple(u) == ("AUX", "PRON", "PUNCT", "PUNCT")
