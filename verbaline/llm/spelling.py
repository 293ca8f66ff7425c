"""Grouping of spelling variants: one-edit pairs of words by merging the light subtrees of their trie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import drop, lower_ascii, written
from verbaline.llm.sharding import _crc_table

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
#: One run in so many loses a code point, as its hash says.
ALTERED = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Nodes of at most this depth are few, as the alphabet is: 90 letters, so at most 8,191 nodes; their heavy edges are sent to all tasks.
SENT_DEPTH = 2


def words_of(docs: DataFrame, *, altered: int = ALTERED, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters of all texts, small A-Z, of at least that length and count. By the CRC-32 of `doc_id:run` one in
    `altered` runs loses a code point first. A null doc_id is written as nothing; null texts have no runs."""
    run = F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), 0)).alias("w")
    r = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run)
    h, n = F.crc32(F.concat_ws(":", "doc", "w").cast("binary")), F.length("w")
    at = (h % n).cast("int")
    short = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, n))
    words = r.select(F.when(h % altered == 0, short).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def edges(words: DataFrame) -> DataFrame:
    """word, n, i, b: each word's path in the trie: at depth i it goes on by the code point b, at its end by an empty one."""
    return words.select("word", "n", F.posexplode(F.concat(F.split("word", ""), F.array(F.lit("")))).alias("i", "b"))


def heavy_edges(words: DataFrame) -> DataFrame:
    """i, p, a: for each node p of depth i that branches, the edge with the most words below it (ties: the largest code point; an
    end is never heavy). The counts are partial aggregates, so the root costs a few rows a task."""
    e = edges(words).groupBy("i", F.substring("word", F.lit(1), F.col("i")).alias("p"), "b").agg(F.count("*").alias("c"))
    g = e.groupBy("i", "p").agg(F.max(F.when(F.col("b") != "", F.struct("c", "b"))).alias("h"), F.count("*").alias("edges"))
    return g.where("edges > 1").select("i", "p", F.col("h.b").alias("a"))


def light(words: DataFrame) -> DataFrame:
    """word, n, i, b, a: where a word's path leaves the heavy one: it goes on by b where the heavy edge is a. At most log2 of the
    number of words for each of them."""
    heavy = written(heavy_edges(words), "heavy")
    e = edges(words).withColumn("p", F.substring("word", F.lit(1), F.col("i")))
    on = lambda top: e.where(F.col("i") <= SENT_DEPTH if top else F.col("i") > SENT_DEPTH).join(F.broadcast(heavy.where(F.col("i") <= SENT_DEPTH)) if top else heavy.where(F.col("i") > SENT_DEPTH), ["i", "p"])
    return on(True).unionByName(on(False)).where("b <> a").select("word", "n", "i", "b", "a")


def merged(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the light subtrees meet when they are merged, with one character skipped or replaced.

    First (word, n, near, m): each word of a light subtree below a node and a word below the same node that it coincides with
    when its own edge is skipped, when the heavy one is put before it, or when its edge is replaced by the heavy one; so
    every one-edit pair with at most one word beside the heavy path, once. Second (word, n, n_near, top): words of two
    light subtrees that coincide when both edges are replaced; each meets as many as the letters that differ there, so at
    most the alphabet, and only their number and the best of them go on.
    """
    low = written(light(words), "light")
    head, tail = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 2, F.length("word"))
    # A pair that differs by one more letter parts where that letter is followed by another one: skipping counts there only.
    skipped = F.when((F.col("b") != "") & (F.substring(tail, 1, 1) != F.col("b")), F.concat(head, tail))
    put = F.concat(head, F.col("a"), F.col("b"), tail)
    replaced = F.when(F.col("b") != "", F.concat(head, F.col("a"), tail))
    probes = low.select("word", "n", F.explode(F.array(skipped, put, replaced)).alias("near")).where("near is not null")
    pairs = probes.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near").select("word", "n", "near", "m")
    same = low.where("b <> ''").groupBy("i", head.alias("p"), tail.alias("t")).agg(F.array_sort(F.collect_list(best("n", "word"))).alias("g")).where(F.size("g") > 1)
    one = same.select("g", F.posexplode("g").alias("k", "x"))
    other = F.when(F.col("k") == 0, F.get("g", F.lit(1))).otherwise(F.get("g", F.lit(0)))
    return pairs, one.select(F.col("x.word").alias("word"), (-F.col("x.less")).alias("n"), (F.size("g") - 1).alias("n_near"), other.alias("top"))


def best(n: str, word: str) -> Column:
    """The least of these is the most frequent word, the first in code-point order among equals."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def forms(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n for every row of words (word, n; words are distinct, neither null nor empty)."""
    pairs, grouped = merged(words)
    there = pairs.select("word", best("m", "near").alias("top"))
    back = pairs.select(F.col("near").alias("word"), best("n", "word").alias("top"))
    found = there.union(back).select("word", F.lit(1).alias("n_near"), "top").union(grouped.select("word", "n_near", "top"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("top").alias("top"))
    d = words.join(near, "word", "left").withColumn("form_n", -F.col("top.less"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    return d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top.word")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))


def rooted(f: DataFrame) -> DataFrame:
    """f (word, form, ...) with root, the last word that forms lead to. Counts rise along forms, so there is no circle; each
    round doubles the steps taken."""
    links = written(f.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        stepped = written(links.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        drop(links)
        links = stepped
        if not links.where("moved").limit(1).count():
            break
    return f.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n).

    A word's form is its most frequent near word (one code point inserted, deleted or replaced; ties: the smallest), if
    that has at least `ratio` times its count; its root is the end of the forms. Words must be distinct and not null.
    Empty table: no rows.
    """
    f = written(forms(words, ratio=ratio), "forms")
    return rooted(f).select("word", "form", "root", "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return variants(written(words_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words"))


_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, w, count(*) AS c FROM
  (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
k AS (SELECT w, c, doc || ':' || w AS k FROM r),
h AS (SELECT w, c, {_CRC}::BIGINT AS h FROM k),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % {ALTERED} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT e.word, v.word AS near, v.n AS m FROM e JOIN words v ON v.word = e.cut UNION SELECT v.word, e.word, e.n FROM e JOIN words v ON v.word = e.cut
  UNION SELECT a.word, b.word, b.n FROM e a JOIN e b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS top FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.near) AS near FROM pairs p JOIN near n ON n.word = p.word AND n.top = p.m GROUP BY p.word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n.n_near, 0)::BIGINT AS n_near, CASE WHEN n.top >= {RATIO} * w.n THEN b.near END AS form, CASE WHEN n.top >= {RATIO} * w.n THEN n.top END AS form_n
  FROM words w LEFT JOIN near n ON n.word = w.word LEFT JOIN best b ON b.word = w.word),
walk(word, stop, onward) AS (SELECT word, word, form FROM forms UNION ALL SELECT k.word, k.onward, f.form FROM walk k JOIN forms f ON f.word = k.onward)
SELECT f.word, f.form, k.stop AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word AND k.onward IS NULL
"""
