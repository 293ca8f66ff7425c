"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaline.llm.common import count_words, hash32, hash_bucket, ranked, written

#: Words in a block; a source's taken words differ from its target by a few blocks at most.
BLOCK = 64
#: Golden-ratio step in units of 2^-31: odd, so its multiples modulo 2^31 visit every point once.
STEP, POINTS = 1327217885, 2**31
BINS = 1024
MAX_PASSES = 3


def targets(sizes: DataFrame, cycle: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """(source, source_size, weight, target): share of all words by weight, held at passes times a source's size.

    One row per source. Sources in order of how soon they fill up: those that fill before the common level are held,
    the level is what remains over the weight that remains. The windows run over sources, never over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("_i") % len(cycle) + 1).cast("int")).cast("double"))
    fills = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("_i"))
    s = s.withColumn("_cap", (F.lit(passes) * F.col("source_size")).cast("double"))
    total = F.sum("source_size").over(Window.partitionBy())
    held = F.coalesce(F.sum("_cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.lit(share) * total - held) / left).withColumn("_open", F.col("_cap") / F.col("weight") > F.col("_level"))
    first = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("_i"), F.col("_level").alias("lv")))).over(Window.partitionBy())
    s = s.withColumn("_lv", first["lv"])
    target = F.when(F.col("_lv").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_lv")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def schedule(spark, goal: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank): the source that each slot draws from, and the slot's place among that source's slots.

    Slot i stands at the fractional part of i times the golden ratio on the line of cumulative targets.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("target").over(Window.partitionBy())
    lines = goal.where("target > 0").select("source", F.coalesce(F.sum("target").over(by_name), F.lit(0.0)).alias("lo"), F.col("target"), whole.alias("all"))
    lines = written(lines.select("source", (F.col("lo") / F.col("all")).alias("lo"), ((F.col("lo") + F.col("target")) / F.col("all")).alias("hi"), "all"), "lines")
    n = int(-(-(lines.agg(F.max("all")).first()[0] or 0.0) // block))
    last = Window.partitionBy()
    lines = lines.withColumn("hi", F.when(F.col("hi") == F.max("hi").over(last), F.lit(2.0)).otherwise(F.col("hi")))
    bins = lines.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1).cast("long")))))
    point = ((F.col("id") % POINTS) * F.lit(STEP) % POINTS) / F.lit(float(POINTS))
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("x")).withColumn("bin", F.floor(F.col("x") * BINS))
    drawn = slots.join(bins, (slots.bin == bins.bin) & (slots.x >= bins.lo) & (slots.x < bins.hi)).select("slot", "source")
    return ranked(drawn, ["source"], F.floor(F.col("slot") / 4096), [F.col("slot")], {"rank": None})


def mix(docs: DataFrame, *, size: Column | None = None, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.0, block: int = BLOCK, passes: int = MAX_PASSES) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Every source's documents, in the order of a hash of doc_id, form a stream of words that is read at most `passes`
    times and cut into blocks of `block` words; the k-th slot of a source takes its k-th block. No document is taken
    more than `passes` times its size. Reruns give the same rows.
    Null text: size 0, nothing taken. Null source: a source of its own, last in order. Rows with an equal doc_id are
    separate rows side by side in the stream. Empty table: no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "source", (count_words(F.col("text")) if size is None else size).alias("size"))
    d = written(d.withColumn("h", hash32(F.col("doc_id"))), "sizes")
    rows = d.count()
    goal = written(targets(d, cycle, share, passes), "targets")
    slots = schedule(spark, goal, block)
    order = [F.col("h"), F.col("doc_id"), F.col("size")]
    laid = ranked(d, ["source"], hash_bucket(F.col("h"), rows), order, {"start": F.col("size"), "row": None}).alias("l")
    laid = laid.join(goal.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select("l.*", "g.source_size", "g.target")
    # Only as many passes as the source's slots can reach, one more for the schedule's unevenness.
    reach = F.least(F.lit(passes), F.ceil((F.col("target") + F.lit(16 * block)) / F.col("source_size")).cast("int"))
    turn = F.when(F.col("size") > 0, F.sequence(F.lit(0), reach - 1))
    p = laid.withColumn("turn", F.explode_outer(turn)).withColumn("from", F.col("start") + F.col("turn") * F.col("source_size"))
    p = p.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block)))))
    words = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("from"), F.col("block") * block)
    p = p.withColumn("words", words).alias("p")
    hit = p.join(slots.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.rank")), "left")
    keys = ["source", "row", "doc_id", "size", "source_size", "target"]
    got = hit.groupBy(*(F.col(f"p.{k}") for k in keys)).agg(F.coalesce(F.sum(F.when(F.col("s.rank").isNotNull(), F.col("p.words"))), F.lit(0)).cast("long").alias("taken"))
    return got.select("doc_id", "source", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (none to three), parts of a copy rounded up or down by a hash of doc_id.

    Rows that share a doc_id, or have none, share one number of copies, from their sizes and takings together. Null, empty and
    blank texts have no words and are never taken. Null source: a source of its own. Empty table: no rows.
    """
    taken = mix(docs).groupBy(F.col("doc_id").alias("_mix_id")).agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    copies = F.floor(F.col("t") / F.greatest(F.col("s"), F.lit(1)) + hash32(F.col("_mix_id"), F.lit("part")) / F.lit(2**32)).cast("int")
    taken = taken.select("_mix_id", copies.alias("_mix_copies")).where("_mix_copies > 0")
    out = docs.join(taken, docs.doc_id.eqNullSafe(taken["_mix_id"]))
    return out.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies"))).alias("_mix_copy")).drop("_mix_copy")


def op9(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 8))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s0),
s2 AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s0)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
lev AS (SELECT lv FROM s3 WHERE cap / w > lv ORDER BY cap / w, i LIMIT 1),
goal AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM lev) = 0 THEN cap ELSE least(cap, w * (SELECT lv FROM lev)) END AS target FROM s3),
l0 AS (SELECT source, target, coalesce(sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
       (SELECT sum(target) FROM goal WHERE target > 0) AS al FROM goal WHERE target > 0),
lines AS (SELECT source, lo / al AS lo, CASE WHEN (lo + target) / al = max((lo + target) / al) OVER () THEN 2.0 ELSE (lo + target) / al END AS hi FROM l0),
slots AS (SELECT i AS slot, ((i % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::DOUBLE AS x
          FROM range(0, (SELECT ceil(max(al) / 64)::BIGINT FROM l0)) t(i)),
drawn AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN lines ON x >= lo AND x < hi),
laid AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         row_number() OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size) AS rn
         FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
spans AS (SELECT source, max(rank) + 1 AS k FROM drawn GROUP BY source),
reads AS (SELECT l.*, t.turn, start + t.turn * source_size AS a, coalesce(k, 0) * 64 AS total
          FROM laid l LEFT JOIN spans s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS turn) t)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(a + size, total) - a))::BIGINT AS taken
FROM reads GROUP BY source, rn, doc_id, size, source_size, target
"""
