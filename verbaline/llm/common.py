"""What several operators share: the shared scratch folder, word splitting, and exact ranks without single-task windows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as every contract spells it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_BUCKET = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='verbaline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, keeps columns prunable. The
    shuffles that made it are deleted once it is there, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A table made by written(), read anew: columns of its own for joins and cogroups with what derives from it."""
    out = df.sparkSession.read.schema(df.schema).parquet(df.scratch_path)
    out.scratch_path = df.scratch_path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def sliced(batches: Iterable, rows: int = 500) -> Iterator:
    """Arrow batches in slices of at most `rows` rows, so that what a task makes of one stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


def hash32(*parts: Column) -> Column:
    """The first 32 bits of an MD5 digest as a long, 0 to 2^32 - 1; nulls are written out as \\N."""
    key = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], add: dict[str, Column | None]) -> DataFrame:
    """Exact positions within each group though one group may hold most rows.

    bucket must not fall along the order; each (group, bucket) is ranked by itself and then moved by the sums of the
    buckets before it, so a task holds a bucket and never a group. add: name -> None for the number of rows before a row,
    or a column whose sum over the rows before it is wanted. group columns may be null.
    """
    df = df.withColumn("_b", bucket)
    amount = {n: F.lit(1).cast("long") if c is None else c for n, c in add.items()}
    sums = df.groupBy(*group, "_b").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in amount.items()))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_b", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in add))
    within = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{n}") for n, c in amount.items())).alias("d")
    on = F.col("d._b") == F.col("s._b")
    for g in group:
        on = on & F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}"))
    keep = [F.col(f"d.{c}") for c in df.columns if c != "_b"]
    return d.join(sums.alias("s"), on).select(*keep, *((F.col(f"_s_{n}") + F.col(f"_w_{n}")).alias(n) for n in add))


def first_by_hash(df: DataFrame, h: str, most: int, *ties: str) -> DataFrame:
    """The first `most` rows by hash32 value h and ties, at every size.

    One pass counts the rows below each power of two, and the least of these bounds with rows enough goes first, so that
    tasks send on about as many rows as are wanted. If many rows share one h, the bound lets them pass, and a task sends
    on `most` of them.
    """
    below = df.agg(*(F.count_if(F.col(h) < 2**k) for k in range(33))).first()
    k = next(k for k, n in enumerate(below) if n >= min(most, below[32]))
    return df.where(F.col(h) < 2**k).orderBy(h, *ties).limit(most)


def hash_bucket(h: Column, rows: int) -> Column:
    """Bucket of a hash32 value that rises with it, of about ROWS_PER_BUCKET rows."""
    n = max(1, -(-rows // ROWS_PER_BUCKET))
    return F.floor(h * F.lit(n) / F.lit(2**32)).cast("long")
