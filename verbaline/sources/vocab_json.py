"""Vocabularies as one flat JSON object, as the browser reads them: as a string, or as files of any size in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A JSON string, non-ASCII characters as they are."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("k"))), r'^\{"k":|\}$', "")


def _entry(key: str, id_col: str) -> Column:
    return F.concat(F.lit("  "), quoted(F.col(key)), F.lit(": "), F.col(id_col).cast("string"))


def to_json(vocab: DataFrame, key: str, id_col: str, last: tuple[str, ...] = ("<PAD>", "<UNK>")) -> DataFrame:
    """json: the object, indented by two, in the order of ids; the reserved entries come last. One row, for small vocabularies such as tags."""
    entry = F.struct(F.col(key).isin(*last).alias("z"), F.col(id_col).alias("i"), _entry(key, id_col).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]), ",\n")
    return vocab.agg(F.concat(F.lit("{\n"), body, F.lit("\n}")).alias("json"))


def write(vocab: DataFrame, key: str, id_col: str, path: str, last: tuple[str, ...] = ("<PAD>", "<UNK>")) -> None:
    """The object that to_json makes, an entry a line, in files whose contents make it up in the order of their names.

    Rows are dealt by ranges of the ids and sorted within them, so no task holds more than its range; the first line has
    the opening bracket and the last entry the closing one. An empty vocabulary is an empty object.
    """
    v = vocab.select(F.col(key).isin(*last).alias("z"), F.col(id_col).alias("i"), F.col(key).alias("k"), _entry(key, id_col).alias("s"))
    end = v.agg(F.max(F.struct("z", "i", "k")).alias("end")).first().end
    is_end = (F.col("z") == F.lit(end.z)) & (F.col("i") == end.i) & (F.col("k") == end.k) if end else F.lit(False)
    # Its place is before all others: a null comes first.
    first = vocab.sparkSession.range(1).select(F.lit(None).cast("boolean").alias("z"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("string").alias("k"), F.lit("{" if end else "{\n}").alias("value"))
    lines = v.select("z", F.col("i").cast("long"), "k", F.concat("s", F.when(is_end, "\n}").otherwise(",")).alias("value"))
    first.unionByName(lines).repartitionByRange("z", "i", "k").sortWithinPartitions("z", "i", "k").select("value").write.mode("overwrite").text(path)


def from_json(df: DataFrame, key: str, id_col: str, column: str = "json") -> DataFrame:
    """key, id from a column of JSON objects."""
    return df.select(F.explode(F.from_json(column, "map<string,bigint>")).alias(key, id_col))


def read(spark: SparkSession, path: str, key: str, id_col: str) -> DataFrame:
    """key, id of an object in one or many files, an entry a line (or several), as write() and other writers that indent give
    it: files are read by splits, and no row is longer than a line. Of equal keys each has a row; brackets may share a line."""
    body = F.regexp_replace("value", r"\A[\s{]+|[\s,}]+\z", "")
    lines = spark.read.text(path, lineSep="\n").select(body.alias("b")).where("b <> ''")
    return from_json(lines.select(F.concat(F.lit("{"), "b", F.lit("}")).alias("json")), key, id_col)


def inverted(vocab: DataFrame, key: str, id_col: str) -> DataFrame:
    """id first: for lookups by id."""
    return vocab.select(F.col(id_col), F.col(key))
