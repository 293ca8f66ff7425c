"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import hash32, hash_bucket, ranked, written

RACKS, SHARDS = 2, 4


def tree(n: int, racks: int = RACKS, shards: int = SHARDS) -> list[list[int]]:
    """Weights of the nodes of each level for n shards: shard k lies in rack k // shards, that in region k // (racks * shards); a node weighs as many shards as it holds."""
    if n < 1:
        raise ValueError("at least one shard")
    held = lambda width: [min(width, n - i) for i in range(0, n, width)]
    return [held(racks * shards), held(shards), held(1)]


def draw(key: Column, level: str, parent: Column, fan: int, weights: list[int]) -> Column:
    """The child of parent (children are parent * fan ... + fan - 1) with the least -ln(u) / weight, u a hash of key and child."""
    def arm(j: int) -> Column:
        child = parent * F.lit(fan) + F.lit(j)
        weight = F.get(F.array(*map(F.lit, weights)), child.cast("int"))
        u = (hash32(key, F.lit(level), child).cast("double") + F.lit(0.5)) / F.lit(float(2**32))
        return F.when(weight.isNotNull(), F.struct((-F.log(u) / weight).alias("s"), child.alias("c")))

    return F.array_min(F.array(*(arm(j) for j in range(fan))))["c"]


def place(df: DataFrame, key: Column, n: int, out: str, racks: int = RACKS, shards: int = SHARDS) -> DataFrame:
    """Adds column out, the shard (0 to n - 1) that the tree of n shards gives key.

    Draws are weighted by the shards below, so all shards get equal shares. Raising a node's weight draws rows into it
    alone and from its siblings alone, so movement stays in subtrees whose weights changed. When the added shard opens a
    region of its own (n a multiple of racks * shards, as 24 is), every row that moves lands in that shard.
    Null keys are one key.
    """
    regions, rack, leaf = tree(n, racks, shards)
    df = df.withColumn("_r", draw(key, "region", F.lit(0), len(regions), regions))
    df = df.withColumn("_k", draw(key, "rack", F.col("_r"), racks, rack))
    return df.withColumn(out, draw(key, "shard", F.col("_k"), shards, leaf).cast("int")).drop("_r", "_k")


def shard(docs: DataFrame, n: int = 24) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard (with n + 1 shards).

    Law `key`: doc_id and the number of shards decide. Slots number each shard's rows without gaps, in the order of a
    hash of doc_id, then doc_id, crc and size, so rows that tie in all of these are interchangeable. Null text: size 8,
    crc of no bytes (0). Null doc_id: one key. Empty table: no rows. Other columns of docs are not read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), hash32(F.col("doc_id")).alias("h"))
    d = written(place(place(d, F.col("doc_id"), n, "shard"), F.col("doc_id"), n + 1, "grown_shard"), "shards")
    order = [F.col(c) for c in ("h", "doc_id", "text_crc32", "size")]
    out = ranked(d, ["shard"], hash_bucket(F.col("h"), d.count()), order, {"slot": None})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _drawn(n: int, out: str) -> str:
    levels, prev = [], "d"
    for name, parent, fan, weights in zip(("region", "rack", "shard"), ("0", "region", "rack"), (len(tree(n)[0]), RACKS, SHARDS), tree(n), strict=True):
        rows = ", ".join(f"({i // fan if name != 'region' else 0}, {i}, {w})" for i, w in enumerate(weights))
        u = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N') || '|{name}|' || c), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0"
        levels.append(f"{out}_{name} AS (SELECT doc_id, arg_min(c, -ln({u}) / w)::INTEGER AS {name} FROM {prev} JOIN (VALUES {rows}) n(p, c, w) ON p = {parent} GROUP BY doc_id)")
        prev = f"{out}_{name}"
    return ", ".join(levels)


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32's reflected polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (c & 1) * 0xEDB88320
        out.append(c)
    return out


_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"""

OP10_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id FROM documents),
{_drawn(24, "a")}, {_drawn(25, "b")},
t AS (SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, {_CRC}::BIGINT AS text_crc32 FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, a_shard.shard,
  row_number() OVER (PARTITION BY a_shard.shard ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 8))::BIGINT, doc_id, text_crc32, size) - 1 AS slot,
  b_shard.shard AS grown_shard
FROM t JOIN a_shard USING (doc_id) JOIN b_shard USING (doc_id)
"""
