"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import first_by_hash, hash32, written
from verbaline.llm.components import components
from verbaline.llm.vectors import matrix, unit, usable

#: Vectors that a pivot cell should hold, the most pivots (they go to every task), and vectors in a block.
CELL, MOST_PIVOTS, BLOCK = 4096, 512, 1024


def assign(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector's nearest pivot, and a mask of the earlier cells that may hold a partner within reach.

    For x at home with pivot h and a partner y at home with pivot p, |x p| <= |x y| + |y p| <= |x y| + |y h| <= 2 |x y| + |x h|;
    and the way from x to y crosses the plane between h and p, which lies (|x p|^2 - |x h|^2) / (2 |h p|) from x.
    """
    d2 = np.maximum(2 - 2 * (x @ pivots.T), 0)
    home = d2.argmin(axis=1)
    own = d2[np.arange(len(x)), home][:, None]
    near = np.sqrt(d2) - np.sqrt(own) <= 2 * reach
    apart = 2 * np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    near &= d2 - own <= reach * apart + 1e-9
    near &= np.arange(len(pivots))[None, :] < home[:, None]
    return home, near


def merge(adjacent: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For a symmetric link matrix, the smallest name in each row's component."""
    low = names.copy()
    while True:
        new = np.minimum(low, np.where(adjacent, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return low
        low = new


def block_links(t: pd.DataFrame, least: float) -> pd.DataFrame:
    """One group: rows of block A with themselves (on the diagonal), with block B, and with the outer block O."""
    a, b = t[t.role == 0], t[t.role > 0]
    if not len(a) or t.role.eq(0).all() and not t.diagonal.iloc[0]:
        return pd.DataFrame({"node": [], "links": [], "peer": []}).astype("int64")
    x = unit(matrix(a.vec))
    both = pd.concat([a, b])
    y = unit(matrix(both.vec))
    hit = x @ y.T >= least
    hit[:, : len(a)] &= bool(t.diagonal.iloc[0])
    hit[np.arange(len(a)), np.arange(len(a))] = False
    n = both.n.to_numpy(np.int64)
    links = np.zeros(len(both), np.int64)
    links[: len(a)] += hit @ n
    links[len(a) :] += hit[:, len(a) :].T @ n[: len(a)]
    linked = np.flatnonzero(hit.any(axis=0) | np.r_[hit.any(axis=1), np.zeros(len(b), bool)])
    full = np.zeros((len(both), len(both)), bool)
    full[: len(a)] = hit
    full |= full.T
    names = both.node.to_numpy(np.int64)[linked]
    return pd.DataFrame({"node": names, "links": links[linked], "peer": merge(full[np.ix_(linked, linked)], names)})


def near_vectors(vectors: DataFrame, *, least: float = 0.98, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows linked directly), component_id, kept.

    Two rows link if their labels are equal and not null, their vectors are usable, of one dimension, and have a cosine
    of at least `least`. Equal vectors of a label are collapsed first and count by their number, so copies cost one row.
    A cell's members are joined in blocks, and a block pair returns a row per linked vector, never its pairs.
    Null label, null, zero or non-finite vectors: no link, component_id is their own vec_id. Null vec_id: no link and a
    null component. vec_id names a vector: rows that share one are one node of the graph, and each row counts as a
    partner. Empty table: no rows. Other columns are not read.
    """
    v = vectors.select("vec_id", "label", "embedding", (usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok"))
    classes = v.where("ok").groupBy("label", F.col("embedding").alias("vec")).agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    classes = written(classes.select("*", F.size("vec").alias("dim"), F.xxhash64("vec", "label").alias("h")), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    k = min(MOST_PIVOTS, -(-largest // cell)) or 1
    some = classes.select("node", "vec", hash32(F.col("h")).alias("h"))
    picked = [np.asarray(r.vec, np.float64) for r in first_by_hash(some, "h", k, "node").collect()]
    by_dim = {d: unit(np.stack([p for p in picked if len(p) == d])) for d in {len(p) for p in picked}}
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for dim, g in t.groupby("dim"):
                if dim not in by_dim:  # no pivot of this dimension: one cell
                    yield g.assign(cell=0, home=True)
                    continue
                home, near = assign(unit(matrix(g.vec)), by_dim[dim], reach)
                yield g.assign(cell=home, home=True)
                row, to = np.nonzero(near)
                yield g.iloc[row].assign(cell=to, home=False)

    kind = classes.schema["vec"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    node = classes.schema["node"].dataType.simpleString()
    placed = classes.select("label", "dim", "node", "n", "h", "vec").mapInPandas(cells, f"label {label}, dim int, node {node}, n long, h long, vec {kind}, cell int, home boolean")
    placed = written(placed, "cells")
    sizes = placed.groupBy("label", "dim", "cell").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("home") == w, 1).otherwise(0)) / block)).cast("int").alias(c) for w, c in ((True, "nh"), (False, "no"))))
    p = placed.join(sizes, ["label", "dim", "cell"])
    p = p.withColumn("b", F.pmod("h", F.when(F.col("home"), F.col("nh")).otherwise(F.col("no"))).cast("int"))
    pair = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    first = F.transform(upto(F.greatest("nh", "no")), lambda t: pair(F.col("b"), t, 0))
    second = F.when(F.col("b") > 0, F.transform(upto(F.greatest(F.col("b"), F.lit(1))), lambda t: pair(t, F.col("b"), 1))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
    outer = F.transform(upto(F.col("nh")), lambda t: pair(t, F.col("b"), 2))
    g = p.select("label", "dim", "cell", "node", "n", "vec", F.inline(F.when(F.col("home"), F.concat(first, second)).otherwise(outer)))
    g = g.withColumn("diagonal", F.col("i") == F.col("j"))
    out = g.groupBy("label", "dim", "cell", "i", "j").applyInPandas(lambda t: block_links(t, least), "node long, links long, peer long")
    out = written(out, "links")
    links = out.groupBy("node").agg(F.sum("links").alias("links"))
    # Other copies of a vector are links of their own.
    copies = classes.groupBy("node").agg(F.max(F.col("n") - 1).alias("copies"))
    degree = copies.join(links, "node", "left").select("node", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"))
    roots = components(out, "node", "peer").withColumnRenamed("node", "_n")
    degree = degree.join(roots, degree.node == F.col("_n"), "left").select("node", "n_links", F.coalesce("component", "node").alias("component_id"))
    # A row finds its class by its vector; the class table has one row per distinct vector, so a hot vector is a skewed probe side only.
    known = classes.select("label", "vec", "node").join(degree, "node")
    r = v.alias("r").join(known.alias("k"), (F.col("r.ok")) & (F.col("r.label") == F.col("k.label")) & (F.col("r.embedding") == F.col("k.vec")), "left")
    component = F.coalesce("k.component_id", "r.vec_id")
    return r.select("r.vec_id", F.coalesce("k.n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("r.vec_id") == component, F.lit(False)).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH ok AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
walk AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM w JOIN links l ON w.b = l.a) SELECT a, min(b) AS low FROM w GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(w.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(w.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN deg d ON d.a = e.vec_id LEFT JOIN walk w ON w.a = e.vec_id
"""
