"""Approximate nearest neighbours by largest inner product: NN-descent graphs built by Spark joins, greedy graph search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbaline.llm.common import again, drop, hash32, hash_bucket, ranked, written
from verbaline.llm.vectors import usable

#: Distinct vectors in a shard at most (about), neighbours of a node, sampled neighbours in a round, rounds, beam.
SHARD, NEIGHBOURS, SAMPLE, ROUNDS, BEAM = 8192, 20, 8, 7, 320
#: Queries searched together, and the share of renewed edges that ends the descent.
QUERIES, SETTLED = 1024, 0.01


def nodes(vectors: DataFrame, keep: int, shard: int) -> DataFrame:
    """(shard, i, vec, ids): the distinct usable vectors, dealt into shards by hash and numbered, with their `keep` smallest ids."""
    v = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("vec"))
    first = v.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= keep)
    c = first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    c = written(c.withColumn("h", hash32(F.col("ids")[0], F.size("vec"))), "distinct")
    n = c.count()
    c = c.withColumn("shard", F.pmod(F.floor(F.col("h") / 7), F.lit(max(1, -(-n // shard)))).cast("int"))
    return written(ranked(c, ["shard"], hash_bucket(F.col("h"), n), [F.col("h"), F.col("ids")], {"i": None}).select("shard", F.col("i").cast("int"), "vec", "ids"), "nodes")


def improve(pairs: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """A shard's best k edges of each node among known edges and new pairs; fresh marks those that are new."""
    if not len(pairs) or not len(points):
        return pd.DataFrame({"shard": [], "u": [], "v": [], "fresh": []}).astype({"shard": "int32", "u": "int32", "v": "int32", "fresh": "bool"})
    points = points.sort_values("i")
    x = padded(points.vec).astype(np.float32)
    m = len(x)
    u, v, new = (pairs[c].to_numpy() for c in ("u", "v", "fresh"))
    key = np.concatenate([u.astype(np.int64) * m + v, v[new].astype(np.int64) * m + u[new]])
    old = np.concatenate([~new, np.zeros(int(new.sum()), bool)])
    order = np.lexsort((~old, key))  # a known edge comes before the same pair found again
    key, old = key[order], old[order]
    one = np.r_[True, key[1:] != key[:-1]]
    key, old = key[one], old[one]
    u, v = key // m, key % m
    score = np.empty(len(key), np.float32)
    for s in range(0, len(key), 65536):
        score[s : s + 65536] = np.einsum("ij,ij->i", x[u[s : s + 65536]], x[v[s : s + 65536]])
    order = np.lexsort((v, -score, u))
    u, v, old = u[order], v[order], old[order]
    start = np.r_[0, np.flatnonzero(u[1:] != u[:-1]) + 1]
    place = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)]))
    best = place < k
    return pd.DataFrame({"shard": np.int32(points.shard.iloc[0]), "u": u[best].astype(np.int32), "v": v[best].astype(np.int32), "fresh": ~old[best]})


def padded(column) -> np.ndarray:
    """Rows of one width; a shorter vector is filled up with zeros."""
    width = max(map(len, column))
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def build(points: DataFrame, *, k: int = NEIGHBOURS, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """(shard, u, v): each node's k nearest found. A node's neighbours, in both directions, are joined with one another.

    Every round samples at most `sample` fresh and as many known neighbours of a node, as NN-descent does; what is left
    out stays in the graph and is drawn later.
    """
    sizes = points.groupBy(F.col("shard").alias("s")).agg(F.count("*").alias("m"))
    start = points.join(sizes, F.col("shard") == F.col("s")).select("shard", F.col("i").alias("u"), "m", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    start = start.select("shard", "u", F.pmod(F.xxhash64("shard", "u", "j"), F.col("m")).cast("int").alias("v"), F.lit(True).alias("fresh")).where("u <> v")
    schema = "shard int, u int, v int, fresh boolean"
    fit = lambda pairs: written(pairs.groupBy("shard").cogroup(again(points).select("shard", "i", "vec").groupBy("shard")).applyInPandas(lambda a, b: improve(a, b, k), schema), "graph")
    graph = fit(start)
    for r in range(rounds):
        both = graph.select("shard", F.col("u").alias("mid"), F.col("v").alias("id"), "fresh").union(graph.select("shard", "v", "u", "fresh"))
        some = Window.partitionBy("shard", "mid", "fresh").orderBy(F.xxhash64("mid", "id", F.lit(r)), "id")
        near = both.withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= sample).drop("_r")
        near = written(near, "near")
        a, b = near.alias("a"), near.alias("b")
        on = (F.col("a.shard") == F.col("b.shard")) & (F.col("a.mid") == F.col("b.mid")) & F.col("a.fresh") & (F.col("a.id") != F.col("b.id"))
        found = a.join(b, on & (~F.col("b.fresh") | (F.col("a.id") < F.col("b.id")))).select("a.shard", F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.lit(True).alias("fresh"))
        # A fresh edge that was sampled has had its turn.
        done = near.where("fresh").select(F.col("shard").alias("s"), "mid", "id", F.lit(True).alias("seen"))
        known = graph.join(done, (F.col("shard") == F.col("s")) & (F.col("u") == F.col("mid")) & (F.col("v") == F.col("id")), "left").select("shard", "u", "v", (F.col("fresh") & F.col("seen").isNull()).alias("later"))
        new = fit(known.select("shard", "u", "v", F.lit(False).alias("fresh")).union(found))
        later = known.where("later").select("shard", "u", "v", F.lit(True).alias("later"))
        renewed = written(new.join(later, ["shard", "u", "v"], "left").select("shard", "u", "v", (F.col("fresh") | F.col("later").isNotNull()).alias("fresh")), "graph")
        changed, edges = new.agg(F.count_if("fresh"), F.count("*")).first()
        for t in (near, new, graph):
            drop(t)
        graph = renewed
        if changed <= SETTLED * max(1, edges):
            break
    return graph.select("shard", "u", "v")


def search(x: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int, entries: int = 64, widen: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries side by side: (nodes, scores) of each query's beam, -1 where there are fewer.

    links: row per node, -1 where it has fewer neighbours. A step expands each query's `widen` best unexpanded nodes;
    the search ends when every node in every beam has been expanded.
    """
    m, n = len(x), len(q)
    beam = min(beam, m)
    seen = np.zeros((n, m + 1), bool)
    seen[:, m] = True
    ids = np.linspace(0, m - 1, min(entries, beam, m)).astype(np.int64)
    ids = np.unique(ids)[None, :].repeat(n, axis=0)
    score = np.einsum("qd,qed->qe", q, x[ids])
    rows = np.arange(n)[:, None]
    seen[rows, ids] = True
    fill = beam - ids.shape[1]
    ids = np.pad(ids, ((0, 0), (0, fill)), constant_values=-1)
    score = np.pad(score, ((0, 0), (0, fill)), constant_values=-np.inf)
    spent = ids < 0
    while not spent.all():
        live = np.flatnonzero(~spent.all(axis=1))
        here = np.arange(len(live))[:, None]
        rank = np.where(spent[live], -np.inf, score[live])
        pick = np.argpartition(-rank, min(widen, beam) - 1, axis=1)[:, :widen]
        usable_ = ~spent[live][here, pick]
        spent[live[:, None], pick] = True
        at = np.where(usable_, ids[live][here, pick], -1)
        to = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
        to = np.where(to < 0, m, to)
        to = np.where(seen[live[:, None], to], m, to)
        to.sort(axis=1)
        to[:, 1:][to[:, 1:] == to[:, :-1]] = m
        seen[live[:, None], to] = True
        to.sort(axis=1)
        width = int((to < m).sum(axis=1).max(initial=0))
        if not width:
            continue
        to = to[:, :width]
        real = to < m
        got = np.where(real, np.einsum("qd,qed->qe", q[live], x[np.where(real, to, 0)]), -np.inf)
        ids2 = np.concatenate([ids[live], np.where(real, to, -1)], axis=1)
        score2 = np.concatenate([score[live], got], axis=1)
        spent2 = np.concatenate([spent[live], ~real], axis=1)
        top = np.argpartition(-score2, beam - 1, axis=1)[:, :beam]
        ids[live], score[live], spent[live] = ids2[here, top], score2[here, top], spent2[here, top]
    order = np.argsort(-score, axis=1, kind="stable")
    return ids[rows, order], score[rows, order]


def nearest(vectors: DataFrame, queries: DataFrame, *, top: int = 20, shard: int = SHARD, k: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its `top` rows of largest inner product that the search finds.

    vectors and queries: vec_id, embedding. A row is never its own neighbour (by vec_id). Equal vectors are one node of
    the graph that knows its top + 1 smallest ids: no more can be among the results. Nearest first, ties to the smaller
    vec_id. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without vec_id;
    vectors of other dimensions count as filled up with zeros. Repeated rows give repeated candidates. A query listed
    twice is answered once. Empty tables: no rows. Fewer candidates than `top`: all of them. Other columns are not read.
    """
    points = nodes(vectors, top + 1, shard)
    graph = build(points, k=k)
    # Reverse edges too, so that every node can be reached; a node of many stays within a row of fixed width.
    both = graph.union(graph.select("shard", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    some = Window.partitionBy("shard", "u").orderBy(F.xxhash64("u", "v"), "v")
    back = both.withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= 3 * k)
    links = back.groupBy(F.col("shard"), F.col("u").alias("i")).agg(F.collect_list("v").alias("to"))
    index = points.join(links, ["shard", "i"], "left").select("shard", "i", "vec", "ids", "to")
    index = written(index, "index")
    q = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")).dropDuplicates(["query_id"])
    q = written(q.withColumn("h", hash32(F.col("query_id"))), "queries")
    parts = max(1, -(-q.count() // QUERIES))
    shards = index.select("shard").distinct()
    q = q.withColumn("part", F.floor(F.col("h") * parts / F.lit(2**32)).cast("int"))
    asked = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(q, "part").select("shard", "part", "query_id", F.col("vec"))
    tables = again(index).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def answer(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({"query_id": [], "score": [], "ids": []})
        t = t.sort_values("i")
        x, want = padded(t.vec), padded(q.vec)
        width = max(x.shape[1], want.shape[1])
        x, want = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, want))
        links = np.full((len(t), 3 * k), -1, np.int64)
        for i, to in enumerate(t.to):
            if to is not None:
                links[i, : len(to)] = to
        node, _ = search(x.astype(np.float32), links, want.astype(np.float32), beam)
        node = node[:, : 2 * top + 2]
        query, place = np.nonzero(node >= 0)
        node = node[query, place]
        return pd.DataFrame({"query_id": q.query_id.to_numpy()[query], "score": np.einsum("ij,ij->i", want[query], x[node]), "ids": t.ids.to_numpy()[node]})

    found = asked.groupBy("shard", "part").cogroup(tables.groupBy("shard", "part")).applyInPandas(answer, "query_id long, score double, ids array<long>")
    rows = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all rows."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(v, v.where(F.col("vec_id") % 20 == 0))
