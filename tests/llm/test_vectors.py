import numpy as np
import pytest
from compare import same, tables

from verbaline.llm import metric_join, nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 5, "x") for i, v, y in rows], SCHEMA)


def planted(seed=0, n=700, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, dim))
    x = base[rng.integers(0, 40, n)] * rng.uniform(0.5, 2, (n, 1)) + rng.standard_normal((n, dim)) * rng.choice([0.02, 0.1, 0.4], (n, 1))
    x[100:140] = x[99]
    return [(i, [float(v) for v in x[i].astype(np.float32)], int(rng.integers(0, 2))) for i in range(n)]


def plain(rows, least):
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([y for *_, y in rows])
    a = (x @ x.T >= least) & (y[:, None] == y[None, :])
    np.fill_diagonal(a, False)
    low = np.arange(len(rows))
    while True:
        new = np.minimum(low, np.where(a, low[None, :], len(rows)).min(axis=1))
        if (new == low).all():
            return a.sum(axis=1), low
        low = new


@pytest.mark.parametrize(("cell", "block"), [(4096, 1024), (20, 16), (60, 1024)])
def test_join_against_brute_force(spark, cell, block):
    rows = planted()
    n, low = plain(rows, 0.98)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(frame(spark, rows), cell=cell, block=block).collect()}
    assert got == {i: (int(n[i]), int(low[i]), bool(low[i] == i)) for i in range(len(rows))} and n.sum() > 2000


def test_join_equals_sql(spark, sf_dir):
    same(metric_join.op5(spark, sf_dir).toPandas(), tables(sf_dir).sql(metric_join.OP5_SQL).df())


ODD = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0, 0.0], 1), (10, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 1), (11, [], 1)]


def test_join_of_odd_rows(spark):
    rows = metric_join.near_vectors(frame(spark, ODD)).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert len(rows) == len(ODD) and got[1] == (2, 1) and got[2] == (2, 1) and got[3] == (0, 3) and got[None] == (0, None)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert metric_join.near_vectors(frame(spark, [])).count() == 0


def exact(rows, query, top):
    x = np.array([v for _, v, _ in rows], float)
    s = x @ x[query]
    order = [i for i in np.lexsort((np.arange(len(rows)), -s)) if i != query][:top]
    return [(int(i), float(s[i])) for i in order]


def test_search_recall(spark):
    rows = planted(1, 1500, 24)
    v = frame(spark, rows)
    got = nn_descent.nearest(v, v.where("vec_id % 20 = 0"), shard=600, beam=128).toPandas()
    hits, n = 0, 0
    for q in range(0, 1500, 20):
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert g.score.is_monotonic_decreasing
        want = exact(rows, q, 20)
        hits, n = hits + len({i for i, _ in want} & set(g.vec_id)), n + 20
        for i, s in zip(g.vec_id, g.score, strict=True):
            assert abs(s - float(np.dot(np.float64(rows[i][1]), np.float64(rows[q][1])))) < 1e-9
    assert hits / n >= 0.9


def test_recall_on_all_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in e]
    place = {r.vec_id: k for k, r in enumerate(e)}
    got = nn_descent.op7(spark, sf).toPandas()
    hits = [len({rows[k][0] for k, _ in exact(rows, place[q], 20)} & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == sum(i % 20 == 0 for i in place) and np.mean(hits) >= 0.9


def test_search_of_odd_rows(spark):
    v = frame(spark, [(i, [1.0, 0.0], 1) for i in range(40)] + ODD[5:9] + [(100, [0.5, 0.5], 1)])
    got = nn_descent.nearest(v, v.where("vec_id in (5, 20, 100)"), top=20).toPandas()
    assert got[got.query_id == 20].sort_values("rank").vec_id.tolist() == list(range(20))
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(20))
    assert len(got[got.query_id == 5]) == 20  # the vector, not the null of the same id
    few = frame(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1)])
    assert nn_descent.nearest(few, few.where("vec_id = 0")).count() == 2
    assert nn_descent.nearest(few.limit(0), few.limit(0)).count() == 0
