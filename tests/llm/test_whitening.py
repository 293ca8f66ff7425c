import numpy as np
import pytest

from verbaline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x array<int>, w string, n int, component string, deviation int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [1], "w", 3, "c", 4) for i, v in rows], SCHEMA)


def plain(rows):
    """By exact whole numbers and a full symmetric decomposition."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in good], n, dev, e, c @ v


def test_against_plain(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((600, 12)) @ rng.standard_normal((12, 12)) * np.linspace(3, 0.1, 12) + 5).astype(np.float32)
    x[50:90] = x[49]
    rows = [(i % 590, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (None, rows[3][1])]
    ids, n, dev, e, w = plain(rows + odd)
    got = whitening.whiten(frame(spark, rows + odd)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 8 * len(ids) and set(got.n) == {n} and got.vec_id.isna().sum() == 8
    assert sorted(got[got.component == 1].deviation.tolist()) == sorted(dev)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    for k in range(8):
        of = got[got.component == k + 1]
        assert np.allclose(of.explained, e[k] / e.sum(), rtol=1e-9)
        want = {i: y for i, y in zip(ids, w[:, k] / np.sqrt(e[k]), strict=True) if i is not None and 10 <= i < 590}
        of = of[of.vec_id.isin(want)].set_index("vec_id").whitened
        sign = np.sign(of.loc[20] * want[20])
        assert np.allclose([of.loc[i] * sign for i in want], list(want.values()), rtol=1e-7, atol=1e-9)


def test_few_dimensions_and_nothing(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(30)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert set(got.component) == {1, 2} and abs(got.groupby("component").explained.first().sum() - 1) < 1e-12  # the third has no variance
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_large_entries(spark):
    rows = [(i, [float((-1) ** i * 2.0**15), float(i), float(i * i % 5)]) for i in range(40)]
    ids, n, dev, e, _ = plain(rows)
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert sorted(got[got.component == 1].deviation.tolist()) == sorted(dev) and np.allclose(got[got.component == 1].explained, e[0] / e.sum())
    with pytest.raises(Exception, match="(?i)overflow|out of range|cannot be represented"):
        whitening.whiten(frame(spark, [(i, [v * 2.0**45 for v in r]) for i, r in rows])).count()


def test_query(spark):
    got = whitening.op13(spark, "/root/testdata/sf0.01").toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    ids, n, dev, e, w = plain(rows)
    assert len(got) == 8 * len(ids) and sorted(got[got.component == 1].deviation.tolist()) == sorted(dev)
    assert np.allclose(got.groupby("component").explained.first(), (e / e.sum())[:8], rtol=1e-9) and got.identity_error.iloc[0] < 1e-9
    for k in range(8):
        of = got[got.component == k + 1].set_index("vec_id").whitened.loc[ids].to_numpy()
        want = w[:, k] / np.sqrt(e[k])
        assert np.allclose(of * np.sign(of[0] * want[0]), want, rtol=1e-7, atol=1e-8)
