"""Small pieces for the models that are trained here in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a weight array that are averaged together.
ROWS = 256


class Adam:
    """Adam over a dictionary of float32 arrays, updated in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.003):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            if isinstance(g, tuple):  # rows that a step touches, and their gradients; the others stay as they are
                at, g = g
                m, v = self.m[k][at], self.v[k][at]
                m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
                self.m[k][at], self.v[k][at] = m, v
                self.p[k][at] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
                continue
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def normal(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale if scale is not None else shape[0] ** -0.5)).astype(np.float32)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n indexes, the sum of its rows."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        start = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        out[index[start]] = np.add.reduceat(rows[order], start, axis=0)
    return out


def mean_weights(t: pd.DataFrame) -> pd.DataFrame:
    """One run of rows of one weight array: the mean over shards, each weighed by the rows that it learned from."""
    weight = t["weight"].to_numpy()
    values = np.stack([np.frombuffer(v, np.float32) for v in t["values"]]).astype(np.float64)
    return t.iloc[:1].assign(values=[(weight @ values / weight.sum()).astype(np.float32).tobytes()])


def rounds_of(rows: DataFrame, p: dict[str, np.ndarray], learn: Callable[[dict, pd.DataFrame, int], dict], rounds: int) -> dict[str, np.ndarray]:
    """Weights p after rounds over all rows. The rows of each value of `shard` learn together on an executor, from the same weights
    as the others; a round ends with the mean of theirs. learn: weights, a shard's rows, the round -> new weights. Only weights reach the driver."""
    names = list(p)

    def turn_of(r: int, sent):
        def turn(t: pd.DataFrame) -> pd.DataFrame:
            new = learn({k: v.copy() for k, v in sent.value.items()}, t, r)
            out = [(i, lo, new[k][lo : lo + ROWS].astype(np.float32).tobytes(), float(len(t))) for i, k in enumerate(names) for lo in range(0, len(new[k]), ROWS)]
            return pd.DataFrame(out, columns=["name", "lo", "values", "weight"])

        return turn

    kind = "name int, lo int, values binary, weight double"
    for r in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(p)
        parts = rows.groupBy("shard").applyInPandas(turn_of(r, sent), kind)
        got = sorted(parts.groupBy("name", "lo").applyInPandas(mean_weights, kind).select("name", "lo", "values").collect(), key=lambda x: (x.name, x.lo))
        if got:
            p = {k: np.frombuffer(b"".join(bytes(x["values"]) for x in got if x.name == i), np.float32).reshape(p[k].shape).copy() for i, k in enumerate(names)}
        sent.destroy()
    return p
