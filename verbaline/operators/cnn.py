"""The convolutional tagger: embedding, three-tap convolution, ReLU, linear layer. It is trained in training.py.

A tag depends on three words only, and the convolution is linear in the embedding; so each word's contribution to the
left, middle and right tap is a row of a table by word, and scoring adds three of them. Edges of a sentence count as
zeros, as in a batch of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbaline.operators import vocab

EMBED, FILTERS, TAPS = 128, 64, 3
#: Products up to which a layer is written out in columns; beyond, it is a matrix product on Arrow batches.
WRITTEN_OUT = 512
NAMES = ("embedding", "conv.weight", "conv.bias", "fc.weight", "fc.bias")


def new_weights(words: int, tags: int, embed: int = EMBED, filters: int = FILTERS, seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights in the usual shapes: [V, D], [F, D, 3], [F], [T, F], [T]."""
    rng = np.random.default_rng(seed)
    flat = lambda shape, n: rng.uniform(-(n**-0.5), n**-0.5, shape).astype(np.float32)
    return {"embedding": rng.standard_normal((words, embed)).astype(np.float32), "conv.weight": flat((filters, embed, TAPS), embed * TAPS), "conv.bias": flat((filters,), embed * TAPS), "fc.weight": flat((tags, filters), filters), "fc.bias": flat((tags,), filters)}


def tables(w: dict[str, np.ndarray]) -> np.ndarray:
    """(3, V + 1, F): each word's part in the left, middle and right tap; the last row is zero, for edges."""
    t = np.einsum("vd,fdk->kvf", w["embedding"], w["conv.weight"])
    return np.concatenate([t, np.zeros((TAPS, 1, t.shape[2]), t.dtype)], axis=1)


def hidden(t: np.ndarray, bias: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ReLU of the convolution for sentences laid end to end, and the neighbours' ids (V at edges)."""
    edge = t.shape[1] - 1
    left, right = np.r_[edge, ids[:-1]], np.r_[ids[1:], edge]
    if len(ids):
        left[start[start < len(ids)]] = edge
        last = np.r_[start[1:], len(ids)] - 1
        right[last[last >= 0]] = edge
    return np.maximum(t[0][left] + t[1][ids] + t[2][right] + bias, 0), left, right


def forward(w: dict[str, np.ndarray], ids: np.ndarray, start: np.ndarray, t: np.ndarray | None = None) -> np.ndarray:
    """Logits (tokens, tags) of sentences laid end to end, which begin at start."""
    h, _, _ = hidden(tables(w) if t is None else t, w["conv.bias"], ids, start)
    return h @ w["fc.weight"].T + w["fc.bias"]


def to_table(spark: SparkSession, w: dict[str, np.ndarray]) -> DataFrame:
    """(name, shape, values): weights as rows, for Parquet."""
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in w.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<float>")


def from_table(df: DataFrame) -> dict[str, np.ndarray]:
    """A model's few rows on the driver, for a vocabulary of known size; a larger embedding stays a table of rows by word_id."""
    return {r.name: np.asarray(r["values"], np.float32).reshape(r.shape) for r in df.where(F.col("name").isin(*NAMES)).collect()}


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def tap_rows(embedding: DataFrame, layers: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """keep, word_id, as_left, as_mid, as_right from (word_id, vector, ...): what a word adds to the convolution of the token after it,
    its own and the one before it. One row a word, so a vocabulary may be of any size."""
    w = layers["conv.weight"]
    names = ["as_left", "as_mid", "as_right"]
    if w.size <= WRITTEN_OUT:
        taps = (F.array(*(_sum([F.get("vector", F.lit(d)).cast("double") * float(w[f, d, k]) for d in range(w.shape[1])]) for f in range(w.shape[0]))).alias(n) for k, n in enumerate(names))
        return embedding.select(*keep, "word_id", *taps)
    sent = embedding.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.einsum("vd,fdk->kvf", b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1), sent.value).astype(float)
            ends = pa.array(np.arange(b.num_rows + 1) * t.shape[2], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in t)], [*keep, "word_id", *names])

    fields = T.StructType([*(embedding.schema[c] for c in keep), T.StructField("word_id", T.LongType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])
    return embedding.select(*keep, "word_id", "vector").mapInArrow(run, fields)


def scored(tokens: DataFrame, taps: DataFrame, layers: dict[str, np.ndarray], key: str, on: str = "word_id", unknown: tuple[list[float], ...] | None = None) -> DataFrame:
    """tokens (key, tok_idx, on, ...) with logits: tokens meet their words' taps in one join, and their neighbours' in a window.

    The table of taps grows with the vocabulary, so whether it is broadcast is left to its measured size. Tokens whose
    word has no taps, or is null, have those of unknown (three lists) and are left out without it; keys tell sentences apart.
    """
    names = ["as_left", "as_mid", "as_right"]
    zero = F.array_repeat(F.lit(0.0), len(layers["conv.bias"]))
    w = Window.partitionBy(key).orderBy("tok_idx")
    met = tokens.join(taps.select(F.col(on).alias("_on"), *names), tokens[on] == F.col("_on"), "left" if unknown else "inner")
    for n, values in zip(names, unknown or (), strict=False):
        met = met.withColumn(n, F.coalesce(n, F.array(*map(F.lit, values))))
    near = met.select(*tokens.columns, F.coalesce(F.lag("as_left").over(w), zero).alias("_l"), F.col("as_mid").alias("_m"), F.coalesce(F.lead("as_right").over(w), zero).alias("_r"))
    h = F.zip_with(F.zip_with("_l", "_m", lambda a, b: a + b), "_r", lambda a, b: a + b)
    h = F.zip_with(h, F.array(*map(F.lit, map(float, layers["conv.bias"]))), lambda a, b: F.greatest(a + b, F.lit(0.0)))
    return near.select(*tokens.columns, h.alias("_h")).select(*tokens.columns, linear("_h", layers["fc.weight"], layers["fc.bias"]).alias("logits"))


def scored_docs(chunks: DataFrame, taps: DataFrame, layers: dict[str, np.ndarray], on: str = "word") -> DataFrame:
    """Documents of vocab.chunked() with logits, an array for each token in order: what scored() gives for token tables, but each
    chunk meets the taps of its words once, and no token is shuffled. Every word must have taps."""
    names = ["as_left", "as_mid", "as_right"]
    bias, weight, out = (layers[k].astype(float) for k in ("conv.bias", "fc.weight", "fc.bias"))

    def fn(at: np.ndarray, ends: np.ndarray, rows: dict[str, np.ndarray]) -> pa.Array:
        if (at < 0).any():
            raise ValueError("a word without taps")
        left, mid, right = (rows[n][at] for n in names)
        before, after = np.zeros_like(mid), np.zeros_like(mid)
        before[1:], after[:-1] = left[:-1], right[1:]
        before[ends[:-1]], after[ends - 1] = 0, 0  # first tokens of documents and last ones
        h = before + mid + after
        z = np.maximum(h + bias, 0) @ weight.T + out
        return pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))

    return vocab.looked_up(chunks, taps, on, names, fn, T.StructField("logits", T.ArrayType(T.ArrayType(T.DoubleType()))))


def linear(h: str, weight: np.ndarray, bias: np.ndarray) -> Column:
    """array<double>: weight times the column h, plus bias."""
    if weight.size <= WRITTEN_OUT:
        return F.array(*(_sum([F.get(h, F.lit(f)) * float(x) for f, x in enumerate(row)]) + float(b) for row, b in zip(weight, bias, strict=True)))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            z = part.flatten().to_numpy().reshape(len(part), -1) @ weight.T.astype(float) + bias
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(bias), pa.int32()), pa.array(z.ravel()))

    return F.arrow_udf(run, "array<double>")(F.col(h))


def first_best_udf(spark: SparkSession, w: dict[str, np.ndarray]):
    """Column function: array of word ids -> array of tag ids, the first largest logit of each token; NaN counts as none."""
    sent = spark.sparkContext.broadcast(w)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tables(sent.value)
        for s in parts:
            n = np.array([0 if x is None else len(x) for x in s])
            ids = np.concatenate([np.asarray(x, np.int64) for x in s if x is not None] or [np.zeros(0, np.int64)])
            best = np.nan_to_num(forward(sent.value, ids, np.cumsum(n) - n, t), nan=-np.inf).argmax(axis=1)
            yield pd.Series(np.split(best, np.cumsum(n)[:-1]) if len(s) else [], index=s.index)

    return F.pandas_udf(run, "array<long>")


def tag(sentences: DataFrame, w: dict[str, np.ndarray], ids: str = "word_ids", out: str = "tag_ids") -> DataFrame:
    return sentences.withColumn(out, first_best_udf(sentences.sparkSession, w)(F.col(ids)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log of the label's softmax share; null for a negative label."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))
    return F.when(label >= 0, F.log(total) + top - F.get(logits, label.cast("int")))


def accuracy(tokens: DataFrame, pred: str, label: str, *keys: str) -> DataFrame:
    """keys, accuracy: share of right predictions among labels that are not negative; null if there are none."""
    right = F.count_if((F.col(pred) == F.col(label)) & (F.col(label) >= 0))
    return tokens.groupBy(*keys).agg(F.try_divide(right, F.count_if(F.col(label) >= 0)).alias("accuracy"))


#: Tokens whose gradients are worked out at once.
TOGETHER = 1 << 16


def sums(w: dict[str, np.ndarray], ids: np.ndarray, start: np.ndarray, y: np.ndarray) -> tuple[float, int, dict[str, np.ndarray]]:
    """The sum of the losses over the labelled tokens of sentences laid end to end, which begin at start; how many these are; and the
    sums of all gradients. What step() gives, for many tokens: a word's part in each tap is summed over its tokens first, and
    the embedding and the convolution are met by word and no more by token."""
    t = tables(w).astype(float)
    edge, filters = t.shape[1] - 1, t.shape[2]
    left, right = np.r_[edge, ids[:-1]], np.r_[ids[1:], edge]
    left[start], right[start[1:] - 1] = edge, edge
    near, weight = (left, ids, right), w["fc.weight"].astype(float)
    by_word = np.zeros((TAPS, (edge + 1) * filters))
    loss, g = 0.0, {"fc.weight": np.zeros(weight.shape), "fc.bias": np.zeros(len(weight)), "conv.bias": np.zeros(filters)}
    real = np.flatnonzero(y >= 0)
    for lo in range(0, len(real), TOGETHER):
        rows = real[lo : lo + TOGETHER]
        at = [x[rows] for x in near]
        h = t[0][at[0]] + t[1][at[1]]
        h += t[2][at[2]]
        h += w["conv.bias"]
        np.maximum(h, 0, out=h)
        d = h @ weight.T
        d += w["fc.bias"]
        d -= d.max(axis=1, keepdims=True)
        here = np.arange(0, d.size, d.shape[1]) + y[rows]
        loss -= float(d.ravel()[here].sum())
        np.exp(d, out=d)
        total = d.sum(axis=1, keepdims=True)
        loss += float(np.log(total).sum())
        d /= total
        d.ravel()[here] -= 1
        dh = d @ weight
        dh *= h > 0
        g["fc.weight"] += d.T @ h
        g["fc.bias"] += d.sum(axis=0)
        g["conv.bias"] += dh.sum(axis=0)
        for k in range(TAPS):
            by_word[k] += np.bincount((at[k][:, None] * filters + np.arange(filters)).ravel(), dh.ravel(), by_word.shape[1])
    s = by_word.reshape(TAPS, edge + 1, filters)[:, :-1]
    e, conv = w["embedding"].astype(float), w["conv.weight"].astype(float)
    g["conv.weight"] = np.stack([x.T @ e for x in s], axis=2)
    g["embedding"] = sum(x @ conv[:, :, k] for k, x in enumerate(s))
    return loss, len(real), g


def step(w: dict[str, np.ndarray], sents: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """Mean loss over the labelled tokens of a batch, its logits, and all gradients."""
    n = np.array([len(x) for x, _ in sents])
    ids, y = (np.concatenate([s[k] for s in sents]).astype(np.int64) for k in (0, 1))
    t = tables(w)
    h, left, right = hidden(t, w["conv.bias"], ids, np.cumsum(n) - n)
    z = h @ w["fc.weight"].T + w["fc.bias"]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    real = y >= 0
    m = max(1, int(real.sum()))
    rows = np.flatnonzero(real)
    loss = float(-np.log(np.maximum(p[rows, y[rows]], 1e-30)).sum() / m)
    d = p.copy()
    d[rows, y[rows]] -= 1
    d = (d * real[:, None] / m).astype(w["fc.weight"].dtype)
    dh = (d @ w["fc.weight"]) * (h > 0)
    g = {"fc.weight": d.T @ h, "fc.bias": d.sum(axis=0), "conv.bias": dh.sum(axis=0)}
    near = np.stack([left, ids, right])
    e = np.concatenate([w["embedding"], np.zeros((1, w["embedding"].shape[1]), w["embedding"].dtype)])
    g["conv.weight"] = np.stack([dh.T @ e[near[k]] for k in range(TAPS)], axis=2)
    ge = np.zeros_like(e)
    for k in range(TAPS):
        np.add.at(ge, near[k], dh @ w["conv.weight"][:, :, k])
    g["embedding"] = ge[:-1]
    return loss, z, g
