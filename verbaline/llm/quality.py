"""Quality classification by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import fold, sliced, written
from verbaline.llm.nn import Adam, normal, rounds_of, sigmoid, summed

#: Words in a passage, buckets of words and of their shapes, width of a passage's vector and of its attention.
PASSAGE, WORDS, SHAPES, WIDTH, GATE = 64, 2048, 1024, 16, 8
#: Labelled documents in a shard, about; passes of the first shard over its own, documents in a step.
SHARD_DOCS, EPOCHS, STEP = 3000, 8, 32
#: Rounds of all shards after that, a pass each, and their first rate.
ROUNDS, LATER = 2, 0.003
THRESHOLD = 0.3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words of all texts in order: bucket of the word, bucket of its shape; and the words in each text.

    A shape is the word with each run of small letters, capitals and digits written as a, A and 9.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.drop_null(split.flatten())
    full = pc.not_equal(words, "")
    counts = np.add.reduceat(np.r_[full.to_numpy(zero_copy_only=False), False].astype(np.int64), split.offsets.to_numpy()[:-1]) * (np.diff(split.offsets.to_numpy()) > 0) if len(texts) else np.zeros(0, np.int64)
    d = words.filter(full).dictionary_encode()
    shape = d.dictionary
    for pattern, to in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"[0-9]+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    bucket = lambda a, n: (pd.util.hash_array(np.asarray(a.to_pylist(), object), categorize=False) % n).astype(np.int32) if len(a) else np.zeros(0, np.int32)
    at = d.indices.to_numpy()
    shapes = shape.dictionary_encode()
    return bucket(pc.utf8_lower(d.dictionary), WORDS)[at], bucket(shapes.dictionary, SHAPES)[shapes.indices.to_numpy()][at], counts


def passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all passages, and the text of each; a text without words has none."""
    n = -(-counts // PASSAGE)
    owner = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[owner] + k * PASSAGE, owner


def new_model(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "word": normal(rng, WORDS, WIDTH, scale=0.05), "shape": normal(rng, SHAPES, WIDTH, scale=0.3), "bias": np.zeros(WIDTH, np.float32),
        "v": normal(rng, WIDTH, GATE), "u": normal(rng, WIDTH, GATE), "a": normal(rng, GATE, 1), "out": normal(rng, WIDTH, 1), "c": np.zeros(1, np.float32),
    }


def forward(p: dict, word: np.ndarray, shape: np.ndarray, start: np.ndarray, owner: np.ndarray, n: int) -> dict:
    """Vectors of all passages, their gated attention within each text, and the texts' scores."""
    size = np.diff(np.r_[start, len(word)]).astype(np.float32)[:, None]
    h = np.tanh(np.add.reduceat(p["word"][word] + p["shape"][shape], start, axis=0) / size + p["bias"]) if len(start) else np.zeros((0, WIDTH), np.float32)
    t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
    e = ((t * s) @ p["a"])[:, 0]
    top = np.full(n, -np.inf, np.float32)
    np.maximum.at(top, owner, e)
    e = np.exp(e - top[owner]) if len(e) else e
    weight = e / np.maximum(np.bincount(owner, e, n), 1e-12)[owner] if len(e) else e
    z = summed(owner, (weight[:, None] * h).astype(np.float32), n)
    return {"size": size, "h": h, "t": t, "s": s, "weight": weight.astype(np.float32), "z": z, "score": sigmoid(z @ p["out"] + p["c"])[:, 0]}


def gradients(p: dict, f: dict, word: np.ndarray, shape: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict:
    d = ((f["score"] - y) / len(y)).astype(np.float32)[:, None]
    dz = d @ p["out"].T
    dw = (f["h"] * dz[owner]).sum(axis=1)
    de = f["weight"] * (dw - np.bincount(owner, f["weight"] * dw, len(y))[owner].astype(np.float32))
    dg = de[:, None] * p["a"].T
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["weight"][:, None] * dz[owner] + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
    per = np.repeat(dh / f["size"], f["size"][:, 0].astype(int), axis=0)
    return {
        "word": summed(word, per, WORDS), "shape": summed(shape, per, SHAPES), "bias": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds,
        "a": (f["t"] * f["s"]).T @ de[:, None], "out": f["z"].T @ d, "c": d.sum(axis=0),
    }


def train(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 0, start: dict | None = None, rate: float = 0.01, part: tuple[int, int] = (0, 1)) -> dict | None:
    """The model from (word buckets, shape buckets, words in each passage) of each document, and its 0/1 label; from weights
    start, which change, if given, in the part[0]-th of part[1] rounds."""
    if not len(samples):
        return None
    p, rng = start or new_model(seed), np.random.default_rng(seed)
    if start is None:
        share = np.clip(labels.mean(), 0.01, 0.99)
        p["c"][:] = np.log(share / (1 - share))
    adam, done, total = Adam(p, rate), 0, epochs * -(-len(samples) // STEP)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), STEP):
            rows = order[lo : lo + STEP]
            word, shape, size = (np.concatenate([samples[i][k] for i in rows]) for k in range(3))
            owner = np.repeat(np.arange(len(rows)), [len(samples[i][2]) for i in rows])
            f = forward(p, word, shape, np.cumsum(size) - size, owner, len(rows))
            adam.step(gradients(p, f, word, shape, owner, labels[rows]), 1 - (part[0] + done / total) / part[1])
            done += 1
    return p


def learn(docs: DataFrame, labels: DataFrame, *, shard: int = SHARD_DOCS) -> dict | None:
    """The model from every labelled document, in shards of about `shard` that learn on the executors.

    labels: doc_id, quality; null qualities are left out, a document with several takes the smallest. One shard learns the
    first weights; from these all shards learn side by side, see nn.rounds_of(). Shards are dealt by a hash of doc_id and text,
    so rows which share a doc_id are learned from like others. Only weights reach the driver.
    """
    y = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            word, shape, counts = features(b.column(2).cast(pa.string()))
            cuts = np.r_[0, np.cumsum(counts)]
            raw = lambda v: pa.array([v[lo:hi].astype("<i2").tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw(word), raw(shape)], ["doc_id", "h", "word", "shape"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    every = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(buckets, f"doc_id {kind}, h long, word binary, shape binary")
    rows = written(every.join(y.hint("merge"), "doc_id").select("h", "quality", "word", "shape"), "labelled")  # buckets meet the labels, as they are smaller than texts
    shards = -(-rows.count() // shard)
    if not shards:
        return None
    read = lambda x: np.frombuffer(bytes(x), "<i2").astype(np.int64)
    sizes = lambda n: np.diff(np.r_[np.arange(0, n, PASSAGE), n])

    def taught(t: pd.DataFrame, **how) -> dict:
        t = t.sort_values(["h", "quality"], kind="stable")
        return train([(read(w), read(x), sizes(len(w) // 2)) for w, x in zip(t["word"], t["shape"], strict=True)], (t["quality"] > 0).to_numpy(np.float32), **how)

    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    p = rounds_of(rows.where("shard = 0"), new_model(), lambda _, t, r: taught(t), 1)
    return rounds_of(rows, p, lambda p, t, r: taught(t, start=p, epochs=1, seed=r + 1, rate=LATER, part=(r, ROUNDS)), ROUNDS) if shards > 1 else p


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs, from all passages of the whole text.

    Null, empty and blank texts have no passage; their vector is zero. Without a model (no labels): 0.5. Repeated rows
    stay; empty table: no rows. Only doc_id and text are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            if sent.value is None:
                s = np.full(len(part), 0.5)
            else:
                word, shape, counts = features(part.column(1))
                start, owner = passages(counts)
                s = forward(sent.value, word, shape, start, owner, len(part))["score"].astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from those outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(fold(F.col("doc_id"), 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = score(docs, model)
    return s.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score under the threshold).

    Null, empty and blank texts have the score of no passage, one for all. Rows are judged one by one, so equal rows stay or
    go together. Without labels nothing is rejected. Empty table: no rows. All columns pass through.
    """
    model = learn(docs.where(fold(F.col("doc_id"), 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if sent.value is None:
                yield b
                continue
            word, shape, counts = features(b.column(at).cast(pa.string()))
            start, owner = passages(counts)
            yield b.filter(pa.array(forward(sent.value, word, shape, start, owner, len(counts))["score"] >= THRESHOLD))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
