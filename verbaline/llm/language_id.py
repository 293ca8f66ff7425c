"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import first_by_hash, fold, hash32
from verbaline.llm.nn import Adam, log_softmax, normal, sigmoid, summed

#: Bytes in a sequence: a word is one sequence, a longer one is cut. Units of each direction.
LENGTH, UNITS = 24, 12
#: Labelled documents that the network learns from at most, words of each at most, passes, words in a step.
TRAIN_DOCS, TRAIN_WORDS, EPOCHS, STEP = 3000, 40, 2, 512
#: Sequences that go through the network together when predicting.
TOGETHER = 4096
UNKNOWN = "und"


def new_model(langs: list[str], units: int = UNITS, seed: int = 0) -> dict:
    rng, p = np.random.default_rng(seed), {}
    for d in "fb":
        p[f"x{d}"] = normal(rng, 256, 3 * units, scale=0.3)
        p[f"u{d}"] = normal(rng, units, 3 * units)
        p[f"c{d}"] = np.zeros(units, np.float32)
    p["o"] = normal(rng, 2 * units, len(langs))
    p["ob"] = np.zeros(len(langs), np.float32)
    return {"langs": langs, "p": p}


def cells(p: dict, d: str, bytes_: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, sequences, units) of one direction; live[t] is how many sequences, longest first, reach step t.

    The backward direction reads the same array from the last step to the first; sequences enter as they begin to live.
    """
    steps, n = bytes_.shape
    units = p[f"u{d}"].shape[0]
    out = np.zeros((steps, n, units), np.float32)
    h = np.zeros((n, units), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        m = live[t]
        x, hp = p[f"x{d}"][bytes_[t, :m]], h[:m]
        g = hp @ p[f"u{d}"]
        zr = sigmoid(x[:, : 2 * units] + g[:, : 2 * units])
        z, r = zr[:, :units], zr[:, units:]
        inner = g[:, 2 * units :] + p[f"c{d}"]
        c = np.tanh(x[:, 2 * units :] + r * inner)
        new = c + z * (hp - c)
        if keep is not None:
            keep.append((t, m, hp.copy(), z, r, inner, c))
        h[:m] = new
        out[t, :m] = new
    return out


def backward(p: dict, d: str, bytes_: np.ndarray, kept: list, grad_out: np.ndarray) -> dict:
    """Backpropagation through time for one direction."""
    gx, gu, gc = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"]), np.zeros_like(p[f"c{d}"])
    dh = np.zeros(grad_out.shape[1:], np.float32)
    for t, m, hp, z, r, inner, c in reversed(kept):
        g = dh[:m] + grad_out[t, :m]
        dz = g * (hp - c) * z * (1 - z)
        dc = g * (1 - z) * (1 - c * c)
        dr = dc * inner * r * (1 - r)
        gates = np.concatenate([dz, dr, dc * r], axis=1)
        gu += hp.T @ gates
        gc += (dc * r).sum(axis=0)
        np.add.at(gx, bytes_[t, :m], np.concatenate([dz, dr, dc], axis=1))
        dh[:m] = g * z + gates @ p[f"u{d}"].T
    return {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}


def arrange(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, sequence) bytes with the longest sequence first, how many live at each step, and the order taken."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max(initial=0))
    flat = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in words), np.uint8).reshape(len(words), steps)
    live = (lengths[:, None] > np.arange(steps)).sum(axis=0)
    return np.ascontiguousarray(flat[order].T), live, order


def train(samples: list[tuple[bytes, str]], *, units: int = UNITS, epochs: int = EPOCHS, seed: int = 0) -> dict | None:
    """The network from (word, language) pairs; every byte of a word is labelled with its document's language."""
    if not samples:
        return None
    langs = sorted({x for _, x in samples})
    at = {x: i for i, x in enumerate(langs)}
    model, rng = new_model(langs, units, seed), np.random.default_rng(seed)
    p = model["p"]
    adam, labels = Adam(p, 0.01), np.array([at[x] for _, x in samples])
    total, done = epochs * -(-len(samples) // STEP), 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(samples))
        for lo in range(0, len(samples), STEP):
            rows = shuffled[lo : lo + STEP]
            b, live, order = arrange([samples[i][0] for i in rows])
            y = labels[rows][order]
            kept = {"f": [], "b": []}
            both = np.concatenate([cells(p, d, b, live, kept[d]) for d in "fb"], axis=2)
            mask = np.arange(len(rows))[None, :] < live[:, None]
            g = np.exp(log_softmax(both @ p["o"] + p["ob"]))
            g[:, np.arange(len(rows)), y] -= 1
            g = (g * mask[:, :, None] / mask.sum()).astype(np.float32)
            grads = {"o": np.einsum("tnu,tnl->ul", both, g), "ob": g.sum(axis=(0, 1))}
            down = g @ p["o"].T
            for k, d in enumerate("fb"):
                grads |= backward(p, d, b, kept[d], np.ascontiguousarray(down[:, :, k * units : (k + 1) * units]))
            adam.step(grads, 1 - done / total)
            done += 1
    return model


def label(model: dict, words: list[bytes]) -> np.ndarray:
    """For each word, the sum over its bytes of the languages' probabilities."""
    p, out = model["p"], np.zeros((len(words), len(model["langs"])))
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    for lo in range(0, len(order), TOGETHER):
        rows = order[lo : lo + TOGETHER]
        b, live, o = arrange([words[i] for i in rows])
        if not len(b):
            continue
        logits = sum(cells(p, d, b, live) @ w for d, w in zip("fb", np.split(p["o"], 2), strict=True)) + p["ob"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        e /= e.sum(axis=2, keepdims=True)
        e *= (np.arange(len(rows))[None, :] < live[:, None])[:, :, None]
        out[np.array(rows)[o]] = e.sum(axis=0)
    return out


def sequences(distinct: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The sequences of each word (cut every LENGTH bytes) and the word that each belongs to."""
    if all(len(w) <= LENGTH for w in distinct):
        return distinct, np.arange(len(distinct))
    cut = [(w[i : i + LENGTH], k) for k, w in enumerate(distinct) for i in range(0, len(w), LENGTH)]
    return [c for c, _ in cut], np.array([k for _, k in cut])


def predict(model: dict | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text: the mean over all its bytes that are not white space.

    A word's bytes are labelled once for each batch of texts, however often it occurs.
    """
    n = len(texts)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None or not letters.any():
        return [UNKNOWN] * n, np.zeros(n)
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    owner = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    words = split.flatten().dictionary_encode()
    which, distinct = words.indices.to_numpy(), words.dictionary.cast(pa.binary()).to_pylist()
    cut, of = sequences(distinct)
    by_word = summed(of, label(model, cut), len(distinct))
    sums = np.stack([np.bincount(owner, by_word[which, j], n) for j in range(by_word.shape[1])], axis=1)
    share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
    best = share.argmax(axis=1)
    langs = [model["langs"][j] if ok else UNKNOWN for j, ok in zip(best, letters, strict=True)]
    return langs, np.where(letters, share[np.arange(n), best], 0.0)


def learn(docs: DataFrame, *, most: int = TRAIN_DOCS, words: int = TRAIN_WORDS) -> dict | None:
    """The network from at most `most` labelled documents (doc_id, text, lang), the first by a hash of doc_id and text,
    so that rows which share a doc_id are drawn like others, and `words` words of each, evenly spaced; texts stay on the
    executors."""
    ids = docs.where("lang is not null and text is not null").select("text", "lang", hash32(F.col("doc_id"), F.col("text")).alias("h"))
    near = first_by_hash(ids, "h", most, "text", "lang").select("text", "lang", "h")

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, lang, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = text.as_py().encode().split()
                rows.append((b"\n".join(w[i][:LENGTH] for i in (np.arange(min(words, len(w))) * len(w) // min(words, len(w) or 1)).tolist()), lang, h))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int64()), strict=True)], ["words", "lang", "h"])

    got = sorted(near.mapInArrow(spaced, "words binary, lang string, h long").collect(), key=lambda r: (r.h, bytes(r["words"])))
    return train([(w, r.lang) for r in got for w in bytes(r["words"]).split(b"\n") if w])


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs.

    `und` with score 0 where the text is null or has no letter, or if nothing could be learned. Ties go to the language
    first in code-point order. Repeated rows stay; empty table: no rows. Only doc_id and text are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 4000):
                part = b.slice(lo, 4000)
                langs, score = predict(sent.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
