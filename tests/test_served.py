import numpy as np
import pytest

from verbaline.operators import cnn
from verbaline.streaming import served

MESSAGE = "worker string, seq long, request_id string, type string, version long, text string"
WORDS = ["<PAD>", "<UNK>", "a", "b", "c"]


@pytest.fixture
def models(spark, tmp_path):
    w = {v: cnn.new_weights(len(WORDS), 3, 4, 3, seed=v) for v in (1, 2)}
    words = spark.createDataFrame([(x, i) for i, x in enumerate(WORDS)], "word string, word_id long")
    for v in w:
        e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w[v]["embedding"])], "word_id long, vector array<float>")
        served.save(f"file://{tmp_path}/models", v, words, e, w[v], ["X", "Y", "Z"])
    return f"file://{tmp_path}/models", w


def tags_of(w, text):
    ids = np.array([WORDS.index(x) if x in WORDS else 1 for x in text.split()], np.int64)
    return ["XYZ"[i] for i in cnn.forward(w, ids, np.zeros(1, np.int64)).argmax(axis=1)] if len(ids) else []


def test_waiting_restarts_and_versions(spark, models, tmp_path):
    at, w = models
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/served"

    def put(rows):
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(source)

    def run():
        served.serve(spark.readStream.schema(MESSAGE).parquet(source), at, folder)
        return {r.request_id: r for r in served.answered(spark, folder).collect()}

    put([("p", 5, "p5", "INFER", None, "a b"), ("p", 3, "p3", "INFER", None, None), ("q", 2, "q2", "INFER", None, "c new"), ("q", 1, "q1", "LOAD", 2, None), ("q", 3, "q3", "PING", None, "a")])
    got = run()
    assert set(got) == {"q1", "q2"} and got["q1"].type == "READY"
    assert got["q2"].words == ["c", "new"] and got["q2"].tags == tags_of(w[2], "c new")
    put([("p", 9, "p9", "LOAD", 1, None), ("q", 7, "q7", "INFER", None, ""), ("q", 8, "q8", "LOAD", 9, None), ("q", 9, "q9", "INFER", None, "a"), (None, 1, "n1", "INFER", None, "a")])
    got = run()  # a new query on the same folder: the state of the first goes on
    assert set(got) == {"q1", "q2", "p9", "p5", "p3", "q7", "q8", "q9"}
    assert got["p5"].tags == tags_of(w[1], "a b") and (got["p3"].type, got["p3"].error) == ("ERROR", "no text")
    assert got["q7"].words == [] and got["q7"].tags == [] and got["q9"].type == "ERROR" and got["q9"].error.startswith("no model 9")


def test_stream_equals_batch(spark, models):
    at, w = models
    texts = ["a b c", "b", "", "x a", "c c c c", None]
    rows = spark.createDataFrame([("w", i, f"r{i}", "INFER", 1, t) for i, t in enumerate(texts)], served.ASKED)
    got = {r.request_id: r for r in served.answers(rows, at).collect()}
    assert all(got[f"r{i}"].tags == tags_of(w[1], t) for i, t in enumerate(texts) if t is not None) and got["r5"].type == "ERROR"


def test_batches_send_nothing_through_the_driver(spark, models):
    at, _ = models
    rows = spark.createDataFrame([("w", 0, "r0", "INFER", 1, "a b")], served.ASKED)
    assert "Broadcast" not in served.answers(rows, at)._jdf.queryExecution().executedPlan().toString()
