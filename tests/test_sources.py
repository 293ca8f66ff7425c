import glob
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaline.operators import cnn
from verbaline.sources import conllu, onnx_file, vocab_json


def sentences_as_text(rnd, n, end):
    """A file of n sentences with comments, ranges, empty nodes, extra blank lines; and its tokens (sent_id, tok_idx, form, xpos)."""
    lines, want, blank = [], [], 0
    for _ in range(n):
        lines.append("# sent   one")
        for i in range(rnd.randrange(5)):
            form, tag = rnd.choice(["Dog", "cat#", "Été", "a\u0085b", "42"]), rnd.choice(["NN", "_", "VB"])
            want.append((blank, i, form.lower(), None if tag == "_" else tag))
            lines.append("\t".join([str(i + 1), form, "_", "_", tag, *["_"] * rnd.choice([0, 5])]))
            if rnd.random() < 0.3:
                lines.append("\t".join([rnd.choice([f"{i + 1}-{i + 2}", f"{i + 1}.1"]), "x", "_", "_", "NN"]))
        for _ in range(rnd.choice([1, 1, 1, 2, 3])):
            lines.append(rnd.choice(["", "", " \t"]))
            blank += 1
    return end.join(lines) + end, want


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_conllu_by_splits(spark, tmp_path, end):
    text, want = sentences_as_text(random.Random(3), 4000, end)
    (tmp_path / "a.conllu").write_bytes(text.encode())
    (tmp_path / "b.conllu").write_bytes(("\n" + text).encode())  # a blank line first
    rows = lambda df: sorted((r.path[-8], r.sent_id, r.tok_idx, r.form, r.xpos or "") for r in df.collect())
    both = sorted([("a", s, i, f, x or "") for s, i, f, x in want] + [("b", s + 1, i, f, x or "") for s, i, f, x in want])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = conllu.read(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}", lineSep="\n").rdd.getNumPartitions() > 10
        assert rows(got) == both
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.read.text(f"file://{tmp_path}", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    assert rows(conllu.tokens_of(whole)) == both
    assert "Exchange" not in conllu.tokens_of(whole)._jdf.queryExecution().executedPlan().toString()
    q = conllu.read_stream(spark, f"file://{tmp_path}").writeStream.format("memory").queryName("conllu_tokens").option("checkpointLocation", f"{tmp_path}_log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("conllu_tokens")) == both


def test_conllu_without_rows(spark, tmp_path):
    (tmp_path / "e.conllu").write_text("# nothing\n\n\n")
    assert conllu.read(spark, f"file://{tmp_path}").count() == 0
    assert conllu.tokens_of(spark.createDataFrame([("p", None), ("q", "")], "path string, text string")).count() == 0


def test_vocabulary_in_parts(spark, tmp_path):
    odd = ['"', "\\", "}", "{", ",", "é", "a\nb", "", "x: 1,", "<PAD>", "<UNK>"]
    words = {w: i for i, w in enumerate([*odd, *map(str, range(3000))])}
    v = spark.createDataFrame(list(words.items()), "word string, word_id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        vocab_json.write(v, "word", "word_id", f"file://{tmp_path}/v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{tmp_path}/v/part-*"))
    text = "".join(open(f, encoding="utf-8", newline="").read() for f in files)
    assert len(files) > 2 and json.loads(text) == words and text == vocab_json.to_json(v, "word", "word_id").first().json + "\n"
    assert list(json.loads(text))[-2:] == ["<PAD>", "<UNK>"]
    read = lambda at: {r.word: r.word_id for r in vocab_json.read(spark, f"file://{at}", "word", "word_id").collect()}
    assert read(f"{tmp_path}/v") == words
    for i, text in enumerate([json.dumps(words), json.dumps(words, indent=2, ensure_ascii=False), "{}", ""]):
        (tmp_path / f"{i}.json").write_text(text)
        assert read(f"{tmp_path}/{i}.json") == (words if i < 2 else {})
    vocab_json.write(v.limit(0), "word", "word_id", f"file://{tmp_path}/none")
    assert read(f"{tmp_path}/none") == {}


def saved(spark, tmp_path, w, rows=None):
    at = f"{tmp_path}/m.onnx"
    rows = list(enumerate(w["embedding"].tolist())) if rows is None else rows
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "word_id long, vector array<float>, part string")
    onnx_file.write(df, {k: v for k, v in w.items() if k != "embedding"}, f"file://{at}")
    return at


@pytest.mark.parametrize("part_rows", [7, 65536])
def test_onnx_is_read_back_and_runs(spark, tmp_path, monkeypatch, part_rows):
    monkeypatch.setattr(onnx_file, "PART_ROWS", part_rows)
    w = cnn.new_weights(30, 5, 8, 6)
    at = saved(spark, tmp_path, w)
    t = onnx_file.tensors(spark, f"file://{at}")
    small = {r.name: np.array(r["values"], np.float32).reshape(r["shape"]) for r in t.where("name <> 'embedding'").collect()}
    assert set(small) == set(w) - {"embedding"} and all(np.array_equal(small[k], w[k]) for k in small)
    rows = onnx_file.embedding_rows(t).orderBy("word_id").collect()
    assert np.array_equal(np.array([r.vector for r in rows], np.float32), w["embedding"]) and t.where("name = 'embedding'").count() == -(-30 // part_rows)
    d = onnx_file.described(spark, f"file://{at}").first()
    assert d.opset == 15 and d.inputs == ["input(batch_size, sequence_length)"] and d.outputs == ["output(batch_size, sequence_length, 5)"]
    assert d.ops == ["Concat", "Gather", "Transpose", "Conv", "Relu", "Transpose", "Transpose", "MatMul", "Add"]
    onnxruntime = pytest.importorskip("onnxruntime")
    session = onnxruntime.InferenceSession(at, providers=["CPUExecutionProvider"])
    for length in (1, 2, 9):
        ids = np.random.default_rng(length).integers(0, 30, (3, length))
        got = session.run(None, {"input": ids})[0]
        want = cnn.forward(w, ids.ravel(), np.arange(3) * length).reshape(3, length, 5)
        assert np.allclose(got, want, atol=1e-5)


def test_onnx_refuses_gaps_and_takes_no_words(spark, tmp_path):
    w = cnn.new_weights(4, 3, 8, 6)
    for rows in ([(0, [0.0] * 8), (2, [0.0] * 8)], [(0, [0.0] * 8), (0, [1.0] * 8)]):
        with pytest.raises(Exception, match="gaps or repeats"):
            saved(spark, tmp_path, w, rows)
    at = saved(spark, tmp_path, w, [])
    t = onnx_file.tensors(spark, f"file://{at}")
    assert onnx_file.embedding_rows(t).count() == 0 and t.where("name = 'embedding'").first()["shape"] == [0, 8]


def test_conllu_is_read_and_written_without_a_shuffle_of_lines(spark, sf_dir, tmp_path):
    from verbaline.plans import catalogue

    assert "Exchange" not in catalogue.conllu_roundtrip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    line = "\t".join(["{}", "w", "_", "_", "NN"])
    (tmp_path / "a.conllu").write_text("\n".join(line.format(i + 1) for i in range(5000)) + "\n\n" + line.format(1) + "\n")  # a sentence over many splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = conllu.read(spark, f"file://{tmp_path}")
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.sent_id, r.tok_idx) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(0, i) for i in range(5000)] + [(1, 0)]


def test_onnx_roundtrip_makes_the_vocabulary_once(spark, sf_dir, monkeypatch):
    from verbaline.plans import catalogue

    plans, write = [], onnx_file.write
    monkeypatch.setattr(catalogue.onnx_file, "write", lambda e, *rest: (plans.append(e._jdf.queryExecution().toString()), write(e, *rest)))
    assert catalogue.onnx_roundtrip(spark, sf_dir).count() == 5 and "Generate" not in plans[0]
