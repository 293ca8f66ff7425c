import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaline.operators import cnn, features, vocab
from verbaline.sources import conllu, vocab_json
from verbaline.streaming import tagger

CONLLU = """# a comment
1-2\tDon't\t_\t_\t_\t_\t_\t_\t_\t_
1\tThe\tthe\tDET\tDT\t_\t2\tdet\t_\t_
2\tDog\tdog\tNOUN\tNN\t_\t0\troot\t_\t_
2.1\tghost\t_\t_\t_\t_\t_\t_\t_\t_

# nothing but a comment

1\tThe\tthe\tDET\tDT\t_\t2\tdet\t_\t_
2\tCat\tcat\tNOUN\t_\t_\t0\troot\t_\t_
"""


@pytest.fixture
def sentences(spark, tmp_path):
    (tmp_path / "x.conllu").write_text(CONLLU)
    return conllu.read(spark, f"file://{tmp_path}/x.conllu")


def test_conllu(sentences):
    got = [(r.sent_id, r.tok_idx, r.form, r.xpos) for r in sentences.orderBy("sent_id", "tok_idx").collect()]
    assert got == [(0, 0, "the", "DT"), (0, 1, "dog", "NN"), (2, 0, "the", "DT"), (2, 1, "cat", None)]
    assert sorted(r.sentence[1].form for r in conllu.sentences(sentences, "sent_id").collect()) == ["cat", "dog"]


def test_vocabulary(spark, sentences, tmp_path):
    v = vocab.word_vocab(sentences, "form")
    assert {r.word: r.word_id for r in v.collect()} == {"cat": 2, "dog": 3, "the": 4, "<PAD>": 0, "<UNK>": 1}
    t = vocab.tag_vocab(sentences, "xpos")
    assert {r.tag: r.tag_id for r in t.collect()} == {"DT": 0, "NN": 1}
    text = vocab_json.to_json(v, "word", "word_id").first().json
    assert text.startswith('{\n  "cat": 2,\n') and text.endswith('"<PAD>": 0,\n  "<UNK>": 1\n}')
    vocab_json.write(v, "word", "word_id", f"file://{tmp_path}/v")
    assert vocab_json.read(spark, f"file://{tmp_path}/v", "word", "word_id").count() == 5
    odd = spark.createDataFrame([('"', 0), ("\\", 1), ("}", 2), ("é", 3)], "word string, word_id long")
    assert sorted(map(tuple, vocab_json.from_json(vocab_json.to_json(odd, "word", "word_id"), "word", "word_id").collect())) == sorted(map(tuple, odd.collect()))
    with pytest.raises(Exception, match="unknown tag"):
        vocab.encode_tags(sentences, t.where("tag = 'DT'"), "xpos").collect()
    assert vocab.encode_tags(sentences, t, "xpos", strict=False).where("tag_id is null").count() == 1
    assert vocab.dataset_stats(sentences, "sent_id", "form", "xpos").first().vocabulary == 5


def test_batches(spark):
    d = spark.createDataFrame([(i, [1] * (i % 3 + 1)) for i in range(70)], "id long, a array<long>")
    b = vocab.pad(vocab.batch_ids(d, "id"), "a", -1)
    rows = b.orderBy("id").collect()
    assert [r.batch_id for r in rows] == [i // 32 for i in range(70)] and all(len(r.a) == 3 for r in rows[:64]) and rows[0].a == [1, -1, -1]
    shuffled = vocab.batch_ids(d, "id", seed=7)
    assert sorted(r["count"] for r in shuffled.groupBy("batch_id").count().collect()) == [6, 32, 32]


def test_features(spark):
    words = zip("He left . Who can help ?".split(), "PRP VBD . WP MD VB .".split(), "PRON VERB PUNCT PRON AUX VERB PUNCT".split(), "NSUBJ ROOT PUNCT NSUBJ AUX ROOT PUNCT".split(), strict=True)
    t = spark.createDataFrame([(1, i, *w) for i, w in enumerate(words)], "doc_id long, tok_idx long, token string, tag string, upos string, dep string")
    assert features.sentence_level_feats(t).first().feats == 3 and features.wh_question_count(t).first().wh_questions == 1 and features.token_count(t).first().n_tokens == 7


def naive(w, ids):
    e = [w["embedding"][i] for i in ids]
    zero, out = np.zeros(w["embedding"].shape[1]), []
    for t in range(len(ids)):
        near = (e[t - 1] if t else zero, e[t], e[t + 1] if t + 1 < len(ids) else zero)
        h = np.maximum(sum(w["conv.weight"][:, :, k] @ x for k, x in enumerate(near)) + w["conv.bias"], 0)
        out.append(w["fc.weight"] @ h + w["fc.bias"])
    return np.array(out)


def test_network(spark):
    w = cnn.new_weights(20, 5, 8, 6)
    a, b = np.array([3, 4, 5]), np.array([7])
    assert np.allclose(cnn.forward(w, np.r_[a, b], np.array([0, 3])), np.concatenate([naive(w, a), naive(w, b)]), atol=1e-5)
    back = cnn.from_table(cnn.to_table(spark, w))
    assert all(np.array_equal(back[k], w[k]) for k in w)
    df = spark.createDataFrame([(1, [3, 4, 5]), (2, [7]), (3, []), (4, None)], "id long, word_ids array<long>")
    got = {r.id: r.tag_ids for r in cnn.tag(df, w).collect()}
    assert got[1] == naive(w, a).argmax(axis=1).tolist() and got[3] == [] and got[4] == []


def test_gradients():
    w = {k: v.astype(np.float64) for k, v in cnn.new_weights(9, 4, 5, 6).items()}
    batch = [(np.array([2, 3, 4]), np.array([1, -1, 2])), (np.array([5]), np.array([0]))]
    _, _, g = cnn.step(w, batch)
    rng = np.random.default_rng(0)
    for name, v in w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            old = v[at]
            v[at] = old + 1e-5
            up = cnn.step(w, batch)[0]
            v[at] = old - 1e-5
            down = cnn.step(w, batch)[0]
            v[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_loss_and_argmax(spark):
    d = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([0.0, 0.0, 0.0], -1)], "z array<float>, y long")
    r = d.select(cnn.cross_entropy(F.col("z"), F.col("y")).alias("l"), vocab.argmax(F.col("z")).alias("a")).collect()
    assert abs(r[0].l - 0.7584) < 1e-3 and r[0].a == 1 and r[1].l is None and r[1].a == 0
    none = spark.createDataFrame([(1, 0, -1)], "k long, p long, y long")
    assert cnn.accuracy(none, "p", "y", "k").first().accuracy is None


def test_messages(spark):
    m = spark.createDataFrame([("a", "Hi <b>"), ("b", ""), ("c", None)], "request_id string, text string")
    got = {r.request_id: r for r in tagger.infer(m, lambda w: F.transform(w, lambda x: F.lit("NN"))).collect()}
    assert got["a"].words == ["hi", "<", "b", ">"] and got["b"].words == [] and got["c"].type == "ERROR"
    page = {r.request_id: r.html for r in tagger.render(tagger.infer(m, lambda w: F.transform(w, lambda x: F.lit("NN")))).collect()}
    assert "&lt;" in page["a"] and page["b"] == ""


@pytest.mark.parametrize("written_out", [0, 10**6])
def test_taps_equal_the_network(spark, written_out, monkeypatch):
    monkeypatch.setattr(cnn, "WRITTEN_OUT", written_out)
    w = cnn.new_weights(20, 5, 8, 6)
    layers = {k: v for k, v in w.items() if k != "embedding"}
    embedding = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(w["embedding"])], "word_id long, vector array<float>, left string")
    sents = {1: [3, 4, 5, 3], 2: [7], 3: [0, 19]}
    t = spark.createDataFrame([(k, i, x) for k, s in sents.items() for i, x in enumerate(s)], "id long, tok_idx long, word_id long")
    got = {(r.id, r.tok_idx): r.logits for r in cnn.scored(t, cnn.tap_rows(embedding, layers), layers, "id").collect()}
    for k, s in sents.items():
        assert np.allclose([got[k, i] for i in range(len(s))], naive(w, s), atol=1e-5)


def test_chunks_of_documents_meet_words_once(spark, monkeypatch):
    """Encoding and scoring by chunks give what token tables give, and no window or join sees single tokens."""
    from verbaline.operators import tokens

    monkeypatch.setattr(vocab, "CHUNK_WORDS", 7)
    rows = [(i, t) for i, t in enumerate(["a b c a b", "d", "", None, "a a a a a a a a b", "e f g h a", "b"])]
    d = spark.createDataFrame(rows, "id long, text string").coalesce(2)
    chunks = vocab.chunked(d.select("id", F.split("text", " ").alias("words")).withColumn("words", F.filter("words", lambda w: w != "")))
    assert chunks.select("chunk").distinct().count() > 2
    t = tokens.web_token_table(d, "id")
    v = vocab.word_vocab(t.where("token <> 'b'"))
    want = sorted((r.id, r.tok_idx, r.word_id) for r in vocab.encode(t, v).collect())
    got = vocab.encoded_docs(chunks, v).select("id", F.posexplode("word_ids").alias("i", "w"))
    assert sorted(tuple(r) for r in got.collect()) == want
    layers = {k: x for k, x in cnn.new_weights(1, 4, 6, 3, 1).items() if k != "embedding"}
    every = vocab.word_vocab(t).withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(i * F.col("word_id")).cast("float")))
    taps = cnn.tap_rows(every, layers, "word")
    plain = {(r.id, r.tok_idx): r.logits for r in cnn.scored(t.withColumnRenamed("token", "word"), taps, layers, "id", on="word").collect()}
    by_chunk = cnn.scored_docs(chunks, taps, layers)
    assert "Window" not in by_chunk._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
    met = {(r.id, k): x for r in by_chunk.collect() for k, x in enumerate(r.logits)}
    assert met.keys() == plain.keys() and all(abs(a - b) < 1e-12 for k in met for a, b in zip(met[k], plain[k], strict=True))


def test_heads_within_documents_join_no_tokens(spark):
    """The same as the join of token tables, also for rows that share a doc or have none."""
    rows = [(1, ["a", "b", "c", "d", "e"]), (1, ["f", "g"]), (2, ["h"]), (2, []), (3, None), (None, ["i", "j", "k"])]
    d = spark.createDataFrame(rows, "doc_id long, w array<string>").select("doc_id", F.transform("w", lambda t: F.struct(t.alias("token"), F.upper(t).alias("tag"))).alias("s"))
    got = features.heads_within(d, "doc_id", lambda i: F.floor(i / 2), "token", "tag")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    t = d.select("doc_id", F.posexplode("s").alias("tok_idx", "x")).select("doc_id", "tok_idx", "x.*").withColumn("head", F.floor(F.col("tok_idx") / 2))
    want = features.heads(t).select("doc_id", "tok_idx", "head_token", "head_tag")
    key = lambda df: sorted((str(tuple(r)) for r in df.collect()))
    assert key(got) == key(want)
