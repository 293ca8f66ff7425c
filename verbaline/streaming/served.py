"""A served tagger: messages with state for each worker, and models that are kept by version and read where they are asked for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verbaline.functions.text import web_tokens
from verbaline.operators import cnn, vocab
from verbaline.streaming.tagger import shared_folder

ASKED = "worker string, n long, request_id string, type string, version long, text string"
STATE = "version long, n long, ids array<string>, texts array<string>"


def asked(messages: DataFrame) -> DataFrame:
    """worker, n, request_id, type, version, text: what each worker has to do, n counting up for each worker.

    messages (a stream): worker, seq, request_id, type, version, text. LOAD names the version of the model that the worker answers with
    from then on, and is READY; INFER is answered with it, and waits in the worker's state while none is loaded. Messages
    of one batch are taken in the order of seq, so they may come in any order; other types and null ones ask for nothing.
    The state holds the texts that wait; a worker that never loads keeps its own.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, n, ids, texts = state.get if state.exists else (None, 0, [], [])
        wait, rows = list(zip(ids, texts, strict=True)), []
        for m in pd.concat(list(parts)).sort_values(["seq", "request_id"], kind="stable").itertuples(index=False):
            if m.type == "LOAD" and not pd.isna(m.version):
                version = int(m.version)
                rows.append((m.request_id, "READY", version, None))
                rows += [(i, "INFER", version, t) for i, t in wait]
                wait = []
            elif m.type == "INFER" and version is None:
                wait.append((m.request_id, m.text))
            elif m.type == "INFER":
                rows.append((m.request_id, "INFER", version, m.text))
        state.update((version, n + len(rows), [i for i, _ in wait], [t for _, t in wait]))
        yield pd.DataFrame([(key[0], n + k, *r) for k, r in enumerate(rows)], columns=["worker", "n", "request_id", "type", "version", "text"])

    m = messages.select("worker", "seq", "request_id", "type", "version", "text")
    return m.groupBy("worker").applyInPandasWithState(run, ASKED, STATE, "append", GroupStateTimeout.NoTimeout)


@dataclass
class Model:
    """What a version needs: taps by word, a table of any size, with those of unknown words; the small layers; the tags in order."""

    taps: DataFrame
    unknown: tuple[list[float], ...]
    layers: dict[str, np.ndarray]
    tags: list[str]


def save(at: str, version: int, words: DataFrame, embedding: DataFrame, layers: dict[str, np.ndarray], tags: list[str]) -> None:
    """Writes a version of a model: words (word, word_id), embedding (word_id, vector). The tags come last, so a version with tags is whole."""
    spark, to = words.sparkSession, f"{at}/version={version}"
    cnn.tap_rows(embedding.join(words.select("word_id", "word"), "word_id"), layers, "word").write.mode("overwrite").parquet(f"{to}/taps")
    cnn.to_table(spark, {k: v for k, v in layers.items() if k != "embedding"}).write.mode("overwrite").parquet(f"{to}/layers")
    spark.createDataFrame(list(enumerate(tags)), "tag_id long, tag string").write.mode("overwrite").parquet(f"{to}/tags")


def load(spark: SparkSession, at: str, version: int) -> Model:
    to = f"{at}/version={version}"
    tags = [r.tag for r in spark.read.parquet(f"{to}/tags").orderBy("tag_id").collect()]
    taps = spark.read.parquet(f"{to}/taps")
    row = taps.where(F.col("word") == vocab.UNK).first()
    return Model(taps, (row.as_left, row.as_mid, row.as_right), cnn.from_table(spark.read.parquet(f"{to}/layers")), tags)


def tagged(requests: DataFrame, model: Model, *keys: str) -> DataFrame:
    """keys, words, tags of requests (keys, text), which keys tell apart: the batch tagger. Null texts are left out; empty ones have no words.

    A stream has many batches, so its joins are by shuffle: a broadcast would send the taps through the driver for each of them.
    """
    r = requests.where("text is not null").select(*keys, web_tokens(F.col("text")).alias("words"))
    t = r.select(F.struct(*keys).alias("id"), F.posexplode("words").alias("tok_idx", "word"))
    scored = cnn.scored(t, model.taps.hint("merge"), model.layers, "id", on="word", unknown=model.unknown)
    name = F.get(F.array(*map(F.lit, model.tags)), vocab.argmax(F.col("logits")).cast("int"))
    each = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "word", name.alias("tag")))).alias("s"))
    got = each.select("id.*", F.col("s.tag").alias("tags"))
    return r.join(got.hint("merge"), list(keys), "left").select(*keys, "words", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def answers(rows: DataFrame, models: str) -> DataFrame:
    """request_id, type, words, tags, error for rows of asked(): READY, RESULT, and ERROR for a null text or a version that is not there."""
    spark, keys = rows.sparkSession, ("worker", "n")
    none = F.lit(None).cast("array<string>")
    out = rows.where("type = 'READY'").select("request_id", "type", none.alias("words"), none.alias("tags"), F.lit(None).cast("string").alias("error"))
    ask = rows.where("type = 'INFER'")
    for v in sorted(r.version for r in ask.select("version").distinct().collect()):  # the versions loaded, a few
        of = ask.where(F.col("version") == v)
        try:
            model = load(spark, models, v)
        except Exception as e:  # a version that was never saved, or not wholly: an answer to its messages, and no end of the stream
            out = out.unionByName(of.select("request_id", F.lit("ERROR").alias("type"), none.alias("words"), none.alias("tags"), F.lit(f"no model {v}: {type(e).__name__}").alias("error")))
            continue
        j = of.select(*keys, "request_id", "text").join(tagged(of, model, *keys).hint("merge"), list(keys), "left")
        wrong = F.col("text").isNull()
        out = out.unionByName(j.select("request_id", F.when(wrong, "ERROR").otherwise("RESULT").alias("type"), "words", "tags", F.when(wrong, "no text").alias("error")))
    return out


def serve(messages: DataFrame, models: str, folder: str) -> None:
    """Runs the stream over all there is. What a batch asks for and its answers go to folders of their own by the batch's number, so a
    batch that is run again after a failure replaces itself; a query that is given the folder again goes on with its state."""
    def batch(df: DataFrame, number: int) -> None:
        spark, at = df.sparkSession, f"{folder}/asked/batch={number}"
        df.write.mode("overwrite").parquet(at)
        answers(spark.read.schema(ASKED).parquet(at), models).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = asked(messages).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()


def answered(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/out").drop("batch")


def new_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "served")
