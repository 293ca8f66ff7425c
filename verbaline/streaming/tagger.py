"""Online tagging: messages in, tokens or tagged words out, without state between messages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaline.functions.text import html, web_tokens


def guarded(fn: Callable[[list[list[str]]], list[list[str]]]):
    """Column function of words for infer: fn tags many messages at once. If it raises, each message of the batch is tagged
    alone, and those for which it raises again carry its message as their error."""

    def alone(words: list[str]) -> tuple[list[str] | None, str | None]:
        try:
            return fn([words])[0], None
        except Exception as e:  # any failure of a model is an answer to its message, and no end of the stream
            return None, str(e) or type(e).__name__

    def run(s: pd.Series) -> pd.DataFrame:
        words = [[] if w is None else list(w) for w in s]
        try:
            got = [(t, None) for t in fn(words)]
        except Exception:
            got = [alone(w) for w in words]
        return pd.DataFrame(got, index=s.index, columns=["tags", "error"])

    return F.pandas_udf(run, "tags array<string>, error string")


def infer(messages: DataFrame, predict=None, *, key: str = "request_id", text: str = "text") -> DataFrame:
    """key, type, words, tags, error for each message, batch or stream alike.

    RESULT with the words (empty if there are none) and what predict, a column function of the words, gives; ERROR for a
    null text, and where a guarded() predict raises. The key pairs a result with its request.
    """
    none = F.when(F.col(text).isNull(), "no text")
    m = messages.select(key, web_tokens(F.col(text)).alias("words"), none.alias("error"))
    m = m.withColumn("tags", predict(F.col("words")) if predict else F.lit(None).cast("array<string>"))
    if "error" in getattr(m.schema["tags"].dataType, "names", ()):
        m = m.withColumn("error", F.coalesce("error", "tags.error")).withColumn("tags", F.when(F.col("error").isNull(), F.col("tags.tags")))
    return m.select(key, F.when(F.col("error").isNotNull(), "ERROR").otherwise("RESULT").alias("type"), "words", "error", "tags")


def serve(messages: DataFrame, predict=None, *, key: str = "request_id", text: str = "text", kind: str = "type") -> DataFrame:
    """The answers to messages of several types, batch or stream alike: READY for LOAD, that of infer for INFER, none for other
    types or null. The model is there before the first message, so INFER need not wait for LOAD."""
    ready = dispatch(messages, "LOAD", kind).select(key, F.lit("READY").alias("type"))
    return infer(dispatch(messages, "INFER", kind), predict, key=key, text=text).unionByName(ready, allowMissingColumns=True)


def dispatch(messages: DataFrame, kind: str, column: str = "type") -> DataFrame:
    return messages.where(F.col(column) == kind)


def render(results: DataFrame, key: str = "request_id") -> DataFrame:
    """key, html: one element for each word with its tag, escaped."""
    one = F.transform(F.arrays_zip("words", "tags"), lambda x: F.concat(F.lit("<div><span>"), html(x["words"]), F.lit("</span><span>"), html(F.coalesce(x["tags"], F.lit(""))), F.lit("</span></div>")))
    return results.select(key, F.array_join(one, "").alias("html"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='verbaline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(spark: SparkSession, source: str, schema, transform, folder: str | None = None) -> DataFrame:
    """Runs a stream over all files there are in a Parquet source (a pattern: one file, or a folder of them), and returns what it wrote.

    The sink and its log lie in folder; a query that is given the same folder again goes on where it stopped. Without one, in
    a new folder under the shared one that the cluster names.
    """
    at = (folder or shared_folder(spark, "stream")).rstrip("/")
    stream = transform(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
