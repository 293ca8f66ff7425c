"""Vocabularies: sorted ranks, encoding with defaults, strict lookups, out-of-vocabulary reports, batches and padding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbaline.streaming.tagger import shared_folder

PAD, UNK = "<PAD>", "<UNK>"


def sorted_ranks(values: DataFrame, column: str, first: int, out: str) -> DataFrame:
    """Distinct non-null values of a column with their rank in code-point order, from `first`.

    Ranked by a short leading part, whose order is the values' own, and then within it; so no task sorts everything.
    """
    v = values.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_p", F.substring(column, 1, 3))
    sizes = v.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = v.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(column)))
    return ranked.join(sizes, "_p").select(column, (F.col("_before") + F.col("_r") - 1 + first).cast("long").alias(out))


def word_vocab(tokens: DataFrame, word: str = "token") -> DataFrame:
    """(word, word_id): <PAD> 0, <UNK> 1, words from 2 in code-point order."""
    words = sorted_ranks(tokens.select(F.col(word).alias("word")), "word", 2, "word_id")
    return words.union(tokens.sparkSession.createDataFrame([(PAD, 0), (UNK, 1)], "word string, word_id long"))


def tag_vocab(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, tag_id): tags from 0 in code-point order."""
    return sorted_ranks(tokens.select(F.col(tag).alias("tag")), "tag", 0, "tag_id")


def encode(tokens: DataFrame, vocab: DataFrame, word: str = "token") -> DataFrame:
    """tokens with word_id; 1 for words that the vocabulary lacks. The vocabulary grows with the corpus, so whether it is broadcast is left to its measured size."""
    v = vocab.select(F.col("word").alias("_w"), "word_id")
    return tokens.join(v, tokens[word] == F.col("_w"), "left").select(*tokens.columns, F.coalesce("word_id", F.lit(1).cast("long")).alias("word_id"))


#: Words of a chunk of documents, about: what a task holds of the look-up at once.
CHUNK_WORDS = 500_000


def chunked(docs: DataFrame, words: str = "words") -> DataFrame:
    """docs (one row a document) in chunks of neighbouring rows, written to the shared folder: chunk, the other columns, at (array:
    each word's place in the chunk's list), and in one row of each chunk that list as listed. Rows without words are left out.

    A word that a chunk holds many times is then looked up once for it, and tokens are never shuffled one by one.
    """
    keep = [c for c in docs.columns if c != words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.greater(pc.list_value_length(b.column(words)), 0), False))
            ends = np.cumsum(pc.list_value_length(b.column(words)).to_numpy())
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(ends // CHUNK_WORDS)) + 1, b.num_rows])  # none of no rows
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = b.slice(lo, hi - lo)
                x = part.column(words).flatten().dictionary_encode()
                offsets = np.r_[0, np.cumsum(pc.list_value_length(part.column(words)).to_numpy())].astype(np.int32)
                at = pa.ListArray.from_arrays(pa.array(offsets), x.indices.cast(pa.int32()))
                listed = pa.array([x.dictionary.to_pylist()] + [None] * (hi - lo - 1), pa.list_(pa.string()))
                chunk = pa.array([uuid.uuid4().hex] * (hi - lo))
                yield pa.RecordBatch.from_arrays([chunk, *(part.column(c) for c in keep), at, listed], ["chunk", *keep, "at", "listed"])

    fields = T.StructType([T.StructField("chunk", T.StringType()), *(docs.schema[c] for c in keep), *T.StructType.fromDDL("at array<int>, listed array<string>")])
    at = shared_folder(docs.sparkSession, "chunks")
    docs.select(*keep, words).mapInArrow(run, fields).write.parquet(at)
    return docs.sparkSession.read.schema(fields).parquet(at)


def listed_words(chunks: DataFrame) -> DataFrame:
    """chunk, pos, token: the chunks' lists of words, in which every word of the documents occurs."""
    return chunks.where("listed is not null").select("chunk", F.posexplode("listed").alias("pos", "token"))


def looked_up(chunks: DataFrame, values: DataFrame, on: str, columns: list[str], fn: Callable[[np.ndarray, dict[str, np.ndarray]], pa.Array], added: T.StructField) -> DataFrame:
    """chunks without at and listed, with a column of one list for each document, made by fn.

    values (on, columns) has numbers, or lists of one length, by word; each chunk meets the rows of its own words. fn gets the
    documents' words laid end to end, as places in the rows (-1: the word has none), with where each document ends, and the rows.
    """
    keep = [c for c in chunks.columns if c not in ("chunk", "at", "listed")]
    met = listed_words(chunks).join(values.select(F.col(on).alias("_on"), *columns), F.col("token") == F.col("_on")).select(F.col("chunk").alias("of"), "pos", *columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        lists = left["at"].chunk(0)
        at, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        place = np.full(at.max() + 1, -1)
        place[right["pos"].to_numpy()] = np.arange(right.num_rows)
        rows = {}
        for c in columns:
            x = right[c].combine_chunks()
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            rows[c] = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False)
        got = fn(place[at], np.cumsum(sizes), rows)
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.table([*(left[c] for c in keep), pa.ListArray.from_arrays(ends, got)], [*keep, added.name])

    fields = T.StructType([*(chunks.schema[c] for c in keep), added])
    return chunks.drop("listed").groupBy("chunk").cogroup(met.groupBy("of")).applyInArrow(run, fields)


def encoded_docs(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """chunks' documents with word_ids, an array in order; 1 for words that the vocabulary lacks."""
    fn = lambda at, _, rows: pa.array(np.r_[rows["word_id"], 1].astype(np.int64)[at])
    return looked_up(chunks, vocab, "word", ["word_id"], fn, T.StructField("word_ids", T.ArrayType(T.LongType())))


def encode_tags(tokens: DataFrame, vocab: DataFrame, tag: str = "tag", strict: bool = True) -> DataFrame:
    """tokens with tag_id; strict fails on a tag that the map lacks, else null."""
    v = vocab.select(F.col("tag").alias("_t"), F.col("tag_id").alias("_id"))
    j = tokens.join(v, tokens[tag].eqNullSafe(F.col("_t")), "left")
    found = F.when(F.col("_id").isNotNull(), F.col("_id")).otherwise(F.raise_error(F.concat(F.lit("unknown tag "), F.coalesce(tokens[tag], F.lit("null")))).cast("long")) if strict else F.col("_id")
    return j.select(*tokens.columns, found.alias("tag_id"))


def unseen(tokens: DataFrame, vocab: DataFrame, column: str, key: str) -> DataFrame:
    """Values of a column that a vocabulary lacks, with how often they occur."""
    counts = tokens.groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n"))
    return counts.join(vocab.select(key), key, "left_anti")


def decode(encoded: DataFrame, vocab: DataFrame, id_col: str = "tag_id", out: str = "tag") -> DataFrame:
    v = vocab.select(F.col(out), F.col(id_col).alias("_id"))
    return encoded.join(v, encoded[id_col] == F.col("_id")).drop("_id")


def batch_ids(sentences: DataFrame, key: str, size: int = 32, seed: int | None = None) -> DataFrame:
    """sentences with batch_id: consecutive ones in the order of the key, or in a random order that the seed fixes; the
    last batch may be short. Ranked by buckets of an order-preserving number, so no task holds all rows. Null keys come
    first; equal keys in any order."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    order = F.col(key) if seed is None else F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    bucket = F.coalesce(F.floor(F.col("_o") / (4096 if seed is None else 2**44)), F.lit(-(2**62)))
    s = sentences.withColumn("_o", order).withColumn("_b", bucket)
    sizes = s.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    r = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)) - 1
    return s.join(sizes, "_b").select(*sentences.columns, F.floor(r / size).cast("long").alias("batch_id"))


def pad(batches: DataFrame, array: str, fill: int, batch: str = "batch_id") -> DataFrame:
    """The array column filled up to the longest of its batch."""
    width = F.max(F.size(array)).over(Window.partitionBy(batch))
    return batches.withColumn("_w", width).withColumn(array, F.concat(F.col(array), F.array_repeat(F.lit(fill).cast("long"), F.col("_w") - F.size(array)))).drop("_w")


def dataset_stats(tokens: DataFrame, sentence: str, word: str, tag: str) -> DataFrame:
    """sentences, vocabulary (distinct words, PAD and UNK included), tags, tokens."""
    return tokens.agg(
        F.count_distinct(sentence).alias("sentences"), (F.count_distinct(word) + 2).alias("vocabulary"), F.count_distinct(tag).alias("tags"), F.count("*").alias("tokens")
    )


def argmax(scores: Column) -> Column:
    """Place from 0 of the first largest number."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")
