"""Byte-level BPE over whole tables: a table of distinct words, each encoded and decoded once, joined back by position."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbaline.llm.common import drop, written

#: Unicode white space, and the letters and digits below U+0250, of which no later Unicode version adds any.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: What makes a run of non-spaces one word, which the tokenizer itself takes apart: letters beyond, and an added token's first sign.
FAR = "<\u0250-\U0010ffff"
#: The parts that byte-level BPE encodes by themselves, or several of them where a run is left whole.
WORD = re.compile(
    rf"(?:[{SPACE}]++|\A)(?=[^{SPACE}{FAR}]*+[{FAR}])[^{SPACE}]++"
    rf"|'(?:[stmd]|re|ve|ll)| ?[{LETTER}]++| ?[{DIGIT}]++| ?[^{SPACE}{LETTER}{DIGIT}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Distinct words that a task counts before it sends them on.
FLUSH = 200_000
#: Words sent to every task, the most frequent ones of at most LONGEST bytes: so at most 160 MB for a corpus of any size, 16 MB or so for prose.
SENT, LONGEST = 2**19, 48
#: Words and documents of a chunk, which is one row until its ids come back.
CHUNK_WORDS, CHUNK_DOCS = 2**19, 4000
WORD_COLUMNS = "word string, n long"


def json_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def tokenizer(path: str | None):
    """The vocabulary of a tokenizers file (the installed public one by default), without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(json_path(path))
    tok.no_truncation()
    tok.no_padding()
    return tok


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, piece (bytes): the vocabulary of the file, added tokens included. Its size is the file's, whatever the corpus."""
    with open(json_path(path), encoding="utf-8") as f:
        model = json.load(f)
    # Byte-level vocabularies write a byte as itself if it prints, and the others, in order, as the characters from U+0100.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    rows = [(i, bytearray(byte[c] for c in piece)) for piece, i in model["model"]["vocab"].items()]
    rows += [(t["id"], bytearray(t["content"].encode())) for t in model.get("added_tokens") or [] if t["content"] not in model["model"]["vocab"]]
    return spark.createDataFrame(rows, "id int, piece binary")


def encode_udf(path: str | None = None):
    """Column function of a string: its ids."""
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([e.ids for e in tokenizer(path).encode_batch(part.to_pylist(), add_special_tokens=False)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "piece") -> DataFrame:
    """encoded with its ids as bytes (null or empty ids: no bytes), by a join with the pieces; an id without a piece fails.

    A row's ids stay in one task and in order through the join, as the pieces are a broadcast table of a tokenizer's size; so
    the bytes are put together as they come, without a shuffle. Rows may repeat, and null ids become empty ones.
    """
    rest = [c for c in encoded.columns if c != ids]
    each = encoded.select(F.struct(F.lit(True).alias("_row"), *rest).alias("head"), F.posexplode_outer(ids).alias("pos", "id"))
    each = each.select(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("head")).alias("head"), "pos", "id")
    known = pieces(encoded.sparkSession, path).select(F.col("id").alias("_id"), "piece")
    each = each.join(F.broadcast(known), F.col("id") == F.col("_id"), "left").select("head", "pos", "id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows():
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            starts = np.flatnonzero(t.column("head").is_valid().to_numpy(zero_copy_only=False))
            pos = t.column("pos").fill_null(0).to_numpy(zero_copy_only=False)
            sizes = np.diff(np.r_[starts, t.num_rows])
            if not np.array_equal(pos, np.arange(t.num_rows) - np.repeat(starts, sizes)):
                raise ValueError("ids out of order after their join")
            lost = pc.filter(t.column("id"), pc.and_(t.column("id").is_valid(), t.column("piece").is_null()))
            if len(lost):
                raise ValueError(f"no piece for id {lost[0]}")
            head, none = t.column("head").take(pa.array(starts)), t.column("id").is_null().to_numpy(zero_copy_only=False)
            before = np.r_[0, np.cumsum(~none)]
            lists = pa.ListArray.from_arrays(pa.array(before[np.r_[starts, t.num_rows]], pa.int32()), t.column("id").drop_null())
            raw = t.column("piece").fill_null(b"")
            ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1][np.r_[starts, t.num_rows]]
            piece = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), raw.buffers()[2]])
            return pa.RecordBatch.from_arrays([*(head.field(c) for c in rest), lists, piece], [*rest, ids, out])

        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(b.column("head").is_valid().to_numpy(zero_copy_only=False))
            if not len(starts):  # all of one row that began before
                held.append(b)
                continue
            held.append(b.slice(0, starts[-1]))  # the last row of a batch may go on in the next one
            if sum(h.num_rows for h in held):
                yield rows()
            held = [b.slice(starts[-1])]
        if held:
            yield rows()

    fields = T.StructType([encoded.schema[c] for c in rest] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())])
    return each.mapInArrow(run, fields)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words of all texts. A task sums up what it has seen, then words meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def rows():
            words, n = list(seen), list(seen.values())
            for lo in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 50_000], pa.string()), pa.array(n[lo : lo + 50_000], pa.int64())], ["word", "n"])
            seen.clear()

        for b in batches:
            for t in b.column(0):
                seen.update(WORD.findall(t.as_py() or ""))
                if len(seen) > FLUSH:
                    yield from rows()
        yield from rows()

    return docs.select("text").mapInArrow(run, WORD_COLUMNS).groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """word, n, level, ids, piece: every distinct word once, encoded, and decoded again by the join with the pieces. level rises with n.
    piece is null where it is the word itself, as nearly always, so that no word is stored and shuffled twice."""
    raw_word = F.col("word").cast("binary")
    e = word_counts(docs).select("word", "n", F.floor(F.log2("n") * 32).cast("int").alias("level"), encode_udf(path)("word").alias("ids"))
    encoded = written(e, "bpe-ids")  # by itself, so that a task has one Python worker at a time
    words = written(decode(encoded, path).withColumn("piece", F.nullif("piece", raw_word)), "bpe-words")
    drop(encoded)
    return words


def sent_level(words: DataFrame, most: int) -> int:
    """The least level from which on there are at most `most` words; a level is one of 64 x 32 numbers."""
    total, level = 0, 2**30
    for r in sorted(words.where(F.octet_length("word") <= LONGEST).groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        level = r.level
    return level


class Words:
    """Words by number: ids and bytes of each, end to end."""

    def __init__(self, ids: pa.ListArray, piece: pa.BinaryArray):
        self.ids, self.id_sizes = ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.raw, self.raw_sizes = np.frombuffer(b"".join(piece.to_pylist()), np.uint8), pc.binary_length(piece).to_numpy(zero_copy_only=False).astype(np.int64)

    def and_then(self, other: Words) -> Words:
        both = Words.__new__(Words)
        for k in ("ids", "id_sizes", "raw", "raw_sizes"):
            setattr(both, k, np.concatenate([getattr(self, k), getattr(other, k)]))
        return both


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that `which` names, end to end, and the place after each."""
    n = sizes[which]
    ends = np.cumsum(n)
    starts = (np.cumsum(sizes) - sizes)[which]
    return flat[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


#: What a worker keeps between its tasks of the words sent last: their numbers where documents are split, what they stand for where
#: they are put together.
_KEPT: dict[tuple[str, bool], dict[str, int] | Words] = {}


def kept(name: str, sent, numbers: bool) -> dict[str, int] | Words:
    if (name, numbers) not in _KEPT:
        t = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        one = lambda c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
        _KEPT.clear()
        _KEPT[name, numbers] = {w: i for i, w in enumerate(t["word"].to_pylist())} if numbers else Words(one("ids"), one("piece"))
    return _KEPT[name, numbers]


def chunks(docs: DataFrame, name: str, sent, others: bool) -> DataFrame:
    """chunk, doc_ids, sizes (words of each document), codes, n_others: documents in order as numbers of words, those sent
    first; beyond are the chunk's other words, each with one number. With others: chunk, slot, word for these instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(name, sent, True)
        chunk, total = TaskContext.get().partitionId() << 32, 0
        ids, sizes, codes, rare = [], [], [], {}

        def row(kind):
            if others:
                n = len(rare)
                return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(list(rare), pa.string())], ["chunk", "slot", "word"])
            planes = np.array(codes, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
            cells = [[chunk], [ids], [sizes], [pa.compress(planes, codec="zstd", asbytes=True)], [len(rare)]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], ["chunk", "doc_ids", "sizes", "codes", "n_others"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = WORD.findall(text.as_py() or "")
                if others:
                    for w in words:
                        if w not in known:
                            rare.setdefault(w)
                else:
                    got = list(map(known.get, words))
                    if None in got:
                        got = [rare.setdefault(w, len(known) + len(rare)) if c is None else c for w, c in zip(words, got, strict=True)]
                    codes += got
                    sizes.append(len(words))
                ids.append(doc_id)
                total += len(words)
                if total >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                    yield row(kind)
                    chunk, total = chunk + 1, 0
                    ids, sizes, codes, rare = [], [], [], {}
        if ids:
            yield row(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, slot int, word string" if others else f"chunk long, doc_ids array<{kind}>, sizes array<int>, codes binary, n_others int")


def assembled(rows: DataFrame, name: str, sent, kind: str) -> DataFrame:
    """doc_id, ids, text from chunks and their rare words (found: slot, ids, piece)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                words = kept(name, sent, False)
                want, found = r.column("n_others")[0].as_py(), r.column("found").flatten()
                if len(found) != want:
                    raise ValueError(f"{len(found)} of {want} words of a chunk found")
                if want:
                    found = found.take(pc.sort_indices(found.field("slot")))
                    raw = found.field("ids")
                    ids = pa.array(np.frombuffer(b"".join(raw.to_pylist()), ">u4").astype(np.int32))
                    ends = np.r_[0, np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False) // 4)]
                    words = words.and_then(Words(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), found.field("piece")))
                sizes = r.column("sizes").flatten().to_numpy(zero_copy_only=False)
                total = int(sizes.sum())
                planes = np.frombuffer(pa.decompress(r.column("codes")[0].as_py(), 4 * total, codec="zstd", asbytes=True) if total else b"", np.uint8)
                codes = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
                last = np.cumsum(sizes)
                cut = lambda ends: np.r_[0, np.r_[0, ends][last]]
                ids, ends = gathered(words.ids, words.id_sizes, codes)
                raw, raw_ends = gathered(words.raw, words.raw_sizes, codes)
                raw, at = raw.tobytes(), cut(raw_ends)
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(cut(ends), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([r.column("doc_ids").flatten(), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_ids", "sizes", "codes", "n_others", "found").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, *, path: str | None = None, sent_words: int = SENT) -> DataFrame:
    """doc_id, ids, text (what the ids decode to) for every row of docs, as tokenizers gives them without special tokens added.

    Words are counted over all texts, and each distinct one is encoded once and its ids joined with their pieces. Ids come
    back by position in two ways from this one table: the most frequent words, a table of bounded size, are sent to all
    tasks; each chunk of documents joins its other words by name, once a chunk. Only word numbers are shuffled with the
    documents, never texts.

    docs is read three times, so its rows must come in the same order again, as those of files do; write() others first.
    Null or empty text: no ids, empty text. Words of any length, rows with null or repeated doc_id and repeated rows each
    give their row. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    words = word_table(docs, path)
    level = sent_level(words, sent_words)
    piece = F.coalesce("piece", F.col("word").cast("binary"))
    often = (F.col("level") >= level) & (F.octet_length("word") <= LONGEST)
    t = words.where(often).select("word", "n", "ids", piece.alias("piece")).toArrow()
    t = t.sort_by([("n", "descending"), ("word", "ascending")]).drop_columns("n")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    bytes_of = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), 8, "0")), ""))  # shorter on its way than a list
    found = chunks(docs, name, sent, True).join(words.where(~often).select("word", bytes_of.alias("ids"), "piece"), "word").groupBy("chunk").agg(F.collect_list(F.struct("slot", "ids", piece.alias("piece"))).alias("found"))
    rows = chunks(docs, name, sent, False).join(found, "chunk", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    return assembled(rows, name, sent, docs.schema["doc_id"].dataType.simpleString())


def op11(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded, as digests."""
    d = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
