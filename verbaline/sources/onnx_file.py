"""The tagger as an ONNX file, written and read in parts.

Serialized messages that are laid end to end merge into one: repeated fields add up. So every task writes a whole model
that holds nothing but its own rows of the embedding, one more fragment holds the graph and the small layers, and the file
is all of them in a row. The format allows 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the embedding in a fragment; the format's limit.
PART_ROWS, MOST_BYTES = 65536, 2**31 - 1
#: Fixed values of the format: versions, type codes, names of the open axes.
IR, OPSET, FLOAT, INT64, AXES = 8, 15, 1, 7, ("batch_size", "sequence_length")
INT, INTS = 2, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(*fields: tuple[int, int | str | bytes]) -> bytes:
    """Fields (number, value): integers as varints, strings and bytes with their length."""
    out = []
    for number, v in fields:
        if isinstance(v, int):
            out.append(varint(number << 3) + varint(v))
        else:
            raw = v.encode() if isinstance(v, str) else v
            out += [varint(number << 3 | 2), varint(len(raw)), raw]
    return b"".join(out)


def fields(raw: memoryview) -> dict[int, list]:
    """Number -> values of a message, in order; fixed-width fields stay bytes."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            v = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            v, at = raw[at : at + size], at + size
        out.setdefault(key >> 3, []).append(v)
    return out


def tensor(name: str, a: np.ndarray) -> bytes:
    return message(*((1, int(d)) for d in a.shape), (2, FLOAT), (8, name), (9, np.ascontiguousarray(a, "<f4").tobytes()))


def node(op: str, inputs: list[str], output: str, **attributes: int | list[int]) -> bytes:
    attrs = [message((1, k), (3, v), (20, INT)) if isinstance(v, int) else message((1, k), *((8, x) for x in v), (20, INTS)) for k, v in attributes.items()]
    return message(*((1, i) for i in inputs), (2, output), (3, output), (4, op), *((5, a) for a in attrs))


def value(name: str, kind: int, *dims: str | int) -> bytes:
    """A graph's input or output; named dimensions are open."""
    shape = message(*((1, message((2 if isinstance(d, str) else 1, d))) for d in dims))
    return message((1, name), (2, message((1, message((1, kind), (2, shape))))))


def head(layers: dict[str, np.ndarray], parts: int) -> bytes:
    """Versions, graph and small layers: embedding, convolution over three words, ReLU, linear layer."""
    nodes = [
        node("Concat", [f"embedding/{i}" for i in range(parts)], "embedding", axis=0),
        node("Gather", ["embedding", "input"], "vectors", axis=0),
        node("Transpose", ["vectors"], "by_channel", perm=[0, 2, 1]),
        node("Conv", ["by_channel", "conv.weight", "conv.bias"], "taps", kernel_shape=[3], pads=[1, 1]),
        node("Relu", ["taps"], "active"),
        node("Transpose", ["active"], "by_word", perm=[0, 2, 1]),
        node("Transpose", ["fc.weight"], "fc.columns", perm=[1, 0]),
        node("MatMul", ["by_word", "fc.columns"], "product"),
        node("Add", ["product", "fc.bias"], "output"),
    ]
    graph = message(*((1, n) for n in nodes), (2, "tagger"), *((5, tensor(k, v)) for k, v in layers.items()), (11, value("input", INT64, *AXES)), (12, value("output", FLOAT, *AXES, len(layers["fc.bias"]))))
    return message((1, IR), (2, "verbaline"), (7, graph), (8, message((1, ""), (2, OPSET))))


def fragments(embedding: DataFrame, layers: dict[str, np.ndarray]) -> DataFrame:
    """(part, content): the file's pieces in order, from (word_id, vector) rows and the small layers.

    word_id must run from 0 without gaps or repeats, else the job fails; so it does past the format's limit. No rows: an
    embedding of no words.
    """
    spark, dim = embedding.sparkSession, layers["conv.weight"].shape[1]
    words = embedding.agg(F.coalesce(F.max("word_id") + 1, F.lit(0))).first()[0]
    if words * dim * 4 >= MOST_BYTES:
        raise ValueError(f"{words} words of {dim} numbers are beyond the 2 GB of the format")

    def piece(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word_id").combine_chunks()
        part = rows["part"][0].as_py()
        first = part * PART_ROWS
        if not np.array_equal(rows["word_id"].to_numpy(), np.arange(first, min(words, first + PART_ROWS))):
            raise ValueError(f"word ids from {first} on have gaps or repeats")
        vectors = rows["vector"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.table({"part": pa.array([part], pa.int32()), "content": pa.array([message((7, message((5, tensor(f"embedding/{part}", vectors)))))], pa.binary())})

    parts = -(-words // PART_ROWS)
    pieces = embedding.select("word_id", "vector", F.floor(F.col("word_id") / PART_ROWS).cast("int").alias("part")).groupBy("part").applyInArrow(piece, "part int, content binary")
    first = head(layers, max(1, parts)) + (b"" if parts else message((7, message((5, tensor("embedding/0", np.zeros((0, dim), np.float32)))))))
    return spark.createDataFrame([(-1, first)], "part int, content binary").unionByName(pieces)


def write(embedding: DataFrame, layers: dict[str, np.ndarray], path: str) -> None:
    """One file at path, in any store that Spark writes to; the driver passes on a fragment at a time."""
    spark = embedding.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        for r in fragments(embedding, layers).orderBy("part").toLocalIterator():
            out.write(bytes(r.content))
    finally:
        out.close()


def graphs(raw: memoryview) -> Iterator[dict[int, list]]:
    yield from map(fields, fields(raw).get(7, []))


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, part, shape, values): the weights in one or many files; a file is read by one task, a tensor is a row.

    Pieces of one tensor have its name and their number, others part 0. Other types than float: the job fails.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0), b.column(1), strict=True):
                for g in graphs(memoryview(content.as_buffer()).cast("B")):
                    for t in map(fields, g.get(5, [])):
                        if t[2] != [FLOAT]:
                            raise ValueError("only tensors of floats are read")
                        name, _, part = bytes(t[8][0]).decode().partition("/")
                        v = pa.array(np.frombuffer(t[9][0], "<f4") if 9 in t else np.zeros(0, np.float32))
                        shape = pa.array([t.get(1, [])], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([at_row(at), pa.array([name]), pa.array([int(part or 0)], pa.int32()), shape, pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)], ["path", "name", "part", "shape", "values"])

    at_row = lambda at: pa.array([at.as_py()])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, part int, shape array<long>, values array<float>")


def embedding_rows(weights: DataFrame) -> DataFrame:
    """(word_id, vector) from the pieces of the embedding in tensors()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shape, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = pa.array(part * PART_ROWS + np.arange(shape[0]))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1) * shape[1], pa.int32()), values.values)], ["word_id", "vector"])

    return weights.where("name = 'embedding' and shape[0] > 0").select("part", "shape", "values").mapInArrow(run, "word_id long, vector array<float>")


def described(spark: SparkSession, path: str) -> DataFrame:
    """(path, opset, ops, inputs, outputs): the graph's operations in order, and its ends as name(dimensions)."""
    def end(raw: memoryview) -> str:
        v = fields(raw)
        shape = fields(fields(fields(v[2][0])[1][0])[2][0])
        dims = [fields(d) for d in shape.get(1, [])]
        return f"{bytes(v[1][0]).decode()}({', '.join(bytes(d[2][0]).decode() if 2 in d else str(d[1][0]) for d in dims)})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0), b.column(1), strict=True):
                raw = memoryview(content.as_buffer()).cast("B")
                opset = [fields(o)[2][0] for o in fields(raw).get(8, [])]
                ops, ends = [], {11: [], 12: []}
                for g in graphs(raw):
                    ops += [bytes(fields(n)[4][0]).decode() for n in g.get(1, [])]
                    for k, found in ends.items():
                        found += map(end, g.get(k, []))
                yield pa.RecordBatch.from_pylist([{"path": at.as_py(), "opset": max(opset, default=None), "ops": ops, "inputs": ends[11], "outputs": ends[12]}], pa.schema([("path", pa.string()), ("opset", pa.int64()), *((c, pa.list_(pa.string())) for c in ("ops", "inputs", "outputs"))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, opset long, ops array<string>, inputs array<string>, outputs array<string>")
