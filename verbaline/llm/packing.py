"""Packing documents into fixed-size sequences by the linear grouping scheme, on the histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import hash32, hash_bucket, ranked, sliced, written

CAPACITY, END = 1024, 2
#: The added token of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}
#: Pieces longer than CAPACITY / SMALL are grouped; the rest are best-fitted afterwards.
SMALL = 8
#: Groups of equal cardinality, so distinct rounded sizes.
GROUPS = 160
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None):
    """The byte-level BPE of byte_bpe_50k.json; special strings in a text are ordinary text, except those of added in ids_of()."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})


def ids_of(bpe, text: str) -> list[int]:
    """The ids of text; the added token is one id, as tokenizers has it by default."""
    return bpe.encode(text, allowed_special="all") if any(a in text for a in ADDED) else bpe.encode_ordinary(text)


def pieces(docs: DataFrame, *, ranks_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every document's ids and an end id, cut into pieces of `capacity`; only the first piece of a long one is shorter.

    Columns: doc_id, piece, start (ids before it), length, ids_crc32, ids (little-endian unsigned 32-bit; null unless
    keep_ids). The vocabulary is the installed public one, or ranks_path on every executor. Null or empty text: one
    piece with the end id alone. doc_id may be null or repeated; then its pieces are too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe = encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ADDED)
        for b in sliced(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*ids_of(bpe, text.as_py() or ""), END], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[lo:hi].tobytes()
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(raw), raw if keep_ids else None))
            if rows:
                types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PIECE.replace("doc_id long", f"doc_id {kind}"))


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        if c >= least:
            room = c - sizes
            v = np.where(room >= 0, best[np.maximum(room, 0)] + values, -1.0)
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], pick[c] = v[j], j
    take, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            take[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), take


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many sequences): the configuration LP by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        value, take = knapsack(sizes, np.linalg.solve(basis.T, np.ones(k)), capacity)
        if value <= 1 + 1e-7:
            break
        step, x = np.linalg.solve(basis, take.astype(float)), np.linalg.solve(basis, demand.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        basis[:, int(ratio.argmin())] = take
    x = np.floor(np.linalg.solve(basis, demand.astype(float)) + 1e-6).astype(np.int64)
    out, left = [], demand.copy()
    for j in range(k):
        a = basis[:, j].round().astype(np.int64)
        n = min([int(x[j]), *(int(left[i] // a[i]) for i in np.flatnonzero(a))])
        if n > 0:
            left -= a * n
            out.append((a, n))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of equal sequences: (how many, [(length, how many of it in each)]) that hold exactly the given pieces.

    Work and memory depend on the capacity and the number of groups alone, never on the number of pieces.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths lie from 1 to the capacity")
    runs: list[tuple[int, list[tuple[int, int]], int]] = []
    if full := counts.pop(capacity, 0):
        runs.append((full, [(capacity, 1)], 0))
    rest = dict(counts)
    large = sorted((n for n in counts if n > capacity // SMALL), reverse=True)
    total = sum(counts[n] for n in large)
    if total:
        # Equal cardinality: the piece at rank r of the descending order belongs to group r * groups // total.
        queues: dict[int, list[list[int]]] = defaultdict(list)
        rank = 0
        for n in large:
            left = counts[n]
            while left:
                g = rank * groups // total
                here = min(left, -(-(g + 1) * total // groups) - rank)
                queues[g].append([n, here])
                rank, left = rank + here, left - here
        keys = sorted(queues)
        sizes = np.array([queues[g][0][0] for g in keys])
        demand = np.array([sum(c for _, c in queues[g]) for g in keys])
        for a, n in configurations(sizes, demand, capacity):
            while n:
                use = [(queues[keys[j]], int(a[j])) for j in np.flatnonzero(a)]
                times = min([n, *(max(1, q[0][1] // m) for q, m in use)])
                items: list[tuple[int, int]] = []
                for q, m in use:
                    need = m * times
                    while need:
                        take = min(need, q[0][1])
                        items.append((q[0][0], take // times if take == m * times else take))
                        q[0][1] -= take
                        need -= take
                        if not q[0][1]:
                            q.pop(0)
                for length, m in items:
                    rest[length] -= m * times
                runs.append((times, items, capacity - sum(length * m for length, m in items)))
                n -= times
    # Best fit, longest first, over runs of equal sequences: a piece goes where the least room is left over.
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for n, items, room in runs:
        rooms[room].append((n, items))
    open_rooms = sorted(rooms)

    def put(room: int, run: tuple[int, list[tuple[int, int]]]) -> None:
        if not rooms[room]:
            insort(open_rooms, room)
        rooms[room].append(run)

    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                q = capacity // length
                put(capacity, (max(1, left // q), []))
                continue
            room = open_rooms[at]
            n, items = rooms[room].pop()
            if not rooms[room]:
                open_rooms.pop(at)
            q = min(room // length, left)
            used = min(n, left // q)
            if n > used:
                put(room, (n - used, items))
            put(room - q * length, (used, [*items, (length, q)]))
            left -= used * q
    return [(n, items) for room in sorted(rooms) for n, items in rooms[room]]


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces with sequence_id and offset added: sequences of at most `capacity`, gapless from 0.

    The driver sees how many pieces have each length, at most `capacity` numbers, and sends back runs of equal
    sequences, a table bounded by capacity and groups alone. Each piece then finds its run by its rank among the pieces
    of its length. Pieces of one length are interchangeable, so ties cannot matter. Empty table: no rows.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows, first, used = [], 0, defaultdict(int)
    for n, items in plan(counts, capacity, groups):
        offset = 0
        for length, m in items:
            lo = used[length]
            used[length] = lo + n * m
            rows.append((length, lo, lo + n * m, m, first, offset))
            offset += length * m
        first += n
    runs = spark.createDataFrame(rows, "length long, lo long, hi long, m long, first long, base long")
    h = hash32(F.col("doc_id"), F.col("piece"))
    d = ranked(pieces.withColumn("h", h), ["length"], hash_bucket(F.col("h"), sum(counts.values())), [F.col("h"), F.col("doc_id"), F.col("piece")], {"rank": None})
    d = d.alias("d").join(F.broadcast(runs).alias("r"), (F.col("d.length") == F.col("r.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    sequence, offset = F.col("first") + F.floor(k / F.col("m")), F.col("base") + (k % F.col("m")) * F.col("r.length")
    return d.select(*(F.col(f"d.{c}") for c in pieces.columns), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents, packed. The ids' digests are taken where the ids are made, so ids need not be shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(written(pieces(docs, keep_ids=False).drop("ids"), "pieces"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their ids, one row per piece. Null and empty texts: a piece of the end id. Equal rows are packed
    each for itself, pieces of one length in any order among them. Empty table: no rows. Other columns are not kept."""
    return pack(written(pieces(docs), "pieces"))
