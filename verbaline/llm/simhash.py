"""SimHash near-duplicates by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verbaline.llm.common import drop, sliced, written
from verbaline.llm.components import components

BITS, SEGMENTS, SEED = 64, 4, 42
WIDTH = BITS // SEGMENTS
#: Counts of shingles by hash, and the parts in which they are added up.
BUCKETS, PARTS = 2**20, 64
#: Pairs left a row of the shingles' lists from which on further turns cost more than they save.
ENOUGH = 4
#: Longs of a set's parities.
LANES = 4


def fingerprint(text: str | None, n: int) -> bytes:
    """8 bytes, most significant first; a bit is 1 if more than half of the shingles' XXH64 values have it."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return bytes(8)
    whole = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_digest(whole, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    pieces = map(whole.__getitem__, map(slice, starts, ends[n - 1 :].tolist()))
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, pieces, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(digests), 4096):
        ones += np.unpackbits(digests[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests)).tobytes()


def fingerprints(docs: DataFrame, *, shingle: int) -> DataFrame:
    """doc_id, fp (long with the fingerprint's bits) for every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = b"".join(fingerprint(t.as_py(), shingle) for t in b.column(1))
            fp = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(2**WIDTH - 1))


def viable(d: list[Column], start: int, most: int) -> Column:
    """The chain from start stays within its budget: the first l segments differ in at most floor(l * most / SEGMENTS) bits."""
    ok, run = F.lit(True), F.lit(0)
    for k in range(SEGMENTS):
        run = run + d[(start + k) % SEGMENTS]
        ok = ok & (run <= (k + 1) * most // SEGMENTS)
    return ok


def links(distinct: DataFrame, most: int) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints with 1 to `most` differing bits, each once.

    Four segments stand in a ring. If two fingerprints differ in at most two bits, some segment starts a chain whose
    running differences stay within 0, 1, 1, 2; so that segment is equal and so is one of the next two. The join is on
    these two segments, 32 bits together; the chain test comes next, and the full distance last. Needs most <= 2, for
    which budgets begin with 0 and 1.
    """
    if not 0 <= most <= 2:
        raise ValueError("two equal segments are only certain up to two differing bits")
    kinds = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), (segment(F.col("fp"), i) * 2**WIDTH + segment(F.col("fp"), j)).alias("key")) for k, (i, j) in enumerate(kinds)))
    keyed = distinct.select("fp", F.inline(rows))
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    d = [F.bit_count(segment(x, i)) for i in range(SEGMENTS)]
    chain = F.lit(False)
    for s in range(SEGMENTS):
        chain = chain | viable(d, s, most)
    near = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, near & chain & (F.bit_count(x) <= most)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, most: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over links of at most `most` bits).

    Documents with one fingerprint are collapsed first, so thousands of copies cost one row; links are then found
    between fingerprints. Null, empty and blank texts have fingerprint zero, linked like any other. Fewer words than a
    shingle: the whole sequence is the only one. Rows with equal doc_id are rows of their own. Null doc_id: never the
    smallest; component_id is null if a class has no other. Empty table: no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs, shingle=shingle), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = components(links(classes.select("fp"), most), "a", "b")
    to = classes.join(near, classes.fp == near.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = to.groupBy("root").agg(F.min("first").alias("component_id"))
    names = to.join(least, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def op6(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by 3-word shingles and at most 2 bits."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, most=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; fewer words than a shingle are one."""
    words = (text or "").encode().lower().split()
    whole, count = b" ".join(words), max(1, len(words) - n + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    pieces = map(whole.__getitem__, map(slice, (ends - lengths)[:count].tolist(), ends[n - 1 :].tolist())) if count > 1 else [whole]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, count)).view(np.int64)


def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) without the rows whose key this task has had, in slices; copies then cost a row a task."""
    seen: set = set()
    for b in sliced(batches):
        at = []
        for i, k in enumerate(zip(*b.column(0).flatten(), strict=True) if pa.types.is_struct(b.column(0).type) else b.column(0)):
            k = tuple(x.as_py() for x in k) if isinstance(k, tuple) else k.as_py()
            if k not in seen:
                seen.add(k)
                at.append(i)
        if at:
            yield b.take(pa.array(at))


def frequencies(keyed: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts (of copies in one task, one) fall in each of BUCKETS by their hash: a table of one size for any input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in unseen(batches):
            for t in b.column(1):
                np.add.at(counts, shingles(t.as_py(), shingle) & (BUCKETS - 1), 1)
        parts = counts.reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])

    def total(rows):
        counts = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return rows.iloc[:1].assign(counts=[counts.tobytes()])

    got = keyed.select("key", "text").mapInArrow(run, "part int, counts binary").groupBy("part").applyInPandas(total, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(got)]) if got else np.zeros(BUCKETS, np.int64)


def prefixes(keyed: DataFrame, shingle: int, least: float) -> DataFrame:
    """key, n (distinct shingles), token, pos: each text's first n - ceil(least * n) + 1 shingles, rare ones first.

    Two sets at a Jaccard similarity of `least` share one of these under any order that is the same for all texts; the
    order by frequency only keeps what many texts share out of the way, so that frequencies may be rough. A text has its
    rows once for every task that holds a copy of it.
    """
    sent = keyed.sparkSession.sparkContext.broadcast(frequencies(keyed, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in unseen(batches):
            size, token, pos = [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), shingle)
                m = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1
                token.append(h[np.lexsort((h, sent.value[h & (BUCKETS - 1)]))[:m]])
                size.append(np.full(m, len(h), np.int32))
                pos.append(np.arange(m, dtype=np.int32))
            key = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in token])))
            yield pa.RecordBatch.from_arrays([key, *(pa.array(np.concatenate(c)) for c in (size, token, pos))], ["key", "n", "token", "pos"])

    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.select("key", "text").mapInArrow(run, f"key {kind}, n int, token long, pos int")


def parities(h: np.ndarray) -> np.ndarray:
    """LANES longs: a bit tells whether an odd number of the hashes have it for their place."""
    bits = np.bincount((h.view(np.uint64) >> np.uint64(32)) % np.uint64(64 * LANES), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").astype(np.int64)


def shingle_sets(keyed: DataFrame, shingle: int) -> DataFrame:
    """key, set: distinct 64-bit hashes of a text's shingles; odd: their parities (see parities())."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingles(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in (sets, [parities(h) for h in sets]))], ["key", "set", "odd"])

    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.select("key", "text").mapInArrow(run, f"key {kind}, set array<long>, odd array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ra, rb) of keys whose sets have a Jaccard similarity of `least` or more."""
    x, y = sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), sets.select(F.col("key").alias("b"), F.col("set").alias("sb"))
    p = pairs.join(x, "a").join(y, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return p.where(F.col("n") >= F.lit(least) * (F.size("sa") + F.size("sb") - F.col("n")) - 1e-9).select("ra", "rb")


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (key, root) with the roots that edges (ra, rb) connect made one."""
    near = components(edges, "ra", "rb")
    return written(roots.join(near, roots.root == near.node, "left").select("key", F.coalesce("component", "root").alias("root")), "roots")


def spread(placed: DataFrame) -> DataFrame:
    """token, c (texts), major (the root that most of them have), most (how many): lists of more than one root."""
    each = placed.groupBy("token", "root").count()
    lists = each.groupBy("token").agg(F.sum("count").alias("c"), F.max_by("root", F.struct("count", "root")).alias("major"), F.max("count").alias("most"))
    return lists.where("most < c")


def sided(side: str, of: str = "") -> list[Column]:
    """key, root, n and pos of a text in a shingle's list, named for one side of a pair."""
    return [F.col(of + c).alias(p + side) for c, p in (("key", ""), ("root", "r"), ("n", "n"), ("pos", "p"))]


def joined(keyed: DataFrame, roots: DataFrame, shingle: int, least: float) -> DataFrame:
    """roots (key, root), made one for every pair of texts whose distinct shingles have a Jaccard similarity of `least`.

    Candidates share a prefix shingle (see prefixes()), so none is missed. Each text is first compared with one text of
    every shingle's list: the one in which the shingle comes earliest, which of a group of altered copies is the least
    altered, then others by hash. Turns are repeated while they help and more pairs are left than rows; they join large
    groups at a cost in proportion to their size. What is left are pairs of different roots. Such a
    pair meets at the first prefix shingle that it has in common, and only if what follows it in both texts is long
    enough for the similarity and their parities differ in no more bits than the sets may have different shingles (a shingle that
    only one set has turns one bit, so sets differ in as many shingles at least); those pairs are compared as whole sets.
    """
    every = written(prefixes(keyed, shingle, least), "prefixes")
    kind = keyed.schema["key"].dataType
    fields = [f"key.{f}" for f in kind.names] if isinstance(kind, StructType) else ["key"]
    ends = every.groupBy("token").agg(*(f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(fields) for f in (F.min, F.max)))
    several = ends.where(" or ".join(f"min{i} <> max{i}" for i in range(len(fields)))).select("token")
    several = written(several, "several")  # the lists' sums are tables of their own, so that Spark can split a long list in the joins with them
    p = written(every.join(several, "token", "left_semi").select("key", "n", "token", "pos").distinct(), "shared")
    drop(every)
    drop(several)
    texts = keyed.join(p.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    sets = written(shingle_sets(texts, shingle), "sets")
    need = F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6
    sizes = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    turn, before = 0, float("inf")
    while True:
        held, placed = p, p.select("key", "n", "token", "pos").join(roots, "key")
        lists = written(spread(placed), "lists")
        p = written(placed.join(lists, "token"), "open")
        drop(held)
        drop(lists)
        rows, left = p.agg(F.count("*"), F.coalesce(F.sum((F.col("c") - F.col("most")).cast("double")), F.lit(0.0))).first()
        if turn and (left <= ENOUGH * rows or left > 0.9 * before):
            break
        other = F.xxhash64(F.lit(turn), "key")
        lead = p.groupBy("token").agg(F.min_by(F.struct("key", "root", "n", "pos"), F.struct("pos", other.alias("h")) if turn == 0 else other).alias("l"))
        lead = written(lead, "lead")
        pairs = p.join(lead, "token").where("root <> l.root").select(*sided("a", "l."), *sided("b"))
        roots = merged(roots, similar(pairs.where(sizes & (F.least("pa", "pb") + rest >= need)).select("a", "b", "ra", "rb").distinct(), sets, least))
        drop(lead)
        turn, before = turn + 1, left
    # Of two texts with different roots at least one is outside the root that most of the list has.
    held = p.join(sets.select("key", *(F.col("odd")[i].alias(f"odd{i}") for i in range(LANES))), "key")
    odd = lambda side: [F.col(f"odd{i}").alias(f"odd{side}{i}") for i in range(LANES)]
    a = held.where("root <> major").select("token", *sided("a"), *odd("a"))
    b = held.select(F.col("token").alias("_t"), *sided("b"), *odd("b"), (F.col("root") == F.col("major")).alias("_m"))
    turned = sum((F.bit_count(F.col(f"odda{i}").bitwiseXOR(F.col(f"oddb{i}"))) for i in range(LANES)), F.lit(0))
    alike = turned <= F.col("na") + F.col("nb") - 2 * F.ceil(need)
    # The first shingle in common has nothing in common before it, so what follows it in both must do.
    met = a.join(b, (F.col("token") == F.col("_t")) & (F.col("ra") != F.col("rb")) & (F.col("_m") | (F.col("a") < F.col("b"))) & sizes & (rest >= need) & alike)
    one, two = (F.struct(F.col(x).alias("key"), F.col("r" + x).alias("root")) for x in "ab")
    met = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return merged(roots, similar(met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb")), sets, least))


def stage(spark, docs: DataFrame, sf_dir: str, shingle: int = 5, most: int = 2, least: float = 0.8) -> DataFrame:
    """Keeps one document, the first by doc_id, of each group of near-duplicates over five-word shingles.

    First all fingerprints within `most` bits are linked, which folds the large groups of copies. Then all different texts
    are compared by their shingles themselves, each pair at a similarity of `least` or more is linked. Empty texts are one
    class. The first document is decided by the doc_id, last if null, then by hashes of the text and of all columns; so
    documents that share a doc_id, or have none, are told apart by their texts. Texts are known by 128 bits of hashes.
    """
    whole = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(whole).alias("hi"), F.xxhash64(F.lit(SEED), whole).alias("lo")).alias("key")
    keyed = docs.select(key, "text")
    rows = docs.select(F.struct("doc_id", key, F.xxhash64(*docs.columns).alias("row")).alias("doc_id"), "text")
    prints = written(fingerprints(rows, shingle=shingle).select("doc_id.*", "fp"), "prints")
    classes = prints.select("fp").distinct()
    near = components(links(classes, most), "a", "b")
    to = classes.join(near, classes.fp == near.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))
    roots = written(prints.select("key", "fp").distinct().join(to, "fp").select("key", "root"), "roots")
    roots = joined(keyed, roots, shingle, least)
    first = prints.join(roots, "key").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "row")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("_kept_id"), F.col("k.key").alias("_kept_key"), F.col("k.row").alias("_kept_row"))
    d = docs.withColumn("_key", key).withColumn("_row", F.xxhash64(*docs.columns))
    same = (F.col("_key") == F.col("_kept_key")) & (F.col("_row") == F.col("_kept_row")) & F.col("doc_id").eqNullSafe(F.col("_kept_id"))
    return d.join(kept, same, "left_semi").dropDuplicates(["_key"]).drop("_key", "_row")
