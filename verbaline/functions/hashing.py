"""The MurmurHash2 family over UTF-8 bytes, many strings at a time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

M32, R32, M64, R64 = 0x5BD1E995, 24, 0xC6A4A7935BD1E995, 47


def grouped(raw: list[bytes], fn: Callable[[np.ndarray, int], np.ndarray], dtype) -> np.ndarray:
    """fn on the byte matrix of each length."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, r in enumerate(raw):
        by[len(r)].append(i)
    out = np.zeros(len(raw), dtype)
    with np.errstate(over="ignore"):
        for n, at in by.items():
            out[at] = fn(np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n), n)
    return out


def blocks(b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole little-endian blocks of each row, and what is left as one number."""
    n, kind = b.shape[1] // width, f"<u{width}"
    whole = np.ascontiguousarray(b[:, : n * width]).view(kind) if n else np.zeros((len(b), 0), kind)
    tail = np.zeros(len(b), kind)
    for j in range(b.shape[1] - n * width):
        tail |= b[:, n * width + j].astype(kind) << np.dtype(kind).type(8 * j)
    return whole, tail


def mixed(k: np.ndarray, m, r: int) -> np.ndarray:
    k = k * m
    return (k ^ (k >> k.dtype.type(r))) * m


def murmur64a(raw: list[bytes], seed: int = 1) -> np.ndarray:
    m = np.uint64(M64)

    def fn(b: np.ndarray, n: int) -> np.ndarray:
        whole, tail = blocks(b, 8)
        h = np.full(len(b), np.uint64(seed) ^ (np.uint64(n) * m), np.uint64)
        for j in range(whole.shape[1]):
            h = (h ^ mixed(whole[:, j], m, R64)) * m
        if n % 8:
            h = (h ^ tail) * m
        h = (h ^ (h >> np.uint64(R64))) * m
        return h ^ (h >> np.uint64(R64))

    return grouped(raw, fn, np.uint64)


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(13))) * np.uint32(M32)
    return h ^ (h >> np.uint32(15))


def murmur2(raw: list[bytes], seed: int = 1) -> np.ndarray:
    """Its endian-neutral and aligned forms give the same values."""
    m = np.uint32(M32)

    def fn(b: np.ndarray, n: int) -> np.ndarray:
        whole, tail = blocks(b, 4)
        h = np.full(len(b), (seed ^ n) & 0xFFFFFFFF, np.uint32)
        for j in range(whole.shape[1]):
            h = (h * m) ^ mixed(whole[:, j], m, R32)
        if n % 4:
            h = (h ^ tail) * m
        return finished(h)

    return grouped(raw, fn, np.uint32)


def murmur2a(raw: list[bytes], seed: int = 1) -> np.ndarray:
    m = np.uint32(M32)

    def fn(b: np.ndarray, n: int) -> np.ndarray:
        whole, tail = blocks(b, 4)
        h = np.full(len(b), seed, np.uint32)
        for k in (*whole.T, tail, np.full(len(b), n, np.uint32)):
            h = (h * m) ^ mixed(k, m, R32)
        return finished(h)

    return grouped(raw, fn, np.uint32)


class Murmur2A:
    """murmur2a of bytes that come in parts; holds the hash so far, up to three bytes that fill no block yet, and the length."""

    def __init__(self, seed: int = 1):
        self.h, self.left, self.n = seed & 0xFFFFFFFF, b"", 0

    def _take(self, k: int) -> None:
        k = k * M32 & 0xFFFFFFFF
        self.h = (self.h * M32 & 0xFFFFFFFF) ^ ((k ^ k >> R32) * M32 & 0xFFFFFFFF)

    def add(self, part: bytes) -> Murmur2A:
        self.n += len(part)
        data = self.left + part
        whole = len(data) // 4 * 4
        for k in np.frombuffer(data[:whole], "<u4").tolist():
            self._take(k)
        self.left = data[whole:]
        return self

    def end(self) -> int:
        """The hash; nothing can be added after it."""
        self._take(int.from_bytes(self.left, "little"))
        self._take(self.n & 0xFFFFFFFF)
        h = (self.h ^ self.h >> 13) * M32 & 0xFFFFFFFF
        return h ^ h >> 15


#: Rows from which on a block of all of them at once is faster than each row's blocks in turn.
TOGETHER = 8


def murmur2a_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """murmur2a of slices of one byte array: a block of all rows at once, longest rows first, so that those still going are in
    front; the last few go on as states of their own."""
    order = np.argsort(start - end, kind="stable")
    at, n = start[order].astype(np.int64), (end - start)[order].astype(np.int64)
    m, data = np.uint32(M32), np.r_[data, np.zeros(4, np.uint8)]
    h, out = np.full(len(n), seed & 0xFFFFFFFF, np.uint32), np.empty(len(n), np.uint32)
    four = lambda i: np.ascontiguousarray(data[i[:, None] + np.arange(4)]).view("<u4")[:, 0]
    going, done = np.searchsorted(-(n // 4), -np.arange(1, n.max(initial=0) // 4 + 1), side="right"), 0
    with np.errstate(over="ignore"):
        for j, g in enumerate(going):
            if g < TOGETHER:
                break
            h[:g] = (h[:g] * m) ^ mixed(four(at[:g] + 4 * j), m, R32)
            done = j + 1
        for i in range(going[done] if done < len(going) else 0):
            state, to = Murmur2A(seed), n[i] // 4 * 4
            state.h = int(h[i])
            h[i] = state.add(data[at[i] + 4 * done : at[i] + to].tobytes()).h
        tail = four(at + n // 4 * 4) & ((np.uint32(1) << (8 * (n % 4)).astype(np.uint32)) - np.uint32(1))
        for k in (tail, n.astype(np.uint32)):
            h = (h * m) ^ mixed(k, m, R32)
        out[order] = finished(h)
    return out


def parts_hash_udf(seed: int = 1):
    """Column function of an array of strings: murmur2a of them one after another; null parts are skipped, a null array gives
    null. The parts of a row already lie side by side in its Arrow batch, so nothing is joined or copied row by row."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            words = b.values.cast(pa.large_binary()).fill_null(b"")
            _, ends, data = words.buffers()
            ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
            cut = ends[b.offsets.to_numpy()]
            h = murmur2a_slices(np.frombuffer(data or b"", np.uint8), cut[:-1], cut[1:], seed)
            yield pa.array(h.astype(np.int64), mask=np.asarray(b.is_null()))

    return F.arrow_udf(run, "long")


def murmur64b(raw: list[bytes], seed: int = 1) -> np.ndarray:
    """Two 32-bit lanes that take the blocks in turn."""
    m = np.uint32(M32)

    def fn(b: np.ndarray, n: int) -> np.ndarray:
        whole, tail = blocks(b, 4)
        lane = [np.full(len(b), (seed & 0xFFFFFFFF) ^ n, np.uint32), np.full(len(b), seed >> 32, np.uint32)]
        pairs = n // 8 * 2
        for j in range(whole.shape[1]):
            at = j % 2 if j < pairs else 0
            lane[at] = (lane[at] * m) ^ mixed(whole[:, j], m, R32)
        if n % 4:
            lane[1] = (lane[1] ^ tail) * m
        for at, r in ((0, 18), (1, 22), (0, 17), (1, 19)):
            lane[at] = (lane[at] ^ (lane[1 - at] >> np.uint32(r))) * m
        return (lane[0].astype(np.uint64) << np.uint64(32)) | lane[1]

    return grouped(raw, fn, np.uint64)


HASHES = {"murmur64a": murmur64a, "murmur2": murmur2, "murmur2a": murmur2a, "murmur64b": murmur64b}


def hash_udf(name: str, seed: int = 1):
    """Column function of a string: 64-bit hashes in two's complement, 32-bit ones as they are; null gives null."""
    fn = HASHES[name]

    def run(s: pd.Series) -> pd.Series:
        there = s.notna()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[there] = fn([x.encode() for x in s[there]], seed).astype(np.int64)
        return out

    return F.pandas_udf(run, "long")


def unsigned(h: Column) -> Column:
    """A two's-complement hash as a decimal without sign."""
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")
