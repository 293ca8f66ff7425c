"""The rule tokenizer: white-space runs, affixes peeled to a fixpoint, infixes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from verbaline.functions.text import PY_SPACE

# The characters and strings that the rules are made of.
#: The gap between the last two pairs is an empty entry; see prefix().
QUOTES = ["'", '"', "”", "“", "`", "‘", "´", "’", "‚", ",", "„", "»", "«", "「", "」", "『", "』", "（", "）", "〔", "〕", "【", "】", "《", "》", "〈", "〉", "\u2329", "\u232A", "", "⟦", "⟧"]
PUNCTS = ["…", "……", ",", ":", ";", "!", "?", "¿", "؟", "¡", "(", ")", "[", "]", "{", "}", "<", ">", "_", "#", "*", "&", "。", "？", "！", "，", "、", "；", "：", "～", "·", "।", "،", "۔", "؛", "٪"]
HYPHENS = ["-", "–", "—", "--", "---", "——", "~"]
CURRENCY = "$ £ € ¥ ฿ US$ C$ A$ ₽ ﷼ ₴ ₠ ₡ ₢ ₣ ₤ ₥ ₦ ₧ ₨ ₩ ₪ ₫ € ₭ ₮ ₯ ₰ ₱ ₲ ₳ ₴ ₵ ₶ ₷ ₸ ₹ ₺ ₻ ₼ ₽ ₾ ₿".split()
ELLIPSIS = [r"\.\.+", "…"]
POSSESSIVE = ["'s", "'S", "’s", "’S"]

SPANS = "array<struct<start:int,end:int,spacy:boolean>>"


def escaped(words: list[str]) -> list[str]:
    return [re.escape(w) for w in words]


def char_class(chars: str) -> str:
    return "".join(re.escape(c) for c in dict.fromkeys(chars))


@lru_cache
def prefix(currency: bool = False) -> re.Pattern:
    """The prefix that a chunk may begin with; the first alternative wins.

    An empty entry stands among the quotes and matches anywhere, so by default nothing after it is ever reached: the last
    quotes and all currency signs are no prefixes. currency=True leaves the empty entry out.
    """
    # Fixed values, here and in suffix() and infix(): what may be peeled off or cut at.
    entries = [*escaped(["§", "%", "=", "—", "–"]), r"\+(?![0-9])", *escaped(PUNCTS), *ELLIPSIS]
    entries += escaped([q for q in QUOTES if q] + CURRENCY) if currency else escaped(QUOTES[: QUOTES.index("")])
    return re.compile(f"(?:{'|'.join(entries)})")


@lru_cache
def suffix() -> re.Pattern:
    """The longest suffix that a chunk may end with."""
    before_dot = "0-9a-z" + char_class("%²-+|(?:)" + "".join(PUNCTS + QUOTES))
    entries = [*escaped(PUNCTS), *ELLIPSIS, *escaped([q for q in QUOTES if q] + POSSESSIVE + ["—", "–"])]
    entries += [r"(?<=[0-9])\+", r"(?<=°[FfCcKk])\.", f"(?<=[0-9])(?:{'|'.join(escaped(CURRENCY))})", rf"(?<=[{before_dot}])\.", r"(?<=[A-Z][A-Z])\."]
    return re.compile(f"(?:{'|'.join(entries)})\\Z")


@lru_cache
def infix() -> re.Pattern:
    quotes = char_class("".join(QUOTES))
    entries = [*ELLIPSIS, r"(?<=[0-9])[+\-*^](?=[0-9-])", rf"(?<=[a-z{quotes}])\.(?=[A-Z{quotes}])", r"(?<=[A-Za-z]),(?=[A-Za-z])"]
    entries += [f"(?<=[A-Za-z0-9])(?:{'|'.join(escaped(HYPHENS))})(?=[A-Za-z])", r"(?<=[A-Za-z0-9])[:<>=/](?=[A-Za-z])"]
    return re.compile("|".join(entries))


def peel(chunk: str, currency: bool = False) -> tuple[list[str], str, list[str]]:
    """(prefixes, core, suffixes in text order). A prefix and the suffix of what follows it come off together."""
    front, back = [], []
    while chunk:
        p = prefix(currency).match(chunk)
        rest = chunk[p.end() :] if p else chunk
        s = suffix().search(rest)
        if not p and not s:
            break
        if p:
            front.append(p[0])
        if s:
            back.append(s[0])
        chunk = rest[: s.start()] if s else rest
    return front, chunk, back[::-1]


#: Every rule needs a character outside these to act on, so a chunk of them alone is a token.
PLAIN = re.compile("[0-9A-Za-z\u00c0-\u024f]+")


def chunk_pieces(chunk: str, currency: bool = False) -> list[str]:
    """The tokens of a chunk, which depend on the chunk alone."""
    if PLAIN.fullmatch(chunk):
        return [chunk]
    front, core, back = peel(chunk, currency)
    middle: list[str] = [core] if core else []
    if core and "http://" not in core:
        middle, at = [], 0
        for m in infix().finditer(core):
            middle += [x for x in (core[at : m.start()], m[0]) if x]
            at = m.end()
        middle += [core[at:]] if core[at:] else []
    return front + middle + back


RUNS = re.compile(f"[{PY_SPACE}]+|[^{PY_SPACE}]+")


def tokenize(text: str | None, memo: dict[str, list[int]], currency: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, followed by one space) in code points. A run that begins with a space gives it to the token before;
    white space beyond that is a token. memo: lengths of the pieces of chunks seen so far."""
    out: list[tuple[int, int, bool]] = []
    for m in RUNS.finditer(text or ""):
        start, end, chunk = m.start(), m.end(), m[0]
        if chunk[0] == " " and start:
            out[-1] = (*out[-1][:2], True)
            start += 1
            chunk = chunk[1:]
        if not chunk:
            continue
        sizes = memo.get(chunk)
        if sizes is None:
            sizes = memo[chunk] = [len(p) for p in chunk_pieces(chunk, currency)]
        for n in sizes:
            out.append((start, start + n, False))
            start += n
        assert start == end
    return out


#: Chunks remembered by a task at most; then it starts anew.
MEMO = 200_000
#: Tokens, and bytes of text or of packed documents, after which a task sends on what it has, so that its memory is bounded at any size.
SEND, SEND_BYTES = 50_000, 1 << 20


def dealt(texts: pa.Array, currency: bool, memo: dict[str, list[int]]) -> Iterator[tuple[int, list[tuple[str | None, np.ndarray]]]]:
    """Texts in groups of about SEND tokens or one text: the first one's place, and each text with its spans (n, 3)."""
    first, got, n = 0, [], 0
    for i in range(len(texts)):
        if len(memo) > MEMO:
            memo.clear()
        t = texts[i].as_py()
        spans = tokenize(t, memo, currency)
        got.append((t, np.fromiter(chain.from_iterable(spans), np.int64, 3 * len(spans)).reshape(-1, 3)))
        n += len(spans)
        if n >= SEND or i == len(texts) - 1:
            yield first, got
            first, got, n = i + 1, [], 0


def in_bytes(text: str, spans: np.ndarray) -> np.ndarray:
    """The spans with starts and ends in bytes of UTF-8."""
    raw = text.encode()
    if len(raw) != len(text):  # the byte at which each code point begins: all but the bytes 10xxxxxx
        begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        spans = np.c_[np.r_[begins, len(raw)][spans[:, :2]], spans[:, 2]]
    return spans


def rule_tokens_udf(currency: bool = False):
    """Column function text -> spans, as flat Arrow arrays. A task tokenises each distinct chunk once, so nothing is shuffled
    to share work. Null text: null; empty text: no spans."""
    def some(got: list[tuple[str | None, np.ndarray]]) -> pa.Array:
        x = np.concatenate([s for _, s in got])
        spans = pa.StructArray.from_arrays([pa.array(x[:, 0], pa.int32()), pa.array(x[:, 1], pa.int32()), pa.array(x[:, 2] > 0)], ["start", "end", "spacy"])
        ends = np.r_[0, np.cumsum([len(s) for _, s in got])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.array([*(t is None for t, _ in got), False])), spans)

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("spacy", pa.bool_())]))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, list[int]] = {}
        for part in parts:
            yield pa.concat_arrays([some(got).cast(kind) for _, got in dealt(part, currency, memo)] or [pa.array([], kind)])

    return F.arrow_udf(run, SPANS)


def token_rows(currency: bool = False, by_bytes: bool = False):
    """For mapInArrow, batches whose last column is a text: the other columns, tok_idx, start, end, spacy and token for each token;
    by_bytes: start_byte and end_byte besides. Null text: no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for b in batches:
            for first, got in dealt(b.column(b.num_columns - 1), currency, memo):
                n = np.array([len(x) for _, x in got])
                x = np.concatenate([x for _, x in got])
                of = pa.array(first + np.repeat(np.arange(len(got)), n))
                keys = [c.take(of) for c in b.columns[:-1]]
                cols = [pa.array(np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)), pa.array(x[:, 0], pa.int32()), pa.array(x[:, 1], pa.int32()), pa.array(x[:, 2] > 0)]
                cols.append(pa.array([t[i:j] for t, s in got for i, j in s[:, :2].tolist()], pa.string()))
                if by_bytes:
                    y = np.concatenate([in_bytes(t or "", s) for t, s in got])
                    cols += [pa.array(y[:, 0]), pa.array(y[:, 1])]
                yield pa.RecordBatch.from_arrays([*keys, *cols], [*b.schema.names[:-1], "tok_idx", "start", "end", "spacy", "token", "start_byte", "end_byte"][: len(keys) + len(cols)])

    return run


def packed_rows(currency: bool = False):
    """For mapInArrow, batches whose last column is a text: the other columns and buffer, the packed document: byte length, UTF-8
    text, token count, then start byte, end byte and flag of each token; all 32 bits, least byte first. Null text: null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for b in batches:
            for first, got in dealt(b.column(b.num_columns - 1), currency, memo):
                buffers = pa.array([None if t is None else packed(t, x) for t, x in got], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(got)) for c in b.columns[:-1]), buffers], [*b.schema.names[:-1], "buffer"])

    return run


def packed(text: str, spans: np.ndarray) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(4, "little") + raw + len(spans).to_bytes(4, "little") + in_bytes(text, spans).astype("<u4").tobytes()


BLANKS = np.array([bool(re.match(f"[{PY_SPACE}]", chr(i))) for i in range(1 << 16)])


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, batches whose last column is a text: the other columns, run_idx, start, run and is_space for each maximal run
    of white space or of anything else. Runs are slices of the texts' bytes, about SEND_BYTES of them at once or one text."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(sizes // SEND_BYTES)) + 1, b.num_rows])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            texts = [t or "" for t in b.column(b.num_columns - 1).slice(lo, hi - lo).to_pylist()]
            whole = "".join(texts)
            if not whole:
                continue
            raw = whole.encode()
            blank = BLANKS[np.minimum(np.frombuffer(whole.encode("utf-32-le"), np.uint32), 0xFFFF)]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            begins = np.cumsum(lengths) - lengths
            new = np.r_[True, blank[1:] != blank[:-1]]
            new[begins[lengths > 0]] = True
            r = np.flatnonzero(new)
            doc = np.searchsorted(begins, r, side="right") - 1
            byte = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            ends = np.r_[byte[r], len(raw)].astype(np.int32)
            runs = pa.StringArray.from_buffers(len(r), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw))
            idx = np.arange(len(r)) - np.searchsorted(r, begins[doc])
            keys = [c.take(pa.array(lo + doc)) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(idx), pa.array(r - begins[doc]), runs, pa.array(blank[r])], [*b.schema.names[:-1], "run_idx", "start", "run", "is_space"])
