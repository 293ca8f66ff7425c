"""Secret scans: patterns, and a character convolutional network over every candidate with its surroundings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaline.llm.common import LOWER, UPPER, hash32, sliced, written
from verbaline.llm.nn import Adam, normal, rounds_of, sigmoid

#: Fixed patterns and least lengths of the base kinds. Letters of the first group count in either case.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS, MODEL_KIND = ("assign", "access", "hex"), "model"
MARKS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: A candidate: a run of such characters, as short as a base value may be, with a digit, with a capital after a small letter,
#: or with any letter if it is longer than words are. Bytes of surroundings on either side, and of one window.
CANDIDATE, AROUND, WINDOW, OVERLAP = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_VALUE), 16, 80, 32
ODD, LETTER, LONG = re.compile(r"[0-9]|[a-z][A-Z]"), re.compile(r"[A-Za-z]"), 16
#: The network: width of a byte's vector, filters, width of a filter.
EMBED, FILTERS, KERNEL = 6, 16, 5
#: Findings of the more frequent label in a shard, about; steps of the first shard, windows in a step; recall that the threshold must keep.
SHARD, STEPS, STEP, RECALL = 3000, 800, 64, 0.98
#: Rounds of all shards after that, a pass each, and their first rate. Logits are counted in parts of 1 / GRID.
ROUNDS, LATER, GRID = 2, 0.002, 1024
#: Made keys and made names, put in the place of other findings: alphabets, least and largest length, what joins a name's words.
ALPHABETS = (UPPER + LOWER + "0123456789", UPPER + "0123456789", LOWER + "0123456789", UPPER + LOWER + "0123456789+/", UPPER + LOWER + "0123456789_-", "0123456789ABCDEF")
MADE, JOINTS = (20, 64), "/-_."


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, in code points, by start and then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if ODD.search(m[0]) or len(m[0]) >= LONG and LETTER.search(m[0])]


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The candidate and its surroundings, in windows that overlap if it is long: nothing of it stays unread."""
    raw = text[max(0, start - AROUND) : end + AROUND].encode()
    step = WINDOW - OVERLAP
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - OVERLAP), step)]


def suspects(b: pa.StringArray) -> np.ndarray:
    """Which texts may hold a base match: found on the batch's bytes at once; the patterns decide."""
    n = len(b)
    offsets = np.frombuffer(b.buffers()[1], np.int32, n + 1, b.offset * 4)
    raw = memoryview(b.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    data, offsets = np.frombuffer(raw, np.uint8), offsets - offsets[0]
    found: list[int] = []
    low = bytes(raw).lower()
    for mark in (*MARKS, b"akia"):
        at = low.find(mark)
        while at >= 0:
            found.append(at)
            at = low.find(mark, at + 1)
    base = np.zeros(n, bool)
    # A run of 24 holds three neighbours of every eighth byte.
    some = data[::8]
    some = ((some - np.uint8(48)) < 10) | ((some - np.uint8(97)) < 6)
    found += (np.flatnonzero(some[:-2] & some[1:-1] & some[2:]) * 8).tolist() if len(some) > 2 else []
    # The run may begin in the text after the one that its first byte lies in, so both are looked at.
    texts = np.searchsorted(offsets, np.array(found, np.int64), "right") - 1
    base[np.clip(texts, 0, n - 1)] = True
    texts = np.searchsorted(offsets, np.array(found, np.int64) + 16, "right") - 1
    base[np.clip(texts, 0, n - 1)] = True
    return base


def inspect(texts: pa.StringArray) -> tuple[list[list[dict]], list[list[dict]]]:
    """For each text, its base spans, and its candidates with their windows; base says that one overlaps a base span."""
    base = suspects(texts)
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    cands: list[list[dict]] = [[] for _ in range(len(texts))]
    for i, t in enumerate(texts.to_pylist()):
        s = base_spans(t) if base[i] else []
        spans[i] = [{"kind": k, "start": x, "end": y} for k, x, y in s]
        cands[i] = [{"start": x, "end": y, "base": any(p < y and x < q for _, p, q in s), "windows": windows(t, x, y)} for x, y in candidates(t)]
    return spans, cands


def decide(cands: list[list[dict]], model: dict | None) -> list[list[dict]]:
    """For each text, the candidates beside base spans whose calibrated probability reaches the threshold."""
    added: list[list[dict]] = [[] for _ in cands]
    rows = [(i, c) for i, cs in enumerate(cands) for c in cs if not c["base"]] if model else []
    for lo in range(0, len(rows), 512):
        part = rows[lo : lo + 512]
        z = forward(model["p"], rows_of([w for _, c in part for w in c["windows"]]))[0]
        first = np.cumsum([0, *(len(c["windows"]) for _, c in part)])[:-1]
        for (i, c), v in zip(part, np.maximum.reduceat(z, first), strict=True):
            if sigmoid(model["a"] * v + model["b"]) >= model["threshold"]:
                added[i].append({"kind": MODEL_KIND, "start": c["start"], "end": c["end"]})
    return added


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
CANDIDATES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("windows", pa.list_(pa.binary()))]))
SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans and candidates, as inspect() gives them, for every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans, cands = inspect(b.column(1).cast(pa.string()).fill_null(""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS), pa.array(cands, CANDIDATES)], ["doc_id", "spans", "candidates"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS_SQL}, candidates array<struct<start:bigint,end:bigint,base:boolean,windows:array<binary>>>")


def rows_of(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in raw), np.uint8).reshape(len(raw), WINDOW)


def forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits of windows (rows of WINDOW bytes): embedding, convolution, ReLU, largest and mean over all places, linear."""
    e = p["embed"][x]
    n = WINDOW - KERNEL + 1
    col = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), n, KERNEL * EMBED)
    a = np.maximum(col @ p["conv"] + p["cb"], 0)
    top = a.argmax(axis=1)
    pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(axis=1)], axis=1)
    return (pooled @ p["out"])[:, 0] + p["b"][0], {"col": col, "a": a, "top": top, "pooled": pooled}


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {"embed": normal(rng, 256, EMBED, scale=0.3), "conv": normal(rng, KERNEL * EMBED, FILTERS), "cb": np.zeros(FILTERS, np.float32), "out": normal(rng, 2 * FILTERS, 1), "b": np.zeros(1, np.float32)}


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0, *, start: dict | None = None, steps: int = STEPS, rate: float = 0.005, part: tuple[int, int] = (0, 1)) -> dict[str, np.ndarray]:
    """The network from windows and labels, every label weighing half; from weights start, which change, if given, in the
    part[0]-th of part[1] rounds."""
    rng = np.random.default_rng(seed)
    p = start or new_model(rng)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    adam, order = Adam(p, rate), rng.permutation(len(x))
    n = WINDOW - KERNEL + 1
    for done in range(steps):
        r = np.take(order, np.arange(done * STEP, (done + 1) * STEP), mode="wrap")
        z, f = forward(p, x[r])
        d = ((sigmoid(z) - y[r]) * weight[r] / len(r)).astype(np.float32)[:, None]
        dp = d @ p["out"].T
        da = np.repeat(dp[:, None, FILTERS:] / n, n, axis=1)
        np.put_along_axis(da, f["top"][:, None, :], np.take_along_axis(da, f["top"][:, None, :], 1) + dp[:, None, :FILTERS], 1)
        da *= f["a"] > 0
        dcol = da @ p["conv"].T
        de = np.zeros((len(r), WINDOW, EMBED), np.float32)
        for k in range(KERNEL):
            de[:, k : k + n] += dcol[:, :, k * EMBED : (k + 1) * EMBED]
        ge = np.zeros_like(p["embed"])
        np.add.at(ge, x[r].ravel(), de.reshape(-1, EMBED))
        flat = f["col"].reshape(-1, KERNEL * EMBED)
        adam.step({"embed": ge, "conv": flat.T @ da.reshape(-1, FILTERS), "cb": da.sum(axis=(0, 1)), "out": f["pooled"].T @ d, "b": d.sum(axis=0)}, 1 - (part[0] + done / steps) / part[1])
    return p


Findings = list[tuple[list[bytes], bool]]


def parted(findings: Findings) -> tuple[Findings, Findings]:
    """Four fifths, to fit the network, and the rest, to calibrate it; all for both if the rest has but one label."""
    rest = findings[4::5]
    return ([f for i, f in enumerate(findings) if i % 5 != 4], rest) if len({y for _, y in rest}) == 2 else (findings, findings)


def flat(findings: Findings) -> tuple[np.ndarray, np.ndarray]:
    """All windows, and the label of each."""
    return rows_of([w for ws, _ in findings for w in ws]), np.array([float(y) for ws, y in findings for _ in ws], np.float32)


def logits(p: dict, findings: Findings) -> np.ndarray:
    return np.array([forward(p, rows_of(ws))[0].max() for ws, _ in findings])


def calibrated(p: dict, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> dict:
    """The network p with its calibration and threshold from logits, labels and how often each pair occurs: a logistic map,
    and the highest threshold that keeps RECALL of the true ones."""
    a, b, share = 1.0, 0.0, n / n.sum()
    for _ in range(200):  # gradient descent on the two numbers of the map, drawn towards the identity
        d = (sigmoid(a * z + b) - y) * share
        a, b = a - 0.1 * ((d * z).sum() + 0.01 * (a - 1)), b - 0.1 * (d.sum() + 0.01 * b)
    true = sigmoid(a * z[y > 0] + b)
    order = np.argsort(true)
    ends = np.cumsum(n[y > 0][order])
    keep = float(true[order][np.searchsorted(ends, int(np.floor((1 - RECALL) * ends[-1])), "right")])
    return {"p": p, "a": float(a), "b": float(b), "threshold": keep}


def train(findings: Findings) -> dict | None:
    """Network, calibration and threshold from findings of one place."""
    if len({y for _, y in findings}) < 2:
        return None
    some, rest = parted(findings)
    p = fit(*flat(some))
    return calibrated(p, logits(p, rest), np.array([float(y) for _, y in rest]), np.ones(len(rest), np.int64))


def made_key(rng: np.random.Generator) -> str:
    """A random key: a run over one alphabet with a digit in it, half of them behind a short prefix of small letters."""
    letters = ALPHABETS[rng.integers(len(ALPHABETS))]
    run = [letters[i] for i in rng.integers(len(letters), size=rng.integers(MADE[0], MADE[1] + 1))]
    run[rng.integers(len(run))] = str(rng.integers(10))
    prefix = "".join(LOWER[i] for i in rng.integers(26, size=rng.integers(2, 6))) + "_-"[rng.integers(2)] if rng.random() < 0.5 else ""
    return prefix + "".join(run)


def made_name(rng: np.random.Generator, words: list[str]) -> str:
    """Words joined like a path, a host or an identifier, some with a number: as long as a key, but none."""
    some = [words[i] for i in rng.integers(len(words), size=rng.integers(2, 6))]
    some = [w.capitalize() for w in some] if rng.random() < 0.3 else some
    name = ("" if rng.random() < 0.2 else JOINTS[rng.integers(len(JOINTS))]).join(some)
    return name + JOINTS[rng.integers(len(JOINTS))] + str(rng.integers(10**4)) if rng.random() < 0.5 else name


def taught(found: list[tuple[list[bytes], int, int, bool]], seed: int = 0) -> list[tuple[list[bytes], bool]]:
    """(windows, true) to learn from: the findings (windows, start, end, base) themselves, and what they show when changed.

    A base finding stands beside a keyword, from which alone the network would tell it; so in half of those whose value is
    LONG the keyword is overwritten with letters. And in the surroundings of every finding without one, a made key, which is
    true, and a made name, which is not, take the finding's place: there only the value decides.
    """
    rng, out = np.random.default_rng(seed), []
    whole = [(ws[0].decode(), min(AROUND, start), end - start, base) for ws, start, end, base in found if len(ws) == 1]
    words = sorted({w for text, *_, base in whole if not base for w in re.findall("[a-z]{3,12}", text)}) or ["name", "file", "page"]
    blot = lambda m: "".join(LOWER[i] for i in rng.integers(26, size=len(m[0])))
    for ws, start, end, base in found:
        if base and end - start >= LONG and rng.random() < 0.5:
            ws = [re.sub(b"|".join(MARKS), lambda m: blot(m).encode(), w, flags=re.IGNORECASE) for w in ws]
        out.append((ws, base))
    for text, at, length, base in whole:
        if not base:
            for value, true in ((made_key(rng), True), (made_name(rng, words), False)):
                out.append((windows(text[:at] + value + text[at + length :], at, at + len(value)), true))
    return [out[i] for i in rng.permutation(len(out))]


def learn(scanned: DataFrame, shard: int = SHARD) -> dict | None:
    """The network from every finding. A candidate that overlaps a base span is a true finding, others are not; see taught()
    for what is made of them. Without findings of both kinds: None.

    Findings are dealt by a hash of doc_id, place and windows, so that rows which share a doc_id are dealt like others, into
    shards with about `shard` of the more frequent label. One shard fits the first weights; from these all shards learn side by side,
    see nn.rounds_of(). What each holds back calibrates the network: only weights and counts of logits reach the driver.
    """
    c = scanned.select("doc_id", F.explode("candidates").alias("c")).select("c.*", hash32(F.col("doc_id"), F.col("c.start"), F.xxhash64("c.windows")).alias("h"))
    counts = [r.n for r in c.groupBy("base").agg(F.count("*").alias("n")).collect()]
    if len(counts) < 2:
        return None
    shards = -(-max(counts) // shard)
    dealt = c.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def own(t: pd.DataFrame) -> tuple[Findings, Findings]:
        rows = [([bytes(w) for w in ws], int(x), int(y), bool(v)) for ws, x, y, v in sorted(zip(t["windows"], t["start"], t["end"], t["base"], strict=True), key=lambda r: (r[1], r[2], [bytes(w) for w in r[0]]))]
        return parted(taught(rows, seed=int(t["shard"].iloc[0])))

    def first(p: dict, t: pd.DataFrame, r: int) -> dict:
        return fit(*flat(own(t)[0]))

    def later(p: dict, t: pd.DataFrame, r: int) -> dict:
        x, y = flat(own(t)[0])
        return fit(x, y, r + 1, start=p, steps=-(-len(x) // STEP), rate=LATER, part=(r, ROUNDS)) if len(set(y.tolist())) == 2 else p

    p = rounds_of(dealt.where("shard = 0"), new_model(np.random.default_rng(0)), first, 1)
    p = rounds_of(dealt, p, later, ROUNDS) if shards > 1 else p
    sent = scanned.sparkSession.sparkContext.broadcast(p)

    def held(t: pd.DataFrame) -> pd.DataFrame:
        rest = own(t)[1]
        at = np.floor(logits(sent.value, rest) * GRID).astype(np.int64)
        return pd.DataFrame({"z": at, "base": [y for _, y in rest]}).value_counts().rename("n").reset_index()

    got = dealt.groupBy("shard").applyInPandas(held, "z long, base boolean, n long").groupBy("z", "base").agg(F.sum("n").alias("n")).orderBy("z", "base").collect()
    return calibrated(p, np.array([r.z / GRID for r in got]), np.array([float(r.base) for r in got]), np.array([r.n for r in got]))


def judge(scanned: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, spans, added, as decide() gives them."""
    sent = scanned.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2000):
            added = decide(b.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(added, SPANS)], ["doc_id", "spans", "added"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(run, f"doc_id {kind}, spans {SPANS_SQL}, added {SPANS_SQL}")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (base), added (by the network) for every row of docs, in code points, ends exclusive.

    Null or empty text: no spans. Without findings of both kinds nothing can be learned and nothing is added. Long
    candidates are read in overlapping windows. Repeated rows stay; empty table: no rows. Only doc_id and text are read.
    """
    scanned = written(scan(docs), "scan")
    return judge(scanned, learn(scanned))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op8(spark, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = F.array(*map(F.lit, (*KINDS, MODEL_KIND)))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s.start, F.array_position(order, s.kind), s.end, s.kind))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.concat("spans", "added")).alias("spans"))


def mask(text: str | None, spans: list[dict], mark: str) -> str | None:
    """text with every span, overlapping ones together, replaced by mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def stage(spark, docs: DataFrame, sf_dir: str, mark: str = "[SECRET]") -> DataFrame:
    """Every document stays; base and added spans in its text are masked. n_chars follows the text.

    The network learns from one scan; a second one masks each text where it lies, so rows need no key. Null, empty and blank
    texts stay as they are; equal rows are masked alike; an empty table gives none.
    """
    sent = spark.sparkContext.broadcast(learn(written(scan(docs).select("doc_id", "candidates"), "scan")))
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans, cands = inspect(b.column(at).cast(pa.string()).fill_null(""))
            added = decide(cands, sent.value)
            texts = [mask(t, s + a, mark) for t, s, a in zip(b.column(at).to_pylist(), spans, added, strict=True)]
            arrays = {c: b.column(i) for i, c in enumerate(columns)} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), columns)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in columns else out
