"""CoNLL-U files as token tables, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbaline.streaming.tagger import shared_folder

#: The line end before a blank line; a line with an integer id and the five fields that are read.
BREAK, TOKEN = r"\r?\n[ \t]*(?=\r?\n)", r"\A[0-9]+\t[^\t]*\t[^\t]*\t[^\t]*\t"


def _read_fields(line: Column) -> list[Column]:
    f = F.split(line, "\t")
    xpos = F.get(f, 4)
    return [F.lower(F.get(f, 1)).alias("form"), F.when(xpos != "_", xpos).alias("xpos")]


def tokens_of(files: DataFrame) -> DataFrame:
    """From (path, text): path, sent_id, tok_idx, form (lower-cased), xpos (null for _). A narrow map, for streams as well.

    Blank lines part sentences, whose number is that of the blank lines before them; lines that begin with # and tokens
    whose id is no plain integer (a-b, a.b) are left out, and so are sentences without tokens. Lines may end in CRLF.
    """
    s = files.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), BREAK)).alias("sent_id", "s"))
    lines = F.filter(F.split("s", r"\r?\n"), lambda line: line.rlike(TOKEN))
    t = s.select("path", F.col("sent_id").cast("long"), F.posexplode(lines).alias("tok_idx", "l"))
    return t.select("path", "sent_id", F.col("tok_idx").cast("long"), *_read_fields(F.col("l")))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of lines (file, block, blank, token, ...) in the order of their splits, each line with whether it begins a split, the blank
    lines up to it there, and its sentence's tokens up to it there."""
    last, blanks, inside = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        file, block, blank, token = (b.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block", "blank", "token"))
        new = np.r_[(file[0], block[0]) != last, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]
        at, t = np.cumsum(blank), np.cumsum(token)
        n = at - np.maximum.accumulate(np.r_[-blanks, np.where(new, at - blank, -blanks)])[1:]
        here = t - np.maximum.accumulate(np.r_[-inside, np.where(blank, t, np.where(new, t - token, -inside))])[1:]
        yield b, new, n, here
        last, blanks, inside = (file[-1], block[-1]), int(n[-1]), int(here[-1])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens with their sentence and place, as counted within their split."""
    for b, _, n, here in _walked(batches):
        own = pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.array(here - 1, pa.int64()), b.column("form"), b.column("xpos")], ["file", "block", "sent", "idx", "form", "xpos"])
        yield own.filter(b.column("token"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: its blank lines, and its tokens after the last of them."""
    held = None
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(("path", "file", "block", "n", "tail"), held, strict=True))])
    for b, new, n, here in _walked(batches):
        begins = np.flatnonzero(new)
        for i, j in zip(np.r_[0, begins] if not new[0] else begins, np.r_[begins if not new[0] else begins[1:], b.num_rows] - 1, strict=True):
            if new[i] and held:
                yield row()
            held = [b.column("path")[int(i)].as_py(), b.column("file")[int(i)].as_py(), b.column("block")[int(i)].as_py(), int(n[j]), int(here[j])]
    if held:
        yield row()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Token table of one or many files, as tokens_of gives it. Spark cuts files at line ends, CRLF or LF, so a file of any
    size is read by many tasks (a compressed file by one). No line is shuffled: sentences and places are counted within splits, and
    a table with a row for each split, written to the shared folder, tells with what each of them begins."""
    m = F.col("_metadata")
    raw = spark.read.text(path, lineSep="\n").select(m["file_path"].alias("path"), F.xxhash64(m["file_path"]).alias("file"), m["file_block_start"].alias("block"), F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("l"))
    # TOKEN without a regular expression: plain digits in the first of five fields or more. Lines are dropped where they are counted, as a filter here would test them twice.
    split = raw.select("path", "file", "block", "l", F.split("l", "\t", 6).alias("f"))
    digits = F.translate(F.get("f", F.lit(0)), "0123456789", "")
    token = (F.size("f") >= 5) & (F.get("f", F.lit(0)) != "") & (digits == "")
    blank = F.trim(F.col("l"), F.lit(" \t")) == ""
    xpos = F.get("f", F.lit(4))
    lines = split.select("path", "file", "block", blank.alias("blank"), token.alias("token"), F.lower(F.get("f", F.lit(1))).alias("form"), F.when(xpos != "_", xpos).alias("xpos"))
    ends = lines.select("path", "file", "block", "blank", "token").mapInArrow(_ends, "path string, file long, block long, n long, tail long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = ends.select("*", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(a) for c, a in (("n", "start"), ("tail", "before"))))
    # Tokens that the first sentence has in earlier splits: all tails since the last split with a blank line.
    begun = F.col("before") - F.coalesce(F.max(F.when(F.col("n") > 0, F.col("before"))).over(earlier), F.lit(0))
    at = shared_folder(spark, "splits")
    sums.select("path", "file", "block", "start", begun.alias("begun")).write.parquet(at)
    t = lines.select("file", "block", "blank", "token", "form", "xpos").mapInArrow(_numbered, "file long, block long, sent long, idx long, form string, xpos string")
    t = t.join(spark.read.parquet(at), ["file", "block"])
    return t.select("path", (F.col("start") + F.col("sent")).alias("sent_id"), (F.col("idx") + F.when(F.col("sent") == 0, F.col("begun")).otherwise(0)).alias("tok_idx"), "form", "xpos")


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The token table of files as they arrive in a folder; each is read whole, by one task."""
    files = spark.readStream.text(folder, wholetext=True)
    return tokens_of(files.select(F.col("_metadata")["file_path"].alias("path"), F.col("value").alias("text")))


def sentences(tokens: DataFrame, *keys: str) -> DataFrame:
    """keys, sentence: array of (form, xpos)."""
    return tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "form", "xpos"))).alias("s")).select(*keys, F.transform("s", lambda t: F.struct(t["form"].alias("form"), t["xpos"].alias("xpos"))).alias("sentence"))


def _line(tok_idx: Column, form: Column, xpos: Column) -> Column:
    return F.concat_ws("\t", (tok_idx + 1).cast("string"), form, F.lit("_\t_"), F.coalesce(xpos, F.lit("_")), F.lit("_\t_\t_\t_\t_"))


def sentence_text(sentence: Column, form: str = "form", xpos: str = "xpos") -> Column:
    """The text of a sentence that one row holds as an array in order: a narrow map, for tables that are not one row a token."""
    return F.concat(F.array_join(F.transform(sentence, lambda t, i: _line(i, t[form], t[xpos])), "\n"), F.lit("\n\n"))


def to_text(tokens: DataFrame, *keys: str, form: str = "form", xpos: str = "xpos") -> DataFrame:
    """keys, text: each sentence in the ten fields, unknown ones as _. Of a token table; see sentence_text() for sentences in rows."""
    rows = tokens.select(*keys, F.struct("tok_idx", _line(F.col("tok_idx"), F.col(form), F.col(xpos)).alias("l")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(*keys, F.concat(F.array_join(F.transform("x", lambda x: x["l"]), "\n"), F.lit("\n\n")).alias("text"))
