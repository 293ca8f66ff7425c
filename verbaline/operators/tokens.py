"""Token tables: one row per token, from either tokenizer, with offsets and the packed document form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbaline.functions.rules import packed_rows, rule_tokens_udf, run_rows, token_rows
from verbaline.functions.text import web_tokens


def web_token_table(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, tok_idx (from 0), token: lower-cased word runs and single other characters. Null or empty text: no rows."""
    return df.select(*keys, F.posexplode(web_tokens(F.col(text))).alias("tok_idx", "token")).select(*keys, F.col("tok_idx").cast("long"), "token")


def _mapped(df: DataFrame, keys: tuple[str, ...], text: str, run: Callable, added: str) -> DataFrame:
    """keys and the added columns, from a narrow map over the texts."""
    fields = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(added)])
    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, fields)


def run_table(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, run_idx, start (code points), run, is_space: alternating runs that together are the text."""
    return _mapped(df, keys, text, run_rows, "run_idx long, start long, run string, is_space boolean")


def rule_docs(df: DataFrame, *keys: str, text: str = "text", currency: bool = False) -> DataFrame:
    """keys, text, tokens: array of (start, end, spacy) in code points."""
    return df.select(*keys, F.col(text).alias("text"), rule_tokens_udf(currency)(F.col(text)).alias("tokens"))


def rule_token_table(df: DataFrame, *keys: str, text: str = "text", currency: bool = False, by_bytes: bool = False) -> DataFrame:
    """keys, tok_idx, start, end, spacy, token; by_bytes: start_byte and end_byte besides, as byte_offsets() gives them, without its
    shuffle and for each row of df by itself. A task sends tokens on as it goes, so its memory does not grow with the table."""
    added = "tok_idx long, start int, end int, spacy boolean, token string" + ", start_byte long, end_byte long" * by_bytes
    return _mapped(df, keys, text, token_rows(currency, by_bytes), added)


def byte_offsets(tokens: DataFrame) -> DataFrame:
    """A token table with start_byte and end_byte: running sums of the bytes of tokens and of the single spaces between them."""
    keys = [c for c in tokens.columns if c not in ("tok_idx", "start", "end", "spacy", "token")]
    own = F.octet_length("token") + F.col("spacy").cast("int")
    before = Window.partitionBy(*keys).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(own).over(before), F.lit(0)).cast("long")
    return tokens.select("*", start.alias("start_byte"), (start + F.octet_length("token")).alias("end_byte"))


def packed(df: DataFrame, *keys: str, text: str = "text", currency: bool = False) -> DataFrame:
    """keys, buffer: one packed document per row of df (see packed_rows), so rows with equal keys stay apart. Null text: null;
    empty text: a buffer without tokens; empty table: no rows."""
    return _mapped(df, keys, text, packed_rows(currency), "buffer binary")
