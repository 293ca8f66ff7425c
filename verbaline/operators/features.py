"""Sentence-level features over annotated tokens, by window functions within a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaline.functions.tags import is_wh_word


def context(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """tokens (doc, tok_idx, tag, upos, dep) with next_dep, prev_upos, prev2_upos and at_start.

    At start: the first two tokens, or one or two places after punctuation.
    """
    w = Window.partitionBy(doc).orderBy("tok_idx")
    t = tokens.select("*", F.lead("dep").over(w).alias("next_dep"), F.lag("upos", 1).over(w).alias("prev_upos"), F.lag("upos", 2).over(w).alias("prev2_upos"))
    near = F.coalesce((F.col("prev_upos") == "PUNCT") | (F.col("prev2_upos") == "PUNCT"), F.col("prev_upos") == "PUNCT", F.col("prev2_upos") == "PUNCT", F.lit(False))
    return t.withColumn("at_start", (F.col("tok_idx") <= 1) | near)


def _wh() -> Column:
    return is_wh_word(F.col("tag")) & (F.col("upos") != "DET")


def _aux_next() -> Column:
    return F.coalesce(F.col("next_dep") == "AUX", F.lit(False))


def sentence_level_feats(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, feats): sentence starts that are neither a wh-word (unless a determiner) nor before an auxiliary, as first written; the last token has no next one."""
    return context(tokens, doc).groupBy(doc).agg(F.count_if(F.col("at_start") & ~_wh() & ~_aux_next()).alias("feats"))


def wh_question_count(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, wh_questions): wh-words (no determiners) at a sentence start before an auxiliary, as the feature was meant."""
    return context(tokens, doc).groupBy(doc).agg(F.count_if(F.col("at_start") & _wh() & _aux_next()).alias("wh_questions"))


def token_count(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    return tokens.groupBy(doc).agg(F.count("*").alias("n_tokens"))


def heads(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """tokens with the token and tag of their head (same document, head = tok_idx); null where there is none."""
    h = tokens.select(F.col(doc).alias("_d"), F.col("tok_idx").alias("_i"), F.col("token").alias("head_token"), F.col("tag").alias("head_tag"))
    return tokens.join(h, (tokens[doc] == F.col("_d")) & (tokens["head"] == F.col("_i")), "left").drop("_d", "_i")


def heads_within(docs: DataFrame, doc: str, head: Callable[[Column], Column], *columns: str) -> DataFrame:
    """doc, tok_idx and head_<column> of documents (doc, s: array of structs in order), head giving a token's head by its place: what
    heads() gives for token tables, without a join of tokens. Rows that share a doc, where any head of either counts, are brought
    together whole; a null doc has no heads."""
    held = docs.groupBy(doc).agg(F.collect_list("s").alias("_all"))
    found = lambda own: F.transform("_all", lambda other: F.filter(F.transform(own, lambda t, i: F.struct(i.cast("long").alias("tok_idx"), F.get(other, head(i).cast("int")).alias("h"))), lambda x: x["h"].isNotNull()))
    some = F.flatten(F.transform("_all", lambda own: F.flatten(found(own))))
    none = F.flatten(F.transform("_all", lambda own: F.transform(own, lambda t, i: F.struct(i.cast("long").alias("tok_idx"), F.get(F.slice(own, 1, 0), F.lit(0)).alias("h")))))
    t = held.select(doc, F.inline(F.when(F.col(doc).isNull(), none).otherwise(some)))
    return t.select(doc, "tok_idx", *(F.col(f"h.{c}").alias(f"head_{c}") for c in columns))
