"""The library's functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from verbaline.functions import hashing, rules, tags, text


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """web_tokens(text) and resolve_upos(tag, dep) as SQL functions, which Catalyst inlines; rule_tokens(text), the four
    hashes of a string as Arrow functions; rule_tokenize(text) as a table function in SQL, a row for each token and none for null or empty text."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION web_tokens(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(t), {quoted(text.WEB_TOKEN)}, 0)")
    base = " ".join(f"WHEN {quoted(t)} THEN '{u}'" for t, u in [*tags.LABELS, ("GW", "X")])
    verbs = ", ".join(map(quoted, tags.VERBS))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION resolve_upos(tag STRING, dep STRING) RETURNS STRING RETURN
CASE WHEN tag IN ({verbs}) AND dep IN ('AUX', 'AUXPASS') THEN 'AUX' WHEN tag IN ('DT', 'WDT') AND dep NOT IN ('DET', 'QUANTMOD') THEN 'PRON' ELSE CASE tag {base} END END""")
    spark.udf.register("rule_tokens", rules.rule_tokens_udf())
    for name in hashing.HASHES:
        spark.udf.register(name, hashing.hash_udf(name))
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION rule_tokenize(t STRING) RETURNS TABLE (tok_idx BIGINT, start INT, end INT, spacy BOOLEAN, token STRING)
RETURN SELECT CAST(pos AS BIGINT), x.start, x.end, x.spacy, substring(t, x.start + 1, x.end - x.start) FROM posexplode(rule_tokens(t)) AS p (pos, x)""")
