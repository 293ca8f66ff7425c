"""Corpus linguistics on Spark: tokens, vocabularies, hashes, tags, features and a small tagger, for tables and streams."""
