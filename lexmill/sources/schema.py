"""The record schema of a corpus: a nullable superset, with the file and line a record came from."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_FIELDS = (
    "id", "split", "language", "type", "domain", "topic", "topic_zh", "text", "source", "source_url", "source_title", "group_id", "legacy_id", "origin_class",
    "origin_evidence", "round15_split", "question", "answer",
)
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in TEXT_FIELDS] + [T.StructField("chunk_index", T.IntegerType())])
CATALOG = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "url", "source", "domain", "topic")])
SPLITS = ("train", "valid", "test")
