"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_A = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


RAW_PAGES = _struct(("url", _S), ("html", _S))
PAGES = _struct(
    ("page_id", _L), ("url", _S), ("title", _S), ("abstract", _S), ("content", _S), ("organization", _S), ("trust_tier", _I), ("posted_at", T.TimestampNTZType()),
    ("last_crawled_at", T.TimestampNTZType()), ("deadline_at", T.TimestampNTZType()), ("fields_of_study", _A), ("degree_levels", _A), ("location", _S), ("remote", _B),
)
ELEMENTS = _struct(("page_id", _L), ("elem_idx", _I), ("tag", _S), ("text", _S))
WORDS = _struct(("page_id", _L), ("elem_idx", _I), ("word", _S), ("score", _I), ("position", _I))
POSTINGS = _struct(("word", _S), ("page_id", _L), ("score", _I), ("position", _I))
DICTIONARY = _struct(("word", _S), ("frequency", _L))
LINKS = _struct(("src_id", _L), ("dst_id", _L))
PAGE_IDS = _struct(("url", _S), ("page_id", _L))
ALLOWLIST = _struct(("domain", _S), ("tier", _I))
SEARCHES = _struct(("query_id", _L), ("q", _S), ("page", _I), ("size", _I), ("major", _S))
