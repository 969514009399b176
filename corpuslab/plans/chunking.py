"""Queries on chunks, masked spans, suffixes and classes of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as C
from .registry import query, table

_SUFFIXES = ["ations", "ation", "ings", "ing", "ness", "ly", "ed", "er", "es", "s"]


def _stripped(column: str) -> str:
    return f"coalesce(nullif(regexp_extract({column}, '{C.stem_pattern(_SUFFIXES)}', 1), ''), {column})"


@query()
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents, by paragraph, line, sentence or hard."""
    return C.chunked(table(spark, d, "documents").select("doc_id", "text"), most=400).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")


@query()
def text_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of documents that end after a line or a word."""
    return C.chunked(table(spark, d, "documents").select("doc_id", "text"), most=400, by="windows").select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")


@query()
def sentence_packs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents packed up to 100 words."""
    return C.chunked(table(spark, d, "documents").select("doc_id", "text"), most=100, by="sentences").select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text")


@query()
def span_corruption(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items' characters as ids, masked in spans."""
    items = table(spark, d, "benchmark").select("item_id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("ids"))
    return C.corrupted(items, "item_id", "ids", list(range(200_000, 200_100))).select("item_id", "inputs", "targets")


@query(f"SELECT word, {_stripped('s3')} AS stem FROM (SELECT word, {_stripped('s2')} AS s3 FROM (SELECT word, {_stripped('s1')} AS s2 FROM (SELECT word, {_stripped('word')} AS s1 FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents))))")
def suffix_stems(spark: SparkSession, d: str) -> DataFrame:
    """The stems of all words: up to four suffixes, the longest first, four letters stay."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("word")).distinct()
    return C.with_stem(words, "word", _SUFFIXES)


_ERROR = """WITH p AS (SELECT item_id, text AS s, replace(replace(text, 'a', 'e'), ' the ', ' ') AS t FROM benchmark), w AS (SELECT item_id, list_filter(string_split_regex(trim(s), '\\s+'), lambda x: x <> '') AS a,
 list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> '') AS b FROM p) SELECT item_id, CASE WHEN a = b THEN 'identity' WHEN list_sort(a) = list_sort(b) THEN 'word_order' WHEN len(a) <> len(b) THEN 'mixed'
 WHEN len(list_filter(range(1, len(a) + 1), lambda i: length(a[i]) <> length(b[i]) OR len(list_filter(range(1, length(a[i]) + 1), lambda j: a[i][j] <> b[i][j])) > 3)) = 0 THEN 'morphology' ELSE 'orthography' END AS class FROM w"""


@query(_ERROR)
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    """Items against themselves with changed letters and a lost word."""
    changed = F.replace(F.replace("text", F.lit("a"), F.lit("e")), F.lit(" the "), F.lit(" "))
    return table(spark, d, "benchmark").select("item_id", C.error_class(F.col("text"), changed).alias("class"))
