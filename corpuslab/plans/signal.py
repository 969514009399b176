"""Queries on signals, transcripts, model ids, sentence records and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as R
from ..operators import signal as S
from .correction import _PAIRS, _pairs
from .registry import edit_distance, query, table

_ENERGY = "e AS (SELECT vec_id, list_transform(range(0, len(embedding) // 8), lambda i: list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda v: v::DOUBLE * v::DOUBLE)) / 8) AS e FROM embeddings), c AS (SELECT vec_id, e, list_aggregate(e, 'median') AS c FROM e)"


@query(
    f"WITH {_ENERGY} SELECT vec_id, round(10 * log10(coalesce(list_aggregate(list_filter(e, lambda x: x > c), 'avg'), 1e-10) / greatest(coalesce(list_aggregate(list_filter(e, lambda x: x <= c), 'avg'), 1e-10), 1e-10)), 6) AS db,"
    " len(list_filter(embedding, lambda x: abs(x) >= 0.25)) / len(embedding) AS clipped FROM c JOIN embeddings USING (vec_id)"
)
def signal_quality(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as signals, in frames of eight samples."""
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(S.snr(F.col("embedding"), 8, 1.0), 6).alias("db"), S.clip_fraction(F.col("embedding"), F.lit(0.25).cast("float")).alias("clipped"))


@query(
    r"""SELECT doc_id, lang IN ('de', 'fr') AND (doc_id % 10) / 10.0::DOUBLE >= 0.5 AND length(text) >= 200 AND len(regexp_extract_all(lower(text), '[\x{00C0}-\x{024F}]')) / greatest(len(regexp_extract_all(text, '\p{L}')), 1) >= 0.02 AS accepted FROM documents"""
)
def transcript_gate(spark: SparkSession, d: str) -> DataFrame:
    gate = S.transcript_gate(F.col("lang"), (F.col("doc_id") % 10) / F.lit(10.0), F.col("text"), ("de", "fr"), r"\x{00C0}-\x{024F}", chars=200)
    return table(spark, d, "documents").select("doc_id", gate.alias("accepted"))


@query(
    "WITH m AS (SELECT event_id, event_type || ':' || CASE event_id % 4 WHEN 0 THEN 'v1:8k' WHEN 1 THEN 'v1:mm' WHEN 2 THEN 'Embed' ELSE '0' END AS id FROM events) SELECT event_id, CASE WHEN contains(lower(id), 'embed') OR contains(lower(id), 'view') THEN 'skipped' WHEN regexp_matches(id, ':.*:([0-9]+k|mm)$') THEN 'variant' ELSE 'model' END AS kind FROM m"
)
def model_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    name = F.concat_ws(":", "event_type", F.when(k == 0, "v1:8k").when(k == 1, "v1:mm").when(k == 2, "Embed").otherwise("0"))
    return table(spark, d, "events").select("event_id", S.model_kind(name, ("embed", "VIEW")).alias("kind"))


@query(
    r"""WITH p AS (SELECT doc_id, i - 1 AS para_idx, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS para FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
 s AS (SELECT doc_id, para_idx, i, regexp_replace(s[i], '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, para_idx, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, para_idx, string_split(regexp_replace(para, '([.!?])\s+([\p{Lu}\p{Nd}"])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM p))),
 r AS (SELECT doc_id, CASE WHEN s = '' THEN 'empty_paragraph' WHEN length(s) > 512 OR len(regexp_extract_all(s, '\S+')) < 3 OR (length(replace(s, ' ', '')) - len(regexp_extract_all(replace(s, ' ', ''), '\p{L}'))) / greatest(length(replace(s, ' ', '')), 1) > 0.3 THEN 'noisy' ELSE '' END AS reason FROM s)
 SELECT doc_id, count(*) AS sentences, count(*) FILTER (reason = 'empty_paragraph') AS breaks, count(*) FILTER (reason = 'noisy') AS noisy FROM r GROUP BY doc_id"""
)
def sentence_record_counts(spark: SparkSession, d: str) -> DataFrame:
    r = S.sentence_records(table(spark, d, "documents"), "doc_id")
    return r.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if("is_paragraph_break").alias("breaks"), F.count_if(F.col("skip_reason") == "noisy").alias("noisy"))


@query(
    r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '\S+') AS t FROM benchmark), g AS (SELECT item_id, t, list_transform(t, lambda w: CASE length(w) % 5 WHEN 0 THEN 'B-P' WHEN 1 THEN 'I-Q' ELSE 'O' END) AS g FROM t), i AS (SELECT item_id, t, g, unnest(list_filter(range(1, len(g) + 1), lambda i: g[i] = 'B-P')) AS i FROM g),
 n AS (SELECT *, coalesce(list_filter(range(i + 1, len(g) + 1), lambda j: g[j] <> 'I-Q')[1], len(g) + 1) AS e FROM i) SELECT item_id, i - 1 AS at, array_to_string(t[i:e - 1], ' ') AS entity, array_to_string(t[greatest(i - 20, 1):i - 1], ' ') AS before, array_to_string(t[e:e + 9], ' ') AS after FROM n"""
)
def entity_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Words by their length stand in for tagged ones."""
    t = table(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("t"))
    m = lambda w: F.length(w) % 5
    tagged = t.withColumn("g", F.transform("t", lambda w: F.when(m(w) == 0, "B-P").when(m(w) == 1, "I-Q").otherwise("O")))
    starts = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.get(F.col("g"), i) == "B-P")
    found = tagged.select("item_id", F.explode(F.arrays_zip(starts.alias("at"), S.entities(F.col("t"), F.col("g")).alias("e"))).alias("x"))
    return found.select("item_id", F.col("x.at").cast("bigint").alias("at"), *(F.col(f"x.e.{c}").alias(c) for c in ("entity", "before", "after")))


@query(f"WITH {_PAIRS} SELECT doc_id % 4 AS shard, cast(sum({edit_distance('t', 's')}) AS BIGINT) AS edits, cast(sum(length(s)) AS BIGINT) AS length, sum({edit_distance('t', 's')}) / greatest(sum(length(s)), 1) AS rate FROM p GROUP BY 1")
def corpus_error_rate(spark: SparkSession, d: str) -> DataFrame:
    distance, length = R.cer_parts(F.col("t"), F.col("s"))
    return S.corpus_error_rates(_pairs(spark, d).withColumn("shard", F.col("doc_id") % 4), ["shard"], distance, length)


@query(
    r"SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l[i], '^\s*(?:[-*\x{2022}]|\d+[.)])\s*', ''), '^\s*[\p{L} ]{1,20}:\s*', ''), '\*\*([^*]*)\*\*', '\1', 'g'), '\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
)
def cleaned_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("i"), T.clean_line(F.col("l")).alias("line"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g'), '[\x00-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def speech_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.collapse(F.col("text"))).alias("h"))
