"""Further queries: filters by column, joins, set operations, rollups, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling as S
from ..sources.readers import joined_text, ordered_union
from .registry import query, table


@query("SELECT DISTINCT lang, source FROM documents WHERE lang <> 'en' UNION SELECT DISTINCT lang, source FROM documents WHERE n_chars > 200")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where("lang <> 'en'").select("lang", "source").union(docs.where("n_chars > 200").select("lang", "source")).distinct()


@query("SELECT source FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where("lang = 'fr'").select("source").intersect(docs.where("lang = 'de'").select("source"))


@query("SELECT doc_id AS id, lang, NULL::VARCHAR AS role, 0 AS source_rank FROM documents UNION ALL SELECT conv_id, NULL, role, 1 FROM conversations")
def aligned_union(spark: SparkSession, d: str) -> DataFrame:
    return ordered_union([table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role")])


@query("SELECT doc_id, md5(concat_ws(chr(10), nullif(text, ''), nullif(lang, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''))) AS h FROM documents")
def multi_column_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")))
    return docs.select("doc_id", F.md5(joined_text(docs, ["text", "lang", "source"])).alias("h"))


@query("SELECT doc_id, kind, value FROM (SELECT doc_id, lang, source FROM documents) UNPIVOT (value FOR kind IN (lang, source))")
def stacked_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source").unpivot(["doc_id"], ["lang", "source"], "kind", "value")


@query(
    """SELECT item_id, split_part(tag, '/', 1) AS l1, split_part(tag, '/', 2) AS l2, split_part(tag, '/', 3) AS l3 FROM (SELECT item_id, 'morph/' || CASE item_id % 2 WHEN 0 THEN 'noun' ELSE 'verb' END || '/' || CASE item_id % 7 WHEN 0 THEN 'nom' ELSE 'case' || item_id % 7 END AS tag FROM benchmark)"""
)
def taxonomy_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    tag = F.concat(F.lit("morph/"), F.when(i % 2 == 0, "noun").otherwise("verb"), F.lit("/"), F.when(i % 7 == 0, "nom").otherwise(F.concat(F.lit("case"), i % 7)))
    levels = F.split(tag, "/")
    return table(spark, d, "benchmark").select("item_id", *(levels[k].alias(f"l{k + 1}") for k in range(3)))


@query("SELECT coalesce(l1, 'all') AS l1, coalesce(l2, 'all') AS l2, count(*) AS n FROM (SELECT source AS l1, lang AS l2 FROM documents) GROUP BY ROLLUP (l1, l2)")
def taxonomy_rollup(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").select(F.col("source").alias("l1"), F.col("lang").alias("l2")).rollup("l1", "l2").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("l1", F.lit("all")).alias("l1"), F.coalesce("l2", F.lit("all")).alias("l2"), "n")


@query("SELECT event_id, event_type, json_extract_string(r, '$.answer') AS answer, cast(json_extract(r, '$.n') AS BIGINT) AS n FROM (SELECT event_id, event_type, '{\"answer\": \"' || event_type || '\", \"n\": ' || event_id % 9 || '}' AS r FROM events)")
def json_in_text(spark: SparkSession, d: str) -> DataFrame:
    """The first JSON object inside a model's answer."""
    said = F.concat(F.lit('Sure: {"answer": "'), "event_type", F.lit('", "n": '), F.col("event_id") % 9, F.lit("} done"))
    parsed = F.from_json(F.regexp_extract(said, r"(?s)(\{.*\})", 1), "answer string, n bigint")
    return table(spark, d, "events").select("event_id", "event_type", parsed["answer"].alias("answer"), parsed["n"].alias("n"))


@query(
    r"""SELECT item_id, CASE WHEN len(list_distinct(v)) = 1 THEN v[1] END AS verdict FROM (SELECT item_id, regexp_extract_all('[[A]] ' || CASE item_id % 3 WHEN 0 THEN 'then [[B]]' WHEN 1 THEN 'again [[A]]' ELSE '' END, '\[\[(A|B|C)\]\]', 1) AS v FROM benchmark)"""
)
def judge_verdict(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id") % 3
    said = F.concat(F.lit("[[A]] "), F.when(i == 0, "then [[B]]").when(i == 1, "again [[A]]").otherwise(""))
    found = F.array_distinct(F.regexp_extract_all(said, F.lit(r"\[\[(A|B|C)\]\]"), F.lit(1)))
    return table(spark, d, "benchmark").select("item_id", F.when(F.size(found) == 1, found[0]).alias("verdict"))


@query(
    """WITH s AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS choice, (doc_id * 31 + unnest([0, 1, 2, 3]) * 17) % 23 AS score FROM documents), b AS (SELECT doc_id, choice, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, choice) AS k FROM s)
 SELECT doc_id, choice FROM b WHERE k = 1"""
)
def choice_argmax(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("choice")).withColumn("score", (F.col("doc_id") * 31 + F.col("choice") * 17) % 23)
    return scored.groupBy("doc_id").agg(F.max_by("choice", F.struct("score", -F.col("choice"))).alias("choice"))


@query("SELECT source, n, n_train, n - n_train AS n_rest FROM (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 10 < 9) AS n_train FROM documents GROUP BY source)")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 10 < 9).alias("n_train"))
    return counts.withColumn("n_rest", F.col("n") - F.col("n_train"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 + 1 >= 4 THEN 'positive' ELSE 'negative' END AS label FROM documents WHERE doc_id % 5 + 1 <> 3")
def binary_labels(spark: SparkSession, d: str) -> DataFrame:
    stars = F.col("doc_id") % 5 + 1
    return table(spark, d, "documents").where(stars != 3).select("doc_id", F.when(stars >= 4, "positive").otherwise("negative").alias("label"))


@query("SELECT event_id FROM (SELECT event_id, ntile(4) OVER (ORDER BY event_id) AS part FROM events) WHERE part = 2")
def worker_slice(spark: SparkSession, d: str) -> DataFrame:
    """The second of four equal slices of the ids. Bounds come from exact quantile ranks, not from a window over all rows."""
    from ..operators.packing import offsets

    events = table(spark, d, "events").select("event_id", F.lit(1).cast("long").alias("one"))
    placed = offsets(events, "event_id", "one", "k").crossJoin(F.broadcast(events.agg(F.count("*").alias("n"))))
    small, more = F.floor(F.col("n") / 4), F.col("n") % 4
    first = small + (more > 0).cast("long")
    return placed.where((F.col("k") >= first) & (F.col("k") < first + small + (more > 1).cast("long"))).select("event_id")


@query("SELECT l_orderkey, n, q FROM (SELECT l_orderkey, count(*) AS n, cast(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    return lines.join(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), lines["l_orderkey"] == F.col("o_orderkey"), "left_semi")


@query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY md5('42:' || cast(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_chars AS before FROM documents) WHERE before < 20000")
def token_ratio_trim(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", S.order_of(F.col("doc_id")).alias("o"))
    return S.running_until(docs, "lang", "o", "n_chars", 20000, ["doc_id"]).select("doc_id")


@query(
    """WITH r AS (SELECT doc_id, lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY md5('42:' || cast(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_chars AS before FROM documents),
 t AS (SELECT floor(cast(sum(n_chars) AS DOUBLE) * 0.50::DOUBLE) AS en, floor(cast(sum(n_chars) AS DOUBLE) * 0.45::DOUBLE) AS fr FROM documents)
 SELECT doc_id, lang, cast(CASE lang WHEN 'en' THEN least(n_chars, en - before) WHEN 'fr' THEN least(n_chars, fr - before) ELSE n_chars END AS BIGINT) AS kept FROM r, t WHERE CASE lang WHEN 'en' THEN before < en WHEN 'fr' THEN before < fr ELSE true END"""
)
def token_share_trim(spark: SparkSession, d: str) -> DataFrame:
    """Two languages cut to .50 and .45 of all tokens, for which characters stand in; the others are whole."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return S.trim_to_shares(docs, "lang", "doc_id", "n_chars", {"en": 0.50, "fr": 0.45}).select("doc_id", "lang", "kept")


@query("SELECT doc_id, identity FROM (SELECT doc_id, false AS identity FROM documents UNION ALL SELECT doc_id, true FROM documents WHERE cast('0x' || substr(md5('42:' || cast(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10)")
def identity_augment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("s"), F.col("text").alias("t"))
    return S.identity_rows(docs, "doc_id", "s", "t", 10).select("doc_id", "identity")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\x{FFFD}')) AS bad, len(regexp_extract_all(text, '\p{L}\?\p{L}')) AS broken, len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) AS special, regexp_matches(text, '[\x{00C0}-\x{024F}]') AS own FROM documents")
def char_features(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.count(t, r"\x{FFFD}").alias("bad"), T.count(t, r"\p{L}\?\p{L}").alias("broken"), T.count(t, r"[^\p{L}\p{N}\s]").alias("special"), t.rlike(r"[\x{00C0}-\x{024F}]").alias("own"))


@query("SELECT a.item_id, len(list_intersect(a.w, b.w)) AS common, len(list_distinct(a.w)) AS own FROM (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark) a JOIN (SELECT item_id + 1 AS item_id, string_split(lower(text), ' ') AS w FROM benchmark) b USING (item_id)")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    after = items.select((F.col("item_id") + 1).alias("item_id"), F.col("w").alias("v"))
    return items.join(after, "item_id").select("item_id", F.size(F.array_intersect("w", "v")).cast("long").alias("common"), F.size(F.array_distinct("w")).cast("long").alias("own"))


@query("SELECT model, task, v FROM (SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT user_id % 6 AS model, event_type AS task, event_id % 100 AS v, ts, event_id FROM events WHERE event_id % 4 <> 0)) WHERE k = 1 AND model NOT IN (5)")
def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """Of each model and task the newest value that isn't null, without forbidden models."""
    e = F.col("event_id")
    runs = table(spark, d, "events").select((F.col("user_id") % 6).alias("model"), F.col("event_type").alias("task"), F.when(e % 4 != 0, e % 100).alias("v"), "ts", "event_id")
    newest = runs.where("v IS NOT NULL").groupBy("model", "task").agg(F.max_by("v", F.struct("ts", "event_id")).alias("v"))
    return newest.join(F.broadcast(spark.range(5, 6).withColumnRenamed("id", "model")), "model", "left_anti")


@query("SELECT source, avg_len FROM (SELECT source, cast(sum(n_chars) AS DOUBLE) / count(*) AS avg_len, row_number() OVER (ORDER BY cast(sum(n_chars) AS DOUBLE) / count(*) DESC, source) AS k FROM documents GROUP BY source) WHERE k <= 5")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    mean = table(spark, d, "documents").groupBy("source").agg((F.sum("n_chars").cast("double") / F.count("*")).alias("avg_len"))
    return mean.orderBy(F.desc("avg_len"), "source").limit(5)


@query("SELECT vec_id, label, n FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 3")
def first_per_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long").alias("n")).where("n <= 3")
