"""Queries on scores, pages, evaluation and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import leaderboard as L
from ..operators import quality as Q
from ..operators import web as W
from .registry import query, table

_SCORE = "(doc_id * 7919 % 1009 + n_chars % 13) / 8.0::DOUBLE"
_PPL = f"s AS (SELECT doc_id, source, n_chars, CASE WHEN doc_id % 41 = 0 THEN 'inf'::DOUBLE ELSE {_SCORE} END AS ppl FROM documents)"
_FIN = "ppl < 'inf'::DOUBLE"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    score = F.when(i % 41 == 0, F.lit(float("inf"))).otherwise((i * 7919 % 1009 + F.col("n_chars") % 13) / F.lit(8.0))
    return table(spark, d, "documents").select("doc_id", "source", "n_chars", score.alias("ppl"))


@query(f"WITH {_PPL} SELECT count(*) AS n, count(*) FILTER (NOT {_FIN}) AS infinite, min(ppl) AS least, median(ppl) FILTER ({_FIN}) AS median, quantile_cont(ppl, 0.25) FILTER ({_FIN}) AS p25, quantile_cont(ppl, 0.75) FILTER ({_FIN}) AS p75, cast(sum(ppl * 8) FILTER ({_FIN}) AS BIGINT) AS eighths FROM s")
def ppl_summary(spark: SparkSession, d: str) -> DataFrame:
    s, ok = _scored(spark, d), Q.finite(F.col("ppl"))
    sums = s.agg(F.count("*").alias("n"), F.count_if(~ok).alias("infinite"), F.min(F.when(ok, F.col("ppl"))).alias("least"), F.sum(F.when(ok, (F.col("ppl") * 8).cast("long"))).alias("eighths"))
    ranks = Q.percentiles(s.where(ok).withColumn("all", F.lit(0)), "all", "ppl", {"median": 0.5, "p25": 0.25, "p75": 0.75}).drop("all")
    return sums.crossJoin(F.broadcast(ranks))


@query(f"WITH {_PPL} SELECT CASE WHEN NOT {_FIN} THEN 'none' WHEN ppl < 10 THEN '[0,10)' WHEN ppl < 50 THEN '[10,50)' WHEN ppl < 100 THEN '[50,100)' ELSE '[100,inf)' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def ppl_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy(Q.buckets(F.col("ppl"), [0, 10, 50, 100]).alias("bucket")).agg(F.count("*").alias("n"))


_TIERS = f"{_PPL}, e AS (SELECT quantile_cont(ppl, 0.25) AS a, quantile_cont(ppl, 0.5) AS b, quantile_cont(ppl, 0.75) AS c FROM s WHERE {_FIN}), t AS (SELECT s.*, CASE WHEN NOT {_FIN} THEN 'reject' WHEN ppl < a THEN 'gold' WHEN ppl < b THEN 'silver' WHEN ppl < c THEN 'bronze' ELSE 'reject' END AS tier FROM s, e)"


@query(f"WITH {_TIERS} SELECT tier, count(*) AS n, min(ppl) AS least, median(ppl) AS median, cast(sum(n_chars) AS BIGINT) AS chars FROM t GROUP BY tier")
def ppl_tiers(spark: SparkSession, d: str) -> DataFrame:
    t = Q.tiers(_scored(spark, d), "ppl", (0.25, 0.5, 0.75))
    sums = t.groupBy("tier").agg(F.count("*").alias("n"), F.min("ppl").alias("least"), F.sum("n_chars").alias("chars"))
    return sums.join(Q.percentiles(t, "tier", "ppl", {"median": 0.5}), "tier")


@query(f"WITH {_PPL} SELECT source, count(*) AS n, median(ppl) AS median FROM s WHERE {_FIN} GROUP BY source")
def ppl_by_source(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).where(Q.finite(F.col("ppl")))
    return s.groupBy("source").agg(F.count("*").alias("n")).join(Q.percentiles(s, "source", "ppl", {"median": 0.5}), "source")


@query(f"WITH {_PPL} SELECT doc_id, ppl FROM s WHERE ppl BETWEEN 10 AND 100 AND n_chars >= 50 ORDER BY ppl, doc_id LIMIT 20 OFFSET 20")
def explorer_page(spark: SparkSession, d: str) -> DataFrame:
    return Q.page(_scored(spark, d).where(F.col("ppl").between(10, 100) & (F.col("n_chars") >= 50)), [F.col("ppl"), F.col("doc_id")], 20, 1).select("doc_id", "ppl")


@query(f"WITH {_PPL}, f AS (SELECT * FROM s WHERE {_FIN}) SELECT * FROM (SELECT 'best' AS k, doc_id FROM f ORDER BY ppl, doc_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst' AS k, doc_id FROM f ORDER BY ppl DESC, doc_id LIMIT 5)")
def best_worst_k(spark: SparkSession, d: str) -> DataFrame:
    f = _scored(spark, d).where(Q.finite(F.col("ppl")))
    return f.orderBy("ppl", "doc_id").limit(5).select(F.lit("best").alias("k"), "doc_id").union(f.orderBy(F.desc("ppl"), "doc_id").limit(5).select(F.lit("worst"), "doc_id"))


@query(f"WITH {_PPL} SELECT source, count(*) AS n FROM s WHERE {_FIN} AND n_chars >= 50 AND ppl <= (SELECT quantile_cont(ppl, 0.5) FROM s WHERE {_FIN}) GROUP BY source")
def quality_export(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).where(Q.finite(F.col("ppl")))
    cut = Q.percentiles(s.withColumn("all", F.lit(0)), "all", "ppl", {"cut": 0.5}).select("cut")
    return s.crossJoin(F.broadcast(cut)).where("n_chars >= 50 AND ppl <= cut").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {_PPL} SELECT cast(floor(least(ppl, 120) / 5) AS BIGINT) AS bin, count(*) AS n FROM s WHERE {_FIN} GROUP BY 1")
def ppl_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(Q.finite(F.col("ppl"))).groupBy(F.floor(F.least("ppl", F.lit(120.0)) / 5).alias("bin")).agg(F.count("*").alias("n"))


_HOST = r"lower(regexp_extract({0}, '^https?://([^/?#:]+)', 1))"


@query(r"SELECT page_id, CASE WHEN t <> '' THEN t END AS title FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS t FROM pages)")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.title(F.col("html")).alias("title"))


@query()
def page_text_len(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where(F.length("html") >= 100)
    return pages.select("page_id", F.length(W.page_text(F.col("html"))).alias("text_len"), F.length(W.markdown(F.col("html"))).alias("markdown_len"))


@query(
    rf"""WITH l AS (SELECT page_id, url, x.t AS target, x.i AS pos FROM (SELECT page_id, url, unnest(list_transform(range(1, len(l) + 1), lambda i: {{'t': l[i], 'i': i - 1}})) AS x FROM (SELECT page_id, url, regexp_extract_all(concat(html, '<a href="https://t.me/x"><a href="https://site', page_id % 7, '.example.edu/p">'), '(?i)href=["''](https?://[^"'']+)["'']', 1) AS l FROM pages))),
 o AS (SELECT *, {_HOST.format("target")} AS host FROM l), e AS (SELECT * FROM o WHERE host <> {_HOST.format("url")} AND length(host) >= 4 AND host <> 't.me'), f AS (SELECT page_id, arg_min(target, pos) AS target, arg_min(host, pos) AS host FROM e GROUP BY page_id)
 SELECT host, min(page_id) AS page_id, arg_min(target, page_id) AS target FROM f GROUP BY host"""
)
def first_external_link(spark: SparkSession, d: str) -> DataFrame:
    """Pages have no outer links, so each is given two, of which one is to a skipped host."""
    more = F.concat("html", F.lit('<a href="https://t.me/x"><a href="https://site'), F.col("page_id") % 7, F.lit('.example.edu/p">'))
    return W.first_external(table(spark, d, "pages").withColumn("html", more), "page_id", "url", "html")


@query(
    r"""WITH p AS (SELECT page_id, replace(regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1), '/', '_') AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages), n AS (SELECT page_id, CASE WHEN p = '' THEN 'index' ELSE p END AS p, q FROM p)
 SELECT page_id, CASE WHEN q = '' THEN p ELSE p || '_' || substr(md5(q), 1, 8) END AS name FROM n"""
)
def url_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", W.file_name(F.col("url")).alias("name"))


@query(
    rf"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, regexp_matches(url, '^https?://') AND regexp_replace({_HOST.format("url")}, '^www\.', '') = {_HOST.format("url")}
 AND len(regexp_extract_all(path, '/[^/]+')) <= 1 AND NOT regexp_matches(path, '(?i)\.(?:pdf|jpe?g|png|gif|zip|mp[34]|docx?|xlsx?)$') AND NOT regexp_matches(path, '/(?:login|logout|cart|admin)(?:/|$)') AS ok FROM p"""
)
def crawl_rule(spark: SparkSession, d: str) -> DataFrame:
    host = F.when(W.host(F.col("url")).startswith("www."), F.lit("elsewhere")).otherwise(W.host(F.col("url")))
    return table(spark, d, "pages").select("page_id", W.crawlable(F.col("url"), host, 1).alias("ok"))


@query(f"WITH h AS (SELECT {_HOST.format('url')} AS host, page_id FROM pages) SELECT host, count(*) AS pages, count(*) FILTER (page_id % 3 = 0) AS done FROM h GROUP BY host")
def crawl_progress(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(W.host(F.col("url")).alias("host"), "page_id")
    return pages.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("page_id") % 3 == 0).alias("done"))


@query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE url LIKE '%.com%')")
def pending_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.join(pages.where("url LIKE '%.com%'").select("page_id"), "page_id", "left_anti")


@query("SELECT coalesce(lang, 'all') AS grp, count(*) AS total, count(*) FILTER (quality = 1) AS correct FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def grouped_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return L.accuracy(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "lang", F.col("quality") == 1)


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1)))
    return wide.select("source", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("en", "fr", "de", "es")))


@query("WITH m AS (SELECT source, lang, max(n_chars) AS best FROM documents GROUP BY ALL) SELECT source, lang, best FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY best DESC) AS r FROM m) WHERE r = 1")
def best_per_column(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "documents").groupBy("source", "lang").agg(F.max("n_chars").alias("best"))
    return best.withColumn("r", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("best")))).where("r = 1").drop("r")


@query("SELECT source, n, rank() OVER (ORDER BY n DESC) AS rank FROM (SELECT source, cast(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY source)")
def leaderboard_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))


_BATTLES = "b AS (SELECT event_id, 'm' || (user_id % 5) AS model_a, 'm' || ((user_id + 1 + event_id % 4) % 5) AS model_b, CASE WHEN event_id % 7 = 0 THEN 'tie' WHEN (event_id * 31 + user_id) % 3 = 0 THEN 'model_b' ELSE 'model_a' END AS winner FROM events)"


def _battles(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    winner = F.when(e % 7 == 0, "tie").when((e * 31 + u) % 3 == 0, "model_b").otherwise("model_a")
    return table(spark, d, "events").select("event_id", F.concat(F.lit("m"), u % 5).alias("model_a"), F.concat(F.lit("m"), (u + 1 + e % 4) % 5).alias("model_b"), winner.alias("winner"))


@query(f"WITH {_BATTLES}, p AS (SELECT model_a AS a, model_b AS b, CASE winner WHEN 'model_a' THEN 2 WHEN 'model_b' THEN 0 ELSE 1 END AS points FROM b UNION ALL SELECT model_b, model_a, CASE winner WHEN 'model_a' THEN 0 WHEN 'model_b' THEN 2 ELSE 1 END FROM b) SELECT a, b, cast(sum(points) AS BIGINT) AS points, count(*) AS games FROM p GROUP BY ALL")
def elo_win_matrix(spark: SparkSession, d: str) -> DataFrame:
    return L.win_counts(_battles(spark, d))


@query()
def bt_elo(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(L.bradley_terry(L.win_counts(_battles(spark, d))), "model string, elo double")


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    hits = _battles(spark, d).select("event_id", "model_a", (F.col("winner") == "model_a").cast("int").alias("hit"))
    return L.bootstrap(hits, "model_a", "hit", "event_id", 100)


_SEG = "g AS (SELECT user_id % 20 AS v, floor(epoch(ts)) AS a, floor(epoch(ts)) + event_id % 600 AS b FROM events)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    a = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("v"), a.alias("a"), (a + F.col("event_id") % 600).alias("b"))


@query(
    f"""WITH {_SEG}, u AS (SELECT *, max(b) OVER (PARTITION BY v ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto, row_number() OVER (PARTITION BY v ORDER BY a, b) AS i FROM g),
 n AS (SELECT *, sum(CASE WHEN upto IS NULL OR a - upto > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY i) AS island FROM u) SELECT v, min(a) AS a, max(b) AS b, count(*) AS n FROM n GROUP BY v, island"""
)
def merge_segments_gap(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_gaps(_segments(spark, d), "v", "a", "b", 300.0).select("v", "a", "b", "n")


_JOINS = "s.a - r.b <= 300 AND s.b - r.a <= 1800"


@query(
    f"""WITH RECURSIVE {_SEG}, s AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY a, b) AS i FROM g), r AS (SELECT v, i, a, b, 0 AS k FROM s WHERE i = 1
 UNION ALL SELECT s.v, s.i, CASE WHEN {_JOINS} THEN r.a ELSE s.a END, CASE WHEN {_JOINS} THEN greatest(r.b, s.b) ELSE s.b END, CASE WHEN {_JOINS} THEN r.k ELSE r.k + 1 END FROM r JOIN s ON s.v = r.v AND s.i = r.i + 1)
 SELECT v, min(a) AS a, max(b) AS b FROM r GROUP BY v, k"""
)
def merge_segments_capped(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_capped(_segments(spark, d), "v", "a", "b", 300.0, 1800.0)


_BIO = r"""t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), x AS (SELECT doc_id, i, w[i] AS tok, CASE WHEN length(w[i]) % 5 = 0 THEN 'B-P' WHEN length(w[i]) % 5 = 1 THEN 'I-P' ELSE 'O' END AS tag FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
 l AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM x), s AS (SELECT *, sum(CASE WHEN tag = 'B-P' OR (tag = 'I-P' AND (p IS NULL OR p = 'O')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)"""


@query(f"WITH {_BIO}, e AS (SELECT doc_id, k, min(i) AS f, max(i) AS g FROM s WHERE tag <> 'O' GROUP BY ALL) SELECT doc_id, count(*) AS entities, cast(sum(g - f + 1) AS BIGINT) AS tokens FROM e GROUP BY doc_id")
def bio_spans(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"))).alias("i", "tok"))
    m = F.length("tok") % 5
    tagged = words.withColumn("tag", F.when(m == 0, "B-P").when(m == 1, "I-P").otherwise("O"))
    return L.spans(tagged, "doc_id", "i", "tag", "tok").groupBy("doc_id").agg(F.count("*").alias("entities"), F.sum(F.col("last") - F.col("first") + 1).alias("tokens"))


@query(
    """SELECT q, vec_id, rank FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 4"""
)
def topk_inner_product(spark: SparkSession, d: str) -> DataFrame:
    """The four facts of greatest inner product for each stated query; queries are the small side."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("e").alias("x"))
    return L.top_products(asked, v, 4)


@query("SELECT doc_id, len(list_filter(embedding, lambda x: abs(x) > 0.25)) AS clipped, len(embedding) AS n FROM (SELECT vec_id AS doc_id, embedding FROM embeddings)")
def signal_clipping(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size(F.filter("embedding", lambda x: F.abs(x) > F.lit(0.25).cast("float"))).cast("long").alias("clipped"), F.size("embedding").cast("long").alias("n"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return newest.select("user_id", "event_type", "m.event_id")


@query(
    """WITH r AS (SELECT event_id, list_filter([CASE WHEN event_type = 'click' THEN 'denied' END, CASE WHEN value < 10 THEN 'short' END, CASE WHEN value > 90 THEN 'long' END], lambda x: x IS NOT NULL) AS reasons FROM events)
 SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason"""
)
def inventory_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons of each row, not only the first, counted."""
    reasons = F.array_compact(F.array(F.when(F.col("event_type") == "click", "denied"), F.when(F.col("value") < 10, "short"), F.when(F.col("value") > 90, "long")))
    return table(spark, d, "events").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
