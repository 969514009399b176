"""Queries on sets put together: budgets, quotas, directions, shuffles, inventories, reports, catalogs, plug-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import gates as G
from ..operators import packing as P
from ..operators import quality as Q
from ..operators import structure as E
from ..sources.work import saved, work_folder
from ..sources.writers import write_parts
from .registry import query, table

_ORDER = "md5('42:' || cast({0} AS VARCHAR))"


@query(
    """WITH s(lang, p) AS (VALUES ('en', 0.5::DOUBLE), ('fr', 0.3::DOUBLE), ('de', 0.2::DOUBLE)), t AS (SELECT lang, p, count(*) AS rows, cast(sum(n_chars) AS BIGINT) AS total FROM documents JOIN s USING (lang) GROUP BY ALL), b AS (SELECT min(total / p) AS budget FROM t)
 SELECT lang, rows, total, cast(greatest(1, floor(rows * least(1.0, budget * p / total))) AS BIGINT) AS take FROM t, b"""
)
def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    return A.token_budgets(table(spark, d, "documents"), "lang", "n_chars", {"en": 0.5, "fr": 0.3, "de": 0.2}).withColumn("take", F.col("take").cast("bigint"))


@query(
    """WITH r AS (SELECT doc_id, source, n_chars, CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS g, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents),
 p AS (SELECT *, CASE WHEN g < 2 AND n <= 4 THEN 1 ELSE 2 END AS phase FROM r), o AS (SELECT doc_id, source, phase, row_number() OVER (ORDER BY phase, CASE WHEN phase = 1 THEN g ELSE 0 END, n_chars DESC, doc_id) AS place FROM p) SELECT * FROM o WHERE place <= 30"""
)
def two_phase_quota(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    found = A.two_phase_quota(docs, "source", ["src3", "src1"], [F.desc("n_chars"), F.col("doc_id")], "doc_id", target=30, cap=4)
    return found.select("doc_id", "source", F.col("phase").cast("bigint").alias("phase"), F.col("place").cast("bigint").alias("place"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_ORDER.format('doc_id')} DESC, doc_id DESC) <= greatest(1, floor(0.01 * (SELECT count(*) FROM documents))) AS picked FROM documents")
def exact_validation_share(spark: SparkSession, d: str) -> DataFrame:
    return A.exact_share(table(spark, d, "documents").select("doc_id"), "doc_id", 0.01)


@query(f"SELECT doc_id, md5(CASE WHEN row_number() OVER (ORDER BY {_ORDER.format('doc_id')} DESC, doc_id DESC) <= greatest(1, floor(0.1 * (SELECT count(*) FROM documents))) THEN text ELSE lower(text) END) AS h FROM documents")
def exact_identity_share(spark: SparkSession, d: str) -> DataFrame:
    """Of a tenth of the rows, exactly, the input is the target."""
    docs = A.exact_share(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 0.1)
    return docs.select("doc_id", F.md5(F.when(F.col("picked"), F.col("text")).otherwise(F.lower("text"))).alias("h"))


_IDS = r"i AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)) AS ids FROM documents)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """A word's length stands in for its id."""
    return table(spark, d, "documents").select("doc_id", "lang", F.transform(T.words(F.col("text")), lambda w: F.length(w).cast("bigint")).alias("ids"))


@query(
    f"WITH {_IDS}, w AS (SELECT doc_id, ids AS a, list_transform(ids, lambda x: x + 100) AS b FROM i), u AS (SELECT doc_id, 0 AS way, list_concat([1], a, [3, 2], b, [0]) AS ids FROM w UNION ALL SELECT doc_id, 1, list_concat([2], b, [3, 1], a, [0]) FROM w)"
    " SELECT doc_id, way, md5(array_to_string(ids, ',')) AS h FROM u"
)
def directed_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = _ids(spark, d).select("doc_id", F.col("ids").alias("a"), F.transform("ids", lambda x: x + 100).alias("b"))
    return A.directed(pairs, "doc_id", "a", "b", (1, 2), 3, 0).select("doc_id", "way", F.md5(F.array_join("ids", ",")).alias("h"))


@query(
    f"""WITH {_IDS}, e AS (SELECT lang, doc_id, pos, id FROM (SELECT lang, doc_id, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS id FROM i)), n AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) - 1 AS pl FROM e),
 c AS (SELECT lang, pl // 10000 AS chunk, md5(array_to_string(list(id ORDER BY pl), ',')) AS h FROM n GROUP BY ALL) SELECT lang, chunk, h, {_ORDER.format("lang || '|' || chunk")} AS place FROM c"""
)
def interleaved_chunks(spark: SparkSession, d: str) -> DataFrame:
    return A.interleaved(_ids(spark, d), "lang", "doc_id", "ids", 10_000).select("lang", "chunk", F.md5(F.array_join("ids", ",")).alias("h"), "place")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_ORDER.format('doc_id')}, doc_id) - 1 AS place FROM documents")
def whole_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Each row's place in the shuffled order: within its part, and rows of the parts before."""
    order = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    rows = table(spark, d, "documents").select("doc_id", order.alias("o"), F.conv(F.substring(order, 1, 3), 16, 10).cast("bigint").alias("p"), F.lit(1).alias("one"))
    sums = rows.groupBy("p").agg(F.count("*").alias("n"))
    before = sums.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("p").orderBy("o", "doc_id")) - 1
    return rows.withColumn("within", within).join(F.broadcast(before), "p").select("doc_id", (F.col("before") + F.col("within")).cast("bigint").alias("place"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '\\S+'), ' ')) AS h FROM documents")
def decoded_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts as ids by a vocabulary, and back."""
    rows = table(spark, d, "documents").select("doc_id", T.words(F.lower("text")).alias("w"))
    vocabulary = saved(P.vocabulary(rows, F.col("w")).select("token", "id"))
    each = rows.select("doc_id", F.posexplode("w").alias("pos", "token")).join(vocabulary, "token")
    ids = each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    tokens = ids.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(vocabulary, "id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    text = rows.select("doc_id").join(tokens, "doc_id", "left").select("doc_id", F.array_join(F.coalesce(F.transform("t", lambda x: x["token"]), F.array().cast("array<string>")), " ").alias("x"))
    return text.select("doc_id", F.md5("x").alias("h"))


@query("SELECT lang, cast(sum(len(regexp_extract_all(text, '\\S+'))) AS DOUBLE) / 20 AS parameters FROM documents GROUP BY lang")
def best_parameters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(A.chinchilla(F.sum(T.word_count(F.col("text")))).alias("parameters"))


@query()
def trained_merges(spark: SparkSession, d: str) -> DataFrame:
    merges = A.train_merges(table(spark, d, "documents"), T.words(F.lower("text")), 40)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "place int, a string, b string")


_INV = """v AS (SELECT event_id, event_type, value, strftime(ts, '%Y%m%d') AS day, event_id % 2400 AS seconds, event_id % 13 = 0 AS live, props FROM events),
 a AS (SELECT *, date_diff('day', cast(strptime(day, '%Y%m%d') AS DATE), DATE '2025-01-01') AS age, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS allow, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS deny FROM v)"""


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day"), (e % 2400).alias("seconds"), (e % 13 == 0).alias("live"))
    return rows.withColumns({"age": A.days_since(F.col("day"), F.lit("2025-01-01").cast("date")), "allow": (F.col("event_type") == "purchase").cast("int"), "deny": (e % 17 == 0).cast("int")})


@query(f"WITH {_INV} SELECT event_id, cast(age AS BIGINT) AS age, round(greatest(0, 365 - age) + least(seconds, 1800) / 60 + 20 * allow - 50 * deny + CASE WHEN live THEN 5 ELSE 0 END, 9) AS score FROM a")
def inventory_scores(spark: SparkSession, d: str) -> DataFrame:
    score = A.rank_score(F.col("age"), F.col("seconds"), F.col("allow"), F.col("deny"), F.col("live"))
    return _inventory(spark, d).select("event_id", F.col("age").cast("bigint").alias("age"), F.round(score, 9).alias("score"))


@query(
    f"""WITH {_INV}, r AS (SELECT list_filter([CASE WHEN live THEN 'live' END, CASE WHEN seconds = 0 THEN 'no_duration' END, CASE WHEN seconds > 0 AND seconds < 60 THEN 'short' END, CASE WHEN seconds > 1800 THEN 'long' END, CASE WHEN age > 330 THEN 'old' END, CASE WHEN deny > 0 THEN 'deny_keyword' END,
 CASE WHEN allow = 0 THEN 'no_allow_keyword' END], lambda x: x IS NOT NULL) AS r FROM a) SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN ['ok'] ELSE r END) AS reason FROM r) GROUP BY reason"""
)
def inventory_all_reasons(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seconds")
    gates = [
        G.Gate("live", F.col("live")), G.Gate("no_duration", s == 0), G.Gate("short", (s > 0) & (s < 60)), G.Gate("long", s > 1800), G.Gate("old", F.col("age") > 330), G.Gate("deny_keyword", F.col("deny") > 0),
        G.Gate("no_allow_keyword", F.col("allow") == 0),
    ]
    reasons = _inventory(spark, d).select(G.all_reasons(gates).alias("r"))
    return reasons.select(F.explode(F.when(F.size("r") == 0, F.array(F.lit("ok"))).otherwise(F.col("r"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text || chr(10) || 'it''s ' || role ELSE text END) AS h FROM conversations WHERE NOT regexp_matches(text, '[''\"{}\\\\\\n]')")
def unwrapped_literals(spark: SparkSession, d: str) -> DataFrame:
    """Every other turn is wrapped as two literals, and unwrapped."""
    rows = table(spark, d, "conversations").where(~F.col("text").rlike("['\"{}\\\\\\n]"))
    wrapped = F.concat(F.lit("{'text': '"), "text", F.lit("'}, {\"text\": \"it's "), "role", F.lit('"}'))
    text = F.when(F.col("turn") % 2 == 0, wrapped).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.md5(A.literal_texts(text)).alias("h"))


@query("SELECT page_id, translate(regexp_extract(url, '^https?://([^/?#]+)', 1), ':/.', '___') AS folder FROM pages")
def folder_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", A.folder_name(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("folder"))


@query(
    """WITH c AS (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS domain, regexp_replace(url, '/+$', '') || '/' AS url, substr(html, 1, 200) AS description FROM pages WHERE regexp_matches(url, '^https?://'))
 SELECT domain, url, md5(description) AS h FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url, description) AS n FROM c) WHERE n = 1"""
)
def site_catalog(spark: SparkSession, d: str) -> DataFrame:
    return A.catalog(table(spark, d, "pages"), "url", "html").select("domain", "url", F.md5("description").alias("h"))


@query(
    """WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, page_id FROM pages), p AS (SELECT host, count(*) AS pages FROM h WHERE page_id % 2 = 0 GROUP BY host), x AS (SELECT DISTINCT host FROM h WHERE page_id % 3 = 0)
 SELECT count(*) AS sites, cast(sum(coalesce(pages, 0)) AS BIGINT) AS pages, count(x.host) AS done, 100 * count(x.host) / count(*) AS percent FROM (SELECT DISTINCT host FROM h) c LEFT JOIN p USING (host) LEFT JOIN x USING (host)"""
)
def catalog_progress(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's sites with their page counts and whether they are done, in sum."""
    h = table(spark, d, "pages").select(F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)).alias("host"), "page_id")
    pages = h.where("page_id % 2 = 0").groupBy("host").agg(F.count("*").alias("pages"))
    done = h.where("page_id % 3 = 0").select("host", F.lit(1).alias("done")).distinct()
    sites = h.select("host").distinct().join(pages, "host", "left").join(done, "host", "left")
    return sites.agg(F.count("*").alias("sites"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.count("done").alias("done"), (100 * F.count("done") / F.count("*")).alias("percent"))


@query("SELECT a.event_id, a.stem, b.event_id AS text_id FROM (SELECT event_id, regexp_extract('wav/' || user_id || '_' || event_id // 2 || '.wav', '([^/]+)\\.[^.]+$', 1) AS stem FROM events WHERE event_id % 2 = 0) a JOIN (SELECT event_id, user_id || '_' || event_id // 2 AS stem FROM events WHERE event_id % 2 = 1) b USING (stem)")
def matched_stems(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of files with the same stem."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("_", "user_id", F.expr("event_id div 2")).alias("name"))
    stem = lambda path: F.regexp_extract(path, r"([^/]+)\.[^.]+$", 1)
    sound = e.where("event_id % 2 = 0").select("event_id", stem(F.concat(F.lit("wav/"), "name", F.lit(".wav"))).alias("stem"))
    text = e.where("event_id % 2 = 1").select(F.col("event_id").alias("text_id"), stem(F.concat(F.lit("txt/"), "name", F.lit(".txt"))).alias("stem"))
    return sound.join(text, "stem")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN cast(length(html) AS VARCHAR) ELSE 'old' END AS lang FROM pages")
def backfilled_column(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("lang", F.lit("old"))
    return A.backfilled(pages, "lang", F.col("page_id") % 3 == 0, F.length("html").cast("string")).select("page_id", "lang")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 2 = 0 THEN length(html) END AS size, CASE WHEN page_id % 5 = 0 THEN 'kept' WHEN page_id % 2 = 0 THEN upper(substr(url, 1, 4)) END AS scheme FROM pages")
def agent_columns(spark: SparkSession, d: str) -> DataFrame:
    """A row plug-in that fails on some rows, is masked from others, and leaves what is there."""

    def process(row: dict) -> dict:
        if row["page_id"] % 5 == 0:
            raise ValueError(row["page_id"])
        return {"size": len(row["html"]), "scheme": row["url"][:4].upper()}

    agent = A.register(A.Agent("probe", {"size": "bigint", "scheme": "string"}, process, mask=F.col("page_id") % 2 == 0))
    pages = table(spark, d, "pages").withColumn("scheme", F.when(F.col("page_id") % 5 == 0, "kept"))
    return A.run_agent(pages, agent.name, ["page_id", "url", "html"]).select("page_id", "size", "scheme")


@query(
    """SELECT lang, count(*) AS rows, 100 * count(*) / (SELECT count(*) FROM documents) AS percent, avg(n_chars) AS mean, sum(strlen(text)) / sum(n_chars) AS ratio, list_sort(list(n_chars))[least(cast(floor(0.5 * count(*)) AS INT) + 1, count(*))] AS p50,
 list_sort(list(n_chars))[least(cast(floor(0.95 * count(*)) AS INT) + 1, count(*))] AS p95, list_sort(list(n_chars))[least(cast(floor(0.99 * count(*)) AS INT) + 1, count(*))] AS p99 FROM documents GROUP BY lang"""
)
def length_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Shares, means and order statistics, the last by counts of values."""
    docs = table(spark, d, "documents")
    total = docs.agg(F.count("*").alias("total"))
    means = docs.groupBy("lang").agg(F.count("*").alias("rows"), F.avg("n_chars").alias("mean"), (F.sum(F.octet_length("text")) / F.sum("n_chars")).alias("ratio"))
    ranks = Q.order_statistics(docs, "lang", "n_chars", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return means.crossJoin(F.broadcast(total)).join(ranks, "lang").select("lang", "rows", (100 * F.col("rows") / F.col("total")).alias("percent"), "mean", "ratio", "p50", "p95", "p99")


@query(
    r"""SELECT coalesce(cast(shard AS VARCHAR), 'total') AS shard, count(*) AS rows, cast(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, cast(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, cast(sum(n_chars) AS BIGINT) AS chars FROM (SELECT *, doc_id % 4 AS shard FROM documents) GROUP BY ROLLUP (shard)"""
)
def shard_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("shard", (F.col("doc_id") % 4).cast("string"))
    sums = docs.rollup("shard").agg(F.count("*").alias("rows"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.sum(T.word_count(F.col("text"))).alias("words"), F.sum("n_chars").alias("chars"))
    return sums.withColumn("shard", F.coalesce("shard", F.lit("total")))


@query("SELECT event_type AS kind, sum(event_id % 600) / 3600 AS hours, count(DISTINCT user_id) AS speakers, array_to_string(list_sort(list(DISTINCT event_id % 5)), ',') AS moods FROM events GROUP BY event_type")
def speech_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sums = e.groupBy(F.col("event_type").alias("kind")).agg((F.sum(F.col("event_id") % 600) / 3600).alias("hours"), F.count_distinct("user_id").alias("speakers"), F.array_sort(F.collect_set(F.col("event_id") % 5)).alias("moods"))
    return sums.withColumn("moods", F.array_join("moods", ","))


@query("SELECT event_type AS domain, " + ", ".join(f"round(avg(cast(event_id % 97 AS DOUBLE)) FILTER (user_id % 4 = {i}), 9) AS e{i}" for i in range(4)) + " FROM events GROUP BY event_type")
def expert_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("domain"), (F.col("user_id") % 4).alias("expert"), (F.col("event_id") % 97).cast("double").alias("v"))
    wide = e.groupBy("domain").pivot("expert", [0, 1, 2, 3]).agg(F.round(F.avg("v"), 9))
    return wide.toDF("domain", "e0", "e1", "e2", "e3")


@query(
    rf"""WITH s AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY {_ORDER.format("doc_id")}, doc_id) AS k FROM (SELECT source, doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents)), c AS (SELECT source, count(*) AS rows, cast(sum(n) AS BIGINT) AS exact, avg(n) FILTER (k <= 20) AS m FROM s GROUP BY source)
 SELECT source, exact, cast(floor(m * rows) AS BIGINT) AS estimate FROM c"""
)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The sum, and what the mean of a sample of each source makes of it."""
    docs = table(spark, d, "documents").select("source", "doc_id", T.word_count(F.col("text")).alias("n"))
    order = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    sample = docs.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_id"))).where("k <= 20").groupBy("source").agg(F.avg("n").alias("m"))
    sums = docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n").alias("exact"))
    return sums.join(sample, "source").select("source", "exact", F.floor(F.col("m") * F.col("rows")).cast("bigint").alias("estimate"))


_TIER = "CASE WHEN n_chars >= 2000 THEN 'long' WHEN n_chars >= 800 THEN 'middle' ELSE 'short' END"


@query(f"SELECT {_TIER} AS tier, cast(least(99, floor(least(n_chars, 5000) / 50)) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY ALL")
def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A hundred bins of clipped values by tier."""
    n = F.col("n_chars")
    tier: Column = F.when(n >= 2000, "long").when(n >= 800, "middle").otherwise("short")
    bins = F.least(F.lit(99), F.floor(F.least(n, F.lit(5000)) / 50)).cast("bigint")
    return table(spark, d, "documents").groupBy(tier.alias("tier"), bins.alias("bin")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT doc_id, source, n_chars, cast(doc_id * 7919 % 1009 AS DOUBLE) AS ppl FROM documents), c AS (SELECT list_sort(list(ppl))[least(cast(floor(0.9 * count(*)) AS INT) + 1, count(*))] AS p90 FROM s), k AS (SELECT s.* FROM s, c WHERE ppl <= p90 AND n_chars >= 50)
 SELECT source, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM k), 9) AS percent FROM k GROUP BY source"""
)
def export_shares(spark: SparkSession, d: str) -> DataFrame:
    """What is exported up to the ninetieth percentile, by source with shares; the score column is dropped."""
    s = table(spark, d, "documents").select("doc_id", "source", "n_chars", (F.col("doc_id") * 7919 % 1009).cast("double").alias("ppl"))
    cut = Q.order_statistics(s.withColumn("all", F.lit(1)), "all", "ppl", {"p90": 0.9}).select("p90")
    kept = s.crossJoin(F.broadcast(cut)).where("ppl <= p90 AND n_chars >= 50").drop("ppl", "p90")
    counts = kept.groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("source", "n", F.round(100 * F.col("n") / F.col("total"), 9).alias("percent"))


@query(
    "WITH s AS (SELECT doc_id, cast(doc_id * 7919 % 1009 AS DOUBLE) AS ppl FROM documents), c AS (SELECT list_sort(list(ppl))[least(cast(floor(0.9 * count(*)) AS INT) + 1, count(*))] AS p90 FROM s) SELECT doc_id, ppl FROM s, c WHERE abs(ppl - p90) <= 0.05 * p90"
)
def around_p90(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 7919 % 1009).cast("double").alias("ppl"))
    cut = Q.order_statistics(s.withColumn("all", F.lit(1)), "all", "ppl", {"p90": 0.9}).select("p90")
    return s.crossJoin(F.broadcast(cut)).where(F.abs(F.col("ppl") - F.col("p90")) <= 0.05 * F.col("p90")).select("doc_id", "ppl")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) ORDER BY md5('42:' || cast(doc_id AS VARCHAR)) LIMIT 2")
def sample_of_first(spark: SparkSession, d: str) -> DataFrame:
    """Two rows in hash order of the first hundred: the limits are the operator."""
    first = table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(100)
    return first.orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))).limit(2)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IS NOT NULL")
def sorted_for_padding(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.language import largest_first

    return largest_first(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"))


@query("SELECT count(DISTINCT doc_id) AS documents, count(*) AS pairs FROM (SELECT doc_id, unnest(range(0, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?\\x{2026}])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 10)))) AS i FROM documents)")
def two_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentence pairs from one pass, which is written."""
    rows = saved(E.sentences(table(spark, d, "documents"), "doc_id").select("doc_id", "sent_idx", "sentence", F.upper("sentence").alias("other")))
    documents = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.agg(F.count("*").alias("documents")).crossJoin(rows.agg(F.count("*").alias("pairs")))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def resumed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of documents, of which some were written before; a part without its mark is written again."""
    docs, path = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), work_folder(spark)
    every = docs.agg(F.max("doc_id")).first()[0] // 4 + 1
    write_parts(docs.where(F.col("doc_id") < 2 * every), path, "doc_id", every)
    write_parts(docs, path, "doc_id", every)
    return spark.read.parquet(path).select("doc_id", "h")
