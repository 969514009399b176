"""Queries on results: requests, leaderboards, judgments, battles, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leaderboard as L
from .registry import query, table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


_RES = "r AS (SELECT user_id % 12 AS model, event_type AS task, cast(event_id % 97 AS DOUBLE) / 97 AS v, event_id FROM events)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, d).select((F.col("user_id") % 12).alias("model"), F.col("event_type").alias("task"), ((e % 97).cast("double") / 97).alias("v"), "event_id")


@query(
    """WITH r AS (SELECT DISTINCT user_id % 12 AS model, event_type AS "precision" FROM events), q AS (SELECT user_id % 10 AS model, event_type AS "precision", event_id, event_id % 3 AS status FROM events WHERE event_id % 2 = 0)
 SELECT model, "precision", arg_max(status, event_id) AS status, max(event_id) AS event_id FROM r LEFT JOIN q USING (model, "precision") GROUP BY model, "precision\""""
)
def results_with_requests(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    results = e.select((F.col("user_id") % 12).alias("model"), F.col("event_type").alias("precision")).distinct()
    requests = e.where("event_id % 2 = 0").select((F.col("user_id") % 10).alias("model"), F.col("event_type").alias("precision"), "event_id", (F.col("event_id") % 3).alias("status"))
    return L.with_requests(results, requests, ["model", "precision"], "event_id").select("model", "precision", "status", "event_id")


@query(f"WITH {_RES}, m AS (SELECT DISTINCT user_id % 9 AS model, 'card ' || cast(user_id % 9 AS VARCHAR) AS card FROM events) SELECT model, count(*) AS n, any_value(card) AS card, model IN (2, 3) AS flagged FROM r LEFT JOIN m USING (model) WHERE model <> 11 GROUP BY model")
def results_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Results with their models' metadata, without a forbidden model; flagged ones are marked."""
    cards = _events(spark, d).select((F.col("user_id") % 9).alias("model")).distinct().withColumn("card", F.concat(F.lit("card "), F.col("model").cast("string")))
    allowed = _results(spark, d).join(F.broadcast(spark.range(11, 12).toDF("model")), "model", "left_anti").groupBy("model").agg(F.count("*").alias("n"))
    flags = spark.range(2, 4).select(F.col("id").alias("model"), F.lit(True).alias("f"))
    return allowed.join(cards, "model", "left").join(F.broadcast(flags), "model", "left").select("model", "n", "card", F.coalesce("f", F.lit(False)).alias("flagged"))


@query(f"WITH {_RES}, t AS (SELECT task, model, round(avg(v), 9) AS v FROM r GROUP BY ALL) SELECT task, CASE WHEN task = 'click' THEN min(v) ELSE max(v) END AS best FROM t GROUP BY task")
def best_per_task(spark: SparkSession, d: str) -> DataFrame:
    """The least of a task where less is better, the greatest of others."""
    means = _results(spark, d).groupBy("task", "model").agg(F.round(F.avg("v"), 9).alias("v"))
    return means.groupBy("task").agg(F.when(F.col("task") == "click", F.min("v")).otherwise(F.max("v")).alias("best"))


_TASKS = ("click", "view", "purchase", "signup")


@query(
    f"WITH {_RES}, w AS (SELECT model, " + ", ".join(f"max(v) FILTER (task = '{t}' AND event_id % 5 <> 1) AS {t}" for t in _TASKS) + " FROM r WHERE event_id < 400 OR model < 9 GROUP BY model)"
    f" SELECT model, CASE WHEN {' AND '.join(f'{t} IS NULL' for t in _TASKS)} THEN NULL ELSE round(list_aggregate(list_filter([{', '.join(_TASKS)}], lambda x: x IS NOT NULL), 'avg'), 3) END AS mean FROM w"
)
def row_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the benchmarks that a model has."""
    rows = _results(spark, d).where("event_id < 400 OR model < 9")
    wide = rows.groupBy("model").agg(*(F.max(F.when((F.col("task") == t) & (F.col("event_id") % 5 != 1), F.col("v"))).alias(t) for t in _TASKS))
    return wide.select("model", L.row_mean(list(_TASKS)).alias("mean"))


@query(f"WITH {_RES} SELECT model, task, round(avg(CASE WHEN event_id % 7 = 0 THEN 0 ELSE v END), 9) AS mean FROM r GROUP BY ALL")
def task_means(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh value is NaN, which counts as 0."""
    rows = _results(spark, d).withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return L.task_means(rows, ["model", "task"], "v").withColumn("mean", F.round("mean", 9))


@query(
    """WITH j AS (SELECT user_id % 12 AS model, CASE WHEN event_id % 11 <> 0 THEN event_id % 40 - 5 END AS score FROM events)
 SELECT model, count(score) AS answered, count(*) FILTER (score IS NULL) AS errored, cast(sum(greatest(0, score)) FILTER (score IS NOT NULL) AS BIGINT) AS points, 100 * cast(sum(greatest(0, score)) FILTER (score IS NOT NULL) AS DOUBLE) / (count(score) * 30) AS percent FROM j GROUP BY model"""
)
def judge_ranking(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = _events(spark, d).select((F.col("user_id") % 12).alias("model"), F.when(e % 11 != 0, e % 40 - 5).alias("score"))
    return L.judge_ranking(rows.withColumn("score", F.col("score").cast("bigint")), "model", "score")


@query(
    "WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RERUN' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'FINISHED_2' ELSE 'PENDING_NEW_EVAL' END AS s FROM events)"
    " SELECT CASE WHEN s IN ('PENDING', 'RERUN') THEN 'pending' WHEN s = 'RUNNING' THEN 'running' ELSE 'finished' END AS queue, count(*) AS n FROM s GROUP BY 1"
)
def request_queue(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, "PENDING").when(k == 1, "RERUN").when(k == 2, "RUNNING").when(k == 3, "FINISHED_2").otherwise("PENDING_NEW_EVAL")
    return _events(spark, d).select(L.queue_class(status).alias("queue")).groupBy("queue").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_RES}, w AS (SELECT cast(model AS VARCHAR) AS model, max(v) FILTER (task = 'click') AS a, max(v) FILTER (task = 'view' AND model % 4 <> 1) AS b FROM r GROUP BY model UNION ALL SELECT 'baseline', 0.5, 0.25),
 x AS (SELECT model, round(a, 2) AS a, round(b, 2) AS b FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT model, a, b, row_number() OVER (ORDER BY a DESC, model, a, b) AS rank FROM x"""
)
def leaderboard_view(spark: SparkSession, d: str) -> DataFrame:
    view = lambda c, extra=True: F.max(F.when((F.col("task") == c) & extra, F.col("v")))
    rows = _results(spark, d).groupBy("model").agg(view("click").alias("a"), view("view", F.col("model") % 4 != 1).alias("b")).select(F.col("model").cast("string").alias("model"), "a", "b")
    base = spark.range(1).select(F.lit("baseline").alias("model"), F.lit(0.5).alias("a"), F.lit(0.25).alias("b"))
    return L.view(rows, base, ["a", "b"], "a").withColumn("rank", F.col("rank").cast("bigint"))


_GAMES = ["A>>B", "A>B", "A=B", "B>A", "B>>A", "?"]


def _battles(spark: SparkSession, d: str) -> DataFrame:
    verdicts, e = F.array(*map(F.lit, _GAMES)), F.col("event_id")
    games = F.array(F.get(verdicts, (e % 6).cast("int")), F.get(verdicts, ((e + F.col("user_id")) % 6).cast("int")))
    rows = _events(spark, d).select(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_a"), F.concat(F.lit("m"), (e % 5).cast("string")).alias("model_b"), games.alias("games")).where("model_a <> model_b")
    return L.battles(rows)


@query(
    """WITH v AS (SELECT ['A>>B', 'A>B', 'A=B', 'B>A', 'B>>A', '?'] AS v), e AS (SELECT 'm' || cast(user_id % 7 AS VARCHAR) AS model_a, 'm' || cast(event_id % 5 AS VARCHAR) AS model_b, v[event_id % 6 + 1] AS g1, v[(event_id + user_id) % 6 + 1] AS g2 FROM events, v),
 g AS (SELECT model_a, model_b, g1 AS g, 0 AS turned FROM e UNION ALL SELECT model_a, model_b, g2, 1 FROM e), w AS (SELECT model_a, model_b, CASE WHEN g LIKE '%>>%' THEN 3 ELSE 1 END AS k, CASE WHEN g = 'A=B' THEN 'tie' WHEN (g LIKE 'A>%') = (turned = 0) THEN 'model_a' ELSE 'model_b' END AS winner FROM g WHERE g <> '?' AND model_a <> model_b)
 SELECT model_a, model_b, winner, cast(sum(k) AS BIGINT) AS n FROM w GROUP BY ALL"""
)
def battle_counts(spark: SparkSession, d: str) -> DataFrame:
    return _battles(spark, d).groupBy("model_a", "model_b", "winner").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT user_id % 5 AS model, round(900 + 200 * avg(event_id % 100) / 100, 3) AS elo FROM events GROUP BY 1) SELECT x.model AS a, y.model AS b, round(1 / (1 + pow(10, (y.elo - x.elo) / 400)), 9) AS rate FROM m x JOIN m y ON x.model <> y.model")
def win_rate_matrix(spark: SparkSession, d: str) -> DataFrame:
    elo = _events(spark, d).groupBy((F.col("user_id") % 5).alias("model")).agg(F.round(900 + 200 * F.avg(F.col("event_id") % 100) / 100, 3).alias("elo"))
    return L.win_rates(elo).withColumn("rate", F.round("rate", 9))


@query()
def elo_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Elo of resampled battles."""
    rows = _battles(spark, d).groupBy("model_a", "model_b", "winner").agg(F.count("*").alias("n")).withColumn("key", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(1000)).cast("int"))))
    rows = rows.withColumn("key", F.concat_ws("|", "model_a", "model_b", "winner", "key"))
    return spark.createDataFrame(L.elo_bootstrap(rows, "key", 20), "model string, low double, mid double, high double")


@query(
    """WITH p AS (SELECT ln(n_chars) AS x, ln(strlen(text)) AS y FROM documents WHERE n_chars > 0), f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS i, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM p),
 g AS (SELECT *, sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx) AS e FROM f) SELECT n, round(exp(i), 6) AS a, round(b, 6) AS b, round(b - 1.96 * e, 6) AS low, round(b + 1.96 * e, 6) AS high FROM g"""
)
def power_law_fit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("n_chars", F.octet_length("text").alias("size"))
    return L.power_law(docs, "n_chars", "size").select("n", *(F.round(c, 6).alias(c) for c in ("a", "b", "low", "high")))
