"""Evaluation analytics: accuracy by group, pivots, ranks, Elo, bootstrap, segments and spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """total and correct for each group and, as group ``all``, overall."""
    found = df.rollup(by).agg(F.count("*").alias("total"), F.count_if(hit).alias("correct"), F.grouping(by).alias("_all"))
    return found.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(by).cast("string")).alias("grp"), "total", "correct")


def win_counts(battles: DataFrame) -> DataFrame:
    """a, b and half points of a against b (a win counts 2, a tie 1), from battles (model_a, model_b, winner)."""
    a, b = F.col("model_a"), F.col("model_b")
    points = F.when(F.col("winner") == "model_a", 2).when(F.col("winner") == "model_b", 0).otherwise(1)
    both = battles.select(a.alias("a"), b.alias("b"), points.alias("points")).union(battles.select(b.alias("a"), a.alias("b"), (2 - points).alias("points")))
    return both.groupBy("a", "b").agg(F.sum("points").alias("points"), F.count("*").alias("games"))


def bradley_terry(wins: DataFrame, anchor: str | None = None, scale: float = 400.0, base: float = 1000.0, rounds: int = 500) -> list[tuple[str, float]]:
    """Elo-scaled strengths by Newton's method on the logistic likelihood. What comes to the driver is one row for each pair of models."""
    return strengths(wins.collect(), anchor, scale, base, rounds)


def strengths(rows: list, anchor: str | None = None, scale: float = 400.0, base: float = 1000.0, rounds: int = 500) -> list[tuple[str, float]]:
    """The same of the rows (a, b, points, games) themselves."""
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    won, played = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for r in rows:
        won[at[r["a"]], at[r["b"]]] += r["points"] / 2
        played[at[r["a"]], at[r["b"]]] += r["games"]
    theta = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(theta[None, :] - theta[:, None]))
        slope = (won - played * p).sum(1)
        w = played * p * (1 - p)
        step = np.linalg.lstsq(np.diag(w.sum(1)) - w, slope, rcond=None)[0]
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    elo = theta * scale / np.log(10)
    elo += base - (elo[at[anchor]] if anchor else elo.mean())
    return list(zip(names, elo.tolist(), strict=True))


def poisson(hashed: Column) -> Column:
    """A Poisson(1) number from a 64-bit hash."""
    u = (hashed.bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    weight, total, term = F.lit(0), 0.0, float(np.exp(-1))
    for k in range(1, 9):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k
    return weight


def bootstrap(df: DataFrame, by: str, value: str, key: str, rounds: int = 200) -> DataFrame:
    """Quantiles .025, .5 and .975 of resampled means by group. Each row counts a Poisson(1) number of times in each round, from a hash of its key, so rounds are one pass."""
    each = df.select(by, value, key).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    means = each.withColumn("w", poisson(F.xxhash64(key, "round"))).groupBy(by, "round").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    return means.groupBy(by).agg(*(F.percentile("mean", q).alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))))


def elo_bootstrap(battles: DataFrame, key: str, rounds: int = 100, anchor: str | None = None) -> list[tuple[str, float, float, float]]:
    """model and the quantiles .025, .5 and .975 of its Elo over resamples of the battles; a row for each round and pair of models comes to the driver."""
    drawn = battles.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", poisson(F.xxhash64(key, "round"))).where("w > 0")
    a, b = F.col("model_a"), F.col("model_b")
    points = F.when(F.col("winner") == "model_a", 2).when(F.col("winner") == "model_b", 0).otherwise(1)
    both = drawn.select("round", a.alias("a"), b.alias("b"), (points * F.col("w")).alias("points"), "w").union(drawn.select("round", b.alias("a"), a.alias("b"), ((2 - points) * F.col("w")).alias("points"), "w"))
    rows = both.groupBy("round", "a", "b").agg(F.sum("points").alias("points"), F.sum("w").alias("games")).collect()
    found: dict[str, list[float]] = {}
    for n in sorted({r["round"] for r in rows}):
        for model, elo in strengths([r for r in rows if r["round"] == n], anchor):
            found.setdefault(model, []).append(elo)
    return [(m, *np.quantile(x, [0.025, 0.5, 0.975]).tolist()) for m, x in sorted(found.items())]


def win_rates(elo: DataFrame, scale: float = 400.0) -> DataFrame:
    """a, b and the expected rate at which a wins against b, for all pairs of the models in ``elo`` (model, elo): as many rows as models squared."""
    a, b = (elo.select(F.col("model").alias(x), F.col("elo").alias(f"elo_{x}")) for x in "ab")
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", (1 / (1 + F.pow(F.lit(10.0), (F.col("elo_b") - F.col("elo_a")) / scale))).alias("rate"))


def battles(judgments: DataFrame, weight: int = 3) -> DataFrame:
    """model_a, model_b, winner, one row for each game of a judgment (question, model_a, model_b, games: array of verdicts as A>>B, A>B, A=B, B>A, B>>A), and ``weight`` rows for a clear one.

    In the second game the models have changed places.
    """
    games = judgments.select("model_a", "model_b", F.posexplode("games").alias("game", "verdict"))
    first = F.when(F.col("verdict").startswith("A>"), "model_a").when(F.col("verdict").startswith("B>"), "model_b").when(F.col("verdict") == "A=B", "tie")
    turned = F.when(F.col("game") == 0, first).otherwise(F.when(first == "model_a", "model_b").when(first == "model_b", "model_a").otherwise(first))
    times = F.when(F.col("verdict").contains(">>"), weight).otherwise(1)
    return games.where(first.isNotNull()).select("model_a", "model_b", turned.alias("winner"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def with_requests(results: DataFrame, requests: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """``results`` with the columns of the newest request of the same keys; nulls without one."""
    rest = [c for c in requests.columns if c not in keys]
    last = requests.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_last"))
    return results.join(last, keys, "left").select(*results.columns, *(F.col(f"_last.{c}").alias(c) for c in rest))


def task_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means by group with NaN counted as 0; nulls take no part."""
    return df.groupBy(*by).agg(F.avg(F.nanvl(F.col(value), F.lit(0.0))).alias("mean"))


def row_mean(columns: list[str]) -> Column:
    """The mean of the columns that aren't null, to three places; null without any."""
    values = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), 3))


def queue_class(status: Column) -> Column:
    return F.when(status.isin("PENDING", "RERUN"), "pending").when(status == "RUNNING", "running").when(status.startswith("FINISHED") | (status == "PENDING_NEW_EVAL"), "finished")


def view(df: DataFrame, baseline: DataFrame, benchmarks: list[str], order: str) -> DataFrame:
    """Rows and the baseline's, benchmarks to two places, without rows that lack one, ranked by ``order`` from the greatest."""
    both = df.unionByName(baseline).dropna(subset=benchmarks).withColumns({c: F.round(c, 2) for c in benchmarks})
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(order), *both.columns)))


def judge_ranking(df: DataFrame, by: str, score: str, most: int = 30) -> DataFrame:
    """By model: answered (a score that isn't null), errored, the sum of scores above 0, and its percentage of answered times ``most``."""
    sums = df.groupBy(by).agg(F.count(score).alias("answered"), F.count_if(F.col(score).isNull()).alias("errored"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col(score))), F.lit(0)).alias("points"))
    return sums.withColumn("percent", F.when(F.col("answered") > 0, 100 * F.col("points") / (F.col("answered") * most)))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: a and b of y = a x ** b by least squares of logarithms, and the standard error of b and its 95 % band."""
    log_x, log_y = F.log(F.col(x)), F.log(F.col(y))
    fit = df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.count("*").alias("n"), F.regr_slope(log_y, log_x).alias("b"), F.regr_intercept(log_y, log_x).alias("i"), F.regr_sxx(log_y, log_x).alias("sxx"), F.regr_syy(log_y, log_x).alias("syy"), F.regr_sxy(log_y, log_x).alias("sxy"))
    error = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    return fit.select("n", F.exp("i").alias("a"), "b", (F.col("b") - 1.96 * error).alias("low"), (F.col("b") + 1.96 * error).alias("high"))


def merge_gaps(df: DataFrame, by: str, start: str, end: str, gap: float) -> DataFrame:
    """Segments joined where the next starts at most ``gap`` after all before it end."""
    order = Window.partitionBy(by).orderBy(start, end)
    upto = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(upto.isNull() | (F.col(start) - upto > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def merge_capped(df: DataFrame, by: str, start: str, end: str, gap: float, most: float, least: float = 0.0, cut: bool = False) -> DataFrame:
    """As :func:`merge_gaps`, but no joined segment is longer than ``most``. With ``cut`` longer single ones are cut; what is shorter than ``least`` goes.

    The rule is sequential, so a group's segments go through one task in order of start; it holds one of them.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        types: list[pa.DataType] = []
        for batch in batches:
            out: list[list] = []
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and key == now[0] and a - now[2] <= gap and b - now[1] <= most:
                    now[2] = max(now[2], b)
                    continue
                if now is not None:
                    out.append(now)
                now = [key, a, b]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(batch.schema.types)], [by, start, end])
            types = batch.schema.types
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now, types, strict=True)], [by, start, end])

    rows = df.select(by, F.col(start).cast("double"), F.col(end).cast("double")).repartition(by).sortWithinPartitions(by, start, end)
    found = rows.mapInArrow(folded, rows.schema)
    if cut:
        parts = F.ceil((F.col(end) - F.col(start)) / most).cast("int")
        found = found.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
        found = found.select(by, (F.col(start) + F.col("_i") * most).alias(start), F.least(F.col(end), F.col(start) + (F.col("_i") + 1) * most).alias(end))
    return found.where(F.col(end) - F.col(start) >= least)


def top_products(queries: DataFrame, facts: DataFrame, k: int, *, floor: float | None = None, block: int = 4096) -> DataFrame:
    """q, vec_id and rank of the ``k`` facts (vec_id, e) of greatest inner product with each query (q, x), other than itself; of ``floor`` or more.

    Queries go out in blocks of about ``block``, each broadcast by itself over one scan of the facts, whose partitions rank before the shuffle.
    """
    score = F.round(F.aggregate(F.zip_with("x", "e", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p), 9)
    blocks, out = max(1, -(-queries.count() // block)), None
    for i in range(blocks):
        both = facts.crossJoin(F.broadcast(queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i))).where("q <> vec_id").select("q", "vec_id", score.alias("s"))
        both = both if floor is None else both.where(F.col("s") >= floor)
        top = both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).where(F.col("rank") <= k).select("q", "vec_id", F.col("rank").cast("long"))
        out = top if out is None else out.union(top)
    return out


def spans(df: DataFrame, by: str, at: str, tag: str, token: str) -> DataFrame:
    """Entities of BIO tags: by, type, first and last position, text. An I that follows no tag of its type starts an entity."""
    order = Window.partitionBy(by).orderBy(at)
    kind = F.when(F.col(tag) != "O", F.substring(F.col(tag), 3, 100))
    df = df.withColumn("_kind", kind)
    new = F.col(tag).startswith("B-") | (F.col("_kind").isNotNull() & ~F.lag("_kind").over(order).eqNullSafe(F.col("_kind")))
    df = df.withColumn("_span", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_kind IS NOT NULL")
    found = df.groupBy(by, "_span").agg(F.first("_kind").alias("kind"), F.min(at).alias("first"), F.max(at).alias("last"), F.array_sort(F.collect_list(F.struct(at, token))).alias("t"))
    return found.select(by, "kind", "first", "last", F.array_join(F.transform("t", lambda x: x[token]), " ").alias("entity"))
