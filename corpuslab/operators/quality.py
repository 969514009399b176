"""Scores into percentiles, buckets, tiers and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def buckets(x: Column, edges: list[float]) -> Column:
    """``[a,b)`` of the fixed edges that ``x`` is in; the last is open."""
    out = F.lit(f"[{edges[-1]:g},inf)")
    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when(x < b, F.lit(f"[{a:g},{b:g})")).otherwise(out)
    return F.when(finite(x), out).otherwise(F.lit("none"))


def tiers(df: DataFrame, score: str, cuts: tuple[float, float, float] = (0.25, 0.5, 0.9), names: tuple[str, ...] = ("gold", "silver", "bronze", "reject")) -> DataFrame:
    """``df`` with ``tier`` by exact percentiles of the finite scores; scores that aren't finite are the last tier."""
    names_of = {f"_e{i}": c for i, c in enumerate(cuts)}
    edges = percentiles(df.where(finite(F.col(score))).select(F.lit(0).alias("_all"), score), "_all", score, names_of).select(F.array(*names_of).alias("_e"))
    tier = F.lit(names[-1])
    for i in reversed(range(len(cuts))):
        tier = F.when(finite(F.col(score)) & (F.col(score) < F.col("_e")[i]), names[i]).otherwise(tier)
    return df.crossJoin(F.broadcast(edges)).withColumn("tier", tier).drop("_e")


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; ``order`` must be total."""
    return df.orderBy(*order).offset(size * number).limit(size)


def _counted(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, the distinct values, _n (all values of the group) and _upto (those up to this one)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    edges = counts.groupBy(by).agg(F.sum("_c").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.greatest((F.col("_high") - F.col("_low")).cast("double") / 256, F.lit(1e-300))
    placed = counts.join(F.broadcast(edges), by).withColumn("_part", F.least(F.lit(255), F.floor((F.col(value) - F.col("_low")) / width)))
    sums = placed.groupBy(by, "_part").agg(F.sum("_c").alias("_s"))
    before = sums.select(by, "_part", F.coalesce(F.sum("_s").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_c").over(Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_in", within).join(F.broadcast(before), [by, "_part"]).withColumn("_upto", F.col("_before") + F.col("_in"))


def order_statistics(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """By group the value at index floor(share * n) of the sorted values, for each named share; nulls take no part.

    Values are counted first; of the distinct ones the running count is taken within ranges of the value and over the
    ranges' sums, so no task holds or sorts a group's rows.
    """
    upto = _counted(df, by, value)
    at = lambda s: F.least(F.floor(F.lit(s) * F.col("_n")), F.col("_n") - 1)
    return upto.groupBy(by).agg(*(F.min(F.when(F.col("_upto") > at(s), F.col(value))).alias(name) for name, s in shares.items()))


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """By group the exact percentiles of the values that aren't null, between two values in proportion; by counting, as :func:`order_statistics`."""
    upto = _counted(df, by, value)
    at = lambda s: (F.col("_n") - 1) * F.lit(s)
    value_at = lambda p: F.min(F.when(F.col("_upto") > p, F.col(value).cast("double")))
    ends = upto.groupBy(by).agg(F.max("_n").alias("_n"), *(value_at(f(at(s))).alias(f"_{k}_{name}") for name, s in shares.items() for k, f in (("low", F.floor), ("high", F.ceil))))
    part = lambda name, s: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at(s) - F.floor(at(s)))
    return ends.select(by, *(part(name, s).alias(name) for name, s in shares.items()))
