"""Exact and near de-duplication that keep the first of each group under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.work import saved


def keep_first(df: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """Of each key the row that is first by ``order`` (unique within a key). The order's least values are aggregated before the shuffle, so a hot key is no hot task."""
    keyed = df.withColumn("_key", F.md5(F.col(key) if isinstance(key, str) else key))
    first = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
    return keyed.drop("_key").join(first, order, "left_semi")


def flag_duplicates(df: DataFrame, key: Column | str, order: list[str], flag: str = "duplicate") -> DataFrame:
    """``df`` with a column that says whether a row isn't the first of its key; read twice, so ``df`` should be cheap."""
    keyed = df.select(F.md5(F.col(key) if isinstance(key, str) else key).alias("_key"), *order)
    first = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first")).select("_first.*", F.lit(False).alias(flag))
    return df.join(first, order, "left").withColumn(flag, F.coalesce(flag, F.lit(True)))


def not_seen(df: DataFrame, seen: DataFrame, key: Column) -> DataFrame:
    """Rows whose key's MD5 isn't in the one column of ``seen``."""
    return df.withColumn("_key", F.md5(key)).join(seen.toDF("_key"), "_key", "left_anti").drop("_key")


def exact_pairs(df: DataFrame, key: str, text: str, n: int, threshold: float) -> DataFrame:
    """Pairs (a < b) of texts whose sets of word ``n``-grams have a Jaccard similarity of ``threshold`` or more.

    Prefix filter: in the global order of n-grams (rare ones first) two such sets share one of their first
    size - ceil(threshold * size) + 1, so only those are joined; common n-grams are hardly ever among them, and n-grams of one
    set are left out. All pairs of a group of near copies are in the result, as asked for.
    """
    grams = F.array_distinct(F.transform(T.ngrams(T.words(F.col(text)), n), lambda g: F.xxhash64(g)))
    sets = saved(df.select(F.col(key).alias("id"), grams.alias("grams")).where(F.size("grams") > 0))
    each = sets.select("id", F.explode("grams").alias("gram"))
    frequency = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")  # others are the rarest and meet no one
    ranked = each.join(frequency, "gram").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("common"))
    sized = sets.select("id", F.size("grams").alias("n")).join(ranked, "id")
    # Of the first size - ceil(threshold * size) + 1, those that another set has.
    keys = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1 - (F.col("n") - F.size("common"))
    keys = sized.where(keys > 0).select("id", "n", F.explode(F.slice("common", F.lit(1), keys)).alias("gram"))
    a, b = (keys.select("gram", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))
    pairs = a.join(b, "gram").where(near).select("a", "b").distinct()
    left, right = (sets.select(F.col("id").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
    return both.select("a", "b", "common", (F.size("grams_a") + F.size("grams_b") - F.col("common")).alias("either")).where(F.col("common") >= threshold * F.col("either"))


def greedy_keep(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids that stay if one goes through them in order and drops what is like one that stayed.

    In rounds: an undecided id without a smaller undecided neighbour stays, its neighbours go. Each round's ids are
    checkpointed (spark.checkpoint.dir), so plans don't grow.
    """
    undecided, kept = ids.toDF("id"), None
    edges = pairs.select("a", "b").checkpoint()
    lone = undecided.join(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "id", "left_anti")
    undecided = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    kept = lone
    while True:
        if edges.isEmpty():
            return kept.union(undecided)
        stays = undecided.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti").checkpoint()
        goes = edges.join(stays.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        kept = kept.union(stays)
        undecided = undecided.join(stays.union(goes), "id", "left_anti").checkpoint()
        alive = undecided
        edges = edges.join(alive.withColumnRenamed("id", "a"), "a", "left_semi").join(alive.withColumnRenamed("id", "b"), "b", "left_semi").checkpoint()
