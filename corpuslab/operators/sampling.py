"""Samples, splits and balancing by hash order: the same rows at any partitioning. A seed changes which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(key: Column, seed: int = 42) -> Column:
    """A text that orders rows as if shuffled; any engine with MD5 has the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def sample_per_group(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group. Spark limits each partition's groups before the shuffle."""
    return ranked(df, [by], [order_of(F.col(key), seed), F.col(key)]).where(F.col("rank") <= n).drop("rank")


def first_in_order(df: DataFrame, by: str, key: str, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Of each group the first ``_target`` rows (targets: by, _target) in hash order; groups without a target have none.

    Rows are counted by the first digits of the order. Parts that lie before the target stay whole and unsorted; only those it
    falls into are ranked, so no task holds a group.
    """
    rows = df.withColumn("_order", order_of(F.col(key), seed)).withColumn("_part", F.substring("_order", 1, 3))
    sums = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.withColumn("_before", before).join(targets.select(by, "_target"), by).where("_before < _target")
    placed = rows.join(parts.withColumn("_whole", F.col("_before") + F.col("_n") <= F.col("_target")), [by, "_part"])
    edge = placed.where("NOT _whole").withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_part").orderBy("_order", key)))
    return placed.where("_whole").select(*df.columns).union(edge.where("_rank <= _target - _before").select(*df.columns))


def balance(df: DataFrame, by: str, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """As many rows of each group that their proportions are ``shares`` and nothing more could be had; groups without a share have none."""
    share = F.lit(None).cast("double")
    for k, v in shares.items():
        share = F.when(F.col(by) == k, F.lit(v)).otherwise(share)
    counts = df.groupBy(by).agg(F.count("*").alias("_n")).withColumn("_share", share).where("_share > 0")
    targets = counts.crossJoin(counts.agg(F.min(F.col("_n") / F.col("_share")).alias("_budget")))
    return first_in_order(df, by, key, targets.select(by, F.least("_n", F.floor(F.col("_budget") * F.col("_share"))).alias("_target")), seed)


def undersample(df: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """All groups cut to the smallest one's size; rows without a group go."""
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    return first_in_order(df, by, key, counts.select(by).crossJoin(counts.agg(F.min("_n").alias("_target"))), seed)


def upsample(df: DataFrame, by: str, wanted: int, most: int) -> DataFrame:
    """Rows of small groups repeated min(wanted // n, most) times (once at least), numbered in ``copy``."""
    counts = df.groupBy(by).agg(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(wanted) / F.count("*")))).cast("int").alias("_k"))
    return df.join(counts, by).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def split(df: DataFrame, key: str, percent: dict[str, int], seed: int = 42) -> DataFrame:
    """``df`` with a column ``split``: each row falls into one of a hundred parts by its hash, without a sort."""
    part = F.conv(F.substring(order_of(F.col(key), seed), 1, 8), 16, 10).cast("bigint") % 100
    out, upto = F.lit(None).cast("string"), 100
    for name, share in reversed(percent.items()):
        upto -= share
        out = F.when(part >= upto, name) if out is None else F.when((part >= upto) & (part < upto + share), F.lit(name)).otherwise(out)
    return df.withColumn("split", out)


def quota(df: DataFrame, by: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return ranked(df, [by], order).where(F.col("rank") <= cap)


def running_until(df: DataFrame, by: str, order: str, amount: str, target: float, unique: list[str] | None = None) -> DataFrame:
    """Rows in order of a number or a text (and of ``unique`` where it is equal) until their running sum reaches ``target``; the row that reaches it is in.

    The sum is taken within parts of the order and over the parts' sums, and parts that begin beyond the target are left out
    before they are sorted, so no task holds a group. Amounts must not be negative.
    """
    if dict(df.dtypes)[order] == "string":
        rows = df.withColumn("_part", F.substring(order, 1, 3))
    else:
        edges = df.groupBy(F.col(by).alias("_by")).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
        width = F.greatest((F.col("_high") - F.col("_low")).cast("double") / 4096, F.lit(1e-300))
        rows = df.join(F.broadcast(edges), F.col(by).eqNullSafe(F.col("_by"))).withColumn("_part", F.floor((F.col(order) - F.col("_low")) / width)).drop("_by", "_low", "_high")
    sums = rows.groupBy(by, "_part").agg(F.sum(amount).alias("_n"))
    over = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before")).where(F.col("_before") < target)
    rows = rows.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    within = Window.partitionBy(by, "_part").orderBy(order, *(unique or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("running", F.col("_before") + F.sum(amount).over(within)).where(F.col("running") - F.col(amount) < target)
    return rows.select(*df.columns, "running")


def trim_to_shares(df: DataFrame, by: str, key: str, amount: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Each group cut to its share of the sum of ``amount`` over all of ``df``; ``kept`` is what is left of a row's amount.

    Rows are in hash order, and the one that reaches the target is cut. Groups without a share are whole. The running sum is within
    parts of the order, and over the parts' sums, so no task holds a group.
    """
    share = F.lit(None).cast("double")
    for k, v in shares.items():
        share = F.when(F.col(by) == k, F.lit(v)).otherwise(share)
    total = df.agg(F.sum(amount).alias("_total"))
    rows = df.withColumn("_order", order_of(F.col(key), seed)).withColumn("_part", F.substring("_order", 1, 3))
    sums = rows.groupBy(by, "_part").agg(F.sum(amount).alias("_n"))
    over = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    within = F.sum(amount).over(Window.partitionBy(by, "_part").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_in", F.coalesce(within, F.lit(0))).join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))).crossJoin(F.broadcast(total))
    left = F.floor(F.col("_total") * share) - F.col("_before") - F.col("_in")
    rows = rows.withColumn("kept", F.when(share.isNull(), F.col(amount)).otherwise(F.least(F.col(amount), left)))
    return rows.where(share.isNull() | (left > 0)).select(*df.columns, "kept")


def identity_rows(df: DataFrame, key: str, source: str, target: str, percent: int, seed: int = 42) -> DataFrame:
    """``df`` and, for ``percent`` of it, rows whose source is their target."""
    part = F.conv(F.substring(order_of(F.col(key), seed), 1, 8), 16, 10).cast("bigint") % 100
    same = df.where(part < percent).withColumn(source, F.col(target))
    return df.withColumn("identity", F.lit(False)).unionByName(same.withColumn("identity", F.lit(True)))
