"""URL filter: host and path rules first, and for the rest a ratio of two character language models.

The models are smoothed variable-order Markov models of URL bytes, one of URLs that the rules allow, one of those that they
block: contexts of up to ``ORDER`` bytes, interpolated from the longest down by Witten-Bell weights. Counts are kept by the
n-gram itself, of all n-grams, in tables that grow with the input; the n-grams of the URLs to score are joined to them. Only the
values of the ``HOT`` n-grams that occur most often are broadcast, for they would be hot keys of that join. A URL's score is the
difference of the models' log-likelihoods divided by its length; the least score to allow is the one that separates best
(balanced accuracy) a fifth of the ruled URLs that the models haven't seen.

A null URL, and one without ``://``, has empty host and path, so no rule fits it. An empty URL scores 0. Repeated URLs count
as often as they occur; very long ones are scored whole. Columns keep their values but for host, path, rule, verdict and ratio,
which are replaced. Of thresholds that separate as well the middle one is taken. No rows give no rows. If the rules allow or block nothing, there is no ratio, and what no rule decides is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, steps, written

ORDER = 5
#: Bits of a byte of an n-gram: 0 is before the start, others are 1 more. ORDER + 1 of them fit into 64 bits.
BITS = 9
HOT = 1 << 16
#: Scores are calibrated by bins of 1 / BINS from -LIMIT to LIMIT.
BINS, LIMIT = 200, 8
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Differences of log-likelihoods are summed as multiples of 1 / UNIT, so that sums don't depend on their order.
UNIT = 1 << 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; and then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a domain above it) and the start of its path, and the rule's verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each URL: its row, and the byte with the ``ORDER`` bytes before it, the last one in the lowest bits."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    start, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8)[start:end].astype(np.int64) + 1 if end > start else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    since = np.arange(len(data)) - (offsets[:-1] - start)[row]
    grams = data.copy()
    for k in range(1, ORDER + 1):  # the byte k before
        before = np.zeros(len(data), np.int64)
        before[k:] = data[: len(data) - k]
        before[since < k] = 0
        grams |= before << (BITS * k)
    return row, grams


def gram_tables(urls: DataFrame) -> list[DataFrame]:
    """By order, the n-grams of ``urls`` (url, side, n, train): gram, n0 and n1 by side in what is learned from, w in the rest."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "url", 4 << 20):
            row, grams = _grams(batch.column(0))
            unique, at = np.unique(grams, return_inverse=True)
            side, n, train = (pc.fill_null(batch.column(i).cast(pa.int64()), 0).to_numpy() for i in (1, 2, 3))
            weights = (np.where((train == 1) & (side == 0), n, 0), np.where((train == 1) & (side == 1), n, 0), 1 - train)
            sums = [pa.array(np.bincount(at, w[row], len(unique)).astype(np.int64)) for w in weights]
            yield pa.RecordBatch.from_arrays([pa.array(unique), *sums], ["gram", "n0", "n1", "w"])

    tables: list[DataFrame] = []
    grams = urls.select("url", "side", "n", F.col("train").cast("int")).mapInArrow(counted, "gram bigint, n0 bigint, n1 bigint, w bigint")
    for k in range(ORDER, -1, -1):
        gram = F.col("gram").bitwiseAND((1 << BITS * (k + 1)) - 1).alias("gram")
        grams = written(grams.groupBy(gram).agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "w"))), "grams")
        tables.insert(0, grams)
    return tables


def differences(tables: list[DataFrame]) -> DataFrame:
    """gram, w and the models' difference of log-likelihoods (in 1 / UNIT) of each n-gram of the highest order with w."""
    below = None
    for k, table in enumerate(tables):
        same = Window.partitionBy("context")  # 257 rows at most
        at = table.withColumn("context", F.shiftright("gram", BITS))
        at = at.withColumns({f"t{i}": F.sum(f"n{i}").over(same) for i in (0, 1)} | {f"d{i}": F.sum((F.col(f"n{i}") > 0).cast("long")).over(same) for i in (0, 1)}).where("w > 0")
        if below is None:
            at = at.withColumns({f"q{i}": F.lit(1 / 256) for i in (0, 1)})
        else:
            at = at.withColumn("rest", F.col("gram").bitwiseAND((1 << BITS * k) - 1)).join(below.withColumnRenamed("gram", "rest"), "rest")
        p = (F.when(F.col(f"t{i}") > 0, (F.col(f"n{i}") + F.col(f"d{i}") * F.col(f"q{i}")) / (F.col(f"t{i}") + F.col(f"d{i}"))).otherwise(F.col(f"q{i}")).alias(f"q{i}") for i in (0, 1))
        below = at.select("gram", *p, *(["w"] if k == len(tables) - 1 else []))
    return below.select("gram", "w", F.round((F.log("q0") - F.log("q1")) * UNIT).cast("bigint").alias("d"))


def ratios(urls: DataFrame, models: DataFrame, hot: int = HOT) -> DataFrame:
    """url, side, n and ratio of ``urls``."""
    most = written(models.orderBy(F.desc("w"), "gram").limit(hot), "hot").toPandas().sort_values("gram")  # cut on executors
    shared = urls.sparkSession.sparkContext.broadcast((most["gram"].to_numpy(np.int64), most["d"].to_numpy(np.int64)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, d = shared.value
        for batch in steps(batches, "url", 1 << 20):
            row, grams = _grams(batch.column(0))
            at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
            held = known[at] == grams if len(known) else np.zeros(len(grams), bool)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row[held], d[at[held]])
            others = np.concatenate([[0], np.cumsum(np.bincount(row[~held], minlength=batch.num_rows))])
            rest = pa.ListArray.from_arrays(pa.array(others, pa.int32()), pa.array(grams[~held]))
            length = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(total), rest], ["url", "side", "n", "length", "total", "rest"])

    parts = written(urls.select("url", "side", "n").mapInArrow(summed, "url string, side int, n bigint, length bigint, total bigint, rest array<bigint>"), "parts")
    rest = parts.select("url", F.explode("rest").alias("gram")).join(models.select("gram", "d"), "gram").groupBy("url").agg(F.sum("d").alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0))
    return parts.join(rest, "url", "left").select("url", "side", "n", (total / UNIT / F.greatest("length", F.lit(1))).alias("ratio"))


def least_ratio(held_out: DataFrame) -> float:
    """The ratio that separates the sides of ``held_out`` (side, n, ratio) best; 0 if it lacks a side."""
    at = F.greatest(F.least(F.floor(F.col("ratio") * BINS), F.lit(LIMIT * BINS)), F.lit(-LIMIT * BINS)).alias("bin")
    table = held_out.groupBy(at, "side").agg(F.sum("n").alias("n")).toPandas()
    by_side = np.zeros((2, 2 * LIMIT * BINS + 2))
    by_side[table["side"].to_numpy(np.int64), table["bin"].to_numpy(np.int64) + LIMIT * BINS] = table["n"]
    total = by_side.sum(1)
    if not (total > 0).all():
        return 0.0
    # Share of allowed ones at or above a bin, and of blocked ones below it.
    right = by_side[0][::-1].cumsum()[::-1] / total[0] + (by_side[1].cumsum() - by_side[1]) / total[1]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return (best[len(best) // 2] - LIMIT * BINS) / BINS  # the middle of what separates as well


def judge(pages: DataFrame, *, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, hot: int = HOT) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ratio (null where a rule decides); columns of these names are replaced."""
    host, path = host_and_path(F.col(url))
    named = pages.withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "verdict": verdict, "ratio": F.lit(None).cast("double")})
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path}).withColumn("verdict", longest_rule(F.col("host"), F.col("path"), rules)[1])
    side = F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("int"))
    train = F.col("verdict").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(5)) != 0)
    urls = written(urls.select("url", "n", side.alias("side"), train.alias("train")), "urls")
    tables = gram_tables(urls)
    learned = tables[0].agg(F.sum("n0"), F.sum("n1")).first()
    if not (learned[0] and learned[1]):
        return named.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    models = written(differences(tables), "models")
    scored = written(ratios(urls.where("NOT train"), models, hot), "ratios")
    least = least_ratio(scored.where("side IS NOT NULL"))
    key = fresh(named.columns, "scored_url")
    value = fresh([*named.columns, key], "scored_ratio")
    scored = scored.where("side IS NULL").select(F.col("url").alias(key), F.col("ratio").alias(value))
    open_ = named.where("verdict IS NULL").withColumn(key, F.coalesce(F.col(url), F.lit(""))).join(scored, key)
    open_ = open_.withColumns({"ratio": F.col(value), "verdict": F.when(F.col(value) >= least, "allow").otherwise("block")})
    return named.where("verdict IS NOT NULL").unionByName(open_.select(*named.columns))


def url_report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "ratio")
