"""Putting training sets together: quotas, token budgets, directed pairs, interleaving, inventories, catalogs, plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols as S
from ..sources.work import removed, saved, work_folder
from .sampling import order_of


def token_budgets(df: DataFrame, by: str, amount: str, shares: dict[str, float]) -> DataFrame:
    """By group the rows to take, so that sums of ``amount`` are in proportion to ``shares``: at least one of a group that has any."""
    share = F.lit(None).cast("double")
    for k, v in shares.items():
        share = F.when(F.col(by) == k, F.lit(v)).otherwise(share)
    sums = df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(amount).alias("total")).withColumn("share", share).where("share > 0")
    least = sums.agg(F.min(F.col("total") / F.col("share")).alias("budget"))
    kept = F.least(F.lit(1.0), F.col("budget") * F.col("share") / F.col("total"))
    return sums.crossJoin(F.broadcast(least)).select(by, "rows", "total", F.greatest(F.lit(1), F.floor(F.col("rows") * kept)).alias("take"))


def two_phase_quota(df: DataFrame, by: str, priority: list, order: list[Column], key: str, *, target: int, cap: int) -> DataFrame:
    """``target`` rows: of each group in ``priority`` its first ``cap`` by ``order``, groups in turn, and then the best of what is left.

    ``df`` with the columns ``phase`` and ``place``. Ranks are within groups; what is ranked over all groups are the ``cap`` rows of the named
    ones and, of the rest, the first ``target`` of each group, as no more can be needed.
    """
    rank = F.lit(len(priority))
    for i, g in reversed(list(enumerate(priority))):
        rank = F.when(F.col(by) == g, F.lit(i)).otherwise(rank)
    own = df.withColumn("_group", rank).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    first = (F.col("_group") < len(priority)) & (F.col("_n") <= cap)
    near = own.where(F.col("_n") <= cap + target).withColumn("phase", F.when(first, 1).otherwise(2))
    named = F.when(F.col("phase") == 1, F.col("_group")).otherwise(0)
    taken = near.withColumn("place", F.row_number().over(Window.orderBy("phase", named, *order, key)))
    return taken.where(F.col("place") <= target).drop("_group", "_n")


def exact_share(df: DataFrame, key: str, share: float, seed: int = 42, flag: str = "picked") -> DataFrame:
    """``df`` with a flag that holds for max(1, floor(share * rows)) rows, the last in hash order: by the order's parts, so nothing is sorted in one task."""
    order = order_of(F.col(key), seed)
    part = df.select(key, order.alias("_order"), F.substring(order, 1, 3).alias("_part"))
    sums = part.groupBy("_part").agg(F.count("*").alias("_n"))
    after = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_after"))
    wanted = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("_wanted"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_order"), F.desc(key)))
    placed = part.withColumn("_in", place).join(F.broadcast(after), "_part").crossJoin(F.broadcast(wanted)).select(key, (F.col("_after") + F.col("_in") <= F.col("_wanted")).alias(flag))
    return df.join(placed, key)


def directed(df: DataFrame, key: str, a: str, b: str, tags: tuple[int, int], separator: int, end_id: int) -> DataFrame:
    """Two rows for each pair of id lists, one for each direction: tag, ids, separator, other tag, other ids, end."""
    lit = lambda x: F.array(F.lit(x).cast("bigint"))
    whole = lambda x, y, s, t: F.concat(lit(s), F.col(x), lit(separator), lit(t), F.col(y), lit(end_id))
    return df.select(key, F.explode(F.array(F.struct(F.lit(0).alias("way"), whole(a, b, *tags).alias("ids")), F.struct(F.lit(1).alias("way"), whole(b, a, *reversed(tags)).alias("ids")))).alias("x")).select(key, "x.*")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in hash order: a range partitioning by the hash, so that no task sorts more than its part."""
    return df.withColumn("_order", order_of(F.col(key), seed)).repartitionByRange("_order").sortWithinPartitions("_order", key).drop("_order")


def interleaved(df: DataFrame, by: str, key: str, ids: str, size: int, seed: int = 42) -> DataFrame:
    """Chunks of ``size`` ids of each group's documents in order of key (the last of a group may be shorter), with ``place``, the hash by which chunks are shuffled."""
    from .packing import offsets

    rows = df.select(by, key, F.col(ids).alias("_ids"), F.size(ids).cast("long").alias("_n")).where("_n > 0")
    groups = [r[0] for r in rows.select(by).distinct().collect()]
    out = None
    for g in groups:
        placed = offsets(rows.where(F.col(by).eqNullSafe(g)), key, "_n")
        cut = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("_n") - 1) / size))))
        start = F.greatest(F.lit(0), F.col("chunk") * size - F.col("offset"))
        stop = F.least(F.col("_n"), (F.col("chunk") + 1) * size - F.col("offset"))
        cut = cut.select(by, "chunk", "offset", F.slice("_ids", (start + 1).cast("int"), (stop - start).cast("int")).alias("piece"))
        whole = cut.groupBy(by, "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"])).alias("ids"))
        out = whole if out is None else out.unionByName(whole)
    if out is None:
        return rows.select(by, F.lit(0).cast("long").alias("chunk"), F.col("_ids").alias("ids")).withColumn("place", F.lit(""))
    return out.withColumn("place", order_of(F.concat_ws("|", by, "chunk"), seed))


def decoded(ids: Column, tokens: Column) -> Column:
    """The tokens of ids, a map's or an array's (from id 0), joined by spaces; unknown ids give nothing."""
    return F.array_join(F.transform(ids, lambda i: F.try_element_at(tokens, i)), " ")


def chinchilla(tokens: Column) -> Column:
    """Parameters for which as many tokens are the best budget: a twentieth."""
    return tokens / 20


#: Merges after which words are written anew. Until then each count makes them again.
_REWRITE = 8


def train_merges(df: DataFrame, words: Column, merges: int) -> list[tuple[str, str]]:
    """A BPE vocabulary's merges: words and, for each merge, the pairs in distinct words are counted by Spark; only the best pair comes to the driver. Ties go to the smaller pair."""
    spark = df.sparkSession
    counted = df.select(F.explode(words).alias("w")).where(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n"))
    folder = work_folder(spark)
    blocks = saved(counted.mapInArrow(S.word_blocks, S.BLOCK), folder)
    out: list[tuple[str, str]] = []
    texts: list[str] = []
    ids: dict[str, int] = {}
    rules: list[S.Rule] = []
    while len(out) < merges:
        if len(rules) == _REWRITE:
            last, folder = folder, work_folder(spark)
            blocks = saved(blocks.mapInArrow(lambda x, rules=tuple(rules): S.merged_blocks(x, rules), S.BLOCK), folder)
            removed(spark, last)
            rules = []
        pairs = blocks.mapInArrow(lambda x, rules=tuple(rules), texts=tuple(texts): S.pair_counts(x, rules, texts), "a string, b string, n bigint")
        best = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(1).collect()
        if not best:
            break
        a, b, _ = best[0]
        out.append((a, b))
        if a + b not in ids:  # several pairs may make one text, which is one symbol
            texts.append(a + b)
            ids[a + b] = S.END + len(texts)
        rules.append((*(ids[x] if len(x) > 1 else ord(x) for x in (a, b)), ids[a + b]))
    removed(spark, folder)
    return out


def days_since(date: Column, as_of: Column) -> Column:
    """Whole days from a date (as yyyyMMdd, else null) to ``as_of``."""
    return F.datediff(as_of, F.try_to_timestamp(date, F.lit("yyyyMMdd")).cast("date"))


def rank_score(age_days: Column, seconds: Column, allow: Column, deny: Column, live: Column, horizon: int = 365) -> Column:
    """Recency (days left of ``horizon``), minutes up to thirty, and what keywords and a live flag add or take."""
    recency = F.greatest(F.lit(0), F.lit(horizon) - F.coalesce(age_days, F.lit(horizon)))
    return recency + F.least(F.coalesce(seconds, F.lit(0)), F.lit(1800)) / 60 + 20 * allow - 50 * deny + F.when(live, 5).otherwise(0)


def literal_texts(text: Column) -> Column:
    """The texts of ``{'text': '...'}`` literals in a text, on a line each; a text without any as it is."""
    found = F.regexp_extract_all(text, F.lit(r"\{\s*['\"]text['\"]\s*:\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\")\s*\}"), F.lit(0))
    inner = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\{\s*['\"]text['\"]\s*:\s*['\"]|['\"]\s*\}$", ""), r"\\(['\"\\])", "$1"))
    return F.when(F.size(found) > 0, F.array_join(F.transform(inner, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\n")).otherwise(text)


def folder_name(host: Column) -> Column:
    return F.translate(host, ":/.", "___")


def catalog(df: DataFrame, url: str, description: str) -> DataFrame:
    """Sites of http URLs: host in lower case, URL with a slash behind, 200 characters of description, one row for each host (the least URL)."""
    host = F.lower(F.regexp_extract(url, "^https?://([^/?#:]+)", 1))
    rows = df.where(F.col(url).rlike("^https?://")).select(host.alias("domain"), F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/")).alias("url"), F.substring(F.col(description), 1, 200).alias("description"))
    return rows.groupBy("domain").agg(F.min(F.struct("url", "description")).alias("x")).select("domain", "x.*")


#: Chat text between code blocks, code blocks, and the prefixes of Markdown lines.
_CODE = r"(?s)```.*?```"


def segments(text: Column) -> Column:
    """What a translator may change and what it must not: structs (kind code or text, prefix, body) of a chat text's code blocks and lines."""
    marked = F.regexp_replace(text, _CODE, "\u0001$0\u0001")

    def of(part: Column) -> Column:
        line = lambda x: F.struct(F.lit("text").alias("kind"), F.regexp_extract(x, r"^(\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s*)?)", 1).alias("prefix"), F.regexp_replace(x, r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s*)?", "").alias("body"))
        return F.when(part.startswith("```"), F.array(F.struct(F.lit("code").alias("kind"), F.lit("").alias("prefix"), part.alias("body")))).otherwise(F.transform(F.split(part, "\n", -1), line))

    return F.transform(F.split(marked, "\u0001", -1), of)


def reassembled(parts: Column) -> Column:
    """The text of :func:`segments`, again."""
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(p, lambda s: F.concat(s["prefix"], s["body"])), "\n")), "")


@dataclass(frozen=True)
class Agent:
    """A plug-in that adds columns to rows: a function of each row (a dict) to a dict. What raises gives nulls."""

    name: str
    columns: dict[str, str]
    process: Callable[[dict], dict]
    #: A condition on rows to process; others get nulls.
    mask: Column | None = field(default=None)


AGENTS: dict[str, Agent] = {}


def register(agent: Agent) -> Agent:
    AGENTS[agent.name] = agent
    return agent


def run_agent(df: DataFrame, agent: Agent | str, inputs: list[str]) -> DataFrame:
    """``df`` with the agent's columns, unless it has them all; columns that it has are filled only where they are null."""
    agent = AGENTS[agent] if isinstance(agent, str) else agent
    if set(agent.columns) <= set(df.columns):
        return df
    process, names = agent.process, list(agent.columns)  # the mask stays on the driver

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in agent.columns.items()))
    def processed(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            found: dict = {}
            if row.pop("_run"):
                try:
                    found = process(row)
                except Exception:  # a plug-in's failure is a null, by contract
                    found = {}
            out.append({c: found.get(c) for c in names})
        return pd.DataFrame(out, columns=names, dtype=object)

    mask = F.lit(True) if agent.mask is None else F.coalesce(agent.mask, F.lit(False))
    found = df.withColumn("_agent", processed(F.struct(*inputs, mask.alias("_run"))))
    return found.withColumns({c: F.coalesce(F.col(c), F.col(f"_agent.{c}")) if c in df.columns else F.col(f"_agent.{c}") for c in agent.columns}).drop("_agent")


def backfilled(df: DataFrame, column: str, mask: Column, value: Column) -> DataFrame:
    """``column`` recomputed for the rows of ``mask``; no join by position is needed."""
    return df.withColumn(column, F.when(mask, value).otherwise(F.col(column)))

