"""Overlap of benchmark items with a corpus by character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chars import known_windows
from ..sources.work import saved


#: N-grams of items that are broadcast, at most; more are joined.
BROADCAST = 1 << 20


def _plain(text: str) -> Column:
    return F.lower(T.strip(F.col(text)))


def item_overlap(items: DataFrame, corpus: DataFrame, *, key: str = "item_id", text: str = "text", n: int = 13, broadcast: int = BROADCAST) -> DataFrame:
    """key, n_grams and n_found: how many of an item's distinct n-grams some text of the corpus has. Items of fewer characters have none.

    The items' n-grams are the small side. Up to ``broadcast`` of them are looked for in one pass over the corpus by hash, and
    by what they are; nothing of the corpus is shuffled but what is found. More are joined. Both give the same rows.
    """
    own = saved(items.select(key, F.explode(T.char_ngrams(_plain(text), n)).alias("gram")))
    wanted = own.select("gram").distinct()
    if wanted.count() <= broadcast:
        found = known_windows(corpus.select(_plain(text).alias("plain")), "plain", n, [r.gram for r in wanted.collect()])
    else:
        found = corpus.select(F.explode(T.char_ngrams(_plain(text), n)).alias("gram")).join(wanted, "gram", "left_semi")
    found = found.distinct().withColumn("hit", F.lit(1))
    return own.join(found, "gram", "left").groupBy(key).agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_found"))
