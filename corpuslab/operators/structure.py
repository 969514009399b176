"""Sentences, documents and conversations: taken apart, put together, adapted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MESSAGES = "array<struct<role:string,content:string>>"
ROLES = {"human": "user", "gpt": "assistant", "user": "user", "assistant": "assistant", "system": "system"}


def sentences(df: DataFrame, key: str, text: str = "text", least: int = 10) -> DataFrame:
    """One row for each sentence of ``least`` characters or more: key, sent_idx (from 0), sentence."""
    marked = F.regexp_replace(F.col(text), r"([.!?\x{2026}])\s+", "$1\n")
    kept = F.filter(F.transform(F.split(marked, "\n"), T.strip), lambda s: F.length(s) >= least)
    return df.select(key, F.posexplode(kept).alias("sent_idx", "sentence"))


def paragraph_sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, para_idx, sent_idx and sentence; an empty paragraph is one empty sentence. Sentences end before a capital, digit or quote."""
    paragraphs = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("para_idx", "para"))
    marked = F.regexp_replace(F.col("para"), r"([.!?])\s+([\p{Lu}\p{Nd}\"])", "$1\n$2")
    return paragraphs.select(key, "para_idx", F.posexplode(F.split(T.strip(marked), "\n")).alias("sent_idx", "sentence"))


def reassemble(df: DataFrame, key: str) -> DataFrame:
    """Of :func:`paragraph_sentences` the text again: sentences joined by a space, paragraphs by a line end."""
    paragraphs = df.groupBy(key, "para_idx").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))).alias("s"))
    paragraphs = paragraphs.select(key, "para_idx", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("para"))
    whole = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("para_idx", "para"))).alias("p"))
    return whole.select(key, T.strip(F.array_join(F.transform("p", lambda x: x["para"]), "\n")).alias("text"))


def content_id(parts: Column) -> Column:
    """The first half of the MD5 of an array's texts, each on its line; null without any."""
    return F.when(F.size(parts) > 0, F.substring(F.md5(F.array_join(parts, "\n")), 1, 16))


def document_decision(sents: DataFrame, key: str, lang: str, main: str, drop: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """Of documents of ``least`` sentences or more, of which less than ``share`` are of language ``drop``: counts, and whether ``main`` prevails."""
    own, other = (F.count_if(F.col(lang) == x) for x in (main, drop))
    found = sents.groupBy(key).agg(F.count("*").alias("n"), own.alias("n_main"), other.alias("n_drop"))
    return found.where((F.col("n") >= least) & (F.col("n_drop") / F.col("n") < share)).withColumn("tag", F.when(F.col("n_main") * 2 >= F.col("n"), main).otherwise("other"))


def messages(df: DataFrame, key: str, order: str, role: str = "role", text: str = "text", roles: dict[str, str] = ROLES) -> DataFrame:
    """One row for each conversation with its turns of known roles and some text, in order; conversations without any go."""
    named = F.lit(None).cast("string")
    for k, v in roles.items():
        named = F.when(F.col(role) == k, v).otherwise(named)
    turns = df.select(key, order, named.alias("role"), T.strip(F.col(text)).alias("content")).where(F.col("role").isNotNull() & (F.col("content") != ""))
    whole = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "content"))).alias("m"))
    return whole.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def first_of(messages: Column, role: str) -> Column:
    """The content of the first turn of a role; null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]


def turns(messages: Column, *roles: str) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"].isin(*roles))).cast("long")


def markup(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"], F.lit("<|end|>"))), "")


def exchange(question: Column, answer: Column) -> Column:
    """A conversation of one question and one answer."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", question), turn("assistant", answer)).cast(MESSAGES)


def best_paths(nodes: DataFrame) -> DataFrame:
    """From a forest of messages (id, parent, rank, text; a root has no parent) each root's path of least-ranked children (nulls last, then id).

    Children are ranked first, so a level is one join of the paths' ends with the chosen child of each parent.
    """
    chosen = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct(F.col("rank").isNull().alias("no"), F.coalesce("rank", F.lit(0)).alias("rank"), "id", "text")).alias("c"))
    chosen = chosen.select(F.col("parent").alias("end"), F.col("c.id").alias("child"), F.col("c.text").alias("child_text"))
    paths = nodes.where("parent IS NULL").select(F.col("id").alias("root"), F.col("id").alias("end"), F.lit(0).alias("depth"), F.array("text").alias("path"))
    done = None
    while True:  # as often as the longest path has levels; nodes have one parent, so paths from roots end
        grown = paths.join(chosen, "end", "left")
        ended = grown.where("child IS NULL").select("root", "end", "depth", "path")
        done = ended if done is None else done.union(ended)
        paths = grown.where("child IS NOT NULL").select("root", F.col("child").alias("end"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child_text")).alias("path")).checkpoint()
        if paths.isEmpty():
            return done
