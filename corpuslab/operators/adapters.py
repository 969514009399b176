"""Adapters of instruction sets to conversations, prompts, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structure import exchange

#: Role names of other formats.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system"}


def share_gpt(turns: Column, role: str = "from", text: str = "value") -> Column:
    """An array of turns in that format as messages; turns of other roles and empty ones go."""
    named = lambda t: F.try_element_at(F.create_map(*(F.lit(x) for p in ROLES.items() for x in p)), t[role])
    out = F.transform(turns, lambda t: F.struct(named(t).alias("role"), F.trim(t[text]).alias("content")))
    return F.filter(out, lambda m: m["role"].isNotNull() & (m["content"] != ""))


def alpaca(df: DataFrame) -> DataFrame:
    question = F.when(F.coalesce(F.col("input"), F.lit("")) != "", F.concat("instruction", F.lit("\n\n"), "input")).otherwise(F.col("instruction"))
    return df.select("id", exchange(question, F.col("output")).alias("messages"))


def dolly(df: DataFrame) -> DataFrame:
    question = F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.concat("instruction", F.lit("\n\nContext: "), "context")).otherwise(F.col("instruction"))
    return df.select("id", exchange(question, F.col("response")).alias("messages"))


def prompt_response(df: DataFrame) -> DataFrame:
    return df.select("id", exchange(F.col("prompt"), F.col("response")).alias("messages"))


def json_messages(df: DataFrame) -> DataFrame:
    return df.select("id", share_gpt(F.from_json("messages", "array<struct<role:string,content:string>>"), "role", "content").alias("messages"))


def conversations(df: DataFrame) -> DataFrame:
    return df.select("id", share_gpt(F.col("conversations")).alias("messages"))


#: Format -> function of a DataFrame to (id, messages).
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"alpaca": alpaca, "dolly": dolly, "prompt_response": prompt_response, "json": json_messages, "sharegpt": conversations}


def adapted(df: DataFrame, kind: str) -> DataFrame:
    """(id, source, messages) of a set in a registered format, without conversations that lack an answer."""
    out = ADAPTERS[kind](df)
    return out.where(F.exists("messages", lambda m: m["role"] == "assistant")).select("id", F.lit(kind).alias("source"), "messages")


def instruction_prompt(instruction: Column, answer: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"), answer)


def question_prompt(passage: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Context: "), passage, F.lit("\nQuestion: "), question, F.lit("\nAnswer: "), answer)


def choice_prompt(question: Column, choices: Column, answer: Column) -> Column:
    """Choices as lettered lines; ``answer`` counts from 0."""
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(") "), c)), "\n")
    return F.concat(question, F.lit("\n"), lines, F.lit("\nAnswer: "), F.char(answer + 65))
