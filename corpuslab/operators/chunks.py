"""Long texts in chunks, spans of ids masked for reconstruction, and words cut into stem and suffixes.

Null and empty texts have no chunks; null ids are empty. All rows are worked on by themselves, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SEPARATORS = ("\n\n", "\n", ". ")
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")


def _packed(parts: list[str], separator: str, most: int, size: Callable[[str], int] = len) -> Iterator[str]:
    """Neighbours joined while their sizes, with a separator after each, stay within ``most``."""
    ends = np.cumsum([size(p) + len(separator) * (size is len) for p in parts])
    start = 0
    while start < len(parts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield separator.join(parts[start:stop]).strip()
        start = stop


def fitted(text: str, most: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """``text`` in chunks of about ``most`` characters, cut at the first separators that make them fit, or else hard."""
    if len(text) <= most:
        return [text]
    if not separators:
        return [text[i : i + most] for i in range(0, len(text), most)]
    return [x for chunk in _packed(text.split(separators[0]), separators[0], most) for x in fitted(chunk, most, separators[1:])]


def windows(text: str, most: int) -> list[str]:
    """Stripped windows of at most ``most`` characters, which end after a line or else a word that ends in their last half."""
    text, out, at = text.strip(), [], 0
    while len(text) - at > most:
        half, stop = at + most // 2, at + most
        cut = max(text.rfind("\n", half, stop), at) or at
        cut = cut if cut > at else text.rfind(" ", half, stop)
        stop = cut + 1 if cut > at else stop
        out.append(text[at:stop].strip())
        at = stop
    return [x for x in (*out, text[at:].strip()) if x]


def sentence_chunks(text: str, most: int) -> list[str]:
    """Sentences joined up to ``most`` words; a longer sentence is cut by words."""
    parts = []
    for sentence in SENTENCE_END.split(text.strip()):
        words = sentence.split()
        parts += [sentence] if len(words) <= most else [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
    return [x for x in _packed(parts, " ", most, lambda s: len(s.split())) if x]


def _of_texts(f: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    @F.pandas_udf(ArrayType(StringType()))
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([f(t) if t else [] for t in column], dtype=object)

    return run


def chunked(df: DataFrame, text: str = "text", *, most: int = 20_000, least: int = 50, by: str = "separators") -> DataFrame:
    """A row for each chunk of ``text``, in place of it, with its place ``chunk`` (from 0). ``by``: separators, windows or sentences.

    By separators, chunks under ``least`` characters are dropped if their text was cut. ``most`` are words for sentences.
    """
    ways = {
        "separators": lambda t: [t] if len(t) <= most else [c for c in fitted(t, most) if len(c) >= least],
        "windows": lambda t: windows(t, most),
        "sentences": lambda t: sentence_chunks(t, most),
    }
    others = [c for c in df.columns if c not in (text, "chunk")]
    return df.select(*others, F.posexplode(_of_texts(ways[by])(F.col(text))).alias("chunk", text))


def corrupted(df: DataFrame, key: str, ids: str, sentinels: list[int], *, share: float = 0.15, mean: float = 3.0, seed: int = 0) -> DataFrame:
    """``df`` with ``inputs`` (spans of ``ids`` replaced by sentinels) and ``targets`` (each sentinel and its span, then the next sentinel).

    The spans are drawn from ``seed`` and the row's key alone. Fewer than two ids are not masked.
    """

    def one(row_key: object, values: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(values)
        if n < 2:
            return [int(v) for v in values], sentinels[:1]
        draw = np.random.default_rng([seed, *str(row_key).encode()])
        masked = min(max(round(n * share), 1), n - 1)
        spans = min(max(round(masked / mean), 1), masked, len(sentinels))
        # Cut points without repeats: each span and each gap but the outer ones has an id, so spans never touch.
        spans = min(spans, n - masked + 1)
        inner = np.sort(draw.choice(np.arange(1, masked), spans - 1, replace=False)) if spans > 1 else np.empty(0, int)
        long = np.diff(np.concatenate([[0], inner, [masked]]))
        cuts = np.sort(draw.choice(n - masked + 1, spans, replace=False))
        starts = cuts + np.cumsum(long) - long
        inputs, targets, at = [], [], 0
        for mark, a, b in zip(sentinels, starts.tolist(), (starts + long).tolist(), strict=False):
            inputs += [*values[at:a], mark]
            targets += [mark, *values[a:b]]
            at = b
        return [int(v) for v in (*inputs, *values[at:])], [int(v) for v in (*targets, *sentinels[spans : spans + 1])]

    @F.pandas_udf("inputs array<bigint>, targets array<bigint>")
    def run(keys: pd.Series, lists: pd.Series) -> pd.DataFrame:
        found = [one(k, () if v is None else v) for k, v in zip(keys, lists, strict=True)]
        return pd.DataFrame({"inputs": [a for a, _ in found], "targets": [b for _, b in found]})

    rest = [c for c in df.columns if c not in ("inputs", "targets")]
    return df.select(*rest, run(F.col(key).cast("string"), F.col(ids)).alias("_c")).select(*rest, "_c.inputs", "_c.targets")


def stem_pattern(suffixes: list[str], least: int = 4) -> str:
    """Group 1 is what the longest fitting suffix leaves of a word."""
    return rf"(?i)^(.{{{least},}}?)(?:{'|'.join(map(re.escape, suffixes))})$"


def with_stem(df: DataFrame, word: str, suffixes: list[str], *, layers: int = 4, least: int = 4) -> DataFrame:
    """``df`` with ``stem``: ``word`` without at most ``layers`` suffixes, the longest first; ``least`` characters stay."""
    df, pattern = df.withColumn("stem", F.col(word)), stem_pattern(suffixes, least)
    for _ in range(layers):
        df = df.withColumn("stem", F.coalesce(F.nullif(F.regexp_extract("stem", pattern, 1), F.lit("")), F.col("stem")))
    return df


def error_class(source: Column, target: Column) -> Column:
    """identity, word_order, mixed (other number of words), morphology (same lengths, at most three characters differ a word), else orthography."""
    a, b = (F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "") for x in (source, target))
    differing = lambda x, y: F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p != q), lambda d: d))
    small = F.forall(F.zip_with(a, b, lambda x, y: (F.length(x) == F.length(y)) & (differing(x, y) <= 3)), lambda ok: ok)
    return (
        F.when(source.isNull() | target.isNull(), None)
        .when(F.array_join(a, " ") == F.array_join(b, " "), "identity")
        .when(F.sort_array(a) == F.sort_array(b), "word_order")
        .when(F.size(a) != F.size(b), "mixed")
        .when(small, "morphology")
        .otherwise("orthography")
    )
