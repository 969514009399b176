"""Scores and tags of word sequences, over Arrow batches."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import _each, _edits


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of the words of two texts; word errors are this by the reference's word count."""

    def distance(s: str, t: str) -> int:
        x, y = s.split(), t.split()
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
        return row[-1]

    @F.arrow_udf("bigint")
    def found(x: pa.Array, y: pa.Array) -> pa.Array:
        return _each(distance, pa.int64(), x, y)

    return found(a, b)


def ngram_overlap(hypothesis: Column, reference: Column, most: int = 4) -> Column:
    """The mean over n up to ``most`` of the clipped share of n-grams that both have, of the longer side's; sizes that neither has don't count."""

    def score(h: str, r: str) -> float:
        x, y, shares = h.split(), r.split(), []
        for n in range(1, most + 1):
            a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (x, y))
            if a or b:
                shares.append((a & b).total() / max(a.total(), b.total()))
        return sum(shares) / len(shares) if shares else 1.0

    @F.arrow_udf("double")
    def found(x: pa.Array, y: pa.Array) -> pa.Array:
        return _each(score, pa.float64(), x, y)

    return found(hypothesis, reference)


def _tags(source: list[str], target: list[str]) -> list[str]:
    """A tag for the start and each word of the source: keep or delete it, and then append words."""
    kept, after = ["$KEEP"] * (len(source) + 1), [[] for _ in range(len(source) + 1)]
    for e in _edits(source, target):
        if e["op"] == "delete":
            kept[e["at"] + 1] = "$DELETE"
        else:
            after[e["at"]].append(e["word"])
    return [" ".join([k, *(f"$APPEND_{w}" for w in words)]) for k, words in zip(kept, after, strict=True)]


def edit_tags(source: Column, target: Column) -> Column:
    @F.arrow_udf("array<string>")
    def found(x: pa.Array, y: pa.Array) -> pa.Array:
        return _each(lambda s, t: _tags(s.split(), t.split()), pa.list_(pa.string()), x, y)

    return found(source, target)


def apply_tags(source: Column, tags: Column) -> Column:
    """The text that :func:`edit_tags` make of the source's words; built-in functions only."""
    words = F.concat(F.array(F.lit("")), F.regexp_extract_all(source, F.lit(r"(\S+)")))

    def changed(word: Column, tag: Column) -> Column:
        added = F.transform(F.regexp_extract_all(tag, F.lit(r"\$APPEND_(\S+)"), F.lit(1)), lambda w: w)
        return F.concat(F.when(tag.startswith("$DELETE") | (word == ""), F.array().cast("array<string>")).otherwise(F.array(word)), added)

    return F.array_join(F.flatten(F.zip_with(words, tags, changed)), " ")
