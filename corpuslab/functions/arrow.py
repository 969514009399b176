"""Functions that Spark has no built-in for, over Arrow batches."""

from __future__ import annotations

import difflib
import gzip
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(function, kind: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """``function`` of each row, null where an argument is null."""
    return pa.array([None if any(v is None for v in row) else function(*row) for row in zip(*(a.to_pylist() for a in arrays), strict=True)], kind)


def unicode_form(text: Column, form: str = "NFC") -> Column:
    @F.arrow_udf("string")
    def normalised(column: pa.Array) -> pa.Array:
        return _each(lambda t: t if t.isascii() else unicodedata.normalize(form, t), pa.string(), column)

    return normalised(text)


def gzip_ratio(text: Column) -> Column:
    """Compressed size of the whole text (level 6) by its size in bytes; 1 of an empty text."""

    @F.arrow_udf("double")
    def ratio(column: pa.Array) -> pa.Array:
        return _each(lambda t: len(gzip.compress(t.encode(), 6)) / len(t.encode()) if t else 1.0, pa.float64(), column)

    return ratio(text)


def likeness(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's similarity, on what the cheaper bounds leave open: equal texts are 1, texts of very different length their ratio, of few common characters 0.8 of those."""

    @F.arrow_udf("double")
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return _each(lambda s, t: difflib.SequenceMatcher(None, s, t).ratio(), pa.float64(), x, y)

    low_a, low_b = F.lower(a), F.lower(b)
    length = F.least(F.length(low_a), F.length(low_b)) / F.greatest(F.length(low_a), F.length(low_b), F.lit(1))
    set_a, set_b = (F.array_distinct(F.split(x, "")) for x in (low_a, low_b))
    common = F.size(F.array_intersect(set_a, set_b)) / F.greatest(F.size(F.array_union(set_a, set_b)), F.lit(1))
    near = (low_a != low_b) & (length >= 0.5) & (common >= 0.5)
    return F.when(low_a == low_b, F.lit(1.0)).when(length < 0.5, length).when(common < 0.5, common * 0.8).otherwise(ratio(F.when(near, low_a), F.when(near, low_b)))


def _edits(source: list[str], target: list[str]) -> list[dict]:
    """Deletions and insertions of words that turn ``source`` into ``target``, by a longest common subsequence."""
    table = [[0] * (len(target) + 1) for _ in range(len(source) + 1)]
    for i in range(len(source) - 1, -1, -1):
        for j in range(len(target) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if source[i] == target[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(source) or j < len(target):
        if i < len(source) and j < len(target) and source[i] == target[j]:
            i, j = i + 1, j + 1
        elif j == len(target) or (i < len(source) and table[i + 1][j] >= table[i][j + 1]):
            out.append({"op": "delete", "at": i, "word": source[i]})
            i += 1
        else:
            out.append({"op": "insert", "at": i, "word": target[j]})
            j += 1
    return out


EDITS = "array<struct<op:string,at:int,word:string>>"


def word_edits(source: Column, target: Column) -> Column:
    @F.arrow_udf(EDITS)
    def edits(a: pa.Array, b: pa.Array) -> pa.Array:
        return _each(lambda s, t: _edits(s.split(), t.split()), pa.list_(pa.struct([("op", pa.string()), ("at", pa.int32()), ("word", pa.string())])), a, b)

    return edits(source, target)


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _number_words(n: int) -> str:
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10 - 2] + (f" {_ONES[n % 10]}" if n % 10 else "")
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{_number_words(n // size)} {name}" + (f" {_number_words(n % size)}" if n % size else "")
    raise AssertionError


def spoken(text: Column) -> Column:
    """Typographic quotes and dashes as plain ones, and whole numbers of up to twelve digits as words."""
    import re

    @F.arrow_udf("string")
    def worded(column: pa.Array) -> pa.Array:
        return _each(lambda t: re.sub(r"\d{1,12}", lambda m: _number_words(int(m[0])), t, flags=re.ASCII), pa.string(), column)

    plain = F.translate(text, "“”„«»’‘–—", "\"\"\"\"\"''--")
    return F.when(plain.rlike("[0-9]"), worded(F.when(plain.rlike("[0-9]"), plain))).otherwise(plain)
