"""Text functions of built-in Spark functions only; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
#: What counts as a link, a tag, an address.
URL, TAG, EMAIL = r"(?i)https?://\S+", r"<[^>]{1,200}>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """Without control characters; runs of blanks as one space, of three line ends or more as two; stripped."""
    text = F.regexp_replace(text, CONTROL, "")
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def collapse(text: Column) -> Column:
    """All white space (Unicode's) as single spaces, control characters dropped, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+", " "), r"[\x00-\x1f]", ""))


def without_links(text: Column) -> Column:
    """URLs, e-mail addresses and tags deleted."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, URL, ""), EMAIL, ""), TAG, "")


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters: up to the last blank line among them, else the last line end, else all; without trailing space."""
    head = F.substring(text, 1, most)
    at_break = lambda sep: F.when(F.instr(head, sep) > 0, F.substring_index(head, sep, -1))
    cut = lambda sep: F.substring(head, F.lit(1), F.length(head) - F.length(at_break(sep)) - F.length(F.lit(sep)))
    cut_text = F.when(F.instr(head, "\n\n") > 1, cut("\n\n")).when(F.instr(head, "\n") > 1, cut("\n")).otherwise(head)
    return F.regexp_replace(F.when(F.length(text) > most, cut_text).otherwise(text), r"\s+$", "")


def plain_speech(text: Column) -> Column:
    """For speech scores: lower case, punctuation and symbols as spaces, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", " "), r"\s+", " "))


def clean_line(text: Column) -> Column:
    """A model's answer line without label, bold marks and remarks in parentheses."""
    text = F.regexp_replace(text, r"^\s*(?:[-*\x{2022}]|\d+[.)])\s*", "")
    text = F.regexp_replace(text, r"^\s*[\p{L} ]{1,20}:\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(text, r"\*\*([^*]*)\*\*", "$1"), r"\([^)]*\)", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"))


def word_count(text: Column) -> Column:
    return count(text, r"\S+")


def share(part: Column, whole: Column) -> Column:
    """``part`` of ``whole``, 0 of nothing."""
    return part / F.greatest(whole, F.lit(1))


def special_ratio(text: Column) -> Column:
    """Characters that are neither letters, numbers nor white space, of all."""
    return share(count(text, r"[^\p{L}\p{N}\s]"), F.length(text))


def url_density(text: Column) -> Column:
    """URLs for each thousand characters."""
    return count(text, URL) * 1000 / F.greatest(F.length(text), F.lit(1))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, computed once: Spark computes what a lambda names anew for each item."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """Runs of ``n`` items of an array, joined; none of a shorter array."""

    def runs(items: Column) -> Column:
        last = F.size(items) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(items, i, n), sep))).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def repeated_ngrams(text: Column, n: int) -> Column:
    """Of the word ``n``-grams of a text: how many occur more than once (``repeated``), and how many there are (``total``). A text of fewer words has none."""

    def counted(h: Column) -> Column:
        twice = F.filter(h, lambda x, i: (x == F.get(h, i - 1)) | (x == F.get(h, i + 1)))
        return F.struct(F.size(twice).alias("repeated"), F.size(h).alias("total"))

    hashes = F.array_sort(F.transform(ngrams(words(text), n), lambda g: F.xxhash64(g)))
    return let(hashes, counted)


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; none of a shorter text."""
    return F.array_distinct(ngrams(F.filter(F.split(text, ""), lambda c: c != ""), n, ""))


def overlap(a: Column, b: Column) -> Column:
    """The share of the distinct items of ``a`` that ``b`` has."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def first_reason(gates: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """The name of the first gate whose condition holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(gates):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out
