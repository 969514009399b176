"""Gate cascades: one pass names the first gate that a row fails; funnels count rows by gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..profile import LanguageProfile


@dataclass(frozen=True)
class Gate:
    name: str
    #: Holds for rows to reject; null counts as not rejected.
    rejects: Column


def cascade(df: DataFrame, gates: list[Gate], reason: str = "reason") -> DataFrame:
    """``df`` with the name of the first gate that rejects a row, else ``ok``. Built-in functions only, so evaluation stops there."""
    return df.withColumn(reason, T.first_reason([(g.name, g.rejects) for g in gates]))


def text_cascade(df: DataFrame, text: Column, gates: Callable[[Column], list[Gate]], reason: str = "reason", name: str = "text") -> DataFrame:
    """``df`` with ``text`` as column ``name`` and the first gate that rejects it. The text is computed once, however many gates name it."""
    both = T.let(text, lambda t: F.struct(t.alias(name), T.first_reason([(g.name, g.rejects) for g in gates(t)]).alias(reason)))
    columns = [c for c in df.columns if c not in (name, reason)]
    return df.select(*columns, F.inline(F.array(both)).alias(name, reason))


def funnel(df: DataFrame, by: str | None = None, reason: str = "reason") -> DataFrame:
    """Rows by reason (and ``by``)."""
    return df.groupBy(*([by] if by else []), reason).agg(F.count("*").alias("n"))


def clean_gates(text: Column, p: LanguageProfile) -> list[Gate]:
    """Length, words, distinctive letters, special characters."""
    return [
        Gate("empty", F.length(text) == 0),
        Gate("too_short", F.length(text) < p.min_chars),
        Gate("too_few_words", T.word_count(text) < p.min_words),
        Gate("no_alphabet", ~text.rlike(f"[{p.distinctive}]")),
        Gate("special", T.special_ratio(text) > p.max_special),
    ]


def junk_gates(text: Column, p: LanguageProfile) -> list[Gate]:
    """Links, tags, special characters, boilerplate, underscores: each with its own sub-reason."""
    return [
        Gate("junk:urls", T.url_density(text) > p.max_urls_per_1000),
        Gate("junk:tags", T.count(text, T.TAG) > p.max_tags),
        Gate("junk:special", T.special_ratio(text) > p.max_special),
        *(Gate(f"junk:{w}", F.lower(text).contains(w)) for w in p.boilerplate),
        Gate("junk:underscores", text.rlike("_{5,}")),
    ]


def script_gates(text: Column, p: LanguageProfile) -> list[Gate]:
    visible = T.count(text, r"\S")
    own = T.count(text, f"[{p.script}]")
    letters = T.count(text, r"\p{L}")
    return [Gate("script", (T.share(own, visible) < p.min_script) | (T.share(letters - own, visible) > p.max_other_script))]


def collect_gates(text: Column) -> list[Gate]:
    return [Gate("too_short", F.length(text) < 50), Gate("urls", T.url_density(text) > 5), Gate("tags", T.count(text, T.TAG) > 5)]


#: Named Unicode blocks whose characters count as foreign.
FOREIGN = {"greek": r"\x{0370}-\x{03FF}", "hebrew": r"\x{0590}-\x{05FF}", "arabic": r"\x{0600}-\x{06FF}", "devanagari": r"\x{0900}-\x{097F}", "thai": r"\x{0E00}-\x{0E7F}", "georgian": r"\x{10A0}-\x{10FF}", "hangul": r"\x{AC00}-\x{D7AF}", "kana": r"\x{3040}-\x{30FF}", "han": r"\x{4E00}-\x{9FFF}"}


def top_char(text: Column) -> tuple[Column, Column]:
    """Shares of the most frequent and of the distinct characters among those that aren't white space; nulls for 20 or fewer."""
    # Characters of a text repeat, so distinct ones are few and each is counted by what its removal leaves.
    bare = F.regexp_replace(text, r"\s", "")
    distinct = lambda x: F.filter(F.array_distinct(F.split(x, "")), lambda c: c != "")
    most = T.let(bare, lambda x: F.array_max(F.transform(distinct(x), lambda c: F.length(x) - F.length(F.replace(x, c, F.lit(""))))))
    many = F.length(bare) > 20
    return F.when(many, most / F.length(bare)), F.when(many, F.size(distinct(bare)) / F.length(bare))


def foreign_gates(text: Column, p: LanguageProfile) -> list[Gate]:
    foreign = T.count(text, f"[{''.join(FOREIGN.values())}]")
    visible = T.count(text, r"\S")
    top, unique = top_char(text)
    marks = T.count(text, r"\?")
    return [
        Gate("empty", F.length(T.strip(text)) < 10),
        Gate("top_char", top > p.max_top_char),
        Gate("unique_chars", unique < 0.05),
        Gate("replacement", T.count(text, r"\x{FFFD}") >= 3),
        Gate("broken", T.count(text, r"\p{L}\?\p{L}") >= 2),
        Gate("question_marks", (marks >= 5) & (T.share(marks, visible) >= 0.08)),
        Gate("foreign", (foreign >= 3) & (T.share(foreign, visible) >= 0.005)),
        Gate("useful", T.share(T.count(text, f"[{p.script}0-9.,!?;:()-]"), visible) < 0.70),
    ]


def keep_all_columns(passes: list[Column]) -> Column:
    """A row passes if each of its columns that isn't empty does."""
    out = F.lit(True)
    for p in passes:
        out = out & F.coalesce(p, F.lit(True))
    return out


def seed_sentence(text: Column, words: tuple[int, int] = (6, 30), junk: tuple[str, ...] = ("http", "www", "@", "|")) -> Column:
    """As many words, an upper-case start, a sentence end, no junk, and digits up to a tenth (or three)."""
    n = T.word_count(text)
    return (n >= words[0]) & (n <= words[1]) & text.rlike(r"^\p{Lu}") & text.rlike(r"[.!?]$") & ~text.rlike("|".join(f"\\Q{j}\\E" for j in junk)) & (T.count(text, "[0-9]") <= F.greatest(F.lit(3.0), F.length(text) * 0.1))


def repetition(text: Column, n: int = 10) -> Column:
    """The share of a text's word ``n``-grams that occur more than once; 0 of fewer words."""
    return T.let(T.repeated_ngrams(text, n), lambda x: T.share(x["repeated"], x["total"]))


def gzip_below_hundred(text: Column) -> Column:
    """Compressed size by size, and 0 of under a hundred bytes: so short texts count as repetitive."""
    from ..functions.arrow import gzip_ratio

    return F.when(F.octet_length(text) < 100, F.lit(0.0)).otherwise(gzip_ratio(text))


def whole_cascade(text: Column, p: LanguageProfile, *, language: Column | None = None, repeated: bool = True) -> list[Gate]:
    """The corpus cascade: length, words, alphabet, script, language (a condition to reject), junk with sub-reasons, repetition."""
    first, rest = clean_gates(text, p)[:4], [Gate("language", language)] if language is not None else []
    again = [Gate("repetition", repetition(text) >= p.max_repeated)] if repeated else []
    return [*first, *script_gates(text, p), *rest, *junk_gates(text, p), *again]


def bilingual_gates(text: Column, p: LanguageProfile, language: Column | None = None) -> list[Gate]:
    """For either side of a pair, after links and tags are gone: length, script, language (a condition to reject)."""
    return [Gate("too_short", F.length(text) < 50), script_gates(text, p)[0], *([Gate("language", language)] if language is not None else [])]


def cut(text: Column, most: int = 500_000) -> Column:
    """At most ``most`` characters; longer texts are cut and not dropped."""
    return F.substring(text, 1, most)


def balanced_gates(df: DataFrame, text: str, p: LanguageProfile, *, lang: str = "predicted_language", wanted: str = "kaz", flag: str = "contains_kaz_symbols") -> list[Gate]:
    """Length, and as far as ``df`` has the columns the predicted language and a flag; then the alphabet."""
    gates = [Gate("too_short", F.length(text) < 30)]
    if lang in df.columns:
        gates.append(Gate("language", ~F.col(lang).eqNullSafe(wanted)))
    if flag in df.columns:
        gates.append(Gate("flag", ~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))))
    return [*gates, Gate("no_alphabet", ~F.col(text).rlike(f"[{p.distinctive}]"))]


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Those of ``words`` that stand in the text, in any case, with no letter beside them."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.rlike(text, F.concat(F.lit(r"(?i)(?:^|[^\p{L}])"), w, F.lit(r"(?:$|[^\p{L}])"))))


def instruction_skipped(text: Column, words: tuple[str, ...]) -> Column:
    """Under three words, or one of ``words`` anywhere in it, in any case."""
    return (T.word_count(text) < 3) | F.lower(text).rlike("|".join(f"\\Q{w.lower()}\\E" for w in words))


def script_ratio(text: Column, script: str) -> Column:
    """Letters of the script, of all letters; 0 without letters."""
    return T.share(T.count(text, f"[{script}]"), T.count(text, r"\p{L}"))


def seed_variant(text: Column, *, words: tuple[int, int] = (8, 40), digits: float | None = None, endings: tuple[str, ...] = ()) -> Column:
    """A seed sentence of as many words; with ``digits`` at most that share of its characters, with ``endings`` a word that ends so."""
    n = T.word_count(text)
    out = (n >= words[0]) & (n <= words[1]) & text.rlike(r"^\p{Lu}") & text.rlike(r"[.!?]$")
    if digits is not None:
        out = out & (T.share(T.count(text, "[0-9]"), F.length(text)) <= digits)
    if endings:
        out = out & text.rlike(rf"(?:{'|'.join(endings)})(?:[^\p{{L}}]|$)")
    return out


def first_line(text: Column, passes: Callable[[Column], Column]) -> Column:
    """The first line, cleaned of labels and marks, for which ``passes`` holds; else null."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), T.clean_line), passes), 0)


def all_reasons(gates: list[Gate]) -> Column:
    """The names of all gates that reject a row."""
    return F.filter(F.array(*(F.when(g.rejects, F.lit(g.name)) for g in gates)), lambda x: x.isNotNull())
