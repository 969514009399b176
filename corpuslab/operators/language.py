"""Language identification and perplexity: operators that take a predictor, and deterministic predictors where none is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A predictor makes a struct (lang string, confidence double) of a text.
Predictor = Callable[[Column], Column]

#: Fixed values of the default predictor: frequent short words by language.
STOP_WORDS = {
    "de": ("das", "den", "der", "die", "ein", "eine", "er", "es", "in", "ist", "mit", "nicht", "und", "zu"),
    "en": ("and", "are", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was", "with"),
    "es": ("con", "de", "el", "en", "es", "la", "las", "los", "por", "que", "un", "una", "y"),
    "fr": ("dans", "de", "des", "du", "est", "et", "la", "le", "les", "que", "qui", "un", "une"),
}


def stop_word_shares(text: Column, words: dict[str, tuple[str, ...]] = STOP_WORDS) -> Column:
    """By language the share of a text's words (runs of letters, in lower case) that are among its frequent ones."""

    def hits(own: Column, known: tuple[str, ...]) -> Column:
        return F.size(F.filter(own, lambda w: w.isin(*known)))

    def shares(own: Column) -> Column:
        return F.struct(*((hits(own, v) / F.greatest(F.size(own), F.lit(1))).alias(k) for k, v in sorted(words.items())))

    return T.let(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)")), shares)


def stop_word_language(text: Column, words: dict[str, tuple[str, ...]] = STOP_WORDS) -> Column:
    """The language of the greatest share, of equal ones the first by name, and as confidence its share of all shares; ``unk`` and 0 without any."""

    def best(s: Column) -> Column:
        names = sorted(words)
        top, total = F.greatest(*(s[k] for k in names)), sum((s[k] for k in names[1:]), s[names[0]])
        lang = F.lit("unk")
        for k in reversed(names):
            lang = F.when((s[k] == top) & (top > 0), F.lit(k)).otherwise(lang)
        return F.struct(lang.alias("lang"), F.when(top > 0, top / total).otherwise(F.lit(0.0)).alias("confidence"))

    return T.let(stop_word_shares(text, words), best)


def _flat(text: Column, most: int) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, most)


def identified(text: Column, predict: Predictor = stop_word_language, *, most: int = 5000) -> Column:
    """What ``predict`` says of the first ``most`` characters, line ends as spaces."""
    return predict(_flat(text, most))


def identified_short(text: Column, predict: Predictor = stop_word_language, *, most: int = 500, least: int = 5) -> Column:
    """The same of the first ``most`` characters, confidence to three places; ``unk`` and 0 for fewer than ``least`` characters but white space."""
    found = predict(_flat(text, most))
    short = F.length(T.strip(text)) < least
    return T.let(found, lambda x: F.struct(F.when(short, F.lit("unk")).otherwise(x["lang"]).alias("lang"), F.when(short, F.lit(0.0)).otherwise(F.round(x["confidence"], 3)).alias("confidence")))


def identified_or_null(text: Column, predict: Predictor = stop_word_language, *, most: int = 2000, least: int = 20) -> Column:
    """The same of the first ``most`` characters; null for fewer than ``least`` of them but white space."""
    return F.when(F.length(T.strip(text)) >= least, predict(_flat(text, most)))


def leads(found: Column, wanted: str, others: tuple[str, ...], least: float = 0.5, gap: float = 0.1) -> Column:
    """Whether the share of ``wanted`` (a struct of shares by language) is ``least`` or more of all, and ``gap`` above each of ``others``."""
    names = sorted(STOP_WORDS)
    total = F.greatest(sum((found[k] for k in names[1:]), found[names[0]]), F.lit(1e-9))
    out = found[wanted] / total >= least
    for k in others:
        out = out & ((found[wanted] - found[k]) / total >= gap)
    return out


def unigram_model(docs: DataFrame, tokens: Column) -> DataFrame:
    """token and its negative log-likelihood with one added to each count; one more token stands for all others."""
    counts = docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg((F.sum("n") + F.count("*") + 1).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("token", (F.log("total") - F.log(F.col("n") + 1)).alias("nll"))


def perplexity(docs: DataFrame, key: str, tokens: Column, model: DataFrame, *, most: int = 256, clamp: float = 20.0) -> DataFrame:
    """key, n (tokens scored), nll (their sum) and ppl of the first ``most`` tokens of each row: exp of the mean, at most ``clamp``; infinite without tokens.

    ``model`` has token and nll. A row's tokens are counted before they are joined, so a frequent token is one row a document.
    """
    first = docs.select(key, F.explode(F.slice(tokens, 1, most)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    scored = first.join(model, "token").groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("nll")).alias("nll"))
    mean = F.least(F.col("nll") / F.col("n"), F.lit(clamp))
    out = docs.select(key).join(scored, key, "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("nll", F.lit(0.0)).alias("nll"), F.when(F.col("n") > 0, F.exp(mean)).otherwise(F.lit(float("inf"))).alias("ppl"))


def bits_per_byte(nll: Column, size: Column) -> Column:
    """Of a sum of negative log-likelihoods over a text of ``size`` bytes; null of nothing."""
    return F.when(size > 0, nll / (size * F.lit(0.6931471805599453)))


def fertility(docs: DataFrame, by: str, text: str, tokens: Column) -> DataFrame:
    """By group: tokens for each word, characters and bytes for each token."""
    n = F.sum(F.size(tokens))
    words, chars, size = (F.sum(c) for c in (T.word_count(F.col(text)), F.length(text), F.octet_length(text)))
    return docs.groupBy(by).agg((n / words).alias("tokens_per_word"), (chars / n).alias("chars_per_token"), (size / n).alias("bytes_per_token"))


def boundary_match(pieces: Column, morphemes: Column) -> Column:
    """Of the inner boundaries between morphemes, the share that is one between pieces too; null without an inner boundary."""
    ends = lambda parts: F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda t, p: t + F.length(p)))
    inner = lambda parts: F.slice(ends(parts), F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return T.let(F.struct(inner(pieces).alias("a"), inner(morphemes).alias("b")), lambda x: F.when(F.size(x["b"]) > 0, F.size(F.array_intersect(x["a"], x["b"])) / F.size(x["b"])))


def document_filter(docs: DataFrame, key: str, text: str, *, least: int = 50, languages: tuple[str, ...] = ("en",), predict: Predictor = stop_word_language, near: DataFrame | None = None) -> DataFrame:
    """``docs`` with a reason: too_short, duplicate (not the least ``key`` of its text among those long enough), language, near_duplicate (ids in the one column of ``near``), or ok."""
    rows = docs.withColumn("_h", F.md5(F.col(text)))
    first = rows.where(F.length(text) >= least).groupBy("_h").agg(F.min(key).alias("_first"))
    rows = rows.join(first, "_h", "left")
    gates = [("too_short", F.coalesce(F.length(text), F.lit(0)) < least), ("duplicate", F.col(key) != F.col("_first")), ("language", ~identified(F.col(text), predict)["lang"].isin(*languages))]
    if near is not None:
        rows = rows.join(near.toDF("_near").distinct(), F.col(key) == F.col("_near"), "left")
        gates.append(("near_duplicate", F.col("_near").isNotNull()))
    return rows.withColumn("reason", T.first_reason(gates)).select(*docs.columns, "reason")


def largest_first(df: DataFrame, size: Column) -> DataFrame:
    """Each partition in order of size, so that batches of a model need little padding."""
    return df.sortWithinPartitions(size.desc())


def running(df: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """``df`` with how many rows of its group up to it have ``flag``."""
    return df.withColumn("so_far", F.sum(flag.cast("long")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
