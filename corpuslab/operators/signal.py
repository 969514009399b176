"""Quality of signals and transcripts, model ids, sentence records, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .pairs import noisy


def clip_fraction(signal: Column, limit: float = 0.99) -> Column:
    """The share of samples of that size or more; 0 of none."""
    return F.when(F.size(signal) > 0, F.size(F.filter(signal, lambda x: F.abs(x) >= limit)) / F.size(signal)).otherwise(0.0)


def snr(signal: Column, frame: int = 2048, share: float = 0.1, least: float = 1e-10) -> Column:
    """Decibels between the mean energies of frames above and up to ``share`` of the median energy; 0 of under two frames. Samples beyond the last whole frame don't count."""

    def energies(x: Column) -> Column:
        frames = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / frame).cast("int") - 1), lambda i: F.slice(x, i * frame + 1, F.lit(frame)))
        return F.transform(frames, lambda f: F.aggregate(f, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / frame)

    def mean(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)).otherwise(F.lit(least))

    def median(values: Column) -> Column:
        return T.let(F.array_sort(values), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)

    def ratio(e: Column, cut: Column) -> Column:
        return 10 * F.log10(mean(F.filter(e, lambda x: x > cut)) / F.greatest(mean(F.filter(e, lambda x: x <= cut)), F.lit(least)))

    whole = T.let(energies(signal), lambda e: T.let(F.struct(e.alias("e"), (median(e) * share).alias("c")), lambda x: ratio(x["e"], x["c"])))
    return F.when(F.size(signal) >= 2 * frame, whole).otherwise(F.lit(0.0))


def signal_gate(signal: Column, seconds: Column, *, frame: int = 2048, min_snr: float = 15.0, max_clipped: float = 0.001, length: tuple[float, float] = (1.0, 30.0)) -> Column:
    """Whether a signal is as long as it should be, clear and hardly clipped."""
    return seconds.between(*length) & (snr(signal, frame) >= min_snr) & (clip_fraction(signal) <= max_clipped)


def transcript_gate(lang: Column, confidence: Column, transcript: Column, languages: tuple[str, ...], letters: str, *, least: float = 0.5, chars: int = 20, share: float = 0.02) -> Column:
    """Whether a preview's language is accepted and sure, and its transcript is long enough and has enough of the language's own letters (of all letters)."""
    own = T.share(T.count(F.lower(transcript), f"[{letters}]"), T.count(transcript, r"\p{L}"))
    return lang.isin(*languages) & (confidence >= least) & (F.length(transcript) >= chars) & (own >= share)


def model_kind(model: Column, skipped: tuple[str, ...]) -> Column:
    """``skipped`` where an id holds one of these, ``variant`` where its last of three parts or more is a context size (as 8k) or mm, else ``model``."""
    parts = F.split(model, ":")
    tail = F.element_at(parts, -1)
    other = F.lower(model).rlike("|".join(f"\\Q{s.lower()}\\E" for s in skipped))
    return F.when(other, "skipped").when((F.size(parts) >= 3) & tail.rlike("^([0-9]+k|mm)$"), "variant").otherwise("model")


def sentence_records(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, para_idx, sent_idx (through the text), sentence, skipped, skip_reason, is_paragraph_break: an empty paragraph is a record that is skipped, as noisy sentences are."""
    marked = F.regexp_replace(T.strip(F.col("para")), r"([.!?])\s+([\p{Lu}\p{Nd}\"])", "$1\u0001$2")
    paragraphs = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("para_idx", "para"))
    parts = paragraphs.select(key, "para_idx", F.posexplode(F.transform(F.split(marked, "\u0001"), T.strip)).alias("_i", "sentence"))
    gap = F.col("sentence") == ""
    at = F.row_number().over(Window.partitionBy(key).orderBy("para_idx", "_i")) - 1  # within a document
    skipped = F.when(gap, "empty_paragraph").when(noisy(F.col("sentence")), "noisy").otherwise("")
    return parts.select(key, "para_idx", at.alias("sent_idx"), "sentence", (skipped != "").alias("skipped"), skipped.alias("skip_reason"), gap.alias("is_paragraph_break"))


def entities(tokens: Column, tags: Column, before: int = 20, after: int = 10) -> Column:
    """Of BIO tags, entities as structs: kind, entity, and the words before and after. An entity starts at a B and goes on over I of whatever type."""

    def of(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x["g"]) - 1), lambda i: F.get(x["g"], i).startswith("B-"))

        def entity(i: Column) -> Column:
            rest = F.slice(x["g"], i + 2, F.greatest(F.size(x["g"]), F.lit(1)))
            length = F.coalesce(F.nullif(F.array_position(F.transform(rest, lambda t: t.startswith("I-")), F.lit(False)), F.lit(0)), F.size(rest) + 1).cast("int")
            words = lambda a, n: F.array_join(F.slice(x["t"], a, n), " ")
            first = F.greatest(i - before, F.lit(0))
            return F.struct(F.substring(F.get(x["g"], i), 3, 100).alias("kind"), words(i + 1, length).alias("entity"), words(first + 1, i - first).alias("before"), words(i + length + 1, F.lit(after)).alias("after"))

        return F.transform(starts, entity)

    return F.when(F.size(tokens) > 0, T.let(F.struct(tokens.alias("t"), tags.alias("g")), of)).otherwise(F.array())


def corpus_error_rates(df: DataFrame, by: list[str], edits: Column, length: Column) -> DataFrame:
    """The sum of edits by the sum of lengths: long references count for more than short ones."""
    return df.groupBy(*by).agg(F.sum(edits).alias("edits"), F.sum(length).alias("length")).withColumn("rate", T.share(F.col("edits"), F.col("length")))


def read_binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """stem, size and content of a folder's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("length").alias("size"), "content")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split."""
    df.write.mode("error").partitionBy(split).option("compression", "zstd").parquet(path)
