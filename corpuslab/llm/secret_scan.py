"""Secret scan in DataFrame functions only: fixed patterns, and a randomness test battery for other tokens.

Patterns (``assign``, ``access``, ``hex``) report spans as they are. Besides, each run of 20 characters or more that base 16,
32, 62 or 64 could write is a candidate if it has a letter and a digit. Its alphabet is inferred, and three tests ask
whether it is uniformly random: chi-squared of its symbol counts, the runs of symbols in the lower and upper half of the
alphabet, and the correlation of neighbouring symbols. Their least p-value times three is the candidate's p-value. Within
each class of lengths (powers of two) Benjamini-Hochberg at ``fdr`` rejects what is not random; long tokens, for which the
tests see more, so don't share a threshold with the many short ones. What is left, carries ``least_bits`` or more and
doesn't overlap a pattern's span is reported as ``random``.

The procedure controls how often what is random is taken not to be, not how much of what is reported is no secret: shorter
tokens give the tests little to go by. Tokens without a digit or a letter, and of fewer than 20 characters, are left to the patterns.

Null text is empty. Spans of one start are ordered by kind, those of ``random`` never overlap others. Repeated rows give
repeated results; very long texts are scanned whole, and texts without candidates cost one scan for each pattern. Other
columns stay as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, written

ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match takes its whole run, so the least length can stand in these two patterns. In ASSIGN it can't: a short match uses up text.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,end:int>>"
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order in which they are tried: pattern, symbols in the order of their values.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[A-Za-z0-9]+$", _UPPER + _UPPER.lower() + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", _UPPER + _UPPER.lower() + _DIGITS + "-_"),
    ("^[A-Za-z0-9+/_-]+$", _UPPER + _UPPER.lower() + _DIGITS + "+/-_"),  # of both kinds, as a token behind a path
)
BINS = 10_000


def _matches(text: Column, pattern: str, guard: Column | None = None, group: int = 0) -> Column:
    """Matches from left to right: start and end in code points, the match, and a group of it.

    ``guard`` is cheaper than the pattern and holds for every text that has a match.
    """
    has = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), F.length).alias("gap"),
        hits.alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,part:string>>")

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part"].alias("part")))).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda a: a["out"])
    return F.when(has, found).otherwise(empty)


def _tail(z: Column) -> Column:
    """The two-sided p-value of a normal score (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    fixed = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)  # fixed values of that formula

    def tail(z: Column, t: Column) -> Column:
        series = F.lit(0.0)
        for b in reversed(fixed):
            series = (series + b) * t
        return F.least(F.lit(1.0), 2 * series * F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5)

    return _let(F.abs(z), lambda z: _let(1 / (1 + 0.2316419 * z), lambda t: tail(z, t)))


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _chi(values: Column, size: Column, n: Column) -> Column:
    squares = F.aggregate(F.array_distinct(values), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), F.lit(2)))
    return _let(size - 1, lambda k: _let((F.pow((size / n * squares - n) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)), _tail))


def _run(values: Column, pairs: Column, size: Column, n: Column) -> Column:
    high = F.size(F.filter(values, lambda v: 2 * v >= size)).cast("double")
    runs = 1 + F.size(F.filter(pairs, lambda p: (2 * p["a"] >= size) != (2 * p["b"] >= size)))

    def test(x: Column) -> Column:
        spread = (x["expected"] - 1) * (x["expected"] - 2) / (n - 1)
        return F.when(spread > 0, _let((x["runs"] - x["expected"]) / F.sqrt(F.greatest(spread, F.lit(1e-9))), _tail)).otherwise(F.lit(0.0))

    return _let(F.struct(runs.alias("runs"), _let(high, lambda h: 2 * h * (n - h) / n + 1).alias("expected")), test)


def _serial(values: Column, pairs: Column, n: Column) -> Column:
    def test(mean: Column) -> Column:
        variance = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        product = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        return _let(variance, lambda s: F.when(s > 0, _let((product / F.greatest(s, F.lit(1e-9)) + 1 / n) * F.sqrt(n), _tail)).otherwise(F.lit(0.0)))

    return _let(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n, test)


def _p_value(values: Column, size: Column, n: Column) -> Column:
    """The battery's p-value of an array of ``n`` symbol values (doubles) of an alphabet of ``size``."""
    pairs = F.arrays_zip(F.slice(values, F.lit(1), F.size(values) - 1).alias("a"), F.slice(values, F.lit(2), F.size(values) - 1).alias("b"))
    return _let(pairs, lambda p: F.least(F.lit(1.0), 3 * F.least(_chi(values, size, n), _run(values, p, size, n), _serial(values, p, n))))


def _candidate(span: Column) -> Column:
    """Of a match of CANDIDATE: its class of lengths, its p-value (null without an encoding), the bits that it could carry."""

    def of(body: Column) -> Column:
        symbols = F.lit(None).cast("string")
        for pattern, alphabet in reversed(ENCODINGS):
            symbols = F.when(body.rlike(pattern), F.lit(alphabet)).otherwise(symbols)
        return _let(F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), symbols), lambda s: tested(body, s))

    def tested(body: Column, symbols: Column) -> Column:
        size, n = F.length(symbols).cast("double"), F.length(body).cast("double")
        values = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: (F.instr(symbols, c) - 1).cast("double"))
        p = _let(F.struct(values.alias("v"), size.alias("s"), n.alias("n")), lambda x: _let(x["v"], lambda v: _let(x["s"], lambda s: _let(x["n"], lambda n: _p_value(v, s, n)))))
        return F.struct(
            span["start"].alias("start"), span["end"].alias("end"), F.floor(F.log2(n)).cast("int").alias("class"), F.when(symbols.isNotNull(), p).alias("p"), (n * F.log2(size)).alias("bits")
        )

    return _let(F.rtrim(span["hit"], F.lit("=")), of)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def with_matches(docs: DataFrame, text: str, base: str, candidates: str) -> DataFrame:
    """``docs`` with the patterns' spans in column ``base`` and the candidates in column ``candidates``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_matches(whole, ASSIGN, whole.contains("=") | whole.contains(":"), 2), lambda x: F.length(x["part"]) >= 12)
    spans = F.concat(_spans(assign, "assign"), _spans(_matches(whole, ACCESS, whole.contains("AKIA")), "access"), _spans(_matches(whole, HEX), "hex"))
    tested = F.filter(F.transform(_matches(whole, CANDIDATE, whole.rlike("[0-9]")), _candidate), lambda c: c["p"].isNotNull())
    return docs.withColumns({base: F.array_sort(spans), candidates: tested})


def thresholds(candidates: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg for each class of lengths: one row with a map from class to the greatest bin of p-values rejected.

    ``candidates`` has one column, an array as :func:`with_matches` makes. P-values count by bins of 1 / BINS, rounded
    up, so what is sorted has at most BINS rows a class, of which there are as many as powers of two.
    """
    each = candidates.select(F.explode(F.col(candidates.columns[0])).alias("c")).groupBy(F.col("c.class").alias("class"), F.ceil(F.col("c.p") * BINS).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("class")
    ranked = each.select("class", "bin", F.sum("n").over(of.orderBy("bin")).alias("rank"), F.sum("n").over(of).alias("m"))
    cut = ranked.groupBy("class").agg(F.coalesce(F.max(F.when(F.col("bin") * F.col("m") <= F.lit(fdr) * BINS * F.col("rank"), F.col("bin"))), F.lit(-1)).alias("cut"))
    return cut.agg(F.map_from_entries(F.collect_list(F.struct("class", "cut"))).alias("cuts"))


def _random(base: Column, candidates: Column, cuts: Column, least_bits: float) -> Column:
    """Candidates whose randomness isn't rejected and that no span of ``base`` overlaps."""
    kept = F.filter(
        candidates,
        lambda c: (F.ceil(c["p"] * BINS) > F.coalesce(cuts[c["class"]], F.lit(-1))) & (c["bits"] >= least_bits) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return _spans(kept, "random")


def find_secrets(docs: DataFrame, *, text: str = "text", keep_text: bool = True, fdr: float = 0.05, least_bits: float = 80.0, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with columns ``base`` and ``spans``: arrays of (start, kind, end) by start and kind, kinds counted as in KINDS.

    All columns of ``docs`` stay, the text only with ``keep_text``; columns named ``base`` or ``spans`` are replaced. The
    thresholds come from all rows, so what the patterns find is written once and read twice.
    """
    docs = docs.drop(base, spans)
    tested = fresh([*docs.columns, base, spans], "tested")
    cut = fresh([*docs.columns, base, spans, tested], "cuts")
    found = with_matches(docs, text, base, tested)
    found = written(found if keep_text else found.drop(text), "matches")
    cuts = thresholds(found.select(tested), fdr).withColumnRenamed("cuts", cut)
    every = F.array_sort(F.concat(F.col(base), _random(F.col(base), F.col(tested), F.col(cut), least_bits)))
    # One row with as many entries as there are classes of lengths.
    return found.crossJoin(F.broadcast(cuts)).withColumn(spans, every).drop(tested, cut)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts by pattern, a digest of the patterns' spans, and all spans; one row for each row of ``docs``."""
    found = find_secrets(docs.select("doc_id", "text"), keep_text=False, **options)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each span of :func:`find_secrets` (overlapping ones as one) replaced by ``mark``; null stays null."""
    base, spans = (fresh(docs.columns, c) for c in ("secret_base", "secret_spans"))
    found = find_secrets(docs, text=text, base=base, spans=spans, **options)

    def add(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"))

    cleaned = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(F.col(text))).select(*docs.columns)
