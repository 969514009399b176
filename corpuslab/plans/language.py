"""Queries on language identification, perplexity and whole cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates as G
from ..operators import language as L
from ..profile import LATIN
from .registry import query, table

_LISTS = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in sorted(L.STOP_WORDS.items())}
_NAMES = sorted(_LISTS)


def _lang(text: str, source: str, key: str = "doc_id") -> str:
    """CTEs sh (shares by language) and lg (key, lang, confidence) of an expression over a table."""
    shares = ", ".join(f"len(list_filter(w, lambda x: list_contains({v}, x))) / greatest(len(w), 1) AS {k}" for k, v in _LISTS.items())
    case = " ".join(f"WHEN {k} = top THEN '{k}'" for k in _NAMES)
    return (
        f"sw AS (SELECT {key}, regexp_extract_all(lower({text}), '\\p{{L}}+') AS w FROM {source}), sh AS (SELECT {key}, {shares} FROM sw), tp AS (SELECT *, greatest({', '.join(_NAMES)}) AS top, {' + '.join(_NAMES)} AS total FROM sh),"
        f" lg AS (SELECT {key}, CASE WHEN top = 0 THEN 'unk' {case} END AS lang, CASE WHEN top > 0 THEN top / total ELSE 0.0::DOUBLE END AS confidence FROM tp)"
    )


def _head(most: int) -> str:
    return f"substr(replace(text, chr(10), ' '), 1, {most})"


@query(f"WITH {_lang(_head(5000), 'documents')} SELECT doc_id, lang, confidence FROM lg")
def language_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", L.identified(F.col("text")).alias("x")).select("doc_id", "x.*")


@query(rf"WITH {_lang(_head(500), 'documents')} SELECT doc_id, CASE WHEN s THEN 'unk' ELSE lang END AS lang, CASE WHEN s THEN 0.0::DOUBLE ELSE round(confidence, 3) END AS confidence FROM lg JOIN (SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 5 AS s FROM documents) USING (doc_id)")
def language_id_short(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", L.identified_short(F.col("text")).alias("x")).select("doc_id", "x.*")


@query(rf"WITH {_lang(_head(2000), 'pages').replace('text', 'html').replace('doc_id', 'page_id')} SELECT page_id, CASE WHEN NOT s THEN lang END AS lang FROM lg JOIN (SELECT page_id, length(regexp_replace(html, '^\s+|\s+$', '', 'g')) < 20 AS s FROM pages) USING (page_id)".replace("doc_id", "page_id"))
def language_id_or_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", L.identified_or_null(F.col("html"))["lang"].alias("lang"))


_SPACED = r"regexp_extract_all(lower(text), '\S+')"
_MODEL = f"""t AS (SELECT doc_id, {_SPACED} AS w FROM documents), c AS (SELECT x AS token, count(*) AS n FROM (SELECT unnest(w) AS x FROM t) GROUP BY x), m AS (SELECT sum(n) + count(*) + 1 AS total FROM c),
 f AS (SELECT doc_id, x AS token, count(*) AS k FROM (SELECT doc_id, unnest(w[1:256]) AS x FROM t) GROUP BY ALL), p AS (SELECT doc_id, sum(k) AS n, sum(k * (ln(total) - ln(c.n + 1))) AS nll FROM f JOIN c USING (token), m GROUP BY doc_id)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs, tokens = table(spark, d, "documents"), T.words(F.lower("text"))
    return L.perplexity(docs, "doc_id", tokens, L.unigram_model(docs, tokens))


@query(f"WITH {_MODEL} SELECT doc_id, cast(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n > 0 THEN round(ln(exp(least(nll / n, 20))), 6) END AS log_ppl FROM documents LEFT JOIN p USING (doc_id)")
def unigram_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Rounded, as the order of a sum of floating-point numbers is no one's."""
    s = _scores(spark, d)
    return s.select("doc_id", "n", F.when(F.col("n") > 0, F.round(F.log("ppl"), 6)).alias("log_ppl"))


@query(f"WITH {_MODEL} SELECT lang, round(sum(nll) / sum(strlen(array_to_string(t.w[1:256], ' '))) / 0.6931471805599453, 6) AS bits FROM documents JOIN t USING (doc_id) JOIN p USING (doc_id) GROUP BY lang")
def bits_per_byte_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.octet_length(F.array_join(F.slice(T.words(F.lower("text")), 1, 256), " ")).alias("size"))
    sums = docs.join(_scores(spark, d).where("n > 0"), "doc_id").groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("size").alias("size"))
    return sums.select("lang", F.round(L.bits_per_byte(F.col("nll"), F.col("size")), 6).alias("bits"))


@query(
    r"""SELECT lang, sum(len(k)) / sum(len(w)) AS tokens_per_word, sum(length(text)) / sum(len(k)) AS chars_per_token, sum(strlen(text)) / sum(len(k)) AS bytes_per_token
 FROM (SELECT lang, text, regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]') AS k, regexp_extract_all(text, '\S+') AS w FROM documents) GROUP BY lang"""
)
def fertility_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return L.fertility(table(spark, d, "documents"), "lang", "text", F.regexp_extract_all("text", F.lit(r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}])")))


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents), b AS (SELECT w, list_transform(range(1, cast(ceil(length(w) / 3) AS BIGINT)), lambda i: i * 3) AS a, [length(w) - 2] AS b FROM w)
 SELECT w, cast(len(list_intersect(a, b)) AS DOUBLE) / len(b) AS matched FROM b"""
)
def boundary_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of three letters against a stem and an ending of two: stand-ins for a tokenizer and a segmenter."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"))).alias("w")).distinct()
    pieces = F.regexp_extract_all("w", F.lit("(.{1,3})"))
    return words.select("w", L.boundary_match(pieces, F.array(F.substring("w", F.lit(1), F.length("w") - 2), F.right("w", F.lit(2)))).alias("matched"))


@query(
    rf"""WITH {_lang(_head(5000), 'documents')}, f AS (SELECT min(doc_id) AS doc_id, 1 AS one FROM documents WHERE length(text) >= 50 GROUP BY md5(text))
 SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(length(text), 0) < 50 THEN 'too_short' WHEN one IS NULL THEN 'duplicate' WHEN lg.lang NOT IN ('en', 'de') THEN 'language' ELSE 'ok' END AS reason
 FROM documents LEFT JOIN f USING (doc_id) JOIN lg USING (doc_id)) GROUP BY reason"""
)
def document_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return G.funnel(L.document_filter(table(spark, d, "documents"), "doc_id", "text", languages=("en", "de")))


_N = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_S = r"len(regexp_extract_all(t, '[^\p{L}\p{N}\s]')) / greatest(length(t), 1)"
_VIS, _LET = r"greatest(len(regexp_extract_all(t, '\S')), 1)", r"len(regexp_extract_all(t, '\p{L}'))"
_OWN = rf"len(regexp_extract_all(t, '[{LATIN.script}]'))"
_SCRIPT = f"{_OWN} / {_VIS} < 0.60 OR ({_LET} - {_OWN}) / {_VIS} > 0.25"
_JUNK = f"""WHEN len(regexp_extract_all(t, '(?i)https?://\\S+')) * 1000 / greatest(length(t), 1) > 5 THEN 'junk:urls' WHEN len(regexp_extract_all(t, '<[^>]{{1,200}}>')) > 5 THEN 'junk:tags' WHEN {_S} > 0.15 THEN 'junk:special'
 {" ".join(f"WHEN contains(lower(t), '{w}') THEN 'junk:{w}'" for w in LATIN.boilerplate)} WHEN regexp_matches(t, '_{{5,}}') THEN 'junk:underscores'"""
_REP = r"""w AS (SELECT doc_id, regexp_extract_all(t, '\S+') AS w FROM n), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM w WHERE len(w) >= 10),
 gc AS (SELECT doc_id, g, count(*) AS k FROM g GROUP BY ALL), r AS (SELECT doc_id, sum(CASE WHEN k > 1 THEN k ELSE 0 END) / sum(k) AS r FROM gc GROUP BY doc_id)"""
_SHARE = "(en / greatest(de + en + es + fr, 1e-9) >= 0.5 AND (en - fr) / greatest(de + en + es + fr, 1e-9) >= 0.1 AND (en - de) / greatest(de + en + es + fr, 1e-9) >= 0.1)"


def _english(t: Column) -> Column:
    return T.let(L.stop_word_shares(t), lambda x: L.leads(x, "en", ("fr", "de")))


@query(
    rf"""WITH n AS (SELECT doc_id, {_N} AS t FROM documents), {_lang("t", "n")}, {_REP}
 SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 50 THEN 'too_short' WHEN len(regexp_extract_all(t, '\S+')) < 10 THEN 'too_few_words' WHEN NOT regexp_matches(t, '[{LATIN.distinctive}]') THEN 'no_alphabet'
 WHEN {_SCRIPT} THEN 'script' WHEN {_SHARE} THEN 'language' {_JUNK} WHEN coalesce(r, 0) >= 0.3 THEN 'repetition' ELSE 'ok' END AS reason FROM n JOIN sh USING (doc_id) LEFT JOIN r USING (doc_id)) GROUP BY reason"""
)
def whole_cascade_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The corpus cascade with script, language (English goes), junk and repetition; without gzip, which SQL lacks."""
    docs = table(spark, d, "documents").select("text")
    return G.funnel(G.text_cascade(docs, T.normalise(F.col("text")), lambda t: G.whole_cascade(t, LATIN, language=_english(t))))


@query()
def whole_cascade_gzip(spark: SparkSession, d: str) -> DataFrame:
    """What passes the cascade, less what gzip compresses below a fifth."""
    from ..functions.arrow import gzip_ratio

    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    passed = G.text_cascade(docs, T.normalise(F.col("text")), lambda t: G.whole_cascade(t, LATIN)).where("reason = 'ok'")
    return passed.withColumn("ratio", gzip_ratio(F.col("text"))).where(F.col("ratio") >= LATIN.min_gzip).select("doc_id", "source", "ratio")


@query(
    rf"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://\S+', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '', 'g'), '<[^>]{{1,200}}>', '', 'g') AS text FROM documents), n AS (SELECT doc_id, substr({_N}, 1, 500000) AS t FROM x)
 SELECT doc_id, CASE WHEN length(t) < 50 THEN 'too_short' WHEN {_SCRIPT} THEN 'script' ELSE 'ok' END AS reason FROM n"""
)
def bilingual_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return G.text_cascade(docs, G.cut(T.normalise(T.without_links(F.col("text")))), lambda t: G.bilingual_gates(t, LATIN)).select("doc_id", "reason")


@query("SELECT doc_id, CASE WHEN length(text) < 30 THEN 'too_short' WHEN lang <> 'fr' THEN 'language' WHEN NOT regexp_matches(text, '[\\x{00C0}-\\x{024F}]') THEN 'no_alphabet' ELSE 'ok' END AS reason FROM documents")
def balanced_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return G.cascade(docs, G.balanced_gates(docs, "text", LATIN, lang="lang", wanted="fr", flag="absent")).select("doc_id", "reason")


@query("SELECT doc_id, coalesce(len(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{024F}]')) / greatest(len(regexp_extract_all(text, '\\p{L}')), 1), 0) AS ratio FROM documents")
def script_ratios(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", G.script_ratio(F.col("text"), LATIN.script).alias("ratio"))


_KEYS = ["the", "und", "licensed", "de", "password"]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{k}'" for k in _KEYS) + r"], lambda k: regexp_matches(text, '(?i)(?:^|[^\p{L}])' || k || '(?:$|[^\p{L}])')), ',') AS hits FROM documents")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(G.keyword_hits(F.col("text"), _KEYS), ",").alias("hits"))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) < 3 OR regexp_matches(lower(text), 'translate|http|python|image') AS skipped FROM conversations WHERE role = 'user'")
def instruction_skips(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", G.instruction_skipped(F.col("text"), ("translate", "http", "Python", "image")).alias("skipped"))


_LINE = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), s AS (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM l)"


@query(
    rf"""WITH {_LINE}, n AS (SELECT *, len(regexp_extract_all(x, '\S+')) AS n, regexp_matches(x, '^\p{{Lu}}') AND regexp_matches(x, '[.!?]$') AS o FROM s)
 SELECT count(*) FILTER (o AND n BETWEEN 8 AND 40) AS v3, count(*) FILTER (o AND n BETWEEN 8 AND 40 AND len(regexp_extract_all(x, '[0-9]')) / greatest(length(x), 1) <= 0.2 AND regexp_matches(x, '(?:ed|en|ing)(?:[^\p{{L}}]|$)')) AS v2, count(*) FILTER (o AND n BETWEEN 6 AND 30) AS plain FROM n"""
)
def seed_variants(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("l")).select(T.strip(F.col("l")).alias("x"))
    return lines.agg(F.count_if(G.seed_variant(x)).alias("v3"), F.count_if(G.seed_variant(x, digits=0.2, endings=("ed", "en", "ing"))).alias("v2"), F.count_if(G.seed_variant(x, words=(6, 30))).alias("plain"))


@query(
    r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s*(?:[-*\x{2022}]|\d+[.)])\s*', ''), '^\s*[\p{L} ]{1,20}:\s*', ''), '\*\*([^*]*)\*\*', '\1', 'g'), '\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g')),
 lambda x: length(x) >= 30 AND len(regexp_extract_all(x, '\S+')) <= 12)[1] AS line FROM documents"""
)
def picked_lines(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, as of a model's answer, the first line that passes."""
    return table(spark, d, "documents").select("doc_id", G.first_line(F.col("text"), lambda x: (F.length(x) >= 30) & (T.word_count(x) <= 12)).alias("line"))
