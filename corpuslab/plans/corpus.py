"""Queries on the corpus: normalising, features, gates, duplicates, samples, contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as T
from ..functions.chars import CLASSES, class_counts, repeated_windows
from ..operators import contamination as C
from ..operators import dedup as D
from ..operators import gates as G
from ..operators import quality as Q
from ..operators import sampling as S
from ..profile import LATIN
from ..sources.work import saved
from .registry import query, table

_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_WORDS = r"regexp_extract_all({0}, '\S+')"
_SPECIAL = r"len(regexp_extract_all({0}, '[^\p{{L}}\p{{N}}\s]')) / greatest(length({0}), 1)"
_LATIN = r"[\x{00C0}-\x{024F}]"
_CLEAN = rf"""CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) < 50 THEN 'too_short' WHEN len({_WORDS.format("t")}) < 10 THEN 'too_few_words'
 WHEN NOT regexp_matches(t, '{_LATIN}') THEN 'no_alphabet' WHEN {_SPECIAL.format("t")} > 0.15 THEN 'special' ELSE 'ok' END"""
_DIRTY = "CASE WHEN doc_id % 7 = 0 THEN concat(text, chr(65533), chr(65533), chr(65533)) WHEN doc_id % 11 = 0 THEN concat(text, ' a?b c?d') WHEN doc_id % 13 = 0 THEN concat(text, ' ' || repeat(chr(1488), 400)) ELSE text END"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, reason and the hash of the normalised text, from one pass over the texts."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    gated = G.text_cascade(docs, T.normalise(F.col("text")), lambda t: G.clean_gates(t, LATIN))
    return saved(gated.select("doc_id", "source", "reason", F.md5("text").alias("h")))


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Documents with characters that the test table lacks, by a rule on ids."""
    t, i = F.col("text"), F.col("doc_id")
    dirty = F.when(i % 7 == 0, F.concat(t, F.lit("�" * 3))).when(i % 11 == 0, F.concat(t, F.lit(" a?b c?d"))).when(i % 13 == 0, F.concat(t, F.lit(" " + "א" * 400))).otherwise(t)
    return table(spark, d, "documents").withColumn("text", dirty)


@query(
    rf"""WITH n AS (SELECT doc_id, source, {_NORM} AS t FROM documents), g AS (SELECT *, {_CLEAN} AS reason FROM n),
 u AS (SELECT *, row_number() OVER (PARTITION BY reason = 'ok', CASE WHEN reason = 'ok' THEN md5(t) ELSE cast(doc_id AS VARCHAR) END ORDER BY doc_id) AS k FROM g)
 SELECT source, CASE WHEN reason = 'ok' AND k > 1 THEN 'duplicate' ELSE reason END AS reason, count(*) AS n FROM u GROUP BY ALL"""
)
def clean_exact(spark: SparkSession, d: str) -> DataFrame:
    """Normalise, gate, drop exact copies of what passed, and count by source and reason."""
    gated = _clean(spark, d)
    flagged = D.flag_duplicates(gated.where("reason = 'ok'"), "h", ["doc_id"]).withColumn("reason", F.when(F.col("duplicate"), "duplicate").otherwise("ok"))
    return G.funnel(flagged.select("source", "reason").unionByName(gated.where("reason <> 'ok'").select("source", "reason")), "source")


@query(
    rf"""WITH n AS (SELECT source, {_NORM} AS t FROM documents), g AS (SELECT *, {_CLEAN} AS reason FROM n)
 SELECT coalesce(source, 'all') AS source, count(*) AS raw, count(*) FILTER (reason = 'ok') AS passed, count(DISTINCT CASE WHEN reason = 'ok' THEN md5(t) END) AS distinct_texts FROM g GROUP BY ROLLUP (source)"""
)
def gate_funnel(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("reason") == "ok"
    found = _clean(spark, d).rollup("source").agg(F.count("*").alias("raw"), F.count_if(ok).alias("passed"), F.count_distinct(F.when(ok, F.col("h"))).alias("distinct_texts"))
    return found.withColumn("source", F.coalesce("source", F.lit("all")))


@query(rf"WITH n AS (SELECT {_NORM} AS t FROM documents), g AS (SELECT {_CLEAN} AS reason FROM n) SELECT reason, count(*) AS n, sum(count(*)) OVER () AS total FROM g GROUP BY reason")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return G.funnel(_clean(spark, d)).withColumn("total", F.sum("n").over(Window.partitionBy()))


@query(f"SELECT doc_id, md5({_NORM}) AS h, length({_NORM}) AS n FROM documents")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.normalise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("h"), F.length(t).cast("long").alias("n"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{0400}-\x{052F}]')) AS cyrillic, len(regexp_extract_all(text, '[A-Za-z]')) AS latin,
 len(regexp_extract_all(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}]')) AS arabic, len(regexp_extract_all(text, '\p{Nd}')) AS digit,
 len(regexp_extract_all(text, '[\p{P}\p{S}]')) AS punct, len(regexp_extract_all(text, '\S')) AS total FROM documents"""
)
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", class_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    return docs.select("doc_id", *("cyrillic", "latin", "arabic", "digit", "punct"), sum((F.col(c) for c in CLASSES[2:]), F.col("cyrillic")).alias("total"))


@query(
    rf"""SELECT page_id, len(regexp_extract_all(html, '(?i)https?://\S+')) AS urls, len(regexp_extract_all(html, '<[^>]{{1,200}}>')) AS tags,
 {_SPECIAL.format("html")} AS special, regexp_matches(html, '_{{5,}}') AS underscores FROM pages"""
)
def junk_features(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", T.count(h, T.URL).alias("urls"), T.count(h, T.TAG).alias("tags"), T.special_ratio(h).alias("special"), h.rlike("_{5,}").alias("underscores"))


@query(
    rf"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len(regexp_extract_all(html, '(?i)https?://\S+')) * 1000 / greatest(length(html), 1) > 5 THEN 'junk:urls'
 WHEN len(regexp_extract_all(html, '<[^>]{{1,200}}>')) > 5 THEN 'junk:tags' WHEN {_SPECIAL.format("html")} > 0.15 THEN 'junk:special' WHEN contains(lower(html), 'copyright') THEN 'junk:copyright'
 WHEN contains(lower(html), 'license') THEN 'junk:license' WHEN contains(lower(html), 'all rights reserved') THEN 'junk:all rights reserved' WHEN regexp_matches(html, '_{{5,}}') THEN 'junk:underscores' ELSE 'ok' END AS reason FROM pages) GROUP BY reason"""
)
def junk_reasons(spark: SparkSession, d: str) -> DataFrame:
    return G.funnel(G.cascade(table(spark, d, "pages"), G.junk_gates(F.col("html"), LATIN)))


@query(
    r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(html) < 50 THEN 'too_short' WHEN len(regexp_extract_all(html, '(?i)https?://\S+')) * 1000 / greatest(length(html), 1) > 5 THEN 'urls'
 WHEN len(regexp_extract_all(html, '<[^>]{1,200}>')) > 5 THEN 'tags' ELSE 'ok' END AS reason FROM pages) GROUP BY reason"""
)
def collect_reasons(spark: SparkSession, d: str) -> DataFrame:
    return G.funnel(G.cascade(table(spark, d, "pages"), G.collect_gates(F.col("html"))))


_TOP = r"""c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS ch FROM {0}), f AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL),
 p AS (SELECT doc_id, max(n) AS most, count(*) AS kinds, sum(n) AS total FROM f GROUP BY doc_id)"""


@query(f"WITH {_TOP.format('documents')} SELECT doc_id, most / total AS top_char, kinds / total AS unique_chars FROM p WHERE total > 20")
def top_char_ratio(spark: SparkSession, d: str) -> DataFrame:
    top, unique = G.top_char(F.col("text"))
    return table(spark, d, "documents").select("doc_id", top.alias("top_char"), unique.alias("unique_chars")).where("top_char IS NOT NULL")


_FOREIGN = "[" + "".join(G.FOREIGN.values()) + "]"


@query(
    rf"""WITH x AS (SELECT doc_id, {_DIRTY} AS text FROM documents), {_TOP.format("x")},
 k AS (SELECT x.doc_id, text, CASE WHEN total > 20 THEN most / total END AS top, CASE WHEN total > 20 THEN kinds / total END AS uniq, len(regexp_extract_all(text, '\S')) AS vis FROM x LEFT JOIN p USING (doc_id))
 SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 10 THEN 'empty' WHEN top > 0.25 THEN 'top_char' WHEN uniq < 0.05 THEN 'unique_chars'
 WHEN len(regexp_extract_all(text, '\x{{FFFD}}')) >= 3 THEN 'replacement' WHEN len(regexp_extract_all(text, '\p{{L}}\?\p{{L}}')) >= 2 THEN 'broken'
 WHEN len(regexp_extract_all(text, '\?')) >= 5 AND len(regexp_extract_all(text, '\?')) / greatest(vis, 1) >= 0.08 THEN 'question_marks'
 WHEN len(regexp_extract_all(text, '{_FOREIGN}')) >= 3 AND len(regexp_extract_all(text, '{_FOREIGN}')) / greatest(vis, 1) >= 0.005 THEN 'foreign'
 WHEN len(regexp_extract_all(text, '[{LATIN.script}0-9.,!?;:()-]')) / greatest(vis, 1) < 0.70 THEN 'useful' ELSE 'ok' END AS reason FROM k) GROUP BY reason"""
)
def foreign_char_reasons(spark: SparkSession, d: str) -> DataFrame:
    return G.funnel(G.cascade(_dirty(spark, d), G.foreign_gates(F.col("text"), LATIN)))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '[{c}]')) AS {k}" for k, c in G.FOREIGN.items()) + f" FROM (SELECT doc_id, {_DIRTY} AS text FROM documents)")
def foreign_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("doc_id", *(T.count(F.col("text"), f"[{c}]").alias(k) for k, c in G.FOREIGN.items()))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM w WHERE len(w) >= 10),
 c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) SELECT doc_id, cast(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, cast(sum(n) AS BIGINT) AS total FROM c GROUP BY doc_id"""
)
def repeated_ngram_ratio(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", repeated_windows(F.col("text"), 10).alias("x")).select("doc_id", "x.*")
    return docs.where("total > 0").select("doc_id", "repeated", "total")


@query("SELECT doc_id, md5(nfc_normalize(t)) AS h FROM (SELECT doc_id, concat(text, 'e', chr(769)) AS t FROM documents)")
def nfc_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(A.unicode_form(F.concat("text", F.lit("é")))).alias("h"))


@query()
def gzip_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", A.gzip_ratio(F.col("text")).alias("ratio"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(lower(text)), '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g'), '[\x00-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def dedup_key_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """SQL has NFC only; the tables hold no character that has another NFKC form."""
    key = T.collapse(A.unicode_form(F.lower("text"), "NFKC"))
    return table(spark, d, "documents").select("doc_id", F.md5(key).alias("h"))


@query(
    r"""WITH h AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) END AS h, text FROM documents)
 SELECT doc_id, md5(regexp_replace(CASE WHEN h IS NULL THEN text WHEN strpos(h, chr(10) || chr(10)) > 1 THEN regexp_replace(h, '(?s)^(.*)\n\n.*$', '\1')
 WHEN strpos(h, chr(10)) > 1 THEN regexp_replace(h, '(?s)^(.*)\n.*$', '\1') ELSE h END, '\s+$', '')) AS h FROM h"""
)
def truncate_at_break(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.truncate(F.col("text"), 2000)).alias("h"))


@query(
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?i)https?://\S+', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g'), '<[^>]{1,200}>', '', 'g')) AS h FROM pages"""
)
def remove_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.without_links(F.col("html"))).alias("h"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def plain_speech(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.plain_speech(F.col("text"))).alias("h"))


@query(r"SELECT DISTINCT source, regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", T.slug(F.concat_ws(" / ", "source", "lang")).alias("slug")).distinct()


@query()
def spoken_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(A.spoken(F.col("text"))).alias("h"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h, count(*) AS copies FROM documents GROUP BY md5(text)")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    copies = docs.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("copies"))
    return D.keep_first(docs, "text", ["doc_id"]).select("doc_id", F.md5("text").alias("h")).join(copies, "h").select("doc_id", "h", "copies")


@query(
    """WITH r AS (SELECT *, cast(substr(source, 4) AS INT) AS rank FROM documents), k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY rank, doc_id) AS n FROM r)
 SELECT source, count(*) AS raw, count(*) FILTER (n = 1) AS kept FROM k GROUP BY source"""
)
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.substring("source", 4, 9).cast("int").alias("rank"))
    flagged = D.flag_duplicates(docs, "text", ["rank", "doc_id"])
    return flagged.groupBy("source").agg(F.count("*").alias("raw"), F.count_if(~F.col("duplicate")).alias("kept"))


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'de')")
def not_seen_before(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return D.not_seen(docs, docs.where("lang = 'de'").select(F.md5("text")), F.col("text")).select("doc_id")


_SHINGLES = r"""t AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text), w AS (SELECT id, regexp_extract_all(text, '\S+') AS w FROM t),
 s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
 p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY ALL)"""


@query(f"WITH {_SHINGLES} SELECT a, b, common, na.n + nb.n - common AS either FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE common >= 0.8 * (na.n + nb.n - common)")
def shingle_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = D.keep_first(table(spark, d, "documents"), "text", ["doc_id"])
    return D.exact_pairs(docs, "doc_id", "text", 5, 0.8).select("a", "b", F.col("common").cast("long"), F.col("either").cast("long"))


@query()
def near_dup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stay by the greedy rule; tested against the sequential rule."""
    docs = D.keep_first(table(spark, d, "documents"), "text", ["doc_id"])
    return D.greedy_keep(docs.select("doc_id"), D.exact_pairs(docs, "doc_id", "text", 5, 0.8)).toDF("doc_id")


_GRAMS = "{k} lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM {t}"
_ITEMS = f"""b AS (SELECT {_GRAMS.format(k="item_id,", t="benchmark")}), c AS (SELECT {_GRAMS.format(k="", t="documents")}),
 bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 11), lambda i: substr(t, i, 13))) AS g FROM b WHERE length(t) >= 13),
 cg AS (SELECT DISTINCT unnest(list_transform(range(1, length(t) - 11), lambda i: substr(t, i, 13))) AS g FROM c WHERE length(t) >= 13),
 o AS (SELECT item_id, count(*) AS n_grams, count(cg.g) AS n_found FROM bg LEFT JOIN cg ON bg.g = cg.g GROUP BY item_id)"""


@query(f"WITH {_ITEMS} SELECT * FROM o")
def contamination_items(spark: SparkSession, d: str) -> DataFrame:
    return C.item_overlap(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query(
    f"""WITH {_ITEMS}, r AS (SELECT n_found / n_grams AS r FROM o) SELECT count(*) AS items, count(*) FILTER (r > 0.5) AS contaminated, max(r) AS max_ratio, round(avg(r), 9) AS mean_ratio, (SELECT count(*) FROM benchmark) - count(*) AS skipped, median(r) AS median_ratio,
 list_sort(list(r))[least(cast(floor(0.95 * count(*)) AS INT) + 1, count(*))] AS p95_ratio FROM r"""
)
def contamination_summary(spark: SparkSession, d: str) -> DataFrame:
    r = saved(contamination_items(spark, d).select(F.lit(0).alias("all"), (F.col("n_found") / F.col("n_grams")).alias("r")))
    sums = r.groupBy("all").agg(F.count("*").alias("items"), F.count_if(F.col("r") > 0.5).alias("contaminated"), F.max("r").alias("max_ratio"), F.round(F.avg("r"), 9).alias("mean_ratio"))
    ranks = Q.percentiles(r, "all", "r", {"median_ratio": 0.5}).join(Q.order_statistics(r, "all", "r", {"p95_ratio": 0.95}), "all")
    skipped = table(spark, d, "benchmark").agg(F.count("*").alias("given"))
    return sums.join(ranks, "all").crossJoin(skipped).withColumn("skipped", F.col("given") - F.col("items")).drop("all", "given")


_ORDER = "md5('42:' || cast(doc_id AS VARCHAR))"


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}, doc_id) AS k FROM documents) WHERE k <= 5")
def sample_per_source(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_per_group(table(spark, d, "documents"), "source", "doc_id", 5).select("doc_id", "source")


@query(
    f"""WITH s(lang, p) AS (VALUES ('en', 0.4), ('fr', 0.3), ('de', 0.2), ('es', 0.1)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT min(n / cast(p AS DOUBLE)) AS budget FROM c JOIN s USING (lang)),
 t AS (SELECT lang, least(n, floor(budget * cast(p AS DOUBLE))) AS target FROM c JOIN s USING (lang), b), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}, doc_id) AS k FROM documents)
 SELECT doc_id, lang FROM r JOIN t USING (lang) WHERE k <= target"""
)
def domain_balance(spark: SparkSession, d: str) -> DataFrame:
    return S.balance(table(spark, d, "documents"), "lang", "doc_id", {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}).select("doc_id", "lang")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || cast(doc_id AS VARCHAR)), doc_id) AS k FROM labels), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))
 SELECT doc_id, toxic FROM r, m WHERE k <= least"""
)
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return S.undersample(table(spark, d, "labels"), "toxic", "doc_id").select("doc_id", "toxic")


@query(
    """WITH c AS (SELECT lang, greatest(1, least(50, floor(50000 / count(*)))) AS k FROM documents GROUP BY lang)
 SELECT doc_id, cast(unnest(range(1, cast(k AS BIGINT) + 1)) AS INT) AS copy FROM documents JOIN c USING (lang)"""
)
def upsample(spark: SparkSession, d: str) -> DataFrame:
    return S.upsample(table(spark, d, "documents"), "lang", 50_000, 50).select("doc_id", "copy")


@query(
    f"""SELECT doc_id, CASE WHEN p >= 99 THEN 'test' WHEN p >= 94 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, cast('0x' || substr({_ORDER}, 1, 8) AS BIGINT) % 100 AS p FROM documents)"""
)
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return S.split(table(spark, d, "documents"), "doc_id", {"train": 94, "validation": 5, "test": 1}).select("doc_id", "split")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def quota_select(spark: SparkSession, d: str) -> DataFrame:
    return S.quota(table(spark, d, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("doc_id", "source")


@query(
    """SELECT event_id, running FROM (SELECT event_id, event_type, sum(event_id % 97) OVER (PARTITION BY event_type ORDER BY event_id) AS running, event_id % 97 AS a FROM events) WHERE running - a < 1000"""
)
def running_total_stop(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 97).alias("a"))
    return S.running_until(events, "event_type", "event_id", "a", 1000).select("event_id", "running")


@query(
    """SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 OR lang <> 'en' THEN 'drop' ELSE 'keep' END AS verdict FROM documents"""
)
def multi_column_filter(spark: SparkSession, d: str) -> DataFrame:
    keep = G.keep_all_columns([F.length(T.strip(F.col("text"))) >= 50, F.col("lang") == "en"])
    return table(spark, d, "documents").select("doc_id", F.when(keep, "keep").otherwise("drop").alias("verdict"))


@query(
    r"""SELECT lang, count(*) AS rows, cast(sum(n_chars) AS BIGINT) AS chars, cast(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, cast(sum(strlen(text)) AS BIGINT) AS bytes,
 quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75 FROM documents GROUP BY lang"""
)
def token_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sums = (
        docs.groupBy("lang")
        .agg(
            F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), F.sum(T.word_count(F.col("text"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes"),
        )
    )
    return sums.join(Q.percentiles(docs, "lang", "n_chars", {"p50": 0.5, "p75": 0.75}), "lang")
