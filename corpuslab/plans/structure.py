"""Queries on sentences, conversations, blocks and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import scores as C
from ..functions import text as T
from ..operators import gates as G
from ..operators import packing as P
from ..operators import pairs as R
from ..operators import structure as E
from .registry import query, table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SENT = rf"""s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\x{{2026}}])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: {_STRIP.format("x")}), lambda x: length(x) >= 10) AS s FROM documents),
 s AS (SELECT doc_id, cast(i - 1 AS INT) AS sent_idx, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s0))"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return E.sentences(table(spark, d, "documents"), "doc_id")


@query(f"WITH {_SENT} SELECT doc_id, sent_idx, md5(sentence) AS h FROM s")
def sentence_explode(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).select("doc_id", "sent_idx", F.md5("sentence").alias("h"))


@query(f"WITH {_SENT} SELECT doc_id, CASE WHEN len(s) > 0 THEN substr(md5(array_to_string(s, chr(10))), 1, 16) END AS content_id FROM s0")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    marked = F.regexp_replace("text", r"([.!?\x{2026}])\s+", "$1\n")
    kept = F.filter(F.transform(F.split(marked, "\n"), T.strip), lambda s: F.length(s) >= 10)
    return table(spark, d, "documents").select("doc_id", E.content_id(kept).alias("content_id"))


_LANG = r"CASE WHEN regexp_matches(sentence, '[\x{00C0}-\x{024F}]') THEN 'x' ELSE 'en' END"


def _decision(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("sentence").rlike(r"[\x{00C0}-\x{024F}]"), "x").otherwise("en")
    return E.document_decision(_sentences(spark, d).withColumn("l", lang), "doc_id", "l", "x", "en")


_DECIDE = f"""{_SENT}, l AS (SELECT doc_id, {_LANG} AS l FROM s), g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (l = 'x') AS n_main, count(*) FILTER (l = 'en') AS n_drop FROM l GROUP BY doc_id),
 dec AS (SELECT *, CASE WHEN n_main * 2 >= n THEN 'x' ELSE 'other' END AS tag FROM g WHERE n >= 2 AND n_drop / n < 0.5)"""


@query(f"WITH {_DECIDE} SELECT * FROM dec")
def doc_language_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decision(spark, d)


@query(f"WITH {_DECIDE} SELECT source, tag, count(*) AS docs, cast(sum(n) AS BIGINT) AS sentences FROM documents JOIN dec USING (doc_id) GROUP BY ALL")
def doc_decision_join(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source").join(_decision(spark, d), "doc_id")
    return joined.groupBy("source", "tag").agg(F.count("*").alias("docs"), F.sum("n").alias("sentences"))


@query(rf"WITH {_SENT} SELECT count(*) AS n, count(*) FILTER ({_STRIP.format('sentence')} = '' OR length(sentence) > 512 OR len(regexp_extract_all(sentence, '\S+')) < 3 OR (length(replace(sentence, ' ', '')) - len(regexp_extract_all(replace(sentence, ' ', ''), '\p{{L}}'))) / greatest(length(replace(sentence, ' ', '')), 1) > 0.3) AS noisy FROM s")
def noisy_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).agg(F.count("*").alias("n"), F.count_if(R.noisy(F.col("sentence"))).alias("noisy"))


@query(
    rf"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda q: {_STRIP.format("q")}) AS p FROM documents)
 SELECT doc_id, md5({_STRIP.format(r"array_to_string(list_transform(p, lambda q: regexp_replace(q, '([.!?])\s+([\p{Lu}\p{Nd}" + chr(34) + r"])', '\1 \2', 'g')), chr(10))")}) AS h FROM p"""
)
def reassemble_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return E.reassemble(E.paragraph_sentences(table(spark, d, "documents"), "doc_id"), "doc_id").select("doc_id", F.md5("text").alias("h"))


@query(
    f"""WITH {_SENT}, t AS (SELECT doc_id, sent_idx, CASE WHEN sent_idx % 3 = 0 THEN NULL ELSE length(sentence) % 10 / 10.0::DOUBLE END AS conf FROM s)
 SELECT doc_id, count(*) AS total, count(conf) AS translated, count(*) - count(conf) AS skipped, min(conf) AS least FROM t GROUP BY doc_id"""
)
def translation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sentences left-joined with translations; a document's totals and least confidence."""
    s = _sentences(spark, d)
    done = s.where("sent_idx % 3 <> 0").select("doc_id", "sent_idx", (F.length("sentence") % 10 / F.lit(10.0)).alias("conf"))
    joined = s.select("doc_id", "sent_idx").join(done, ["doc_id", "sent_idx"], "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("conf").alias("translated"), F.count_if(F.col("conf").isNull()).alias("skipped"), F.min("conf").alias("least"))


@query(f"WITH {_SENT} SELECT doc_id, md5(max(CASE WHEN sent_idx = 0 THEN sentence END)) AS a, md5(max(CASE WHEN sent_idx = 1 THEN sentence END)) AS b FROM s GROUP BY doc_id HAVING count(*) FILTER (sent_idx < 2) = 2")
def parallel_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = _sentences(spark, d).groupBy("doc_id").pivot("sent_idx", [0, 1]).agg(F.max("sentence"))
    return wide.where("`0` IS NOT NULL AND `1` IS NOT NULL").select("doc_id", F.md5("0").alias("a"), F.md5("1").alias("b"))


_CHAT = f"""m AS (SELECT conv_id, turn, role, {_STRIP.format("text")} AS content FROM conversations), c AS (SELECT conv_id, list({{'role': role, 'content': content}} ORDER BY turn, role, content) AS m FROM m WHERE content <> '' AND role IN ('user', 'assistant', 'system') GROUP BY conv_id)"""


def _chat(spark: SparkSession, d: str) -> DataFrame:
    renamed = table(spark, d, "conversations").withColumn("role", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")))
    return E.messages(renamed, "conv_id", "turn")


@query(f"WITH {_CHAT} SELECT conv_id, md5(array_to_string(list_transform(m, lambda x: '<|' || x.role || '|>' || x.content || '<|end|>'), '')) AS h, len(list_filter(m, lambda x: x.role = 'assistant')) AS answers, len(list_filter(m, lambda x: x.role <> 'system')) AS turns FROM c")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return _chat(spark, d).select("conv_id", F.md5(E.markup(m)).alias("h"), E.turns(m, "assistant").alias("answers"), E.turns(m, "user", "assistant").alias("turns"))


@query(f"WITH {_CHAT}, f AS (SELECT conv_id, list_filter(m, lambda x: x.role = 'user')[1].content AS q FROM c) SELECT min(conv_id) AS conv_id, md5(q) AS h FROM f WHERE q IS NOT NULL AND length(q) >= 10 GROUP BY q")
def chat_dedup_first_user(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.dedup import keep_first

    first = _chat(spark, d).select("conv_id", E.first_of(F.col("messages"), "user").alias("q")).where("length(q) >= 10")
    return keep_first(first, "q", ["conv_id"]).select("conv_id", F.md5("q").alias("h"))


@query(f"WITH {_CHAT} SELECT conv_id, md5(list_filter(m, lambda x: x.role = 'user')[1].content || '|' || list_filter(m, lambda x: x.role = 'assistant')[1].content) AS h FROM c WHERE len(list_filter(m, lambda x: x.role = 'user')) > 0 AND len(list_filter(m, lambda x: x.role = 'assistant')) > 0")
def first_exchange(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    pair = _chat(spark, d).select("conv_id", E.first_of(m, "user").alias("q"), E.first_of(m, "assistant").alias("a")).where("q IS NOT NULL AND a IS NOT NULL")
    return pair.select("conv_id", F.md5(F.concat_ws("|", "q", "a")).alias("h"))


@query("SELECT item_id, md5('<|user|>Read.' || chr(10) || chr(10) || text || '<|end|><|assistant|>' || length(text) || '<|end|>') AS h FROM benchmark")
def alpaca_to_chat(spark: SparkSession, d: str) -> DataFrame:
    chat = E.exchange(F.concat_ws("\n\n", F.lit("Read."), "text"), F.length("text").cast("string"))
    return table(spark, d, "benchmark").select("item_id", F.md5(E.markup(chat)).alias("h"))


@query(
    """WITH RECURSIVE n AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN doc_id - 1 - doc_id % 3 % (doc_id % 10) END AS parent, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS rank, md5(text) AS text FROM documents),
 c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY rank IS NULL, coalesce(rank, 0), id) AS k FROM n WHERE parent IS NOT NULL) WHERE k = 1),
 p AS (SELECT id AS root, id AS last, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT root, c.id, depth + 1 FROM p JOIN c ON c.parent = p.last)
 SELECT root, max(depth) AS depth, arg_max(last, depth) AS leaf FROM p GROUP BY root"""
)
def best_path_tree(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    parent = F.when(i % 10 != 0, i - 1 - i % 3 % F.nullif(i % 10, F.lit(0)))
    nodes = table(spark, d, "documents").select(i.alias("id"), parent.alias("parent"), F.when(i % 4 > 0, i % 4).cast("int").alias("rank"), F.md5("text").alias("text"))
    return E.best_paths(nodes).select("root", "depth", F.col("end").alias("leaf"))


_TOKENS = r"t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS id FROM (SELECT unnest(w) AS w FROM t) GROUP BY w)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """Documents with ids of a cheap tokenizer: the lengths of their words."""
    return table(spark, d, "documents").select("doc_id", "lang", F.transform(T.words(F.col("text")), lambda w: F.length(w).cast("long")).alias("ids"))


_PACK = r"""i AS (SELECT doc_id, lang, list_append(list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)), 0) AS ids FROM documents),
 x AS (SELECT doc_id, lang, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM i), p AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM x),
 b AS (SELECT pos // 256 AS block, md5(string_agg(cast(id AS VARCHAR), ',' ORDER BY pos)) AS h, arg_max(lang, pos) AS lang FROM p GROUP BY 1 HAVING count(*) = 256)"""


@query(f"WITH {_PACK} SELECT block, h FROM b")
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.pack(_ids(spark, d), "doc_id", "ids", 256, 0).select("block", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("h"))


@query(f"WITH {_PACK} SELECT block, h, lang FROM b")
def pack_domain_blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.pack(_ids(spark, d), "doc_id", "ids", 256, 0, "lang").select("block", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("h"), "lang")


@query(r"WITH i AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)) AS ids FROM documents) SELECT doc_id, list_position(ids, 7) AS masked, md5(array_to_string(list_transform(range(1, len(ids) + 1), lambda k: CASE WHEN k <= list_position(ids, 7) THEN -100 ELSE ids[k] END), ',')) AS h FROM i WHERE list_position(ids, 7) > 0")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    ids = _ids(spark, d)
    masked = ids.select("doc_id", F.array_position("ids", F.lit(7)).cast("int").alias("masked"), P.label_mask(F.col("ids"), 7).alias("m"))
    return masked.where("m IS NOT NULL").select("doc_id", "masked", F.md5(F.array_join(F.col("m").cast("array<string>"), ",")).alias("h"))


@query(rf"WITH {_TOKENS} SELECT w AS token, id FROM v WHERE id < 50")
def top_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    counts = table(spark, d, "documents").select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(50)
    return top.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1).cast("long").alias("id"))


_PAIR = """k AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g') AS text FROM benchmark), p AS (SELECT item_id, text AS s, CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'i') WHEN 2 THEN '' WHEN 3 THEN concat(text, ' one two three four five') WHEN 4 THEN upper(substr(text, 1, 5)) || substr(text, 6) ELSE reverse(text) END AS t FROM k)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Items and changed copies, in ASCII: DuckDB's edit distance counts bytes."""
    i, t = F.col("item_id") % 6, F.regexp_replace("text", r"[^\x00-\x7f]", "x")
    changed = F.when(i == 0, t).when(i == 1, F.replace(t, F.lit("e"), F.lit("i"))).when(i == 2, "").when(i == 3, F.concat(t, F.lit(" one two three four five"))).when(i == 4, F.concat(F.upper(F.substring(t, 1, 5)), F.substring(t, 6, 100000))).otherwise(F.reverse(t))
    return table(spark, d, "benchmark").select("item_id", t.alias("s"), changed.alias("t"))


_LW = r"regexp_extract_all(lower({0}), '\S+')"


@query(
    rf"""WITH {_PAIR} SELECT item_id, CASE WHEN {_STRIP.format("s")} = '' OR {_STRIP.format("t")} = '' THEN 'empty' WHEN s = t THEN 'identity'
 WHEN len(regexp_extract_all(t, '[A-Za-z\x{{00C0}}-\x{{024F}}]')) / greatest(len(regexp_extract_all(t, '\p{{L}}')), 1) < 0.7 THEN 'script'
 WHEN abs(len(regexp_extract_all(s, '\S+')) - len(regexp_extract_all(t, '\S+'))) > 3 THEN 'length'
 WHEN len(list_intersect({_LW.format("s")}, {_LW.format("t")})) / greatest(len(list_distinct({_LW.format("s")})), 1) < 0.45 THEN 'overlap'
 WHEN levenshtein(s, t) = 0 THEN 'no_edit' WHEN levenshtein(s, t) > greatest(16, floor(length(s) * 0.35)) THEN 'too_far' ELSE 'ok' END AS reason FROM p"""
)
def pair_validate(spark: SparkSession, d: str) -> DataFrame:
    from ..profile import LATIN

    return G.cascade(_pairs(spark, d), R.pair_gates(F.col("s"), F.col("t"), LATIN.script)).select("item_id", "reason")


@query(
    rf"""WITH {_PAIR}, w AS (SELECT item_id, s, t, {_LW.format("s")} AS a, {_LW.format("t")} AS b FROM p) SELECT item_id, CASE WHEN s = t THEN 'identity' WHEN list_sort(a) = list_sort(b) THEN 'word_order' WHEN len(a) <> len(b) THEN 'mixed'
 WHEN len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i] AND substr(a[i], 1, 3) <> substr(b[i], 1, 3))) = 0 THEN 'morphology' ELSE 'orthography' END AS class FROM w"""
)
def error_class(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("item_id", R.error_class(F.col("s"), F.col("t")).alias("class"))


@query(f"WITH {_PAIR} SELECT item_id, CASE WHEN length(s) = 0 THEN cast(length(t) > 0 AS BIGINT) ELSE levenshtein(t, s) END AS edits, greatest(length(s), 1) AS size FROM p")
def edit_distance_cer(spark: SparkSession, d: str) -> DataFrame:
    edits, size = R.cer_parts(F.col("t"), F.col("s"))
    return _pairs(spark, d).select("item_id", edits.alias("edits"), size.alias("size"))


@query()
def word_f05(spark: SparkSession, d: str) -> DataFrame:
    scored = R.edit_scores(_pairs(spark, d).withColumn("r", F.replace("s", F.lit("a"), F.lit("o"))), "s", "t", "r")
    return scored.select("item_id", "tp", "fp", "fn", R.f_half(F.col("tp"), F.col("fp"), F.col("fn")).alias("f"))


@query()
def bad_translations(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return pairs.select("item_id", R.bad_translation(F.col("s"), F.col("t"), A.likeness(F.col("s"), F.col("t"))).alias("bad"))


@query(
    rf"""SELECT doc_id FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n FROM documents) WHERE n BETWEEN 6 AND 30 AND regexp_matches(text, '^\p{{Lu}}') AND regexp_matches(text, '[.!?]$')
 AND NOT (contains(text, 'http') OR contains(text, 'www') OR contains(text, '@') OR contains(text, '|')) AND len(regexp_extract_all(text, '[0-9]')) <= greatest(3.0, length(text) * 0.1)"""
)
def seed_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(G.seed_sentence(F.col("text"))).select("doc_id")


@query(f"WITH {_PAIR} SELECT DISTINCT s, t FROM p WHERE length(s) BETWEEN 3 AND 5000 AND length(t) BETWEEN 3 AND 5000 AND s <> t")
def pair_clean_dedup(spark: SparkSession, d: str) -> DataFrame:
    sides = F.length("s").between(3, 5000) & F.length("t").between(3, 5000)
    return _pairs(spark, d).where(sides & (F.col("s") != F.col("t"))).select("s", "t").distinct()


@query()
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Word edits and reference words of each pair, and an n-gram overlap."""
    return _pairs(spark, d).select("item_id", C.word_distance(F.col("t"), F.col("s")).alias("edits"), T.word_count(F.col("s")).alias("words"), C.ngram_overlap(F.col("t"), F.col("s")).alias("overlap"))


@query(f"WITH {_PAIR} SELECT item_id, array_to_string(regexp_extract_all(t, '\\S+'), ' ') AS t FROM p")
def edit_tag_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tags that turn a source into its target, applied: the target's words again."""
    tagged = _pairs(spark, d).withColumn("tags", C.edit_tags(F.col("s"), F.col("t")))
    return tagged.select("item_id", C.apply_tags(F.col("s"), F.col("tags")).alias("t"))


@query()
def edit_tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent edit tags."""
    tags = _pairs(spark, d).select(F.explode(C.edit_tags(F.col("s"), F.col("t"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.orderBy(F.desc("n"), "tag").limit(20)
