"""Queries on sentence pairs: validation, taxonomy, corpus scores, adapters and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adapters as D
from ..operators import assembly as A
from ..operators import gates as G
from ..operators import gec as C
from ..operators import pairs as R
from ..operators import structure as E
from ..profile import LATIN
from ..sources.work import saved
from .registry import edit_distance, query, table
from .structure import _SENT

#: Pairs of each document sentence and what a rule on ids makes of it: the same, a word less, lower case, two words swapped, a letter less.
_PAIRS = rf"""{_SENT}, w AS (SELECT doc_id, sent_idx, sentence AS s, regexp_extract_all(sentence, '\S+') AS w, (doc_id + sent_idx) % 5 AS k FROM s),
 p AS (SELECT doc_id, sent_idx, s, CASE k WHEN 0 THEN s WHEN 1 THEN array_to_string(list_filter(w, lambda x, i: i <> 2), ' ') WHEN 2 THEN lower(s) WHEN 3 THEN CASE WHEN len(w) >= 2 THEN array_to_string(list_concat([w[2], w[1]], w[3:]), ' ') ELSE s END ELSE replace(s, 'th', 't') END AS t FROM w)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("s"), (F.col("doc_id") + F.col("sent_idx")) % 5
    rows = E.sentences(table(spark, d, "documents"), "doc_id").select("doc_id", "sent_idx", F.col("sentence").alias("s"))

    def changed(w: Column) -> Column:
        swapped = F.when(F.size(w) >= 2, F.array_join(F.concat(F.array(F.get(w, 1), F.get(w, 0)), F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1)))), " ")).otherwise(s)
        return F.when(k == 0, s).when(k == 1, F.array_join(F.filter(w, lambda _, i: i != 1), " ")).when(k == 2, F.lower(s)).when(k == 3, swapped).otherwise(F.replace(s, F.lit("th"), F.lit("t")))

    return saved(rows.withColumn("t", T.let(T.words(s), changed)))  # else each use of t would make it again


_LW = r"regexp_extract_all(lower({0}), '\S+')"
#: The pairs with their lower-case words, listed once.
_LISTED = f"q AS (SELECT *, {_LW.format('s')} AS ls, {_LW.format('t')} AS lt FROM p)"
_NEG = """len(ls) = len(lt) AND len(list_filter(list_zip(ls, lt), lambda x: x[1] <> x[2] AND regexp_matches(x[1], 'un|th') <> regexp_matches(x[2], 'un|th')
 AND len(list_filter(range(1, least(length(x[1]), length(x[2])) + 1), lambda j: substr(x[1], j, 1) = substr(x[2], j, 1))) >= 2)) > 0"""
_AFFIXES = ("un", "th")


@query(f"WITH {_PAIRS}, {_LISTED} SELECT doc_id, sent_idx, {_NEG} AS shifted FROM q")
def negation_shifts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", "sent_idx", F.coalesce(C.negation_shift(F.col("s"), F.col("t"), _AFFIXES), F.lit(False)).alias("shifted"))


_N = r"len(regexp_extract_all({0}, '\S+'))"
_VALID = rf"""CASE WHEN regexp_replace(s, '^\s+|\s+$', '', 'g') = '' OR regexp_replace(t, '^\s+|\s+$', '', 'g') = '' THEN 'empty' WHEN s = t THEN 'identity'
 WHEN len(regexp_extract_all(t, '[{LATIN.script}]')) / greatest(len(regexp_extract_all(t, '\p{{L}}')), 1) < 0.7 THEN 'script' WHEN abs({_N.format("s")} - {_N.format("t")}) > 3 THEN 'length'
 WHEN len(list_intersect({_LW.format("s")}, {_LW.format("t")})) / greatest(len(list_distinct({_LW.format("s")})), 1) < 0.45 THEN 'overlap' WHEN {_NEG} THEN 'negation' WHEN {edit_distance('s', 't')} > greatest(16, floor(length(s) * 0.35)) THEN 'too_far' ELSE 'ok' END"""


@query(f"WITH {_PAIRS}, {_LISTED} SELECT reason, count(*) AS n FROM (SELECT {_VALID} AS reason FROM q) GROUP BY reason")
def pair_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Of all documents' sentences, with the negation gate."""
    s, t = F.col("s"), F.col("t")
    return G.funnel(G.cascade(_pairs(spark, d), R.pair_gates(s, t, LATIN.script, negation=C.negation_shift(s, t, _AFFIXES))))


_BARE = r"regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')"
_TAGGED = rf"""f AS (SELECT *, regexp_extract_all(s, '\S+') AS a, regexp_extract_all(t, '\S+') AS b FROM p), g AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])[1] AS i FROM f), h AS (SELECT *, a[i] AS x, b[i] AS y FROM g),
 c AS (SELECT doc_id, sent_idx, CASE WHEN s = t THEN 'none' WHEN len(a) < len(b) THEN 'lexis/count/missing' WHEN len(a) > len(b) THEN 'lexis/count/extra' WHEN list_sort(a) = list_sort(b) AND i IS NOT NULL THEN 'order/words/swap' WHEN i IS NULL THEN 'orthography/punctuation/space'
 WHEN lower(x) = lower(y) THEN 'orthography/case/letter' WHEN {_BARE.format("x")} = {_BARE.format("y")} THEN 'orthography/punctuation/mark' WHEN substr(x, 1, 3) = substr(y, 1, 3) AND length(x) > 3 AND length(y) > 3 AND right(x, 2) <> right(y, 2) THEN 'morphology/suffix/changed'
 WHEN {edit_distance('x', 'y')} <= 2 THEN 'orthography/spelling/letter' ELSE 'lexis/word/choice' END AS tag FROM h)"""


@query(f"WITH {_PAIRS}, {_TAGGED} SELECT * FROM c")
def taxonomy_classes(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", "sent_idx", C.classify(F.col("s"), F.col("t")).alias("tag"))


@query(
    f"""WITH {_PAIRS}, {_TAGGED}, l AS (SELECT string_split(tag, '/') AS l FROM c) SELECT l[1] AS one, CASE WHEN len(l) >= 2 THEN l[1] || '/' || l[2] END AS two, CASE WHEN len(l) >= 3 THEN array_to_string(l[1:3], '/') END AS three, count(*) AS n FROM l GROUP BY ALL"""
)
def taxonomy_levels(spark: SparkSession, d: str) -> DataFrame:
    one, two, three = C.tag_levels(F.col("tag"))
    return taxonomy_classes(spark, d).groupBy(one.alias("one"), two.alias("two"), three.alias("three")).agg(F.count("*").alias("n"))


#: The corrupted side is the source, the sentence the reference, and the hypothesis right for every other document.
_HYP = f"""{_PAIRS}, x AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN s ELSE t END AS h FROM p), y AS (SELECT doc_id, sent_idx, s, t, h, h = s AS exact, {edit_distance('h', 's')} / greatest(length(s), 1) AS cer,
 list_distinct(list_filter({_LW.format("h")}, lambda v: NOT list_contains({_LW.format("t")}, v))) AS made, list_distinct(list_filter({_LW.format("s")}, lambda v: NOT list_contains({_LW.format("t")}, v))) AS wanted FROM x),
 z AS (SELECT *, len(list_intersect(made, wanted)) AS tp, len(made) - len(list_intersect(made, wanted)) AS fp, len(wanted) - len(list_intersect(made, wanted)) AS fn FROM y)"""


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).withColumn("h", F.when(F.col("doc_id") % 2 == 0, F.col("s")).otherwise(F.col("t")))
    distance, length = R.cer_parts(F.col("h"), F.col("s"))
    made, wanted = (F.array_except(R.lower_words(F.col(x)), R.lower_words(F.col("t"))) for x in "hs")
    rows = rows.withColumns({"exact": F.col("h") == F.col("s"), "cer": distance / length, "made": made, "wanted": wanted})
    tp = F.size(F.array_intersect("made", "wanted"))
    return rows.withColumns({"tp": tp, "fp": F.size("made") - tp, "fn": F.size("wanted") - tp})


@query(
    f"WITH {_HYP} SELECT CASE WHEN s = t THEN 'identity' ELSE 'error' END AS kind, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(fn) AS BIGINT) AS fn, sum(tp) / greatest(sum(tp + fp), 1) AS \"precision\", sum(tp) / greatest(sum(tp + fn), 1) AS recall,"
    " CASE WHEN sum(tp + fp + fn) = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * sum(tp) / (1.25::DOUBLE * sum(tp) + 0.25::DOUBLE * sum(fn) + sum(fp)) END AS f05 FROM z GROUP BY 1"
)
def corpus_f05(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("s") == F.col("t"), "identity").otherwise("error")
    return C.corpus_scores(_hypotheses(spark, d).withColumn("kind", kind), ["kind"])


@query(f"WITH {_HYP}, {_TAGGED} SELECT string_split(tag, '/')[1] AS level, count(*) AS n, round(avg(CASE WHEN exact THEN 1 ELSE 0 END), 9) AS exact, round(avg(cer), 9) AS cer FROM z JOIN c USING (doc_id, sent_idx) GROUP BY 1")
def mean_scores_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches (of identity pairs: what is left as it was) and character errors by the first level of the taxonomy."""
    rows = _hypotheses(spark, d).withColumns({"level": C.tag_levels(C.classify(F.col("s"), F.col("t")))[0], "exact": F.col("exact").cast("double")})
    return C.mean_scores(rows, ["level"], ["exact", "cer"]).withColumns({c: F.round(c, 9) for c in ("exact", "cer")})


@query(
    f"WITH {_HYP}, r AS (SELECT doc_id, exact, cer, CASE WHEN tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * tp / (1.25::DOUBLE * tp + 0.25::DOUBLE * fn + fp) END AS f05, len(list_intersect({_LW.format('h')}, {_LW.format('s')})) / greatest(len(list_distinct({_LW.format('h')})), 1) AS gleu FROM z)"
    " SELECT doc_id, max(f05) AS f05, min(cer) AS cer, bool_or(exact) AS exact, round(avg(gleu), 9) AS gleu FROM r GROUP BY doc_id"
)
def multi_reference_scores(spark: SparkSession, d: str) -> DataFrame:
    """A document's sentences stand in for references, the overlap of words for GLEU."""
    rows = _hypotheses(spark, d).select("doc_id", "exact", "cer", R.f_half(F.col("tp"), F.col("fp"), F.col("fn")).alias("f05"), T.overlap(R.lower_words(F.col("h")), R.lower_words(F.col("s"))).alias("gleu"))
    return C.multi_reference(rows, "doc_id").withColumn("gleu", F.round("gleu", 9))


@query()
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = _hypotheses(spark, d).groupBy("doc_id").agg(F.avg("cer").alias("a"), F.lit(0.05).alias("b"))
    return C.paired_bootstrap(rows, "doc_id", "a", "b", 200)


@query()
def synthetic_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = E.sentences(table(spark, d, "documents"), "doc_id").select(F.concat_ws(":", "doc_id", "sent_idx").alias("id"), F.col("sentence").alias("target"))
    return C.synthetic_errors(rows, "id", "target").select("id", "input", F.array_join("error_tags", ",").alias("tags"))


@query(f"WITH {_PAIRS} SELECT doc_id, sent_idx, md5('<TASK_FIX><SRC>' || t || '<SEP>' || s) AS h FROM p")
def correction_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", "sent_idx", F.md5(C.task_prompt(F.col("t"), F.col("s"))).alias("h"))


_FIRST = "f AS (SELECT conv_id AS id, arg_min(text, turn) FILTER (role = 'user') AS q, arg_min(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)"


@query(
    f"""WITH {_FIRST}, u AS (SELECT id, 'dolly' AS source, CASE WHEN id % 2 = 0 THEN q || chr(10) || chr(10) || 'Context: ' || a ELSE q END AS x, a FROM f UNION ALL SELECT id, 'alpaca', CASE WHEN id % 2 = 0 THEN q || chr(10) || chr(10) || a ELSE q END, a FROM f UNION ALL SELECT id, 'prompt_response', q, a FROM f)
 SELECT id, source, md5('<|user|>' || x || '<|end|><|assistant|>' || a || '<|end|>') AS h FROM u WHERE x IS NOT NULL AND a IS NOT NULL"""
)
def adapted_sets(spark: SparkSession, d: str) -> DataFrame:
    """First exchanges as three instruction formats, by the registered adapters."""
    t = table(spark, d, "conversations")
    first = t.groupBy(F.col("conv_id").alias("id")).agg(*(F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn"))).alias(c) for r, c in (("user", "q"), ("assistant", "a")))).where("q IS NOT NULL AND a IS NOT NULL")
    more = F.when(F.col("id") % 2 == 0, F.col("a")).otherwise("")
    q, a = F.col("q"), F.col("a")
    sets = {
        "dolly": first.select("id", q.alias("instruction"), more.alias("context"), a.alias("response")),
        "alpaca": first.select("id", q.alias("instruction"), more.alias("input"), a.alias("output")),
        "prompt_response": first.select("id", q.alias("prompt"), a.alias("response")),
    }
    out = None
    for kind, df in sets.items():
        rows = D.adapted(df, kind).select("id", "source", F.md5(E.markup(F.col("messages"))).alias("h"))
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT conv_id, array_to_string(list(role || '=' || md5(content) ORDER BY turn), ',') AS turns FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' END AS role, trim(text) AS content FROM conversations) WHERE role IS NOT NULL AND content <> '' GROUP BY conv_id")
def sharegpt_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns as that format has them (human, gpt), back as messages."""
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("from"), F.col("text").alias("value")))).alias("conversations"))
    found = turns.select("conv_id", D.share_gpt(F.col("conversations")).alias("m")).where(F.size("m") > 0)
    return found.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit("="), F.md5(m["content"]))), ",").alias("turns"))


@query(
    f"""WITH {_FIRST} SELECT id, md5('### Instruction:' || chr(10) || q || chr(10) || chr(10) || '### Response:' || chr(10) || a) AS instruction, md5('Context: ' || a || chr(10) || 'Question: ' || q || chr(10) || 'Answer: ' || substr(a, 1, 9)) AS question,
 md5(q || chr(10) || 'A) yes' || chr(10) || 'B) no' || chr(10) || 'Answer: ' || CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END) AS choice FROM f WHERE q IS NOT NULL AND a IS NOT NULL"""
)
def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    first = t.groupBy(F.col("conv_id").alias("id")).agg(*(F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn"))).alias(c) for r, c in (("user", "q"), ("assistant", "a")))).where("q IS NOT NULL AND a IS NOT NULL")
    q, a = F.col("q"), F.col("a")
    choice = D.choice_prompt(q, F.array(F.lit("yes"), F.lit("no")), (F.col("id") % 2).cast("int"))
    return first.select("id", F.md5(D.instruction_prompt(q, a)).alias("instruction"), F.md5(D.question_prompt(a, q, F.substring(a, 1, 9))).alias("question"), F.md5(choice).alias("choice"))


@query(f"WITH {_PAIRS} SELECT doc_id, sent_idx, md5(s || '|' || t) AS h FROM p WHERE s <> ''")
def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written as labelled blocks of one answer a document, and read from it."""
    block = F.concat(F.lit("WRONG: "), F.col("s"), F.lit("\nRIGHT: "), F.col("t"), F.lit("\n"))
    answers = _pairs(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", block.alias("b")))), lambda x: x["b"]), "").alias("answer"))
    found = answers.select("doc_id", F.posexplode(C.labelled_blocks(F.col("answer"), "WRONG:", "RIGHT:")).alias("sent_idx", "x"))
    return found.select("doc_id", "sent_idx", F.md5(F.concat_ws("|", "x.wrong", "x.right")).alias("h"))


@query("SELECT conv_id, turn, md5(text || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '- ' || role) AS h, cast(1 AS BIGINT) AS code FROM conversations")
def chat_segments(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks and Markdown prefixes apart from what a translator changes, and put together again."""
    text = F.concat("text", F.lit("\n```py\nx = 1\n```\n- "), "role")
    parts = table(spark, d, "conversations").select("conv_id", "turn", A.segments(text).alias("p"))
    code = F.size(F.filter(F.flatten("p"), lambda s: s["kind"] == "code")).cast("long")
    return parts.select("conv_id", "turn", F.md5(A.reassembled(F.col("p"))).alias("h"), code.alias("code"))
