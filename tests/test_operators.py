"""Literals, edge rows and laws of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import arrow as A
from corpuslab.functions import scores as C
from corpuslab.functions import text as T
from corpuslab.operators import dedup as D
from corpuslab.operators import leaderboard as L
from corpuslab.operators import packing as P
from corpuslab.operators import pairs as R
from corpuslab.operators import sampling as S
from corpuslab.operators import structure as E
from corpuslab.sources import readers, writers

EDGES = [None, "", "   ", " ", "é", "😀", "�", "\x01", "a\r\nb", "word", "one two three four", "one two three four five"]


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "edits", "size"), [("hello", "hello", 0, 5), ("abc", "xyz", 3, 3), ("helo", "hello", 1, 5), ("a", "", 1, 1), ("", "", 0, 1)])
def test_character_errors(spark, a, b, edits, size):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(*(c.alias(n) for c, n in zip(R.cer_parts(F.col("a"), F.col("b")), "es"))).first()
    assert (row.e, row.s) == (edits, size)


def test_word_edits(spark):
    assert one(spark, A.word_edits(F.col("a"), F.col("b")), a="a b c", b="a b c") == []
    edits = one(spark, A.word_edits(F.col("a"), F.col("b")), a="a b c", b="a x c")
    assert sorted((e["op"], e["word"]) for e in edits) == [("delete", "b"), ("insert", "x")]


def test_word_scores(spark):
    assert one(spark, C.word_distance(F.col("a"), F.col("b")), a="a b c", b="a x c d") == 2
    assert one(spark, C.ngram_overlap(F.col("a"), F.col("b")), a="a b", b="a b") == 1.0
    assert one(spark, C.ngram_overlap(F.col("a"), F.col("b")), a="a b", b="c") == 0.0
    assert one(spark, C.edit_tags(F.col("a"), F.col("b")), a="a b c", b="z a x c") == ["$KEEP $APPEND_z", "$KEEP", "$DELETE $APPEND_x", "$KEEP"]


def test_f_half(spark):
    rows = spark.createDataFrame([("a b", "a c", "a c"), ("a b", "a b", "a c")], "s string, h string, r string")
    found = [r.f for r in R.edit_scores(rows, "s", "h", "r").select(R.f_half(F.col("tp"), F.col("fp"), F.col("fn")).alias("f")).collect()]
    assert found == [1.0, 0.0]


def test_edge_rows_do_not_fail(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "id int, t string")
    t = F.col("t")
    columns = [T.normalise(t), T.collapse(t), T.truncate(t, 3), T.special_ratio(t), T.url_density(t), T.ngrams(T.words(t), 5), T.char_ngrams(t, 2), A.unicode_form(t), A.gzip_ratio(t), A.spoken(t), A.likeness(t, t)]
    rows = df.select("id", *(c.alias(f"c{i}") for i, c in enumerate(columns))).orderBy("id").collect()
    assert rows[0].c0 is None and rows[1].c8 == 1.0
    assert rows[-1].c5 == ["one two three four five"] and rows[-2].c5 == []
    assert rows[4].c7 == "é"
    again = df.select(T.normalise(T.normalise(t)).alias("a"), T.normalise(t).alias("b")).collect()
    assert all(r.a == r.b for r in again)


def test_truncate(spark):
    assert one(spark, T.truncate(F.col("a"), 12), a="first\n\nsecond line") == "first"
    assert one(spark, T.truncate(F.col("a"), 12), a="first\nsecond line") == "first"
    assert one(spark, T.truncate(F.col("a"), 4), a="abcdefgh") == "abcd"


def test_spoken(spark):
    assert one(spark, A.spoken(F.col("a")), a="“5” – 1200") == '"five" - one thousand two hundred'


def test_greedy_keep(spark, data):
    docs = D.keep_first(spark.read.parquet(f"{data}/documents.parquet"), "text", ["doc_id"])
    pairs = D.exact_pairs(docs, "doc_id", "text", 5, 0.3)
    kept = {r[0] for r in D.greedy_keep(docs.select("doc_id"), pairs).collect()}
    near = {}
    for r in pairs.collect():
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    expected = set()
    for (i,) in docs.select("doc_id").orderBy("doc_id").collect():
        if not near.get(i, set()) & expected:
            expected.add(i)
    assert near and kept == expected
    # Pairs against all pairs.
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in docs.collect() for w in [r.text.split()]}
    brute = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.3 * len(sets[a] | sets[b])}
    assert brute == {(r.a, r.b) for r in pairs.collect()}


def test_samples_do_not_depend_on_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(S.sample_per_group(docs, "lang", "doc_id", 3)) == ids(S.sample_per_group(docs.repartition(7), "lang", "doc_id", 3))
    assert len(ids(S.sample_per_group(docs, "lang", "doc_id", 3, seed=1))) == 12


def test_pack_round_trip(spark):
    docs = spark.createDataFrame([(i, list(range(1, i + 1))) for i in (3, 0, 5, 2)] + [(9, None)], "k bigint, ids array<bigint>")
    blocks = [r.ids for r in P.pack(docs, "k", "ids", 4, 0).orderBy("block").collect()]
    assert sum(blocks, []) == [0, 1, 2, 0, 1, 2, 3, 0, 1, 2, 3, 4]


def test_label_mask(spark):
    row = spark.createDataFrame([([5, 7, 1, 7],), ([1, 2],)], "ids array<bigint>").select(P.label_mask(F.col("ids"), 7).alias("m")).collect()
    assert row[0].m == [-100, -100, 1, 7] and row[1].m is None


def test_tree(spark):
    nodes = spark.createDataFrame([(1, None, None, "q"), (2, 1, 1, "b"), (3, 1, 0, "a"), (4, 3, None, "x"), (5, 3, 2, "y"), (6, None, None, "r")], "id bigint, parent bigint, rank int, text string")
    assert {r.root: r.path for r in E.best_paths(nodes).collect()} == {1: ["q", "a", "y"], 6: ["r"]}


def test_reassemble(spark):
    df = spark.createDataFrame([(1, "One. Two!\n\nThree? four."), (2, ""), (3, None)], "id int, text string")
    assert {r.id: r.text for r in E.reassemble(E.paragraph_sentences(df, "id"), "id").collect()} == {1: "One. Two!\n\nThree? four.", 2: "", 3: ""}


def test_merge_capped(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.5, 4.0), (1, 4.1, 9.0), (1, 20.0, 21.0)], "v int, a double, b double")
    assert sorted((r.a, r.b) for r in L.merge_capped(df, "v", "a", "b", 1.0, 5.0).collect()) == [(0.0, 4.0), (4.1, 9.0), (20.0, 21.0)]


def test_elo_orders_models(spark):
    games = [("a", "b", "model_a")] * 8 + [("a", "b", "model_b")] * 2 + [("b", "c", "model_a")] * 7 + [("b", "c", "tie")] * 4
    elo = dict(L.bradley_terry(L.win_counts(spark.createDataFrame(games, "model_a string, model_b string, winner string")), "a"))
    assert elo["a"] == pytest.approx(1000) and elo["a"] > elo["b"] > elo["c"]
    assert elo["a"] - elo["b"] == pytest.approx(400 * 0.6020599, abs=0.01)


def test_spans(spark):
    df = spark.createDataFrame([(1, i, t, w) for i, (t, w) in enumerate([("B-P", "x"), ("I-P", "y"), ("O", "z"), ("I-L", "u"), ("B-L", "v")])], "k int, i int, t string, w string")
    assert sorted(r.entity for r in L.spans(df, "k", "i", "t", "w").collect()) == ["u", "v", "x y"]


def test_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\ntwo\n\n\nthree\n")
    assert [r.text for r in readers.read_paragraphs(spark, str(tmp_path / "p.txt")).orderBy("pos").collect()] == ["one\ntwo", "three"]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in "ab") + "\n\n")
    assert readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "text string").count() == 2
    (tmp_path / "t.tsv").write_text("a\tb\tc\nonly\n")
    assert [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "t.tsv"), ["x", "y"]).collect()] == [("a", "b")]
    (tmp_path / "c.csv").write_text('text,n\n"a\nb",1\n,2\n')
    assert sorted(r.text for r in readers.read_csv(spark, str(tmp_path / "c.csv"), "text string, n int").collect()) == ["", "a\nb"]
    df = spark.createDataFrame([("a", ["x", "y"], "")], "t string, l array<string>, e string")
    assert df.select(readers.joined_text(df, ["t", "l", "e"]).alias("x")).first().x == "a\nx y"
    assert readers.resolve_text_column(df.select("l", "t")) == "t"
    with pytest.raises(ValueError, match="no column"):
        readers.resolve_text_column(df.select("l"))


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("reason", F.when(F.col("id") < 4, "ok").otherwise("bad"))
    writers.write_shards(df, str(tmp_path / "s"), 2, ["reason"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
    writers.write_verdicts(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v/verdict=accepted")).count() == 4
    assert writers.append_pending(df.where("id < 5"), str(tmp_path / "r"), "id") == 5
    assert writers.append_pending(df, str(tmp_path / "r"), "id") == 10
    assert "hline" in writers.to_latex(df.groupBy("reason").count(), "x")
