"""Chunks, masked spans, stems and classes of errors on small rows."""

import pytest
from corpuslab.operators import chunks as C
from pyspark.sql import functions as F


def test_fitted():
    assert C.fitted("short", 10) == ["short"]
    assert C.fitted("aaaa\n\nbbbb\n\ncccc", 12) == ["aaaa\n\nbbbb", "cccc"]
    assert C.fitted("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert all(len(c) <= 30 for c in C.fitted("One is here. Two is there. " * 20, 30))


def test_windows_lose_no_word():
    text = "some words here\nand others " * 50
    found = C.windows(text, 40)
    assert max(map(len, found)) <= 40 and " ".join(found).split() == text.split()
    assert C.windows("y" * 25, 10) == ["y" * 10, "y" * 10, "y" * 5]
    assert C.windows("ab\ncd efgh", 6) == ["ab\ncd", "efgh"]


def test_sentence_chunks():
    assert C.sentence_chunks("A b c. D e. F g h i.", 5) == ["A b c. D e.", "F g h i."]
    assert C.sentence_chunks("a b c d e f g", 3) == ["a b c", "d e f", "g"]


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a" * 60 + "\n\n" + "b" * 10, 7), (4, "tiny", 7)], "doc_id long, text string, chunk int")
    got = {(r.doc_id, r.chunk, len(r.text)) for r in C.chunked(df, most=64).collect()}
    assert got == {(3, 0, 60), (4, 0, 4)}


def test_corrupted_restores(spark):
    rows = [(i, list(range(n))) for i, n in enumerate((0, 1, 2, 3, 10, 500))] + [(99, None)]
    df = spark.createDataFrame(rows, "k long, ids array<bigint>")
    marks = list(range(10_000, 10_020))
    for r in C.corrupted(df, "k", "ids", marks).collect():
        spans, now = {}, None
        for x in r.targets:
            if x >= 10_000:
                now = spans[x] = []
            else:
                now.append(x)
        back = [y for x in r.inputs for y in (spans[x] if x >= 10_000 else [x])]
        assert back == list(r.ids or [])
        if len(back) >= 10:
            assert len(back) - sum(x < 10_000 for x in r.inputs) == round(len(back) * 0.15)


def test_stems(spark):
    df = spark.createDataFrame([("workings",), ("Kindnesses",), ("sing",), ("",), (None,)], "w string")
    assert [r.stem for r in C.with_stem(df, "w", ["ings", "ing", "ness", "es", "s"]).collect()] == ["work", "Kind", "sing", "", None]


@pytest.mark.parametrize(("a", "b", "kind"), [("a b", " a b ", "identity"), ("a b", "b a", "word_order"), ("a b", "a", "mixed"), ("abcd e", "abce e", "morphology"), ("abcd e", "abc e", "orthography"), ("abcdefgh", "ijklmngh", "orthography"), ("", "", "identity"), (None, "a", None)])
def test_error_class(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(C.error_class(F.col("a"), F.col("b")).alias("c")).first().c == kind
