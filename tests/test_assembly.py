"""Sources, sinks, plug-ins, synthetic errors and learned numbers that no SQL expresses."""

import io
import json
import math
import random
import tarfile
import tracemalloc

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import arrow, chars, text
from corpuslab.operators import assembly, contamination, dedup, gates, gec, language, leaderboard, pairs, quality
from corpuslab.profile import LATIN
from corpuslab.sources import readers, writers


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_sources(spark, tmp_path):
    spark.createDataFrame([("a", "b"), ("c", None)], "text string, more string").write.parquet(f"{tmp_path}/p")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "news.csv").write_text('title,text\nx,"two\nlines"\n')
    found = readers.read_sources(spark, [readers.Source("one", f"{tmp_path}/p", text_columns=("text", "more")), readers.Source("two", f"{tmp_path}/c", "csv", options={"header": "true", "multiLine": "true"})])
    assert sorted((r.text, r.source, r.source_rank) for r in found.collect()) == [("a\nb", "one", 0), ("c", "one", 0), ("two\nlines", "two", 1)]
    assert readers.read_csv_domains(spark, f"{tmp_path}/c", "title string, text string").first().domain == "news"
    (tmp_path / "j").mkdir()
    for name in ("b.jsonl", "a.jsonl"):
        (tmp_path / "j" / name).write_text(json.dumps({"text": name}) + "\n\n")
    rows = readers.read_chunks(spark, f"{tmp_path}/j", "text string").orderBy("chunk").collect()
    assert [r.text for r in rows] == ["a.jsonl", "b.jsonl"]


def test_page_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as archive:
        for name, text in (("site.kz/a.html", "é" * 120), ("site.kz/short.html", "x"), ("other/b.htm", "y" * 100), ("other/c.txt", "z" * 200)):
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            archive.addfile(info, io.BytesIO(text.encode()))
    found = readers.read_page_archives(spark, f"{tmp_path}/*.tar.gz").collect()
    assert sorted((r.domain, r.name, len(r.html)) for r in found) == [("other", "other/b.htm", 100), ("site.kz", "site.kz/a.html", 120)]


def test_sitemaps():
    files = {"s": "<sitemapindex><loc>a.xml</loc><loc> s </loc><loc>gone.xml</loc></sitemapindex>", "a.xml": "<urlset><loc>p1</loc><loc><![CDATA[p2]]></loc><loc>p1</loc></urlset>"}
    assert readers.sitemap_urls("s", files.get) == ["p1", "p2"]


def test_sinks(spark, tmp_path):
    df = spark.range(25).withColumn("x", F.when(F.col("id") > 3, "y"))
    for _ in range(2):
        writers.append_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 50
    df.repartition(5).write.parquet(f"{tmp_path}/p")
    assert writers.merge_files(spark, f"{tmp_path}/p", f"{tmp_path}/m", 1) == 25
    assert len(spark.read.parquet(f"{tmp_path}/m").inputFiles()) == 1
    sent, failed = [], set()

    def send(name):
        if name not in failed:
            failed.add(name)
            raise OSError(name)
        sent.append(name)

    assert writers.upload_chunks(df.coalesce(1), f"{tmp_path}/u", send, rows=10) == 3 == len(sent)
    with pytest.raises(OSError):
        writers.upload_chunks(df, f"{tmp_path}/v", lambda _: (_ for _ in ()).throw(OSError("x")), tries=2)
    writers.write_report(df.limit(2), f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 2
    assert writers.write_parts(df.where("id < 10"), f"{tmp_path}/w", "id", 5) == 2
    (tmp_path / "w" / "part=1" / "_SUCCESS").unlink()
    assert writers.write_parts(df, f"{tmp_path}/w", "id", 5) == 4 and spark.read.parquet(f"{tmp_path}/w").count() == 25


def test_scores_from_the_literature(spark):
    rows = [("hello", "hello", 0.0), ("abc", "xyz", 1.0), ("helo", "hello", 0.2), ("x", "", 1.0), ("", "", 0.0)]
    df = spark.createDataFrame(rows, "h string, r string, cer double")
    distance, length = pairs.cer_parts(F.col("h"), F.col("r"))
    assert all(math.isclose(r.x, r.cer) for r in df.select("cer", (distance / length).alias("x")).collect())
    edits = spark.createDataFrame([("a b c", "a b c", "a b c"), ("a x c", "a b c", "a b c"), ("a x c", "a x c", "a b c")], "s string, h string, r string")
    scored = pairs.edit_scores(edits, "s", "h", "r").select(pairs.f_half(F.col("tp"), F.col("fp"), F.col("fn")).alias("f")).collect()
    assert [r.f for r in scored] == [0.0, 1.0, 0.0]
    assert one(spark, lambda t: pairs.repeats(t, 2, 3), "a b a b a b") and not one(spark, lambda t: pairs.repeats(t, 2, 3), "a b a b a c")


def test_synthetic_errors(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["Morning", "lights", "over", "the", "harbour,", "and", "small", "boats."], k=9)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, target string")
    found = gec.synthetic_errors(df, "id", "target").collect()
    again = gec.synthetic_errors(df.repartition(3), "id", "target").collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert {t for r in found for t in r.error_tags} == {t for t, _, _ in gec.corruptions(F.array(F.lit("")), F.lit(0))}
    twice = sum(len(r.error_tags) == 2 for r in found) / len(found)
    assert 0.25 < twice < 0.35 and sum(r.input != r.target for r in found) > 0.8 * len(found)
    by = {r.error_tags[0]: r for r in found if len(r.error_tags) == 1}
    assert len(by["lexis/word/lost"].input.split()) == 8 and len(by["lexis/word/repeated"].input.split()) == 10
    assert sorted(by["order/words/swapped"].input.split()) == sorted(by["order/words/swapped"].target.split())


def test_taxonomy(spark):
    rows = [("a b", "a b", "none"), ("b a", "a b", "order/words/swap"), ("a", "a b", "lexis/count/missing"), ("A b", "a b", "orthography/case/letter"), ("a, b", "a b", "orthography/punctuation/mark"), ("houses x", "housing x", "morphology/suffix/changed"), ("teh x", "the x", "orthography/spelling/letter"), ("cat x", "table x", "lexis/word/choice")]
    df = spark.createDataFrame(rows, "s string, t string, tag string")
    assert all(r.x == r.tag for r in df.select("tag", gec.classify(F.col("s"), F.col("t")).alias("x")).collect())
    assert df.select(*(c.alias(n) for c, n in zip(gec.tag_levels(F.lit("one/two/three")), "abc", strict=True))).first() == ("one", "one/two", "one/two/three")


def test_predictors_are_injected(spark):
    df = spark.createDataFrame([(1, "x" * 60), (2, "y" * 60), (3, "x" * 60), (4, "short"), (5, None)], "id bigint, text string")
    first = lambda t: F.struct(F.substring(t, 1, 1).alias("lang"), F.lit(0.87654).alias("confidence"))
    found = language.document_filter(df, "id", "text", languages=("x",), predict=first, near=spark.range(1, 2))
    assert {r.id: r.reason for r in found.collect()} == {1: "near_duplicate", 2: "language", 3: "duplicate", 4: "too_short", 5: "too_short"}
    assert one(spark, lambda t: language.identified_short(t, first), "abcdefg") == ("a", 0.877)
    assert one(spark, lambda t: language.identified_short(t, first), " ab ") == ("unk", 0.0)
    assert one(spark, lambda t: language.identified_or_null(t, first), "too short") is None
    tagged = gec.corrected(df.where("id < 3"), "text", lambda t: F.struct(F.lit("tag").alias("text"), F.when(t.startswith("x"), 0.95).otherwise(0.5).alias("confidence")), F.upper)
    assert {r.id: r.corrected for r in tagged.collect()} == {1: "tag", 2: "Y" * 60}
    model = spark.createDataFrame([("a", 1.0), ("b", 50.0)], "token string, nll double")
    texts = spark.createDataFrame([(1, ["a", "a"]), (2, ["b"]), (3, [])], "id bigint, w array<string>")
    ppl = {r.id: r.ppl for r in language.perplexity(texts, "id", F.col("w"), model).collect()}
    assert math.isclose(ppl[1], math.e) and math.isclose(ppl[2], math.exp(20)) and ppl[3] == float("inf")


def test_short_texts_count_as_repetitive(spark):
    assert one(spark, gates.gzip_below_hundred, "x" * 99) == 0.0 < one(spark, gates.gzip_below_hundred, "abc" * 40)
    assert one(spark, arrow.gzip_ratio, "") == 1.0
    assert one(spark, lambda t: gates.repetition(t, 2), "a b a b c") == 2 / 4 and one(spark, lambda t: gates.repetition(t, 9), "a b") == 0.0


def test_classes_and_windows(spark):
    rows = spark.createDataFrame([("aZ9 \n\u00a0é,$١жא²",), ("",), (None,)], "t string").select(chars.class_counts(F.col("t")).alias("c")).collect()
    assert rows[0].c.asDict() == {"space": 2, "cyrillic": 1, "latin": 2, "arabic": 1, "digit": 1, "punct": 2, "letter": 2, "number": 1, "other": 1}
    assert sum(rows[1].c.asDict().values()) == 0 and rows[2].c is None
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é", k=rng.randrange(40))) for _ in range(200)] + [None, "ab"]
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    items = spark.createDataFrame([(i, "".join(rng.choices("ab é", k=30))) for i in range(20)] + [(99, "ab")], "item_id bigint, text string")
    near, far = (sorted(map(tuple, contamination.item_overlap(items, corpus, n=6, broadcast=b).collect())) for b in (1 << 20, 0))
    assert near == far and len(near) == 20 and 0 < sum(r[2] for r in near) < sum(r[1] for r in near)


def test_repeated_runs_of_words(spark):
    rows = ["a b a b c", " a  b\ta b ", "a", "", None, "x y z x y z x y"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    found = [tuple(r.x) if r.x else None for r in df.select(chars.repeated_windows(F.col("t"), 2).alias("x")).collect()]
    assert found == [(2, 4), (2, 3), (0, 0), (0, 0), None, (7, 7)]
    again = [(r.x.repeated, r.x.total) for r in df.where("t IS NOT NULL").select(text.repeated_ngrams(F.col("t"), 2).alias("x")).collect()]
    assert again == [x for x in found if x]


def test_order_statistics(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random() * 1e6, 5.0, 7.0])) for g in "ab" for _ in range(700)] + [("c", 1.0), ("d", None)]
    found = quality.order_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()
    for r in found:
        own = sorted(v for g, v in rows if g == r.g)
        assert [r.p0, r.p50, r.p99, r.p100] == [own[min(int(s * len(own)), len(own) - 1)] for s in (0.0, 0.5, 0.99, 1.0)]
    assert {r.g for r in found} == {"a", "b", "c"}


def test_elo_quantiles(spark):
    rows = [(i, "a", "b", "model_a" if i % 4 else "model_b") for i in range(200)] + [(500 + i, "b", "c", "model_a" if i % 3 else "tie") for i in range(200)]
    found = leaderboard.elo_bootstrap(spark.createDataFrame(rows, "k bigint, model_a string, model_b string, winner string"), "k", 30)
    assert [m for m, *_ in found] == ["a", "b", "c"] and all(low <= mid <= high for _, low, mid, high in found) and found[0][2] > found[1][2] > found[2][2]
    test = gec.paired_bootstrap(spark.createDataFrame([(i, 0.1, 0.3 + i % 3 / 10) for i in range(60)], "k bigint, a double, b double"), "k", "a", "b", 100).first()
    assert math.isclose(test.difference, 0.3) and test.p == 0.0


def test_pairs_of_near_copies(spark):
    """Links by the prefix filter are all that brute force finds."""
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(60)]
    texts = [" ".join(base[: k % 7] + [str(k)] * (k % 3) + base[k % 7 :]) for k in range(40)] + ["a b", ""]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    expected = {(i, j) for i in range(40) for j in range(i + 1, 40) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    assert {(r.a, r.b) for r in dedup.exact_pairs(df, "id", "text", 3, 0.8).collect()} == expected and expected


def test_merges(spark):
    df = spark.createDataFrame([("low low lower newest newest widest",)], "t string")
    assert assembly.train_merges(df, F.split("t", " "), 2) == [("e", "s"), ("es", "t")]
    assert LATIN.name == "latin"


def merges_by_loop(words, merges):
    """As train_merges, over lists."""
    held, out = [(list(w), n) for w, n in words.items()], []
    for _ in range(merges):
        counts = {}
        for w, n in held:
            for pair in zip(w, w[1:], strict=False):
                counts[pair] = counts.get(pair, 0) + n
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        out.append(best)
        for w, _ in held:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [w[i] + w[i + 1]]
                i += 1
    return out


@pytest.mark.parametrize("letters,merges", [("ab", 30), ("aé\U0001f600\uffff", 18)])
def test_merges_equal_a_loop(spark, letters, merges):
    rng = random.Random(merges)
    rows = [[("".join(rng.choices(letters, k=rng.randrange(12)))) for _ in range(rng.randrange(9))] for _ in range(60)] + [None, [], ["", "a"], ["aaaaaaa", "a\0b"]]
    words = {}
    for w in (w for r in rows if r for w in r):
        words[w] = words.get(w, 0) + 1
    found = assembly.train_merges(spark.createDataFrame([(r,) for r in rows], "w array<string>"), F.col("w"), merges)
    assert found == merges_by_loop(words, merges)


def test_merges_end_with_the_pairs(spark):
    df = spark.createDataFrame([(["aaa", "b"],), ([],)], "w array<string>")
    assert assembly.train_merges(df, F.col("w"), 9) == [("a", "a"), ("aa", "a")]
    assert assembly.train_merges(df.limit(0), F.col("w"), 9) == []


def test_merges_hold_no_words_in_the_driver(spark):
    """A hundred thousand distinct words took 88 MB."""
    df = spark.range(100_000).select(F.array(F.md5(F.col("id").cast("string"))).alias("w"))
    tracemalloc.start()
    try:
        assert len(assembly.train_merges(df, F.col("w"), 1)) == 1
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
