"""What the operators gather grows with the input, and nothing of it is cut."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpuslab.llm import near_dedup, shared, url_filter, words
from corpuslab.llm.words import hash_of


def brute_ratio(train, url):
    """The difference of Witten-Bell log-likelihoods by URLs (bytes, side, n), counted by n-gram in dictionaries."""
    counts, kinds, totals = Counter(), Counter(), Counter()
    for text, side, n in train:
        for i, b in enumerate(text):
            for k in range(url_filter.ORDER + 1):
                context = (side, k, tuple(text[j] if j >= 0 else -1 for j in range(i - k, i)))
                kinds[context] += (context, b) not in counts
                counts[context, b] += n
                totals[context] += n
    out = 0.0
    for i, b in enumerate(url):
        for side, sign in ((0, 1), (1, -1)):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                context = (side, k, tuple(url[j] if j >= 0 else -1 for j in range(i - k, i)))
                if totals[context]:
                    p = (counts[context, b] + kinds[context] * p) / (totals[context] + kinds[context])
            out += sign * math.log(p)
    return out / max(len(url), 1)


def held_out(url):
    value = xxhash.xxh64_intdigest(url.encode(), 42)
    return (value - (1 << 64) if value >> 63 else value) % 5 == 0


@pytest.mark.parametrize("hot", [0, 20, url_filter.HOT])
def test_url_ratio_exact(spark, hot):
    ruled = [(f"http://{a}{i}.{z}/{p}/{i * 7}", s) for i in range(30) for a, z, p, s in (("gut", "org", "ä", 0), ("bad", "com", "de", 1))]
    rest = ["http://gut3.net/ä/4", "bad", "", "x" * 300, "http://bad77.net/de/9"]
    rows = [(i, u, "", "") for i, u in enumerate([u for u, _ in ruled] * 2 + [ruled[0][0]] + rest * 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string")
    train = [(u.encode(), s, 2 + (u == ruled[0][0])) for u, s in ruled if not held_out(u)]
    found = url_filter.judge(pages, hot=hot).collect()
    assert len(found) == len(rows) and all((r.ratio is None) == (r.rule is not None) for r in found)
    for r in found:
        if r.rule is None:
            assert r.ratio == pytest.approx(brute_ratio(train, r.url.encode()), abs=1e-8)


def test_url_grams_grow(spark):
    """Every n-gram has its own entry: 2 ** 18 slots of contexts would be full."""
    urls = spark.range(60_000).selectExpr("concat(md5(cast(id AS string)), '/') AS url", "0 AS side", "1L AS n", "true AS train")
    half = url_filter.gram_tables(urls.where("url < '8'"))
    whole = url_filter.gram_tables(urls)
    assert whole[5].count() > 1.2 * half[5].count() > 1 << 19
    texts = [r.url for r in urls.select("url").collect()]
    assert whole[5].count() == len({(" " * 5 + t)[i : i + 6] for t in texts for i in range(len(t))})
    assert whole[0].count() == 17


def test_word_weights(spark):
    """Weights are those of the document frequencies of all words, and don't change when all documents are there twice."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.3, 60) % 500) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id bigint, text string")
    df = Counter(w for t in texts for w in set(t.split()))
    pairs, rows = sum(df.values()), len(texts) + 2
    for shares in (shared.WordWeights.SHARES, 100):
        pytest.MonkeyPatch().setattr(shared.WordWeights, "SHARES", shares)
        one, two = (shared.WordWeights.of(d) for d in (docs, docs.union(docs).repartition(5)))
        assert len(one.hashes) == sum(n >= pairs / shares for n in df.values()) <= shares
        rarest = min(max(pairs / shares / rows, 1e-9), 0.5)
        expected = [1 + math.log(min(max(n / rows, rarest), 1)) / math.log(rarest) for n in df.values()]
        hashes = np.array([hash_of(w) for w in df], np.uint64)
        assert one.of_words(hashes) == pytest.approx(expected) and two.of_words(hashes) == pytest.approx(expected)
    pytest.MonkeyPatch().setattr(shared.WordWeights, "SHARES", 1 << 17)


def test_word_hashes_in_pieces(monkeypatch):
    """Words, rows and stems are the same however texts are cut, and equal hashes mean equal words."""
    rng = random.Random(1)
    for chunk in (16, 64, words.CHUNK):
        monkeypatch.setattr(words, "CHUNK", chunk)
        for _ in range(100):
            rows = ["".join(rng.choice("abAB é İß.,!- \n\t梦😀1") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
            column = pa.array(["cut", *rows], pa.large_string()).slice(1)
            hashes, offsets, (stems,) = words.word_hashes(column, (2,))
            plain = [[p for w in r.split() if (p := words.plain_word(w))] for r in rows]
            assert offsets.tolist() == [0, *np.cumsum([len(x) for x in plain]).tolist()]
            flat = [w for x in plain for w in x]
            assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist(), strict=True)))
            assert [s == 0 for s in stems.tolist()] == [len(w) <= 2 for w in flat]


def test_sampler_draws_by_similarity():
    """Two weighted sets draw the same sample with the probability of their weighted Jaccard similarity, by whatever bound."""
    rng = np.random.default_rng(0)
    for n, reach in ((1, 5.0), (40, 5.0), (40, 0.01), (150, 5.0)):
        shingle = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a = np.where(np.arange(2 * n) < 1.5 * n, rng.uniform(1, 2, 2 * n) * rng.integers(1, 4, 2 * n), 0)
        b = np.where(np.arange(2 * n) >= 0.5 * n, np.where(rng.random(2 * n) < 0.5, a, rng.uniform(1, 4, 2 * n)), 0)
        row = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        rows = (row, np.concatenate([shingle[a > 0], shingle[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        sampler = near_dedup.Sampler(3000)
        sampler.REACH = reach
        one, two = sampler.signatures(*rows)
        similarity = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((one == two).mean() - similarity) < 0.04
        whole = near_dedup.Sampler(3000)
        assert (whole.signatures(*rows) == [one, two]).all()


def brute_classes(texts, weights, similarity=0.8):
    """Least position of each text's class, from all pairs that share a shingle."""
    column = pa.array(texts, pa.large_string())
    row, shingle, _ = weights.shingles(column)
    by = {}
    for r, s in zip(row.tolist(), shingle.tolist(), strict=True):
        by.setdefault(s, []).append(r)
    pairs = sorted({(a, b) for rows in by.values() for i, a in enumerate(rows) for b in rows[i + 1 :]})
    alike = np.concatenate([shared.weighted_jaccard(weights, column.take(pa.array([p[0] for p in part])), column.take(pa.array([p[1] for p in part]))) for part in (pairs[i : i + 2000] for i in range(0, len(pairs), 2000))])
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    links = [p for p, s in zip(pairs, alike, strict=True) if s >= similarity - 1e-9] + [(first.setdefault(t, i), i) for i, t in enumerate(texts)]
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], len(links) - len(texts)


def family(rng, n):
    """A text, copies of it with edits of their own (some too many), copies of those, and texts that share a passage with it."""
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(150)]
    out = [base]
    for k in range(n):
        copy = list(out[rng.randrange(len(out))] if k % 5 == 0 else base)
        for _ in range(rng.randrange(1, 9)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], [word()], [word(), word()]])
        out.append(copy)
    out += [[word() for _ in range(60)] + base[20:110] + [word() for _ in range(30)] for _ in range(n // 2)]
    return [" ".join(x) for x in out]


def test_classes_by_brute_force(spark, data):
    """Links and classes are those of all pairs: on documents, and on large groups of copies that are not all alike."""
    own = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    for texts in (own, family(random.Random(4), 150), family(random.Random(5), 40)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        expected, links = brute_classes(texts, shared.WordWeights.of(docs))
        found = near_dedup.near_duplicates(docs).collect()
        assert sorted((r.doc_id, r.class_id) for r in found) == list(enumerate(expected)) and links > 10


def test_texts_of_one_id_belong_together(spark):
    one, two = family(random.Random(6), 0)[0], family(random.Random(7), 0)[0]
    rows = [(1, one), (2, two), (5, f"{one} x"), (5, f"{two} y"), (7, "alone"), (None, one)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in found) == [(0, 0), (1, 1), (2, 1), (5, 1), (5, 1), (7, 7)]
    kept = near_dedup.keep_one(spark.createDataFrame([(1, "b"), (1, "a"), (2, "a")], "doc_id bigint, text string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "a")]
