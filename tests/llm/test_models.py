"""What is learned or tested by numbers, against plain loops: FTRL, the randomness battery, and the pipeline's edge tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm import secret_scan, toxicity


def test_ftrl_by_a_plain_loop(spark):
    """Weights of the fit are those of FTRL-proximal written out for one coordinate at a time."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["good", "bad", "day", "ugly", "weather", "horrible"], k=rng.randrange(1, 12))) + (" badly" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    at, found = toxicity.fit(docs, labels, learn=F.lit(True), passes=2)
    alpha, beta, l1, l2, size = 0.3, 1.0, 8.0, 0.1, 1 << toxicity.BITS
    z, n = {}, {}

    def weight(i):
        l = 0.0 if i == size else l1  # noqa: E741
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= l else -(s - math.copysign(l, s)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    order = [r.doc_id for r in docs.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").collect()]
    features = {}
    for i, t in rows:
        own = set()
        for slots, _ in toxicity.slots(pa.array([t], pa.large_string())):
            own |= set(slots.tolist())
        features[i] = sorted(own) + [size]
    for _ in range(2):
        for i in order:
            w = {f: weight(f) for f in features[i]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - (i % 3 == 0)
            for f in features[i]:
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f], n[f] = z.get(f, 0.0) + g - sigma * w[f], n.get(f, 0.0) + g * g
    expected = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(at.tolist(), found.tolist(), strict=True)) == pytest.approx(expected) and len(expected) > 5
    # Scores are the logistic of the features' weights, clashing columns keep their values, and a column of the score's name goes.
    scored = toxicity.scored(docs.withColumns({"score": F.lit("mine"), "slot": F.lit("x"), "weight": F.lit("y")}), (at, found))
    for r in scored.collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(expected.get(f, 0.0) for f in features[r.doc_id])))) and (r.slot, r.weight) == ("x", "y")


def tail(z):
    return math.erfc(abs(z) / math.sqrt(2))


def brute_p(token):
    """The battery on one token, in floating point from the definitions."""
    body = token.rstrip("=")
    alphabet = next(a for p, a in secret_scan.ENCODINGS if all(c in a for c in body))
    v = [alphabet.index(c) for c in body]
    size, n = len(alphabet), len(v)
    chi = sum(v.count(x) ** 2 for x in set(v)) * size / n - n
    k = size - 1
    z_chi = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    high = [2 * x >= size for x in v]
    expected = 2 * sum(high) * (n - sum(high)) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    p_run = tail((runs - expected) / math.sqrt(spread)) if spread > 0 else 0.0
    mean = sum(v) / n
    variance = sum((x - mean) ** 2 for x in v)
    p_serial = tail((sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / variance + 1 / n) * math.sqrt(n)) if variance else 0.0
    return min(1.0, 3 * min(tail(z_chi), p_run, p_serial))


def planted(rng, n=150):
    """Tokens by kind: random ones of three alphabets, dictionary words with digits, and both mixed, of 20 to 63 characters."""
    words = ["alpha", "river", "Config", "user", "service", "backup", "Image", "report", "final", "version", "draft", "module", "Handler", "value"]
    out = []
    for k in range(n):
        size = rng.randrange(20, 64)
        for kind, alphabet in (("hex", "0123456789ABCDEF"), ("base62", secret_scan.ENCODINGS[3][1]), ("base64", secret_scan.ENCODINGS[4][1])):
            out.append((f"random {kind}", "".join(rng.choices(alphabet, k=size))))
        text = ""
        while len(text) < size:
            text += rng.choice(words) + rng.choice(["", "", str(rng.randrange(100))])
        out.append(("dictionary", text[: size - 1] + str(k % 10)))
        out.append(("repeated", (rng.choice(words) + "1")[:6] * 12))
        out[-1] = ("repeated", out[-1][1][:size])
    return out


def test_battery_by_definition(spark):
    tokens = [t for _, t in planted(random.Random(1), 40) if any(c.isdigit() for c in t) and any(c.isalpha() for c in t)]
    docs = spark.createDataFrame(list(enumerate(tokens)), "doc_id bigint, text string")
    found = secret_scan.with_matches(docs, "text", "base", "tested").select("doc_id", F.explode("tested").alias("c")).collect()
    by = {r.doc_id: r.c for r in found if r.c.start == 0 and r.c.end == len(tokens[r.doc_id])}
    assert len(by) > 0.9 * len(tokens)
    for i, c in by.items():
        assert c.p == pytest.approx(brute_p(tokens[i]), abs=1e-6)


def test_secrets_found_and_false(spark):
    """Shares reported by kind of token: the figures of the README."""
    tokens = planted(random.Random(2))
    docs = spark.createDataFrame([(i, f"see {t} there") for i, (_, t) in enumerate(tokens)], "doc_id bigint, text string")
    found = {r.doc_id: "random" in r.spans or "hex" in r.spans for r in secret_scan.secret_report(docs).collect()}
    share = lambda kind, test: np.mean([found[i] for i, (k, t) in enumerate(tokens) if k.startswith(kind) and test(len(t))])
    assert share("random", lambda n: n < 32) > 0.85 and share("random", lambda n: n >= 32) > 0.85
    assert share("repeated", lambda n: n >= 32) < 0.1 and share("dictionary", lambda n: n >= 32) < share("random", lambda n: n >= 32) - 0.2


def test_pipeline_on_empty_tables(spark, tmp_path, data):
    for name, kind in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_rows_with_other_columns(spark, data):
    """Columns beyond those of documents, of whatever names, change no stage's rows."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60")
    clash = docs.withColumns({c: F.lit("x") for c in ("score", "_toxicity", "h1", "node", "label", "item_id", "text_md5", "base", "spans", "ids", "key")})
    for name, stage in corpus_pipeline.STAGES:
        one, two = (sorted(map(tuple, stage(spark, d, data).collect()), key=str) for d in (docs, clash))
        assert one == two, name
