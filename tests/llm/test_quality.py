import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import quality as Q


def slow_ftrl(rows, dim_bits, how):
    """One coordinate at a time, as published."""
    dim = 1 << dim_bits
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        l1 = 0 if i == dim else how.l1
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((how.beta + math.sqrt(n.get(i, 0.0))) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for y, feature, value in rows:
            x = {**dict(zip(feature, value)), dim: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / how.alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_slow_form():
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(0, 2)), np.sort(rng.choice(64, 5, replace=False)), rng.random(5).astype(np.float32)) for _ in range(200)]
    index, weight, bias = Q.ftrl(rows, 6, Q.Ftrl())
    want = slow_ftrl(rows, 6, Q.Ftrl())
    assert bias == pytest.approx(want[64], abs=1e-5)
    assert dict(zip(index.tolist(), weight.tolist())) == pytest.approx({i: w for i, w in want.items() if w and i != 64}, abs=1e-5)


def sample(spark, n, seed):
    rnd = random.Random(seed)
    good, bad = "the river runs past quiet green hills and old stone houses".split(), "buy now click win cash !!! $$$ free".split()
    rows, labels = [], []
    for i in range(n):
        y = rnd.randrange(2)
        w = [rnd.choice(good if rnd.random() < (0.9 if y else 0.2) else bad) for _ in range(rnd.randrange(5, 60))]
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy_on_a_fixture(spark):
    df, labels, truth = sample(spark, 600, 3)
    model = Q.train(df, labels.filter("doc_id < 400"))
    got = Q.score(df.filter("doc_id >= 400"), model).collect()
    assert sum((r["quality_score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got) / len(got) > 0.95


def test_held_out_accuracy_on_given_tables(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = Q.train(docs, labels.filter("pmod(hash(doc_id), 4) <> 0"))
    held = labels.filter("pmod(hash(doc_id), 4) = 0").join(docs, "doc_id")
    got = Q.score(held, model).select("quality", "quality_score").collect()
    wrong = [r for r in got if (r["quality_score"] >= Q.THRESHOLD) != bool(r["quality"])]
    lost = [r for r in wrong if r["quality"]]
    assert len(got) > 100 and len(wrong) / len(got) < 0.05 and len(lost) / len(got) < 0.02


def test_training_takes_a_bounded_sample_in_a_fixed_order(spark):
    df, labels, _ = sample(spark, 300, 4)
    a, b = Q.train(df, labels, max_rows=50), Q.train(df.repartition(7), labels.repartition(3), max_rows=50)
    assert a.bias == b.bias and a.index.tolist() == b.index.tolist() and a.weight.tolist() == b.weight.tolist()
    c = Q.train(df, labels)
    assert len(c.index) > len(a.index)


def test_scores_equal_sparse_dot_products(spark):
    df, labels, _ = sample(spark, 80, 5)
    model = Q.train(df, labels, dim_bits=12)
    w = model.dense()
    for r in Q.score(df, model).collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        feat, _ = Q.occurrences(data, np.array([0, len(data)]), {}, 12)
        x = {}
        for f in feat.tolist():
            x[f] = x.get(f, 0) + 1
        dot = sum(w[f] * c / math.sqrt(len(feat)) for f, c in x.items()) + model.bias
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-6)


def test_nulls_empty_long_repeated_and_clashing(spark):
    df, labels, _ = sample(spark, 120, 6)
    odd = labels.union(spark.createDataFrame([(None, 1), (3, None), (5, 7), (10**9, 1)], "doc_id long, quality int"))
    model = Q.train(df.union(spark.createDataFrame([(None, "x"), (7, None)], "doc_id long, text string")), odd)
    rows = [(1, None, "a"), (2, "", "b"), (None, "the river " * 200_000, "c"), (4, "x", "d"), (4, "x", "d")]
    edge = spark.createDataFrame(rows, "doc_id long, text string, quality_score string")
    out = Q.score(edge, model)
    assert out.columns == ["doc_id", "text", "quality_score", "quality_score_1"]
    got = out.collect()
    assert len(got) == 5
    by = {r["quality_score"]: r["quality_score_1"] for r in got}
    assert by["a"] is None and by["b"] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    kept = Q.quality_filter(edge, labels.limit(0))
    assert kept.columns == edge.columns and kept.count() == 5
    assert Q.score(edge.limit(0), model).collect() == []


M64 = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def slow_features(text, dim_bits):
    """Counts of hashed 1- and 2-grams of word and symbol runs, one token at a time, with whole numbers."""
    tokens, kind = [], 0
    for byte in text.encode():
        now = 1 if byte >= 128 or chr(byte).isalnum() else 2 if 32 < byte < 127 else 0
        if now and now == kind:
            tokens[-1].append(byte)
        elif now:
            tokens.append([byte])
        kind = now
    base, step, hashes = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, []
    for t in tokens:
        power, h = 1, 0
        for byte in t:
            h, power = (h + (byte + 1) * power) & M64, power * base & M64
        hashes.append(mixed(h))
    out = {}
    for f in [mixed(h) >> 64 - dim_bits for h in hashes] + [mixed((a * step + b) & M64) >> 64 - dim_bits for a, b in zip(hashes, hashes[1:])] + [0xA6A1 & (1 << dim_bits) - 1 for a, b in zip(hashes, hashes[1:]) if a == b]:
        out[f] = out.get(f, 0) + 1
    return out


def test_the_query_against_a_slow_version(spark, sf_dir):
    """Own features, own training, own scores, over all documents."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality", "xxhash64(doc_id, 'ftrl-order') AS turn").collect()
    feats = {i: slow_features(t or "", Q.DIM_BITS) for i, t in docs.items()}

    def example(i):
        n = math.sqrt(sum(feats[i].values()) or 1)
        at = sorted(feats[i])
        return at, [feats[i][f] / n for f in at]

    rows = [(float(r["quality"]), *example(r["doc_id"])) for r in sorted(labels, key=lambda r: r["turn"]) if docs.get(r["doc_id"]) is not None]
    weight = slow_ftrl(rows, Q.DIM_BITS, Q.Ftrl())
    got = Q.op8_quality_classifier(spark, sf_dir).collect()
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == set(docs)
    for r in got:
        at, x = example(r["doc_id"])
        want = 1 / (1 + math.exp(-(sum(weight.get(f, 0.0) * v for f, v in zip(at, x)) + weight[1 << Q.DIM_BITS])))
        assert r["quality_score"] == pytest.approx(want, abs=2e-4)
        assert r["keep"] == (want >= Q.THRESHOLD) or abs(want - Q.THRESHOLD) < 2e-4


def test_rows_that_repeat_an_id_are_one_example(spark):
    df, labels, _ = sample(spark, 60, 8)
    many = df.union(spark.createDataFrame([(7, "zz the river"), (7, "zz"), (7, "zzz cash")] * 50, "doc_id long, text string"))
    names = labels.union(labels.filter("doc_id = 7"))
    a, b = Q.train(df, labels), Q.train(many, names)
    assert a.bias == b.bias and a.index.tolist() == b.index.tolist()


def test_ids_that_are_not_numbers(spark):
    df, labels, truth = sample(spark, 200, 9)
    text = lambda d: d.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    out = Q.quality_filter(text(df), text(labels))
    assert out.schema == text(df).schema
    kept = {r["doc_id"] for r in out.collect()}
    assert sum((f"doc-{i}" in kept) == bool(y) for i, y in truth.items()) > 190
