import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillmere.llm import simhash as S


def signatures_of(n, rng, groups=4, flips=60):
    base = rng.integers(0, 2, (groups, S.BITS))
    out = base[rng.integers(0, groups, n)].copy()
    for r in out:
        r[rng.choice(S.BITS, rng.integers(0, flips), replace=False)] ^= 1
    return np.packbits(out.astype(np.uint8), axis=1)


def brute_labels(sig, stop, radius):
    n = len(sig)
    bits = np.unpackbits(sig, axis=1).astype(int)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i + 1, stop[i]):
            if (bits[i] != bits[j]).sum() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(n)]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 200), st.sampled_from([0, 1, 3, 31, 48, 100, 255]))
def test_bit_sliced_comparison_equals_hamming_distance(seed, n, radius):
    rng = np.random.default_rng(seed)
    sig = signatures_of(n, rng)
    cuts = sorted({0, n, *rng.integers(0, n, 3)})
    stop = np.repeat(cuts[1:], np.diff(cuts))
    assert S.near_labels(sig, stop, radius).tolist() == brute_labels(sig, stop, radius)


def test_large_bucket_equals_brute_force(monkeypatch):
    monkeypatch.setattr(S, "BIG", 50)
    rng = np.random.default_rng(5)
    sig = signatures_of(300, rng, groups=6, flips=35)
    ids = rng.permutation(300).astype(np.int64)
    a, b = S.bucket_pairs(np.zeros(300, np.int64), ids, sig, 40)
    root = dict(zip(a.tolist(), b.tolist()))
    want = brute_labels(sig, np.full(300, 300), 40)
    for label in set(want):
        members = [int(ids[i]) for i in range(300) if want[i] == label]
        assert {root.get(m, m) for m in members} == {min(members)}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    want = {(x, root(x)) for x in list(label) if root(x) != x}
    assert {tuple(r) for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def words(rnd, n):
    return [rnd.choice("kam lor ven tis dur mak pel".split()) + str(rnd.randrange(3000)) for _ in range(n)]


def test_planted_copies_go_and_others_stay(spark):
    rnd = random.Random(7)
    rows, groups = [], []
    for g in range(60):
        w = words(rnd, rnd.choice([60, 150, 600, 6000]))
        ids = [len(rows)]
        rows.append((len(rows), " ".join(w)))
        for _ in range(rnd.randrange(4)):
            v = [x if rnd.random() > 0.04 else rnd.choice(w) for x in w]
            ids.append(len(rows))
            rows.append((len(rows), " ".join(v).upper() if rnd.random() < 0.3 else " ".join(v)))
        groups.append(ids)
    rnd.shuffle(rows)
    kept = {r["doc_id"] for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {ids[0] for ids in groups}


@pytest.fixture
def edge(spark):
    long = " ".join(words(random.Random(1), 60_000))
    rows = [(1, None, "p"), (None, "same words here", "q"), (2, "", "r"), (3, " .. ", "s"), (4, "same words here", "t"), (4, "same words here", "u"), (5, "same, WORDS here!", "v"), (6, long, "w"), (7, long + " end", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, `sig` string")


def test_nulls_empty_long_and_repeated(edge):
    out = S.near_dedup(edge)
    assert out.columns == edge.columns
    assert sorted(r["sig"] for r in out.collect()) == list("pqrstuw")


def test_empty_table(edge):
    assert S.near_dedup(edge.limit(0)).collect() == []
    kept, removed = S.near_groups(edge.limit(0))
    assert kept.collect() == [] and removed.collect() == []


def test_query_against_brute_force(spark, sf_dir):
    """Groups from all pairs of signatures; the buckets may miss no more than a tenth of the pairs' groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sig = {r["id"]: bytes(r["sig"]) for r in S.signatures(docs).collect() if r["sig"] is not None}
    ids = sorted(sig)
    labels = brute_labels(np.frombuffer(b"".join(sig[i] for i in ids), np.uint8).reshape(-1, 32), np.full(len(ids), len(ids)), S.RADIUS)
    want = {ids[i] for i in range(len(ids)) if labels[i] == i}
    got = {r["doc_id"]: r["group_size"] for r in S.op2_simhash_near_dedup(spark, sf_dir).collect()}
    nothing = docs.count() - len(ids)
    assert sum(got.values()) == docs.count()
    gone = set(ids) - want
    assert want <= set(got) and len(gone & set(got)) <= 0.1 * len(gone) and nothing == len(set(got) - set(ids))


def test_shared_vocabulary_is_no_near_copy(spark):
    """The same words in another order, or without some of them, have near signatures and yet aren't copies."""
    rnd = random.Random(11)
    a = words(rnd, 200)
    b = rnd.sample(a, 200)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b[:100] + ["new"] + b[100:])), (4, " ".join(a).upper()), (5, " ".join(b[::-1]))]
    # rows that repeat an id: one text is a copy of 1 and the other has words of its own
    rows += [(6, " ".join(words(rnd, 50))), (6, " ".join(a[:-1])), (6, " ".join(a[:-1]))]
    sig = {r["id"]: np.frombuffer(bytes(r["sig"]), np.uint8) for r in S.signatures(spark.createDataFrame(rows[:5], "doc_id long, text string")).collect()}
    assert all(np.bitwise_count(sig[1] ^ s).sum() <= S.RADIUS for s in sig.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, removed = S.near_groups(df)
    assert {tuple(r) for r in kept.collect()} == {(1, 5), (2, 2), (5, 1)}
    assert {r["id"] for r in removed.collect()} == {3, 4, 6}


def test_shuffled_texts_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(S.near_groups(docs)[0].collect())
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert sorted(S.near_groups(docs)[0].collect()) == want


def test_confirmed_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 60):
        sig, ids = signatures_of(n, rng, groups=2, flips=40), np.sort(rng.integers(0, 50, n))
        sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12))).astype(np.uint64) for _ in range(n)]
        far = np.unpackbits(sig[:, None] ^ sig[None], axis=2).sum(2)
        a, b = np.array([(i, j) for i in range(n) for j in range(i) if ids[i] == ids[j] or far[i, j] <= 30 and len({*sets[i]} & {*sets[j]}) >= 0.5 * len({*sets[i]} | {*sets[j]})] or [(0, 0)]).T
        assert S.confirmed(ids, sig, sets, 30).tolist() == S.join(np.arange(n), a, b).tolist()


def test_large_buckets_and_groups_are_cut(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rnd = random.Random(12)
    w = words(rnd, 80)
    many = spark.createDataFrame([(10_000 + i, " ".join(w[: 60 + i % 20] + [f"x{i}"])) for i in range(60)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(many)
    want = sorted(S.near_groups(both)[0].collect())
    monkeypatch.setattr(S, "HOT_BUCKET", 7)
    monkeypatch.setattr(S, "HOT_GROUP", 4)
    assert sorted(S.near_groups(both)[0].collect()) == want
    assert max(n for _, n in want) >= 60


def test_coarse_parts_hold_their_keys():
    rng = np.random.default_rng(4)
    keys = S.band_keys(rng.integers(0, 256, (500, 32)).astype(np.uint8), rng.integers(0, S.BAND_BITS, (500, S.BANDS * 2)).astype(np.uint8)).ravel()
    part = S.coarse(keys)
    assert part.min() >= 0 and part.max() < S.BANDS << S.COARSE_BITS and len(np.unique(part)) > 5000
    assert all(len(set(part[keys == k])) == 1 for k in keys[:200])


def test_ids_that_are_not_numbers(spark, edge):
    df = edge.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    out = S.near_dedup(df)
    assert out.schema == df.schema and sorted(r["sig"] for r in out.collect()) == list("pqrstuw")
    kept, removed = S.near_groups(df)
    assert {r["id"] for r in removed.collect()} == {"doc-5", "doc-7"} and ("doc-4", 3) in {tuple(r) for r in kept.collect()}
