import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import retrieval as R


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", f"d{i // 5}", i % 5, f"word{i} common text", [float(x) for x in rng.normal(size=8)]) for i in range(25)]
    return spark.createDataFrame([*rows, ("z", "d9", 0, "zero", [0.0] * 8)], "chunk_id string, document_name string, chunk_index int, content string, embedding array<double>")


def queries(spark, chunks):
    rows = chunks.filter("chunk_id IN ('c3', 'c11')").collect()
    return spark.createDataFrame([(i, r["content"], r["embedding"]) for i, r in enumerate(sorted(rows))], "query_id int, text string, query array<double>")


def test_vector_search_equals_brute_force(spark, chunks):
    q = queries(spark, chunks)
    got = R.batch_vector_search(chunks, q, 6).collect()
    all_ = {r["chunk_id"]: np.array(r["embedding"]) for r in chunks.collect()}
    for r in q.collect():
        v = np.array(r["query"])
        s = sorted(((-(float(x @ v) / (np.linalg.norm(x) or 1) / np.linalg.norm(v)), i) for i, x in all_.items()))[:6]
        assert [x["id"] for x in sorted((x for x in got if x["query_id"] == r["query_id"]), key=lambda x: x["rank"])] == [i for _, i in s]
    one = R.vector_search(chunks, q.first()["query"], 3).collect()
    assert [r["chunk_id"] for r in one] == [x["id"] for x in sorted((x for x in got if x["query_id"] == 0), key=lambda x: x["rank"])][:3]


def test_bm25_against_formula(spark):
    d = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c c c c"), (4, None), (5, "")], "chunk_id int, content string")
    got = {r["id"]: r["score"] for r in R.bm25(d, spark.createDataFrame([(0, "A x")], "query_id int, query string"), 5).collect()}
    idf, mean = math.log(1 + (4 - 1 + 0.5) / 1.5), (3 + 2 + 4 + 0) / 4
    assert got == {1: pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)))}


def ranks(spark, ids):
    return spark.createDataFrame([(0, i, r + 1, 0.0) for r, i in enumerate(ids)], "query_id int, id string, rank int, score double")


def test_fusion(spark):
    got = R.rrf(ranks(spark, "abc"), ranks(spark, "cax")).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "c", "b", "x"] and got[0]["score"] == pytest.approx((1 / 61 + 1 / 62) / (2 / 61))
    pen = {r["id"]: r["score"] for r in R.rrf(ranks(spark, "a"), ranks(spark, "b"), variant="penalty", penalty=60).collect()}
    assert pen["a"] == pytest.approx(1 / 61 + 1 / 180)
    assert [r["id"] for r in R.hybrid(ranks(spark, "abc"), ranks(spark, "").limit(0), 2).orderBy("rank").collect()] == ["a", "b"]


def test_structural_and_pool(spark, chunks):
    seeds = spark.createDataFrame([(0, "c5"), (0, "c7")], "query_id int, chunk_id string")
    near = R.structural(seeds, chunks)
    assert {r["chunk_id"] for r in near.collect()} == {"c6", "c8"}
    got = {r["chunk_id"]: r["provenance"] for r in R.pool([("seed", seeds), ("structural", near.union(seeds))]).collect()}
    assert got == {"c5": "seed", "c7": "seed", "c6": "structural", "c8": "structural"}
    assert {r["provenance"]: r["n"] for r in R.trace(R.pool([("seed", seeds), ("structural", near)])).collect()} == {"seed": 2, "structural": 2}


def test_mmr_against_direct_form():
    rng = np.random.default_rng(9)
    v, q = rng.normal(size=(12, 4)), rng.normal(size=4)
    prov = ["seed", "structural", "other"] * 4
    u, w = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q)
    chosen = []
    while len(chosen) < 5:
        best = None
        for i in range(12):
            if i not in chosen:
                near = max((u[i] @ u[j] for j in chosen), default=0.0)
                s = 0.5 * (u[i] @ w) + 0.2 * R.PRIORITY.get(prov[i], 0.5) + 0.3 * (u[i] @ w - 0.3 * near)
                if best is None or s > best[0] + 1e-12:
                    best = (s, i)
        chosen.append(best[1])
    assert [i for i, _ in R.mmr(q, v, prov, 5)] == chosen


def test_whole_search_and_modes(spark, chunks):
    q = queries(spark, chunks)
    links = spark.createDataFrame([("c3", "e", 1.0), ("c20", "e", 0.5), ("c11", "f", 1.0)], "chunk_id string, entity_id string, score double")
    got = R.search(chunks, q, 4, associations=links, neighbours=spark.createDataFrame([("e", "f")], "entity_id string, neighbour string")).collect()
    assert {r["query_id"] for r in got} == {0, 1} and all(sum(r["query_id"] == i for r in got) == 4 for i in (0, 1))
    with pytest.raises(ValueError):
        R.search(chunks, q, 4, mode="odd")


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    h = spark.createDataFrame([(0, "other", 0, "x" * 40), (0, "seed", 0, "y" * 80), (0, "seed", 1, "z" * 400), (0, "structural", 0, "w" * 4)], "query_id int, provenance string, position int, content string")
    assert [r["content"][0] for r in R.prompt_budget(h, 100).collect()] == ["y"]


def test_missing_entities_are_filled(spark, chunks):
    cohort = spark.createDataFrame([(0, "c1")], "query_id int, chunk_id string")
    asked = spark.createDataFrame([(0, "WORD1"), (0, "word7")], "query_id int, entity string")
    miss = R.missing_entities(cohort, chunks, asked)
    assert [r["entity"] for r in miss.collect()] == ["word7"]
    assert {r["chunk_id"] for r in R.fill_missing(miss, chunks).collect()} == {"c7"}


def test_near_duplicate_hits_go(spark):
    h = spark.createDataFrame([(0, "a", 0.9, [1.0, 0.0]), (0, "b", 0.8, [1.0, 0.01]), (0, "c", 0.7, [0.0, 1.0])], "query_id int, chunk_id string, score double, embedding array<double>")
    assert sorted(r["chunk_id"] for r in R.near_duplicates_out(h).collect()) == ["a", "c"]


def test_ndcg_and_run_diff(spark):
    d = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (1, 1, 0.0)], "query_id int, rank int, relevance double")
    assert {r["query_id"]: r["ndcg"] for r in R.ndcg(d, 10).collect()} == {0: pytest.approx(1 / math.log2(3)), 1: 0.0}
    a, b = (spark.createDataFrame([(0, x) for x in s], "query_id int, chunk_id string") for s in ("ab", "bc"))
    assert tuple(R.run_diff(a, b).first()) == (0, ["b"], ["a"], ["c"])


def test_search_expands_by_entity_vectors_and_completes(spark):
    rows = [(f"c{i}", "d", i, f"text {i}" + (" zeta" if i == 9 else ""), [1.0, i / 10]) for i in range(10)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_name string, chunk_index int, content string, embedding array<double>").withColumn("chunk_type", F.lit("document"))
    asked = spark.createDataFrame([(0, "text", [1.0, 0.0])], "query_id int, text string, query array<double>")
    links = spark.createDataFrame([("c8", "e", 1.0)], "chunk_id string, entity_id string, score double")
    vectors = spark.createDataFrame([("e", [1.0, 0.0])], "entity_id string, embedding array<double>")
    entity = spark.createDataFrame([(0, "zeta")], "query_id int, entity_id string")
    plain = R.search(chunks, asked, 1)
    assert {r["chunk_id"] for r in plain.collect()} == {"c0"}
    pooled = {r["chunk_id"] for r in R.search(chunks, asked, 10, associations=links, entity_vectors=vectors).filter("provenance = 'entity_embedding' OR chunk_id = 'c8'").collect()}
    assert pooled == {"c8"}
    done = R.search(chunks, asked, 1, query_entities=entity, complete=True).orderBy("rank").collect()
    assert [(r["chunk_id"], r["provenance"], r["rank"]) for r in done] == [("c0", "seed", 1), ("c9", "entity_embedding", 2)]
    assert [r["chunk_id"] for r in R.search(chunks, asked, 1, query_entities=spark.createDataFrame([(0, "text")], "query_id int, entity_id string"), complete=True).collect()] == ["c0"]
