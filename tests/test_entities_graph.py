import pytest
from pyspark.sql import functions as F

from quillmere.operators import clusters, entities as N, graph as G


def test_matcher_needs_word_edges_and_the_later_entity_wins():
    m = N.Matcher.vocabulary([N.Entity("1", "ann", "Ann", aliases=("an",)), N.Entity("2", "cat", "ANN")])
    assert m.find("Ann, joann ann2 ANN an") == {"2": [(0, 3), (16, 19)], "1": [(20, 22)]}
    exact = N.Matcher.vocabulary([N.Entity("1", "Ann", "Ann")], mode="exact")
    assert exact.find("ann Ann") == {"1": [(4, 7)]}


def test_schema_matcher_finds_variants():
    m = N.Matcher.schema(["customerOrders"])
    (name,) = m.entities
    assert set(m.find("see customer_order and customer orders")) == {name}


def test_normal_forms():
    assert N.normalize_entity(" (U.S.A.) ") == "USA"
    assert N.normalize_entity("big boxes") == "big box" and N.normalize_entity("data") == "data" and N.normalize_entity("the series") == "the series"


def test_vocabulary_beats_overlapping_generic(spark):
    chunks = spark.createDataFrame([("c", "New York City council")], "chunk_id string, content string")
    vocab = N.match_entities(chunks, N.Matcher.vocabulary([N.Entity("ny", "new york", "New York")]))
    ner = N.model_entities(chunks, lambda t: [("York City", "GPE", 4, 13), ("council,", "ORG", 14, 21)])
    got = {r["entity_id"]: [tuple(s) for s in r["spans"]] for r in N.merge_matches(vocab, ner).collect()}
    assert got["ny"] == [(0, 8)] and len(got) == 2


def counts(spark):
    rows = [(f"c{i}", e) for i in range(3) for e in "ab"] + [(f"d{i}", e) for i in range(3) for e in "xy"] + [("z", "a"), ("z", "x")]
    return spark.createDataFrame(rows, "chunk_id string, entity_id string")


def test_cooccurrence_and_clusters(spark):
    p = counts(spark)
    got = {(r["a"], r["b"]): r["count"] for r in clusters.cooccurrence(p, 7, "raw").collect()}
    assert got == {("a", "b"): 3, ("x", "y"): 3}
    scores = clusters.cooccurrence(p, 7, "pmi")
    for algorithm in ("agglomerative", "dbscan", "louvain"):
        c = clusters.cluster_entities(p.select("entity_id").distinct(), scores, algorithm, 0.5)
        groups = {}
        for r in c.collect():
            groups.setdefault(r["cluster_id"], set()).add(r["entity_id"])
        assert sorted(map(sorted, groups.values())) == [["a", "b"], ["x", "y"]], algorithm
    with pytest.raises(ValueError):
        clusters.cooccurrence(p, 7, "other")


def test_average_linkage_and_modularity():
    assert len(set(clusters.average_linkage(4, [(0, 1, 0.1), (2, 3, 0.2), (1, 2, 0.9)], 0.5).tolist())) == 2
    ring = [(a, b, 1.0) for g in (0, 4) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 4, 0.1)]
    label = clusters.modularity(8, ring).tolist()
    assert len(set(label[:4])) == 1 and len(set(label[4:])) == 1 and label[0] != label[4]


def test_similarity_edges_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(clusters, "BLOCK", 20)
    v = np.random.default_rng(1).normal(size=(90, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in clusters.similarity_edges(df, 0.5).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if v[i] @ v[j] >= 0.5}


def test_components_and_coherence(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "chunk_id long")
    edges = spark.createDataFrame([(3, 4, 1.0), (4, 5, 1.0), (6, 7, 1.0)], "a long, b long, weight double")
    got = {r["chunk_id"]: r["community_id"] for r in clusters.partition(nodes, edges, algorithm="components").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6}
    m = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 1.0]), ("h", [1.0, 0.0])], "g string, v array<double>")
    assert {r["g"]: (r["size"], r["coherence"]) for r in clusters.coherence(m, "g", "v").collect()} == {"g": (2, 0.0), "h": (1, 0.0)}
    assert clusters.resolutions(3) == pytest.approx([0.25, 0.25 * 8**0.5, 2.0])


def test_summaries_by_a_fake_model(spark):
    m = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z")], "community_id int, chunk_id string, content string")
    got = clusters.summarize_communities(m, lambda t: f"sum:{len(t)}").collect()
    assert [(r["document_name"], r["content"], r["chunk_type"]) for r in got] == [("community:1", "sum:4", "community_summary")]


def test_context_edges_are_symmetric_and_bounded(spark):
    p = counts(spark)
    c = spark.createDataFrame([(f"c{i}", "k1") for i in range(3)] + [(f"d{i}", "k2") for i in range(3)] + [("z", "k1")], "chunk_id string, cluster_id string")
    t = spark.createDataFrame([("b", "y"), ("b", "unknown")], "subject_id string, object_id string")
    e = G.context_edges(p, c, t).collect()
    w = {(r["source"], r["target"]): r["weight"] for r in e}
    assert all(w[b, a] == x and 0.1 <= x <= 1 for (a, b), x in w.items())
    assert max(w.values()) == 1.0 and ("b", "y") in w and not any("unknown" in k for k in w)


def test_triples(spark):
    answer = '```json\n[{"subject_id": "a", "verb": "requires", "object_id": "b", "confidence": 0.5}, {"subject_id": "a", "verb": "zzz", "object_id": "b"}, {"subject_id": "a", "verb": "requires", "object_id": "q"}, 7]\n```'
    assert [r[:4] for r in G.parse_triples(answer, ["a", "b"])] == [("a", "requires", "b", 0.5)]
    chunks = spark.createDataFrame([("c", "t", ["a", "b"])], "chunk_id string, content string, entities array<string>")
    assert G.extract_triples(chunks, lambda p: answer).count() == 1
    assert G.extract_triples(chunks, lambda p: "not json").count() == 0


def test_two_hops_with_a_cycle(spark):
    t = spark.createDataFrame([("a", "uses", "b"), ("b", "uses", "c"), ("c", "uses", "a"), ("c", "uses", "d")], "subject_id string, verb string, object_id string")
    one, two, near = G.two_hop(t, spark.createDataFrame([("a",)], "id string"))
    assert sorted(r[0] for r in one.collect()) == ["b", "c"] and [r[0] for r in two.collect()] == ["d"] and near.count() == 2


def test_user_aliases_win(spark):
    a = spark.createDataFrame([("x", "1", None, "auto"), ("x", "2", None, "user"), ("y", "3", None, "b"), ("y", "4", None, "a")], "alias string, entity_id string, namespace string, source string")
    assert {r["alias"]: r["entity_id"] for r in G.alias_table(a).collect()} == {"x": "2", "y": "4"}


def test_scores_use_the_whole_corpus(spark):
    chunks = spark.createDataFrame([("1", "ann ann"), ("2", "bob"), ("3", "ann bob"), ("4", None)], "chunk_id string, content string")
    m = N.Matcher.vocabulary([N.Entity("ann", "ann", "ann"), N.Entity("bob", "bob", "bob")])
    got = {(r["chunk_id"], r["entity_id"]): r["score"] for r in N.score_associations(N.match_entities(chunks, m), 4).collect()}
    import math

    assert got["1", "ann"] == pytest.approx(0.4 * math.log1p(2) + 0.3 + 0.3 * math.log(4 / 2))
    assert N.remove_chunks(spark.createDataFrame([("1",)], "chunk_id string"), chunks).count() == 0


def test_bridge_edges_of_a_kind_in_blocks_are_spread_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "PAIR_BLOCK", 8, raising=False)
    monkeypatch.setattr(clusters, "PAIRS", 64, raising=False)
    docs = [(f"c{i}", "x" if i % 3 else "y") for i in range(60)] + [("lone", "z"), ("c1", "y"), ("no", None)]
    links = [(f"c{i}", e) for i in range(60) for e in ("a", "b", "c")[: 1 + i % 2]] + [("lone", "c"), ("no", "a")]
    got = clusters.bridge_edges(spark.createDataFrame(links, "chunk_id string, entity_id string"), spark.createDataFrame(docs, "chunk_id string, document_name string"))
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    of = {}
    for c, e in links:
        of.setdefault(c, set()).add(e)
    want = [(a, b) for a, d in docs for b, k in docs if a < b and d and k and d != k and of[a] & of[b]]
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(want)
    # tasks are as many as the pairs ask for, not as the ids that are shuffled
    assert len({r["task"] for r in rows}) > 4


def test_brands_are_counted_before_they_meet(spark, monkeypatch):
    from collections import Counter

    from quillmere.plans import registry, registry_more

    rows = [(k, b) for k, b, n in ((1, "x", 50), (1, "y", 40), (2, "x", 3), (2, "y", 2), (2, "z", 1), (None, "z", 5), (3, None, 2), (3, "z", 1)) for _ in range(n)]
    seen = []
    monkeypatch.setattr(registry_more.clusters, "cluster_entities", lambda e, met, *how: seen.append(met) or e)
    part = spark.createDataFrame(rows, "p_size int, p_brand string")
    monkeypatch.setattr(registry.loaders, "read_table", lambda *a: part)
    registry.QUERIES["dbscan_clusters"](spark, "")
    want = Counter((a, b) for k, a in rows for m, b in rows if k is not None and k == m and a and b and a < b)
    assert {(r["a"], r["b"]): r["score"] for r in seen[0].collect()} == {x: n for x, n in want.items() if n >= 2}
    joined = seen[0]._jdf.queryExecution().optimizedPlan().toString().partition("Join")[2]
    assert joined.count("Aggregate") == 2


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_communities_are_fed_by_batches_and_equal_the_plain_method(spark, monkeypatch, kind):
    import random

    r = random.Random(3)
    name = (lambda i: 2**60 + i) if kind == "bigint" else (lambda i: f"c{i:03d}")
    pairs = {tuple(sorted(r.sample(range(lo, hi), 2))): r.random() for lo, hi, n in ((0, 120, 900), (120, 160, 60)) for _ in range(n)}
    pairs = {p: round(w, 3) for p, w in pairs.items()}
    nodes = spark.createDataFrame([(name(i),) for i in range(170)], f"chunk_id {kind}")
    edges = spark.createDataFrame([(name(a), name(b), w) for (a, b), w in pairs.items()], f"a {kind}, b {kind}, weight double")
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        part = clusters.partition(nodes, edges)
        assert "FlatMapGroups" not in part._jdf.queryExecution().optimizedPlan().toString()
        got = {x["chunk_id"]: x["community_id"] for x in part.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    label = clusters.modularity(170, [])
    comp = {x["id"]: x["component"] for x in clusters.connected_components(nodes.withColumnRenamed("chunk_id", "id"), edges).collect()}
    for one in set(comp.values()):
        mine = [i for i in range(170) if comp[name(i)] == one]
        at = {x: k for k, x in enumerate(mine)}
        found = clusters.modularity(len(mine), sorted((at[a], at[b], w) for (a, b), w in pairs.items() if a in at))
        for k, i in enumerate(mine):
            label[i] = mine[list(found).index(found[k])]
    assert got == {name(i): name(label[i]) for i in range(170)}


@pytest.mark.parametrize("held", [1 << 23, 100])
def test_modularity_of_links_in_a_file_equals_that_in_memory(monkeypatch, held):
    import random

    import numpy as np

    monkeypatch.setattr(clusters, "HELD", held)
    monkeypatch.setattr(clusters, "READ", held)
    r = random.Random(1)
    pairs = {tuple(sorted(r.sample(range(200), 2))): r.random() for _ in range(900)}
    edges = sorted((a, b, w) for (a, b), w in pairs.items())
    both = sorted(edges + [(b, a, w) for a, b, w in edges])
    links = clusters.Links()
    for k in range(0, len(both), 70):
        links.add(np.array([b for _, b, _ in both[k : k + 70]]), np.array([w for *_, w in both[k : k + 70]]))
    start = np.concatenate([[0], np.cumsum(np.bincount([a for a, *_ in both], minlength=200))])
    assert (links.file is not None) == (held == 100)
    assert (clusters.modularity_of(start, links.done()) == clusters.modularity(200, edges)).all()
