import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmere.functions.embed import embedded, hash_embedding
from quillmere.operators import entities, store as S
from quillmere.plans import index as I
from quillmere.streaming import incremental


def test_snapshots_stage_and_promote(spark, tmp_path):
    s = S.Snapshots(spark, f"file://{tmp_path}/store")
    assert s.read("documents").count() == 0 and s.version("documents") == 0
    s.stage("domains", spark.createDataFrame([("a", None, None, None)], S.SCHEMAS["domains"]))
    assert s.read("domains").count() == 0
    assert s.promote("domains") == 1 and s.read("domains").count() == 1
    assert s.write("domains", s.read("domains").union(s.read("domains"))) == 2 and s.read("domains").count() == 2
    with pytest.raises(ValueError):
        s.promote("domains")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in S.upsert(old, new, ["k"], F.col("v")).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert {r["k"]: r["v"] for r in S.insert_new(old, new, ["k"]).collect()}[2] == "b"


def test_domains(spark):
    d = spark.createDataFrame([("a", None, "n"), ("b", "a", "n"), ("c", "b", "n"), ("g", None, "global"), ("x", "y", "n"), ("y", "x", "n")], "domain_id string, parent_id string, namespace string")
    roots = lambda *r: spark.createDataFrame([(x,) for x in r], "domain_id string")
    assert {r[0] for r in S.domain_closure(d, roots("b")).collect()} == {"b", "c", "g"}
    assert {r[0] for r in S.domain_closure(d, roots("x"), False).collect()} == {"x", "y"}


def test_cache_validity(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    sources = spark.createDataFrame([("n", "s1", t(5)), ("m", "s2", t(1)), ("o", "s3", None)], "namespace string, source_id string, last_crawled timestamp")
    files = spark.createDataFrame([("s1", t(4)), ("s2", t(2))], "source_id string, modificationTime timestamp")
    chunks = spark.createDataFrame([("n",), ("m",), ("o",)], "namespace string")
    assert {r["namespace"]: r["valid"] for r in S.cache_valid(sources, files, chunks).collect()} == {"n": True, "m": False, "o": False}


def test_embedding_hook(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    got = [r["embedding"] for r in embedded(df, "t", hash_embedding(16), batch=1).collect()]
    assert len(got[0]) == 16 and got[1] is None and not any(got[2])


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    for i in range(12):
        (root / f"f{i}.md").write_text(f"# Topic {i}\n\nAlpha engine number {i} uses the beta pump. " + f"Detail {i} of the machine. " * 30)
    (root / "broken.py").write_text("def (:")
    m = entities.Matcher.vocabulary([entities.Entity(w, w, w) for w in ("alpha engine", "beta pump", "machine")])
    config = {"store": f"file://{root}/store", "sources": [{"type": "directory", "path": str(root), "extensions": ["md", "py"], "exclude": ["store"]}], "index": {"threshold": 0.9}}
    return I.build(spark, config, hash_embedding(32), m)


def test_build_makes_all_tables(index):
    n = index.snapshots.read("embeddings").count()
    assert n >= 12 and index.snapshots.read("chunk_entities").select("entity_id").distinct().count() == 3
    assert index.snapshots.read("chunk_communities").groupBy("level").count().filter(f"count = {n}").count() == 3
    assert index.snapshots.read("context_graph_edges").count() == 6


def test_search_and_ask(index):
    hits = index.search(["Topic 7 alpha engine number 7", "beta pump"], 5).collect()
    assert {r["query_id"] for r in hits} == {0, 1} and any("number 7" in r["content"] for r in hits if r["query_id"] == 0)
    assert index.search(["Topic"], 3, namespaces=["other"]).count() == 0
    a = index.ask("What uses the beta pump?", lambda p: f"answer to {len(p)}", 3)
    assert a.text == f"answer to {len(a.prompt)}" and len(a.citations) == 3 and "beta pump" in a.prompt


def test_redaction(index):
    index.redact = lambda t: t.replace("beta", "####")
    try:
        assert "beta pump." not in index.ask("engine", lambda p: "x", 2).prompt
    finally:
        index.redact = None


def test_changes_are_incremental(index, spark):
    docs = spark.createDataFrame([("new", "A new text."), ("other", "B text.")], "document_name string, content string")
    assert index.add(docs) == {"added": 2} and index.add(docs) == {"skipped": 2}
    again = spark.createDataFrame([("new", "A changed text."), (None, "x"), ("null", None)], "document_name string, content string")
    assert index.add(again) == {"updated": 1}
    mine = index.snapshots.read("embeddings").filter("document_name = 'new'").collect()
    assert [r["content"] for r in mine] == ["A changed text."]
    assert index.remove(["new", "other", "absent"]) == 2
    with pytest.raises(ValueError):
        index.add_source({"type": "odd"})


def test_routing():
    both = {"a": "apples", "b": "pears", "c": ""}
    assert I.route("q", {"a": "x"}, lambda p: 1 / 0) is None
    assert I.route("q", both, lambda p: '```json\n["b", "z", 1]\n```') == ["b"]
    assert I.route("q", both, lambda p: "b") is None and I.route("q", both, lambda p: '["z"]') is None


def test_structured_answers():
    said = iter(["no json", '{"answer": "x", "claims": ["c"], "evidence": null}'])
    got = I.structured("p", lambda p: next(said))
    assert (got.answer, got.claims, got.evidence) == ("x", ["c"], [])
    assert I.structured("p", lambda p: "plain").answer == "plain"


def test_stores_merge_by_score(spark):
    a, b = (spark.createDataFrame([(0, c, s, 1) for c, s in rows], "query_id int, chunk_id string, score double, rank int") for rows in ([("x", 0.9), ("y", 0.1)], [("z", 0.5)]))
    assert [(r["chunk_id"], r["store"]) for r in I.merged([a, b], 2).orderBy("rank").collect()] == [("x", 0), ("z", 1)]


def test_claims_without_support_find_their_chunk(index):
    chunks = index.snapshots.read("embeddings")
    claims = embedded(chunks.limit(1).select(F.lit(1).alias("claim_id"), "embedding_content"), "embedding_content", hash_embedding(32))
    assert [r["claim_id"] for r in I.gaps(claims, chunks).collect()] == [1]


def test_vacuum_keeps_the_current_snapshot(spark, tmp_path):
    s = S.Snapshots(spark, f"file://{tmp_path}/store")
    for n in ("a", "b", "c"):
        s.write("sources", spark.createDataFrame([(n, None, None, None)], S.SCHEMAS["sources"]))
    assert s.vacuum("sources") == 2 and s.read("sources").first()["source_id"] == "c"


def test_stream_indexes_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("first text of the file")
    s = S.Snapshots(spark, f"file://{tmp_path}/store")
    seen = []
    for text in (None, "second text"):
        if text:
            (tmp_path / "in/b.txt").write_text(text)
        q = incremental.index_stream(incremental.text_files(spark, str(tmp_path / "in")), s, str(tmp_path / "ck"), on_batch=lambda n, c: seen.append(c))
        q.awaitTermination()
    assert seen == [{"added": 1}, {"added": 1}] and s.read("documents").count() == 2 and s.read("embeddings").count() == 2


def test_event_windows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    q = incremental.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_tables_change_together(spark, tmp_path):
    """A crash between the joint pointer and the tables' own leaves both tables at the new state."""
    s = S.Snapshots(spark, f"file://{tmp_path}/store")
    row = lambda n: spark.createDataFrame([(n, None, None, None)], S.SCHEMAS["sources"])
    names = spark.createDataFrame([("n", "x")], S.SCHEMAS["namespaces"])
    s.write("sources", row("old"))
    s.stage("sources", row("new"))
    with pytest.raises(ValueError):
        s.promote_together(["sources", "namespaces"])
    s.stage("namespaces", names)
    point, s._point = s._point, lambda t, x: None
    s.promote_together(["sources", "namespaces"])
    s._point = point
    assert s.read("sources").first()["source_id"] == "new" and s.read("namespaces").count() == 1 and s.version("sources") == 2
    assert s.vacuum("sources") == 1 and s.read("sources").first()["source_id"] == "new"
    s.write("sources", row("newer"))
    assert s.read("sources").first()["source_id"] == "newer" and s.version("sources") == 3


def test_rebuild_does_what_is_new(index, spark, monkeypatch):
    matcher = entities.Matcher.vocabulary([entities.Entity("alpha", "alpha", "Alpha"), entities.Entity("zeta", "zeta", "Zeta")])
    rebuild = lambda **how: index.rebuild(matcher, levels=(1.0,), algorithm="components", **how)
    assert rebuild() and not rebuild()
    index.add(spark.createDataFrame([("fresh", "A zeta text.")], "document_name string, content string"))
    seen = []
    match = I.entities.match_entities
    monkeypatch.setattr(I.entities, "match_entities", lambda chunks, m: seen.append(chunks.count()) or match(chunks, m))
    total = index.snapshots.read("embeddings").count()
    assert rebuild() and 1 <= seen[0] < total
    links = index.snapshots.read("chunk_entities")
    assert links.filter("entity_id = 'zeta'").count() == 1
    whole = {(r["chunk_id"], r["entity_id"], round(r["score"], 9)) for r in links.collect()}
    assert rebuild(force=True) and seen[1] == total
    assert {(r["chunk_id"], r["entity_id"], round(r["score"], 9)) for r in index.snapshots.read("chunk_entities").collect()} == whole
    # a document that changes loses its old associations at once
    index.add(spark.createDataFrame([("fresh", "A zeta text no more, but much longer.")], "document_name string, content string"))
    assert index.snapshots.read("chunk_entities").filter("entity_id = 'zeta'").count() == 0
    assert rebuild() and index.snapshots.read("chunk_entities").filter("entity_id = 'zeta'").count() == 1
    index.remove(["fresh"])


def test_search_uses_entities_and_asks_with_topics(index):
    matcher = entities.Matcher.vocabulary([entities.Entity("beta", "beta pump", "beta pump")])
    hits = index.search(["What uses the beta pump?"], 3, matcher=matcher, complete=True).collect()
    assert any("beta pump" in r["content"] for r in hits)
    assert all(r["content"].startswith(r["breadcrumb"]) for r in hits if r["breadcrumb"])
    a = index.ask("What uses the beta pump?", lambda p: "x", 3)
    assert a.prompt.index("Query: What uses") < a.prompt.index("[") or a.prompt.startswith("Context: ")


def test_indexer_reports_and_stops(index, spark, tmp_path):
    spark.createDataFrame([("t1", "One text."), ("t2", "Two text.")], "n string, c string").write.parquet(f"{tmp_path}/t.parquet")
    good = {"type": "table", "path": f"{tmp_path}/t.parquet", "name_col": "n", "content_col": "c"}
    told = []
    run = I.Indexer(index, lambda *x: told.append(x), lambda n: told.append(("done", n)), lambda p, e: told.append((p, type(e).__name__)), lambda n: told.append(("aborted", n)))
    run.start([{"type": "odd"}, good], lambda i: told.append("rebuilt")).join()
    assert told == [("source", 0, 2), ("source", "ValueError"), ("source", 1, 2), ("source", 2, 2), "rebuilt", ("rebuild", 1, 1), ("done", 2)]
    told.clear()
    run.abort()
    assert run.run([good]) == 0 and told == [("aborted", 0)]
    assert index.remove(["t1", "t2"]) == 2


def test_questions_are_taken_apart():
    assert I.decompose("q", lambda p: '```json\n["a", "b", "q", 3, " "]\n```') == ["q", "a", "b"]
    assert I.decompose("q", lambda p: "no list") == ["q"] and I.decompose("q", lambda p: '{"a": 1}') == ["q"]
