"""More registered queries with their SQL: store changes, search stages, entities, extractors and text functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import embed, text as X
from ..operators import chunking, clusters, entities, graph, retrieval, store
from ..sources import extract, loaders
from . import index
from .registry import _BM25, _ENT, _TRI, _V, SQL, TERMS, VOCABULARY, _found, _triples, _words, query, r6

# changes of the store


def _turns(t):
    """Conversations as documents, turns as their chunks, roles as namespaces."""
    return t("conversations").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("document_name"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), F.col("role").alias("namespace"))


@query("""SELECT 'chunk' AS kind, conv_id || '_' || turn AS id, 1::BIGINT AS n FROM conversations WHERE conv_id <> 3 UNION ALL SELECT DISTINCT 'document', conv_id::VARCHAR, 1 FROM conversations WHERE conv_id <> 3
UNION ALL SELECT 'deleted', '3', count(*) FROM conversations WHERE conv_id = 3""")
def deleted_document(spark, t):
    c = _turns(t)
    chunks, docs, n = store.delete_document(c, c.select("document_name").distinct(), "3")
    one = F.lit(1).cast("long")
    return chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), one.alias("n")).union(docs.select(F.lit("document"), "document_name", one)).union(n.select(F.lit("deleted"), F.lit("3"), "deleted"))


def _domains(t):
    """Documents as chunks with their source as the domain, and the entities found in them."""
    chunks = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("domain_id"), F.lit("old").alias("namespace"))
    return {"embeddings": chunks, "chunk_entities": _found(t).select("chunk_id", "entity_id", F.lit("old").alias("namespace"))}


@query(f"""WITH {_ENT} SELECT 'embeddings' AS tbl, source AS key, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src3') GROUP BY source
UNION ALL SELECT 'chunk_entities', entity_id, count(*) FROM en JOIN documents USING (doc_id) WHERE source NOT IN ('src1', 'src3') GROUP BY entity_id""")
def deleted_domains(spark, t):
    left = store.delete_domains(_domains(t), spark.createDataFrame([("src1",), ("src3",)], "domain_id string"))
    count = lambda name, key: left[name].groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), F.col(key).alias("key"), "n")
    return count("embeddings", "domain_id").union(count("chunk_entities", "entity_id"))


@query(f"""WITH {_ENT}, e AS (SELECT source, entity_id FROM en JOIN documents USING (doc_id))
SELECT 'source' AS side, 'embeddings' AS tbl, source AS key, 'old' AS namespace, count(*) AS n FROM documents WHERE source <> 'src2' GROUP BY source UNION ALL SELECT 'target', 'embeddings', source, 'moved', count(*) FROM documents WHERE source = 'src2' GROUP BY source
UNION ALL SELECT 'target', 'embeddings', role, 'there', count(*) FROM conversations GROUP BY role
UNION ALL SELECT 'source', 'chunk_entities', entity_id, 'old', count(*) FROM e WHERE source <> 'src2' GROUP BY entity_id UNION ALL SELECT 'target', 'chunk_entities', entity_id, 'moved', count(*) FROM e WHERE source = 'src2' GROUP BY entity_id""")
def promoted_domain(spark, t):
    """A source's documents move to a store that holds conversations."""
    there = {"embeddings": _turns(t).select("chunk_id", F.col("namespace").alias("domain_id"), F.lit("there").alias("namespace")), "chunk_entities": spark.createDataFrame([], "chunk_id string, entity_id string, namespace string")}
    sides = store.promote_domain(_domains(t), there, "src2", "moved")
    out = None
    for side, tables in zip(("source", "target"), sides):
        for name, key in (("embeddings", "domain_id"), ("chunk_entities", "entity_id")):
            part = tables[name].groupBy(key, "namespace").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), F.lit(name).alias("tbl"), F.col(key).alias("key"), "namespace", "n")
            out = part if out is None else out.union(part)
    return out


_NS = "CASE WHEN s_acctbal < 0 THEN 'global' WHEN s_acctbal < 5000 THEN 'a' ELSE 'b' END"


@query(f"SELECT s_name AS chunk_id, {_NS} AS namespace FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 2) AND {_NS} IN ('a', 'global')")
def session_view(spark, t):
    """Chunks that a session of namespace a sees with two regions active; nations are domains below them."""
    n = F.lit(None).cast("string")
    d = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("domain_id"), n.alias("parent_id")).union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    c = t("supplier").select(F.col("s_name").alias("chunk_id"), F.concat(F.lit("n"), "s_nationkey").alias("domain_id"), F.expr(_NS).alias("namespace"))
    return store.session_chunks(c, store.domain_closure(d, spark.createDataFrame([("r1",), ("r2",)], "domain_id string")), "a").select("chunk_id", "namespace")


@query("""WITH s AS (SELECT c_mktsegment || '-' || c_nationkey AS namespace, c_custkey, CASE WHEN c_acctbal > -900 THEN c_acctbal END AS crawled FROM customer), f AS (SELECT o_custkey, max(o_totalprice) AS changed FROM orders GROUP BY 1),
g AS (SELECT namespace, bool_and(crawled IS NOT NULL AND (changed IS NULL OR changed <= crawled * 100 + 400000)) AS ok FROM s LEFT JOIN f ON o_custkey = c_custkey GROUP BY 1),
n AS (SELECT c_mktsegment || '-' || c_nationkey AS namespace, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1)
SELECT namespace, ok AND coalesce(n, 0) > 0 AS valid FROM g LEFT JOIN n USING (namespace)""")
def cache_validity(spark, t):
    """Customers as sources, their orders as files (prices stand for times), rich ones as chunks."""
    ns = F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("namespace")
    c = t("customer")
    sources = c.select(ns, F.col("c_custkey").alias("source_id"), F.when(F.col("c_acctbal") > -900, F.col("c_acctbal") * 100 + 400000).alias("last_crawled"))
    files = t("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_totalprice").alias("modificationTime"))
    return store.cache_valid(sources, files, c.filter("c_acctbal > 8000").select(ns))


@query("SELECT c_custkey AS source_id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') OR c_acctbal > 0 AS crawled FROM customer")
def crawl_marks(spark, t):
    sources = t("customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_acctbal") > 0, F.lit(0).cast("timestamp")).alias("last_crawled"))
    done = t("orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("source_id"))
    return store.mark_crawled(sources, done).select("source_id", F.col("last_crawled").isNotNull().alias("crawled"))


_DOCS = "SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws, sha256(text) AS h FROM documents WHERE text IS NOT NULL"


@query(f"""WITH d AS ({_DOCS}) SELECT doc_id::VARCHAR AS document_name, ceil(len(ws) / 256)::INT AS chunk_count, h AS content_hash FROM d
UNION ALL SELECT conv_id::VARCHAR, 1, sha256(max(text)) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM d) GROUP BY conv_id""")
def synced_registry(spark, t):
    """The registry after documents are synced over conversations of the same names, in windows of 256 words."""
    old = t("conversations").groupBy(F.col("conv_id").cast("string").alias("document_name")).agg(F.max("text").alias("x")).select("document_name", store.document_hash(F.col("x")).alias("content_hash"), F.lit(None).cast("string").alias("source_uri"), F.current_timestamp().alias("indexed_at"), F.lit(1).alias("chunk_count"))
    new = t("documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("document_name"), F.col("text").alias("content"))
    chunks = spark.createDataFrame([], "document_name string, content string")
    _, registry = store.sync(chunks, old, new, lambda d: chunking.token_windows(d, "document_name", "content").select(F.col("key").alias("document_name"), "content"))
    return registry.select("document_name", "chunk_count", "content_hash")


@query("SELECT role AS namespace, count(*) AS n FROM conversations WHERE role IN ('user', 'system') AND turn <= 3 GROUP BY role")
def allowed_chunks(spark, t):
    """The allow-list of namespaces and kinds."""
    c = _turns(t).withColumn("chunk_type", F.when(F.col("chunk_index") <= 3, "head").otherwise("tail"))
    return c.filter(retrieval.filters(["user", "system"], ["head"])).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


# stages of a search

_Q5 = [(1, "that with the"), (2, "les que nicht"), (3, "licensed under license"), (4, "idiot clown"), (5, "zzzz qqqq")]
_BM = _BM25.replace("(4, ['idiot', 'clown'])", "(4, ['idiot', 'clown']), (5, ['zzzz', 'qqqq'])")


@query(f"""WITH {_BM}, v AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM documents, (SELECT DISTINCT query_id FROM q) WHERE text IS NOT NULL),
a AS (SELECT query_id, doc_id, rank AS r1 FROM v WHERE rank <= 30), c AS (SELECT query_id, doc_id, rank AS r2 FROM w WHERE rank <= 30),
j AS (SELECT query_id, doc_id, r1, r2, (coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0)) / (2.0::DOUBLE / 61) AS score FROM a FULL JOIN c USING (query_id, doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS rank FROM j WHERE query_id IN (SELECT query_id FROM c))
SELECT query_id, doc_id, rank::INT AS rank FROM k WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, r1::INT FROM a WHERE r1 <= 10 AND query_id NOT IN (SELECT query_id FROM c)""")
def hybrid_search(spark, t):
    """Word hits fused with a list by length; a query without word hits keeps that list."""
    q = spark.createDataFrame(_Q5, "query_id int, query string")
    words = retrieval.bm25(t("documents"), q, 30, "doc_id", "text")
    by_length = t("documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.desc("n_chars"), "id").limit(30).crossJoin(q.select("query_id"))
    by_length = by_length.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "id"))).withColumn("score", F.lit(0.0))
    return retrieval.hybrid(by_length, words, 10).select("query_id", F.col("id").alias("doc_id"), "rank")


_LINKS = "e AS (SELECT doc_id::VARCHAR AS chunk_id, lang || '-' || source AS entity_id, n_chars AS score FROM documents)"
_POOL = f"{_BM25}, po AS (SELECT query_id, doc_id::VARCHAR AS chunk_id FROM w WHERE rank <= 20), {_LINKS}, fo AS (SELECT DISTINCT query_id, entity_id FROM po JOIN e USING (chunk_id)), be AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, chunk_id) AS r FROM e)"


def _links(t):
    """Every document has one entity, of its language and source, scored by length."""
    return t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat_ws("-", "lang", "source").alias("entity_id"), F.col("n_chars").alias("score"))


def _pool(spark, t):
    return _words(spark, t, 20).select("query_id", F.col("id").cast("string").alias("chunk_id"))


@query(f"WITH {_POOL} SELECT query_id, be.chunk_id, be.entity_id AS linked_by FROM fo JOIN be USING (entity_id) WHERE r <= 3")
def entity_expansion(spark, t):
    return retrieval.by_entities(_pool(spark, t), _links(t), 3)


@query(f"""WITH {_POOL}, g AS (SELECT DISTINCT entity_id, split_part(entity_id, '-', 1) AS c FROM e), ne AS (SELECT DISTINCT fo.query_id, y.entity_id FROM fo JOIN g x USING (entity_id) JOIN g y ON x.c = y.c AND x.entity_id <> y.entity_id),
lo AS (SELECT ne.* FROM ne ANTI JOIN fo USING (query_id, entity_id)), o AS (SELECT query_id, chunk_id, entity_id AS linked_by FROM lo JOIN be USING (entity_id) WHERE r = 1)
SELECT query_id, chunk_id, linked_by FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY linked_by, chunk_id) AS n FROM o) WHERE n <= 15""")
def cluster_expansion(spark, t):
    """Languages are the clusters of entities."""
    links = _links(t)
    near = clusters.neighbours(links.select("entity_id", F.substring_index("entity_id", "-", 1).alias("cluster_id")).distinct())
    return retrieval.by_clusters(_pool(spark, t), links, near, 15)


@query("WITH g AS (SELECT DISTINCT lang AS c, lang || '-' || source AS e FROM documents) SELECT x.e AS entity_id, y.e AS neighbour FROM g x JOIN g y ON x.c = y.c AND x.e <> y.e")
def cluster_neighbours(spark, t):
    return clusters.neighbours(_links(t).select("entity_id", F.substring_index("entity_id", "-", 1).alias("cluster_id")).distinct())


_CUST = "e AS (SELECT c_custkey AS chunk_id, 'n' || c_nationkey AS entity_id, c_acctbal AS score FROM customer), be AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, chunk_id) AS r FROM e)"


@query(f"""WITH {_TRI}, {_CUST}, s AS (SELECT * FROM (VALUES (0, 'r0'), (1, 'n5')) v(query_id, x)), h1 AS (SELECT s.query_id, wy.y FROM s JOIN wy USING (x)), h2 AS (SELECT query_id, wy.y FROM h1 JOIN wy ON h1.y = wy.x),
a AS (SELECT query_id, x AS entity_id FROM s UNION SELECT * FROM h1 UNION SELECT * FROM h2) SELECT DISTINCT query_id, chunk_id FROM a JOIN be USING (entity_id) WHERE r <= 3""")
def graph_first_chunks(spark, t):
    """Customers are the chunks of their nations' entities; two hops reach a region's nations."""
    links = t("customer").select(F.col("c_custkey").alias("chunk_id"), F.concat(F.lit("n"), "c_nationkey").alias("entity_id"), F.col("c_acctbal").alias("score"))
    return retrieval.graph_first(spark.createDataFrame([(0, "r0"), (1, "n5")], "query_id int, entity_id string"), _triples(t), links, 3)


def _first_vectors(v):
    return v.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))


_FIRST = f"v AS ({_V}), q AS (SELECT label AS query_id, e AS q FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM v) WHERE r = 1)"


@query(f"""WITH {_FIRST}, s AS (SELECT query_id, vec_id AS entity_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q, e) DESC, vec_id) AS r FROM q, v),
a AS (SELECT vec_id AS chunk_id, vec_id - vec_id % 2 AS entity_id, row_number() OVER (PARTITION BY vec_id - vec_id % 2 ORDER BY label DESC, vec_id) AS n FROM v)
SELECT query_id, chunk_id, entity_id AS linked_by FROM s JOIN a USING (entity_id) WHERE r <= 10 AND n <= 1""")
def entity_vector_expansion(spark, t):
    """Vectors stand for entities; even ids have their own chunk and that of the next id."""
    v = t("embeddings")
    links = v.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") - F.col("vec_id") % 2).alias("entity_id"), F.col("label").alias("score"))
    return retrieval.by_entity_vectors(_first_vectors(v), v.select(F.col("vec_id").alias("entity_id"), "embedding"), links, 10, 1)


@query(f"WITH {_FIRST} SELECT query_id, vec_id AS chunk_id FROM q JOIN v ON label = query_id WHERE list_cosine_similarity(q, e) >= 0.05")
def lane_filter(spark, t):
    v = t("embeddings")
    return retrieval.lane(v.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id")), v.withColumnRenamed("vec_id", "chunk_id"), _first_vectors(v), 0.05)


#: SQL for a query of the first module: entities that the twenty best documents lack, and the documents that have their text.
SQL["completeness_gate"] = f"""WITH {_BM25}, hi AS (SELECT query_id, lower(text) AS x FROM w JOIN documents USING (doc_id) WHERE rank <= 20), ew AS (SELECT unnest(['the', 'and', 'that', 'with', 'les', 'que', 'der', 'die', 'las', 'nicht', 'idiot', 'clown', 'license']) AS entity),
ask AS (SELECT DISTINCT query_id, entity FROM q, ew), mi AS (SELECT * FROM ask WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.query_id = ask.query_id AND instr(x, entity) > 0))
SELECT DISTINCT query_id, doc_id AS chunk_id FROM mi JOIN documents ON instr(lower(text), entity) > 0"""


@query(f"WITH {_FIRST}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, e), 6) + 0.0 AS score FROM q, v) SELECT query_id AS claim_id, vec_id AS chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r = 1 AND score >= 0.35")
def claim_gaps(spark, t):
    v = t("embeddings")
    found = index.gaps(_first_vectors(v).select(F.col("query_id").alias("claim_id"), F.col("query").alias("embedding")), v.withColumnRenamed("vec_id", "chunk_id"))
    return found.withColumn("score", r6("score"))


@query("""WITH a AS (SELECT s_nationkey AS query_id, 's' || s_suppkey AS chunk_id, s_acctbal AS score, 0 AS store FROM supplier UNION ALL SELECT c_nationkey, 'c' || c_custkey, c_acctbal, 1 FROM customer)
SELECT query_id, chunk_id, store, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, store, chunk_id) AS rank FROM a) WHERE rank <= 7""")
def merged_stores(spark, t):
    """Suppliers and customers as two stores' hits for their nations."""
    a = t("supplier").select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("s"), "s_suppkey").alias("chunk_id"), F.col("s_acctbal").alias("score"))
    b = t("customer").select(F.col("c_nationkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("chunk_id"), F.col("c_acctbal").alias("score"))
    return index.merged([a, b], 7).select("query_id", "chunk_id", "store", "rank")


@query("""WITH q AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Context: topic ' || conv_id || chr(10) ELSE '' END || 'Query: question ' || conv_id AS head FROM conversations),
x AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 4 END AS tier, '[' || CASE role WHEN 'user' THEN 'seed' WHEN 'assistant' THEN 'structural' ELSE 'other' END || '] conversation:' || chr(10) || text AS line, head,
sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 4 END, turn) + greatest(1, length(head) // 4) AS used FROM conversations JOIN q USING (conv_id)),
b AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY tier, turn) AS body FROM x WHERE used <= 120 GROUP BY conv_id)
SELECT conv_id AS query_id, head || coalesce(chr(10) || chr(10) || body, '') AS prompt FROM q LEFT JOIN b USING (conv_id)""")
def built_prompts(spark, t):
    """A conversation's turns as the hits of a question about it."""
    prov = F.when(F.col("role") == "user", "seed").when(F.col("role") == "assistant", "structural").otherwise("other")
    c = t("conversations")
    hits = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), prov.alias("provenance"), F.col("text").alias("content"), F.lit("conversation").alias("document_name"))
    q = c.select(F.col("conv_id").alias("query_id")).distinct().select("query_id", F.concat(F.lit("question "), "query_id").alias("text"), F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("topic "), "query_id")).alias("community_context"))
    return retrieval.build_prompts(hits, q, 120)


@query("SELECT conv_id AS query_id, turn AS report_id, (length(text) % 5)::DOUBLE AS points, role || ':' || left(text, 8) AS answer FROM conversations WHERE length(text) % 5 > 0")
def answered_reports(spark, t):
    """A model that scores a report by its length stands for a language model."""
    r = t("conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("text"), F.col("turn").alias("report_id"), F.col("text").alias("content"))
    return retrieval.map_reduce_answers(r, lambda q, c: (float(len(c) % 5), f"{q}:{c[:8]}"))


@query("""WITH a AS (SELECT DISTINCT source AS query_id, doc_id::VARCHAR AS c FROM documents JOIN labels USING (doc_id) WHERE quality = 1), b AS (SELECT DISTINCT source AS query_id, doc_id::VARCHAR AS c FROM documents WHERE lang = 'en'),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.c AS x, b.c AS y FROM a FULL JOIN b ON a.query_id = b.query_id AND a.c = b.c)
SELECT query_id, coalesce(string_agg(x, ' ' ORDER BY x) FILTER (WHERE x = y), '') AS "both", coalesce(string_agg(x, ' ' ORDER BY x) FILTER (WHERE y IS NULL), '') AS only_a, coalesce(string_agg(y, ' ' ORDER BY y) FILTER (WHERE x IS NULL), '') AS only_b FROM j GROUP BY query_id""")
def run_differences(spark, t):
    """Good documents against English ones, by source."""
    d = t("documents").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "lang")
    got = retrieval.run_diff(d.join(t("labels").filter("quality = 1"), "doc_id"), d.filter("lang = 'en'"))
    return got.select("query_id", *[F.array_join(c, " ").alias(c) for c in ("both", "only_a", "only_b")])


@query(f"""WITH {_BM25}, hi AS (SELECT query_id, doc_id, rank, lower(text) AS x FROM w JOIN documents USING (doc_id) WHERE rank <= 20), ew AS (SELECT unnest(['the', 'and', 'that', 'with', 'les', 'que', 'der', 'die', 'las', 'nicht', 'idiot', 'clown', 'license']) AS entity),
ask AS (SELECT DISTINCT query_id, entity FROM q, ew), mi AS (SELECT * FROM ask WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.query_id = ask.query_id AND instr(x, entity) > 0)),
fi AS (SELECT DISTINCT query_id, doc_id FROM mi JOIN documents ON instr(lower(text), entity) > 0 EXCEPT SELECT query_id, doc_id FROM hi), la AS (SELECT query_id, max(rank) AS last FROM hi GROUP BY 1),
ne AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM fi)
SELECT query_id, doc_id AS chunk_id, 'seed' AS provenance, rank::INT AS rank FROM hi UNION ALL SELECT query_id, doc_id, 'entity_embedding', (last + n)::INT FROM ne JOIN la USING (query_id) WHERE n <= 5""")
def completed_cohort(spark, t):
    """The twenty best documents and five more that mention what they lack."""
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    cohort = _words(spark, t, 20).select("query_id", F.col("id").alias("chunk_id"), F.lit("seed").alias("provenance"), "score", "rank")
    asked = spark.createDataFrame([(i, w) for i, _ in TERMS for w in VOCABULARY], "query_id int, entity string")
    return retrieval.completed(cohort, d, asked, 20, most=5).select("query_id", "chunk_id", "provenance", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {_BM25}, n AS (SELECT query_id, 'topic ' || source AS topic, count(*) AS n FROM w JOIN documents USING (doc_id) WHERE rank <= 20 AND source <> 'src1' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, topic) AS r FROM n)
SELECT query_id, string_agg(topic, '; ' ORDER BY r) AS community_context FROM r WHERE r <= 3 GROUP BY query_id""")
def community_topics(spark, t):
    """Sources stand for communities, of which one isn't coherent."""
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("community_id"), F.lit(0).alias("level"))
    c = d.select("community_id", "level").distinct().select("*", F.concat(F.lit("topic "), "community_id").alias("topic_label"), F.when(F.col("community_id") == "src1", 0.1).otherwise(0.5).alias("coherence"))
    return retrieval.community_context(_words(spark, t, 20).select("query_id", F.col("id").alias("chunk_id")), d, c, 0, 3, 0.2)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '[' || source || ']' || chr(10) ELSE '' END || text AS content FROM documents")
def shown_breadcrumbs(spark, t):
    d = t("documents").select("doc_id", F.col("text").alias("content"), F.when(F.col("lang") == "en", F.concat(F.lit("["), "source", F.lit("]"))).when(F.col("lang") == "de", "").alias("breadcrumb"))
    return retrieval.with_breadcrumbs(d).select("doc_id", "content")


@query(f"WITH {_ENT}, s AS (SELECT entity_id, min(doc_id::VARCHAR) AS a, count(DISTINCT lang) AS n FROM en JOIN documents USING (doc_id) GROUP BY 1) SELECT DISTINCT a, doc_id::VARCHAR AS b FROM s JOIN en USING (entity_id) WHERE n > 1 AND doc_id::VARCHAR <> a")
def bridge_stars(spark, t):
    """Documents stand for chunks and their language for the document."""
    got = clusters.bridge_stars(_found(t), t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("document_name")))
    return got.select("a", "b")


_HITS = """h AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, text AS content, quality + toxic AS rel, toxic = 1 AS distractor FROM documents JOIN labels USING (doc_id)), f AS (SELECT * FROM h WHERE rank <= 10),
x AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t, list_filter(list_transform(string_split(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '' AND NOT starts_with(l, '[')) AS ls, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS n FROM f),
y AS (SELECT *, NOT regexp_matches(t, '(?i)^\\[(TABLE|LIST|PARA):(cont|start|end)\\]') AND (len(ls) = 0 OR regexp_matches(ls[-1], '[.?!"''\\)\\]>}\\d]\\s*$')) AS whole, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM x),
m AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(best + 1)) AS idcg, count(*) FILTER (WHERE whole) / 10.0 AS coherence, greatest(0, 1 - coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE distractor), 0)) AS scope, coalesce(sum(n) FILTER (WHERE rel > 0), 0)::DOUBLE / sum(n) AS efficiency FROM y GROUP BY 1),
q AS (SELECT query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, coherence::DOUBLE AS coherence, scope, efficiency FROM m), z AS (SELECT *, (0.4 * ndcg + 0.2 * coherence + 0.2 * scope + 0.2 * efficiency) AS rqi FROM q)"""


def _measures(t):
    d = t("documents").join(t("labels"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    hits = d.select(F.col("source").alias("query_id"), rank.alias("rank"), F.col("text").alias("content"), (F.col("quality") + F.col("toxic")).alias("relevance"), (F.col("toxic") == 1).alias("distractor"))
    return retrieval.quality_measures(hits, 10, {"ndcg": 0.4, "coherence": 0.2, "scope": 0.2, "efficiency": 0.2})


@query(f"WITH {_HITS} SELECT query_id, round(ndcg, 6) + 0.0 AS ndcg, round(coherence, 6) + 0.0 AS coherence, round(scope, 6) + 0.0 AS scope, round(efficiency, 6) + 0.0 AS efficiency, round(rqi, 6) + 0.0 AS rqi FROM z")
def retrieval_measures(spark, t):
    """Labelled documents as the hits of their source, toxic ones as distractors."""
    return _measures(t).select("query_id", *[r6(c).alias(c) for c in ("ndcg", "coherence", "scope", "efficiency", "rqi")])


@query(f"WITH {_HITS}, c AS (SELECT CASE WHEN query_id IN ('src0', 'src1', 'src2') THEN 'head' WHEN query_id = 'src3' THEN 'rare' ELSE 'tail' END AS category, avg(rqi) AS m FROM z GROUP BY 1) SELECT round(sum(CASE category WHEN 'head' THEN 0.7 WHEN 'tail' THEN 0.3 ELSE 0 END * m), 6) AS rqi FROM c")
def overall_quality(spark, t):
    """The measure over categories of queries by their weights."""
    kind = F.when(F.col("query_id").isin("src0", "src1", "src2"), "head").when(F.col("query_id") == "src3", "rare").otherwise("tail")
    return retrieval.rqi(_measures(t).withColumn("category", kind), {"head": 0.7, "tail": 0.3, "none": 1.0}).select(F.round("rqi", 6).alias("rqi"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN length(p_name)::DOUBLE ELSE 0 END AS first, CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0 END AS second FROM part")
def heading_vectors(spark, t):
    """A function that counts characters stands for a model; half of the parts have no heading."""
    crumbs = t("part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).when(F.col("p_size") > 10, " ").alias("crumb"))
    v = embed.heading_vectors(crumbs, "crumb", lambda texts: [[len(x), 1.0] for x in texts])
    return v.select("p_partkey", F.col("heading")[0].cast("double").alias("first"), F.col("heading")[1].cast("double").alias("second"))


# entities of several words, that overlap and vary in case

_PHRASES = [
    entities.Entity("mit", "MIT License", "the MIT License", "license", ("Released under the MIT License",)),
    entities.Entity("apache", "Apache License", "Apache License", "license"),
    entities.Entity("license", "License", "License", "concept"),
    entities.Entity("under_the", "under the", "Under The", "concept"),
    entities.Entity("gpl", "GNU General Public License", "General Public License", "license"),
    entities.Entity("the_and", "the and", "the and", "concept"),
]
_MARKED = "mk AS (SELECT doc_id, regexp_replace(' ' || lower(text) || ' ', '([^\\p{L}\\p{N}])', '\\1\\1', 'g') AS x FROM documents WHERE text <> '')"


def _count(phrase: str) -> str:
    """SQL for how often a phrase stands between other than letters and digits; all such characters are doubled, so that two can share one."""
    return f"len(regexp_extract_all(x, '[^\\p{{L}}\\p{{N}}]{phrase.lower().replace(' ', '  ')}[^\\p{{L}}\\p{{N}}]'))"


def _counts(entities_: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id::VARCHAR AS chunk_id, '{e}' AS entity_id, ({' + '.join(map(_count, p))})::INT AS frequency FROM mk" for e, p in entities_.items())


_SURFACES = {e.id: sorted({s.lower() for s in (e.name, e.display_name, *e.aliases)}) for e in _PHRASES}


@query(f"WITH {_MARKED}, c AS ({_counts(_SURFACES)}) SELECT * FROM c WHERE frequency > 0")
def phrase_matches(spark, t):
    return entities.match_entities(t("documents"), entities.Matcher.vocabulary(_PHRASES), "doc_id", "text").select("chunk_id", "entity_id", "frequency")


_KNOWN = {"mit": ["released under the mit license"], "gpl": ["gnu general public license"], "cc": ["creative commons attribution"]}
_OTHER = {"w_license": ["license"], "w_under": ["under"], "w_the": ["the"], "w_public": ["public"], "w_commons": ["commons"]}


def _cut() -> str:
    x = "x"
    for p in (p for ps in _KNOWN.values() for p in ps):
        x = f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}]){p.replace(' ', '  ')}([^\\p{{L}}\\p{{N}}])', '\\1##\\2', 'g')"
    return x


@query(f"WITH {_MARKED}, k AS ({_counts(_KNOWN)}), z AS (SELECT doc_id, {_cut()} AS x FROM mk), o AS ({_counts(_OTHER).replace('FROM mk', 'FROM z')}) SELECT * FROM k WHERE frequency > 0 UNION ALL SELECT * FROM o WHERE frequency > 0")
def merged_matches(spark, t):
    """Single words count only where no known phrase covers them."""
    m = lambda table: entities.match_entities(t("documents"), entities.Matcher.vocabulary([entities.Entity(e, p[0], p[0]) for e, p in table.items()]), "doc_id", "text")
    return entities.merge_matches(m(_KNOWN), m(_OTHER)).select("chunk_id", "entity_id", "frequency")


_TERMS = {"public_license": ["public licenses", "public license", "publiclicenses", "publiclicense", "public_licenses"], "under_the": ["under the", "underthe"], "mit_license": ["mit license", "mitlicense"]}


@query(f"WITH {_MARKED}, c AS ({_counts(_TERMS)}) SELECT * FROM c WHERE frequency > 0")
def schema_matches(spark, t):
    """Names of tables and fields found in prose, in their written forms."""
    m = entities.Matcher.schema(["public_licenses"], ["UnderThe"], ["MITLicense"])
    return entities.match_entities(t("documents"), m, "doc_id", "text").select("chunk_id", "entity_id", "frequency")


@query(f"WITH {_ENT} SELECT entity_id, count(*) AS n FROM en WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY entity_id")
def removed_chunks(spark, t):
    gone = t("labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return entities.remove_chunks(_found(t), gone).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ENT} SELECT doc_id::VARCHAR AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM en)")
def unprocessed_chunks(spark, t):
    return entities.unprocessed(t("documents").select(F.col("doc_id").cast("string").alias("chunk_id")), _found(t))


@query("""WITH RECURSIVE p AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS s FROM part x JOIN part y ON x.p_size = y.p_size AND x.p_brand < y.p_brand GROUP BY ALL HAVING count(*) >= 2), lim AS (SELECT min(s) AS lo, max(s) AS hi FROM p),
l AS (SELECT a, b FROM p, lim WHERE hi = lo OR (s - lo)::DOUBLE / (hi - lo) >= 0.8), w AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), n AS (SELECT DISTINCT p_brand AS id FROM part),
r(id, to_id) AS (SELECT id, id FROM n UNION SELECT r.id, w.b FROM r JOIN w ON r.to_id = w.a) SELECT id AS entity_id, min(to_id) AS cluster_id FROM r GROUP BY id""")
def dbscan_clusters(spark, t):
    """Brands that share sizes, by the number of pairs of parts."""
    p = t("part").select("p_size", "p_brand")
    # parts of a size and brand are counted before they meet, so that no pair of parts is formed
    n = p.groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    met = n.toDF("k", "a", "na").join(n.toDF("k", "b", "nb"), "k").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("score")).filter("score >= 2")
    return clusters.cluster_entities(p.select(F.col("p_brand").alias("entity_id")).distinct(), met, "dbscan", 0.2)


@query("""WITH c AS (SELECT DISTINCT lang AS cluster_id, lang || '-' || source AS e FROM documents), p AS (SELECT x.e AS a, y.e AS b, length(x.e) + length(y.e) AS score FROM c x JOIN c y ON x.cluster_id = y.cluster_id AND x.e < y.e),
m AS (SELECT cluster_id, avg(score) AS m FROM p JOIN c ON c.e = p.a GROUP BY 1) SELECT cluster_id, string_agg(e, ' ' ORDER BY e) AS entities, round(coalesce(any_value(m), 0), 4) AS cohesion_score FROM c LEFT JOIN m USING (cluster_id) GROUP BY cluster_id""")
def cluster_cohesion(spark, t):
    c = _links(t).select("entity_id", F.substring_index("entity_id", "-", 1).alias("cluster_id")).distinct()
    pairs = clusters.neighbours(c).filter("entity_id < neighbour").select(F.col("entity_id").alias("a"), F.col("neighbour").alias("b"), (F.length("entity_id") + F.length("neighbour")).alias("score"))
    return clusters.cluster_map(c, pairs).withColumn("entities", F.array_join("entities", " "))


@query(f"""WITH v AS ({_V}), p AS (SELECT x.label, avg(list_dot_product(x.e, y.e)) AS c FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label) SELECT vec_id AS chunk_id, CASE WHEN coalesce(c, 0) >= 0.002 THEN 'topic ' || label END AS topic_label FROM v LEFT JOIN p USING (label)""")
def topic_labels(spark, t):
    """Labels of vectors as communities; only coherent ones give their name."""
    e = t("embeddings")
    found = clusters.coherence(e, "label", "embedding").select(F.col("label").alias("community_id"), F.lit(0).alias("level"), F.concat(F.lit("topic "), "label").alias("topic_label"), "coherence")
    return clusters.topic_label(found, e.select(F.col("vec_id").alias("chunk_id"), F.lit(0).alias("level"), F.col("label").alias("community_id")), 0, 0.002)


# graph


@query(f"WITH {_TRI} SELECT 'objects' AS way, s AS subject_id, v AS verb, o AS object_id FROM tr WHERE s = 'r0' AND v = 'contains' UNION ALL SELECT 'subjects', s, v, o FROM tr WHERE o = 'n3'")
def relation_lookups(spark, t):
    tr = _triples(t)
    return graph.objects_of(tr, "r0", "contains").select(F.lit("objects").alias("way"), "*").union(graph.subjects_of(tr, "n3").select(F.lit("subjects"), "*"))


@query(f"WITH {_TRI} SELECT DISTINCT s AS subject_id, v AS verb, o AS object_id FROM tr WHERE s IN ('n3', 'r1') OR o IN ('n3', 'r1')")
def touched_triples(spark, t):
    return graph.two_hop(_triples(t), spark.createDataFrame([("n3",), ("r1",)], "id string"))[2]


@query(f"WITH {_ENT} SELECT doc_id::VARCHAR AS chunk_id, string_agg(entity_id, ' ' ORDER BY entity_id) AS entities FROM en GROUP BY doc_id HAVING count(*) >= 3")
def anchored_chunks(spark, t):
    got = graph.anchored_chunks(t("documents").select(F.col("doc_id").cast("string").alias("chunk_id")), _found(t), 3)
    return got.select("chunk_id", F.array_join("entities", " ").alias("entities"))


@query(f"WITH {_ENT} SELECT (SELECT count(DISTINCT entity_id) FROM en) AS entity_count, (SELECT count(*) FROM nation) AS edge_count, (SELECT count(*) FROM documents) AS chunk_count")
def graph_counts(spark, t):
    return graph.graph_stats(_found(t), t("nation"), t("documents"))


@query(f"WITH v AS ({_V}) SELECT '__entity__' || vec_id AS chunk_id, CASE WHEN label < 5 THEN 'about ' || vec_id ELSE vec_id::VARCHAR END AS content, 'entity' AS chunk_type FROM v")
def entity_rows(spark, t):
    v = t("embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), "embedding", "label")
    told = v.filter("label < 5").select("entity_id", F.concat(F.lit("about "), "entity_id").alias("description"))
    return graph.entity_vectors_as_chunks(v.drop("label"), told).drop("embedding")


# extractors, on files made of the tables: each nation is a file of its customers

_NATION = "WITH c AS (SELECT n_name AS f, c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _files(t, ending: str, line, head: str = "", foot: str = "", sep: str = "\n"):
    """(path, content): a file for each nation with customers, a line for each of them, in order of their keys."""
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", F.struct("c_custkey", line.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), sep)
    return c.groupBy("n_name").agg(F.concat(F.lit(head), body, F.lit(foot)).alias("b")).select(F.concat("n_name", F.lit(ending)).alias("path"), F.col("b").cast("binary").alias("content"))


def _texts(t, ending: str, line, options: dict | None = None, **how):
    return extract.extract_documents(_files(t, ending, line, **how), None, options).select("path", "doc_type", "text", "error")


_OK = "NULL::VARCHAR AS error"


@query(f"""{_NATION} SELECT f || '.csv' AS path, 'csv' AS doc_type, '| key | customer | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || k || ' | ' || name || ', x\\|y | ' || seg || ' |', chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def csv_texts(spark, t):
    return _texts(t, ".csv", F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit(', x|y"')), "c_mktsegment"), head="key,customer,segment\n")


@query(f"""{_NATION} SELECT f || '.tsv' AS path, 'tsv' AS doc_type, '| key | customer |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || k || ' | ' || name || ' |', chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def tsv_texts(spark, t):
    return _texts(t, ".tsv", F.concat_ws("\t", "c_custkey", "c_name"), head="key\tcustomer\n")


@query(f"""{_NATION} SELECT f || '.jsonl' AS path, 'jsonl' AS doc_type, string_agg('# name' || chr(10) || name || chr(10) || '# at' || chr(10) || '## at > segment' || chr(10) || seg || chr(10) || '# n' || chr(10) || k || chr(10) || k + 1, chr(10) || chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def jsonl_texts(spark, t):
    row = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("at"), F.array(F.col("c_custkey"), F.col("c_custkey") + 1).alias("n")))
    return _texts(t, ".jsonl", row)


@query(f"""{_NATION} SELECT f || '.jsonl' AS path, 'jsonl' AS doc_type, string_agg('## ' || name || chr(10) || 'segment: ' || seg || chr(10) || 'n: ' || k || ', ' || k + 1, chr(10) || chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def jsonl_sections(spark, t):
    row = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.array(F.col("c_custkey"), F.col("c_custkey") + 1).alias("n")))
    return _texts(t, ".jsonl", row, {"jsonl": {"by_row": True, "row_key": "name"}})


@query(f"""{_NATION} SELECT f || '.json' AS path, 'json' AS doc_type, string_agg('#  ' || '[' || i || ']' || chr(10) || chr(10) || '## [' || i || '] > name' || chr(10) || chr(10) || name, chr(10) || chr(10) ORDER BY k) AS text, {_OK} FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS i FROM c) GROUP BY f""".replace("'#  ' || '['", "'# ['"))
def json_texts(spark, t):
    return _texts(t, ".json", F.to_json(F.struct(F.col("c_name").alias("name"))), head="[", foot="]", sep=",")


@query(f"""{_NATION} SELECT f || '.xml' AS path, 'xml' AS doc_type, '# list' || chr(10) || chr(10) || string_agg('## list > customer' || chr(10) || chr(10) || '### list > customer > name' || chr(10) || chr(10) || name || chr(10) || chr(10) || '### list > customer > seg' || chr(10) || chr(10) || seg, chr(10) || chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def xml_texts(spark, t):
    line = F.concat(F.lit("<m:customer><name>"), "c_name", F.lit("</name><seg> "), "c_mktsegment", F.lit(" </seg></m:customer>"))
    return _texts(t, ".xml", line, head='<m:list xmlns:m="urn:m">', foot="</m:list>")


@query(f"""{_NATION} SELECT f || '.yaml' AS path, 'yaml' AS doc_type, string_agg('# name' || chr(10) || chr(10) || name || chr(10) || chr(10) || '# key' || chr(10) || chr(10) || k, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def yaml_texts(spark, t):
    return _texts(t, ".yaml", F.concat(F.lit("name: "), "c_name", F.lit("\nkey: "), "c_custkey"), sep="\n---\n")


@query(f"""{_NATION} SELECT f || '.md' AS path, 'markdown' AS doc_type, string_agg('# ' || name || chr(10) || seg, chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def markdown_texts(spark, t):
    return _texts(t, ".md", F.concat(F.lit("# "), "c_name", F.lit("\n"), "c_mktsegment"))


@query(f"""{_NATION} SELECT f || '.rows' AS path, 'lookup_table' AS doc_type, string_agg('## ' || name || chr(10) || 'key: ' || k || chr(10) || 'segment: ' || seg, chr(10) || chr(10) ORDER BY k) AS text, {_OK} FROM c GROUP BY f""")
def lookup_texts(spark, t):
    files = _files(t, ".rows", F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment"), head="key,customer,segment\n")
    return extract.extract_documents(files, "lookup_table", {"lookup_table": {"key": "customer"}})


@query("""WITH p AS (SELECT page_id, html FROM pages) SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[\\s>].*?</script>', '', 'gis'), '<style[\\s>].*?</style>', '', 'gis'), '<noscript[\\s>].*?</noscript>', '', 'gis'), '<nav[\\s>].*?</nav>', '', 'gis'), '<aside[\\s>].*?</aside>', '', 'gis'), '<header[\\s>].*?</header>', '', 'gis'), '<footer[\\s>].*?</footer>', '', 'gis') AS html FROM p""")
def pages_without_chrome(spark, t):
    """Scripts, navigation, page head and foot go; the pages have none of the blocks that only their names tell."""
    return t("pages").select("page_id", extract.strip_chrome_column(F.col("html")).alias("html"))


@query("""SELECT 'shop/' || c_custkey AS document_name, '# _id' || chr(10) || chr(10) || c_custkey || chr(10) || chr(10) || '# name' || chr(10) || chr(10) || c_name || chr(10) || chr(10) || '# at' || chr(10) || chr(10) || '## at > nation' || chr(10) || chr(10) || c_nationkey AS content, 'shop' AS collection, c_custkey::VARCHAR AS "key" FROM customer""")
def record_texts(spark, t):
    """Records of a document store."""
    j = t("customer").select(F.to_json(F.struct(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("at"))).alias("j"))
    d = loaders.record_documents(j, "j", "shop")
    return d.select("document_name", "content", F.col("source_detail")["collection"].alias("collection"), F.col("source_detail")["key"].alias("key"))


# text functions


@query("SELECT p_partkey, p_brand || ' | ' || p_type AS sections FROM part")
def heading_texts(spark, t):
    text = F.concat(F.lit("# "), "p_brand", F.lit("\nbody "), "p_name", F.lit("\n##  "), "p_type", F.lit(" \nmore"))
    return t("part").select("p_partkey", F.array_join(X.markdown_sections(text, F.lit("markdown")), " | ").alias("sections"))


@query("SELECT p_partkey, '# ' || p_brand || chr(10) || '## ' || p_type AS headings, '[' || p_brand || ' > ' || p_type || ']' AS literal, p_brand || ' → ' || p_type AS arrows FROM part")
def breadcrumb_styles(spark, t):
    parts = F.array("p_brand", "p_type")
    return t("part").select("p_partkey", *[X.format_breadcrumb(parts, s).alias(n) for s, n in (("markdown", "headings"), ("literal", "literal"), ("symbol", "arrows"))])


@query("""SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN p_brand || '/' || min(p_type) ELSE p_brand END AS path FROM part GROUP BY p_brand""")
def common_paths(spark, t):
    """The common heading path of a brand's parts."""
    g = t("part").groupBy("p_brand").agg(F.collect_list(F.array("p_brand", "p_type")).alias("ps"))
    return g.select("p_brand", F.array_join(X.lca_path(F.col("ps")), "/").alias("path"))


@query("""SELECT s_suppkey, 'postgresql' AS db_dialect, 'host' || s_nationkey || '.example.com' AS db_host, 5432 + s_nationkey AS db_port, 'db' || s_suppkey AS db_name FROM supplier""")
def database_urls(spark, t):
    url = F.concat(F.lit("postgresql+psycopg2://user:secret@host"), "s_nationkey", F.lit(".example.com:"), (F.lit(5432) + F.col("s_nationkey")).cast("string"), F.lit("/db"), "s_suppkey", F.lit("?sslmode=on"))
    return t("supplier").select("s_suppkey", *[c.alias(n) for n, c in X.db_provenance(url).items()])


@query("""SELECT DISTINCT trim(replace(lower(p_brand), '#', ' ')) AS alias, regexp_replace(lower(replace(p_brand, '#', '_') || '_Code'), '[^a-z0-9]+', '_', 'g') AS entity_id, 'strip_suffix' AS source FROM part""")
def suffix_aliases(spark, t):
    return entities.suffix_aliases(t("part").select(F.concat(F.regexp_replace("p_brand", "#", "_"), F.lit("_Code")).alias("term")))


@query("SELECT DISTINCT replace(r_name, ' ', '_') AS term FROM region UNION SELECT n_name FROM nation UNION SELECT unnest(['id', 'label'])")
def ddl_terms(spark, t):
    """Regions and nations as tables."""
    names = t("region").select(F.col("r_name").alias("n")).union(t("nation").select("n_name"))
    return entities.ddl_terms(names.select(F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), F.translate("n", " ", "_"), F.lit(" (\n  id INTEGER,\n  label TEXT\n);")).alias("ddl")))


@query("SELECT DISTINCT p_type AS term FROM part")
def vocabulary_terms(spark, t):
    return entities.query_terms(t("part").select("p_type"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) IN ('http', 'https') AS loadable FROM pages")
def loadable_pages(spark, t):
    mime = F.when(F.lower("url").rlike("^https?:"), "text/html; charset=utf-8").otherwise("font/woff")
    return t("pages").select("page_id", X.is_loadable_mime(mime).alias("loadable"))
