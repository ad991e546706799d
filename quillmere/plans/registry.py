"""Registered queries over the driver's tables, with equivalent DuckDB SQL.

The tables stand in for the engine's own: documents for chunks of text, embeddings for chunk
vectors, labels and regions for namespaces and trees, conversations for a document's
consecutive chunks, parts and suppliers for vocabularies and rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import chunking, clusters, entities, graph, retrieval, store
from ..sources import extract, loaders
from ..streaming import incremental

#: Tables of texts, whose queries are bound by CPU.
TEXTS = ("documents", "pages", "conversations")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, table) -> DataFrame under its name, with its SQL if it has one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: loaders.read_table(spark, f"{sf_dir}/{name}.parquet", name in TEXTS))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chunked, enriched, identified, and ranked for a fixed query."""
    return QUERIES["chunk_bm25"](spark, sf_dir)


def r6(c) -> Column:
    return F.round(c, 6) + F.lit(0.0)


# lines and terms


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE length(line) - length(replace(line, '|', '')) >= 2) AS n_table,
       count(*) FILTER (WHERE regexp_matches(line, '^\\s*([-*+] |[0-9]{1,4}\\. )')) AS n_list
FROM l GROUP BY doc_id""")
def line_kinds(spark, t):
    lines = F.split("text", "\n")
    n = lambda test: F.size(F.filter(lines, test)).cast("long")
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.size(lines).cast("long").alias("n_lines"), n(X.is_table_line).alias("n_table"), n(X.is_list_line).alias("n_list"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
k AS (SELECT doc_id, pos, CASE WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(line, '^\\s*([-*+] |[0-9]{1,4}\\. )') THEN 'list' ELSE 'prose' END AS kind FROM e),
m AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AND kind <> 'prose' THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m)
SELECT doc_id AS key, min(pos)::INT AS first_line, any_value(kind) AS kind, count(*) AS n_lines FROM r GROUP BY doc_id, run""")
def line_runs(spark, t):
    return chunking.merged_lines(t("documents"), "doc_id", "text")


_TERM = "trim(regexp_replace(replace(replace(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' '), '-', ' '), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, lower({_TERM.format(c='p_name')}) AS term, regexp_replace(lower({_TERM.format(c='p_type')}), 's$', '') AS singular FROM part")
def schema_terms(spark, t):
    return t("part").select("p_partkey", X.schema_term(F.col("p_name")).alias("term"), X.schema_term(F.col("p_type"), True).alias("singular"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS id FROM customer")
def auto_ids(spark, t):
    return t("customer").select("c_custkey", X.auto_id(F.col("c_name")).alias("id"))


@query("""SELECT doc_id, source || '_' || doc_id || '_' || left(sha256(source || ':' || doc_id || ':' || left(text, 100)), 16) AS chunk_id, sha256(text) AS content_hash FROM documents""")
def chunk_ids(spark, t):
    return t("documents").select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"), store.document_hash(F.col("text")).alias("content_hash"))


@query("""SELECT doc_id, '[' || source || ' > ' || lang || ']' || chr(10) || chr(10) || text AS embedding_content, greatest(1, length(text) // 4) AS tokens FROM documents""")
def enriched_texts(spark, t):
    return t("documents").select("doc_id", X.enriched(F.col("text"), F.lit(None).cast("string"), F.col("source"), F.array("lang")).alias("embedding_content"), X.est_tokens(F.col("text")).alias("tokens"))


_KINDS = [("a/b/report.PDF", None), ("notes", "text/html; charset=utf-8"), ("x.tsv", None), ("y.bin", "application/pdf+x"), ("z.unknown", None), ("c.java", ""), ("m.eml", None), ("q.csv", "application/json"), ("s", "video/mp4"), (".hidden", None)]


@query("""SELECT * FROM (VALUES ('a/b/report.PDF', 'pdf', true), ('notes', 'html', false), ('x.tsv', 'tsv', false), ('y.bin', 'pdf', true), ('z.unknown', 'text', false), ('c.java', 'java', false),
('m.eml', 'email', false), ('q.csv', 'json', false), ('s', 'audio', true), ('.hidden', 'text', false)) v(path, kind, is_binary)""")
def document_types(spark, t):
    d = spark.createDataFrame(_KINDS, "path string, mime string").withColumn("kind", X.detect_type(F.col("path"), F.col("mime")))
    return d.select("path", "kind", X.is_binary_type(F.col("kind")).alias("is_binary"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ts FROM documents), s AS (SELECT doc_id, ts, unnest(range(0, len(ts), 256)) AS p FROM w)
SELECT doc_id AS key, (p // 256)::INT AS "window", array_to_string(ts[p + 1 : p + 256], ' ') AS content FROM s""")
def token_windows(spark, t):
    return chunking.token_windows(t("documents"), "doc_id", "text")


# schema and API records


@query("""
WITH c AS (SELECT n_nationkey AS i, n_name AS name, n_regionkey FROM nation), x AS (SELECT r_regionkey, r_name, (SELECT string_agg(name, ', ' ORDER BY i) FROM c WHERE n_regionkey = r_regionkey) AS names, (SELECT count(*) FROM c WHERE n_regionkey = r_regionkey) AS n FROM region)
SELECT 'schema:geo.' || r_name AS document_name, 'Table: ' || r_name || chr(10) || 'Source DB: geo' || chr(10) || 'Row count: ' || n || chr(10) || 'Columns: ' || names AS content, 0 AS chunk_index, 'db_table' AS chunk_type FROM x
UNION ALL
SELECT 'schema:geo.' || r_name || '.' || name, 'Column: ' || name || chr(10) || 'Table: ' || r_name || chr(10) || 'Type: INTEGER' || chr(10) || 'Nullable: no' || chr(10) || 'Primary key: yes',
       (row_number() OVER (PARTITION BY r_regionkey ORDER BY i))::INT, 'db_column' FROM region JOIN c ON n_regionkey = r_regionkey""")
def schema_chunks(spark, t):
    """Regions as tables with their nations as columns."""
    cols = t("nation").select(F.col("n_regionkey").alias("k"), F.struct(F.col("n_nationkey").alias("i"), F.col("n_name").alias("name")).alias("c")).groupBy("k").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    meta = F.transform("cs", lambda c: F.struct(c["name"].alias("name"), F.lit("INTEGER").alias("data_type"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("nullable"), F.lit(True).alias("is_primary_key"), F.lit(False).alias("is_foreign_key"), F.lit(None).cast("string").alias("foreign_key_ref")))
    none = F.lit(None).cast("string")
    tables = t("region").join(cols, F.col("r_regionkey") == F.col("k")).select(F.col("r_name").alias("name"), none.alias("schema_name"), none.alias("description"), meta.alias("columns"), F.size("cs").cast("long").alias("row_count"), F.lit("geo").alias("source_db"))
    return loaders.schema_chunks(tables).select("document_name", "content", "chunk_index", "chunk_type")


@query("""
SELECT 'api:shop./' || lower(r_name) AS document_name, 'Endpoint: /' || lower(r_name) || chr(10) || 'Method: GET' || chr(10) || 'Type: rest' || chr(10) || 'Source API: shop' || chr(10) || 'Fields: key' AS content, 0 AS chunk_index, 'api_endpoint' AS chunk_type FROM region
UNION ALL SELECT 'api:shop./' || lower(r_name) || '.key', 'Field: key' || chr(10) || 'Endpoint: /' || lower(r_name) || chr(10) || 'Type: int' || chr(10) || 'Required: yes', 1, 'api_field' FROM region""")
def api_chunks(spark, t):
    none = F.lit(None).cast("string")
    f = F.array(F.struct(F.lit("key").alias("name"), F.lit("int").alias("field_type"), none.alias("description"), F.lit(True).alias("required")))
    e = t("region").select(F.concat(F.lit("/"), F.lower("r_name")).alias("path"), F.lit("GET").alias("method"), none.alias("description"), f.alias("fields"), F.lit("rest").alias("endpoint_type"), F.lit("shop").alias("source_api"))
    return loaders.api_chunks(e).select("document_name", "content", "chunk_index", "chunk_type")


@query("""SELECT s_name AS key, '## ' || s_name || chr(10) || 's_suppkey: ' || s_suppkey || chr(10) || 's_nationkey: ' || s_nationkey AS content FROM supplier""")
def lookup_sections(spark, t):
    return loaders.row_sections(t("supplier").drop("s_acctbal"), "s_name")


@query("""SELECT 'nation' AS document_name, '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS content FROM nation""")
def query_table(spark, t):
    return loaders.markdown_table(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", ["n_nationkey"])


@query("""
WITH k AS (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events), v AS (SELECT path, json_type(json_extract(props, '$."' || path || '"')) AS ty FROM k)
SELECT path, CASE ty WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS kind, count(*) AS n FROM v GROUP BY ALL
UNION ALL SELECT '', 'document', count(*) FROM events WHERE props IS NOT NULL""")
def record_schema(spark, t):
    return loaders.record_paths(t("events"), "props").filter("NOT item").select("path", "kind", "n")


# pages

_BASE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


@query(f"""WITH u AS (SELECT page_id, {_BASE} AS b, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages) SELECT page_id, b || CASE WHEN p = '' THEN '/' ELSE p END AS url FROM u""")
def normalized_urls(spark, t):
    return t("pages").select("page_id", X.normalize_url(F.col("url")).alias("url"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS title FROM pages""")
def page_titles(spark, t):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1))).alias("title"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href=["'']([^"''#?][^"'']*)["'']', 1))) AS href FROM pages""")
def page_hrefs(spark, t):
    return t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"'#?][^"']*)["']"""), F.lit(1)))).alias("href"))


@query()
def page_crawl(spark, t):
    p = t("pages").select("url", "html")
    return loaders.crawl(p, p.select("url"), 3)


@query()
def html_markdown(spark, t):
    return extract.html_documents(t("pages"), "page_id", "html")


@query()
def html_chunks(spark, t):
    md = extract.html_documents(t("pages"), "page_id", "html").withColumn("name", F.col("page_id").cast("string"))
    return loaders.load_texts(md, "name", "markdown").select("chunk_id", "document_name", "chunk_index", "section", "content", "embedding_content")


# chunks


@query()
def chunk_document(spark, t):
    return loaders.load_texts(t("documents").withColumn("name", F.col("doc_id").cast("string")), "name", "text")


@query()
def chunk_promoted(spark, t):
    o = chunking.Options(promote=True, levels=chunking.PROSE_LEVELS, overlap=50, crumb_limit=80)
    return chunking.chunk_documents(t("documents").withColumn("name", F.col("doc_id").cast("string")), "name", "text", o)


# vectors

_V = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"


@query(f"""WITH v AS ({_V}), q AS (SELECT label AS query_id, e AS q FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM v) WHERE r = 1),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e, q), 6) + 0.0 AS score FROM v, q)
SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, t):
    """The first vector of each label as a query; ranked after rounding so that ties are the same everywhere."""
    v = t("embeddings")
    q = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).withColumnRenamed("label", "query_id")
    found = retrieval.batch_vector_search(v, q, 40, "vec_id").withColumn("score", r6("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(f"""WITH v AS ({_V}), s AS (SELECT vec_id, label, round(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0)), 6) + 0.0 AS score FROM v WHERE label IN (1, 2, 3)) SELECT vec_id, label, score FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk_filtered(spark, t):
    v = t("embeddings")
    q = v.filter("vec_id = 0").select("embedding").first()[0]
    return v.filter(F.col("label").isin(1, 2, 3)).select("vec_id", "label", r6(X.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q]))).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"""WITH v AS ({_V}) SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.e, y.e), 6) AS weight FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.35""")
def similarity_pairs(spark, t):
    return clusters.similarity_edges(t("embeddings"), 0.35, "vec_id").select("a", "b", F.round("weight", 6).alias("weight"))


@query(f"""WITH RECURSIVE v AS ({_V}), p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.35), w AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, w.b FROM r JOIN w ON r.to_id = w.a) SELECT id AS chunk_id, min(to_id) AS community_id FROM r GROUP BY id""")
def similarity_components(spark, t):
    e = t("embeddings")
    return clusters.partition(e.select(F.col("vec_id").alias("chunk_id")), clusters.similarity_edges(e, 0.35, "vec_id"), algorithm="components")


@query()
def communities(spark, t):
    e = t("embeddings")
    return clusters.partition(e.select(F.col("vec_id").alias("chunk_id")), clusters.similarity_edges(e, 0.35, "vec_id"), 1.0)


@query(f"""WITH v AS ({_V}), p AS (SELECT x.label, avg(list_dot_product(x.e, y.e)) AS c FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label), n AS (SELECT label, count(*) AS size FROM v GROUP BY label)
SELECT label, size, round(coalesce(c, 0.0), 6) + 0.0 AS coherence FROM n LEFT JOIN p USING (label)""")
def label_coherence(spark, t):
    e = t("embeddings")
    # unit vectors in double precision only nearly so: the squares are summed as they are
    return clusters.coherence(e, "label", "embedding").select("label", "size", r6("coherence").alias("coherence"))


@query(f"""WITH v AS ({_V}), h AS (SELECT label, (SELECT e FROM v z WHERE z.label = v.label ORDER BY vec_id LIMIT 1) AS h FROM v GROUP BY label), m AS (SELECT vec_id, list_transform(range(1, 65), lambda i: 0.2 * h[i] + 0.8 * e[i]) AS m FROM v JOIN h USING (label)) SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) + 0.0 AS first, round(m[64] / sqrt(list_dot_product(m, m)), 6) + 0.0 AS last FROM m""")
def working_vectors(spark, t):
    e = t("embeddings")
    h = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("h"))
    w = e.join(h, "label").withColumn("w", clusters.working_vector(F.col("embedding"), F.col("h")))
    return w.select("vec_id", r6(F.get("w", F.lit(0))).alias("first"), r6(F.get("w", F.lit(63))).alias("last"))


# words

TERMS = [(1, "that with the"), (2, "les que nicht"), (3, "licensed under license"), (4, "idiot clown")]
_TERMS_SQL = "(VALUES (1, ['that', 'with', 'the']), (2, ['les', 'que', 'nicht']), (3, ['licensed', 'under', 'license']), (4, ['idiot', 'clown'])) q(query_id, ts)"
_BM25 = f"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d), q AS (SELECT query_id, unnest(ts) AS token FROM {_TERMS_SQL}),
x AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS token FROM d), h AS (SELECT doc_id, length, token, count(*) AS tf FROM x WHERE token IN (SELECT token FROM q) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM h GROUP BY token),
b AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM h JOIN f USING (token) JOIN q USING (token), st GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b)"""


def _words(spark, t, k):
    return retrieval.bm25(t("documents"), spark.createDataFrame(TERMS, "query_id int, query string"), k, "doc_id", "text")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM w WHERE rank <= 20")
def bm25_topk(spark, t):
    return _words(spark, t, 20).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query()
def chunk_bm25(spark, t):
    c = loaders.load_texts(t("documents").withColumn("name", F.col("doc_id").cast("string")), "name", "text")
    return retrieval.bm25(c, spark.createDataFrame(TERMS, "query_id int, query string"), 20, "chunk_id", "embedding_content")


_LEN = "l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, doc_id) AS rank FROM documents, (SELECT DISTINCT query_id FROM q) WHERE text IS NOT NULL)"


def _by_length(spark, t):
    d = t("documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    q = spark.createDataFrame([(i,) for i, _ in TERMS], "query_id int")
    top = d.orderBy(F.desc("n"), "id").limit(60)
    return top.crossJoin(q).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "id")))


def _rrf_sql(score: str) -> str:
    return f"""WITH {_BM25}, {_LEN}, a AS (SELECT query_id, doc_id, rank AS r1 FROM l WHERE rank <= 60), c AS (SELECT query_id, doc_id, rank AS r2 FROM w WHERE rank <= 60),
j AS (SELECT query_id, doc_id, r1, r2, {score} AS score FROM a FULL JOIN c USING (query_id, doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS rank FROM j)
SELECT query_id, doc_id, round(score, 9) AS score, rank::INT AS rank FROM k WHERE rank <= 20"""


def _fused(spark, t, **how):
    return retrieval.rrf(_by_length(spark, t), _words(spark, t, 60), 20, **how).select("query_id", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


@query(_rrf_sql("(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0)) / (2.0::DOUBLE / 61)"))
def rrf_scaled(spark, t):
    return _fused(spark, t)


@query(_rrf_sql("1.0::DOUBLE / (60 + coalesce(r1, 120)) + 1.0::DOUBLE / (60 + coalesce(r2, 120))"))
def rrf_penalty(spark, t):
    return _fused(spark, t, variant="penalty", penalty=60)


# entities: a vocabulary of single words

VOCABULARY = "the and that with les que der die las nicht idiot clown license".split()
_WORDS = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"
_ENT = f"""
d AS (SELECT doc_id, lower(text) AS x, greatest(length(text), 1) AS len FROM documents WHERE text <> ''), tk AS (SELECT doc_id, unnest(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+')) AS w FROM d),
fr AS (SELECT doc_id, w AS entity_id, count(*) AS frequency FROM tk WHERE w IN (SELECT unnest({_WORDS})) GROUP BY ALL),
en AS (SELECT doc_id, entity_id, frequency::INT AS frequency, instr(' ' || regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' ', ' ' || entity_id || ' ') - 1 AS first_position, len FROM fr JOIN d USING (doc_id))"""


def _found(t):
    m = entities.Matcher.vocabulary([entities.Entity(w, w, w) for w in VOCABULARY])
    return entities.match_entities(t("documents"), m, "doc_id", "text")


@query(f"WITH {_ENT} SELECT doc_id::VARCHAR AS chunk_id, entity_id, frequency, first_position::INT AS first_position FROM en")
def vocabulary_matches(spark, t):
    return _found(t).select("chunk_id", "entity_id", "frequency", F.get("positions", F.lit(0)).alias("first_position"))


_SCORED = f"{_ENT}, df AS (SELECT entity_id, count(*) AS df FROM en GROUP BY entity_id), sc AS (SELECT doc_id::VARCHAR AS chunk_id, entity_id, 0.4 * ln(1 + frequency) + 0.3 * (1 - first_position::DOUBLE / len) + 0.3 * ln((SELECT count(*) FROM documents)::DOUBLE / df) AS score FROM en JOIN df USING (entity_id))"


def _scored(t):
    return entities.score_associations(_found(t), t("documents").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_SCORED} SELECT chunk_id, entity_id, round(score, 6) + 0.0 AS score FROM sc")
def entity_scores(spark, t):
    return _scored(t).select("chunk_id", "entity_id", r6("score").alias("score"))


@query(f"WITH {_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) SELECT entity_id, chunk_id, rank::INT AS rank FROM k WHERE rank <= 3")
def entity_top_chunks(spark, t):
    return entities.chunks_of_entities(_scored(t).withColumn("score", F.round("score", 9)), 3).select("entity_id", "chunk_id", "rank")


def _pair_sql(score: str) -> str:
    return f"""WITH {_ENT}, df AS (SELECT entity_id, count(*) AS df FROM en GROUP BY entity_id), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
m AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS cnt FROM en x JOIN en y ON x.doc_id = y.doc_id AND x.entity_id < y.entity_id GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, cnt AS "count", round({score}, 6) + 0.0 AS score FROM m JOIN df da ON da.entity_id = a JOIN df db ON db.entity_id = b, n"""


def _pairs(t, form):
    return clusters.cooccurrence(_found(t), t("documents").agg(F.count(F.lit(1)).alias("n")), form).withColumn("score", r6("score"))


@query(_pair_sql("cnt::DOUBLE"))
def cooccurrence_raw(spark, t):
    return _pairs(t, "raw")


@query(_pair_sql("cnt::DOUBLE / (da.df + db.df - cnt)"))
def cooccurrence_jaccard(spark, t):
    return _pairs(t, "jaccard")


@query(_pair_sql("log2((cnt / n) / ((da.df / n) * (db.df / n)))"))
def cooccurrence_pmi(spark, t):
    return _pairs(t, "pmi")


@query()
def entity_clusters(spark, t):
    found = _found(t)
    return clusters.cluster_map(clusters.cluster_entities(found.select("entity_id").distinct(), _pairs(t, "pmi")), _pairs(t, "pmi"))


@query(f"""WITH {_ENT}, s AS (SELECT DISTINCT doc_id, entity_id, lang FROM en JOIN documents USING (doc_id)) SELECT DISTINCT x.doc_id::VARCHAR AS a, y.doc_id::VARCHAR AS b, 1.0::DOUBLE AS weight FROM s x JOIN s y ON x.entity_id = y.entity_id AND x.doc_id::VARCHAR < y.doc_id::VARCHAR AND x.lang <> y.lang""")
def bridge_edges(spark, t):
    """Documents stand for chunks and their language for the document."""
    return clusters.bridge_edges(_found(t), t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("document_name")))


@query("""
WITH s AS (SELECT lang, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') AS ws FROM documents), w AS (SELECT lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s), c AS (SELECT lang, w, count(*) AS n, min(i) AS i FROM w WHERE length(w) > 3 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, i, w) AS r FROM c WHERE w NOT IN (SELECT unnest(%s))) SELECT lang, string_agg(w, ', ' ORDER BY r) AS label FROM k WHERE r <= 5 GROUP BY lang""" % str(sorted(clusters.STOPWORDS)))
def term_labels(spark, t):
    return clusters.term_labels(t("documents").filter("text IS NOT NULL"), "lang", "text")


# graph


def _triples(t):
    """Suppliers located in nations, nations part of regions, regions containing nations."""
    s = t("supplier").select(F.col("s_name").alias("subject_id"), F.lit("located_in").alias("verb"), F.concat(F.lit("n"), "s_nationkey").alias("object_id"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("subject_id"), F.lit("part_of").alias("verb"), F.concat(F.lit("r"), "n_regionkey").alias("object_id"))
    r = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("subject_id"), F.lit("contains").alias("verb"), F.concat(F.lit("n"), "n_nationkey").alias("object_id"))
    return s.union(n).union(r)


_TRI = "tr AS (SELECT s_name AS s, 'located_in' AS v, 'n' || s_nationkey AS o FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 'contains', 'n' || n_nationkey FROM nation), wy AS (SELECT s AS x, o AS y FROM tr UNION SELECT o, s FROM tr)"


@query(f"WITH {_TRI}, h1 AS (SELECT DISTINCT y FROM wy WHERE x = 'r0' AND y <> 'r0'), h2 AS (SELECT DISTINCT wy.y FROM wy JOIN h1 ON wy.x = h1.y WHERE wy.y <> 'r0' AND wy.y NOT IN (SELECT y FROM h1)) SELECT y AS id, 1 AS hop FROM h1 UNION ALL SELECT y, 2 FROM h2")
def two_hop(spark, t):
    one, two, _ = graph.two_hop(_triples(t), spark.createDataFrame([("r0",)], "id string"))
    return one.withColumn("hop", F.lit(1)).union(two.withColumn("hop", F.lit(2)))


@query(f"WITH {_TRI}, nm AS (SELECT s_name AS id, s_name AS name FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'r' || n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), c AS (SELECT c.name, p.name AS parent, v, 0 AS way FROM tr JOIN nm c ON c.id = s JOIN nm p ON p.id = o WHERE v IN ('part_of') UNION ALL SELECT c.name, p.name, v, 1 FROM tr JOIN nm c ON c.id = o JOIN nm p ON p.id = s WHERE v = 'contains') SELECT name, parent, v AS verb FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY way, v, parent) AS k FROM c) WHERE k = 1")
def entity_parents(spark, t):
    names = t("supplier").select(F.col("s_name").alias("id"), F.col("s_name").alias("name")).union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), "n_name")).union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    return graph.entity_parents(_triples(t), names)


_CG = f"""{_ENT}, cl AS (SELECT DISTINCT entity_id, source FROM en JOIN documents USING (doc_id)), sz AS (SELECT entity_id, count(*) AS k FROM cl GROUP BY 1),
co AS (SELECT x.entity_id AS a, y.entity_id AS b, least(count(*) * 0.8, 0.8) AS c FROM en x JOIN en y ON x.doc_id = y.doc_id AND x.entity_id < y.entity_id GROUP BY ALL),
cm AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM cl x JOIN cl y ON x.source = y.source AND x.entity_id < y.entity_id GROUP BY ALL),
cs AS (SELECT a, b, 0.4 * n::DOUBLE / (p.k + q.k - n) AS d FROM cm JOIN sz p ON p.entity_id = a JOIN sz q ON q.entity_id = b),
sv AS (SELECT * FROM (VALUES ('clown', 'idiot', 1.0::DOUBLE), ('der', 'die', 1.0)) v(a, b, s)), al AS (SELECT a, b, coalesce(s, 0) AS svo, coalesce(c, 0)::DOUBLE AS cooccur, coalesce(d, 0) AS cluster FROM sv FULL JOIN co USING (a, b) FULL JOIN cs USING (a, b)),
wt AS (SELECT a, b, (svo + cooccur + cluster) / (SELECT max(svo + cooccur + cluster) FROM al) AS weight FROM al)"""


@query(f"WITH {_CG} SELECT a AS source, b AS target, round(weight, 6) AS weight FROM wt WHERE weight >= 0.1 UNION ALL SELECT b, a, round(weight, 6) FROM wt WHERE weight >= 0.1")
def context_edges(spark, t):
    """Document sources stand for the clusters of chunks."""
    triples = spark.createDataFrame([("idiot", "clown"), ("der", "die")], "subject_id string, object_id string")
    c = t("documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("cluster_id"))
    return graph.context_edges(_found(t), c, triples).select("source", "target", F.round("weight", 6).alias("weight"))


# tables


@query("""WITH RECURSIVE d AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT s_name, 'n' || s_nationkey FROM supplier),
t(id) AS (SELECT id FROM d WHERE id IN ('r1', 'n3') UNION SELECT d.id FROM d JOIN t ON d.parent = t.id) SELECT id AS domain_id FROM t""")
def domain_closure(spark, t):
    n = F.lit(None).cast("string")
    d = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("domain_id"), n.alias("parent_id"))
    d = d.union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))).union(t("supplier").select("s_name", F.concat(F.lit("n"), "s_nationkey")))
    return store.domain_closure(d, spark.createDataFrame([("r1",), ("n3",)], "domain_id string"))


@query("""WITH n AS (SELECT doc_id::VARCHAR AS d, sha256(text) AS h FROM documents), o AS (SELECT conv_id::VARCHAR AS d, sha256(max(text)) AS h FROM conversations GROUP BY 1)
SELECT coalesce(n.d, o.d) AS document_name, CASE WHEN n.d IS NULL THEN 'missing' WHEN o.d IS NULL THEN 'added' WHEN n.h = o.h THEN 'skipped' ELSE 'updated' END AS action FROM n FULL JOIN o ON n.d = o.d""")
def sync_actions(spark, t):
    old = t("conversations").groupBy(F.col("conv_id").cast("string").alias("document_name")).agg(F.max("text").alias("x")).select("document_name", store.document_hash(F.col("x")).alias("content_hash"))
    return store.sync_actions(old, t("documents").select(F.col("doc_id").cast("string").alias("document_name"), F.col("text").alias("content"))).select("document_name", "action")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1 UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def upsert_latest(spark, t):
    """Customers' last order over a row made from the customer."""
    old = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"), F.lit(None).cast("timestamp").alias("o_orderdate"))
    new = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return store.upsert(old, new, ["o_custkey"], F.col("o_orderdate")).drop("o_orderdate")


@query("""SELECT s_suppkey AS id, s_name AS name, 'local' AS origin FROM supplier UNION ALL SELECT p_partkey, p_name, 'global' FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def union_global(spark, t):
    a = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return store.union_global(a, t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ["id"])


@query("""SELECT s.conv_id, s.turn AS asked, n.turn FROM conversations s JOIN conversations n ON n.conv_id = s.conv_id AND n.turn BETWEEN s.turn - 1 AND s.turn + 1 WHERE s.role = 'assistant'""")
def chunk_neighbours(spark, t):
    c = t("conversations").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_name"), F.col("turn").alias("chunk_index"), "role")
    got = store.chunk_with_neighbours(c, c.filter("role = 'assistant'"))
    return got.select(F.col("document_name").alias("conv_id"), F.element_at(F.split("asked", "_"), 2).cast("long").alias("asked"), F.col("chunk_index").alias("turn"))


@query("""WITH x AS (SELECT conv_id, turn, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 4 END, turn) AS used FROM conversations) SELECT conv_id AS query_id, turn AS position, used::BIGINT AS used FROM x WHERE used <= 120""")
def prompt_budget(spark, t):
    prov = F.when(F.col("role") == "user", "seed").when(F.col("role") == "assistant", "structural").otherwise("other")
    h = t("conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), prov.alias("provenance"), F.col("text").alias("content"))
    return retrieval.prompt_budget(h, 120).select("query_id", "position", F.col("used").cast("long").alias("used"))


@query("""WITH r AS (SELECT source, quality + toxic AS rel, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rel DESC, k) AS best FROM r),
s AS (SELECT source, sum(CASE WHEN k <= 10 THEN rel / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) AS idcg FROM b GROUP BY source) SELECT source AS query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s""")
def ndcg(spark, t):
    j = t("documents").join(t("labels"), "doc_id").select(F.col("source").alias("query_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), (F.col("quality") + F.col("toxic")).alias("relevance"))
    return retrieval.ndcg(j, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query()
def mmr_cohort(spark, t):
    """A diverse ten for the first vector of each label, from its nearest sixty."""
    v = t("embeddings")
    q = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).withColumnRenamed("label", "query_id")
    near = retrieval.batch_vector_search(v, q, 60, "vec_id").select("query_id", F.col("id").alias("chunk_id"))
    return retrieval.select_cohort(retrieval.pool([("seed", near)]), v, q, 10, "vec_id")


@query()
def completeness_gate(spark, t):
    """Entities that the twenty best documents of a query don't mention, and the documents that do."""
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    hits = _words(spark, t, 20).select("query_id", F.col("id").alias("chunk_id"))
    asked = spark.createDataFrame([(i, w) for i, _ in TERMS for w in VOCABULARY], "query_id int, entity string")
    return retrieval.fill_missing(retrieval.missing_entities(hits, d, asked), d)


# more table operators

_TAGS = [("license", "(?i)licen[cs]e"), ("french", r"(^|\s)que\s"), ("german", r"(^|\s)nicht\s"), ("english", r"(^|\s)that\s")]


@query("""SELECT tag, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'license' WHEN regexp_matches(text, '(^|\\s)que\\s') THEN 'french' WHEN regexp_matches(text, '(^|\\s)nicht\\s') THEN 'german' WHEN regexp_matches(text, '(^|\\s)that\\s') THEN 'english' ELSE 'other' END AS tag FROM documents) GROUP BY tag""")
def domain_tags(spark, t):
    return t("documents").groupBy(X.tag_domain(F.col("text"), _TAGS).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def insert_new_rows(spark, t):
    """On conflict nothing happens."""
    old = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return store.insert_new(old, t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ["id"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_rows(spark, t):
    return store.orphans(t("customer").select("c_custkey", "c_name"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '[' || source || ' > ' || lang || ']' || chr(10) || text ELSE text END AS content FROM documents)
SELECT doc_id, CASE WHEN content LIKE '[%]%' THEN split_part(content, ']', 1) || ']' END AS breadcrumb, CASE WHEN content LIKE '[%]%' THEN ltrim(substr(content, instr(content, ']') + 1), chr(10) || ' ') ELSE content END AS content FROM c""")
def breadcrumb_split(spark, t):
    """Two of three documents carry a breadcrumb in front, as an old store has them."""
    old = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("["), "source", F.lit(" > "), "lang", F.lit("]\n"), "text")).otherwise(F.col("text"))
    return store.split_breadcrumbs(t("documents").select("doc_id", F.lit(None).cast("string").alias("breadcrumb"), old.alias("content")))


@query("""SELECT DISTINCT s.conv_id AS query_id, n.conv_id || '_' || n.turn AS chunk_id FROM conversations s JOIN conversations n ON n.conv_id = s.conv_id AND abs(n.turn - s.turn) = 1 WHERE s.role = 'user'""")
def structural_expansion(spark, t):
    c = t("conversations").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_name"), F.col("turn").alias("chunk_index"), "role")
    return retrieval.structural(c.filter("role = 'user'").select(F.col("document_name").alias("query_id"), "chunk_id"), c)


@query("""SELECT query_id, provenance, count(*) AS n FROM (SELECT s.conv_id AS query_id, s.turn, CASE WHEN s.role = 'user' THEN 'seed' ELSE 'structural' END AS provenance FROM conversations s
WHERE s.role = 'user' OR EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = s.conv_id AND n.role = 'user' AND abs(n.turn - s.turn) = 1)) GROUP BY ALL""")
def pool_provenance(spark, t):
    c = t("conversations").select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_name"), F.col("turn").alias("chunk_index"), "role")
    seeds = c.filter("role = 'user'").select(F.col("document_name").alias("query_id"), "chunk_id")
    return retrieval.trace(retrieval.pool([("seed", seeds), ("structural", retrieval.structural(seeds, c))])).select("query_id", "provenance", "n")


@query("""SELECT alias, entity_id, source FROM (SELECT p_name AS alias, p_partkey::VARCHAR AS entity_id, CASE WHEN p_size > 25 THEN 'user' ELSE p_brand END AS source, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, CASE WHEN p_size > 25 THEN 'user' ELSE p_brand END, p_partkey::VARCHAR) AS r FROM part) WHERE r = 1""")
def alias_priority(spark, t):
    a = t("part").select(F.col("p_name").alias("alias"), F.col("p_partkey").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("namespace"), F.when(F.col("p_size") > 25, "user").otherwise(F.col("p_brand")).alias("source"))
    return graph.alias_table(a).select("alias", "entity_id", "source")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_hours(spark, t):
    """The streaming windows over the events at rest (an extension)."""
    w = incremental.event_windows(t("events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


from . import registry_more  # noqa: E402, F401  registers its queries
