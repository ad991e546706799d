"""Search: vectors, BM25, fusion, expansion, diversity, prompts and measures.

All operators take a ``query_id`` where it makes sense, so that many queries are one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import cosine, est_tokens
from .tables import stored

K1, B = 1.2, 0.75
#: Query terms, at about 100 bytes each, up to which they are sent to all tasks.
BROADCAST_TERMS = 300_000
RRF_K = 60
PRIORITY = dict(seed=1.0, structural=0.9, entity_adjacent=0.7, context_graph_expansion=0.6, cluster_adjacent=0.5)
STAGES = ("seed", "structural", "entity_adjacent", "cluster_adjacent", "entity_embedding")


def filters(namespaces: Sequence[str] | None = None, kinds: Sequence[str] | None = None, domains: Sequence[str] | None = None, fingerprint: str | None = None) -> Column:
    """Conjunction of the given restrictions; a missing one means all, an empty list none."""
    out = F.lit(True)
    for c, v in (("namespace", namespaces), ("chunk_type", kinds), ("domain_id", domains)):
        if v is not None:
            out = out & F.col(c).isin(*v)
    return out if fingerprint is None else out & (F.col("session_fingerprint") == fingerprint)


def vector_search(chunks: DataFrame, query: Sequence[float], k: int, where: Column | None = None, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of largest cosine to one vector after the filter; ties by id.

    The vector is a literal, so this is one scan with a top-k in each task and a final merge.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks if where is None else chunks.filter(where)
    return rows.withColumn("score", cosine(F.col(vec_col), q)).orderBy(F.desc("score"), id_col).limit(k)


def batch_vector_search(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest by cosine for each row of ``queries`` (query_id, query).

    Every task keeps its own k best by query with matrix products, and a window merges
    them.  Queries are the side that is sent to all tasks: batches of them, for which the
    caller's number of queries bounds the memory.
    """
    q = queries.select("query_id", F.col("query").cast("array<double>")).collect()
    ids = [r[0] for r in q]
    m = np.array([r[1] for r in q], float).reshape(len(q), -1)
    m = m / np.where(n := np.linalg.norm(m, axis=1, keepdims=True), n, 1) if len(q) else m
    shipped = chunks.sparkSession.sparkContext.broadcast((ids, m))
    kind, qkind = chunks.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    slim = chunks.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qi, qm = shipped.value
        best: pd.DataFrame | None = None
        for b in batches:
            if not len(b) or not len(qi):
                continue
            v = np.array(b["v"].tolist(), float)
            v = v / np.where(n := np.linalg.norm(v, axis=1, keepdims=True), n, 1)
            s = np.round(v @ qm.T, 9)
            if len(s) > 2 * k:  # the rows at or above the 2k-th score of each query, ties included
                r, c = np.nonzero(s >= -np.partition(-s, 2 * k - 1, axis=0)[2 * k - 1])
            else:
                r, c = (x.ravel() for x in np.indices(s.shape))
            part = pd.DataFrame({"query_id": np.array(qi, dtype=object)[c] if not isinstance(qi[0], int) else np.array(qi)[c], "id": b["id"].to_numpy()[r], "score": s[r, c]})
            if skip_self:
                part = part[part["id"] != part["query_id"]]
            best = part if best is None else pd.concat([best, part])
            best = best.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    found = slim.mapInPandas(run, f"query_id {qkind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_scores(a: DataFrame, b: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Cosine of every pair of two small tables, as a plain cross join."""
    return a.select(F.col(id_col).alias("a"), F.col(vec_col).alias("va")).crossJoin(b.select(F.col(id_col).alias("b"), F.col(vec_col).alias("vb"))).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("score"))


# BM25


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, token, tf, length): the inverted index.

    Write it partitioned or bucketed by token to serve queries; it is one shuffle with
    partial counts in each task.
    """
    t = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts")).select("id", F.size("ts").alias("length"), F.explode("ts").alias("token"))
    return t.groupBy("id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int | None, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, query), best k first; ties by id.

    The corpus is read and cut into words once: only postings of the queries' terms are kept, and one row for each
    text, whose term is empty, for the corpus statistics (N, mean length).  Terms are joined before counting, by
    broadcast up to BROADCAST_TERMS of them, beyond that by a shuffle.
    """
    base = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts")).filter("ts IS NOT NULL")
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    wanted = terms.select("token").union(chunks.sparkSession.createDataFrame([("",)], "token string")).distinct()
    small = terms.count() <= BROADCAST_TERMS  # which bounds wanted and df too
    sent = F.broadcast if small else (lambda d: d)
    found = base.select("id", F.size("ts").alias("length"), F.explode(F.concat(F.array(F.lit("")), "ts")).alias("token")).join(sent(wanted), "token").groupBy("id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
    found = stored(found, "postings")
    stats = found.filter("token = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = found.filter("token <> ''")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(sent(df), "token").join(sent(terms), "token").crossJoin(stats).groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


# fusion


def rrf(left: DataFrame, right: DataFrame, limit: int | None = None, variant: str = "scaled", penalty: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists: (query_id, id, score, rank).

    ``scaled`` divides by the score of a double first place, ``plain`` doesn't, ``penalty``
    gives an absent row the rank of ``penalty`` candidates (the database form).
    """
    a = left.select("query_id", "id", F.col("rank").alias("r1"))
    b = right.select("query_id", "id", F.col("rank").alias("r2"))
    both = a.join(b, ["query_id", "id"], "full")
    if variant == "penalty":
        miss = F.lit((penalty or 0) + RRF_K)
        score = 1.0 / (RRF_K + F.coalesce("r1", miss)) + 1.0 / (RRF_K + F.coalesce("r2", miss))
    else:
        score = F.coalesce(1.0 / (RRF_K + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("r2")), F.lit(0.0))
        if variant == "scaled":
            score = score / (2.0 / (RRF_K + 1))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last(), "id")
    ranked = both.withColumn("score", score).withColumn("rank", F.row_number().over(w)).select("query_id", "id", "score", "rank")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def hybrid(vectors: DataFrame, words: DataFrame, limit: int, fetch: int = 3) -> DataFrame:
    """Fusion of the first ``fetch`` x limit of both lists; a query without word hits keeps its vector list and scores."""
    v, w = (d.filter(F.col("rank") <= fetch * limit) for d in (vectors, words))
    fused = rrf(v, w, limit)
    lone = v.join(w.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("rank") <= limit).select("query_id", "id", "score", "rank")
    return fused.join(w.select("query_id").distinct(), "query_id", "left_semi").unionByName(lone)


# expansion


def structural(seeds: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """(query_id, chunk_id) of the chunks next to seeds (query_id, chunk_id) in their documents."""
    at = chunks.select("chunk_id", "document_name", "chunk_index")
    near = seeds.join(at, "chunk_id").select("query_id", "document_name", F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])).alias("d"), "chunk_index")
    near = near.select("query_id", "document_name", (F.col("chunk_index") + F.col("d")).alias("chunk_index"))
    return near.join(at, ["document_name", "chunk_index"]).select("query_id", "chunk_id").distinct()


def by_entities(pool: DataFrame, associations: DataFrame, top: int = 3, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, linked_by) of the best ``top`` chunks of each entity in the pool (query_id, chunk_id)."""
    a = associations.select("chunk_id", "entity_id", "score")
    found = pool.join(a, "chunk_id").select("query_id", "entity_id").distinct()
    best = a.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("r") <= top)
    out = found.join(best, "entity_id").select("query_id", "chunk_id", F.col("entity_id").alias("linked_by"))
    return out if allowed is None else out.join(allowed.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "linked_by")


def by_clusters(pool: DataFrame, associations: DataFrame, neighbours: DataFrame, budget: int) -> DataFrame:
    """(query_id, chunk_id, linked_by): the best chunk of each cluster neighbour, at most ``budget`` a query, in order of neighbour."""
    found = pool.join(associations.select("chunk_id", "entity_id"), "chunk_id").select("query_id", "entity_id").distinct()
    near = found.join(neighbours, "entity_id").select("query_id", F.col("neighbour").alias("entity_id")).distinct()
    near = near.join(found, ["query_id", "entity_id"], "left_anti")
    out = by_entities_of(near, associations, 1)
    w = Window.partitionBy("query_id").orderBy("linked_by", "chunk_id")
    return out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= budget).drop("n")


def by_entities_of(found: DataFrame, associations: DataFrame, top: int) -> DataFrame:
    """(query_id, chunk_id, linked_by) of the best chunks of given entities (query_id, entity_id)."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("score"), "chunk_id")
    best = associations.select("chunk_id", "entity_id", "score").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    return found.join(best, "entity_id").select("query_id", "chunk_id", F.col("entity_id").alias("linked_by"))


def by_entity_vectors(query_vectors: DataFrame, entity_vectors: DataFrame, associations: DataFrame, entities: int = 10, chunks: int = 2) -> DataFrame:
    """Chunks of the entities nearest to any of a query's vectors (query_id, query)."""
    s = query_vectors.crossJoin(entity_vectors.select("entity_id", "embedding")).select("query_id", "entity_id", cosine(F.col("query"), F.col("embedding")).alias("s"))
    top = s.groupBy("query_id", "entity_id").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "entity_id"))).filter(F.col("r") <= entities)
    return by_entities_of(top.select("query_id", "entity_id"), associations, chunks)


def lane(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """Candidates whose vector is at least so close to the query's."""
    j = candidates.join(chunks.select("chunk_id", "embedding"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    return j.filter(cosine(F.col("embedding"), F.col("query")) >= least).select(*candidates.columns)


def pool(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, chunk_id, provenance, stage): each chunk once, from the first stage that has it."""
    out = None
    for i, (name, d) in enumerate(stages):
        p = d.select("query_id", "chunk_id", F.lit(name).alias("provenance"), F.lit(i).alias("stage"))
        out = p if out is None else out.union(p)
    w = Window.partitionBy("query_id", "chunk_id").orderBy("stage")
    return out.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def trace(pooled: DataFrame) -> DataFrame:
    """(query_id, provenance, n, chunk_ids): what each stage brought."""
    return pooled.groupBy("query_id", "provenance").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def mmr(query: np.ndarray, vectors: Sequence, provenance: Sequence[str], k: int, weights=(0.5, 0.2, 0.3), diversity: float = 0.3) -> list[tuple[int, float]]:
    """(index, score) in order of selection: relevance, priority of the stage, and relevance less the nearest selected."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1)
    m = np.zeros((len(vectors), len(q)))
    has = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == len(q):
            m[i] = np.asarray(v, float)
            m[i] /= np.linalg.norm(m[i]) or 1
            has[i] = True
    rel = np.round(m @ q, 12)
    fixed = weights[0] * rel + weights[1] * np.array([PRIORITY.get(p, 0.5) for p in provenance])
    near, free, out = np.full(len(m), -np.inf), np.ones(len(m), bool), []
    for step in range(min(k, len(m))):
        gain = rel - (diversity * np.where(has, near, 0.0) if step else 0.0)
        total = np.where(free, fixed + weights[2] * gain, -np.inf)
        i = int(np.argmax(np.round(total, 12)))
        out.append((i, float(total[i])))
        free[i] = False
        near = np.maximum(near, m @ m[i])
    return out


def select_cohort(pooled: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, provenance, score, rank): greedy selection, one query a group; ties by stage and chunk id."""
    rows = pooled.join(chunks.select(F.col(id_col).alias("chunk_id"), "embedding"), "chunk_id", "left").join(queries.select("query_id", "query"), "query_id")
    kind, qkind = pooled.schema["chunk_id"].dataType.simpleString(), pooled.schema["query_id"].dataType.simpleString()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["stage", "chunk_id"]).reset_index(drop=True)
        picked = mmr(g["query"].iloc[0], g["embedding"].tolist(), g["provenance"].tolist(), k)
        at = [i for i, _ in picked]
        return pd.DataFrame({"query_id": g["query_id"].iloc[at].to_numpy(), "chunk_id": g["chunk_id"].iloc[at].to_numpy(), "provenance": g["provenance"].iloc[at].to_numpy(), "score": [s for _, s in picked], "rank": range(1, len(at) + 1)})

    return rows.groupBy("query_id").applyInPandas(one, f"query_id {qkind}, chunk_id {kind}, provenance string, score double, rank int")


def missing_entities(cohort: DataFrame, chunks: DataFrame, query_entities: DataFrame) -> DataFrame:
    """(query_id, entity): entities of the query (query_id, entity) that no selected chunk's text mentions."""
    text = cohort.join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", F.lower("content").alias("t"))
    seen = query_entities.join(text, "query_id").filter(F.expr("instr(t, lower(entity)) > 0")).select("query_id", "entity").distinct()
    return query_entities.join(seen, ["query_id", "entity"], "left_anti")


def fill_missing(missing: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, associations: DataFrame | None = None, entity_vectors: DataFrame | None = None, k: int = 20) -> DataFrame:
    """(query_id, chunk_id) to complete a selection: by the context graph, by vectors of the entities, or by their words.

    With edges an entity's graph neighbours give their best chunk; with vectors each entity gets
    max(3, k / missing) chunks; else every chunk that has the entity's text.
    """
    if edges is not None and associations is not None:
        near = missing.join(edges.select(F.col("source").alias("entity"), F.col("target").alias("entity_id")), "entity").select("query_id", "entity_id").distinct()
        return by_entities_of(near, associations, 1).select("query_id", "chunk_id").distinct()
    if entity_vectors is not None:
        n = missing.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
        asked = missing.join(entity_vectors.select(F.col("entity_id").alias("entity"), F.col("embedding").alias("ev")), "entity").join(n, "query_id")
        s = asked.crossJoin(chunks.select("chunk_id", "embedding")).select("query_id", "entity", "m", "chunk_id", cosine(F.col("ev"), F.col("embedding")).alias("s"))
        r = F.row_number().over(Window.partitionBy("query_id", "entity").orderBy(F.desc("s"), "chunk_id"))
        return s.withColumn("r", r).filter(F.col("r") <= F.greatest(F.lit(3), F.floor(F.lit(k) / F.col("m")))).select("query_id", "chunk_id").distinct()
    hit = missing.join(chunks.select("chunk_id", F.lower("content").alias("t")), F.expr("instr(t, lower(entity)) > 0"))
    return hit.select("query_id", "chunk_id").distinct()


def near_duplicates_out(hits: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Hits (query_id, chunk_id, score, embedding) without those too close to a better one of the query."""
    names = hits.columns

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "chunk_id"], ascending=[False, True])
        m = np.array(g["embedding"].tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        keep: list[int] = []
        for i in range(len(m)):
            if not keep or (m[keep] @ m[i]).max() < threshold:
                keep.append(i)
        return g.iloc[keep][names]

    return hits.groupBy("query_id").applyInPandas(one, hits.schema)


def graph_first(queries: DataFrame, triples: DataFrame, associations: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, chunk_id): best chunks of entities within two hops of the query's (query_id, entity_id)."""
    ways = triples.select(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("y")).union(triples.select("object_id", "subject_id"))
    one = queries.join(ways, "entity_id").select("query_id", F.col("y").alias("entity_id"))
    two = one.join(ways, "entity_id").select("query_id", F.col("y").alias("entity_id"))
    return by_entities_of(queries.select("query_id", "entity_id").union(one).union(two).distinct(), associations, top).select("query_id", "chunk_id").distinct()


def completed(cohort: DataFrame, chunks: DataFrame, query_entities: DataFrame, k: int, edges: DataFrame | None = None, associations: DataFrame | None = None, entity_vectors: DataFrame | None = None, most: int = 20) -> DataFrame:
    """The cohort and, for entities of the query that none of its texts mention, up to ``most`` chunks that do, as ``entity_embedding``.

    query_entities has query_id and entity.  Chunks come by the context graph, by entity vectors or by text, whichever is
    given first; they follow the cohort in the order of their ids, with score 0.
    """
    missing = missing_entities(cohort, chunks, query_entities)
    fill = fill_missing(missing, chunks, edges, associations, entity_vectors, k)
    new = fill.join(cohort.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    last = cohort.groupBy("query_id").agg(F.max("rank").alias("last"))
    new = new.withColumn("n", place).filter(F.col("n") <= most).join(last, "query_id", "left")
    return cohort.unionByName(new.select("query_id", "chunk_id", F.lit("entity_embedding").alias("provenance"), F.lit(0.0).alias("score"), (F.coalesce("last", F.lit(0)) + F.col("n")).alias("rank")))


def with_breadcrumbs(hits: DataFrame) -> DataFrame:
    """Hits (content, breadcrumb) whose content shows where it stands: the breadcrumb on a line before it, if there is one."""
    shown = F.when(F.length("breadcrumb") > 0, F.concat("breadcrumb", F.lit("\n"), "content")).otherwise(F.col("content"))
    return hits.withColumn("content", shown)


def community_context(hits: DataFrame, chunk_communities: DataFrame, communities: DataFrame, level: int = 0, most: int = 3, least: float = 0.0) -> DataFrame:
    """(query_id, community_context): labels of the communities that most of a query's hits belong to, the largest share first."""
    at = chunk_communities.filter(F.col("level") == level).select("chunk_id", "community_id")
    named = communities.filter((F.col("level") == level) & (F.col("coherence") >= least) & (F.length("topic_label") > 0)).select("community_id", "topic_label")
    n = hits.join(at, "chunk_id").join(named, "community_id").groupBy("query_id", "topic_label").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "topic_label"))).filter(F.col("r") <= most)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "topic_label"))), lambda x: x["topic_label"]), "; ").alias("community_context"))


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    mode: str = "vector_first",
    associations: DataFrame | None = None,
    neighbours: DataFrame | None = None,
    triples: DataFrame | None = None,
    query_entities: DataFrame | None = None,
    lane_least: float | None = None,
    chunk_filter: Callable[[DataFrame], DataFrame] | None = None,
    entity_vectors: DataFrame | None = None,
    query_entity_vectors: DataFrame | None = None,
    edges: DataFrame | None = None,
    complete: bool = False,
) -> DataFrame:
    """The whole search for queries (query_id, query vector, text) as one plan.

    chunks has chunk_id, document_name, chunk_index, content, embedding.  vector_first: seeds by hybrid
    search, expansion by structure, entities, clusters and entity vectors, and greedy selection.  graph_first adds
    chunks within two hops.  global searches community summaries only.

    With ``entity_vectors`` (entity_id, embedding) the entities nearest to the query, or to its own entities' vectors
    (``query_entity_vectors``: query_id, query), bring their best chunks.  With ``complete``, entities of
    ``query_entities`` (query_id, entity_id[, entity]) that no selected text mentions bring chunks that do, by the context graph
    (``edges``), by vectors or by text.
    """
    if mode not in ("vector_first", "graph_first", "global"):
        raise ValueError(f"no such mode: {mode!r}")
    base = chunks.filter(F.col("chunk_type") == "community_summary") if mode == "global" else chunks
    near = batch_vector_search(base, queries, 9 * k if mode != "global" else k)
    if mode == "global":
        return near.select("query_id", F.col("id").alias("chunk_id"), F.lit("community").alias("provenance"), "score", "rank")
    words = bm25(base, queries.select("query_id", F.col("text").alias("query")), 9 * k)
    seeds = hybrid(near, words, 3 * k).select("query_id", F.col("id").alias("chunk_id"))
    stages = [("seed", seeds)]
    if mode == "graph_first" and triples is not None and query_entities is not None and associations is not None:
        stages.append(("entity_adjacent", graph_first(query_entities.select("query_id", "entity_id"), triples, associations)))
    stages.append(("structural", structural(seeds, chunks)))
    if associations is not None:
        e = by_entities(seeds, associations)
        stages.append(("entity_adjacent", lane(e, chunks, queries, lane_least) if lane_least is not None else e))
        if neighbours is not None:
            stages.append(("cluster_adjacent", by_clusters(seeds, associations, neighbours, 2 * k)))
        if entity_vectors is not None:
            asked = query_entity_vectors if query_entity_vectors is not None else queries.select("query_id", "query")
            found = by_entity_vectors(asked, entity_vectors, associations)
            stages.append(("entity_embedding", lane(found, chunks, queries, lane_least) if lane_least is not None else found))
    out = select_cohort(pool(stages), chunks, queries, k)
    if complete and query_entities is not None:
        entity = F.col("entity") if "entity" in query_entities.columns else F.col("entity_id")
        out = completed(out, chunks, query_entities.select("query_id", entity.alias("entity")), k, edges, associations, entity_vectors)
    return chunk_filter(out) if chunk_filter else out


# prompts


def prompt_budget(hits: DataFrame, budget: int, header_tokens: Column | int = 0) -> DataFrame:
    """Hits (query_id, provenance, position, content) that fit a prompt: by tier, stopping at the first that doesn't."""
    tier = F.coalesce(*[F.when(F.col("provenance") == p, i) for i, p in enumerate(STAGES[:4])], F.lit(4))
    cost = est_tokens(F.col("content"))
    w = Window.partitionBy("query_id").orderBy("tier", "position")
    head = F.lit(header_tokens) if isinstance(header_tokens, int) else header_tokens
    return hits.withColumn("tier", tier).withColumn("cost", cost).withColumn("used", F.sum("cost").over(w) + head).filter(F.col("used") <= budget)


def build_prompts(hits: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """(query_id, prompt): context and query, then the selected chunks; queries has query_id, text, community_context."""
    head = F.concat_ws("\n", F.concat(F.lit("Context: "), F.nullif("community_context", F.lit(""))), F.concat(F.lit("Query: "), "text"))
    q = queries.select("query_id", head.alias("head"))
    kept = prompt_budget(hits.join(q, "query_id"), budget, est_tokens(F.col("head")))
    line = F.concat(F.lit("["), "provenance", F.lit("] "), "document_name", F.lit(":\n"), "content")
    body = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("tier", "position", line.alias("line")))).alias("x"))
    return q.join(body, "query_id", "left").select("query_id", F.concat_ws("\n\n", "head", F.transform("x", lambda r: r["line"])).alias("prompt"))


def graph_context(entities: DataFrame, relations: DataFrame, reports: DataFrame, sources: DataFrame, budget: int = 8000) -> DataFrame:
    """(query_id, context) of sections Entities, Relationships, Community Reports and Source Text within 4 x budget characters.

    The tables are one block each, taken if they fit; reports and sources are blocks in order,
    a section ends at the first block that doesn't fit.
    """
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))

    def table(d: DataFrame, title: str, cols: list[Column], names: str, order: list[str]) -> DataFrame:
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
        rule = "|".join("-" * (len(n) + 2) for n in names.split(","))
        head = f"## {title}\n\n| {' | '.join(names.split(','))} |\n|{rule}|\n"
        rows = d.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, row.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
        return rows.select("query_id", F.concat(F.lit(head), "t").alias("block"))

    def texts(d: DataFrame, title: str, rank: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("position")
        n = F.row_number().over(w)
        return d.select("query_id", F.lit(rank).alias("part"), n.alias("n"), F.when(n == 1, F.concat(F.lit(f"## {title}\n\n"), F.coalesce("content", F.lit("")))).otherwise(F.coalesce("content", F.lit(""))).alias("block"))

    e = table(entities, "Entities", [F.col("name"), F.col("type"), dash("description")], "Name,Type,Description", ["name"]).select("query_id", F.lit(0).alias("part"), F.lit(1).alias("n"), "block")
    r = table(relations, "Relationships", [F.col("subject"), F.col("verb"), F.col("object"), dash("description")], "Subject,Relationship,Object,Description", ["subject", "verb", "object"]).select("query_id", F.lit(1).alias("part"), F.lit(1).alias("n"), "block")
    blocks = e.union(r).union(texts(reports, "Community Reports", 2)).union(texts(sources, "Source Text", 3))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        out, used, full = [], 0, set()
        for part, block in g.sort_values(["part", "n"])[["part", "block"]].itertuples(index=False):
            if part in full:
                continue
            if used + len(block) > 4 * budget:
                full.add(part)
                continue
            out.append(block)
            used += len(block)
        return pd.DataFrame({"query_id": [g["query_id"].iloc[0]], "context": ["\n\n".join(out)]})

    return blocks.groupBy("query_id").applyInPandas(one, f"query_id {entities.schema['query_id'].dataType.simpleString()}, context string")


def map_reduce_answers(reports: DataFrame, llm: Callable[[str, str], tuple[float, str]]) -> DataFrame:
    """(query_id, report_id, points, answer) of reports (query_id, text, report_id, content) that the model scores above 0, best first."""
    qkind, rkind = reports.schema["query_id"].dataType.simpleString(), reports.schema["report_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [llm(q, c) for q, c in zip(b["text"], b["content"])]
            yield pd.DataFrame({"query_id": b["query_id"], "report_id": b["report_id"], "points": [float(p) for p, _ in got], "answer": [a for _, a in got]})

    slim = reports.select("query_id", "text", "report_id", "content")
    return slim.mapInPandas(run, f"query_id {qkind}, report_id {rkind}, points double, answer string").filter("points > 0").orderBy("query_id", F.desc("points"), "report_id")


# measures


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg) of (query_id, rank, relevance) against the best order of the same rows."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank"))
    gain = lambda r: F.when(F.col(r) <= k, F.col("relevance") / F.log2(F.col(r) + 1)).otherwise(0.0)
    d = ranked.withColumn("best", ideal).groupBy("query_id").agg(F.sum(gain("rank")).alias("dcg"), F.sum(gain("best")).alias("idcg"))
    return d.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


#: First line of a chunk that goes on from another, and how a finished text ends.
CONTINUED, FINISHED = r"(?i)^\[(TABLE|LIST|PARA):(cont|start|end)\]", r"[.?!\"')\]>}\d]\s*$"


def quality_measures(hits: DataFrame, k: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(query_id, ndcg, coherence, scope, efficiency, rqi) of hits (query_id, rank, content, relevance, distractor) up to rank k.

    coherence: share of k chunks that are whole, neither marked as a continuation nor ended in mid-sentence; scope: 1 less the
    discounted places of distractors, 0 at least; efficiency: share of words in relevant chunks; rqi: their mean by weight.
    """
    first = hits.filter(F.col("rank") <= k)
    text = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    prose = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~x.startswith("["))
    last = F.try_element_at(prose, F.lit(-1))
    whole = ~text.rlike(CONTINUED) & (last.isNull() | last.rlike(FINISHED))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    per = first.groupBy("query_id").agg(
        F.sum(F.when(whole, 1).otherwise(0)).alias("whole"),
        F.sum(F.when(F.col("distractor"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("far"),
        F.sum(F.when(F.col("relevance") > 0, words).otherwise(0)).alias("used"),
        F.sum(words).alias("words"),
    )
    # the best order is that of the hits up to k, as they were found
    joined = per.join(ndcg(first, k), "query_id")
    out = joined.select("query_id", "ndcg", (F.col("whole") / k).alias("coherence"), F.greatest(F.lit(0.0), 1 - F.col("far")).alias("scope"), F.when(F.col("words") > 0, F.col("used") / F.col("words")).otherwise(0.0).alias("efficiency"))
    w = weights or {"ndcg": 1, "coherence": 1, "scope": 1, "efficiency": 1}
    return out.withColumn("rqi", sum((F.col(c) * x for c, x in w.items()), F.lit(0.0)) / sum(w.values()))


def rqi(measures: DataFrame, category_weights: Mapping[str, float]) -> DataFrame:
    """One row (rqi) from (category, rqi) of queries: the weighted sum of the categories' means; absent categories count nothing."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in category_weights.items() for x in kv]), F.col("category")), F.lit(0.0))
    return measures.groupBy("category").agg(F.avg("rqi").alias("m")).agg(F.coalesce(F.sum(w * F.col("m")), F.lit(0.0)).alias("rqi"))


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, both, only_a, only_b) of two runs' chunk ids."""
    x = a.groupBy("query_id").agg(F.collect_set("chunk_id").alias("x"))
    y = b.groupBy("query_id").agg(F.collect_set("chunk_id").alias("y"))
    none = lambda c: F.coalesce(c, F.array())
    j = x.join(y, "query_id", "full")
    return j.select("query_id", F.sort_array(F.array_intersect(none("x"), none("y"))).alias("both"), F.sort_array(F.array_except(none("x"), none("y"))).alias("only_a"), F.sort_array(F.array_except(none("y"), none("x"))).alias("only_b"))
