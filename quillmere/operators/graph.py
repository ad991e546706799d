"""Triples, traversal, hierarchies and the context graph of entities."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .clusters import cluster_entities

VERBS = frozenset(
    """aggregates approves assigns audited_by authorizes blocks calculated_by causes classified_as complies_with composed_of consumes contains
    created_by creates defined_by depends_on derived_from enables enforced_by equivalent_to exempt_from exposes extends fulfills governs has
    implements indexed_by instance_of inverse_of issues located_in maintained_by manages maps_to masks member_of owned_by part_of partitioned_by
    places populates precedes produces references requires sourced_from supersedes transforms triggers type_of used_for validates version_of""".split()
)
#: Verbs whose object is the parent, and verbs whose subject is.
UPWARD = ("classified_as", "extends", "instance_of", "member_of", "part_of", "type_of")
DOWNWARD = ("composed_of", "contains")

TRIPLE = "subject_id string, verb string, object_id string, confidence double, source_chunk_id string, description string"


def valid_triples(triples: DataFrame) -> DataFrame:
    """Triples with a known verb, both ids and a confidence in [0, 1]."""
    return triples.filter(F.col("verb").isin(*sorted(VERBS)) & F.col("confidence").between(0, 1) & F.col("subject_id").isNotNull() & F.col("object_id").isNotNull())


def parse_triples(answer: str, entities: Sequence[str] | None = None, chunk: str | None = None) -> list[tuple]:
    """Triples in a model's JSON answer, fences or not; rows with another verb, id or shape are dropped."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", answer or "")
    found = json.loads(body)
    rows = found.get("triples", []) if isinstance(found, dict) else found
    out = []
    for r in rows if isinstance(rows, list) else ():
        if not isinstance(r, dict):
            continue
        s, v, o = (r.get(k) for k in ("subject_id", "verb", "object_id"))
        c = r.get("confidence", 1.0)
        known = entities is None or (s in entities and o in entities)
        if isinstance(s, str) and isinstance(o, str) and s and o and known and v in VERBS and isinstance(c, (int, float)) and not isinstance(c, bool) and 0 <= c <= 1:
            out.append((s, v, o, float(c), chunk, str(r.get("description") or "")))
    return out


def extract_triples(chunks: DataFrame, llm: Callable[[str], str], prompt: Callable[[str, list[str]], str] | None = None) -> DataFrame:
    """Triples that an injected model finds in chunks (chunk_id, content[, entities]); one retry on bad JSON."""
    slim = chunks.select("chunk_id", "content", *(["entities"] if "entities" in chunks.columns else [F.lit(None).cast("array<string>").alias("entities")]))
    make = prompt or (lambda text, ids: f"Entities: {', '.join(ids)}\nVerbs: {', '.join(sorted(VERBS))}\nText:\n{text}\nAnswer with a JSON list of triples.")
    names = [f.split()[0] for f in TRIPLE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, text, ids in zip(b["chunk_id"], b["content"], b["entities"]):
                ids = None if ids is None else list(ids)
                for _ in range(2):
                    try:
                        rows += parse_triples(llm(make(text, ids or [])), ids, cid)
                        break
                    except (ValueError, AttributeError):
                        continue
            yield pd.DataFrame(rows, columns=names)

    return slim.mapInPandas(run, TRIPLE)


def anchored_chunks(chunks: DataFrame, associations: DataFrame, least: int = 2) -> DataFrame:
    """Chunks with at least ``least`` entities, with the sorted entity ids."""
    e = associations.groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entities")).filter(F.size("entities") >= least)
    return chunks.join(e, "chunk_id")


def entity_vectors_as_chunks(vectors: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Entities as searchable rows under the id ``__entity__{id}``."""
    d = vectors.join(descriptions, "entity_id", "left")
    return d.select(F.concat(F.lit("__entity__"), F.col("entity_id")).alias("chunk_id"), F.coalesce("description", "entity_id").alias("content"), F.lit("entity").alias("chunk_type"), "embedding")


def objects_of(triples: DataFrame, subject: str, verb: str | None = None) -> DataFrame:
    t = triples.filter(F.col("subject_id") == subject)
    return t.filter(F.col("verb") == verb) if verb else t


def subjects_of(triples: DataFrame, obj: str, verb: str | None = None) -> DataFrame:
    t = triples.filter(F.col("object_id") == obj)
    return t.filter(F.col("verb") == verb) if verb else t


def two_hop(triples: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hop 1 ids, hop 2 ids, triples touched by hop 1) from ``seeds`` (id), in both directions, each id at its nearest hop."""
    ways = triples.select(F.col("subject_id").alias("x"), F.col("object_id").alias("y")).union(triples.select("object_id", "subject_id"))
    start = seeds.select("id").distinct()
    step = lambda s: ways.join(s.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct()
    one = step(start).join(start, "id", "left_anti")
    two = step(one).join(start.union(one), "id", "left_anti")
    near = triples.join(start.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").unionByName(triples.join(start.select(F.col("id").alias("object_id")), "object_id", "left_semi")).select(*triples.columns).distinct()
    return one, two, near


def entity_parents(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, parent, verb): one parent of each entity, upward verbs first, then by verb and parent name.

    ``entities`` has id and name.
    """
    child, parent = entities.select(F.col("id").alias("child_id"), F.col("name")), entities.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    up = triples.filter(F.col("verb").isin(*UPWARD)).select(F.col("subject_id").alias("child_id"), F.col("object_id").alias("parent_id"), "verb", F.lit(0).alias("way"))
    down = triples.filter(F.col("verb").isin(*DOWNWARD)).select(F.col("object_id").alias("child_id"), F.col("subject_id").alias("parent_id"), "verb", F.lit(1).alias("way"))
    rows = up.union(down).join(child, "child_id").join(parent, "parent_id")
    first = Window.partitionBy("name").orderBy("way", "verb", "parent")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("name", "parent", "verb")


def chunk_clusters(associations: DataFrame, algorithm: str = "agglomerative", least: int = 10, threshold: float = 0.5) -> DataFrame:
    """(chunk_id, cluster_id) by the number of shared entities; empty under ``least`` chunks."""
    p = associations.select(F.col("chunk_id").cast("string").alias("chunk_id"), "entity_id").distinct()
    chunks = p.select("chunk_id").distinct()
    if chunks.count() < least:
        return chunks.filter("false").select("chunk_id", F.lit("").alias("cluster_id"))
    a, b = p.select("entity_id", F.col("chunk_id").alias("a")), p.select("entity_id", F.col("chunk_id").alias("b"))
    shared = a.join(b, "entity_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("score"))
    found = cluster_entities(chunks.select(F.col("chunk_id").alias("entity_id")), shared, algorithm, threshold)
    return found.select(F.col("entity_id").alias("chunk_id"), "cluster_id")


def context_edges(associations: DataFrame, clusters: DataFrame, triples: DataFrame, least: float = 0.1) -> DataFrame:
    """(source, target, weight, svo, cooccur, cluster) of related entities, in both directions.

    A triple counts 1, a shared chunk 0.8, and the overlap of the entities' chunk clusters up to
    0.4; weights are relative to the largest.  Only pairs with a signal are formed: three sets of
    candidates, by triple, by chunk, and by cluster.
    """
    p = associations.select("chunk_id", "entity_id").distinct()
    ec = p.join(clusters.select("chunk_id", "cluster_id"), "chunk_id").select("entity_id", "cluster_id").distinct()

    def met(t: DataFrame, key: str) -> DataFrame:
        return t.select(key, F.col("entity_id").alias("a")).join(t.select(key, F.col("entity_id").alias("b")), key).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    known = p.select("entity_id").distinct()
    pairs = triples.select(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).filter("a < b").distinct()
    svo = pairs.join(known.select(F.col("entity_id").alias("a")), "a", "left_semi").join(known.select(F.col("entity_id").alias("b")), "b", "left_semi").select("a", "b", F.lit(1.0).alias("svo"))
    co = met(p, "chunk_id").select("a", "b", F.least(F.col("n") * 0.8, F.lit(0.8)).alias("cooccur"))
    size = ec.groupBy("entity_id").agg(F.count(F.lit(1)).alias("k"))
    cl = met(ec, "cluster_id").join(size.toDF("a", "ka"), "a").join(size.toDF("b", "kb"), "b").select("a", "b", (0.4 * F.col("n") / (F.col("ka") + F.col("kb") - F.col("n"))).alias("cluster"))
    none = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    full = svo.join(co, ["a", "b"], "full").join(cl, ["a", "b"], "full").select("a", "b", none("svo"), none("cooccur"), none("cluster"))
    full = full.withColumn("raw", F.col("svo") + F.col("cooccur") + F.col("cluster"))
    top = full.agg(F.max("raw").alias("top"))
    kept = full.crossJoin(F.broadcast(top)).withColumn("weight", F.col("raw") / F.col("top")).filter(F.col("weight") >= least)  # top is one row
    there = kept.select(F.col("a").alias("source"), F.col("b").alias("target"), "weight", "svo", "cooccur", "cluster")
    return there.union(there.select("target", "source", "weight", "svo", "cooccur", "cluster"))


def edges_by_namespace(associations: DataFrame, clusters: DataFrame, triples: DataFrame, least: float = 0.1) -> DataFrame:
    """``context_edges`` within each namespace (null is ``global``), in one plan.

    Entity, chunk and cluster ids are prefixed by the namespace, so no pair crosses it; the
    largest weight is taken by namespace.
    """
    ns = F.coalesce(F.col("namespace"), F.lit("global"))
    tag = lambda c: F.to_json(F.struct(ns.alias("n"), F.col(c).cast("string").alias("v"))).alias(c)
    a = associations.select(tag("chunk_id"), tag("entity_id"))
    c = clusters.select(tag("chunk_id"), tag("cluster_id"))
    t = triples.select(tag("subject_id"), tag("object_id"))
    raw = context_edges(a, c, t, 0.0)
    own = F.get_json_object("source", "$.n")
    top = F.max("weight").over(Window.partitionBy(own))
    out = raw.withColumn("namespace", own).withColumn("weight", F.col("weight") / top).filter(F.col("weight") >= least)
    return out.withColumns({"source": F.get_json_object("source", "$.v"), "target": F.get_json_object("target", "$.v")})


def edges_of(edges: DataFrame, entity: str, least: float = 0.1) -> DataFrame:
    return edges.filter((F.col("source") == entity) & (F.col("weight") >= least)).orderBy(F.desc("weight"), "target")


def graph_stats(associations: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: entity_count, edge_count, chunk_count."""
    e = associations.agg(F.countDistinct("entity_id").alias("entity_count"))
    return e.crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count"))).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunk_count")))


def alias_table(aliases: DataFrame) -> DataFrame:
    """One row for each (alias, namespace): a user's alias replaces others, else the first by source and entity stays."""
    rank = F.when(F.col("source") == "user", 0).otherwise(1)
    newest = F.desc("added_at") if "added_at" in aliases.columns else F.lit(0)
    w = Window.partitionBy("alias", "namespace").orderBy(rank, F.when(rank == 0, newest) if "added_at" in aliases.columns else F.lit(0), "source", "entity_id")
    return aliases.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
