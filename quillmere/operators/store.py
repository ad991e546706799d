"""Tables as parquet snapshots: upserts, registries, domains, unions and incremental sync.

A table is a folder of snapshot folders and a pointer file that names the current one.  A
change writes a new snapshot and then moves the pointer, so readers never see half a
write and the path being read is never overwritten.  Tables that change together have one more
pointer file, at the root: it moves once for all of them, and counts where it is newer than a table's own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SCHEMAS = {
    "embeddings": "chunk_id string, document_name string, content string, section array<string>, chunk_index int, source_offset long, source_length long, breadcrumb string, embedding_content string, chunk_type string, source_detail map<string,string>, embedding array<float>, namespace string, source_id string, domain_id string, session_fingerprint string",
    "documents": "document_name string, content_hash string, source_uri string, indexed_at timestamp, chunk_count int",
    "namespaces": "namespace_id string, description string",
    "domains": "domain_id string, namespace string, parent_id string, description string",
    "sources": "source_id string, domain_id string, config string, last_crawled timestamp",
    "entities": "id string, name string, display_name string, entity_type string, description string",
    "chunk_entities": "chunk_id string, entity_id string, frequency int, positions array<int>, score double, chunk_length int, namespace string",
    "entity_aliases": "alias string, entity_id string, namespace string, source string",
    "svo_triples": "subject_id string, verb string, object_id string, confidence double, source_chunk_id string, description string, namespace string",
    "entity_clusters": "entity_id string, cluster_id string",
    "chunk_clusters": "chunk_id string, cluster_id string, namespace string",
    "context_graph_edges": "source string, target string, weight double, svo double, cooccur double, cluster double, namespace string",
    "chunk_communities": "chunk_id string, level int, community_id string",
    "communities": "community_id string, level int, topic_label string, size long, coherence double, resolution double",
    "namespace_build_log": "namespace_id string, stage string, built_at timestamp",
}


@dataclass
class Snapshots:
    """Versioned tables under one root; ``stage`` writes, ``promote`` makes current, ``discard`` forgets."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _load(self, path: str) -> dict | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, folder: str, name: str, state: dict) -> None:
        """Written beside and renamed over the old file."""
        fs, new = self._fs(f"{folder}/_new-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, old = self._fs(f"{folder}/{name}")
        sc = self.spark.sparkContext
        hadoop, rename = sc._jvm.org.apache.hadoop.fs, getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(new, old, how)

    def _pointer(self, table: str) -> dict:
        own = self._load(f"{self.root}/{table}/_current.json") or {"version": 0, "current": None, "pending": None}
        joint = (self._load(f"{self.root}/_together.json") or {}).get(table)
        return joint if joint and joint["version"] > own["version"] else own

    def _point(self, table: str, state: dict) -> None:
        self._save(f"{self.root}/{table}", "_current.json", state)

    def read(self, table: str) -> DataFrame:
        """The current snapshot; an empty table of the known schema before the first."""
        now = self._pointer(table)["current"]
        if now is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.parquet(now)

    def stage(self, table: str, df: DataFrame, partition: Sequence[str] = ()) -> None:
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition) if partition else df.write
        writer.parquet(path)
        self._point(table, self._pointer(table) | {"pending": path})

    def promote(self, table: str) -> int:
        s = self._pointer(table)
        if s["pending"] is None:
            raise ValueError(f"nothing staged for {table}")
        self._point(table, {"version": s["version"] + 1, "current": s["pending"], "pending": None})
        return s["version"] + 1

    def promote_together(self, tables: Sequence[str]) -> None:
        """Make the staged snapshots of all ``tables`` current at once, by one rename."""
        states = {t: self._pointer(t) for t in tables}
        if lacking := [t for t, s in states.items() if s["pending"] is None]:
            raise ValueError(f"nothing staged for {lacking}")
        new = {t: {"version": s["version"] + 1, "current": s["pending"], "pending": None} for t, s in states.items()}
        self._save(self.root, "_together.json", (self._load(f"{self.root}/_together.json") or {}) | new)
        for t, s in new.items():  # a crash from here on leaves older pointers, which the joint one overrules
            self._point(t, s)

    def discard(self, table: str) -> None:
        self._point(table, self._pointer(table) | {"pending": None})

    def write(self, table: str, df: DataFrame, partition: Sequence[str] = ()) -> int:
        self.stage(table, df, partition)
        return self.promote(table)

    def vacuum(self, table: str) -> int:
        """Delete snapshots that are neither current nor pending, once no reader uses them; how many went."""
        state = self._pointer(table)
        fs, folder = self._fs(f"{self.root}/{table}")
        keep = {x.rsplit("/", 1)[1] for x in (state["current"], state["pending"]) if x}
        old = [f.getPath() for f in fs.listStatus(folder) if f.isDirectory() and f.getPath().getName() not in keep]
        for p in old:
            fs.delete(p, True)
        return len(old)

    def version(self, table: str) -> int:
        return self._pointer(table)["version"]


# changes as expressions over tables


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: Column | None = None) -> DataFrame:
    """Rows by key from ``new``, else from ``old``; of several new rows the one that is first by ``newest``, descending."""
    order = F.desc(newest) if newest is not None else F.lit(0)
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *[F.col(c) for c in new.columns if c not in keys]))).filter("__n = 1").drop("__n")
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key isn't there; on conflict nothing happens."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return old.unionByName(fresh, allowMissingColumns=True)


def delete_rows(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def delete_document(chunks: DataFrame, documents: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, documents, one row with the number of chunks deleted); entities stay."""
    mine = F.col("document_name") == name
    return chunks.filter(~mine), documents.filter(~mine), chunks.filter(mine).agg(F.count(F.lit(1)).alias("deleted"))


def document_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sync_actions(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """(document_name, action, content_hash): added, updated, skipped, or missing from the incoming set.

    ``incoming`` has document_name and content or content_hash; rows with neither are an error of
    the caller and get the action ``invalid``.
    """
    given = F.col("content_hash") if "content_hash" in incoming.columns else F.lit(None).cast("string")
    raw = document_hash(F.col("content")) if "content" in incoming.columns else F.lit(None).cast("string")
    new = incoming.select("document_name", F.coalesce(given, raw).alias("new_hash"), F.lit(True).alias("here"))
    old = registry.select("document_name", F.col("content_hash").alias("old_hash"))
    action = (
        F.when(F.col("here").isNull(), "missing")
        .when(F.col("new_hash").isNull(), "invalid")
        .when(F.col("old_hash").isNull(), "added")
        .when(F.col("old_hash") == F.col("new_hash"), "skipped")
        .otherwise("updated")
    )
    return new.join(old, "document_name", "full").select("document_name", action.alias("action"), F.coalesce("new_hash", "old_hash").alias("content_hash"))


def sync(chunks: DataFrame, registry: DataFrame, incoming: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(chunks, registry) after the added and updated documents are chunked anew."""
    todo = sync_actions(registry, incoming).filter(F.col("action").isin("added", "updated"))
    made = chunker(incoming.join(todo.select("document_name"), "document_name", "left_semi"))
    kept = delete_rows(chunks, todo, ["document_name"])
    count = made.groupBy("document_name").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    rows = todo.join(count, "document_name", "left").select("document_name", "content_hash", F.lit(None).cast("string").alias("source_uri"), F.current_timestamp().alias("indexed_at"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return kept.unionByName(made, allowMissingColumns=True), upsert(registry, rows, ["document_name"])


# domains and namespaces


def domain_closure(domains: DataFrame, roots: DataFrame, include_global: bool = True) -> DataFrame:
    """(domain_id) of the roots, all below them by parent_id, and by default all of the namespace ``global``.

    A recursive query; a cycle ends because a domain counts once at its first level.
    """
    name = uuid.uuid4().hex
    d, r = f"domains_{name}", f"roots_{name}"
    domains.createOrReplaceTempView(d)
    roots.createOrReplaceTempView(r)
    found = domains.sparkSession.sql(
        f"""WITH RECURSIVE tree(domain_id, depth) AS (
              SELECT d.domain_id, 0 FROM {d} d JOIN {r} r ON d.domain_id = r.domain_id
              UNION ALL
              SELECT d.domain_id, t.depth + 1 FROM {d} d JOIN tree t ON d.parent_id = t.domain_id WHERE t.depth < 64)
            SELECT DISTINCT domain_id FROM tree"""
    )
    if include_global and "namespace" in domains.columns:
        found = found.union(domains.filter(F.col("namespace") == "global").select("domain_id")).distinct()
    return found


def session_chunks(chunks: DataFrame, closure: DataFrame, namespace: str | None) -> DataFrame:
    """Chunks that a session of active domains sees."""
    own = chunks if namespace is None else chunks.filter(F.col("namespace").isin(namespace, "global"))
    return own.join(closure, "domain_id", "left_semi")


def delete_domains(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Chunks of the domains and all that hangs on them, from embeddings, chunk_entities and svo_triples."""
    lost = tables["embeddings"].join(gone.select("domain_id"), "domain_id", "left_semi").select("chunk_id")
    out = dict(tables)
    out["embeddings"] = delete_rows(tables["embeddings"], gone, ["domain_id"])
    if "chunk_entities" in tables:
        out["chunk_entities"] = delete_rows(tables["chunk_entities"], lost, ["chunk_id"])
    if "svo_triples" in tables:
        out["svo_triples"] = delete_rows(tables["svo_triples"], lost.withColumnRenamed("chunk_id", "source_chunk_id"), ["source_chunk_id"])
    if "domains" in tables:
        out["domains"] = delete_rows(tables["domains"], gone, ["domain_id"])
    return out


def union_global(local: DataFrame, shared: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Local and global rows as one view with ``origin``; with keys a local row hides a global one."""
    other = shared if keys is None else delete_rows(shared, local, keys)
    return local.withColumn("origin", F.lit("local")).unionByName(other.withColumn("origin", F.lit("global")), allowMissingColumns=True)


def promote_domain(source: dict[str, DataFrame], target: dict[str, DataFrame], domain: str, namespace: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Move a domain's chunks, associations and triples to another store under a namespace."""
    mine = F.col("domain_id") == domain
    ids = source["embeddings"].filter(mine).select("chunk_id")
    moved = {"embeddings": source["embeddings"].filter(mine)}
    for name, key in (("chunk_entities", "chunk_id"), ("svo_triples", "source_chunk_id")):
        if name in source:
            moved[name] = source[name].join(ids.withColumnRenamed("chunk_id", key), key, "left_semi")
    after = {n: t.unionByName(moved[n].withColumn("namespace", F.lit(namespace)), allowMissingColumns=True) if n in moved else t for n, t in target.items()}
    one = source["embeddings"].sparkSession.createDataFrame([(domain,)], "domain_id string")
    return delete_domains(source, one), after


def cache_valid(sources: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(namespace, valid): all sources crawled, no file changed after its crawl, and some chunks.

    sources: namespace, source_id, last_crawled; files: source_id, modificationTime; chunks: namespace.
    """
    newest = files.groupBy("source_id").agg(F.max("modificationTime").alias("changed"))
    ok = F.col("last_crawled").isNotNull() & (F.col("changed").isNull() | (F.col("changed") <= F.col("last_crawled")))
    good = sources.join(newest, "source_id", "left").groupBy("namespace").agg(F.min(F.when(ok, 1).otherwise(0)).alias("ok"))
    n = chunks.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    return good.join(n, "namespace", "left").select("namespace", ((F.col("ok") == 1) & (F.coalesce("n", F.lit(0)) > 0)).alias("valid"))


def fingerprint(ids: DataFrame, col: str = "chunk_id") -> DataFrame:
    """One row: the number of ids, and an order-free hash of them, for cache checks at any size."""
    d = ids.select(F.col(col).cast("string").alias("i")).distinct()
    return d.agg(F.count(F.lit(1)).alias("n"), F.hex(F.bit_xor(F.xxhash64("i"))).alias("fingerprint"))


def split_breadcrumbs(chunks: DataFrame) -> DataFrame:
    """Move a leading ``[...]`` of the content to the breadcrumb where there is none yet."""
    head = F.regexp_extract("content", r"^(\[[^\]]+\])", 1)
    move = F.col("breadcrumb").isNull() & (head != "")
    return chunks.withColumns({"breadcrumb": F.when(move, head).otherwise(F.col("breadcrumb")), "content": F.when(move, F.regexp_replace("content", r"^\[[^\]]+\]\s*", "")).otherwise(F.col("content"))})


def orphans(catalogue: DataFrame, remote: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Catalogue rows that the remote store no longer has."""
    return catalogue.join(remote.select(key), key, "left_anti")


def mark_crawled(sources: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("source_id").distinct().withColumn("__hit", F.lit(True))
    return sources.join(hit, "source_id", "left").withColumn("last_crawled", F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("last_crawled"))).drop("__hit")


def chunk_with_neighbours(chunks: DataFrame, wanted: DataFrame, radius: int = 1) -> DataFrame:
    """The chunks (chunk_id) asked for and those up to ``radius`` places away in the document, with ``asked``."""
    at = chunks.join(wanted.select("chunk_id"), "chunk_id").select(F.col("document_name").alias("d"), F.col("chunk_index").alias("i"), F.col("chunk_id").alias("asked"))
    spots = at.select("d", "asked", F.explode(F.sequence(F.col("i") - radius, F.col("i") + radius)).alias("p"))
    return spots.join(chunks, (F.col("d") == F.col("document_name")) & (F.col("p") == F.col("chunk_index"))).drop("d", "p")
