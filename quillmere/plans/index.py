"""An index as a whole: sources in, chunks and graph tables as snapshots, searches and answers out.

``build`` runs a configuration; ``Index`` changes what is there.  Every step is a job over
tables; models (vectors, recognisers, language models) are injected functions.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.embed import Embed, embedded, heading_vectors
from ..operators import chunking, clusters, entities, graph, retrieval, store
from ..operators.tables import stored
from ..sources import extract, loaders

SOURCES: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def source(name: str):
    """Register a kind of source: (spark, its settings) -> (document_name, content[, error])."""

    def add(f):
        SOURCES[name] = f
        return f

    return add


@source("directory")
@source("glob")
def _files(spark: SparkSession, s: dict) -> DataFrame:
    files = extract.read_files(spark, s["path"], s.get("glob")) if s.get("glob") else loaders.crawl_folder(spark, s["path"], s.get("extensions", ()), s.get("exclude", ()), s.get("max_files"))
    done = extract.extract_documents(files, s.get("kind"), s.get("options"))
    return done.select(F.col("path").alias("document_name"), F.col("text").alias("content"), "error")


@source("sql")
def _sql(spark: SparkSession, s: dict) -> DataFrame:
    """Row mode with both columns named, else the whole result as one table."""
    df = spark.sql(s["query"])
    if "name_col" in s and "content_col" in s:
        return df.select(F.col(s["name_col"]).cast("string").alias("document_name"), F.col(s["content_col"]).cast("string").alias("content"))
    return loaders.markdown_table(df, s["name"], s.get("order", ())).filter("content <> ''")


@source("json_array")
def _json(spark: SparkSession, s: dict) -> DataFrame:
    rows = spark.read.option("multiLine", True).json(s["path"])
    return rows.select(F.col(s["name_col"]).cast("string").alias("document_name"), F.col(s["content_col"]).cast("string").alias("content"))


@source("pages")
def _pages(spark: SparkSession, s: dict) -> DataFrame:
    """Pages of a parquet table (url, html) that a crawl from the roots reaches."""
    pages = spark.read.parquet(s["path"]).select("url", "html")
    roots = spark.createDataFrame([(u,) for u in s["roots"]], "url string")
    reached = loaders.crawl(pages, roots, s.get("max_depth", 3), s.get("max_pages"), include=s.get("include"), exclude=s.get("exclude", ()))
    known = pages.withColumn("at", loaders.X.normalize_url(F.col("url"))).join(reached.select(F.col("url").alias("at")), "at", "left_semi")
    return extract.html_documents(known, "at", "html").select(F.col("at").alias("document_name"), F.col("markdown").alias("content"))


@source("table")
def _table(spark: SparkSession, s: dict) -> DataFrame:
    return spark.read.parquet(s["path"]).select(F.col(s["name_col"]).cast("string").alias("document_name"), F.col(s["content_col"]).cast("string").alias("content"))


def route(question: str, described: Mapping[str, str], llm: Callable[[str], str]) -> list[str] | None:
    """Namespaces or domains (id -> description) that a model picks for a question; None for no restriction.

    Nothing is asked for fewer than two; ids it makes up are dropped; an answer that isn't a JSON list restricts nothing.
    """
    known = {k: d for k, d in described.items() if d}
    if len(known) < 2:
        return None
    listed = "\n".join(f"{k}: {d}" for k, d in sorted(known.items()))
    said = llm(f"Collections:\n{listed}\nQuestion: {question}\nAnswer with a JSON list of the ids to search.")
    try:
        picked = json.loads(re.sub(r"^\s*```\w*|```\s*$", "", said or ""))
    except ValueError:
        return None
    chosen = [k for k in picked if isinstance(k, str) and k in known] if isinstance(picked, list) else []
    return chosen or None


def decompose(question: str, llm: Callable[[str], str], most: int = 4) -> list[str]:
    """The question and up to ``most`` simpler ones that a model finds in it; the question alone if the answer isn't a JSON list."""
    said = llm(f"Question: {question}\nAnswer with a JSON list of at most {most} simpler questions whose answers together answer it.")
    try:
        parts = json.loads(re.sub(r"^\s*```\w*|```\s*$", "", said or ""))
    except ValueError:
        parts = []
    found = [p.strip() for p in parts if isinstance(p, str) and p.strip()] if isinstance(parts, list) else []
    return list(dict.fromkeys([question, *found[:most]]))


def merged(hits: Sequence[DataFrame], k: int) -> DataFrame:
    """The best k of several stores' hits (query_id, chunk_id, score), with the store's number; scores are compared as they are."""
    out = None
    for i, d in enumerate(hits):
        part = d.drop("rank").withColumn("store", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "store", "chunk_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


@dataclass
class Structured:
    """An answer with the claims made and the evidence named."""

    answer: str
    claims: list[str] = field(default_factory=list)
    evidence: list[str] = field(default_factory=list)


def structured(prompt: str, llm: Callable[[str], str]) -> Structured:
    """Ask for JSON with answer, claims and evidence; one more try on another form, then the text as it is."""
    said, ask = "", f"{prompt}\n\nAnswer as JSON with the keys answer, claims and evidence."
    for _ in range(2):
        said = llm(ask)
        found = re.search(r"\{.*\}", said or "", re.S)
        try:
            got = json.loads(found[0]) if found else None
        except ValueError:
            got = None
        if isinstance(got, dict) and isinstance(got.get("answer"), str):
            listed = lambda key: [str(x) for x in got.get(key) or () if x]  # noqa: E731, B023
            return Structured(got["answer"], listed("claims"), listed("evidence"))
        ask = f"{prompt}\n\nYour last answer wasn't valid JSON. Give only a JSON object with the keys answer, claims and evidence."
    return Structured(said)


def gaps(claims: DataFrame, chunks: DataFrame, least: float = 0.35) -> DataFrame:
    """(claim_id, chunk_id, score): for each claim (claim_id, embedding) the nearest chunk that is at least so close, for a second try."""
    near = retrieval.batch_vector_search(chunks, claims.select(F.col("claim_id").alias("query_id"), F.col("embedding").alias("query")), 1)
    return near.filter(F.col("score") >= least).select(F.col("query_id").alias("claim_id"), F.col("id").alias("chunk_id"), "score")


@dataclass
class Answer:
    text: str
    prompt: str
    citations: list[str]


@dataclass
class Index:
    """Search and change a store of snapshots.  ``defaults`` are arguments of every search."""

    snapshots: store.Snapshots
    embed: Embed
    options: chunking.Options = chunking.Options()
    defaults: dict = field(default_factory=dict)
    chunk_filter: Callable[[DataFrame], DataFrame] | None = None
    redact: Callable[[str], str] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.snapshots.spark

    def add(self, docs: DataFrame, namespace: str = "global", domain: str | None = None) -> dict[str, int]:
        """Chunk and embed what is new or changed in (document_name, content); the counts by action."""
        docs = docs.select("document_name", "content").filter("document_name IS NOT NULL AND content IS NOT NULL").groupBy("document_name").agg(F.max("content").alias("content"))
        chunks, registry = self.snapshots.read("embeddings"), self.snapshots.read("documents")
        counts = {r["action"]: r["count"] for r in store.sync_actions(registry, docs).filter("action <> 'missing'").groupBy("action").count().collect()}
        if not counts.keys() & {"added", "updated"}:
            return counts

        def chunker(d: DataFrame) -> DataFrame:
            made = embedded(loaders.load_texts(d, "document_name", "content", self.options), "embedding_content", self.embed)
            return made.withColumns({"namespace": F.lit(namespace), "domain_id": F.lit(domain).cast("string"), "chunk_type": F.lit("document")})

        changed = store.sync_actions(registry, docs).filter("action = 'updated'")
        self._replace(*store.sync(chunks, registry, docs, chunker), changed)
        return counts

    def _replace(self, chunks: DataFrame, registry: DataFrame, gone: DataFrame) -> None:
        """New chunks and registry, and without what hung on the old chunks of the documents ``gone`` (document_name), all at once."""
        lost = self.snapshots.read("embeddings").join(gone.select("document_name"), "document_name", "left_semi").select("chunk_id")
        self.snapshots.stage("chunk_entities", entities.remove_chunks(self.snapshots.read("chunk_entities"), lost))
        self.snapshots.stage("embeddings", chunks)
        self.snapshots.stage("documents", registry)
        self.snapshots.promote_together(("embeddings", "documents", "chunk_entities"))

    def add_source(self, settings: dict) -> dict[str, int]:
        """Index a source; documents that can't be read are counted as ``failed`` and skipped."""
        if settings.get("type") not in SOURCES:
            raise ValueError(f"no such source type: {settings.get('type')!r}")
        docs = SOURCES[settings["type"]](self.spark, settings)
        failed = docs.filter("error IS NOT NULL").count() if "error" in docs.columns else 0
        return self.add(docs, settings.get("namespace", "global"), settings.get("domain")) | ({"failed": failed} if failed else {})

    def remove(self, documents: Sequence[str]) -> int:
        """Delete documents; the number of chunks that went."""
        gone = self.spark.createDataFrame([(d,) for d in documents], "document_name string")
        chunks = self.snapshots.read("embeddings")
        n = chunks.join(gone, "document_name", "left_semi").count()
        self._replace(store.delete_rows(chunks, gone, ["document_name"]), store.delete_rows(self.snapshots.read("documents"), gone, ["document_name"]), gone)
        return n

    def remove_domain(self, domain: str) -> None:
        """Delete a domain's chunks and what hangs on them."""
        gone = self.spark.createDataFrame([(domain,)], "domain_id string")
        names = ("embeddings", "chunk_entities", "svo_triples", "domains")
        after = store.delete_domains({n: self.snapshots.read(n) for n in names}, gone)
        for n in names:
            self.snapshots.stage(n, after[n])
        self.snapshots.promote_together(names)

    def rebuild(self, matcher: entities.Matcher, levels: Sequence[float] = (0.25, 0.7, 2.0), threshold: float = 0.6, triples: DataFrame | None = None, algorithm: str = "louvain", heading_weight: float = 0.2, force: bool = False) -> bool:
        """Entities, entity clusters, communities and the context graph from the current chunks; whether there was anything to do.

        Only chunks that the same matcher hasn't seen yet are matched; scores, which hang on the whole corpus, are counted anew.
        Nothing is done while matcher, settings, chunks and triples are those of the last time, unless forced.
        """
        chunks = self.snapshots.read("embeddings")
        told = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()[:16]
        log = self.snapshots.read("namespace_build_log")
        done = {r["stage"] for r in log.select("stage").collect()}
        mine = f"entities {told([sorted(matcher.surfaces.items()), matcher.fold, matcher.distinct_spans])}"
        content = store.fingerprint(chunks.select(F.concat_ws(":", "chunk_id", F.sha2("content", 256)).alias("chunk_id"))).first()
        given = None if triples is None else list(store.fingerprint(triples.select(F.concat_ws(":", "subject_id", "verb", "object_id").alias("chunk_id"))).first())
        whole = f"graph {mine} {told([list(levels), threshold, algorithm, heading_weight, given])} {content['n']} {content['fingerprint']}"
        if whole in done and not force:
            return False
        n = chunks.agg(F.count(F.lit(1)).alias("n"))
        old = self.snapshots.read("chunk_entities")
        names = ["chunk_id", "entity_id", "frequency", "positions", "chunk_length"]
        kept = (old.join(chunks.select("chunk_id"), "chunk_id", "left_semi") if mine in done and not force else old.filter("false")).select(*names)
        fresh = entities.match_entities(entities.unprocessed(chunks, kept), matcher).select(*names)
        found = entities.score_associations(kept.unionByName(fresh), n)
        self.snapshots.write("chunk_entities", found.select("chunk_id", "entity_id", "frequency", "positions", "score", "chunk_length"))
        links = self.snapshots.read("chunk_entities")
        scores = stored(clusters.cooccurrence(links, n, "pmi"), "scores")
        self.snapshots.write("entity_clusters", clusters.cluster_entities(links.select("entity_id").distinct(), scores))
        headed = heading_vectors(chunks.filter("embedding IS NOT NULL").select("chunk_id", "breadcrumb", "embedding"), "breadcrumb", self.embed)
        vectors = stored(headed.select("chunk_id", clusters.working_vector(F.col("embedding"), F.col("heading"), heading_weight).alias("embedding")), "vectors")
        bridges = clusters.bridge_stars if algorithm == "components" else clusters.bridge_edges
        edges = clusters.similarity_edges(vectors, threshold).unionByName(bridges(links, chunks)).groupBy("a", "b").agg(F.max("weight").alias("weight"))
        a, b = clusters.community_levels(vectors, chunks.select("chunk_id", "content"), stored(edges, "edges"), levels, algorithm)
        self.snapshots.write("chunk_communities", a)
        self.snapshots.write("communities", b)
        self.snapshots.write("chunk_clusters", graph.chunk_clusters(links))
        known = triples if triples is not None else self.snapshots.read("svo_triples")
        self.snapshots.write("svo_triples", known)
        self.snapshots.write("context_graph_edges", graph.context_edges(links, self.snapshots.read("chunk_clusters"), self.snapshots.read("svo_triples")))
        rows = self.spark.createDataFrame([("*", x) for x in (mine, whole)], "namespace_id string, stage string").withColumn("built_at", F.current_timestamp())
        self.snapshots.write("namespace_build_log", rows)
        return True

    def search(self, queries: Sequence[str] | DataFrame, k: int = 10, mode: str | None = None, namespaces: Sequence[str] | None = None, domains: Sequence[str] | None = None, matcher: entities.Matcher | None = None, **how) -> DataFrame:
        """(query_id, chunk_id, provenance, score, rank, document_name, content, breadcrumb) for texts or a table (query_id, text).

        The contents show their breadcrumbs.  A ``matcher`` finds the queries' entities, for graph_first and for
        ``complete``; entity vectors are those of the rows of type ``entity``, if the store has any.
        """
        how = self.defaults | how
        asked = queries if isinstance(queries, DataFrame) else self.spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
        asked = stored(embedded(asked.select("query_id", "text"), "text", self.embed, "query"), "queries")
        whole = self.snapshots.read("embeddings")
        rows = whole.filter(retrieval.filters(namespaces, None, domains))
        chunks = rows.filter("chunk_type IS NULL OR chunk_type <> 'entity'")
        links = self.snapshots.read("chunk_entities").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        near = clusters.neighbours(self.snapshots.read("entity_clusters"))
        if matcher is not None and "query_entities" not in how:
            found = entities.match_entities(asked, matcher, "query_id", "text").select(F.col("chunk_id").cast(asked.schema["query_id"].dataType).alias("query_id"), "entity_id", F.col("display_name").alias("entity"))
            how["query_entities"] = stored(found, "entities")
        if mode == "graph_first":
            how.setdefault("triples", self.snapshots.read("svo_triples"))
        named = rows.filter("chunk_type = 'entity'").select(F.expr("substring(chunk_id, length('__entity__') + 1)").alias("entity_id"), "embedding")
        if "entity_vectors" not in how and not named.isEmpty():
            how["entity_vectors"] = named
        hits = retrieval.search(chunks, asked, k, mode or "vector_first", associations=links, neighbours=near, chunk_filter=self.chunk_filter, **how)
        return retrieval.with_breadcrumbs(hits.join(chunks.select("chunk_id", "document_name", "content", "breadcrumb"), "chunk_id"))

    def ask(self, question: str, llm: Callable[[str], str], k: int = 10, budget: int = 4096, level: int = 0, least: float = 0.0, **how) -> Answer:
        """An answer of the injected model from the chunks that fit the budget, under the topics of the communities they belong to."""
        hits = self.search([question], k, **how).withColumnRenamed("rank", "position")
        if self.redact is not None:
            redact = F.udf(self.redact, "string")  # a caller's row function, on at most k rows
            hits = hits.withColumn("content", redact("content"))
        hits = stored(hits, "hits")
        topics = retrieval.community_context(hits, self.snapshots.read("chunk_communities"), self.snapshots.read("communities"), level, least=least)
        asked = stored(self.spark.createDataFrame([(0, question)], "query_id int, text string").join(topics, "query_id", "left"), "asked")
        prompt = retrieval.build_prompts(hits, asked, budget).first()["prompt"]
        head = asked.select(F.concat_ws("\n", F.concat(F.lit("Context: "), F.nullif("community_context", F.lit(""))), F.concat(F.lit("Query: "), "text")).alias("h")).first()["h"]
        used = retrieval.prompt_budget(hits, budget, retrieval.est_tokens(F.lit(head))).orderBy("tier", "position")
        return Answer(llm(prompt), prompt, [r["chunk_id"] for r in used.select("chunk_id").collect()])

    def answer_by_communities(self, question: str, llm: Callable[[str, str], tuple[float, str]], level: int = 0, most: int = 20) -> list[str]:
        """Answers from the summaries of communities, each scored by the model, best first (the global way, map and reduce)."""
        asked = stored(embedded(self.spark.createDataFrame([(0, question)], "query_id int, text string"), "text", self.embed, "query"), "queries")
        rows = self.snapshots.read("embeddings").filter("chunk_type = 'community_summary'")
        near = retrieval.batch_vector_search(rows, asked, most).select("query_id", F.col("id").alias("report_id"))
        reports = near.join(rows.select(F.col("chunk_id").alias("report_id"), "content"), "report_id").join(asked.select("query_id", "text"), "query_id")
        return [r["answer"] for r in retrieval.map_reduce_answers(reports, llm).collect()]


@dataclass
class Indexer:
    """Indexing of several sources that reports its progress and can be stopped between sources; what is indexed stays.

    on_progress gets (phase, done, total), on_error (phase, exception) of a source that failed and is skipped, on_complete or
    on_abort the number of documents added or updated.
    """

    index: Index
    on_progress: Callable[[str, int, int], None] = lambda *_: None
    on_complete: Callable[[int], None] = lambda *_: None
    on_error: Callable[[str, Exception], None] = lambda *_: None
    on_abort: Callable[[int], None] = lambda *_: None
    stop: threading.Event = field(default_factory=threading.Event)

    def abort(self) -> None:
        self.stop.set()

    def run(self, sources: Sequence[dict], rebuild: Callable[[Index], object] | None = None) -> int:
        """Index the sources in turn, then rebuild: dispatching, draining and building in one job."""
        n = 0
        for i, s in enumerate(sources):
            if self.stop.is_set():
                self.on_abort(n)
                return n
            self.on_progress("source", i, len(sources))
            try:
                counts = self.index.add_source(s)
                n += counts.get("added", 0) + counts.get("updated", 0)
                if counts.get("failed"):
                    self.on_error("extract", ValueError(f"{counts['failed']} documents of source {i} can't be read"))
            except Exception as e:  # one source that fails doesn't end the others
                self.on_error("source", e)
        self.on_progress("source", len(sources), len(sources))
        if rebuild is not None and not self.stop.is_set():
            try:
                rebuild(self.index)
                self.on_progress("rebuild", 1, 1)
            except Exception as e:
                self.on_error("rebuild", e)
        (self.on_abort if self.stop.is_set() else self.on_complete)(n)
        return n

    def start(self, sources: Sequence[dict], rebuild: Callable[[Index], object] | None = None) -> threading.Thread:
        """``run`` in a thread of its own, with the caller's Spark settings; readers see the old snapshots until it is done."""
        self.stop.clear()
        thread = InheritableThread(target=self.run, args=(sources, rebuild), daemon=True)
        thread.start()
        return thread


def build(spark: SparkSession, config: dict, embed: Embed, matcher: entities.Matcher | None = None) -> Index:
    """Index all sources of a configuration (store, sources, chunking, search) and rebuild its graph tables."""
    options = chunking.Options(**config.get("chunking", {}))
    index = Index(store.Snapshots(spark, config["store"]), embed, options, dict(config.get("search", {})))
    for s in config.get("sources", ()):
        index.add_source(s)
    if matcher is not None:
        index.rebuild(matcher, **config.get("index", {}))
    return index
