"""Discovery and loading: folders, page tables, imports, schemas, APIs, queries and record files."""

from __future__ import annotations

import io
import json
import os
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from ..operators import chunking
from . import extract


@dataclass
class Column:
    name: str
    data_type: str
    nullable: bool = True
    is_foreign_key: bool = False
    is_primary_key: bool = False
    foreign_key_ref: str | None = None
    description: str | None = None


@dataclass
class Table:
    name: str
    schema_name: str | None = None
    description: str | None = None
    columns: list[Column] = field(default_factory=list)
    row_count: int | None = None
    source_db: str | None = None


TABLES = "name string, schema_name string, description string, columns array<struct<name:string,data_type:string,description:string,nullable:boolean,is_primary_key:boolean,is_foreign_key:boolean,foreign_key_ref:string>>, row_count long, source_db string"
ENDPOINTS = "path string, method string, description string, fields array<struct<name:string,field_type:string,description:string,required:boolean>>, endpoint_type string, source_api string"


def tables_frame(spark: SparkSession, tables: Sequence[Table]) -> DataFrame:
    order = "name data_type description nullable is_primary_key is_foreign_key foreign_key_ref".split()
    rows = [(t.name, t.schema_name, t.description, [tuple(getattr(c, f) for f in order) for c in t.columns], t.row_count, t.source_db) for t in tables]
    return spark.createDataFrame(rows, TABLES)


def _lines(*pairs) -> object:
    """Lines ``label: value``; a null value leaves its line out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])


def _chunk(doc, content, section, index, kind) -> list:
    return [doc.alias("document_name"), content.alias("content"), section.cast("array<string>").alias("section"), index.cast("int").alias("chunk_index"), kind.alias("chunk_type")]


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding_content", X.enriched(F.col("content"), F.lit(None).cast("string"), F.col("document_name"), F.col("section")))


def _some(c) -> object:
    return F.nullif(c, F.lit(""))


def schema_chunks(tables: DataFrame) -> DataFrame:
    """A chunk for each table and one for each of its columns."""
    doc = F.concat(F.lit("schema:"), F.coalesce(_some(F.col("source_db")), F.lit("db")), F.lit("."), F.col("name"))
    names = F.when(F.size("columns") > 0, F.array_join(F.transform("columns", lambda c: c["name"]), ", "))
    head = _lines(("Table", F.col("name")), ("Schema", _some(F.col("schema_name"))), ("Source DB", _some(F.col("source_db"))), ("Row count", F.col("row_count").cast("string")), ("Description", _some(F.col("description"))), ("Columns", names))
    top = tables.select(*_chunk(doc, head, F.array(F.lit("table_description")), F.lit(0), F.lit("db_table")))
    c = tables.select(doc.alias("doc"), F.col("name").alias("t"), F.posexplode("columns").alias("i", "c"))
    yes = lambda x: F.when(x, "yes").otherwise("no")
    body = _lines(
        ("Column", F.col("c.name")), ("Table", F.col("t")), ("Type", F.col("c.data_type")), ("Nullable", yes(F.col("c.nullable"))),
        ("Primary key", F.when(F.col("c.is_primary_key"), "yes")), ("Foreign key", F.when(F.col("c.is_foreign_key"), _some(F.col("c.foreign_key_ref")))),
        ("Description", _some(F.col("c.description"))),
    )
    cols = c.select(*_chunk(F.concat("doc", F.lit("."), F.col("c.name")), body, F.array(F.lit("column_description")), F.col("i") + 1, F.lit("db_column")))
    return _finish(top.union(cols))


def api_chunks(endpoints: DataFrame) -> DataFrame:
    """A chunk for each endpoint and one for each of its fields."""
    doc = F.concat(F.lit("api:"), F.coalesce(_some(F.col("source_api")), F.lit("api")), F.lit("."), F.col("path"))
    kind = F.when(F.col("endpoint_type").isin("graphql_type", "graphql_query", "graphql_mutation"), F.concat(F.lit("api_"), "endpoint_type")).otherwise("api_endpoint")
    names = F.when(F.size("fields") > 0, F.array_join(F.transform("fields", lambda f: f["name"]), ", "))
    head = _lines(("Endpoint", F.col("path")), ("Method", _some(F.col("method"))), ("Type", F.col("endpoint_type")), ("Source API", _some(F.col("source_api"))), ("Description", _some(F.col("description"))), ("Fields", names))
    none = F.array()
    top = endpoints.select(*_chunk(doc, head, none, F.lit(0), kind))
    f = endpoints.select(doc.alias("doc"), "path", F.posexplode("fields").alias("i", "f"))
    body = _lines(("Field", F.col("f.name")), ("Endpoint", F.col("path")), ("Type", F.col("f.field_type")), ("Required", F.when(F.col("f.required"), "yes").otherwise("no")), ("Description", _some(F.col("f.description"))))
    return _finish(top.union(f.select(*_chunk(F.concat("doc", F.lit("."), F.col("f.name")), body, none, F.col("i") + 1, F.lit("api_field")))))


# schema of structured files

STRUCTURED = ("arrow", "csv", "feather", "json", "jsonl", "ndjson", "parquet")


def python_type(v) -> str:
    kinds = ((bool, "BOOLEAN"), (int, "INTEGER"), (float, "FLOAT"), ((dict, list), "JSON"))
    return next((n for t, n in kinds if isinstance(v, t)), "TEXT")


def arrow_type(t) -> str:
    from pyarrow import types as p

    tests = (
        ("INTEGER", p.is_integer), ("FLOAT", p.is_floating), ("BOOLEAN", p.is_boolean), ("TIMESTAMP", p.is_temporal), ("TEXT", p.is_string), ("TEXT", p.is_large_string),
        ("BINARY", p.is_binary), ("BINARY", p.is_large_binary), ("LIST", p.is_list), ("LIST", p.is_large_list), ("STRUCT", p.is_struct),
    )
    return next((n for n, test in tests if test(t)), str(t))


def _keys(objects) -> list[Column]:
    seen: dict[str, str] = {}
    for o in objects:
        for k, v in o.items() if isinstance(o, dict) else ():
            seen.setdefault(k, python_type(v))
    return [Column(k, v) for k, v in seen.items()]


def infer_table(data: bytes, path: str, name: str | None = None, sample: int = 100) -> Table:
    """Columns and row count of a structured file; types are from the first ``sample`` rows, as inference sees them."""
    stem, ext = os.path.splitext(os.path.basename(path))
    name, ext = name or stem, ext.lower().lstrip(".")
    if ext not in STRUCTURED:
        raise ValueError(f"no structured file: {path!r}")
    if ext == "csv":
        head = pd.read_csv(io.BytesIO(data), nrows=sample)
        kinds = {"i": "INTEGER", "f": "FLOAT", "b": "BOOLEAN", "M": "TIMESTAMP"}
        rows = data.count(b"\n") + (not data.endswith(b"\n") and bool(data)) - 1
        return Table(name, columns=[Column(c, kinds.get(getattr(head[c].dtype, "kind", "O"), "TEXT")) for c in head.columns], row_count=max(rows, 0))
    if ext == "json":
        try:
            obj = json.loads(data)
        except json.JSONDecodeError as e:
            raise ValueError(f"not JSON: {name}") from e
        if isinstance(obj, list):
            return Table(name, columns=_keys(obj[:sample]), row_count=len(obj))
        return Table(name, columns=_keys([obj])[:sample], row_count=1) if isinstance(obj, dict) else Table(name)
    if ext in ("jsonl", "ndjson"):
        parsed, total = [], 0
        for line in filter(None, map(bytes.strip, data.split(b"\n"))):
            total += 1
            if len(parsed) < sample:
                try:
                    parsed.append(json.loads(line))
                except json.JSONDecodeError:
                    pass
        if total and not parsed:
            raise ValueError(f"no line of {name} is JSON")
        return Table(name, columns=_keys(parsed), row_count=total)
    import pyarrow as pa
    from pyarrow import feather, ipc, parquet

    source = pa.BufferReader(data)
    if ext == "arrow":
        schema, n = ipc.open_stream(source).schema, None
    elif ext == "feather":
        t = feather.read_table(source)
        schema, n = t.schema, t.num_rows
    else:
        f = parquet.ParquetFile(source)
        schema, n = f.schema_arrow, f.metadata.num_rows
    return Table(name, columns=[Column(f.name, arrow_type(f.type)) for f in schema], row_count=n)


SPARK_TYPES = (("INTEGER", ("tinyint", "smallint", "int", "bigint")), ("FLOAT", ("float", "double")), ("BOOLEAN", ("boolean",)), ("TIMESTAMP", ("date", "timestamp", "timestamp_ntz")), ("TEXT", ("string",)), ("BINARY", ("binary",)))


def table_of(df: DataFrame, name: str, row_count: int | None = None, source_db: str | None = None) -> Table:
    """Schema record of a DataFrame, for sources that Spark reads itself."""
    def label(t) -> str:
        s = t.simpleString()
        nested = "LIST" if s.startswith("array") else "STRUCT" if s.startswith("struct") else s
        return next((n for n, ks in SPARK_TYPES if s in ks), nested)

    return Table(name, columns=[Column(f.name, label(f.dataType), nullable=f.nullable) for f in df.schema.fields], row_count=row_count, source_db=source_db)


def load_structured_file(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    row = extract.read_files(spark, path).select("content").first()
    return schema_chunks(tables_frame(spark, [infer_table(bytes(row[0]), path, name)]))


# union schema of record collections

_KINDS = {"NoneType": "null", "bool": "boolean", "int": "integer", "float": "number", "str": "string", "list": "array", "dict": "object"}


def record_paths(df: DataFrame, json_col: str) -> DataFrame:
    """(path, kind, item, n, documents): value kinds at each path over all records, one pass and one shuffle of counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def visit(node: dict, prefix: str) -> None:
            for k, v in node.items():
                p = f"{prefix}.{k}" if prefix else k
                seen[(p, _KINDS[type(v).__name__], False)] += 1
                if isinstance(v, dict):
                    visit(v, p)
                for x in v if isinstance(v, list) else ():
                    seen[(p, _KINDS[type(x).__name__], True)] += 1
                    if isinstance(x, dict):
                        visit(x, p + "[]")

        for b in batches:
            for t in b["j"]:
                if t is None:
                    continue
                try:
                    doc = json.loads(t)
                except ValueError:
                    continue
                if isinstance(doc, dict):
                    seen[("", "document", False)] += 1
                    visit(doc, "")
        yield pd.DataFrame([(p, k, i, n) for (p, k, i), n in seen.items()], columns=["path", "kind", "item", "n"])

    return df.select(F.col(json_col).cast("string").alias("j")).mapInPandas(run, "path string, kind string, item boolean, n long").groupBy("path", "kind", "item").agg(F.sum("n").alias("n"))


def schema_text(paths: DataFrame, label: str, total: int | None = None) -> str:
    """The union schema as text: a line for each path with kinds, counts and the share of records; for a collection's few paths."""
    rows = paths.collect()
    n = sum(r["n"] for r in rows if r["kind"] == "document" and r["path"] == "")
    if not n:
        return f"Source: {label}\nNo documents sampled — schema unavailable.\n"
    kinds: dict[str, list] = defaultdict(list)
    items: dict[str, list] = defaultdict(list)
    for r in rows:
        if r["path"]:
            (items if r["item"] else kinds)[r["path"]].append((r["kind"], r["n"]))
    shown = lambda ks: " | ".join(k if c == 1 else f"{k}×{c}" for k, c in sorted(ks, key=lambda x: (-x[1], x[0])))
    out = [f"Source: {label}", f"Sampled: {n:,}{f' / {total:,}' if total is not None else ''} documents", "", "Field".ljust(40) + "  " + "Type".ljust(20) + "  Present", "-" * 72]
    for p in sorted(kinds):
        t = shown(kinds[p]) + (f"  → items: {shown(items[p])}" if items[p] else "")
        depth = p.count(".") + p.count("[]")
        out.append("  " * depth + p.ljust(40) + "  " + t.ljust(20) + f"  {100 * sum(c for _, c in kinds[p]) // n}%")
    return "\n".join(out) + "\n"


def record_documents(df: DataFrame, json_col: str, collection: str, key: str = "_id") -> DataFrame:
    """One document a record, as document stores give them: name, text of ``name: value`` lines, source_detail."""
    raw = df.select(F.col(json_col).cast("string").alias("j"))

    @F.pandas_udf("string")
    def render(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "\n\n".join(extract.walk({k: v for k, v in json.loads(t).items() if k != "_source_meta"})), na_action="ignore")

    ident = F.coalesce(F.get_json_object("j", f"$.{key}"), F.substring(F.sha2("j", 256), 1, 16))
    meta = F.from_json(F.get_json_object("j", "$._source_meta"), "map<string,string>")
    return raw.filter(F.try_parse_json("j").isNotNull()).select(F.concat(F.lit(f"{collection}/"), ident).alias("document_name"), render("j").alias("content"), F.coalesce(meta, F.create_map(F.lit("collection"), F.lit(collection), F.lit("key"), ident)).alias("source_detail"))


# crawling

SKIPPED_SUFFIX = "7z avi bmp bz2 css deb dmg eot exe gif gz ico jpeg jpg mkv mov mp3 mp4 ogg pkg png rar rpm svg tar ttf wav webp woff woff2 zip".split()
SKIPPED_PATHS = tuple(f"/{p}/" for p in "api assets cdn-cgi fonts media static uploads wp-json".split())
WIKI_PAGES = "Category File Help Module Portal Project Special Talk Template User User_talk Wikipedia".split()
WIKI_QUERY = ("action=edit", "action=history", "action=info", "action=raw", "diff=", "printable=yes")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, link, target): absolute links of pages, without fragments-only and query-only ones, and their normal form."""
    href = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href=["']([^"'#?][^"']*)["']"""), F.lit(1))
    marked = F.regexp_extract_all(F.col(html_col), F.lit(r"\[[^\]]+\]\((https?://[^)]+)\)"), F.lit(1))
    raw = pages.select(F.col(url_col).alias("url"), F.explode(F.array_distinct(F.concat(href, marked))).alias("link"))
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    folder = F.regexp_replace(F.regexp_extract("url", r"^([^?#]*)", 1), r"(?<=[^:/])/[^/]*$", "")
    full = (
        F.when(F.col("link").rlike("^https?://"), F.col("link"))
        .when(F.col("link").startswith("//"), F.concat(scheme, F.lit(":"), "link"))
        .when(F.col("link").startswith("/"), F.concat(root, "link"))
        .when(~F.col("link").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(folder, F.lit("/"), "link"))
    )
    out = raw.withColumn("link", full).filter("link IS NOT NULL")
    path = F.regexp_extract("link", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    ok = ~F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*SKIPPED_SUFFIX)
    for p in SKIPPED_PATHS:
        ok = ok & ~path.startswith(p)
    return out.filter(ok).withColumn("target", X.normalize_url(F.col("link")))


def crawl(pages: DataFrame, roots: DataFrame, max_depth: int = 3, max_pages: int | None = None, same_domain: bool = True, include: str | None = None, exclude: Sequence[str] = (), wiki: bool = False) -> DataFrame:
    """(url, depth) of the pages reached from ``roots`` (url) over a table of fetched pages, breadth first.

    Each level is one join of the frontier with the links and an anti-join with what was
    reached; there are at most ``max_depth`` levels.  ``max_pages`` keeps the first by depth and URL, as a crawl's budget.
    """
    links = page_links(pages).select(X.normalize_url(F.col("url")).alias("url"), "target", "link").distinct()
    ok = F.lit(True)
    host = lambda c: F.regexp_extract(c, r"^[^:]+://([^/?#]*)", 1)
    if include:
        ok = ok & F.col("link").rlike(include)
    for e in exclude:
        ok = ok & ~F.col("link").rlike(e)
    if wiki:
        ok = ok & ~F.col("link").rlike(f"^[^:]+://[^/]*/(?:wiki/(?:{'|'.join(WIKI_PAGES)}):|w/index\\.php)") & ~F.col("link").rlike("[?].*(?:" + "|".join(WIKI_QUERY) + ")")
    links = links.filter(ok).select("url", "target").distinct()
    known = pages.select(X.normalize_url(F.col("url")).alias("url")).distinct()
    front = roots.select(X.normalize_url(F.col("url")).alias("url")).distinct().withColumns({"root": host(F.col("url")), "depth": F.lit(0)})
    reached = front
    for depth in range(1, max_depth + 1):
        step = front.join(links, "url").select(F.col("target").alias("url"), "root")
        if same_domain:
            step = step.filter(host(F.col("url")) == F.col("root"))
        front = step.distinct().join(reached.select("url", "root"), ["url", "root"], "left_anti").join(known, "url", "left_semi").withColumn("depth", F.lit(depth))
        reached = reached.unionByName(front)
    out = reached.groupBy("url").agg(F.min("depth").alias("depth"))
    return out if max_pages is None else out.orderBy("depth", "url").limit(max_pages)


def crawl_folder(spark: SparkSession, root: str, extensions: Sequence[str] = (), exclude: Sequence[str] = (), max_files: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder: without dot folders and excluded ones; with ``max_files`` the first of them by path."""
    files = extract.read_files(spark, root)
    rest = F.expr("substring(path, locate('" + root.rstrip("/").removeprefix("file:").replace("'", "''") + "', path) + " + str(len(root.rstrip("/").removeprefix("file:"))) + ")")
    ok = ~rest.rlike(r"/\.[^/]+/")
    for e in exclude:
        ok = ok & ~rest.contains(f"/{e}/")
    if extensions:
        ok = ok & F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])
    files = files.filter(ok)
    return files if max_files is None else files.orderBy("path").limit(max_files)


def module_imports(source: str, path: str) -> list[str]:
    """Modules that a Python, TypeScript or Java file imports."""
    ext = os.path.splitext(path)[1]
    if ext == ".py":
        found = re.findall(r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([\w.]+(?:\s*,\s*[\w.]+)*))", source)
        return [m.strip().split(" as ")[0] for a, b in found for m in ([a] if a else b.split(","))]
    if ext == ".java":
        return re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", source)
    return re.findall(r"""(?:from|import|require\()\s*["']([^"']+)["']""", source)


def import_edges(files: DataFrame, root: str, skip: Sequence[str] = ()) -> DataFrame:
    """(path, target) of imports that resolve to a file under ``root``; files has path and content."""
    stdlib = sys.stdlib_module_names
    root = root.rstrip("/")
    skip = tuple(skip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                here, ext = os.path.dirname(path), os.path.splitext(path)[1]
                for m in module_imports((data or b"").decode("utf-8", "replace"), path):
                    if m.startswith(skip) if skip else False:
                        continue
                    if ext == ".py":
                        dots = len(m) - len(m.lstrip("."))
                        if not dots and m.split(".")[0] in stdlib:
                            continue
                        base = os.path.normpath(os.path.join(here, *[".."] * (dots - 1))) if dots else root
                        stem = f"{base}/{m.lstrip('.').replace('.', '/')}"
                        rows += [(path, f"{stem}.py"), (path, f"{stem}/__init__.py")]
                    elif ext == ".java":
                        rows.append((path, f"{root}/{m.replace('.', '/')}.java"))
                    elif m.startswith("."):
                        stem = os.path.normpath(f"{here}/{m}")
                        rows += [(path, stem + e) for e in ("", ".ts", ".tsx", ".js", "/index.ts", "/index.js")]
            yield pd.DataFrame(rows, columns=["path", "target"])

    found = files.select("path", "content").mapInPandas(run, "path string, target string").filter(F.col("target").startswith(root + "/"))
    return found.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("path", "target").distinct()


def import_closure(edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """(path, depth) of the files reached from ``roots`` (path)."""
    front = roots.select("path").distinct().withColumn("depth", F.lit(0))
    out = front
    for d in range(1, max_depth + 1):
        front = front.join(edges, "path").select(F.col("target").alias("path")).distinct().join(out.select("path"), "path", "left_anti").withColumn("depth", F.lit(d))
        out = out.unionByName(front)
    return out


# loading into chunks


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A parquet table; with ``spread`` one that has fewer partitions than there are cores is shuffled over them.

    Work on texts is bound by CPU, and a file of one row group is one task; tables of a cluster's size have more partitions than
    cores and are read as they are.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def load_texts(df: DataFrame, name_col: str, text_col: str, options: chunking.Options = chunking.Options()) -> DataFrame:
    """Enriched chunks with ids of a table of texts."""
    return chunking.with_ids(chunking.enrich(chunking.chunk_documents(df, name_col, text_col, options)))


def load_folder(spark: SparkSession, root: str, options: chunking.Options = chunking.Options(), **found) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of all files under a folder; a broken file is a row of errors."""
    texts = extract.extract_documents(crawl_folder(spark, root, **found))
    return load_texts(texts.filter("text IS NOT NULL"), "path", "text", options), texts.filter("error IS NOT NULL").select("path", "error")


def markdown_table(df: DataFrame, name: str, order: Sequence[str] = ()) -> DataFrame:
    """(document_name, content): a whole small result as one Markdown table, rows in the order of the given columns."""
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n| " + " | ".join(["---"] * len(df.columns)) + " |"
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in order], row.alias("row")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    body = F.array_join(F.transform("rs", lambda r: r["row"]), "\n")
    return rows.select(F.lit(name).alias("document_name"), F.when(F.size("rs") > 0, F.concat(F.lit(head + "\n"), body)).otherwise("").alias("content"))


def row_sections(df: DataFrame, key: str) -> DataFrame:
    """(key, content): one ``##`` section for each row, at any size; empty values and empty keys are left out."""
    val = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    line = [F.when(F.length(val(c)) > 0, F.concat(F.lit(f"{c.strip()}: "), val(c))) for c in df.columns if c != key]
    return df.filter(F.length(val(key)) > 0).select(val(key).alias("key"), F.concat_ws("\n", F.concat(F.lit("## "), val(key)), *line).alias("content"))


def load_query(spark: SparkSession, sql: str, name: str, url: str | None = None, options: chunking.Options = chunking.Options(), jdbc: dict | None = None) -> DataFrame:
    """Chunks of a query's result with the query and, for a database, where it ran; an empty result gives none."""
    df = spark.read.jdbc(url, f"({sql}) q", properties=jdbc or {}) if jdbc is not None else spark.sql(sql)
    chunks = load_texts(markdown_table(df, name).filter("content <> ''"), "document_name", "content", options)
    where = X.db_provenance(F.lit(url)) if url else {}
    detail = F.map_filter(F.create_map(F.lit("query"), F.lit(sql), *[x for k, v in where.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    return chunks.withColumn("source_detail", detail)


def load_rows(df: DataFrame, name_col: str, content_col: str, options: chunking.Options = chunking.Options()) -> DataFrame:
    """Row mode of a query source: each row is a document."""
    return load_texts(df.filter(F.col(content_col).isNotNull()), name_col, content_col, options)


def load_json_array(spark: SparkSession, path: str, name_col: str, content_col: str, options: chunking.Options = chunking.Options()) -> DataFrame:
    rows = spark.read.option("multiLine", True).json(path)
    return load_rows(rows, name_col, content_col, options)


CATALOGUE_SQL = {
    "postgresql": "SELECT table_name AS name, 'view' AS kind, view_definition AS body FROM information_schema.views WHERE table_schema NOT IN ('pg_catalog', 'information_schema') UNION ALL SELECT routine_name, 'routine', routine_definition FROM information_schema.routines WHERE routine_schema NOT IN ('pg_catalog', 'information_schema') UNION ALL SELECT trigger_name, 'trigger', action_statement FROM information_schema.triggers",
    "mysql": "SELECT table_name AS name, 'view' AS kind, view_definition AS body FROM information_schema.views WHERE table_schema = DATABASE() UNION ALL SELECT routine_name, 'routine', routine_definition FROM information_schema.routines WHERE routine_schema = DATABASE() UNION ALL SELECT trigger_name, 'trigger', action_statement FROM information_schema.triggers WHERE trigger_schema = DATABASE()",
    "mssql": "SELECT o.name, CASE WHEN o.type = 'V' THEN 'view' WHEN o.type = 'TR' THEN 'trigger' ELSE 'routine' END AS kind, m.definition AS body FROM sys.sql_modules m JOIN sys.objects o ON o.object_id = m.object_id",
    "sqlite": "SELECT name, type AS kind, sql AS body FROM sqlite_master WHERE type IN ('view', 'trigger')",
}


def database_objects(read: Callable[[str], DataFrame], dialect: str, name: str) -> DataFrame:
    """(document_name, content): views, routines and triggers as documents; ``read`` runs SQL in the database."""
    if dialect not in CATALOGUE_SQL:
        raise ValueError(f"no such dialect: {dialect!r}")
    return read(CATALOGUE_SQL[dialect]).filter("body IS NOT NULL").select(F.concat_ws(":", F.lit(name), "kind", "name").alias("document_name"), F.concat(F.lit("# "), "kind", F.lit(" "), "name", F.lit("\n\n```sql\n"), "body", F.lit("\n```")).alias("content"))


# byte transports as a data source

FETCHERS: dict[str, Callable[[str], bytes]] = {}


def register_transport(prefix: str, fetch: Callable[[str], bytes]) -> None:
    """Bytes of URIs that begin with ``prefix``, by an injected function (network access is the caller's)."""
    FETCHERS[prefix] = fetch


def fetch_uri(uri: str) -> bytes:
    for prefix, fetch in FETCHERS.items():
        if uri.startswith(prefix):
            return fetch(uri)
    if re.match("^(?:file://|/|[^:]+$)", uri):
        with open(uri.removeprefix("file://"), "rb") as f:
            return f.read()
    raise ValueError(f"no transport for {uri!r}")


class UriDataSource(DataSource):
    """``spark.read.format("uris").option("uris", "a\\nb")``: (path, mime, content, error) of each URI, fetched by the tasks."""

    @classmethod
    def name(cls) -> str:
        return "uris"

    def schema(self) -> str:
        return "path string, mime string, content binary, error string"

    def reader(self, schema):
        return _UriReader(self.options, dict(FETCHERS))


class _UriReader(DataSourceReader):
    def __init__(self, options: dict, fetchers: dict):
        self.uris = [u for u in options.get("uris", "").split("\n") if u]
        self.fetchers = fetchers

    def partitions(self):
        return [InputPartition(u) for u in self.uris] or [InputPartition(None)]

    def read(self, partition):
        import mimetypes

        uri = partition.value
        if uri is None:
            return
        try:
            fetch = next((f for p, f in self.fetchers.items() if uri.startswith(p)), fetch_uri)
            yield uri, mimetypes.guess_type(uri)[0], fetch(uri), None
        except Exception as e:  # one source that fails is a row with its error
            yield uri, None, None, f"{type(e).__name__}: {e}"
