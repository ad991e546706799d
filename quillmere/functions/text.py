"""Column expressions for lines, terms, identities and labels; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "txt": "text", "md": "markdown", "markdown": "markdown", "htm": "html", "html": "html", "xml": "xml",
    "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yml": "yaml", "yaml": "yaml", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx",
    "pptx": "pptx", "odt": "odt", "ods": "ods", "odp": "odp", "eml": "email", "msg": "email", "parquet": "parquet", "arrow": "arrow",
    "feather": "feather", "py": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "java": "java",
} | {e: "image" for e in "bmp gif jpeg jpg png svg tif tiff webp".split()} | {e: "audio" for e in "aac flac m4a mkv mp3 mp4 ogg wav webm".split()}

_OFFICE, _OPEN = "application/vnd.openxmlformats-officedocument.", "application/vnd.oasis.opendocument."
MIMES = {
    "message/rfc822": "email", "application/x-ndjson": "jsonl", _OFFICE + "wordprocessingml.document": "docx",
    _OFFICE + "spreadsheetml.sheet": "xlsx", _OFFICE + "presentationml.presentation": "pptx",
    _OPEN + "text": "odt", _OPEN + "spreadsheet": "ods", _OPEN + "presentation": "odp",
} | {f"text/{k}": "text" if k == "plain" else k for k in "plain markdown html csv xml yaml".split()} | {f"application/{k}": k.removeprefix("x-") for k in "xml json x-yaml pdf".split()} | {f"video/{k}": "audio" for k in "mp4 webm x-matroska".split()} | {f"image/{k}": "image" for k in ("svg+xml", "gif", "bmp", "webp", "tiff", "jpeg", "png")} | {f"audio/{k}": "audio" for k in ("webm", "flac", "ogg", "x-wav", "wav", "mp4", "mpeg")}
#: Fragments of a MIME type that still tell the kind, in the order of the tests.
MIME_PARTS = (("pdf", "pdf"), ("html", "html"), ("markdown", "markdown"), ("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx"))
SHORT_NAMES = set(EXTENSIONS.values()) | {"auto", "eml"}
OLD_TRANSPORTS = {"notion", "confluence", "inline", "http", "file"}
BINARY = {"audio", "image", "pptx", "xlsx", "docx", "pdf"}
LOADABLE = (
    "audio/", "image/", "video/", "text/", "message/rfc822", "application/octet-stream", "application/msword", "application/vnd.ms-powerpoint",
    "application/vnd.ms-excel", "application/vnd.oasis.opendocument", "application/vnd.openxmlformats", "application/pdf",
    "application/x-ndjson", "application/x-yaml", "application/xml", "application/json",
)


def _case(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def detect_type(path: Column, mime: Column) -> Column:
    """Document type: the MIME type, then a telling part of it, then the file extension, then ``text``."""
    m = F.trim(F.substring_index(F.lower(mime), ";", 1))
    partial = F.lit(None).cast("string")
    for part, kind in reversed(MIME_PARTS):
        partial = F.when(m.contains(part), kind).otherwise(partial)
    ext = F.lower(F.regexp_extract(path, r"[^/.]\.([^./]*)$", 1))
    return F.coalesce(F.try_element_at(_map(MIMES), m), partial, F.try_element_at(_map(EXTENSIONS), ext), F.lit("text"))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def normalize_type(name: str | None) -> str:
    """Short alias of a type given by a user; raises ValueError for an unknown one."""
    if not name:
        return "auto"
    key = name.strip().lower()
    if key in OLD_TRANSPORTS:
        return "auto"
    if key in SHORT_NAMES:
        return key
    if key in MIMES:
        return MIMES[key]
    raise ValueError(f"no such document type: {name!r}")


def is_binary_type(kind: Column) -> Column:
    return F.lower(kind).isin(*BINARY)


def is_loadable_mime(mime: Column) -> Column:
    m = F.trim(F.substring_index(F.lower(mime), ";", 1))
    ok = F.lit(False)
    for p in LOADABLE:
        ok = ok | m.startswith(p)
    return mime.isNull() | ok


def is_table_line(line: Column) -> Column:
    """Two pipes or more."""
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2


def is_list_line(line: Column) -> Column:
    """A bullet, or a number of up to four digits with a dot and a blank."""
    return line.rlike(r"^\s*([-*+] |[0-9]{1,4}\. )")


def markdown_sections(content: Column, kind: Column) -> Column:
    """Texts of the heading lines of a Markdown document; none for other kinds."""
    heads = F.filter(F.split(content, "\n"), lambda x: x.startswith("#"))
    named = F.transform(heads, lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    return F.when(kind.isin("md", "markdown"), named).otherwise(F.array().cast("array<string>"))


def schema_term(term: Column, singular: bool = False) -> Column:
    """Lower-case words of a camel, snake or kebab term; ``singular`` drops one final s."""
    s = F.regexp_replace(term, "([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.lower(F.trim(F.regexp_replace(F.translate(s, "_-", "  "), r"\s+", " ")))
    return F.regexp_replace(s, "s$", "") if singular else s


def auto_id(name: Column) -> Column:
    """Identifier from a display name: runs of other than a-z and 0-9 become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    """Stable id of a chunk: document, index, and 16 hex digits over them and the first 100 characters."""
    raw = F.concat_ws(":", doc, index.cast("string"), F.left(text, F.lit(100)))
    return F.concat_ws("_", doc, index.cast("string"), F.left(F.sha2(raw, 256), F.lit(16)))


def source_kind(chunk_type: Column) -> Column:
    """Where a chunk comes from, by its type."""
    return (
        F.when(chunk_type.isin("db_schema", "db_column", "db_table"), "schema")
        .when(chunk_type.startswith("api_") | chunk_type.isin("graphql_type", "graphql_query", "graphql_mutation"), "api")
        .when(chunk_type == "community_summary", "community")
        .otherwise("document")
    )


def crumb(parts: Column) -> Column:
    """``[a > b > c]`` of the non-null parts, null if there are none."""
    joined = F.array_join(parts, " > ")
    return F.when(F.size(F.filter(parts, lambda p: p.isNotNull())) > 0, F.concat(F.lit("["), joined, F.lit("]")))


def enriched(content: Column, breadcrumb: Column, doc: Column, section: Column) -> Column:
    """Text to embed: the breadcrumb, or one made of document and section, and a blank line before the content."""
    own = F.when(F.length(breadcrumb) > 0, breadcrumb)
    name = F.when(F.length(doc) > 0, F.array(doc)).otherwise(F.array().cast("array<string>"))
    head = F.coalesce(own, crumb(F.concat(name, F.coalesce(section, F.array().cast("array<string>")))))
    return F.when(head.isNull(), content).otherwise(F.concat(head, F.lit("\n\n"), content))


def format_breadcrumb(parts: Column, style: str = "literal", symbol: str = "→") -> Column:
    """A heading path as Markdown headings, as a literal ``[a > b]`` or joined by a symbol."""
    if style == "markdown":
        return F.array_join(F.transform(parts, lambda p, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), p)), "\n")
    if style == "symbol":
        return F.array_join(parts, f" {symbol} ")
    if style == "literal":
        return crumb(parts)
    raise ValueError(f"no such breadcrumb style: {style!r}")


def lca_path(paths: Column) -> Column:
    """Common prefix of the non-empty heading paths; the last of them where nothing is common."""
    some = F.filter(paths, lambda p: F.size(p) > 0)
    common = F.aggregate(
        some,
        F.get(some, F.lit(0)),
        lambda acc, p: F.slice(acc, F.lit(1), F.coalesce(F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(acc), F.size(p)), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & F.get(acc, i - 1).eqNullSafe(F.get(p, i - 1)) & (i <= F.size(acc)) & (i <= F.size(p)), i).otherwise(n)), F.lit(0))),
    )
    return F.when(F.size(some) < 1, F.array().cast("array<string>")).when(F.size(common) > 0, common).otherwise(F.element_at(some, -1))


def est_tokens(text: Column) -> Column:
    """Tokens of a text for prompt budgets: a quarter of its characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def normalize_url(url: Column) -> Column:
    """Scheme, host and path without query, fragment and final slashes."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(head, F.when(path == "", "/").otherwise(path))


def db_provenance(url: Column) -> dict[str, Column]:
    """Dialect, host, port and database of a connection URL; user and password are left out."""
    dialect = F.regexp_extract(url, r"^([A-Za-z0-9]+)(?:\+[^:]*)?:", 1)
    rest = r"^[^:]+://(?:[^@/]*@)?"
    return {
        "db_dialect": F.nullif(dialect, F.lit("")),
        "db_host": F.nullif(F.regexp_extract(url, rest + r"([^:/?#]+)", 1), F.lit("")),
        "db_port": F.nullif(F.regexp_extract(url, rest + r"[^:/?#]*:(\d+)", 1), F.lit("")).cast("int"),
        "db_name": F.nullif(F.regexp_extract(url, r"^[^:]+://[^/]*/([^?#]+)", 1), F.lit("")),
    }


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(squares(a)) * F.sqrt(squares(b))
    return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))


def squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def tag_domain(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule (name, regular expression) that the text matches."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out
