"""URL filters by a sorted digest array: memory-mapped 64-bit keys, binary search, full strings to confirm."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .shared import free_name, new_path, quoted

#: The list of the production query: an entry a line, a domain (with all its subdomains) or a domain and a path; # starts a comment.
PRODUCTION_LIST = os.path.join(os.path.dirname(os.path.abspath(__file__)), "blocklist.txt")
#: Entries in a shard of the digest.
SHARD = 4_000_000

_URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:\s]*)(?::\d*)?([^?#\s]*)", re.I)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) in normal form: lower-case host without user, port and final dot; path without query, fragment and final slash."""
    m = _URL.match(url or "")
    if not m:
        return "", ""
    return m[1].lower().rstrip("."), m[2].rstrip("/")


def entry_key(entry: str | None) -> str:
    """Normal form of a blocklist entry: ``domain`` or ``domain/path``."""
    host, path = split_url(entry)
    return host + path


def candidates(url: str | None) -> list[str]:
    """Keys under which a URL may be listed, the most specific first: each path prefix of the host, then each parent domain."""
    host, path = split_url(url)
    if not host:
        return []
    out, parts = [], path.split("/")[1:] if path.startswith("/") else []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))]
    for h in hosts:
        out += [h + "/" + "/".join(parts[:n]) for n in range(len(parts), 0, -1)]
    return out + hosts


def hashes(keys: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64)


@dataclass(frozen=True)
class Digest:
    """Shards of a sorted digest: (first key, last key, path), by ascending keys."""

    shards: tuple[tuple[int, int, str], ...]


def _signed(keys: np.ndarray) -> np.ndarray:
    """Order-preserving map of unsigned to signed 64-bit keys, which Spark can sort."""
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def python_uri(uri: str) -> str:
    """A URI as Spark writes it, for Python: s3a is s3, dbfs is its mount."""
    if uri.startswith("dbfs:"):
        return "/dbfs/" + uri[5:].lstrip("/")
    return re.sub("^s3[an]:", "s3:", uri)


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    uri = python_uri(uri)
    if not re.match(r"\w+:", uri):
        return fs.LocalFileSystem(), uri
    try:
        return fs.FileSystem.from_uri(uri)
    except (ValueError, pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"Python workers can't write to {uri!r}: the digest needs a shared folder on file, hdfs, s3, s3a, gs, abfs, abfss or dbfs ({e})") from e


def _put(uri: str, name: str, data: bytes) -> None:
    at, path = _file_system(uri)
    at.create_dir(path, recursive=True)
    with at.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def _get(uri: str, name: str, kind: type) -> np.ndarray:
    """The file as an array: memory-mapped where the shared folder is mounted."""
    at, path = _file_system(uri)
    path = f"{path}/{name}"
    if at.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(at, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with at.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def build_digest(entries: DataFrame, entry_col: str = "entry") -> Digest:
    """Write the digest of a blocklist into the shared folder, each range of keys by one task.

    The driver gets one row for each shard.  A task that runs again writes a folder of its own, so
    that a lost executor leaves no half-written shard in use.  Null and empty entries are left
    out, equal ones count once, long ones are kept whole; an empty list gives a digest without shards; extra columns are ignored.
    """
    spark = entries.sparkSession
    base = new_path(spark, "digest")
    _file_system(base)  # a folder that can't be written is an error here, not in every task

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [k for k in map(entry_key, b["entry"]) if k]
            yield pd.DataFrame({"key": _signed(hashes(names)), "name": names})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts)
        keys = rows["key"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        raw = [n.encode() for n in rows["name"]]
        uri = f"{base}/{uuid.uuid4().hex}"
        _put(uri, "keys", keys.tobytes())
        _put(uri, "ends", np.cumsum([len(r) for r in raw], dtype=np.int64).tobytes())
        _put(uri, "names", b"".join(raw))
        yield pd.DataFrame({"first": [rows["key"].iloc[0]], "last": [rows["key"].iloc[-1]], "uri": [uri]})

    named = entries.select(F.col(quoted(entry_col)).cast("string").alias("entry")).filter("entry IS NOT NULL").mapInPandas(key, "key long, name string").distinct()
    n = max(1, -(-named.count() // SHARD))
    shards = named.repartitionByRange(n, "key").sortWithinPartitions("key", "name").mapInPandas(write, "first long, last long, uri string").collect()
    flip = 1 << 63
    return Digest(tuple(sorted(((r["first"] + flip), (r["last"] + flip), r["uri"]) for r in shards)))


class Prober:
    """Looks keys up in the shards; opens a shard when a key first falls into it."""

    def __init__(self, digest: Digest):
        self.shards, self.open = digest.shards, {}
        self.last = np.array([s[1] for s in digest.shards], np.uint64)

    def files(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.open:
            uri = self.shards[i][2]
            self.open[i] = _get(uri, "keys", np.uint64), _get(uri, "ends", np.int64), _get(uri, "names", np.uint8)
        return self.open[i]

    def __call__(self, names: list[str], keys: np.ndarray | None = None) -> np.ndarray:
        """Whether each name is listed: its key is found and the stored string is the same."""
        keys = hashes(names) if keys is None else keys
        out = np.zeros(len(names), bool)
        shard = np.searchsorted(self.last, keys)
        for i in np.unique(shard[shard < len(self.last)]):
            stored, ends, raw = self.files(int(i))
            mine = np.flatnonzero(shard == i)
            at = np.searchsorted(stored, keys[mine])
            hit = at < len(stored)
            hit[hit] = stored[at[hit]] == keys[mine][hit]
            for m, p in zip(mine[hit], at[hit]):
                want = names[m].encode("utf-8", "surrogatepass")
                while p < len(stored) and stored[p] == keys[m] and not out[m]:
                    out[m] = raw[ends[p - 1] if p else 0 : ends[p]].tobytes() == want
                    p += 1
        return out


def match_urls(df: DataFrame, digest: Digest, url_col: str = "url", rule_col: str = "rule") -> DataFrame:
    """All columns with ``rule``, the most specific entry that lists the URL, or null.

    Defined results: a null, empty or host-less URL has no rule, and one of any length is searched whole; equal URLs, and rows that
    repeat, get equal rules; of entries that list a URL those with a path come first, then the longer host, so there are no ties;
    the name of the new column gets a number if it clashes; an empty table gives an empty table.
    """
    name = free_name(df.columns, rule_col)
    names = [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Prober(digest)
        for batch in batches:
            tried = [candidates(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            flat = [c for t in tried for c in t]
            listed = probe(flat) if flat else np.zeros(0, bool)
            first, rules = 0, []
            for t in tried:
                hit = np.flatnonzero(listed[first : first + len(t)])
                rules.append(t[hit[0]] if len(hit) else None)
                first += len(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rules, pa.string())], names)

    asked = df.select(*[F.col(quoted(c)) for c in df.columns], F.col(quoted(url_col)).cast("string").alias("__qm_url"))
    return asked.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def read_list(spark: SparkSession, path: str = PRODUCTION_LIST) -> DataFrame:
    """(entry) of a list: a table of that column, or text with an entry a line; a file of this package is read by the driver."""
    if path.startswith(os.path.dirname(PRODUCTION_LIST)):
        with open(path, encoding="utf-8") as f:
            lines = spark.createDataFrame([(x,) for x in f.read().split("\n")], "value string")
    elif path.endswith(".parquet"):
        return spark.read.parquet(path).select("entry")
    else:
        lines = spark.read.text(path)
    return lines.select(F.trim(F.regexp_replace("value", "(^|\\s)#.*$", "")).alias("entry")).filter("entry <> ''")


def blocklist(spark: SparkSession, entries: Iterable[str]) -> Digest:
    return build_digest(spark.createDataFrame([(e,) for e in entries], "entry string"))


def op6_url_filter(spark: SparkSession, sf_dir: str, path: str = PRODUCTION_LIST) -> DataFrame:
    """Every page with the entry of the list that lists its URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    matched = match_urls(pages, build_digest(read_list(spark, path)))
    return matched.select("page_id", "url", "rule", F.col("rule").isNotNull().alias("blocked"))


def _listed() -> list[str]:
    with open(PRODUCTION_LIST, encoding="utf-8") as f:
        return [x for line in f if (x := re.sub(r"(^|\s)#.*$", "", line).strip())]


OP6_SQL = f"""
WITH rules(rule) AS (VALUES {", ".join(f"('{d}')" for d in _listed())}),
h AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '^\\s*(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://)?(?:[^/?#@\\s]*@)?([^/?#:\\s]*)', 1)), '.') AS host FROM pages)
SELECT page_id, url, rule, rule IS NOT NULL AS blocked FROM h LEFT JOIN rules ON host = rule OR ends_with(host, '.' || rule)
"""
