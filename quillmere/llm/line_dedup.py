"""Line dedup: Bloom filters for lines seen once and twice find suspects, which alone are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .kernels import LINE_CLASS, buffers, by_bytes, hash_spans, row_of, spans, strings
from .shared import free_name, quoted, written

BITS_A_LINE = 12
HASHES = 4
#: Bits of a shard of the filters; a shard has the lines of one range of hashes.
SHARD_BITS = 1 << 21
#: Lines whose hashes a task holds before it sends them.
HELD_LINES = 1 << 22
#: A finished filter is sent to all tasks up to so many bytes; beyond it the hashes of lines go to its shards.
FILTER_BYTES = 64 << 20
U = np.uint64


def lines_of(data: np.ndarray, off: np.ndarray, held: dict) -> tuple[np.ndarray, ...]:
    """(hash, row, line number, start, end) of every line that isn't blank."""
    begin, end, first = spans(data, off, LINE_CLASS)
    row = row_of(first)
    lo = int(off[0])
    ink = np.r_[0, np.cumsum(data[lo : int(off[-1])] > 32)]
    seen = ink[end - lo] > ink[begin - lo]
    begin, end, row = begin[seen], end[seen], row[seen]
    breaks = np.flatnonzero(data[lo : int(off[-1])] == 10) + lo
    number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, off[row])
    return hash_spans(data, begin, end, held), row, number, begin, end


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash, by the range in which its upper half lies."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int32)


def places(h: np.ndarray) -> list[np.ndarray]:
    """Bits of a shard that stand for the lower halves of hashes."""
    low = (h & U(0xFFFFFFFF)) * U(0x9E3779B97F4A7C15)
    step = (low >> U(40)) | U(1)
    return [((low >> U(8)) + U(j) * step & U(SHARD_BITS - 1)).astype(np.int64) for j in range(HASHES)]


def holds(filter_: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(at[0]), bool)
    for p in at:
        out &= (filter_[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def insert(filter_: np.ndarray, at: list[np.ndarray]) -> None:
    for p in at:
        np.bitwise_or.at(filter_, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def note(once: np.ndarray, twice: np.ndarray, h: np.ndarray) -> None:
    """Add hashes to a shard's filters: those met before, here or in ``once``, go to ``twice``."""
    h, n = np.unique(h, return_counts=True)
    at = places(h)
    again = holds(once, at) | (n > 1)
    insert(twice, [p[again] for p in at])
    insert(once, at)


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in ``h``) of the shards that have any."""
    shard = shard_of(h, shards)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(h) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(shard[order[a]]), order[a:b]


def _build(shards: int):
    """A task's part of the filters, kept sparse: for each shard the lower halves of its lines' hashes, twice if seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        seen: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            rows = [(s, h[at].astype(np.uint32).tobytes()) for s, at in _by_shard(h, shards)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "part"])

        for batch in batches:
            data, off = buffers(strings(batch.column(0)))
            for i, j in by_bytes(off):
                seen.append(lines_of(data, off[i : j + 1], held)[0])
                if sum(map(len, seen)) >= HELD_LINES:
                    yield sent()
        if seen:
            yield sent()

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-filter of each shard, from all tasks' parts, sorted by shard."""
    now, parts = None, []
    once = twice = np.zeros(0, np.uint8)

    def take() -> None:
        note(once, twice, np.concatenate(parts).astype(U))
        parts.clear()

    for batch in batches:
        for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            if s != now:
                if now is not None:
                    take()
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()])], ["shard", "twice"])
                now, once, twice = s, np.zeros(SHARD_BITS // 8, np.uint8), np.zeros(SHARD_BITS // 8, np.uint8)
            parts.append(np.frombuffer(b.as_buffer(), np.uint32))
            if sum(map(len, parts)) >= HELD_LINES:
                take()
                parts.append(np.zeros(0, np.uint32))
    if now is not None:
        take()
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()])], ["shard", "twice"])


def twice_filter(texts: DataFrame, n_lines: int) -> tuple[DataFrame, int]:
    """(shard, twice): the filter of lines seen at least twice, as a table of shards; and the number of shards, which follows the lines."""
    shards = max(1, -(-BITS_A_LINE * n_lines // SHARD_BITS))
    parts = texts.mapInArrow(_build(shards), "shard int, part binary")
    return written(parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_fold, "shard int, twice binary"), "twice"), shards


def _hits(h: np.ndarray, filters: dict[int, bytes], shards: int) -> np.ndarray:
    """Which lines the filter that was sent to all tasks holds."""
    hit = np.zeros(len(h), bool)
    for s, at in _by_shard(h, shards):
        if s in filters:
            hit[at] = holds(np.frombuffer(filters[s], np.uint8), places(h[at]))
    return hit


def _probe(shipped, shards: int):
    """Suspects (id, line_no, line) of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            data, off = buffers(strings(batch.column(1)))
            for i, j in by_bytes(off):
                h, row, number, begin, end = lines_of(data, off[i : j + 1], held)
                hit = np.flatnonzero(_hits(h, shipped.value, shards))
                lines = [data[b:e].tobytes() for b, e in zip(begin[hit], end[hit])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[hit] + i)), pa.array(number[hit].astype(np.int32)), pa.array(lines, pa.binary())], ["id", "line_no", "line"])

    return run


def _suspected(shipped, shards: int):
    """UDF: whether a text has a suspect."""

    @F.arrow_udf(T.BooleanType())
    def suspected(texts: pa.Array) -> pa.Array:
        data, off = buffers(strings(texts))
        out, held = np.zeros(len(texts), bool), {}
        for i, j in by_bytes(off):
            h, row, *_ = lines_of(data, off[i : j + 1], held)
            out[i + row[_hits(h, shipped.value, shards)]] = True
        return pa.array(out)

    return suspected


def _address(shards: int):
    """(shard, ids, numbers, hashes) of the lines of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            data, off = buffers(strings(batch.column(1)))
            for i, j in by_bytes(off):
                h, row, number, _, _ = lines_of(data, off[i : j + 1], held)
                each = list(_by_shard(h, shards))
                at = np.concatenate([a for _, a in each]) if each else np.zeros(0, np.int64)
                ends = pa.array(np.r_[0, np.cumsum([len(a) for _, a in each])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in each], pa.int32()), pa.ListArray.from_arrays(ends, batch.column(0).take(pa.array(row[at] + i))), pa.ListArray.from_arrays(ends, pa.array(number[at].astype(np.int32))), pa.array([h[a].astype(np.uint32).tobytes() for _, a in each], pa.binary())], ["shard", "ids", "numbers", "hashes"])

    return run


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, line_no) of the suspects, from rows (shard, twice, ids, numbers, hashes) of which a shard's filter comes first."""
    now, filter_ = None, None
    for batch in batches:
        for n, (s, twice) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            if twice.is_valid:
                now, filter_ = s, np.frombuffer(twice.as_py(), np.uint8)
            elif s == now:
                h = np.frombuffer(batch.column(4)[n].as_py(), np.uint32).astype(U)
                hit = pa.array(np.flatnonzero(holds(filter_, places(h))))
                yield pa.RecordBatch.from_arrays([batch.column(2)[n].values.take(hit), batch.column(3)[n].values.take(hit)], ["id", "line_no"])


def remote_suspects(texts: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """(id, line_no, line) of the lines of (id, text) that the filter holds, whose shards the hashes of lines go to."""
    kind = texts.schema["id"].dataType
    one = T.StructType([T.StructField("id", kind), T.StructField("line_no", T.IntegerType())])
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.BinaryType())])
    lines = texts.mapInArrow(_address(shards), schema)
    both = found.unionByName(lines, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("twice").isNull())
    hits = both.select("shard", "twice", "ids", "numbers", "hashes").mapInArrow(_ask, one)
    at = hits.groupBy("id").agg(F.collect_set("line_no").alias("nos"))
    split = texts.join(at, "id").select("id", F.split("text", "\n").alias("lines"), F.explode("nos").alias("line_no"))
    return split.select("id", "line_no", F.get("lines", F.col("line_no")).cast("binary").alias("line")).filter("line IS NOT NULL")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """``df`` with only the first occurrence of each line in the corpus; ``count_col`` has the lines taken out.

    Lines end at a line feed and are compared byte by byte; first is the least (id, line
    number).  The lines of one range of hashes have two Bloom filters, for lines seen once and lines seen twice,
    of 12 bits a line; each task sends its part of them, and a line of two parts, or twice in one, is in the twice-filter.
    Lines in it are suspects; only these are shuffled, grouped by their bytes, which leaves the lines that
    do repeat, each with its first place.  Documents without a suspect pass straight through; only the others are
    joined with the lines that they lose.  A filter of more than ``FILTER_BYTES`` (45 million lines) stays in its shards: then the
    hashes of all lines go to them, and all documents are joined.

    Defined results: blank lines (nothing above the space character) always stay; a row with
    a null id or text stays as it is and takes no part (its count is 0); rows that
    repeat an id are one document, their equal lines at equal places stay or go together; equal lines of one document are
    ties that the line number decides; an empty text stays empty, a text all of whose lines go becomes empty, and one of any length is
    searched whole.  All columns are kept, ``count_col`` gets a number if
    it clashes; an empty table gives an empty table.
    """
    ident, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    narrow = df.filter(ident.isNotNull() & text.isNotNull()).select(ident.alias("id"), text.alias("text"))
    n = narrow.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    found, shards = twice_filter(narrow.select("text"), n)
    flagged = F.lit(True)
    if shards * SHARD_BITS // 8 <= FILTER_BYTES:
        shipped = df.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["twice"]) for r in found.toLocalIterator()})
        schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.BinaryType())])
        maybe, flagged = narrow.mapInArrow(_probe(shipped, shards), schema), _suspected(shipped, shards)(text)
    else:
        maybe = remote_suspects(narrow, found, shards)
    maybe = written(maybe, "suspects")
    first = maybe.groupBy("line").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("line", "first")
    again = maybe.join(first, "line").filter(F.struct("id", "line_no") != F.col("first"))
    mark = lambda no, line: F.concat_ws(":", no.cast("string"), line.cast("string"))
    gone = again.groupBy(F.col("id").alias("__qm_id")).agg(F.collect_set(mark(F.col("line_no"), F.col("line"))).alias("__qm_gone"))

    name = free_name(df.columns, count_col)
    whole = df.withColumn("__qm_flag", ident.isNotNull() & text.isNotNull() & flagged)
    joined = whole.filter("__qm_flag").join(gone, ident == F.col("__qm_id"), "left").withColumn("__qm_lines", F.split(text, "\n"))
    marked = F.transform("__qm_lines", lambda x, i: mark(i, x))
    kept = F.when(F.col("__qm_gone").isNotNull(), F.transform(F.array_except(marked, F.col("__qm_gone")), lambda x: F.substring(x, F.locate(":", x) + 1, F.length(x))))
    joined = joined.withColumn("__qm_kept", kept)
    cleaned = F.coalesce(F.array_join("__qm_kept", "\n"), text)
    removed = F.when(F.col("__qm_kept").isNull(), 0).otherwise(F.size("__qm_lines") - F.size("__qm_kept"))
    some = joined.select(*[cleaned.alias(c) if c == text_col else F.col(quoted(c)) for c in df.columns], removed.cast("int").alias(name))
    rest = whole.filter("NOT __qm_flag").select(*[F.col(quoted(c)) for c in df.columns], F.lit(0).alias(name))
    return rest.unionAll(some)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated lines taken out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs)


OP9_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) > 1 AND regexp_matches(line, '[^\\x00-\\x20]') AS gone FROM e),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text, (count(*) FILTER (WHERE gone))::INT AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE o.text END AS text, coalesce(o.n_removed, 0) AS n_removed FROM documents d LEFT JOIN o USING (doc_id)
"""
