"""Exact dedup: 128-bit content hash groups, smallest stable id kept, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .shared import free_name, quoted


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return isinstance(t, T.AtomicType) and not isinstance(t, T.VariantType)


def content_hash(text: Column) -> Column:
    """MD5 of the text's UTF-8 bytes, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row for each distinct text, with all columns of ``df``.

    Rows are grouped by (128-bit hash, text): the hash leads the comparison of keys, and the
    bytes that follow it split groups that only collide.  Each map task first reduces its own
    copies to one row, so a text with millions of copies costs one row a task, and the text is
    shuffled once.  ``copies_col`` names an extra column with the number of copies; it gets a number
    at its end if ``df`` has a column of that name, which stays.

    Defined results: of the copies the smallest id stays, a null id only if all are null; rows
    that repeat an id and text count as copies (the row with the smallest other columns stays).
    Every row with a null text stays, since it has no content to compare; the empty text is a
    text like others, and long texts are compared whole.  An empty table gives an empty table.  Extra columns of any name are kept.
    """
    copies_col = copies_col and free_name(df.columns, copies_col)
    rest = [f for f in df.schema.fields if f.name not in (id_col, text_col)]
    order = F.struct(F.col(quoted(id_col)).isNull().alias("n"), F.col(quoted(id_col)).alias("i"), *[F.col(quoted(f.name)).alias(f"o{j}") for j, f in enumerate(rest) if _orderable(f.dataType)])
    unordered = [(j, f) for j, f in enumerate(rest) if not _orderable(f.dataType)]
    best = F.min(order) if not unordered else F.min_by(F.struct(order.alias("k"), *[F.col(quoted(f.name)).alias(f"o{j}") for j, f in unordered]), order)
    text = F.col(quoted(text_col))
    groups = df.filter(text.isNotNull()).groupBy(content_hash(text).alias("__qm_hash"), text.alias("__qm_text")).agg(best.alias("__qm_row"), F.count(F.lit(1)).alias("__qm_n"))
    key = "__qm_row" if not unordered else "__qm_row.k"
    out = []
    for f in df.schema.fields:
        if f.name == text_col:
            c = F.col("__qm_text")
        elif f.name == id_col:
            c = F.col(f"{key}.i")
        else:
            j = next(j for j, g in enumerate(rest) if g is f)
            c = F.col(f"{key}.o{j}" if _orderable(f.dataType) else f"__qm_row.o{j}")
        out.append(c.alias(f.name))
    extra = [F.col("__qm_n").alias(copies_col)] if copies_col else []
    nulls = df.filter(text.isNull())
    if copies_col:
        nulls = nulls.withColumn(copies_col, F.lit(1).cast("long"))
    return groups.select(*out, *extra).unionAll(nulls)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with the hash of their text and the number of its copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = exact_dedup(docs, copies_col="n_copies")
    return kept.select("doc_id", F.lower(F.hex(content_hash(F.col("text")))).alias("content_hash"), "n_copies")


OP7_SQL = """
SELECT min(doc_id) AS doc_id, md5(text) AS content_hash, count(*) AS n_copies
FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL
SELECT doc_id, NULL, 1 FROM documents WHERE text IS NULL
"""
