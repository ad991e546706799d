"""The corpus pipeline: STAGES over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quillmere.llm import bpe, mixing
from quillmere.llm.exact_dedup import exact_dedup
from quillmere.llm.quality import quality_filter
from quillmere.llm.shared import free_name, quoted, written, written_bytes
from quillmere.llm.simhash import near_dedup


#: The places where sources begin again are sent to all tasks up to so many bytes, and joined by source beyond.
EPOCHS_BYTES = 8 << 20


def _epochs(shipped, source: str, order: str):
    """Function of a batch: how often each row's source had begun again at its place."""

    def epochs(batch: pa.RecordBatch) -> pa.Array:
        names, at = batch.column(source).dictionary_encode(), batch.column(order).to_numpy()
        code, out = names.indices.fill_null(-1).to_numpy(), np.zeros(len(at), np.int32)
        for i in np.unique(code):
            s = "" if i < 0 else f"={names.dictionary[int(i)].as_py()}"
            mine = code == i
            out[mine] = np.maximum(np.searchsorted(shipped.value.get(s, at[:0]), at[mine], "right") - 1, 0)
        return pa.array(out)

    return epochs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on ``labels`` doesn't reject.

    Defined results: a null text stays, the empty text goes by the bias alone, long texts are scored whole; rows that repeat stay or go
    together; a score equal to the threshold stays; extra columns of any name are kept; an empty table gives an empty table.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text, the one of least id.

    Defined results: every row with a null text stays, one with the empty text; long texts are compared whole; of rows that repeat an id and text
    one stays, at a tie that of the least other columns; extra columns of any name are kept; an empty table gives an empty table.
    """
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id.

    Defined results: rows with a null id, a null text or a text without words stay; long texts are compared whole; rows that repeat an id are one
    document, so there are no ties; extra columns of any name are kept; an empty table gives an empty table.
    """
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order under the production schedule; a source's documents repeat or end as its weights ask.

    The rows have the columns of documents, and their order, as written, is the training order.  Defined results: a null or empty text counts as one
    token, a long one by its bytes; a null source is a source of its own; null ids come first in their source; rows that repeat are separate documents; positions
    that tie sort by source, id and epoch; extra columns of any name are kept; an empty table gives an empty table.
    """
    tokens = free_name(docs.columns, "tokens")
    mixed = mixing.mix_sources(docs.withColumn(tokens, mixing.text_tokens()), mixing.PRODUCTION_SCHEDULES, mixing.PRODUCTION_DEFAULT, tokens)
    return mixed.select(*[F.col(quoted(c)) for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, in ``train_order`` the row's place in training from 0, and in ``epoch`` how often its source had begun again.

    The stage before wrote its rows in training order and with the columns of documents alone, so the
    order is that of the part files and of the rows in each; the rows of the files before are counted.  A source begins with the same
    document each time, the first in the order of mixing.

    Defined results: a null text has null ids, the empty text none, a long one all of its own; rows that repeat are separate rows, each with its place; where
    ids repeat in a source, rows that tie in mixing may be counted to the epoch before; a name that is taken gets a number; extra columns are
    kept; an empty table gives an empty table.
    """
    taken = list(docs.columns)
    name, row, before, order, source, first, marks = (free_name(taken, c) for c in ("__file", "__row", "__before", "train_order", "__source", "__first", "__marks"))
    epoch = free_name(taken, "epoch")
    meta = docs.metadataColumn("_metadata")
    files = docs.select(meta["file_name"].alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(F.regexp_extract(name, r"part-(\d+)", 1).cast("long"), name).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col(name).alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    kept = [F.col(quoted(c)) for c in docs.columns]
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    place = F.struct(F.md5(F.concat(F.lit(f"{mixing.SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), mixing.text_tokens(), F.xxhash64("text"))
    placed = docs.select(*kept, meta["file_name"].alias(name), meta["row_index"].alias(row), key.alias(source), place.alias(first))
    placed = placed.join(F.broadcast(files), F.col(name) == F.col("of")).withColumn(order, F.col(before) + F.col(row))
    # a row for each source
    heads = docs.select(key.alias("s"), place.alias("p")).groupBy("s").agg(F.min("p").alias("p"))
    begins = written(placed.join(heads, (F.col(source) == F.col("s")) & (F.col(first) == F.col("p"))).select("s", order), "epochs")
    if written_bytes(begins) <= EPOCHS_BYTES:
        held: dict = {}
        for r in begins.collect():
            held.setdefault(r[0], []).append(r[1])
        shipped = spark.sparkContext.broadcast({s: np.sort(x) for s, x in held.items()})
        return bpe.encode(placed.select(*kept, order), also=(epoch, T.IntegerType(), _epochs(shipped, "source", order)))
    begins = begins.groupBy("s").agg(F.sort_array(F.collect_list(order)).alias(marks))
    count = F.greatest(F.size(F.filter(marks, lambda x: x <= F.col(order))) - 1, F.lit(0))
    return bpe.encode(placed.join(begins, F.col(source) == F.col("s"), "left").select(*kept, order, count.alias(epoch)))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: The classifier, the signatures and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
