"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .kernels import TOKEN_CLASS, buffers, by_bytes, grams, hash_spans, row_of, spans, strings
from .shared import free_name, quoted

#: Log2 of the number of weights.
DIM_BITS = 20
#: Runs of symbols are tokens beside words, as they tell prose from markup and noise.
ORDERS = (1, 2)
#: Feature of any 2-gram of one token twice, so that repetition is known in words never seen.
AGAIN = 0xA6A1
#: Most labelled rows used for training: a bounded sample, those with the least hashed ids.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.5


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 penalties."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.005
    l2: float = 0.1
    epochs: int = 4


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    dim_bits: int = DIM_BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.dim_bits, np.float32)
        w[self.index] = self.weight
        return w


def occurrences(data: np.ndarray, off: np.ndarray, held: dict, dim_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every n-gram occurrence."""
    begin, end, first = spans(data, off, TOKEN_CLASS)
    h, row = hash_spans(data, begin, end, held), row_of(first)
    feats, rows = [], []
    for k in ORDERS:
        g = grams(h, k)
        inside = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
        feats.append((g[inside] >> np.uint64(64 - dim_bits)).astype(np.int64))
        rows.append(row[: len(g)][inside])
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    feats.append(np.full(len(again), AGAIN & ((1 << dim_bits) - 1)))
    rows.append(row[again])
    return np.concatenate(feats), np.concatenate(rows)


def _featurise(dim_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            data, off = buffers(strings(batch.column(2)))
            for i, j in by_bytes(off):
                feat, row = occurrences(data, off[i : j + 1], held, dim_bits)
                order = np.lexsort((feat, row))
                feat, row = feat[order], row[order]
                new = np.flatnonzero(np.r_[True, (feat[1:] != feat[:-1]) | (row[1:] != row[:-1])]) if len(feat) else np.zeros(0, np.int64)
                count = np.diff(np.r_[new, len(feat)])
                total = np.bincount(row, minlength=j - i)
                value = (count / np.sqrt(total[row[new]])).astype(np.float32)
                ends = np.r_[0, np.cumsum(np.bincount(row[new], minlength=j - i))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(feat[new].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(value))], ["turn", "y", "feature", "value"])

    return run


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], dim_bits: int, how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """(index, weight, bias) after ``epochs`` passes over (label, features, values) in the given order."""
    dim = 1 << dim_bits
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)  # the last coordinate is the bias, not penalised by l1
    for _ in range(how.epochs):
        for y, feature, value in rows:
            at, x = np.append(feature, dim), np.append(value, np.float32(1))
            zi, ni = z[at], n[at]
            rate = (how.beta + np.sqrt(ni)) / how.alpha + how.l2
            shrink = np.sign(zi) * np.maximum(np.abs(zi) - np.where(at == dim, 0, how.l1), 0)
            w = -shrink / rate
            g = (_sigmoid(w @ x) - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha * w
            n[at] = ni + g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - np.r_[np.full(dim, how.l1), 0], 0) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)
    index = np.flatnonzero(w[:dim])
    return index, w[index].astype(np.float32), float(w[dim])


def _train(dim_bits: int, how: Ftrl):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(float(y), f, v) for b in batches for y, f, v in zip(b["y"], b["feature"], b["value"])]
        index, weight, bias = ftrl(rows, dim_bits, how)
        yield pd.DataFrame({"index": np.append(index, -1), "weight": np.append(weight, bias)})

    return run


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, how: Ftrl = Ftrl(), dim_bits: int = DIM_BITS) -> Model:
    """Fit on at most ``max_rows`` labelled rows, in the order of a hash of the id.

    FTRL updates one example after another, so one task runs them over features that all tasks
    made; the bound on rows keeps that task's memory and time constant.  An id is one example: of labels that
    repeat an id the largest counts, of texts the least.  Labels other than 0
    and 1, null labels, ids and texts are left out; an empty text is an example without features, and a long one is read whole; without any example all
    weights are 0.  Ids may have any type; extra columns of both tables are ignored, whatever their names.
    """
    named = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    turn = F.xxhash64("id", F.lit("ftrl-order"))
    # at most max_rows rows, so the broadcast is bounded by the parameter
    sample = named.groupBy("id").agg(F.max("y").alias("y")).withColumn("turn", turn).orderBy("turn", "id").limit(max_rows)
    docs = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).filter("text IS NOT NULL")
    chosen = docs.join(F.broadcast(sample), "id").groupBy("id", "turn", "y").agg(F.min("text").alias("text")).select("turn", "y", "text")
    features = chosen.mapInArrow(_featurise(dim_bits), "turn long, y int, feature array<int>, value array<float>")
    ordered = features.repartition(1).sortWithinPartitions("turn", "y", F.size("feature"))
    out = ordered.mapInPandas(_train(dim_bits, how), "index int, weight float").toPandas()
    has = out["index"] >= 0
    bias = float(out.loc[~has, "weight"].iloc[0]) if (~has).any() else 0.0
    return Model(out.loc[has, "index"].to_numpy(), out.loc[has, "weight"].to_numpy(np.float32), bias, dim_bits)


def scores(data: np.ndarray, off: np.ndarray, dense: np.ndarray, bias: float, dim_bits: int, held: dict) -> np.ndarray:
    """Probability of good quality of each row: a sparse dot product of its n-gram counts."""
    feat, row = occurrences(data, off, held, dim_bits)
    n = len(off) - 1
    total = np.maximum(np.bincount(row, minlength=n), 1)
    return _sigmoid(np.bincount(row, weights=dense[feat], minlength=n) / np.sqrt(total) + bias)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score", threshold: float | None = None, schema_cols: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``schema_cols``) with the probability of good quality.

    With ``threshold``, only rows that the classifier doesn't reject, that is without those
    with a lower score.  Defined results: a null text has no score and isn't rejected; a text
    without tokens, as the empty one, gets the score of the bias alone; long texts are scored whole; rows that repeat get equal
    scores, and a score equal to the threshold isn't rejected; a column already named ``score_col`` is
    kept, and the score's name gets a number.  An empty table gives an empty table.
    """
    cols = [quoted(c) for c in (schema_cols or df.columns)]
    name = free_name([c for c in (schema_cols or df.columns)], score_col)
    where = len(cols)
    index, weight, bias, dim_bits = model.index, model.weight, model.bias, model.dim_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        dense = Model(index, weight, bias, dim_bits).dense()
        for batch in batches:
            text = strings(batch.column(where))
            data, off = buffers(text)
            for i, j in by_bytes(off):
                p = pa.array(scores(data, off[i : j + 1], dense, bias, dim_bits, held), mask=text.slice(i, j - i).is_null().to_numpy(zero_copy_only=False))
                out = pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[:where]] + [p], names)
                if threshold is not None:
                    out = out.filter(pc.fill_null(pc.greater_equal(p, threshold), True))
                yield out

    slim = df.select(*cols, F.col(quoted(text_col)).alias("__qm_text"))
    names = [f"c{i}" for i in range(where)] + ["p"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in slim.schema.fields[:where]), T.StructField(name, T.DoubleType())])
    names = schema.names
    return slim.mapInArrow(run, schema)


def quality_filter(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that a classifier trained on ``labels`` doesn't reject, columns as before."""
    model = train(df, labels, id_col, text_col)
    return score(df, model, text_col, threshold=threshold).select(*[F.col(quoted(c)) for c in df.columns])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, schema_cols=["doc_id"])
    return scored.select("doc_id", F.round("quality_score", 6).alias("quality_score"), F.coalesce(F.col("quality_score") >= THRESHOLD, F.lit(True)).alias("keep"))
