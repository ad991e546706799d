"""Small helpers shared by the operators: written tables, snapshots, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset one of our own, in local mode only, as executors on other machines couldn't read it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillmere-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmere-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and about the bytes, of a batch that are Python objects at one time.
PART_ROWS, PART_BYTES = 256, 1 << 22


def parts(t: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch or array in slices that are small as Python objects, whatever its own size is."""
    n = len(t)
    step = max(1, min(PART_ROWS, n * PART_BYTES // max(1, t.nbytes)))
    for i in range(0, n, step):
        yield t.slice(i, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: StructType | str) -> DataFrame:
    """Rows that a function gives for each row of ``df``; ``make`` gives the function, once a task.

    Batches of Arrow are taken in slices and given back by slice, so that a worker's memory doesn't grow with the rows of a batch.
    """
    out = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema), timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            same = {x.name: x.type for x in b.schema}  # columns that pass through keep their types
            kinds = [same.get(x.name, x.type) for x in out]
            for t in parts(b):
                rows = [r for x in zip(*(c.to_pylist() for c in t.columns)) for r in f(*x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=out.names)

    return df.mapInArrow(run, schema)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for ``nodes`` (id) and ``edges`` (a, b): the least id that each node can reach.

    Large-star and small-star steps alternate until no edge changes; the number of rounds grows
    with the logarithm of the nodes, and each round is a table in the shared folder.
    """
    kind = nodes.schema["id"].dataType
    links = edges.select(F.greatest("a", "b").cast(kind).alias("a"), F.least("a", "b").cast(kind).alias("b")).filter("a <> b").distinct()
    links, mark = stored(links, "links"), None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = links.union(links.select("b", "a"))
        low = F.least("a", F.min("b").over(Window.partitionBy("a")))
        star = both.select("a", "b", low.alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = star.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        links = stored(down.select("b", "m").union(down.select("a", "m")).toDF("a", "b").filter("a <> b").distinct(), "links")
    return nodes.join(links.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
