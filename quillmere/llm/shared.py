"""The cluster's shared folder, written intermediate tables, and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own in local mode only: executors on other machines couldn't read it.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillmere-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quillmere-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table made by ``written``."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(hadoop).getFileStatus(p).getLen()
    return total


def id_numbers(sides: list[DataFrame], id_col: str) -> tuple[list[DataFrame], DataFrame | None]:
    """``sides`` with ``id`` as a long that orders as the ids do, and (name, id) to go back.

    Whole numbers are their own; ids of another type are numbered in their order by one range sort of
    the distinct ids, written so that the numbers stay the same.  The table of names is None for whole numbers.
    """
    if all(isinstance(d.schema[id_col].dataType, T.IntegralType) for d in sides):
        return [d.withColumn("id", F.col(quoted(id_col)).cast("long")) for d in sides], None
    ids = None
    for d in sides:
        one = d.select(F.col(quoted(id_col)).alias("name")).filter("name IS NOT NULL").distinct()
        ids = one if ids is None else ids.union(one)
    names = written(ids.distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()), "ids")
    return [d.withColumnRenamed(id_col, "name").join(names, "name", "left") for d in sides], names


def free_name(taken: Iterable[str], want: str) -> str:
    """``want``, or ``want_1``, ``want_2`` ... if a column of that name (in any case) exists."""
    low = {t.lower() for t in taken}
    name, i = want, 0
    while name.lower() in low:
        i += 1
        name = f"{want}_{i}"
    return name


def quoted(name: str) -> str:
    """A column reference safe for names with dots and blanks."""
    return "`" + re.sub("`", "``", name) + "`"
