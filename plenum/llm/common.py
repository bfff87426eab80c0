"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, chosen by exact name and position.

    Other columns, also ones that differ from a wanted name only by case or
    repeat it (the first then counts), cannot clash with what an operator adds.
    """
    have = df.columns
    numbered = df.toDF(*[f"_in{i}" for i in range(len(have))])
    return numbered.select(*[F.col(f"_in{have.index(n)}").alias(n) for n in names])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plenum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/plenum/{tag}-{uuid.uuid4().hex}"
    for paths in _recorders.get():
        paths.append(path)
    return path


#: Lists that take down the names of scratch folders, of this thread alone.
_recorders: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recorders", default=())


@contextlib.contextmanager
def recorded():
    """The list of scratch folders that this thread names meanwhile."""
    paths: list[str] = []
    token = _recorders.set((*_recorders.get(), paths))
    try:
        yield paths
    finally:
        _recorders.reset(token)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders in the shared store; those that are gone already are no problem."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def written_at(df: DataFrame) -> float:
    """When the first file that df reads was written, in seconds; 0 if it reads none."""
    files = df.inputFiles()
    if not files:
        return 0.0
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime() / 1000


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize has stored for these, once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df.stored_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
