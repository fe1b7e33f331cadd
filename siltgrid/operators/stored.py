"""Tables in the folder that driver and executors share, for results that are read more than once.

Writing a table ends its lineage: what is stored is not computed again when an executor is lost. The folder is
the session's spark.checkpoint.dir; only a local session without one gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, tag: str):
    """A new path in the shared folder, and what deletes it; at the latest it goes when the interpreter ends."""
    path = f"{shared_folder(spark)}/siltgrid-{tag}-{uuid.uuid4().hex}"

    def at_end() -> None:
        try:
            drop(spark, path)
        except Exception:  # the session is gone, and with it the way to the folder
            pass

    atexit.register(at_end)
    return path, at_end


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written once and read back; deleted by `done`, or when the interpreter ends."""
    path, at_end = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path, out.at_end = path, at_end
    return out


#: Rows of a few numbers up to which a stored table is broadcast.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A stored table of few columns, broadcast if a count shows that it is small and else joined by sorting, whatever its files' size."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def done(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        atexit.unregister(df.at_end)
        drop(df.sparkSession, df.stored_path)
