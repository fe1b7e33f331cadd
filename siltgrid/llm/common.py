"""Shared helpers: column picking, Arrow mapping and tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separators between words.
BLANKS = b" \t\n\v\f\r"


#: Rows of an Arrow batch: texts may be long, and a batch is held by the JVM and by the task at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function, which gives freed memory back to the system at its end: worker processes go on to other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect(1)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/siltgrid-{tag}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session is gone, and with it the way to the folder
            pass

    atexit.register(drop)
    return path


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete saved tables that no later step reads, so that they don't count as disk until the end."""
    for df in stored:
        remove(df.sparkSession, df.saved_path)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: T.StructType | str) -> DataFrame:
    """Apply a function to each Arrow batch; one batch is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(tidied(run), schema)


def byte_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text as UTF-8 bytes); a null text is empty. Other columns are not read."""
    return df.select(F.col(key), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


#: A single blank with no white space beside it: tokenizers of this family always cut there, and what stands before it has no bearing on what follows.
_CUT = re.compile(r"(?<!\s) (?!\s)")
_NEAR = re.compile(r"\s\s")


def blanks_alone(text: str) -> bool:
    """Whether every blank stands alone."""
    return not (text.startswith(" ") or text.endswith(" ") or _NEAR.search(text))


def space_pieces(text: str) -> list[str]:
    """Cut a text at blanks that stand alone; each cut's blank belongs to the piece after it, and is left off there."""
    return text.split(" ") if blanks_alone(text) else _CUT.split(text)


#: Rows of a narrow table (a few numbers each) up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A stored narrow table, marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows that are gathered, at least, before runs are handed on.
RUN_ROWS = 1 << 16


def by_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows of equal value stay together."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append(columns)
        rows += batch.num_rows
        last = columns[column][-1]
        if rows < RUN_ROWS or held[0][column][0] == last:  # sorted: all of one value so far
            continue
        whole = joined()
        cut = int(np.flatnonzero(whole[column] != last)[-1]) + 1
        yield [c[:cut] for c in whole]
        held, rows = [[c[cut:] for c in whole]], len(whole[0]) - cut
    if held:
        yield joined()
