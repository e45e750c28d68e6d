"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


_SLOT: dict[Hashable, Any] = {}


def worker_memo(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks: one thing at a time.

    Memos of pieces and words speed an operator up from task to task; the next
    operator's replaces it, so a worker never holds two.
    """
    if key not in _SLOT:
        if _SLOT:
            _SLOT.clear()
            gc.collect()
            release()
        _SLOT[key] = make()
    return _SLOT[key]


def release() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps freed memory itself
        pass


def tidy(run: Callable) -> Callable:
    """A function of batches that gives freed memory back when its task ends."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def digest_of(value: Any) -> str:
    """A name for a model, by its content."""
    return hashlib.sha256(pickle.dumps(value)).hexdigest()


#: Rows of whole texts that a worker holds at once; Spark's default is five times more.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, with its session's Arrow batches held to BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read the named columns of a table; other columns never reach the plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on one machine a temporary folder is
    set for the life of the context; on a cluster that is an error, for executors
    would write where no other can read.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The written table replaces the lineage, so a lost executor costs a file
    read and never an earlier stage.
    """
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo the given number (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
