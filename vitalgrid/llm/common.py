"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes, up to which a side of a join may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share. Where none is set, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vitalgrid-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """Mark ``df`` for broadcasting if it is small: by its rows, and by their bytes where ``size`` tells them for rows that may be wide. Otherwise the join is left to Spark."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)) if size is not None else F.lit(0)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def text_parts(batch: pa.RecordBatch, column: str = "text", size: int = 2_000_000, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text, a longer text alone, and of ``rows`` rows at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def raw_texts(part: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The texts in UTF-8."""
    return part[column].cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Return memory that this Python worker no longer uses: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frees(run: Callable) -> Callable:
    """A function over the batches of a task that gives memory back when they end."""

    @functools.wraps(run)
    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own
