"""Shared pieces of the corpus operators: scratch tables and text helpers.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every executor and
the driver share. Only a local session in which it is unset gets a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that a task takes from an Arrow batch at a time, and rows at most.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 512

#: Bytes in a row group of a staged table whose rows are large.
ROW_GROUP = 16 << 20

#: Stands for a missing doc_id inside the operators, so that such rows still join and sort.
NO_ID = -(2**63)

WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def scratch_base(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    return _own[app]


def stage(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The folder goes when the session ends, or earlier by ``release``. Parquet's writer looks at sizes only after 100 rows, and
    a reader's batch holds up to 4,096 rows of a row group; ``large_rows`` (megabytes each) are looked at one by one and
    go in row groups of ROW_GROUP bytes, which bounds what either holds.
    """
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}-{name}"
    writer = df.write.option("compression", "zstd")
    if large_rows:
        writer = writer.options(**{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1})
    writer.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = (fs, target)
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads.

    Spark deletes the shuffle files of finished steps only once the driver's JVM has collected what refers
    to them, so this asks for a collection: without it their disk space adds up over the steps.
    """
    for t in tables:
        fs, target = t._scratch
        fs.delete(target, True)
        spark = t.sparkSession
    gc.collect()
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded bytes in ``column`` (a longer text alone): they bound what a worker holds.

    Spark bounds the batches themselves by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
    """
    for batch in batches:
        values = batch.column(batch.schema.names.index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            then = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
            yield batch.slice(at, then - at)
            at = then


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, a missing one as the empty string."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def n_words(text: str = "text") -> Column:
    """Number of runs of bytes other than space, tab, LF, VT, FF and CR; 0 for a missing text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(*cols: Column) -> Column:
    """A 60-bit pseudo-random number from columns, the same in Spark and in plain SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")
