"""Session helpers: shipping the package to executors, and tables that cut lineage.

Written tables live under ``spark.checkpoint.dir`` (the folder a cluster shares);
only a session on one machine that names none, as in tests, gets a local folder.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to Python, where the session names none; Spark's own bound is 64 MB.
BATCH_BYTES = 8 << 20
#: Rows that are read in columns at once: each may be a long text.
READ_ROWS = 512
#: Bytes of a row group of a written table: a task that writes or reads one holds it whole, so many at once.
ROW_GROUP_BYTES = 16 << 20
#: Bytes of an input, as Spark estimates them, up to which its rows are dealt out before long work on each.
SMALL_BYTES = 24 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; bound Arrow batches by bytes."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="millrace-")
    target = os.path.join(folder, "millrace_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Where the session does not say otherwise: Arrow batches end by bytes, texts are read in
    columns of few rows, and nested rows one by one. Spark's own 4,096 rows lie in memory for
    each task, and a nested row is a message with all that it holds."""
    bounds = {
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS),
        "spark.sql.parquet.enableNestedColumnVectorizedReader": "false",
    }
    for key, value in bounds.items():
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables; read from the session, set only where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        else:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
            named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
            spark.sparkContext.setCheckpointDir(named)
            atexit.register(shutil.rmtree, named, True)
    return named.rstrip("/")


class Written:
    """A table written to the shared folder; ``drop`` removes its files. With ``few``, for what
    comes out of a shuffle as short rows, a task writes several partitions into one file: many
    partitions of little else make many small files."""

    def __init__(self, df: DataFrame, name: str, few: bool = False):
        if few:
            df = df.coalesce(max(2 * slots(df.sparkSession), partitions(df.sparkSession) // 4))
        spark = df.sparkSession
        self.spark = spark
        self.path = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(self.path)
        self.df = spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)``, whose workers give memory back when a task ends: they
    live on between tasks, and an idle one would else hold the most that any task took."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return what this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a
    lost executor costs a reread, not a recomputation."""
    return Written(df, name).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """How many tasks run at once, as far as the session can tell."""
    return max(1, spark.sparkContext.defaultParallelism)


def partitions(spark: SparkSession) -> int:
    """How many partitions to deal a keyed job table to: as the session says, with a few for every slot."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * slots(spark))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt to all slots. A small file may be one row group, and so one
    task's work, however long each row takes; a large one has splits enough."""
    n = slots(df.sparkSession)
    if df.isStreaming or n < 2 or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL_BYTES:
        return df
    return df.repartition(n)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder. Frames that
    read them can no longer be computed."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
