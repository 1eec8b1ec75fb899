"""Tables written to the folder that driver and executors share."""

import contextlib
import ctypes
import functools
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Only where spark.checkpoint.dir is unset and Spark runs on this machine alone, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: An Arrow batch ends with the row that brings it to so many bytes.
BATCH_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, LOCAL_CHECKPOINTS in local mode, else an error: executors would each write their own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or LOCAL_CHECKPOINTS


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and survives lost executors.

    ``small`` tables, of a few rows a partition, are written by four tasks a core at most, as each
    task and file costs more than such rows.
    """
    df = df.coalesce(max(8, 4 * df.sparkSession.sparkContext.defaultParallelism)) if small else df
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kindred-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)  # of the application; discard() is for what ends sooner
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing will read them again."""
    for df in tables:
        if path := getattr(df, "_kindred_path", None):
            at, files = _hadoop(df.sparkSession, path)
            files.delete(at, True)


def bound_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most ``rows`` rows and about BATCH_BYTES, so that long texts fit a Python worker; a setting of the session that other queries can share."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give memory that a Python process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What a Python worker keeps from task to task, by its use: tables of an encoder, a loaded model.
KEPT: dict[str, dict] = {}


def forget(use: str | None) -> None:
    """Drop what KEPT has of any other use; a function of this module, so that it is the worker's own KEPT."""
    for other in [k for k in KEPT if k != use]:
        del KEPT[other]


def tidy(run, use: str | None = None):
    """A function over batches that gives what it no longer needs back to the system: Python workers live on between stages.

    At its start it drops what tasks of another ``use`` have left in KEPT, at its end it trims the process.
    """
    @functools.wraps(run)
    def wrapped(batches):
        forget(use)
        yield from run(batches)
        trim()

    return wrapped


@contextlib.contextmanager
def job(spark: SparkSession, name: str):
    """The Spark jobs of a block under one name, by which cancel() ends them."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)
