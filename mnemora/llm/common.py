"""What the operators of this subpackage share: the shared folder and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, with the scheme of the
    file system that Spark finds it in. Where that is unset
    and all runs on one machine (tests), a new temporary folder, remembered in the session; on a
    cluster an error, since rows that executors write to their own disks would be lost."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return (whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


#: Bytes of an Arrow batch, where the session has Spark's own default of 64 MB: a Python worker
#: holds little text at once, however long the texts are, and an executor's buffers fit the chunks
#: that its allocator keeps and uses again.
BATCH_BYTES = 1 << 20
#: Rows of a batch of short rows that a worker makes.
BATCH_ROWS = 8192


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session. No result depends on it; a session that
    has set its own bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def fleeting_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have Spark remove the shuffle files of what runs inside as soon as each execution ends, not
    when the driver's memory is next cleaned: for results that are written or collected at once.
    While an execution runs, its shuffles are kept as always. The session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def give_back() -> None:
    """Return to the system what a task's end has freed in its Python worker, which Spark keeps for
    further tasks: Arrow's pool, and the allocator's free pages where it has a call for it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. This cuts the lineage, and a lost
    executor costs no rerun of what came before. Shuffles on the way go when it is written.
    ``paths`` gets the path, for ``discard``."""
    path = shared_path(df.sparkSession, name)
    with fleeting_shuffles(df.sparkSession):
        df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()
