"""Session helpers shared by the library, the queries and the tests."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHREDLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where a local session names none, as in tests, a temporary folder of this machine is set; a cluster must name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="shredloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive an executor's loss.

    The shuffle files of the writing go as soon as it is done, instead of whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`materialize` that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: Callable[[str], str]) -> Iterator[None]:
    """A setting changed for what runs inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value(before))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """Every query that runs inside deletes its shuffle files when it ends; it must not be collected twice."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", lambda _: "true")


def whole_variants(spark: SparkSession) -> AbstractContextManager[None]:
    """VARIANTs are written as they are inside, not divided into columns, which takes longer to write than reading them saves."""
    return _setting(spark, "spark.sql.variant.writeShredding.enabled", lambda _: "false")


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Smaller Arrow batches for what runs inside, so that a Python worker holds few texts at a time."""
    return _setting(spark, _BATCH, lambda before: _fewer(rows, before))


def smaller_batches(spark: SparkSession, rows: int) -> None:
    """What :func:`batches_of` does, for all that the session runs from now on, as lazy results run later."""
    spark.conf.set(_BATCH, _fewer(rows, spark.conf.get(_BATCH)))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _fewer(rows: int, before: str) -> str:
    return str(min(rows, int(before)) if int(before) > 0 else rows)


Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(one: Arrow) -> Arrow:
    """``one`` for ``mapInArrow``, whose worker gives the memory that it freed back to the machine at the end of a task.

    Spark keeps workers for later tasks; what they freed would stay with them, beside all that runs then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from one(batches)
        trim()

    return run


def trim() -> None:
    """Give memory that Python, numpy and Arrow freed back to the machine."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if release:
        release(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
