"""Session helpers: durable cut points and path checks."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open_steps: list[list[str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="kinsheet-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a table in the shared checkpoint folder.

    A columnar table, unlike ``checkpoint()``, lets each later use read only the columns
    it needs, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4()}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    if _open_steps:
        _open_steps[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` stores inside are removed at the end.

    What the step returns is stored ``kept_tables`` inside it, and must not read the others.
    """
    _open_steps.append([])
    try:
        yield
    finally:
        for path in _open_steps.pop():
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def kept_tables() -> Iterator[None]:
    """Inside a step, tables that belong to its result: only a step around it may remove them."""
    step = _open_steps.pop()
    try:
        yield
    finally:
        _open_steps.append(step)


def kept_table(df: DataFrame) -> DataFrame:
    with kept_tables():
        return materialize(df)


def lasting_table(df: DataFrame) -> DataFrame:
    """``materialize`` for what outlives every step around it."""
    steps = _open_steps[:]
    _open_steps.clear()
    try:
        return materialize(df)
    finally:
        _open_steps.extend(steps)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are removed as each of them ends.

    Otherwise they stay on the executors' disks until the driver happens to collect garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path in full, with its file system, so that two can be compared."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop_path).toString().rstrip("/")
