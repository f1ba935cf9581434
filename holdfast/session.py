"""Session helpers. Library code takes the caller's session and fixes no setting in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def local_session(app: str = "holdfast", cores: str = "8", **conf: str) -> SparkSession:
    """A single-machine session for tests and timings; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    if "spark.checkpoint.dir" not in settings:
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="holdfast-")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    root = _named(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return _scope.get() or root.rstrip("/")


def _named(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def use_local_folder(spark: SparkSession) -> None:
    """Give a session on one machine that names no shared folder one of its own.

    For entry points and tests: a cluster has to name a folder that all executors reach.
    """
    if spark.sparkContext.master.partition("[")[0] == "local" and not _named(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="holdfast-"))


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[str]:
    """A scope whose tables in the shared folder are deleted when it ends.

    What was built inside must have been written or collected by then.
    """
    inner = fresh_dir(spark, "scope")
    before = _scope.set(inner)
    try:
        yield inner
    finally:
        _scope.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(path, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: computed once, read as often as needed.

    The rows outlive the executors that made them, and Spark knows the table's size when
    it picks a join. The files stay until the scope of `written_tables` ends, or the owner of
    the folder removes them.
    """
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
