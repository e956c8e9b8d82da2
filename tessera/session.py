"""Session helpers: a tuned local session for tests, and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no walk of the stack for every column
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: of ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, as in tests, a local session gets a temporary folder, which goes when the
    process ends. On a cluster a folder of the driver's machine would be of no use: that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir("file://" + made)
    return shared_folder(spark)


_runs: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets. What is written there goes when the process ends."""
    shared = shared_folder(spark)
    if shared not in _runs:
        _runs[shared] = f"{shared}/tessera-{uuid.uuid4().hex}"
        atexit.register(removed, spark, _runs[shared])
    return f"{_runs[shared]}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, as far as the session is still there to do it."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session, or the way to it, has ended
        pass


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``, after making sure that a checkpoint folder is set."""
    sc = df.sparkSession.sparkContext
    shared = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Has the shuffles of the queries within removed when they end, so that a loop keeps those of one round only."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
