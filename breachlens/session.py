"""Session construction and the shared scratch folder.

On a cluster the scratch/checkpoint location is whatever the deployment put
into ``spark.checkpoint.dir`` or set with ``setCheckpointDir`` (a shared
filesystem). We only pick a folder of our own when neither is there and the
master is local, where driver and executors are one process; any other master
without such a folder is an error.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every breachlens job relies on. AQE re-plans joins/aggregations at
# runtime (coalescing small shuffle partitions, splitting skewed ones), the UI
# stays off (no servers), timestamps stay timezone-free.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark broadcasts a join side only when its measured size (file statistics,
    # or AQE's runtime shuffle statistics) is below this bound; bigger sides stay
    # sort-merge joins, so the bound holds at any data size.
    "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app_name: str = "breachlens",
              shuffle_partitions: int | None = None,
              extra_conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


NO_SHARED_FOLDER = "Set spark.checkpoint.dir to a folder that all executors share (master {master})."


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting, else the context's; a local one only for a local master."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError(NO_SHARED_FOLDER.format(master=sc.master))
        base = tempfile.mkdtemp(prefix="breachlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def materialise(df):
    """Reliable checkpoint into the shared checkpoint folder (cuts lineage,
    survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)        # a query of its own, whose shuffle files go


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint location."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING = {"lock": threading.Lock(), "inside": 0, "before": None}


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that is made or written inside go when it has ended, not when the driver happens to
    collect its garbage: for steps whose results are written or small."""
    with _FREEING["lock"]:
        if not _FREEING["inside"]:
            _FREEING["before"] = spark.conf.get(FREE_SHUFFLES, None)
            spark.conf.set(FREE_SHUFFLES, "true")
        _FREEING["inside"] += 1
    try:
        yield
    finally:
        with _FREEING["lock"]:
            _FREEING["inside"] -= 1
            if not _FREEING["inside"]:
                spark.conf.unset(FREE_SHUFFLES) if _FREEING["before"] is None else spark.conf.set(FREE_SHUFFLES, _FREEING["before"])


def written(df, name: str):
    """The rows as a Parquet table in the shared folder: for what is read more than once."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, jobs: Sequence[Callable]) -> list:
    """Results of independent functions that run Spark jobs, called at the same time: short jobs leave cores to each other."""
    if not jobs:
        return []
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _application_dir(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/breachlens/{spark.sparkContext.applicationId}"


def _located(spark: SparkSession, path: str):
    """A path as the file system's own, and the file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _located(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    p, fs = _located(spark, path)
    fs.delete(p, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote with ``shared_dir``. Call it when no result that reads it is needed any more."""
    remove_path(spark, _application_dir(spark))


__all__ = ["get_spark", "ensure_checkpoint_dir", "materialise", "shared_dir", "shuffles_freed", "written", "at_once", "path_exists", "remove_path", "remove_scratch",
           "DEFAULT_CONF"]
