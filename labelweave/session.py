"""Session defaults and the one shared scratch location."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Folders made for local sessions without a configured one, by application; the setting itself cannot be changed later.
_made: dict[str, str] = {}


def build_session(app: str = "labelweave", master: str | None = None, **conf) -> SparkSession:
    """Session for local work; on a cluster pass no master and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        cores = os.cpu_count() or 8
        defaults["spark.sql.shuffle.partitions"] = str(min(cores, 8))
        defaults["spark.driver.memory"] = "16g"
        defaults["spark.ui.showConsoleProgress"] = "false"
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session.

    Only a local master may fall back to a temporary folder: there all tasks share one machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="labelweave-")
    return _made[app]


# Folder below which paths are made at the moment, with a slash at its end.
_within: ContextVar[str] = ContextVar("within", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/labelweave/{_within.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[None]:
    """For work whose results are collected: what it writes to paths of its own goes when it ends, and shuffles nothing refers to any more."""
    folder = scratch_path(spark, name)
    before = _within.set(f"{folder.removeprefix(f'{shared_dir(spark)}/labelweave/')}/")
    try:
        yield
    finally:
        _within.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark._jvm.System.gc()


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)
