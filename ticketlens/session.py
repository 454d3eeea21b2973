"""Session settings and the shared folder for tables written between stages."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Stands in for ``spark.checkpoint.dir`` in sessions that run without it.
OWN_FOLDER = "spark.ticketlens.sharedFolder"

_WRITTEN: dict[str, SparkSession] = {}


def build_session(app_name: str = "ticketlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_warehouse(spark: SparkSession) -> None:
    """Name a folder in the session's warehouse where ``spark.checkpoint.dir`` is unset.

    The warehouse is shared by all executors as the checkpoint folder is.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.conf.get(OWN_FOLDER, None):
        spark.conf.set(OWN_FOLDER, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that all executors can reach; ``release`` deletes it.

    The cluster names the folder in ``spark.checkpoint.dir``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if not base:
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a result once to the shared folder and go on from the written table.

    Later stages start from files instead of recomputing the lineage, also after an
    executor is lost.
    """
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def staged_by(frame: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """As ``staged``, laid out in ``parts`` buckets by ``key``: joins and groupings by the key don't move its rows again.

    ``frame`` should be partitioned so already, else every task writes to many buckets. The table's name goes at once, its files stay.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    frame.write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    laid = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return laid


Made = TypeVar("Made")


def at_once(spark: SparkSession, *makers: Callable[[], Made]) -> list[Made]:
    """What the makers return, run at the same time, so that jobs of one fill the cores that stragglers of another leave idle.

    For stagings that don't need each other; the first error of any is raised when all have ended.
    """
    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(make)) for make in makers]
    return [one.result() for one in running]


def discard(path: str) -> None:
    """Delete one folder of ``shared_folder`` before the end, as iterations do with the state before last."""
    owner = _WRITTEN.pop(path)
    # A session that is gone has nothing left to ask; its folder stays.
    with contextlib.suppress(Exception):
        folder = owner._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(owner._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession | None = None) -> None:
    """Delete what was staged, in ``spark`` or in all sessions; results not yet read are lost with it."""
    for path, owner in list(_WRITTEN.items()):
        if spark is None or owner is spark:
            discard(path)


atexit.register(release)
