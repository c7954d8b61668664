"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Made = TypeVar("Made")

#: Fits that are under way at a time.
AT_ONCE = 8

_own_folder: dict[str, str] = {}
_settled: dict[str, list[str]] = defaultdict(list)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster session without it is an error, because executors could not read a
    driver-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="panelwise-")
    return _own_folder[app]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives executor loss, keeps column pruning and filter
    push-down, and gives the planner the true size, so that joins with it are
    broadcast only when Spark's own size check allows it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled[spark.sparkContext.applicationId].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """:func:`settle` in buckets by ``key``, as many as there are shuffle partitions: what joins or groups by it later finds
    the rows where they lie and shuffles only the other side."""
    spark = df.sparkSession
    name = f"settled_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    _settled[spark.sparkContext.applicationId].append(path)
    return spark.table(name)


def together(spark: SparkSession, tasks: Sequence[Callable[[], Made]], most: int = AT_ONCE) -> list[Made]:
    """Results of tasks that do not depend on each other, in their order. Each runs Spark jobs of its own; ``most`` tasks
    are under way at a time, so that the short jobs of one fill the cores that another's leave idle."""
    with ThreadPoolExecutor(most) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        try:
            return [f.result() for f in started]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def release(spark: SparkSession) -> int:
    """Delete all tables that :func:`settle` and :func:`settle_by` have written in this application; returns how many.

    Call it when the results that read them have been written or collected."""
    paths = _settled.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if (name := path.rsplit("/", 1)[-1]).startswith("settled_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
