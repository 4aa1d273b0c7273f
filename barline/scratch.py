"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_on_the_way: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("on_the_way", default=None)


def scratch_base(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may lack that setting: a temporary folder of this
    process takes its place. Either goes when the process ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        base = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="barline-")
            atexit.register(shutil.rmtree, base, True)
        _own_dirs[app] = f"{base.rstrip('/')}/barline-{app}"
        atexit.register(_remove_quietly, spark, _own_dirs[app])
    return _own_dirs[app]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the scratch space, wherever it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session ended before its process
        with contextlib.suppress(Exception):
            remove(spark, path)


def scratch_dir(spark: SparkSession) -> str:
    return f"{scratch_base(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    It cuts lineage and survives the loss of executors.
    """
    path = scratch_dir(df.sparkSession)
    if (tables := _on_the_way.get()) is not None:
        tables.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(build())``; the tables that ``build`` wrote on the way are removed, as nothing reads them any more."""
    outer, mine = _on_the_way.get(), []
    token = _on_the_way.set(mine)
    try:
        out = materialize(build())
    finally:
        _on_the_way.reset(token)
    *steps, last = mine
    if outer is not None:
        outer.append(last)
    for path in steps:
        remove(out.sparkSession, path)
    return out
