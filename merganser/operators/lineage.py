"""Cutting lineage: state is checkpointed to the folder that the session names, which all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="merganser-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that driver and executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The setting by which Spark removes what an action shuffled as soon as it ends, and not when the driver's memory is collected.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside, _before = threading.Lock(), Counter(), {}


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Actions within leave nothing shuffled behind. One that is repeated on the same rows shuffles them again."""
    session = spark._jsparkSession.hashCode()
    with _lock:
        _inside[session] += 1
        if _inside[session] == 1:
            _before[session] = spark.conf.get(RELEASE, None)
            spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        with _lock:
            _inside[session] -= 1
            if not _inside[session]:
                before = _before.pop(session)
                spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    _checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting counts for relations made under it


def kept(df: DataFrame) -> DataFrame:
    """df from files that all executors share; as ``cut``, but packed by column, and nothing shuffled stays."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "kept")
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
