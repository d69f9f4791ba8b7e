"""Helpers that all corpus operators share: shared tables, Arrow batches, text defaults."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts of about this many bytes are held in one working batch of a Python worker.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset (tests, a
    single-process session) a folder of this machine is made and set for the session.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="merganser-"))
    return context.getCheckpointDir()


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets how many rows go to a Python worker at once, if the session leaves that at its default of 10,000.

    Texts are long: the default would hold tens of megabytes in each of the buffers between the processes. Results are
    computed later, so the setting stays; a session that has one of its own keeps it.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def ship(spark: SparkSession) -> None:
    """Lets Python workers on other machines import this package: it goes to them by Spark's own file server."""
    context = spark.sparkContext
    alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if getattr(context, "_merganser_shipped", False) or (alone and _importable()):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="merganser-")  # the driver serves it from there
    with zipfile.ZipFile(f"{folder}/merganser.zip", "w") as out:
        for file in sorted((root / "merganser").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(f"{folder}/merganser.zip")
    context._merganser_shipped = True


def _importable() -> bool:
    """Do workers that this machine starts find the package? They have the working folder and PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    return root in {Path(p).resolve() for p in [".", *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}


class Workspace:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    They are not removed by the operators, since results read them; whoever has used or written a result may drop what was
    opened for it (``Workspace.opened`` lists all, in order).
    """

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and returns the table read back, with the schema it had."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Removes one table, or the whole workspace."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, work: Workspace, name: str) -> DataFrame:
    """df itself where a task that runs again reads the same rows in the same order; else written and read back."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return work.write(df, name) if any(node in plan for node in ("Exchange", "Aggregate", "Join")) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches between rows, so that a piece has about ``most`` bytes of text or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
    release()


def release() -> None:
    """Gives freed memory back at the end of a task: the same worker process may serve another operator next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def crc32_text(column: str) -> str:
    """SQL for crc32 of an id written as text, the key of every held-out split."""
    return f"crc32(cast({column} as string))"
