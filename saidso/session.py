"""Session and lineage helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: The folder of the run that is going on, if there is one.
_folder: ContextVar[str | None] = ContextVar("saidso_run_folder", default=None)


def local_session(cpus: str | int = "*", app: str = "saidso") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. A session in one process without one gets a fresh temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        return private_folder(spark.sparkContext)
    return named


def private_folder(context: SparkContext) -> str:
    """A new folder of this machine, for sessions that have no other machine."""
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of the block go to one new folder, which is deleted when the block ends.

    Results are read from those tables when they are computed: write or collect them inside the block.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/saidso-{uuid.uuid4().hex}"
    mark = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(mark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A fresh folder name under the folder of the run, else under the shared folder."""
    return f"{(_folder.get() or shared_folder(spark)).rstrip('/')}/saidso-{uuid.uuid4().hex}"


def materialize(df: DataFrame, plain: bool = False, **options: str) -> DataFrame:
    """Write `df` once and read it back.

    Lineage ends at files that outlive any executor, readers prune columns, and the
    planner knows the size of what it reads, so small tables broadcast by themselves.
    `plain`: neither compressed nor by dictionary, for tables of many short or repeated
    values, whose files are else a fraction of the memory a broadcast of them takes.
    `options` are those of the writer.
    """
    path = scratch(df.sparkSession)
    how = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {}
    df.write.options(**how, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of `tables` that `materialize` wrote, once all that is made from them is written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
