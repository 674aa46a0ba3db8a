"""What the operators share: the shared folder, the worker path and small expression helpers."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.workers import share_code  # noqa: F401

#: The white space of every word contract here: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; where it is unset and all runs in one process, a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        at = known.get()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = Path(folder).as_uri()
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder; the shuffle files of its plan are removed with the job's end."""
    spark = df.sparkSession
    at = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Removes the files of a DataFrame that `cut` gave and nothing reads any more."""
    found = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if found.isDefined():
        remove(df.sparkSession, found.get())


def rows_of_literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a constant of the plan."""
    names = [x.split()[0] for x in schema.split(", ")]
    said = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{', '.join(x.replace(' ', ': ') for x in schema.split(', '))}>>")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row, also where body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
