"""Session helpers shared by every operator: tables, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast once it has been counted.
BROADCAST_ROWS = 500_000

ROOT = str(Path(__file__).resolve().parent.parent)


#: Python workers give large arrays back when they are freed, rather than hold on to them for the stages that follow.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 22), "MALLOC_TRIM_THRESHOLD_": str(1 << 24), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's checkout (clusters use --py-files instead), in bounded memory."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages, which all executors share.

    It is the session's spark.checkpoint.dir. A folder of our own is set only for a
    single-machine session that names none, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or "/tmp/checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder.

    A checkpoint keeps the size that was estimated for its plan, and joins multiply these, so that in loops the
    number itself outgrows all bounds, and planning with it. A size that is no long is forgotten.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() < 63:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage now: Spark deletes shuffles and checkpoints once nothing there refers to them, but a large heap is seldom collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves that it is small, else df as it is (a shuffle join)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)
