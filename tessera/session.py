"""Session helpers shared by every query."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Workers give freed memory over some 64 MB back to the system, and don't keep any for each thread; a worker lives for many tasks. Arrays
#: up to 32 MB come from what is kept, as mapping memory anew costs more time than the work on them.
MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: For sessions that run one operator after another on the same workers: all freed memory goes back, at some cost of time.
TIGHT = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows of a batch that goes to a worker, which may hold long texts or whole files; the default is 10000.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def ship(spark: SparkSession, memory: dict[str, str] = MEMORY) -> None:
    """Let Python workers import this package when it is not installed on the executors' path, in bounded memory: smaller batches, unless
    the session says how large they are, and allocators that don't hoard; what is set by an earlier call stays."""
    env = spark.sparkContext.environment
    for k, v in memory.items():
        env.setdefault(k, v)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, ROOT) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
