"""Files that arrive in a folder, decoded as a stream, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.reading import decoded

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, format: str, glob: str = "*", files_per_batch: int = 100, **options: object) -> DataFrame:
    """Rows of each file that appears below path, as read_format() gives them; a batch takes files_per_batch at most."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)
    return decoded(stream, format, **options)


def tumbling_counts(events: DataFrame, time: str, keys: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and keys; rows later than `late` behind the latest one are dropped, and windows past it are final."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
