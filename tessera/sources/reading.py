"""Files of the formats as DataFrames.

`read_format` finds files with Spark's own reader, so any store works, and decodes them in `mapInArrow`: one row per entry, frame
or event, with the file's path. A file that can't be decoded gives one row with `_error`, or fails the query with
mode FAILFAST. Parallelism is by file; archives are opened entry by entry with `entries_with_payload`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.session import ship
from tessera.sources.binary import as_error
from tessera.sources.registry import FORMATS

ERROR = "struct<kind:string,context:string,value:long,limit:long>"
ROWS = 2_000


def ddl_of(name: str) -> str:
    return f"path string, {FORMATS[name].schema}, _error {ERROR}"


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(ddl_of(name))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def decoded(df: DataFrame, name: str, content: str = "content", path: str = "path", mode: str = "PERMISSIVE", **options: object) -> DataFrame:
    """Rows of the files in df; null contents give none. Rows of a damaged file up to the damage are kept."""
    ship(df.sparkSession)
    schema = schema_of(name)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, data in zip(batch.column(0), batch.column(1), strict=True):
                if data.as_py() is None:
                    continue
                try:
                    for row in FORMATS[name].decode(data.as_py(), **options):
                        rows.append({"path": at.as_py(), **row})
                        if len(rows) >= ROWS:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                except Exception as e:  # noqa: BLE001  a damaged file is a row, not the job's end
                    if mode == "FAILFAST":
                        raise
                    rows.append({"path": at.as_py(), "_error": as_error(e).row()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


def read_format(spark: SparkSession, name: str, path: str, glob: str = "*", mode: str = "PERMISSIVE", **options: object) -> DataFrame:
    return decoded(files(spark, path, glob), name, mode=mode, **options)


def entries_with_payload(df: DataFrame, name: str, only: int | None = None) -> DataFrame:
    """Entries of the archives in df (path, content) with their bytes, cut out beside the index in one pass over the files; with `only`,
    those of the entry with that hash alone. Archives that can't be read give no row."""
    ship(df.sparkSession)
    schema = StructType.fromDDL(f"path string, {FORMATS[name].schema}, payload binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                data = data.as_buffer()
                try:
                    index = list(FORMATS[name].decode(data.to_pybytes()))
                except Exception:  # noqa: BLE001
                    continue
                for row in index:
                    own = data.slice(row["offset"], row["size"]).to_pybytes() if only is None or row["crc"] == only else None
                    rows.append({"path": at, **row, "payload": own})
                    held += len(own or b"")
                    if len(rows) >= ROWS or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, schema)


#: What Hadoop calls a store that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


def store_uri(path: str) -> str:
    """A path as Spark writes it, as pyarrow reads it."""
    if "://" not in path:
        return f"file://{path.removeprefix('file:')}"
    scheme, rest = path.split("://", 1)
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def bag_payload(idx: DataFrame, bags: DataFrame) -> DataFrame:
    """Sounds of .idx rows, from the .bag file of the same name."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    both = idx.withColumn("_stem", stem(F.col("path"))).join(bags.select(stem(F.col("path")).alias("_stem"), "content"), "_stem")
    return both.withColumn("payload", F.substring("content", (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))).drop("_stem", "content")


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, name: str, options: dict, columns: list[str]):
        self.name, self.options, self.columns = name, options, columns

    def partitions(self) -> list[_Part]:
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(store_uri(self.options["path"]))
        info = fs.get_file_info(at)
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.is_file] if not info.is_file else [at]
        return [_Part(x) for x in sorted(found)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs = pafs.FileSystem.from_uri(store_uri(self.options["path"]))[0]
        with fs.open_input_file(partition.path) as f:
            data = f.read()
        columns = self.columns
        options = {k: v for k, v in self.options.items() if k not in ("path", "mode")}
        try:
            for row in FORMATS[self.name].decode(data, **options):
                yield tuple(({"path": partition.path} | row).get(c) for c in columns)
        except Exception as e:  # noqa: BLE001
            if str(self.options.get("mode", "")).upper() == "FAILFAST":
                raise
            yield tuple(({"path": partition.path, "_error": tuple(as_error(e).row().values())}).get(c) for c in columns)


def _source(format_name: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tessera_" + format_name.replace("-", "_")

        def schema(self) -> str:
            return ddl_of(format_name)

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(format_name, dict(self.options), schema.fieldNames())

    return Source


def register_sources(spark: SparkSession) -> list[str]:
    """spark.read.format("tessera_shp").load(path) and the like; a file is a partition."""
    ship(spark)
    made = [_source(name) for name in FORMATS]
    for s in made:
        spark.dataSource.register(s)
    return [s.name() for s in made]
