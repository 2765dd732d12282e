"""What the formats' tools compute over entry tables, as operators on DataFrames.

Keys can be hot: aggregations combine in each task first, and where one row per key is wanted min_by / max_by are used, not
windows. Windows stay where order matters, within the file or group that the semantics name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unambiguous(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """key and its only value; keys with two different values are dropped, equal repeats are not."""
    out = candidates.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    return out.where(F.col(value) == F.col("_other")).drop("_other")


def first_wins(df: DataFrame, keys: list, order: list, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v")).select("*", "_v.*").drop("_v")


def last_wins(df: DataFrame, keys: list, order: list, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select("*", "_v.*").drop("_v")


def resolve_names(entries: DataFrame, names: DataFrame, key: str, name: str, unknown: str = "(unknown)") -> DataFrame:
    """Every entry with its name, or `unknown`."""
    return entries.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(unknown)))


def overlay(mounts: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Archives mounted over one another: of each key the last mount's entry."""
    return last_wins(mounts, [key], order, values)


def adjacent_overlaps(entries: DataFrame, group: list[str], offset: str, size: str, tie: list[str]) -> DataFrame:
    """Entries that start before the entry before them, in the order of offsets, ends. Only neighbours are compared; an entry of
    size 0 overlaps nothing."""
    w = Window.partitionBy(*group).orderBy(offset, *tie)
    df = entries.withColumn("_end", F.lag(F.col(offset) + F.col(size)).over(w)).withColumn("_size", F.lag(size).over(w))
    return df.where((F.col("_end") > F.col(offset)) & (F.col("_size") > 0)).withColumn("overlap", F.col("_end") - F.col(offset)).drop("_end", "_size")


def run_segments(df: DataFrame, group: list[str], order: list[str], value: str, least: int = 1) -> DataFrame:
    """Runs of equal values: group, run, value, n and the first and last of order[0]; runs shorter than `least` go."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    df = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(*group, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return out.where(F.col("n") >= least)


def unique_names(entries: DataFrame, group: list[str], name: str, order: list[str], instead: Column | None = None) -> DataFrame:
    """Names made unique without regard to case: from the second on, __2, __3, ... before the extension.

    With `instead`, the second of a name takes that one as it is, and __2, __3, ... go to it from the third on, or from the second
    where `instead` is the name itself.
    """
    w = Window.partitionBy(*group, F.lower(name)).orderBy(*order)
    df = entries.withColumn("_n", F.row_number().over(w)).withColumn("_base", F.col(name) if instead is None else instead)
    later = F.col("_n") if instead is None else F.col("_n") - F.when(F.lower("_base") == F.lower(name), 0).otherwise(1)
    stem, ext = F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_base", r"(\.[^.]*)?$", 1)
    numbered = F.when(later == 1, F.col("_base")).otherwise(F.concat(stem, F.lit("__"), later.cast("string"), F.coalesce(ext, F.lit(""))))
    return df.withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(numbered)).drop("_n", "_base")


def sizes_from_offsets(df: DataFrame, group: list[str], offset: str, order: list[str], end: Column) -> DataFrame:
    """size: the next entry's offset, or `end`, less the own one."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("size", F.coalesce(F.lead(offset).over(w), end) - F.col(offset))


def carried(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null so far."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line, with its place."""
    return df.select("*", F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))


def ini_table(df: DataFrame, group: list[str], text: str = "text") -> DataFrame:
    """section, key, value, pos of INI texts. Comments start at any ;, a [ line without ] is skipped, names are compared without
    regard to ASCII case; the last value and casing of a key win, at the place of its first."""
    from tessera.functions.columns import ascii_lower

    lines = text_lines(df, text).withColumn("line", F.trim(F.split_part(F.col("line"), F.lit(";"), F.lit(1))))
    head = F.when(F.col("line").rlike(r"^\[.*\]"), F.trim(F.regexp_extract("line", r"^\[(.*?)\]", 1)))
    lines = carried(lines, group, ["pos"], head, "section").where(~F.startswith("line", F.lit("[")) & F.contains(F.col("line"), F.lit("=")) & F.col("section").isNotNull())
    lines = lines.withColumn("key", F.trim(F.regexp_extract("line", r"^([^=]*)=", 1))).withColumn("value", F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))).where("key != ''")
    keyed = lines.withColumn("_s", ascii_lower(F.col("section"))).withColumn("_k", ascii_lower(F.col("key")))
    return keyed.groupBy(*group, "_s", "_k").agg(F.min_by("section", "pos").alias("section"), F.max_by("key", "pos").alias("key"), F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos")).drop("_s", "_k")


def delta_times(df: DataFrame, group: list[str], time: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("delta", F.col(time) - F.coalesce(F.lag(time).over(w), F.lit(0)))


def blocked(df: DataFrame, at: str, name: str) -> DataFrame:
    """df with `name`, a number that rises with the number `at`: about as many blocks as shuffles have partitions, of about as many rows
    each, however the numbers are spread. Equal numbers are in one block. Runs a job for the bounds, which are all that
    comes to the driver."""
    from pyspark.ml.feature import Bucketizer

    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumn("_at", F.col(at).cast("double"))
    bounds = sorted(set(own.approxQuantile("_at", [i / many for i in range(1, many)], 0.2 / many))) if many > 1 else []
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return own.withColumn(name, F.lit(0.0)).drop("_at")
    return Bucketizer(splits=splits, inputCol="_at", outputCol=name, handleInvalid="keep").transform(own).drop("_at")


def numbered(df: DataFrame, group: list[str], at: str, order: list[str], name: str) -> DataFrame:
    """df with `name`, each row's place from 1 on within its group in the order of `order`, the first of which must rise with the number `at`.

    A group is numbered in blocks, so one with a third of all rows is spread over many tasks; a table of one row per group and
    block hands on how many rows come before.
    """
    df = blocked(df, at, "_b")
    counts = df.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    counts = counts.select(*group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_earlier"))
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)))
    same = out["_b"].eqNullSafe(counts["_b"])
    for g in group:
        same &= out[g].eqNullSafe(counts[g])
    return out.join(counts, same).select(*[out[c] for c in df.columns if c != "_b"], (F.col("_n") + F.col("_earlier")).alias(name))


def nearest(left: DataFrame, right: DataFrame, at: str, to: str, key: str) -> DataFrame:
    """For each row of left the key of its nearest row of right, ties to the smaller key; whole numbers on both sides.

    Each different number of both sides is laid on one line, which is cut into blocks of about as many numbers. Within a block one window
    looks back and one, sorted the other way, ahead, over frames that end at the current row; a table of one row per block
    hands on the nearest points of other blocks. Rows of left get what was found by their number, so equal ones don't meet in one
    task before, no row meets all others, and neither side has to be small.
    """
    points = right.where(F.col(to).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(to).alias("_x")).agg(F.min(key).alias("_k"))
    asked = left.where(F.col(at).isNotNull()).select(F.col(at).alias("_x"), F.lit(None).cast(points.schema["_k"].dataType).alias("_k"))
    line = blocked(asked.unionByName(points).groupBy("_x").agg(F.min("_k").alias("_k")), "_x", "_b")
    line = line.withColumn("_p", F.when(F.col("_k").isNotNull(), F.struct("_x", "_k")))
    edges = line.groupBy("_b").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))  # one row per block
    edges = edges.select("_b", F.last("_last", True).over(up).alias("_lo"), F.last("_first", True).over(down).alias("_hi"))
    back, ahead = (Window.partitionBy("_b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_x"), F.desc("_x")))
    line = line.withColumn("_before", F.last("_p", True).over(back)).withColumn("_after", F.last("_p", True).over(ahead)).join(edges, "_b")
    far = lambda p: F.when(p.isNotNull(), F.struct(F.abs(p["_x"] - F.col("_x")).alias("distance"), p["_k"].alias(key)))
    found = line.select("_x", F.least(far(F.coalesce("_before", "_lo")), far(F.coalesce("_after", "_hi"))).alias("_n"))
    return left.join(found, F.col(at) == F.col("_x"), "left").select(*[left[c] for c in left.columns], "_n.*")
