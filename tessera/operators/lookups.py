"""Lookups and summaries of decoded rows: what a format's own accessors answer, as DataFrames.

Each takes rows of `tessera.sources.reading.decoded` (path and the format's columns; rows with `_error` don't count) and answers
for all files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import ascii_lower, name_hash, whole_div

# Types of a model's top chunks.
MESH, HIERARCHY, ANIMATION, HLOD = 0x00, 0x100, 0x200, 0x700
#: Fixed value: ticks a second of the drivers' clock.
DRIVER_HZ = 560.0


def _good(rows: DataFrame) -> DataFrame:
    return rows.where("_error is null").drop("_error") if "_error" in rows.columns else rows


def _first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def by_hash(entries: DataFrame, crc: Column) -> DataFrame:
    """Per archive the entry with that hash; of several the one of the least index."""
    return _first(_good(entries).where(F.col("crc") == crc), ["path"], "idx")


def by_name(entries: DataFrame, name: Column) -> DataFrame:
    """Per archive the first entry of that name, without regard to case; entries by hash are asked by the name's."""
    named = F.when(F.col("name").isNotNull(), ascii_lower(F.col("name")) == ascii_lower(name)).otherwise(F.col("crc") == name_hash(name)) if "crc" in entries.columns else ascii_lower(F.col("name")) == ascii_lower(name)
    return _first(_good(entries).where(named), ["path"], "idx")


def by_ordinal(entries: DataFrame, idx: int) -> DataFrame:
    return _good(entries).where(F.col("idx") == idx)


def ini_value(rows: DataFrame, section: Column, key: Column) -> DataFrame:
    """path and value, without regard to ASCII case."""
    return _good(rows).where((ascii_lower(F.col("section")) == ascii_lower(section)) & (ascii_lower(F.col("key")) == ascii_lower(key))).select("path", "value")


def has_section(rows: DataFrame, section: Column) -> DataFrame:
    """path and has, of each file with rows."""
    return _good(rows).groupBy("path").agg(F.bool_or(ascii_lower(F.col("section")) == ascii_lower(section)).alias("has"))


def section_sizes(rows: DataFrame) -> DataFrame:
    """path, section, keys: how many keys each section has."""
    return _good(rows).groupBy("path", ascii_lower(F.col("section")).alias("section")).agg(F.count("*").alias("keys"))


def string_value(rows: DataFrame, id: Column) -> DataFrame:
    """The first string of that id, without regard to case."""
    return _first(_good(rows).where(ascii_lower(F.col("id")) == ascii_lower(id)), ["path"], "pos")


def window_property(rows: DataFrame, key: Column) -> DataFrame:
    """Per window the first property of that name, without regard to case."""
    return _first(_good(rows).where(ascii_lower(F.col("key")) == ascii_lower(key)), ["path", "node_id"], "ordinal").select("path", "node_id", "value")


def child(nodes: DataFrame, key: Column) -> DataFrame:
    """Of each node the first child of that name, as it is written."""
    return _first(_good(nodes).where((F.col("key") == key) & F.col("parent_id").isNotNull()), ["path", "parent_id"], "ordinal")


def chunks_named(chunks: DataFrame, name: Column) -> DataFrame:
    return _good(chunks).where(F.col("name") == name)


def chunk(chunks: DataFrame, name: Column) -> DataFrame:
    """The first chunk of that name, as it is written."""
    return _first(chunks_named(chunks, name), ["path"], "idx")


def top_chunks(rows: DataFrame, kind: int) -> DataFrame:
    """A model's top chunks of a type: MESH, ANIMATION, ..."""
    return _good(rows).where((F.col("depth") == 0) & (F.col("chunk_type") == kind))


def first_top_chunk(rows: DataFrame, kind: int) -> DataFrame:
    """The first one: HIERARCHY, HLOD, ..."""
    return _first(top_chunks(rows, kind), ["path"], "ordinal")


def child_chunks(rows: DataFrame, kind: int) -> DataFrame:
    """Chunks of a type inside others, with parent_id."""
    return _good(rows).where((F.col("chunk_type") == kind) & F.col("parent_id").isNotNull())


def first_child_chunk(rows: DataFrame, kind: int) -> DataFrame:
    return _first(child_chunks(rows, kind), ["path", "parent_id"], "ordinal")


def cell(grid: DataFrame, x: int, y: int) -> DataFrame:
    """The cell of a place; no row outside of the grid."""
    return _good(grid).where((F.col("x") == x) & (F.col("y") == y))


def transform(matrices: DataFrame, frame: int, section: int) -> DataFrame:
    return _good(matrices).where((F.col("frame") == frame) & (F.col("section") == section)).select("path", "matrix")


def waypoint_count(rows: DataFrame) -> DataFrame:
    """path and waypoints: the keys of [Waypoints]; 0 without that section."""
    return _good(rows).groupBy("path").agg(F.count_if(ascii_lower(F.col("section")) == "waypoints").alias("waypoints"))


def window_count(rows: DataFrame) -> DataFrame:
    """path and windows, nested ones included."""
    return _good(rows).groupBy("path").agg(F.count_distinct("node_id").alias("windows"))


def midi_summary(events: DataFrame) -> DataFrame:
    """path, events over all tracks, and the channels that they use, sorted."""
    return _good(events).groupBy("path").agg(F.count("*").alias("events"), F.array_sort(F.collect_set("channel")).alias("channels"))


def register_summary(rows: DataFrame) -> DataFrame:
    """path, writes (pairs of register and value in all songs) and seconds: writes x speed of the first song / DRIVER_HZ; 0 without
    writes, null if a song is a program of tracks, or the first has no speed."""
    songs = _good(rows).where("kind = 'song'")
    per = songs.groupBy("path").agg(F.coalesce(F.sum(whole_div(F.octet_length("writes"), F.lit(2))), F.lit(0)).cast("long").alias("writes"), F.min_by("speed", "idx").alias("speed"), F.bool_or(F.col("program").isNotNull()).alias("opaque"))
    seconds = F.when(F.col("opaque"), None).when(F.col("writes") == 0, 0.0).otherwise(F.col("writes") * F.col("speed") / F.lit(DRIVER_HZ))
    return per.select("path", "writes", seconds.alias("seconds"))


def name_stats(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """One row: resolved (keys with one value) and ambiguous (keys with several)."""
    per = candidates.where(F.col(value).isNotNull()).groupBy(key).agg((F.min(value) == F.max(value)).alias("one"))
    return per.agg(F.count_if("one").alias("resolved"), F.count_if(~F.col("one")).alias("ambiguous"))


def frame_at(nanos: Column, fps: Column, frames: Column) -> Column:
    """The frame that is shown at a time: the last one from its end on; null without frames."""
    return F.when(frames > 0, F.least(whole_div(nanos * F.greatest(fps, F.lit(1)), F.lit(1_000_000_000)), frames - 1))


def clip_nanos(fps: Column, frames: Column) -> Column:
    """A clip's length in nanoseconds, cut to whole ones."""
    return whole_div(frames.cast("long") * 1_000_000_000, F.greatest(fps, F.lit(1)).cast("long"))

