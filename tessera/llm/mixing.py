"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Sources get targets in words; a document's expected number of copies is its source's target over the source's size. Within a
source the documents stand in the order of (size, doc_id, a hash of the text); the running sum of expected copies, shifted by one random offset
per source, is cut at whole numbers, and a document is emitted once for each whole number that its stretch crosses. The order
by size spreads the sample over all lengths, so the words taken come within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.quality import words
from tessera.llm.shared import written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = "mix-1"


def sizes(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """per_source (source, source_size) with weight and target.

    Weights repeat over the sources by code point, null last. With all targets capped at `most` times the size, sharing the
    excess by weight again and again ends where each target is min(cap, weight x level) and all sum up to `share` of all sizes;
    the level is found at once: in the order of cap / weight, those before some place are capped, and the first place whose
    level stays under the next cap / weight is it (from there on levels fall, so it is the largest that fits). These windows are over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = per_source.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    goal = F.lit(float(share)) * F.sum("source_size").over(every)
    df = df.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", (goal - F.col("capped")) / F.col("free"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    df = df.withColumn("found", F.max(fits).over(every))
    return df.select("source", "source_size", "weight", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("found"))).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """In [0, 1), from the seed and the source."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def expected_copies(target: Column, size: Column) -> Column:
    return F.when(size > 0, target / size).otherwise(F.lit(0.0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken; with carry also `row`, a struct of its columns.

    The running sum is by rank, as all documents of a source expect the same. Ranks come from one range-partitioned sort of
    (source, size, doc_id, a hash of the text): a place within the task plus the rows of the tasks before it, so no source, however large, meets in
    one task. The sorted rows are written, since they are read twice. Null texts have size 0; null sources are one source; null
    ids and repeated rows are rows like others. An empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie"), *[F.struct(*[docs[c] for c in docs.columns]).alias("row")] * carry)
    key = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("tie")]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("tie")
    rows = rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    rows = written(spark, rows, "mix")
    per = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum("size").alias("words"))
    goals = targets(per.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    base = per.select("source", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base"))
    base = base.join(goals, base["source"].eqNullSafe(goals["source"])).select(base["source"].alias("_s"), base["part"].alias("_p"), "base", "source_size", "target")
    full = rows.join(base, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    each, rank = expected_copies(F.col("target"), F.col("source_size")), F.col("base") + F.col("place")
    shift = offset(F.col("source"), seed)
    copies = (F.floor((rank + 1) * each + shift) - F.floor(rank * each + shift)).cast("long")
    full = full.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *["row"] * carry)
    return full.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    rows = mix(docs, carry=True, **how).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")
