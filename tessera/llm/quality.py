"""Quality rules: counts that mark broken texts, and a likelihood ratio of hashed n-grams. DataFrame functions only.

The ratio compares two multinomials over `buckets` hashed 1- and 2-grams: one of trusted documents, one of the whole corpus.
A document's score is the mean over its n-grams of log(trusted / corpus), in millionths and summed as whole numbers, so that
no order of summation changes it. Every document with a score of at least `least` passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: \x20 and \x09 to \x0D
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BUCKETS, SMOOTHING, LEAST, TRUSTED = 1 << 16, 0.5, -0.25, 20_000
WINDOW = 5


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ as an array; none of a null or empty text."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def hashed(w: Column) -> Column:
    """A 64-bit hash of each word; longer grams are hashed from these."""
    return F.transform(w, lambda x: F.xxhash64(x))


def joined(a: Column, b: Column, apart: int, many: Column) -> Column:
    """Hashes of a's elements, each with b's element `apart` places further on; `many` of them, or none."""
    many = F.greatest(many, F.lit(0))
    return F.zip_with(F.slice(a, 1, many), F.slice(b, 1 + apart, many), lambda x, y: F.xxhash64(x, y))


def gram_buckets(h: Column, buckets: int = BUCKETS, two: Column | None = None) -> Column:
    """Of an array of word hashes: the bucket of each word and of each two neighbouring words (after the words' own); `two` are the
    latter's hashes, if they are known."""
    two = joined(h, h, 1, F.size(h) - 1) if two is None else two
    return F.transform(F.concat(h, two), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def with_rules(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with _h and _two (hashes of the words, and of two neighbours), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as one without words. Lines are parted by \\n and compared as they are; lines without a word don't count.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    df = docs.withColumn("_w", words(t)).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).withColumn("_h", hashed(F.col("_w"))).drop("_w")
    df = df.withColumn("n_symbols", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"))
    df = df.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    n, h = F.size("_h"), F.col("_h")
    df = df.withColumn("_two", joined(h, h, 1, n - 1))
    # Hashes of runs by doubling: those of 1, 2, 4, ... words, and of the window from the powers of two that it is the sum of.
    have, size, parts = h, 1, []
    while size <= window:
        if window & size:
            parts.append((have, size))
        have, size = (F.col("_two") if size == 1 else joined(have, have, size, n - 2 * size + 1)), 2 * size
    run, length = parts[-1]
    for part, size in reversed(parts[:-1]):
        run, length = joined(run, part, length, n - length - size + 1), length + size
    df = df.withColumn("_r", run)
    r = F.col("_r")
    # Places whose run has an equal one: sorted by hash and place, a neighbour has the same hash.
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(r)) < F.size(r), F.array_sort(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("_s")
    df = df.withColumn("_p", F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i + window - a["end"])).alias("n"), (i + window).alias("end"))
    df = df.withColumn("n_repeat_words", F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"]).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_r", "_s", "_p")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, most: int = TRUSTED) -> DataFrame:
    """One row with `ratios`, millionths of log(trusted / corpus) per bucket.

    Corpus counts are of all documents. The trusted ones are the `most` ids of `trusted` (doc_id) that come first by a hash, so
    what is broadcast is bounded. Both counts are made in one pass, in each task first.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = F.broadcast(ids.withColumn("_t", F.lit(1)))
    grams = docs.select("doc_id", hashed(words(F.coalesce(F.col("text"), F.lit("")))).alias("_h")).join(ids, "doc_id", "left")
    grams = grams.select(F.coalesce("_t", F.lit(0)).alias("_t"), F.explode(gram_buckets(F.col("_h"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_t").alias("own"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))  # `buckets` rows, a parameter
    full = every.join(counts, "bucket", "left").na.fill(0, ["raw", "own"])
    one = full.agg(F.sum("raw").alias("raw"), F.sum("own").alias("own"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "own"))).alias("per"))
    a = F.lit(float(smoothing))
    share = lambda c, total: F.log((c + a) / (total + a * F.lit(float(buckets))))
    ratio = lambda x: F.round(1e6 * (share(x["own"], F.col("own")) - share(x["raw"], F.col("raw")))).cast("long")
    return one.select(F.transform("per", ratio).alias("ratios"))


def quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, least: float = LEAST, most: int = TRUSTED) -> DataFrame:
    """docs with the rules' counts, base_failed, score and kept; every row stays, repeated ones and null ids too.

    Columns of docs with the names of results are replaced. A text without words has score 0 and fails the rules. Without
    trusted ids or documents all ratios come from the smoothing alone.
    """
    ratios = log_ratios(docs, trusted, buckets, smoothing, most)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    df = with_rules(docs.drop(*made)).withColumn("_g", gram_buckets(F.col("_h"), buckets, F.col("_two")))
    df = df.withColumn("_r", ratios.scalar())
    total = F.aggregate("_g", F.lit(0).cast("long"), lambda a, b: a + F.get(F.col("_r"), b))
    score = F.when(F.size("_g") > 0, total / F.size("_g") / 1e6).otherwise(F.lit(0.0))
    df = df.withColumn("score", score)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).drop("_h", "_two", "_g", "_r")
