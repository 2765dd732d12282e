"""Near-duplicates by b-bit MinHash.

Documents with equal shingle sets are one class, a node. Of each one signature is kept: PERMUTATIONS minima, banded for candidate
pairs, and of 128 minima the low two bits, packed into four numbers. Of the nodes that meet in a band's bucket the one that meets
the most others, over all its buckets, is the centre: a group of near copies has few centres, and often one. Two steps:

1. Stars: each node is compared with the centres of its buckets. A pair whose sizes allow the similarity, and whose similarity by
   bit counts, corrected for chance agreement, isn't six deviations below it, is confirmed on the full sets. Links make components.
2. Rest: two nodes that meet in a bucket are both in its centre's group, so a group whose nodes lie in different components is
   looked at once more. Its nodes are compared by their packed bits inside a task; only nodes come out, those that have a plausible
   partner in another component, and of these the full sets are compared inside a task, which gives links of a spanning forest.

So no link between components is left untested, and pairs are never rows but for those of stars. Groups of any size are dealt in
blocks: a task holds two blocks of a group, and each pair of blocks meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.shared import drop_written, written
from tessera.llm.words import U64, Words, mix, slices, windows

SHINGLE, PERCENT, BANDS, BAND_ROWS = 5, 80, 32, 5
PERMUTATIONS, PACKED = BANDS * BAND_ROWS, 128
#: Nodes of a block when bits are compared; when sets are, nodes and the numbers of their sets.
BITS_BLOCK, SETS_BLOCK, SETS_NUMBERS = 2048, 512, 1 << 20
#: Of the filter of wanted ids: the most bits, as a power of two, and odd factors, one for each place.
FILTER_BITS, FILTER_HASHES = 26, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x5851F42D4C957F2D)


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return x[:PERMUTATIONS] | U64(1), x[PERMUTATIONS:]


_A, _B = _parameters()


def minima(x: np.ndarray) -> np.ndarray:
    """The least of each of PERMUTATIONS hashes over a set of 64-bit numbers, as 32-bit numbers."""
    x = x & U64(0xFFFFFFFF)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, U64)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        np.minimum(out, ((_A[:, None] * part[None, :] + _B[:, None]) >> U64(32)).min(1), out=out)
    return out


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; of fewer words, one for the whole sequence; empty without words."""
    w = Words(texts, lower=True)
    h = windows(w.hashes, shingle)
    out = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(h[a : b - shingle + 1]))
        elif b > a:
            out.append(mix(windows(w.hashes[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def set_sums(x: np.ndarray) -> list[int]:
    """Two 64-bit sums that tell sets apart."""
    return _signed(np.array([mix(x).sum(dtype=U64), mix(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)])).tolist()


SIGNATURE = "doc_id long, text_key long, n_shingles long, f1 long, f2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row of docs: a hash of the text, its set's size and sums, and of sets that aren't empty the hashes of the bands and the two
    low bits of the first PACKED minima."""
    place = U64(1) << np.arange(64, dtype=U64)
    names = [x.split()[0] for x in SIGNATURE.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for x in shingle_sets(part.column("text"), shingle):
                    if not len(x):
                        rows.append((0, 0, 0, None, None, None, None, None))
                        continue
                    m = minima(x)
                    bands = np.zeros(BANDS, U64)
                    for k in range(BAND_ROWS):
                        bands = mix(bands * U64(0xD6E8FEB86659FD93) + m.reshape(BANDS, BAND_ROWS)[:, k] + U64(1))
                    bands = mix(bands + np.arange(BANDS, dtype=U64))
                    bits = [((m[i : i + 64] >> U64(j)) & U64(1)) @ place for j in (0, 1) for i in (0, 64)]
                    rows.append((len(x), *set_sums(x), _signed(bands).tolist(), *_signed(np.array(bits)).tolist()))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.int64()] * 4
                columns = [part.column("doc_id"), part.column("text_key"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _rows(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(sign, SIGNATURE)


def estimated(a: str, b: str) -> Column:
    """Similarity of two packed signatures: agreeing pairs of bits are counted, and the quarter that agree by chance taken off."""
    bit = lambda k: F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))
    unlike = F.bit_count(bit("s0").bitwiseOR(bit("s2"))) + F.bit_count(bit("s1").bitwiseOR(bit("s3")))
    return (1 - unlike / F.lit(float(PACKED)) - 0.25) / 0.75


def least_estimate(percent: int) -> float:
    """Six deviations below the similarity."""
    j = percent / 100
    p = j + (1 - j) / 4
    return j - 6 * (p * (1 - p) / PACKED) ** 0.5 / 0.75


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and packed bits don't rule out the similarity."""
    own = classes.select("node", F.struct("n", "s0", "s1", "s2", "s3").alias("x"))
    df = pairs.join(own.select(F.col("node").alias("b"), F.col("x").alias("y")), "b").join(own.select(F.col("node").alias("a"), "x"), "a")
    fits = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return df.where(fits & (estimated("x", "y") >= least_estimate(percent))).select("a", "b")


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Of each id, FILTER_HASHES places among 1 << bits."""
    x = mix(ids.view(U64))
    return [(x * U64(odd)) >> U64(64 - bits) for odd in FILTER_HASHES]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of a table's only column, ids: 8 to 16 bits each while they are no more than FILTER_BITS, words of 64 bits. It
    never misses an id; of others it takes some for one, 2 % at 8 bits each and more as they get fewer."""
    bits = min(FILTER_BITS, max(10, (8 * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << bits - 6, U64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(words, at >> U64(6), U64(1) << (at & U64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    found = ids.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, U64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return words


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids an id_filter() has."""
    out = np.ones(len(ids), bool)
    for at in _places(ids, len(words).bit_length() + 5):
        out &= (words[at >> U64(6)] >> (at & U64(63))) & U64(1) > 0
    return out


def _sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """A written table of node and its shingles' sorted hashes, 8 bytes each, for the nodes of `wanted`: made again from a text
    of the class, which its least doc_id and the set's sums tell. Texts are read where they lie and don't move: a filter of the
    wanted ids leaves few others, and the join takes those away."""
    nodes = classes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("doc_id"), "f1", "f2")
    nodes = written(spark, nodes, "wanted")
    words, names = id_filter(nodes.select("doc_id")), ["doc_id", "f1", "f2", "shingles"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(passes(words, batch.column("doc_id").to_numpy()))), "text"):
                found = shingle_sets(part.column("text"), shingle)
                sums = [set_sums(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1)), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=names)

    made = _rows(docs).where("doc_id is not null").mapInArrow(make, "doc_id long, f1 long, f2 long, shingles binary")
    out = written(spark, made.join(nodes, names[:3]).dropDuplicates(names[:3]).select("node", "shingles"), "sets")  # these three tell the node
    drop_written(spark, nodes)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those with 100 x shared >= percent x united shingles."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, keep, held = batch.column("a").to_pylist(), [], (None, None)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                if held[0] != a[i]:
                    held = a[i], np.frombuffer(x.as_buffer(), "<u8")
                own, other = held[1], np.frombuffer(y.as_buffer(), "<u8")
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows (a: the group, b: a node of it) dealt so that each pair of a group's blocks is in one task: with own (the node's block) and
    p <= q, the two that meet."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("p", F.least("own", "met")).withColumn("q", F.greatest("own", "met")).drop("blocks", "met")
    return rows.repartition("a", "p", "q").sortWithinPartitions("a", "p", "q")


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups (a, p, q) of sorted rows, several at a time up to about `most` rows, with one past the end of each row's group."""
    held: list[pa.RecordBatch] = []

    def ready(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        t = pa.Table.from_batches(held)
        keys = np.stack([t.column(k).to_numpy() for k in ("a", "p", "q")], 1)
        edges = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)] * last).astype(np.int64)
        held.clear()
        if len(edges):
            ends = np.repeat(edges, np.diff(edges, prepend=0))
            yield t.slice(0, int(edges[-1])), ends
        if (rest := t.slice(int(edges[-1]) if len(edges) else 0)).num_rows:
            held.extend(rest.to_batches())

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield from ready(False)
    if held:
        yield from ready(True)


def _pairs_within(ends: np.ndarray, own: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of rows of the same group, in steps: j = i + 1, i + 2, ... Where two blocks meet, those of one block don't count."""
    i, step = np.arange(len(ends)), 1
    while len(i := i[i + step < ends[i]]):
        j = i + step
        use = diagonal[i] | (own[i] != own[j])
        yield i[use], j[use]
        step += 1


def _sifted(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nodes of groups (a, b, component, n, s0 to s3) that have a plausible partner in another component."""
    unlike = PACKED * 0.75 * (1 - least_estimate(percent))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in _groups(batches, 20_000):
            c, n, own, p, q = (t.column(k).to_numpy() for k in ("component", "n", "own", "p", "q"))
            s = [t.column(f"s{k}").to_numpy().view(U64) for k in range(4)]
            found = np.zeros(len(ends), bool)
            for i, j in _pairs_within(ends, own, p == q):
                use = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[use], j[use]
                if len(i):
                    x = np.bitwise_count((s[0][i] ^ s[0][j]) | (s[2][i] ^ s[2][j])).astype(np.int32) + np.bitwise_count((s[1][i] ^ s[1][j]) | (s[3][i] ^ s[3][j]))
                    use = x <= unlike
                    found[i[use]] = found[j[use]] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(t.column(k).to_numpy()[found]) for k in ("a", "b", "component", "n")], names=["a", "b", "component", "n"])

    return sift


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many numbers each two sets have in common, by products of 0/1 matrices, `width` numbers at a time."""
    which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = many > 1  # others are shared by none
    place = np.cumsum(both) - 1
    which, number = which[both[number]], place[number[both[number]]]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact below 2^24
    order = np.argsort(number, kind="stable")
    which, number = which[order], number[order]
    for at in range(0, int(both.sum()), width):
        a, b = np.searchsorted(number, [at, at + width])
        m = np.zeros((len(sets), min(width, int(both.sum()) - at)), np.float32)
        m[which[a:b], number[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _linked(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of groups (a, b, component, shingles) links (a, b) of nodes, as many as join the components that links join."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ends in _groups(batches, 1):
            first = 0
            while first < len(ends):
                end = int(ends[first])
                part = t.slice(first, end - first)
                b, c, own, p, q = (part.column(k).to_numpy() for k in ("b", "component", "own", "p", "q"))
                first = end
                sets = [np.frombuffer(x.as_buffer(), "<u8") for x in part.column("shingles")]
                size = np.array([len(x) for x in sets])
                both = shared_counts(sets)
                like = 100 * both >= percent * (size[:, None] + size[None, :] - both)
                like &= c[:, None] != c[None, :]
                if p[0] != q[0]:
                    like &= own[:, None] != own[None, :]
                up: dict[int, int] = {}

                def root(x: int, up: dict[int, int] = up) -> int:
                    while (y := up.get(x, x)) != x:
                        up[x] = up.get(y, y)
                        x = y
                    return x

                out = []
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(like, 1))), strict=True):
                    x, y = root(int(c[i])), root(int(c[j]))
                    if x != y:
                        up[x] = y
                        out.append((int(b[i]), int(b[j])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return link


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, with_key: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id that links lead to) and kept; with_key also
    text_key, xxhash64 of the text, and group, which tells components of one component_id apart where ids repeat.

    Words are of the text with A-Z in lower case. Texts without words have an empty set and no link. A null doc_id has no link
    and is kept, component_id null. Rows that repeat a doc_id with different texts are placed each by its own text. Other columns
    are ignored; whole texts count, however long. An empty table gives no row. Jobs run while the result is made.
    """
    signed = written(spark, signatures(docs, shingle), "signatures")
    live = signed.where("n_shingles > 0 and doc_id is not null")
    same = live.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("bands", "s0", "s1", "s2", "s3")])
    classes = written(spark, same.withColumn("node", F.monotonically_increasing_id()), "classes")
    places = classes.select(F.explode("bands").alias("key"), "node")
    met = places.join(places.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    met = met.join(met.groupBy("node").agg(F.sum("size").alias("meets")), "node").select("key", "node", "meets")
    met = written(spark, met, "buckets")
    rank = F.shiftleft(F.least("meets", F.lit((1 << 31) - 1)), 32).bitwiseOR(F.xxhash64("node").bitwiseAND(0xFFFFFFFF))
    centres = met.groupBy("key").agg(F.max_by("node", rank).alias("a"))
    stars = written(spark, met.join(centres, "key").where("node != a").select("a", F.col("node").alias("b")).distinct(), "stars")
    drop_written(spark, met)
    pairs = written(spark, _plausible(stars, classes, percent), "pairs")
    sets = _sets(spark, docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, shingle)
    links = written(spark, _confirmed(pairs, sets, percent), "links")
    found = components(spark, links)
    for x in (pairs, sets, links):
        drop_written(spark, x)

    placed = stars.join(found.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    apart = placed.groupBy("a").agg(F.count("*").alias("many"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("a", "many")
    bits = placed.join(classes.select(F.col("node").alias("b"), "n", "s0", "s1", "s2", "s3"), "b").join(apart, "a")
    bits = _in_blocks(bits, F.ceil(F.col("many") / F.lit(BITS_BLOCK))).drop("many")
    near = written(spark, bits.mapInArrow(_sifted(percent), "a long, b long, component long, n long").distinct(), "near")
    drop_written(spark, stars)
    if not near.isEmpty():
        sets = _sets(spark, docs, near.select(F.col("b").alias("node")), classes, shingle)
        sums = near.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / F.lit(SETS_BLOCK)), F.ceil(F.sum("n") / F.lit(SETS_NUMBERS))).alias("many"))
        full = near.join(sets.withColumnRenamed("node", "b"), "b").join(sums, "a")
        full = _in_blocks(full, F.col("many")).select("a", "p", "q", "own", "b", "component", "shingles")
        links = written(spark, full.mapInArrow(_linked(percent), "a long, b long"), "links")
        if not links.isEmpty():
            found = components(spark, found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))
        drop_written(spark, sets)
    drop_written(spark, near)

    least = found.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = classes.select("f1", "f2", "node", "least").join(found.join(least, "component"), "node", "left")
    nodes = nodes.select("f1", "f2", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "node").alias("group"))
    out = signed.select("doc_id", "text_key", "n_shingles", "f1", "f2").join(nodes, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *["text_key", F.coalesce("group", "text_key").alias("group")] * with_key)
