"""Toxicity by multiple-instance learning: only documents have labels, sentences are scored.

A sentence's chance is the logistic of a bias and the weights of the features that it has; a document's score is one minus the
product of its sentences' complements (noisy-or), and the likelihood of the documents' labels trains the weights. Features are
a sentence's different words (letters, digits and all beyond ASCII; A-Z in lower case) and the words' first 4 to 8 bytes.
Sentences end at . ! ? and line ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import _POWERS, MULTIPLIER, NOT_ALNUM, U64, Words, mix, slices

PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows that are fitted at most, and the bytes of all their texts: what the driver holds is bounded by these, whatever the
#: lengths. Pairs of a sentence and a feature that are fitted in one step.
SAMPLE, SAMPLE_BYTES, STEP = 8_000, 64 << 20, 1 << 20
LEAST_DOCS, COMMON, TOXIC_WEIGHT = 5, 0.25, 2.0
LEAST = 0.7
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.features & U64((1 << 20) - 1)] = True

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are features, and which ones."""
        maybe = np.flatnonzero(self.bits[x & U64((1 << 20) - 1)])
        if not len(maybe) or not len(self.features):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.features, x[maybe]), len(self.features) - 1)
        found = self.features[at] == x[maybe]
        return maybe[found], at[found]


def sentences(w: Words) -> np.ndarray:
    """For each word the number of its sentence in the slice, counting only sentences with words."""
    ends = np.cumsum(_END[w.data])
    own = ends[w.starts] + w.document * (len(w.data) + 1) if len(w) else np.zeros(0, np.int64)
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    return np.cumsum(new) - 1


def feature_hashes(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and hashes of a feature of theirs, kind by kind."""
    yield np.arange(len(w)), w.hashes
    up, down = _POWERS.get(len(w.data) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum((w.data.astype(U64) + U64(1)) * up[: len(w.data)])])
    for n in PREFIXES:
        long = np.flatnonzero(w.ends - w.starts > n)
        s = w.starts[long]
        yield long, mix((total[s + n] - total[s]) * down[s] + U64((n * int(MULTIPLIER) + 0x7F4A7C1500) & ((1 << 64) - 1)))


def pairs_of(w: Words, model: Model | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (sentence, feature) pairs, and for each sentence its document. A feature is its hash, or its place in the model."""
    s = sentences(w)
    count = int(s[-1]) + 1 if len(s) else 0
    doc = np.zeros(count, np.int64)
    doc[s] = w.document
    a, b = [], []
    for at, h in feature_hashes(w):
        if model is None:
            a.append(s[at])
            b.append(h)
        else:
            found, which = model.places(h)
            a.append(s[at[found]])
            b.append(which)
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], doc


def chances(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's chance and its document."""
    a, b, doc = pairs_of(w, model)
    z = np.bincount(a, model.weights[b], len(doc)) + model.bias if len(a) else np.full(len(doc), model.bias)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), doc


def noisy_or(p: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), documents)) if documents else np.zeros(0)


def _fit(sent: np.ndarray, feat: np.ndarray, doc: np.ndarray, y: np.ndarray, k: int, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows at once; the same rows give the same weights."""
    w, m, v, rate = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1), 0.15
    w[k] = -5.0
    for t in range(1, rounds + 1):
        z = np.full(len(doc), w[k])
        for at in range(0, len(sent), STEP):  # pairs stand in the order of sentences
            part, first = slice(at, at + STEP), sent[at]
            own = np.bincount(sent[part] - first, w[feat[part]])
            z[first : first + len(own)] += own
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of no toxic sentence
        some = np.maximum(-np.expm1(none), 1e-9)
        g = p * np.where(y[doc] > 0, -TOXIC_WEIGHT * np.exp(none[doc]) / some[doc], 1.0)
        grad = np.zeros(k + 1)
        for at in range(0, len(sent), STEP):
            grad[:k] += np.bincount(feat[at : at + STEP], g[sent[at : at + STEP]], k)
        grad[k] = g.sum()
        grad /= len(y)
        grad[:k] += decay * w[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:k] = np.maximum(w[:k], 0)  # a feature can only speak for toxicity
    return w[:k], float(w[k])


def train(rows: pa.Table) -> Model:
    """From a bounded table of (text, toxic). Features of fewer than LEAST_DOCS documents, or of more than COMMON of them, are left
    out; after a first fit the weights near nought go, and the others are fitted again.

    Memory: texts are taken some megabytes at a time, once to count features by document and once to keep the pairs of a sentence
    and a feature that was not left out, as 32-bit numbers.
    """
    y = np.array(rows.column("toxic").to_pylist() if len(rows) else [], float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, U64), np.zeros(0), -30.0)
    batches = [part for batch in rows.to_batches() for part in slices(batch, "text", 1 << 20)]
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    for part in batches:
        sent, h, doc = pairs_of(Words(part.column("text"), NOT_ALNUM, lower=True))
        order = np.lexsort((doc[sent], h))
        hs, ds = h[order], doc[sent][order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        counts.append(np.unique(hs[new], return_counts=True))
        if len(counts) == 8:
            counts = [_merged(counts)]
    keys, docs_with = _merged(counts)
    used = np.flatnonzero((docs_with >= LEAST_DOCS) & (docs_with <= COMMON * len(y)))
    keys = keys[used]  # sorted, as _merged() gives them
    sents, feats, docs = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    model, at_sent, at_doc = Model(keys, np.zeros(len(keys)), 0.0), 0, 0
    for part in batches:
        sent, feat, doc = pairs_of(Words(part.column("text"), NOT_ALNUM, lower=True), model)
        sents.append((sent + at_sent).astype(np.int32))
        feats.append(feat.astype(np.int32))
        docs.append((doc + at_doc).astype(np.int32))
        at_sent, at_doc = at_sent + len(doc), at_doc + part.num_rows
    sent, feat, doc = np.concatenate(sents), np.concatenate(feats), np.concatenate(docs)
    weights, bias = _fit(sent, feat, doc, y, len(keys), 60, 1e-4)
    keep = np.abs(weights) >= 0.4
    place, known = np.cumsum(keep) - 1, keep[feat]
    sent, feat, keys = sent[known], place[feat[known]], keys[keep]
    weights, bias = _fit(sent, feat, doc, y, len(keys), 200, 2e-5)
    return Model(keys, weights, bias)


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in counts]), len(keys)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learned from: crc32 of the id as text leaves 1 by 3. False for a null id, which isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(rows: DataFrame) -> Model:
    """train() over sampled rows (text, toxic), in one task: it takes the memory that the sample's bounds allow, and only features and weights
    come to the driver."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("toxic", pa.int64())])))
        features = pa.array([None, *model.features.view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([features, pa.array([model.bias, *model.weights.tolist()], pa.float64())], names=["feature", "weight"])

    found = rows.coalesce(1).mapInArrow(fit, "feature long, weight double").toArrow()
    if not len(found):
        return Model(np.zeros(0, U64), np.zeros(0), -30.0)
    own = found.column("feature").is_valid()
    features = found.column("feature").filter(own).to_numpy().view(U64)
    order = np.argsort(features)
    return Model(features[order], found.column("weight").filter(own).to_numpy()[order], found.column("weight").filter(found.column("feature").is_null())[0].as_py())


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most `rows` labelled documents that aren't held out, the first by a hash of the id, whole texts and no more of them than
    come to `most_bytes`. A null text isn't learned from; a doc_id with several labels counts as toxic if one says so."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so it is small enough to be sent to every task
    fit = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    order = ["h", "doc_id", "text"]
    fit = fit.orderBy(*order).limit(rows).withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order)))  # of `rows` rows
    return fit.where(F.col("upto") <= most_bytes).select("text", F.col("toxic").cast("long").alias("toxic"))


def scored(docs: DataFrame, model: Model, least: float = LEAST, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """docs (doc_id, text and any others) with held_out, score and predicted, or what `names` calls them; columns of those names are
    replaced. A null text, or one without words, has score 0. Repeated rows and null ids are rows like others; an empty table
    gives no row."""
    held, score_name, predicted = names
    docs = docs.drop(*names).withColumn(held, held_out(F.col("doc_id")))
    schema = docs.withColumn(score_name, F.lit(0.0)).withColumn(predicted, F.lit(0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p, doc = chances(model, Words(part.column("text"), NOT_ALNUM, lower=True))
                s = noisy_or(p, doc, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= least).astype(np.int32))], names=[*part.schema.names, score_name, predicted])

    return docs.mapInArrow(score, schema)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (counted from 0 among those with words), chance and the sentence, of those with a chance of `least`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), NOT_ALNUM, lower=True)
                p, doc = chances(model, w)
                s, keys = sentences(w), part.column("doc_id").to_pylist()
                first = np.searchsorted(doc, np.arange(part.num_rows))
                rows = []
                for k in np.flatnonzero(p >= least).tolist():
                    a, b = np.searchsorted(s, [k, k + 1])
                    text = w.raw[w.starts[a] : w.ends[b - 1]].tobytes().decode(errors="replace")
                    rows.append((keys[doc[k]], int(k - first[doc[k]]), float(p[k]), text))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "sentence", "chance", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, sentence long, chance double, text string")
