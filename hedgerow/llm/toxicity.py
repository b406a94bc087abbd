"""Operator 10: toxicity by a factorization machine over hashed terms.

A text's terms (runs of letters and digits, lower case) are hashed to 32 bits; each hash that tells the classes apart
has a linear weight and a vector of ``FACTORS``. The score is the logistic of bias + sum of weights + the sum over pairs
of terms of the inner product of their vectors, so a pair such as an insult and a group mention counts beyond what
either does alone. All terms of a whole text count, once each.

Learning: at most ``SAMPLE`` labelled rows of each class, in the order of a hash of their ids (the same at every run),
and no more of them than have ``SAMPLE_TERMS`` distinct terms in all; of each row all terms. That bounds what the driver
gathers (4 bytes a term) and learns from (about 40 bytes a term at its peak, 320 MB in all). Scoring runs over all texts
with the model sent along, 48 bytes for each kept term. A term is kept if its document frequencies in the classes differ
by ``SIGMAS`` standard errors, so that the many words of long texts don't add up by chance; and if its co-occurrence
with another frequent term does, beyond what their own frequencies explain, so that pairs of ordinary words are learnt.

Defined results: null and empty texts have no terms and score the logistic of the bias. Rows with a null label teach
nothing; of several labels for one document each teaches. Without labels of both classes every text scores the share
of label 1 (0 without labels). Repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_batches, slices, written

FACTORS = 4
#: Standard errors by which a kept term's, or pair's, frequencies differ; share of rows that a term of such a pair is in.
SIGMAS, FREQUENT = 5.0, 0.05
#: Share of texts by which a pair's excess differs at least: groups of copies make small differences sure, not useful.
EXCESS = 0.1
#: Labelled rows of each class that the model learns from, and terms that they have together.
SAMPLE, SAMPLE_TERMS = 6000, 4_000_000
EPOCHS, RATE, LINEAR_DECAY, FACTOR_DECAY, BATCH = 12, 0.2, 1e-5, 1e-4, 64
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_SCHEMA_TERMS = "doc_id long, y int, n long, terms binary"


class Model(NamedTuple):
    bias: float
    terms: np.ndarray  # the kept hashes, ascending
    weights: np.ndarray  # [terms]
    factors: np.ndarray  # [terms, FACTORS]


def terms_of(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's terms, ascending."""
    words = set(_WORDS.findall((text or "").lower()))
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(w) for w in words), np.int64, len(words)))


def kept_places(model_terms: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Where the terms that are kept stand among the model's."""
    at = np.searchsorted(model_terms, terms)
    at[at == len(model_terms)] = 0
    return at[model_terms[at] == terms] if len(model_terms) else at[:0]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the model never learns from: crc32 of the id, as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, y, terms)`` of the rows to learn from."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    parts = [taught.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    chosen = parts[0].union(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [terms_of(t).astype("<u4") for t in b.column(1).to_pylist()]
            n = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n, pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "y", "n", "terms"])

    rows = written(in_batches(texts, terms, _SCHEMA_TERMS), "labelled-terms").withColumn("at", F.struct(F.xxhash64("doc_id").alias("key"), "doc_id", F.xxhash64("terms").alias("hash")))
    # numbers of the sample's rows alone, to see how far its terms go
    sizes = rows.select("y", "at.*", "n").distinct().toArrow().sort_by([(c, "ascending") for c in ("y", "key", "doc_id", "hash")])
    for y in (0, 1):
        own = sizes.filter(pa.compute.equal(sizes["y"], y))
        over = np.flatnonzero(np.cumsum(own["n"].to_numpy()) > SAMPLE_TERMS)
        if len(over):
            end = own.slice(int(over[0]), 1).to_pylist()[0]
            rows = rows.filter((F.col("y") != y) | (F.col("at") < F.struct(*[F.lit(end[c]).alias(c) for c in ("key", "doc_id", "hash")])))
    return rows.drop("at")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(bias: float, w: np.ndarray, v: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logit, sum of factors) of runs of places that end at ``ends``."""
    at = np.concatenate([[0], ends[:-1]])
    full = (ends > at)[:, None]
    # one zero more, so that runs at the end may be empty
    rows = np.concatenate([v[flat] if len(v) else np.zeros((len(flat), FACTORS)), np.zeros((1, FACTORS))])
    linear = np.add.reduceat(np.append(w[flat] if len(w) else np.zeros(len(flat)), 0.0), at) * full[:, 0]
    first = np.add.reduceat(rows, at, axis=0) * full
    second = np.add.reduceat((rows * rows).sum(axis=1), at) * full[:, 0]
    return bias + linear + 0.5 * ((first * first).sum(axis=1) - second), first


def _slopes(v: np.ndarray, flat: np.ndarray, lengths: np.ndarray, first: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, slopes of their weights, slopes of their factors), where ``loss`` is the slope of each run's logit."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    u, inv = np.unique(flat, return_inverse=True)
    dw = np.bincount(inv, loss[row], len(u))
    return u, dw, np.stack([np.bincount(inv, loss[row] * (first[row, k] - v[flat, k]), len(u)) for k in range(FACTORS)], axis=1)


def _shares(terms: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, share of label 1's texts, share of label 0's) of all terms, ascending."""
    every, at = np.unique(np.concatenate(terms), return_inverse=True)
    label = np.repeat(y, [len(t) for t in terms])
    return every, np.bincount(at, label, len(every)) / y.sum(), np.bincount(at, 1 - label, len(every)) / (len(y) - y.sum())


def distinctive(terms: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms whose shares of the two classes' texts differ by SIGMAS standard errors, ascending."""
    every, p1, p0 = _shares(terms, y)
    n1, n0 = y.sum(), len(y) - y.sum()
    p = (p1 * n1 + p0 * n0) / (n1 + n0)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return every[z >= SIGMAS]


def interacting(terms: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The frequent terms of which two together tell the classes apart: the excess of their joint share over the product
    of their own shares differs between the classes by SIGMAS standard errors and by EXCESS. Ascending."""
    every, p1, p0 = _shares(terms, y)
    n1, n0 = y.sum(), len(y) - y.sum()
    often = (p1 * n1 + p0 * n0) / (n1 + n0) >= FREQUENT
    every, m = every[often], int(often.sum())
    if not m:
        return every
    excess, variance = [], 0.0
    for label, p, n in ((1, p1[often], n1), (0, p0[often], n0)):
        rows, joint = np.flatnonzero(y == label), np.zeros((m, m))
        for i in range(0, len(rows), 1000):
            x = np.zeros((min(1000, len(rows) - i), m), np.float32)
            for r, t in enumerate(rows[i : i + 1000].tolist()):
                x[r, kept_places(every, terms[t])] = 1
            joint += x.T @ x
        excess.append(joint / n - np.outer(p, p))
        variance = variance + np.outer(p * (1 - p), p * (1 - p)) / n
    z = np.abs(excess[0] - excess[1]) / np.sqrt(np.maximum(variance, 1e-12))
    np.fill_diagonal(z, 0)
    return every[((z >= SIGMAS) & (np.abs(excess[0] - excess[1]) >= EXCESS)).any(axis=1)]


def fit(terms: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss with both classes weighing the same, by AdaGrad in small batches."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    kept = np.union1d(distinctive(terms, y), interacting(terms, y))
    terms = [kept_places(kept, t) for t in terms]
    rng, n = np.random.default_rng(seed), len(kept)
    w, v = np.zeros(n), rng.normal(0, 0.05, (n, FACTORS))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bias, gb, gw, gv = 0.0, 1e-8, np.full(n, 1e-8), np.full((n, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            rows = order[i : i + BATCH]
            flat = np.concatenate([terms[r] for r in rows]).astype(np.int64)
            lengths = np.array([len(terms[r]) for r in rows])
            z, first = _sums(bias, w, v, flat, np.cumsum(lengths))
            loss = (_sigmoid(z) - y[rows]) * weight[rows] / len(rows)
            u, dw, dv = _slopes(v, flat, lengths, first, loss)
            dw, dv, db = dw + LINEAR_DECAY * w[u], dv + FACTOR_DECAY * v[u], loss.sum()
            gb += db * db
            gw[u] += dw * dw
            gv[u] += dv * dv
            bias -= RATE * db / np.sqrt(gb)
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= RATE * dv / np.sqrt(gv[u])
    return Model(float(bias), kept, w, v)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of a bounded sample of the labelled rows that aren't held out."""
    rows = sample(docs, labels, label).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("n", "ascending"), ("terms", "ascending")])
    return fit([np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in rows["terms"]], rows["y"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) with ``score``: every whole text's probability of label 1."""
    names = [c for c in docs.columns if c != "score"]
    narrow = docs.select(*[docs[f"`{c}`"] for c in names])
    schema = StructType([*narrow.schema.fields, StructField("score", DoubleType())])
    col = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [kept_places(model.terms, terms_of(t)) for t in b.column(col).to_pylist()]
            z = _sums(model.bias, model.weights, model.factors, np.concatenate(found), np.cumsum([len(x) for x in found]))[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_sigmoid(z), pa.float64())], schema.names)

    return in_batches(narrow, run, schema)
