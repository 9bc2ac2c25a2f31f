"""Toxicity: a factorization machine over hashed terms.

Besides one weight for each term the model has a short vector for each, whose inner products are the weights of pairs
of terms in one text, so an insult beside a group mention can weigh more than their sum, also where neither weighs
anything alone. Linear weights are learned by follow-the-regularised-leader with an L1 penalty, which leaves neutral
words at exactly 0. Vectors are learned for every term of enough labelled rows, whatever its weight; after each step
they are shortened by a fixed amount of gradient, so those that no pair of terms needs end at exactly 0. The model's
size is fixed by the number of buckets and it is broadcast.

Cases: null and empty texts get the score of a text without terms. Very long texts are read whole, and each of their
terms counts once. A column named score is replaced; others, of any name, pass through. Without any labelled row every score is 0.
Repeated rows score alike. Words are maximal runs of letters and digits of the lower-cased whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, slices, table

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicityParameters:
    bits: int = 18
    factors: int = 8
    sample_rows: int = 16384  # the bound on labelled rows that are learned from
    epochs: int = 10
    batch: int = 256
    rate: float = 3.0
    l1: float = 0.5  # times the root of the number of rows: a word's chance gradients add up to about that
    factor_rate: float = 0.1
    factor_start: float = 0.2  # deviation of the vectors' first values
    factor_shrink: float = 0.02  # gradient of a row that a vector must have on the whole to stay
    factor_rows: int = 20  # labelled rows that a term with a vector is in at least
    seed: int = 7


@dataclass(frozen=True)
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    bits: int


class _Terms(dict):
    """Bucket of each word, remembered for the words seen lately."""

    def __init__(self, bits: int):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = (zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B1) & 0xFFFFFFFF
        self[word] = bucket = h >> (32 - self.bits)
        return bucket


def _terms(text: str | None, buckets: _Terms) -> np.ndarray:
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter(map(buckets.__getitem__, words), np.int32, len(words)))


def _parts(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in found])
    have = np.flatnonzero(sizes)
    ids = np.concatenate(found) if len(have) else np.zeros(0, np.int32)
    return ids, have, np.cumsum(sizes)[have] - sizes[have]


def _margin(ids, have, first, rows, bias, weights, factors):
    """The model's value before the logistic, and the sums of factors that its gradient needs."""
    z, sums = np.full(rows, bias), np.zeros((rows, factors.shape[1]))
    if len(have):
        v = factors[ids]
        sums[have] = np.add.reduceat(v, first, axis=0)
        z[have] += np.add.reduceat(weights[ids], first) + 0.5 * ((sums[have] ** 2).sum(1) - np.add.reduceat((v * v).sum(1), first))
    return z, sums


def train(found: list[np.ndarray], labels: np.ndarray, p: ToxicityParameters) -> FactorizationMachine:
    size, rng = 1 << p.bits, np.random.default_rng(p.seed)
    weights, z, n = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = np.bincount(np.concatenate(found), minlength=size) if len(found) else np.zeros(size)
    factors = np.where((rows >= p.factor_rows)[:, None], rng.normal(0, p.factor_start, (size, p.factors)), 0.0)
    paired, seen = rows >= p.factor_rows, np.full((size, p.factors), 0.01)
    bias, bias_seen = -2.0, 1.0
    l1 = p.l1 * np.sqrt(len(found))
    for _ in range(p.epochs if len(found) else 0):
        order = rng.permutation(len(found))
        for at in range(0, len(order), p.batch):
            pick = order[at : at + p.batch]
            ids, have, first = _parts([found[i] for i in pick])
            if not len(ids):
                continue
            margin, sums = _margin(ids, have, first, len(pick), bias, weights, factors)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]
            bias_seen += error.sum() ** 2
            bias -= p.rate * error.sum() / np.sqrt(bias_seen)
            owner = np.repeat(np.arange(len(pick)), [len(found[i]) for i in pick])
            by_term = np.argsort(ids, kind="stable")
            owner, own = owner[by_term], ids[by_term]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            terms = own[start]
            g = np.add.reduceat(error[owner], start)
            step = (np.sqrt(n[terms] + g * g) - np.sqrt(n[terms])) / p.rate
            z[terms] += g - step * weights[terms]
            n[terms] += g * g
            flat = np.abs(z[terms]) <= l1
            weights[terms] = np.where(flat, 0, -(z[terms] - np.sign(z[terms]) * l1) / ((1 + np.sqrt(n[terms])) / p.rate))
            # vectors: a gradient step, then shortened (the proximal step of a penalty on their lengths)
            grad = np.add.reduceat(error[owner, None] * sums[owner], start) - g[:, None] * factors[terms]
            live = paired[terms]
            grad, terms = grad[live] / len(pick), terms[live]
            seen[terms] += grad * grad
            rate = p.factor_rate / np.sqrt(seen[terms])
            moved = factors[terms] - rate * grad
            length = np.sqrt((moved * moved).sum(1, keepdims=True))
            factors[terms] = moved * np.maximum(0, 1 - p.factor_shrink * rate.mean(1, keepdims=True) / np.maximum(length, 1e-12))
    return FactorizationMachine(float(bias), weights.astype(np.float32), factors.astype(np.float32), p.bits)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", p: ToxicityParameters | None = None) -> FactorizationMachine:
    """Learns from at most about p.sample_rows labelled rows, picked by a hash of their key."""
    p = p or ToxicityParameters()
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).alias("y"))
    share = min(1.0, p.sample_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30))

    def terms(batches):
        buckets = _Terms(p.bits)
        for part, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array([_terms(t, buckets).tobytes() for t in texts], pa.binary()), part.column("y").cast(pa.int32())], names=["x", "y"])

    # about sample_rows pairs of numbers: of a proven size, so this side is broadcast and no text is shuffled
    rows = docs.select(key, text).join(F.broadcast(known), key).select(text, "y").mapInArrow(terms, "x binary, y int").toArrow()
    found = sorted((y, x) for x, y in zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True))
    if not found:
        return FactorizationMachine(-50.0, np.zeros(1 << p.bits, np.float32), np.zeros((1 << p.bits, p.factors), np.float32), p.bits)
    return train([np.frombuffer(x, np.int32) for _, x in found], np.array([float(y) for y, _ in found]), p)


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """docs with a score from 0 to 1, in place of any column of that name; every other column passes through."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        buckets = _Terms(m.bits)
        for part, texts in slices(batches, text):
            ids, have, first = _parts([_terms(t, buckets) for t in texts])
            z, _ = _margin(ids, have, first, len(texts), m.bias, m.weights, m.factors)
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned only where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
