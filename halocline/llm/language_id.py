"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters, hashed into a fixed number of buckets, on a bounded sample of
labelled rows per language. The log-probability matrix (buckets x languages, a size that the parameters fix) is
broadcast; batches of texts are scored in numpy by gathering and summing its rows.

Cases: a null text, and one without a letter, is ``und`` with score 0. Very long texts are read whole. Columns named like
the two results are replaced. Rows without a label are not learned from.
Without any labelled row every text is ``und``. Repeated rows are scored alike; other columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, slices, table

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParameters:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    sample_per_language: int = 4096  # the bound on labelled rows that are learned from
    smoothing: float = 0.5
    evidence: int = 64  # letters after which more text no longer sharpens the score


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages
    prior: np.ndarray
    parameters: LanguageParameters


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _buckets(texts: list[str | None], p: LanguageParameters):
    """For each order, the buckets of the n-grams that start at a letter; and the text that each belongs to."""
    pad = " " * max(p.orders)
    low = [(t or "").lower() + pad for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    starts = np.flatnonzero(letter)
    found = []
    for n in p.orders:
        h = np.full(len(starts), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ codes[starts + k]
        found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - p.bits)).astype(np.int64))
    return owner[starts], found


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", p: LanguageParameters | None = None) -> LanguageModel:
    """Learns from at most about p.sample_per_language rows of each language, picked by a hash of their key."""
    p = p or LanguageParameters()
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << p.bits, 0), np.float32), np.zeros(0, np.float32), p)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, p.sample_per_language / sizes[k])))]), F.col(label))
    picked = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30)).select(F.col(text).alias("t"), F.col(label).alias("l"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "t"):
            labels = np.array(part.column("l").to_pylist(), object)
            owner, found = _buckets(texts, p)
            for name in set(labels):
                mine = (labels == name)[owner]
                total = sums.setdefault(name, np.zeros(1 << p.bits, np.int64))
                for b in found:
                    total += np.bincount(b[mine], minlength=1 << p.bits)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"l": pa.array([name] * len(at), pa.string()), "b": at.astype(np.int32), "n": total[at]})

    counted = picked.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    totals = np.full((1 << p.bits, len(languages)), p.smoothing)
    index = {k: i for i, k in enumerate(languages)}
    column = np.array([index[x] for x in counted.column("l").to_pylist()], np.int64)
    np.add.at(totals, (counted.column("b").to_numpy(), column), counted.column("n").to_numpy())
    logp = np.log(totals / totals.sum(0)).astype(np.float32)
    prior = np.log(np.array([sizes[k] for k in languages], float) / sum(sizes.values())).astype(np.float32)
    return LanguageModel(languages, logp, prior, p)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns, in place of any of their names; every other column passes through."""
    spark = docs.sparkSession
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def score(batches):
        m = shared.value
        p, languages = m.parameters, np.array([*m.languages, UNDETERMINED], object)
        for part, texts in slices(batches, text):
            owner, found = _buckets(texts, p)
            letters = np.bincount(owner, minlength=len(texts))
            best, sure = np.full(len(texts), len(m.languages)), np.zeros(len(texts))
            have = np.flatnonzero(letters)
            if len(have) and m.languages:
                first = np.cumsum(letters)[have] - letters[have]
                total = np.zeros((len(have), len(m.languages)))
                for b in found:
                    total += np.add.reduceat(m.log_probability[b], first, axis=0)
                scaled = total / (letters[have] * len(p.orders))[:, None] * np.minimum(letters[have], p.evidence)[:, None] + m.prior
                e = np.exp(scaled - scaled.max(1, keepdims=True))
                best[have] = scaled.argmax(1)
                sure[have] = e.max(1) / e.sum(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages[best], pa.string()), pa.array(sure)], names=[f.name for f in schema])

    return docs.mapInArrow(score, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learned only where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
