"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source gets a target number of words; each of its documents the same fractional number of copies, target over
source size. Whole copies are given at once. The fraction is rounded dependently: two documents exchange mass (words,
so that a source's total stays what it is) in a random direction, with odds that keep both expectations, until one is
taken or left. A source's documents are dealt by hash into groups of about ``fan_in``; in each, a fold over the group
leaves one document undecided, and these residuals meet in groups again, up a tree, until a source has one left, which
goes to the nearer side. So a source's taken words miss its target by half of one document at most.

Random numbers are hashes of the ids of a pair, so reruns agree. A group is bounded by the fan-in whatever a source's
share of the rows is; no source is gathered anywhere.

Cases: null and empty texts have size 0 and are taken 0 times. A null source is a source, the last in order. Rows that
repeat an id are told apart by their content and are alike otherwise. Sources of no words get a target of 0. With no
words at all nothing is taken. Sources stop at three times their size; targets beyond it go to the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixingParameters:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of sources in order, repeating
    most: float = 3.0  # copies of a source, and so of a document
    fan_in: int = 128
    seed: int = 5


def targets(sources: DataFrame, p: MixingParameters) -> DataFrame:
    """source, source_size, target, rate from source, source_size: shares by weight, filled up to p.most times the size.

    A row for each source. In the order of how soon a source is full, the first that its share doesn't fill tells the
    level of all that follow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    ranked = sources.withColumn("weight", weights[F.pmod(F.row_number().over(order) - 1, F.lit(len(p.weights))).cast("int")])
    ranked = ranked.withColumn("full_at", p.most * F.col("source_size") / F.col("weight"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    upto, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum(p.most * F.col("source_size")).over(upto), F.lit(0.0))) / F.sum("weight").over(onward))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    filled = levels.withColumn("target", F.least(p.most * F.col("source_size"), level * F.col("weight")))
    return filled.select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def _uniform(seed: int, *parts: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _settle(units: Column, seed: int) -> Column:
    """Of units (key, size, p with 0 < p < 1), the decided ones and the one that is left."""
    kept = "array<struct<key:string,up:int>>"
    unit = "struct<key:string,size:double,p:double>"

    def step(state: Column, x: Column) -> Column:
        c = state["left"]
        a, pa, b, pb = c["size"], c["p"], x["size"], x["p"]
        rise, fall = F.least((1 - pa) * a, pb * b), F.least(pa * a, (1 - pb) * b)
        up = _uniform(seed, c["key"], x["key"]) * (rise + fall) < fall
        mine = F.when(up, (1 - pa) * a <= pb * b).otherwise(pa * a <= (1 - pb) * b)  # the one left so far is decided
        mass = F.when(up, rise).otherwise(-fall)
        done = F.when(mine, F.struct(c["key"].alias("key"), up.cast("int").alias("up"))).otherwise(F.struct(x["key"].alias("key"), (~up).cast("int").alias("up")))
        left = F.when(mine, F.struct(x["key"].alias("key"), b.alias("size"), (pb - mass / b).alias("p"))).otherwise(F.struct(c["key"].alias("key"), a.alias("size"), (pa + mass / a).alias("p")))
        whole = (left["p"] <= 1e-12) | (left["p"] >= 1 - 1e-12)
        # both decided at once, by rounding of a tie: what is left has the whole value and settles at its next step
        return F.struct(F.array_append(state["done"], done).alias("done"), F.struct(left["key"].alias("key"), left["size"].alias("size"), F.when(whole, F.round(left["p"])).otherwise(left["p"]).alias("p")).alias("left"))

    start = F.struct(F.array().cast(kept).alias("done"), units[0].cast(unit).alias("left"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def dependent_rounding(units: DataFrame, p: MixingParameters) -> DataFrame:
    """key, up (0 or 1) from key, source, size, p (strictly between 0 and 1), by the tree."""
    found = []
    counts = units.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / p.fan_in).alias("groups"))
    groups = counts.agg(F.max("groups")).first()[0]
    if groups is None:
        return units.select("key", F.lit(0).alias("up"))
    level = units.join(counts, F.equal_null(F.col("source"), F.col("of"))).select("key", "source", "size", "p", F.pmod(F.xxhash64(F.lit(p.seed), "key"), F.col("groups")).alias("node"))
    for depth in range(2 + math.ceil(math.log(max(groups, 2), p.fan_in))):
        ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(p.seed + depth), "key").alias("at"), "key", "size", "p")))
        settled = level.groupBy("source", "node").agg(ordered.alias("units")).select("source", "node", _settle(F.transform("units", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["p"].alias("p"))), p.seed + depth).alias("s"))
        settled = written(settled.select("source", "node", "s.done", "s.left"), f"pivotal-{depth}")
        found.append(settled.select(F.inline("done")))
        level = settled.select("left.key", "source", "left.size", "left.p", F.floor(F.col("node") / p.fan_in).cast("long").alias("node"))
    # a row for each source: its last document goes to the nearer side
    found.append(level.select("key", (F.col("p") >= 0.5).cast("int").alias("up")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def plan(docs: DataFrame, p: MixingParameters | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, unit: a row for each of docs; texts are read once and not shuffled."""
    p = p or MixingParameters()
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"), unit_key(key, text, source).alias("unit"))
    sized = written(sized, "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), p)
    rows = sized.join(sources.withColumnRenamed("source", "of"), F.equal_null(F.col("source"), F.col("of"))).drop("of")
    rows = written(rows.withColumns({"whole": F.floor(F.col("rate") + 1e-12), "part": F.greatest(F.col("rate") - F.floor(F.col("rate") + 1e-12), F.lit(0.0))}), "rates")
    # rows alike in id and content share a unit, whose size is theirs together
    units = rows.where((F.col("size") > 0) & (F.col("part") > 1e-12)).groupBy("unit", "source").agg(F.sum("size").cast("double").alias("size"), F.first("part").alias("p"))
    chosen = dependent_rounding(units.withColumnRenamed("unit", "key"), p)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("up", F.lit(0))).otherwise(0).cast("long")
    joined = rows.join(chosen, rows["unit"] == chosen["key"], "left").withColumn("copies", copies)
    return joined.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "unit")


def unit_key(key: str, text: str, source: str) -> Column:
    """Rows of one id, content and source are one unit."""
    return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.hex(F.xxhash64(text, source)))


def mix(docs: DataFrame, p: MixingParameters | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each as many times as the mix takes it; the columns stay."""
    copies = plan(docs, p, key, text, source).where("copies > 0").groupBy("unit").agg(F.first("copies").cast("int").alias("copies"))
    marked = docs.withColumn("__unit", unit_key(key, text, source)).join(copies.withColumnsRenamed({"unit": "__of", "copies": "__copies"}), F.col("__unit") == F.col("__of"))
    return marked.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's target and the words that the mix takes of it."""
    rows = plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")
