"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts (words, characters, symbols, repeated lines and words) decide by fixed limits. Beyond them, rules on rates
of a text (symbols, capitals, marks, repeated lines and words, word length) reject above a cutoff, which labelled
documents select, all of them. What is limited is a stratum's false rejection: the share of its good documents that any
of the rules rejects. Each rule gets an equal part of that risk, as what several reject together is at most the sum. For
each stratum and rule, cutoffs are tried from the most lenient on, and the last is used for which an exact binomial bound
says that the share of good documents that it rejects is at most the rule's part. Testing in this fixed order needs no
correction within a rule; across strata and rules the error is divided by their number (Bonferroni), so with probability
1 - error every stratum keeps to the risk. A stratum with too few labelled documents to prove anything has no cutoff and
rejects nothing by it (without any rejected, a rule of six needs about 1,230 good ones at a risk of 0.03 and four strata).

Cases: null and empty texts have no words and fail the base. A null stratum is a stratum. Documents without a label,
and labels without a document, are not used in choosing. Repeated rows are judged alike, and each counts. Without labels
only the base decides. Whole texts are read, however long; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table, written

SPACE = r"[\x20\x09-\x0D]+"
RULES = ("symbols", "capitals", "marks", "same_lines", "same_words", "word_length")


@dataclass(frozen=True)
class QualityParameters:
    risk: float = 0.03  # share of a stratum's good documents that its rules together may reject
    error: float = 0.05  # probability that any stratum exceeds it
    steps: int = 50  # cutoffs tried for each rule, evenly from 1 down
    min_words: int = 50
    max_repeated: int = 50  # percent of words


def _repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in windows of n words which the text has twice or more.

    Few texts repeat many windows. Where up to 32 are repeated, their places are looked up one by one; where more
    are, windows are sorted along with their places.
    """

    def covered(starts: Column) -> Column:
        start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(n), i - a["last"])).alias("n")), lambda a: a["n"])

    def by_sorting(s: Column) -> Column:
        same = lambda i, x: F.coalesce(F.try_element_at(s, i)["h"] == x["h"], F.lit(False))
        starts = F.filter(s, lambda x, i: F.when(i > 0, same(F.greatest(i, F.lit(1)), x)).otherwise(False) | same(i + 2, x))
        return covered(F.sort_array(F.transform(starts, lambda x: x["i"])))

    def from_hashes(hashes: Column) -> Column:
        def from_repeated(again: Column) -> Column:
            found = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(again, hashes[i]))
            pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(again) <= 32, covered(found)).otherwise(bind(pairs, by_sorting))

        repeated = lambda s: F.array_distinct(F.filter(s, lambda h, i: F.when(i > 0, s[F.greatest(i, F.lit(1)) - 1] == h).otherwise(False)))
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, 0).otherwise(bind(bind(F.sort_array(hashes), repeated), from_repeated))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - n + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *[words[i + k] for k in range(1, n)]))
    return F.when(F.size(words) < n, 0).otherwise(bind(windows, from_hashes))


def measured(docs: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, stratum, the base counts and a rate from 0 to 1 for each rule; a row for each of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), body.alias("t"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.char_length(F.array_join(words, "")).alias("chars"), _repeated_words(words).alias("repeated"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("same"))

    counted = split.select(
        "doc_id", "stratum",
        F.regexp_count("t", F.lit("[#*$%&|<>]")).alias("symbols"), F.regexp_count("t", F.lit("[!?=]")).alias("marks"), F.regexp_count("t", F.lit(r"\p{Lu}")).alias("capitals"),
        bind(F.array_remove(F.split("t", SPACE), ""), of_words).alias("w"),
        bind(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("l"),
    )
    rate = lambda a, b: F.when(b > 0, F.least(F.lit(1.0), a.cast("double") / b)).otherwise(0.0)
    chars = F.col("w.chars")
    return counted.select(
        "doc_id", "stratum", F.col("w.n_words").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), F.col("symbols").cast("long").alias("n_symbols"),
        F.col("l.same").cast("long").alias("n_dup_lines"), F.col("w.repeated").cast("long").alias("n_repeat_words"),
        rate(F.col("symbols"), chars).alias("symbols"), rate(F.col("capitals"), chars).alias("capitals"), rate(F.col("symbols") + F.col("marks"), chars).alias("marks"),
        rate(F.col("l.same"), F.col("l.n")).alias("same_lines"), rate(F.col("w.repeated"), F.col("w.n_words")).alias("same_words"),
        rate(chars, 40 * F.col("w.n_words")).alias("word_length"),
    )


def _stirling_error(x: Column) -> Column:
    """log(x!) - log(sqrt(2 pi x) (x / e)^x), for whole x of at least 1."""
    few = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) if i else 0.0) for i in range(16)])
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(x < 16, few[F.least(x, F.lit(15.0)).cast("int")]).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials of probability p: the term of k, and the sum of the terms below it by their ratios to it.

    The term is written in deviations, so that no large logarithms cancel. Terms so far below k or the mean that they
    are under e^-70 of the sum are not added.
    """
    k, n = k.cast("double"), n.cast("double")
    q, rest = 1 - p, n - k
    log_term = F.when(k < 1, n * math.log1p(-p)).otherwise(
        0.5 * F.log(n / (2 * math.pi * k * rest)) + _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - k * F.log(k / (n * p)) - rest * F.log(rest / (n * q))
    )
    steps = F.least(k, F.ceil(F.greatest(k - n * p, F.lit(0.0)) + 12 * F.sqrt(n * p * q) + 50)).cast("long")

    def add(a: Column, j: Column) -> Column:
        i = k - j + 1  # from the term of i to that of i - 1
        ratio = a["ratio"] * i * q / ((n - i + 1) * p)
        return F.struct(ratio.alias("ratio"), (a["sum"] + ratio).alias("sum"))

    below = F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>"))
    ratios = F.aggregate(below, F.struct(F.lit(1.0).alias("ratio"), F.lit(1.0).alias("sum")), add, lambda a: a["sum"])
    return F.when(k >= n, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_term + F.log(ratios))))


def thresholds(good: DataFrame, p: QualityParameters) -> DataFrame:
    """stratum, rule, cutoff: the strictest that is proven, from good (labelled good) measured documents."""
    rows = good.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("r")).select("stratum", "r.rule", "r.x")
    # below[j]: rows at most cutoff j/steps, counted by the first cutoff that they pass
    passed = rows.groupBy("stratum", "rule", F.least(F.lit(p.steps), F.ceil(F.col("x") * p.steps - 1e-9)).cast("int").alias("step")).agg(F.count("*").alias("n"))
    grouped = passed.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("at"))  # at most steps + 1 entries
    tested = grouped.crossJoin(F.broadcast(grouped.agg(F.count("*").alias("tests"))))  # one row
    cut = tested.select("stratum", "rule", "n", "tests", "at", F.explode(F.sequence(F.lit(1), F.lit(p.steps - 1))).alias("j"))
    rejected = F.aggregate(F.map_entries("at"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > F.col("j"), e["value"]).otherwise(0))
    part = p.risk / len(RULES)
    bound = cut.withColumn("k", rejected).where(F.col("k") <= part * F.col("n"))
    proven = bound.where(binomial_cdf(F.col("k"), F.col("n"), part) <= p.error / F.col("tests"))
    # k only falls as the cutoff rises, so all more lenient cutoffs are proven too
    return proven.groupBy("stratum", "rule").agg((F.min("j") / p.steps).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, p: QualityParameters | None = None, stratum: str = "lang", key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The measures of every document, base_failed, the rules that reject it and kept."""
    p = p or QualityParameters()
    rows = written(measured(docs, stratum, key, text), "measures")
    known = labels.where(F.col(label) == 1).select(F.col(key).alias("labelled")).distinct()
    base = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeated * F.col("n_words"))
    good = rows.where(~base).join(known, F.col("doc_id") == F.col("labelled")).drop("labelled")
    cuts = thresholds(good, p).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")).withColumnRenamed("stratum", "s")
    judged = rows.join(written(cuts, "cutoffs"), F.equal_null(F.col("stratum"), F.col("s")), "left")
    broken = F.filter(F.array(*[F.when(F.col(r) > F.try_element_at("cuts", F.lit(r)), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    judged = judged.withColumns({"base_failed": base, "broken_rules": F.coalesce(broken, F.array().cast("array<string>"))})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).drop("s", "cuts")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict, with cutoffs by language."""
    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"))
