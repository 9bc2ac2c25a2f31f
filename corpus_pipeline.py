"""A training corpus from raw documents: language, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs; all but the last return the columns of documents. Tables may be empty and texts null at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import language_id, mixing, ngram_join, packing, pii
from halocline.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language: null ones, those without a letter, and those of which no language is likelier than not.

    lang becomes the predicted language where it is null or contradicted by a score of 0.99 or more. Where nothing can be
    learned, as no row has a lang, texts with a letter stay as they are.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model, names=("__lang", "__sure")).where((F.col("__lang") != language_id.UNDETERMINED) & (F.col("__sure") >= 0.5))
    lang = F.when(F.col("lang").isNull() | (F.col("__sure") >= 0.99), F.col("__lang")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, 80 percent) stays: that of the smallest id.

    Rows are told apart by id and text together, so ids may be null or repeat over different texts; rows without an id
    come last. Of rows that repeat id and text one stays. Empty texts are no copies of one another.
    """
    found = ngram_join.classes(docs, ngram_join.JoinParameters(words=5, percent=80))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    best = found.where("root is not null").groupBy("root").agg(F.min(place).alias("best"))
    copies = found.join(best, "root").where(place != F.col("best")).select("id", "h").distinct()
    again = written(found.groupBy("id", "h").count().where("count > 1").select("id", "h"), "again")
    hashed = docs.withColumn("__h", F.xxhash64("text"))
    same = lambda rows: F.equal_null(F.col("doc_id").cast("long"), rows["id"]) & (F.col("__h") == rows["h"])
    kept = hashed.join(copies, same(copies), "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same(again), "left_anti").unionByName(once).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, in each row by its own spans, whatever its id."""
    found = pii.detect(docs, whole=True).select("row.*", F.col("spans").alias("__spans"))
    has = F.size("__spans") > 0
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col("__spans")))
    return masked.withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed)]
#: Learned models, seeded rounding and retrieval have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
