"""A corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import jaccard, langid, packing, passages, quality
from strataloom.llm.common import new_path, parted, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; fitted on their own lang labels.

    A null, empty or letterless text has no language and goes; rows with a null lang or id are judged
    like others, and repeated rows alike.
    """
    return langid.keep(docs)


def repetition(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. A null or short text goes; repeated rows are judged alike."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of five-word shingles at Jaccard 0.8: that of least id.

    Documents with an empty set are linked with nothing and stay. Of repeated rows one stays, and so
    of rows that share that least id in one component. Rows with a null id can't be told apart and
    stay.
    """
    columns = docs.columns
    found = jaccard.jaccard_components(docs, words=5, num=80, den=100)
    named = found.filter("doc_id is not null and n_shingles > 0")
    name = F.xxhash64("doc_id", "th").alias("__row")
    stays = named.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("x.*").select(name).distinct()
    rows = named.select(name).groupBy("__row").agg(F.count("*").alias("n"))
    # Documents that surely stay aren't moved: the others are those to drop and repeated rows.
    judged = rows.join(stays.withColumn("stays", F.lit(True)), "__row", "left").filter("n > 1 or stays is null")
    touched, _ = written(judged.select("__row", F.coalesce("stays", F.lit(False)).alias("stays")), "touched")
    some, clear = parted(docs.withColumn("__row", F.xxhash64("doc_id", F.xxhash64("text"))), "__row", touched.select("__row"))
    others = some.join(touched, "__row", "left_anti").select(*columns)
    kept = some.join(touched.filter("stays"), "__row", "left_semi").dropDuplicates(["__row"]).select(*columns)
    return clear.select(*columns).unionByName(others).unionByName(kept)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another document keeps.

    Null and empty texts stay as they are; a document with no word left goes. Of exact copies one
    keeps its text; repeated rows count as one text, and each of them stays or is cut alike.
    """
    return passages.cut(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens. A null text is its end token alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("repetition", repetition),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packed),
]

#: Language models, alignment and packing have no SQL form; tests hold the middle stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, name)
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
