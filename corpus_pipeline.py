"""The corpus pipeline: five stages over documents, each reading what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import dropped, remove, shared_folder, table
from scriptorium.llm.decontaminate import find_leaks
from scriptorium.llm.minhash import near_duplicates
from scriptorium.llm.mixing import mix
from scriptorium.llm.secrets import find_secrets
from scriptorium.llm.toxicity import toxicity

#: No SQL expresses the learned scores and the random draws; tests hold the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, docs["doc_id"] == ids["__id"], "left_anti")


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject. A document of several rows goes when one of them is rejected."""
    judged = toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("predicted = 1 AND id IS NOT NULL").select(F.col("id").alias("__id")).distinct())


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Rows of null doc_id stay."""
    return _without(docs, near_duplicates(docs).where("NOT kept").select(F.col("id").alias("__id")))


def unseen_by_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, leaks.where("id IS NOT NULL").select(F.col("id").alias("__id")).distinct())


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by [SECRET]; n_chars is counted anew where a text changed."""
    found = find_secrets(docs)
    kinds = found.schema["secrets"].dataType.fieldNames()
    every = F.array_sort(F.concat(*[F.transform(F.col(f"secrets.{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in kinds]))
    text = F.coalesce(F.col("text"), F.lit(""))

    def take(acc, x):
        # spans may overlap: what an earlier one covered is not copied or marked again
        fresh = x["s"] >= acc["at"]
        part = F.when(fresh, F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], part).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(every, start, take, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    some = F.size(every) > 0
    out = found.withColumn("__new", F.when(some, masked).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(some, F.length("__new").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__new")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and into which shards."""
    return mix(docs).where(F.size("draws") > 0)


STAGES = [("toxicity", clean_speech), ("minhash", one_of_a_kind), ("decontamination", unseen_by_benchmarks), ("secrets", without_secrets), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written to the shared folder and read again, and goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        with dropped():
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
