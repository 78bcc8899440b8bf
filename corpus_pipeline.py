"""A training-data pipeline over documents: quality, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

quality drops documents that the classifier rejects; near_duplicates keeps one document of each group;
mixing repeats documents by their rates so that languages reach their target shares, with rates of at least 1, so
that no document is lost; tokens encodes every row and returns doc_id, n_tokens, ids and their digests.

Odd rows: null and empty texts get the classifier's prior, which decides on them; they and rows with a null id are near
duplicates of nothing; they have no tokens, so mixing keeps them once; their ids are empty. Repeated rows count as copies. Rows
that share an id but not their text all stay. Empty tables give empty results. Extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, mixing, neardup
from lodestar.llm import quality as scoring
from lodestar.llm._spark import scratch

#: No SQL has the classifier, the rates or the tokenizer; tests hold groups, language shares, copies and ids against brute force.
ORACLE_SQL = None

#: The share of tokens of each language.
TARGETS = {"de": 0.17, "en": 0.56, "es": 0.1, "fr": 0.17}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return scoring.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.apply(docs, mixing.labelled_domains(docs, labels), TARGETS, low=1.0, grow_only=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixed), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
