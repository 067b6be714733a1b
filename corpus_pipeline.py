"""The corpus pipeline: five of the operators, one after the other, over documents.

Every stage takes all that the one before it kept, written as Parquet and read again. All but the
last return the columns of documents.

1. quality: documents that the classifier scores below its threshold go.
2. near_duplicates: of each group of near copies, the document with the least id stays.
3. personal_data: entities are replaced by surrogates; n_chars follows the text.
4. mixture: every document is repeated as often as the mix takes it, or left out.
5. pieces: texts become ids of the SentencePiece model, and the text that the ids decode to.

Defined cases, of every stage. Null text: treated as empty, kept as null up to the last stage. Null
ids: rows like others. Repeated rows: one of them stays (stage 2). Very long texts: whole. Empty
table: no rows, with the same columns. Extra columns: kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventgraph.llm import classifier, mixing, neardup, pieces, surrogates
from eventgraph.llm.common import own, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = own(docs, "_quality")
    return classifier.scored(docs, net, into=score).where(F.col(score) >= classifier.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    count = own(docs, "n_entities")
    return surrogates.replace(docs, count=count).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), decoded="text")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("pieces", encoded),
]
#: The classifier, near-duplicates over signatures, surrogates and ids are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what lies between them is written where all executors reach it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "corpus-pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
