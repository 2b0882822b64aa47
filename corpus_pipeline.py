"""From raw documents to training pieces in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffsieve.llm import decontaminate, line_chunks, minhash, sentence_pieces, toxicity
from diffsieve.llm.common import table
from diffsieve.staging import checkpoint_folder


def names_apart(stage: Callable) -> Callable:
    """``stage`` on documents whose own columns may begin with two underscores, as those do that the operators add: such
    columns go under other names meanwhile."""

    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given = docs.columns
        aside = {c: f"own {k} {c.lstrip('_')}".replace("`", "").replace(".", " ") for k, c in enumerate(given) if c.startswith("__")}
        made = stage(spark, docs.toDF(*(aside.get(c, c) for c in given)), sf_dir)
        back = {v: k for k, v in aside.items()}
        return made.toDF(*(back.get(c, c) for c in made.columns))

    return work


@names_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts are kept whatever they score."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return toxicity.with_scores(docs, network).where((F.col("__score") < toxicity.THRESHOLD) | blank).drop("__score")


@names_apart
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks. Those that held nothing else go; ``n_chars`` follows the text."""
    cut = line_chunks.drop_repeated(docs)
    touched = F.col("__lines") > 0
    cut = cut.where(~touched | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


@names_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. Rows without an id are kept."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


@names_apart
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("__items") == 0).drop("__items", "__walked")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, pieces, n_pieces, lossless`` of every document left."""
    return sentence_pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: None: no stage but the joins can be said in SQL. The tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``. The stages' tables stay in a folder of their own below the shared folder."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
