"""Tables that change by whole commits, for results that a stream writes batch by batch.

A commit writes its tables to folders of its own and then one manifest: which attempt now holds which part. Readers take
the parts that a manifest names, the latest of each, so a batch that dies between two tables leaves nothing to see, and a repeated
one replaces what it wrote before. Parts are the batches themselves, or buckets of keys for tables that are updated by key.
One stream writes a folder at a time.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "part BIGINT, batch BIGINT, attempt STRING, at BIGINT"
# Buckets of a table that is updated by key; a batch writes again only those it touches.
BUCKETS = 64


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def open_tables(spark: SparkSession, folder: str) -> None:
    """Makes the folder readable before the first commit."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{folder}/manifest")


def write_attempt(tables: dict[str, DataFrame], folder: str, batch: int, by_part: bool = False) -> str:
    """Writes all tables of a batch and returns the attempt's name; nothing is visible yet."""
    attempt = f"a{uuid.uuid4().hex}"
    for name, table in tables.items():
        # buckets meet in few tasks, so that a bucket is few files; large ones are split again at run time
        writer = table.hint("rebalance", F.col("part")).write.partitionBy("part") if by_part else table.write
        writer.parquet(f"{folder}/{name}/batch={batch}/attempt={attempt}")
    return attempt


def publish(spark: SparkSession, folder: str, batch: int, attempt: str, parts: DataFrame | None = None) -> None:
    """Makes an attempt visible; ``parts`` has the parts that it replaces, by default the batch itself. The manifest is one file."""
    named = spark.createDataFrame([(batch,)], "part BIGINT") if parts is None else parts.select(F.col("part").cast("bigint").alias("part"))
    named.distinct().select(
        "part", F.lit(batch).cast("bigint").alias("batch"), F.lit(attempt).alias("attempt"), F.lit(time.time_ns()).alias("at")
    ).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """``part, batch, attempt`` of the latest commit of every part."""
    latest = F.max_by(F.struct("batch", "attempt"), "at").alias("x")
    return _manifest(spark, folder).groupBy("part").agg(latest).select("part", "x.batch", "x.attempt")


def committed(spark: SparkSession, folder: str, name: str, schema: str | StructType) -> DataFrame:
    """The rows of a table that commits have published. ``schema`` is the table's, without ``batch`` and ``attempt``."""
    kept = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    keys = StructType.fromDDL("batch BIGINT, attempt STRING")
    live = current(spark, folder)
    by_part = "part" in kept.names
    if not live.take(1):
        return spark.createDataFrame([], kept)
    rows = spark.read.schema(StructType([*kept.fields, *keys.fields])).parquet(f"{folder}/{name}")
    on = ["batch", "attempt", "part"] if by_part else ["batch", "attempt"]
    return rows.join(live.select(*on), on, "left_semi").drop("batch", "attempt")


def commit(tables: dict[str, DataFrame], folder: str, batch: int) -> None:
    """Writes and publishes the tables of a batch; a repeated batch takes the place of the first."""
    spark = next(iter(tables.values())).sparkSession
    publish(spark, folder, batch, write_attempt(tables, folder, batch))


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def upsert(changes: DataFrame, folder: str, batch: int, name: str, key: str, order: str, schema: str) -> None:
    """Merges ``changes`` into the table by ``key``: the row with the greatest ``order`` stays, whichever batch brought it.

    Only the buckets that hold a changed key are written again. Merging the same changes twice changes nothing.
    """
    spark = changes.sparkSession
    columns = StructType.fromDDL(schema).names
    new = changes.select(*columns).withColumn("part", bucket(F.col(key)))
    touched = new.select("part").distinct()
    old = committed(spark, folder, name, f"{schema}, part BIGINT").join(F.broadcast(touched), "part", "left_semi")  # BUCKETS rows at most
    merged = old.unionByName(new).groupBy("part", key).agg(F.max_by(F.struct(*columns), order).alias("x")).select("part", "x.*")
    attempt = write_attempt({name: merged}, folder, batch, by_part=True)
    publish(spark, folder, batch, attempt, spark.read.parquet(f"{folder}/{name}/batch={batch}/attempt={attempt}").select("part"))


def replace_keys(tables: dict[str, DataFrame], keys: DataFrame, folder: str) -> None:
    """Puts the rows of ``tables`` in the place of all earlier rows of the same keys; rows of other keys stay.

    ``keys`` has one column, which all tables have; a key without any row loses its earlier ones. Only the buckets of these keys are
    written again, and all tables change in one commit.
    """
    spark, (key,) = keys.sparkSession, keys.columns
    open_tables(spark, folder)
    touched = keys.select(bucket(F.col(key)).alias("part")).distinct()
    merged = {}
    for name, table in tables.items():
        new = table.withColumn("part", bucket(F.col(key)))
        old = committed(spark, folder, name, new.schema).join(F.broadcast(touched), "part", "left_semi")  # BUCKETS rows at most
        merged[name] = old.join(keys, key, "left_anti").select(new.columns).unionByName(new)
    batch = time.time_ns()
    publish(spark, folder, batch, write_attempt(merged, folder, batch, by_part=True), touched)
