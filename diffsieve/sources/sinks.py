"""Writing reports, comment texts and progress events."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..streaming.commits import committed, replace_keys


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "json") -> None:
    """Write a review's tables side by side, each under its own name, all keyed by ``review_id``.

    The header (verdict, summary, breakdown, counts) and the four row tables stay separate, because one nested
    document per review would put all rows of the largest review into one task.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def replace_report(tables: dict[str, DataFrame], reviews: DataFrame, folder: str) -> None:
    """Write the tables of ``reviews`` into a store of reports; what the store held of these reviews goes, in all tables at once."""
    replace_keys(tables, reviews.select("review_id").distinct(), folder)


def read_report(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A table of the store as the last commits left it; ``schema`` is that of the table written."""
    part = StructType.fromDDL("part BIGINT")
    return committed(spark, folder, name, StructType([*schema.fields, *part.fields])).drop("part")


def write_markdown(lines: DataFrame, folder: str, order: list[str]) -> None:
    """Write text lines so that the files, read in name order, hold every document in line order.

    Range partitioning on the whole order splits a huge document over several files instead of one task. A line that
    stands ``copies`` times is written once and says how often.
    """
    repeated = F.when(F.col("copies") > 1, F.format_string(" (x %d)", "copies")).otherwise(F.lit(""))
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.concat("text", repeated).alias("value")
    ).write.mode("overwrite").text(folder)


def append_events(events: DataFrame, folder: str) -> None:
    """Append progress events."""
    events.write.mode("append").json(folder)


# Folders that the files of ``write_texts`` are dealt to, so that listing them is the work of as many tasks.
TEXT_FOLDERS = 512


def write_texts(texts: DataFrame, folder: str) -> int:
    """Writes every row of ``texts(name, text)`` as a file ``name=<name>-<task>-<n>.txt`` of its own below ``folder`` and returns how many there are.

    Tasks write straight to the shared folder: Spark's partitioned writer makes a folder and two commits for every file. A text is written where it is,
    unless there are fewer partitions than tasks can run at once. The n-th row of a name in a task has the number n, so no row meets the file of another,
    and a repeated task writes the same files again, in whatever order it reads the rows.
    """
    parts = urlparse(folder)
    if parts.scheme in ("", "file"):
        shared, top = pa.fs.LocalFileSystem(), parts.path
    else:
        shared, top = pa.fs.FileSystem.from_uri(folder)
    folders = TEXT_FOLDERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, made = Counter(), set()
        for batch in batches:
            for name, text, task in zip(*(batch.column(c).to_pylist() for c in ("name", "text", "_task")), strict=True):
                seen[name] += 1
                below = f"{top}/{zlib.crc32(str(name).encode()) % folders:03d}"
                if below not in made:
                    shared.create_dir(below, recursive=True)
                    made.add(below)
                with shared.open_output_stream(f"{below}/name={name}-{task}-{seen[name]}.txt") as file:
                    file.write(text.encode())
        yield pa.RecordBatch.from_pydict({"n": [seen.total()]}, pa.schema([("n", pa.int64())]))

    at_once = texts.sparkSession.sparkContext.defaultParallelism
    named = texts.select(F.col("name").cast("string").alias("name"), "text")
    if named.rdd.getNumPartitions() < at_once:
        named = named.repartition(2 * at_once, "name")
    done = named.withColumn("_task", F.spark_partition_id()).mapInArrow(run, "n bigint")
    return done.agg(F.sum("n").alias("n")).first()["n"] or 0
