"""The review job on streams: deliveries in, committed report tables and job states out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans.review import Review
from ..sources.files import with_file_defaults
from ..staging import stage
from .commits import commit, committed, open_tables, upsert
from .events import events_to_files, job_status, started_reviews, verified_events

# How long repeats of a delivery may follow it, and how long a listing may.
LATE = "1 hour"


def read_arrivals(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of hook deliveries with the id and time of each, one JSON line each."""
    return spark.readStream.schema(schemas.HOOK_ARRIVAL).option("maxFilesPerTrigger", max_files).json(folder)


def unique_deliveries(arrivals: DataFrame, late: str = LATE) -> DataFrame:
    """Each delivery id once: a repeat within ``late`` of the first goes. Ids are forgotten behind the watermark, so the state holds
    the ids of about the last ``late`` only."""
    return arrivals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["delivery_id"])


def listed_later(arrivals: DataFrame, listings: DataFrame, late: str = LATE) -> DataFrame:
    """Changed files of the deliveries that start a review, when file lists come as a stream of their own.

    ``listings`` has ``repository, number, files, listed_ts``, one row for a change within ``late``. A delivery waits for a listing up to ``late`` after its
    own time; a list in the payload goes first; a delivery that neither has keeps one row with null ``file_ord`` and
    an empty name. Both sides are kept until the watermarks have passed them, no longer.
    """
    carried = {f.name for f in arrivals.schema} - {"review_id", "event", "signature", "payload"}
    started = started_reviews(arrivals, keep=sorted(carried)).withWatermark("ts", late)
    known = listings.select(
        F.col("repository").alias("_repository"), F.col("number").alias("_number"),
        F.col("files").cast(started.schema["files"].dataType).alias("listed"), "listed_ts").withWatermark("listed_ts", late)
    met = started.join(
        known,
        (F.col("repository") == F.col("_repository")) & (F.col("number") == F.col("_number"))
        & (F.col("listed_ts") >= F.col("ts") - F.expr(f"interval {late}")) & (F.col("listed_ts") <= F.col("ts") + F.expr(f"interval {late}")),
        "left")
    files = F.when(F.size("files") > 0, F.col("files")).otherwise(F.col("listed"))
    rows = met.select("review_id", "pr_url", F.posexplode_outer(files).alias("file_ord", "f"))
    return with_file_defaults(rows.select(
        "review_id", "pr_url", "file_ord", F.coalesce("f.filename", F.lit("")).alias("filename"), F.lit("python").alias("language"),
        F.lit("").alias("content"), F.coalesce("f.contents_url", F.lit("")).alias("url"), "f.patch", "f.additions", "f.deletions"))


def with_errors(headers: DataFrame, files: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Adds ``error`` to report headers: why a review saw less than it was given; null if nothing went wrong."""
    given = files.groupBy("review_id").agg(F.count_if(F.col("file_ord").isNotNull()).alias("_given"))
    bad = quarantine.groupBy("review_id").agg(F.count(F.lit(1)).alias("_bad"))
    joined = headers.join(given, "review_id", "left").join(bad, "review_id", "left")
    error = F.when(F.coalesce("_given", F.lit(0)) == 0, F.lit("no file known")).when(
        F.col("_bad") > 0, F.format_string("%d of %d files rejected", "_bad", "_given"))
    return joined.withColumn("error", error).drop("_given", "_bad")


def report_tables(review: Review) -> dict[str, DataFrame]:
    """The five tables of a batch of reviews; header rows say what went wrong."""
    tables = dict(review.report)
    tables["header"] = with_errors(tables["header"], review.pr_files, review.quarantine)
    return tables


def stream_reviews(
    arrivals: DataFrame, folder: str, checkpoint: str, secret: str = "", late: str = LATE,
    listing: DataFrame | None = None, contents: DataFrame | None = None, make_review: Callable[[DataFrame], Review] = Review,
    write: Callable[[dict[str, DataFrame], str, int], None] = commit,
) -> StreamingQuery:
    """Reviews every delivery once, batch by batch, until the input is drained.

    The report tables of a batch become visible together (see ``commits``); read them with ``read_reports``.
    """
    open_tables(arrivals.sparkSession, folder)
    fresh = unique_deliveries(verified_events(arrivals, secret), late)

    def run(batch: DataFrame, number: int) -> None:
        deliveries = stage(batch)  # once: the review reads them several times
        if deliveries.take(1):
            files = stage(events_to_files(deliveries, listing, contents))  # once: every table of a review would fetch the texts again
            write(report_tables(make_review(files)), folder, number)

    return fresh.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_reports(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return committed(spark, folder, name, schema)


JOB_STATE = "review_id BIGINT, seq BIGINT, status STRING, error STRING"


def stream_job_status(job_events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last status of every review in a table: the aggregation runs in update mode, and the rows that a batch changed are merged
    into the table by review. Read it with ``job_states``."""
    open_tables(job_events.sparkSession, folder)

    def merge(batch: DataFrame, number: int) -> None:
        changes = stage(batch)
        if changes.take(1):
            upsert(changes, folder, number, "jobs", "review_id", "seq", JOB_STATE)

    return (
        job_status(job_events).writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    return committed(spark, folder, "jobs", f"{JOB_STATE}, part BIGINT").drop("part")
