"""Review events as streams. The transformations are plain DataFrame functions that also run on batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as fv
from .. import schemas
from ..functions.ordering import with_position
from ..functions.python_checks import signature_valid
from ..operators.files import review_events_only
from ..sources.files import with_file_defaults


def read_pr_events(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of hook deliveries, one JSON line each."""
    return spark.readStream.schema(schemas.HOOK_DELIVERY).option("maxFilesPerTrigger", max_files).json(folder)


def verified_events(deliveries: DataFrame, secret: str) -> DataFrame:
    """Drop deliveries whose signature does not match their payload."""
    return deliveries.filter(signature_valid(F.col("payload"), F.col("signature"), secret))


def started_reviews(deliveries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The deliveries that start a review: `review_id, pr_url, repository, number` and the file list, if the payload has one,
    and the columns to `keep`."""
    parsed = deliveries.withColumn("p", F.from_json("payload", schemas.HOOK_PAYLOAD))
    started = review_events_only(parsed.withColumn("action", F.col("p.action")))
    return started.select(
        "review_id", F.col("p.pull_request.html_url").alias("pr_url"), F.col("p.repository.full_name").alias("repository"),
        F.col("p.pull_request.number").alias("number"), F.col("p.pull_request.files").alias("files"),
        *(keep or []),
    )


def events_to_files(deliveries: DataFrame, listing: DataFrame | None = None, contents: DataFrame | None = None) -> DataFrame:
    """Changed files of the deliveries that start a review; one `review_id` per delivery.

    Payloads as they arrive name a change by `repository` and `number`; `listing` (those two and `files`, once each) says
    which files it has. A list inside the payload goes first. `contents` (url, content, each url once) holds the texts;
    a file without one has empty content. A started review without any known file keeps one row with null `file_ord`
    and empty name, so that it isn't lost.
    """
    started = started_reviews(deliveries)
    if listing is not None:
        known = listing.select("repository", "number", F.col("files").cast(started.schema["files"].dataType).alias("listed"))
        started = started.join(known, ["repository", "number"], "left").withColumn(
            "files", F.when(F.size("files") > 0, F.col("files")).otherwise(F.col("listed")))
    rows = started.select("review_id", "pr_url", F.posexplode_outer("files").alias("file_ord", "f"))
    rows = rows.withColumn("url", F.coalesce("f.contents_url", F.lit("")))
    texts = F.lit("")
    if contents is not None:
        rows = rows.join(contents.select("url", F.col("content").alias("fetched")), "url", "left")
        texts = F.coalesce("fetched", F.lit(""))
    return with_file_defaults(rows.select(
        "review_id", "pr_url", "file_ord",
        F.coalesce("f.filename", F.lit("")).alias("filename"),
        F.lit("python").alias("language"),
        texts.alias("content"),
        "url",
        "f.patch", "f.additions", "f.deletions",
    ))


def run_reviews(
    deliveries: DataFrame, review: Callable[[DataFrame, int], None], checkpoint: str, secret: str = "",
    listing: DataFrame | None = None, contents: DataFrame | None = None,
) -> StreamingQuery:
    """Runs ``review(files, batch_id)`` on every micro-batch of verified deliveries until the input is drained.

    Spark may repeat a batch after a failure; ``review`` has to replace what it wrote for the same ``batch_id``.
    """
    files = events_to_files(verified_events(deliveries, secret), listing, contents)
    return (
        files.writeStream.foreachBatch(review)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def job_status(job_events: DataFrame) -> DataFrame:
    """Last status and error of every review. On a stream this is an aggregation in update mode."""
    last = F.max_by(F.struct("status", "error"), "seq")
    return job_events.groupBy("review_id").agg(last.alias("s"), F.max("seq").alias("seq")).select(
        "review_id", "seq", "s.status", "s.error"
    )


def tail_events(job_events: DataFrame) -> DataFrame:
    """Every event once, as the message a reader sees; a final status is followed by a done marker.

    Written in append mode, the stream's checkpoint is the reader's moving offset.
    """
    done = F.col("status").isin(fv.FINAL_STATUSES)
    marker = F.to_json(F.struct(F.lit(True).alias("done"), F.col("status")))
    messages = F.array_compact(F.array(F.to_json(F.struct("seq", "status", "error")), F.when(done, marker)))
    return job_events.select("review_id", "seq", F.posexplode(messages).alias("part", "message"))


def write_tail(messages: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = messages.writeStream.outputMode("append").format("json").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": "500 milliseconds"}
    return writer.trigger(**trigger).start(folder)


def events_since(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """A review's events after its first n, in time order. Positions are built minute by minute."""
    minute = F.date_trunc("minute", "ts")
    return with_position(events, ["review_id"], minute, order, "position").filter(F.col("position") > n)


def event_time(seconds):
    """Epoch seconds -> timestamp."""
    return F.timestamp_seconds(seconds)
