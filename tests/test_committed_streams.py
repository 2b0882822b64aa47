"""Streams that end in committed tables: killed and repeated batches, repeats, late lists, states out of order."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from diffsieve import schemas
from diffsieve.plans.review import Review
from diffsieve.sources import sinks
from diffsieve.streaming import commits, reviews

START = datetime(2024, 1, 1)
CODE = "def f(x):\n    return eval(x)\n"
HEADER = (
    "review_id BIGINT, verdict STRING, summary STRING, severity_breakdown STRUCT<critical: BIGINT, high: BIGINT, medium: BIGINT, "
    "low: BIGINT, info: BIGINT>, files_reviewed BIGINT, error STRING")
FILE = "struct<filename string, contents_url string, raw_url string, patch string, additions int, deletions int>"


def arrival(review, delivery, minute, files=None, number=None):
    request = {"html_url": f"u{review}", "number": review if number is None else number}
    if files is not None:
        request["files"] = [{"filename": f, "contents_url": f"c/{f}"} for f in files]
    body = json.dumps({"action": "opened", "repository": {"full_name": "o/r"}, "pull_request": request})
    return (review, "pull_request", None, body, delivery, START + timedelta(minutes=minute))


def put(spark, folder, rows, schema=schemas.HOOK_ARRIVAL):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_killed_batches_show_nothing_and_repeated_ones_replace(spark, tmp_path):
    folder = str(tmp_path / "t")
    commits.open_tables(spark, folder)
    one = lambda *rows: spark.createDataFrame(rows, "k bigint, v string")
    read = lambda name: sorted(tuple(r) for r in commits.committed(spark, folder, name, "k BIGINT, v STRING").collect())
    assert read("a") == []
    commits.commit({"a": one((1, "x")), "b": one((1, "y"))}, folder, 0)
    commits.write_attempt({"a": one((2, "dead"))}, folder, 1)  # died before table b and the manifest
    assert (read("a"), read("b")) == ([(1, "x")], [(1, "y")])
    commits.commit({"a": one((2, "x")), "b": one().limit(0)}, folder, 1)
    commits.commit({"a": one((1, "new")), "b": one((1, "y"), (3, "z"))}, folder, 0)
    assert (read("a"), read("b")) == ([(1, "new"), (2, "x")], [(1, "y"), (3, "z")])


def test_rows_are_updated_by_key_in_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "u")
    commits.open_tables(spark, folder)
    schema = "k BIGINT, n BIGINT, v STRING"
    put_ = lambda batch, *rows: commits.upsert(spark.createDataFrame(rows, schema), folder, batch, "s", "k", "n", schema)
    put_(0, (1, 1, "a"), (2, 5, "b"), (3, 1, None))
    before = {r.part: r.attempt for r in commits.current(spark, folder).collect()}
    put_(1, (2, 4, "late"), (1, 2, "c"))
    put_(1, (2, 4, "late"), (1, 2, "c"))
    rows = commits.committed(spark, folder, "s", f"{schema}, part BIGINT").drop("part").collect()
    assert sorted((r.k, r.n, r.v) for r in rows) == [(1, 2, "c"), (2, 5, "b"), (3, 1, None)]
    after = {r.part: r.attempt for r in commits.current(spark, folder).collect()}
    of = {r.k: r.b for r in spark.range(1, 4).select(F.col("id").alias("k"), commits.bucket(F.col("id")).alias("b")).collect()}
    assert after[of[3]] == before[of[3]] and after[of[1]] != before[of[1]]


def test_reviews_on_a_stream_equal_the_batch_job(spark, tmp_path):
    base = str(tmp_path)
    put(spark, f"{base}/in", [arrival(1, "d1", 0, ["a.py", "b.js"]), arrival(2, "d2", 1, ["c.py"]), arrival(3, "d3", 2)])
    put(spark, f"{base}/in", [arrival(1, "d1", 5, ["a.py", "b.js"]), arrival(4, "d4", 6, ["a.py"])])
    contents = spark.createDataFrame([("c/a.py", CODE), ("c/b.js", "eval(x)\n"), ("c/c.py", "x = 1\n")], "url string, content string")
    died = []

    def dies_once(tables, folder, batch):
        if not died:
            died.append(batch)
            commits.write_attempt({k: tables[k] for k in list(tables)[:2]}, folder, batch)
            raise RuntimeError("lost between two tables")
        commits.commit(tables, folder, batch)

    def run():
        stream = reviews.read_arrivals(spark, f"{base}/in", max_files=1)
        reviews.stream_reviews(stream, f"{base}/out", f"{base}/state", contents=contents, write=dies_once).awaitTermination()

    read = lambda name, schema: reviews.read_reports(spark, f"{base}/out", name, schema)
    with pytest.raises(Exception, match="lost between"):
        run()
    assert read("header", HEADER).count() == 0  # its header was written, but not published
    run()
    run()  # a third run finds nothing new
    headers = {r.review_id: r for r in read("header", HEADER).collect()}
    assert sorted(headers) == [1, 2, 3, 4] and read("header", HEADER).count() == 4
    assert {i: r.error for i, r in headers.items()} == {1: None, 2: None, 3: "no file known", 4: None}
    files = [(1, 0, "a.py", CODE), (1, 1, "b.js", "eval(x)\n"), (2, 0, "c.py", "x = 1\n"), (3, None, "", ""), (4, 0, "a.py", CODE)]
    batch = Review(spark.createDataFrame([(*f[:3], "python", f[3], "", 0, 0) for f in files], schemas.PR_FILES))
    want = {r.review_id: (r.verdict, r.summary, r.severity_breakdown) for r in batch.report["header"].collect()}
    assert {i: (r.verdict, r.summary, r.severity_breakdown) for i, r in headers.items()} == want
    keys = ["review_id", "file_ord", "layer", "seq", "sub", "id"]
    of = lambda df: sorted(tuple(r) for r in df.select(*keys).collect())
    assert of(read("security_issues", "review_id BIGINT, file_ord INT, layer INT, seq INT, sub INT, id STRING")) == of(batch.findings)


def test_rejected_files_are_an_error_of_their_review(spark):
    files = spark.createDataFrame(
        [(1, 0, "a.py", "cobol", "x", "", 0, 0), (1, 1, "b.py", "python", "x = 1", "", 0, 0)], schemas.PR_FILES)
    assert reviews.report_tables(Review(files))["header"].first()["error"] == "1 of 2 files rejected"


def test_repeats_go_within_the_watermark_and_ids_are_forgotten(spark, tmp_path):
    base = str(tmp_path)
    for rows in (
        [arrival(1, "d1", 0), arrival(2, "d2", 1), arrival(2, "d2", 1)],
        [arrival(1, "d1", 30), arrival(3, "d3", 31)],        # a repeat in a later batch
        [arrival(9, "d9", 6000)],                             # moves the watermark far ahead
        [arrival(4, "d4", 6001)],                             # old ids go at the end of this batch
        [arrival(1, "d1", 6002)],                             # the id comes again as a new delivery, long after
    ):
        put(spark, f"{base}/in", rows)
    stream = reviews.unique_deliveries(reviews.read_arrivals(spark, f"{base}/in", max_files=1), "1 hour")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    got = sorted((r.review_id, r.delivery_id) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(1, "d1"), (1, "d1"), (2, "d2"), (3, "d3"), (4, "d4"), (9, "d9")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # d9, d4 and the new d1: the first three are forgotten


def test_lists_may_come_first_late_or_never(spark, tmp_path):
    base = str(tmp_path)
    listing = lambda n, minute, name: ("o/r", n, [(name, f"c/{name}", None, None, None, None)], START + timedelta(minutes=minute))
    schema = f"repository string, number int, files array<{FILE}>, listed_ts timestamp"
    put(spark, f"{base}/in", [arrival(1, "d1", 10), arrival(2, "d2", 11), arrival(3, "d3", 12), arrival(4, "d4", 13, ["own.py"]), arrival(5, "d5", 14)])
    put(spark, f"{base}/in", [arrival(99, "d99", 9000)])
    put(spark, f"{base}/lists", [listing(1, 0, "first.py"), listing(4, 13, "other.py")], schema)
    put(spark, f"{base}/lists", [listing(2, 60, "late.py"), listing(5, 200, "too_late.py"), listing(98, 9000, "x.py")], schema)
    lists = spark.readStream.schema(schema).json(f"{base}/lists")
    files = reviews.listed_later(reviews.read_arrivals(spark, f"{base}/in"), lists, "1 hour")
    query = files.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    got = sorted((r.review_id, r.file_ord, r.filename, r.url) for r in spark.read.parquet(f"{base}/out").where("review_id < 90").collect())
    assert got == [
        (1, 0, "first.py", "c/first.py"), (2, 0, "late.py", "c/late.py"), (3, None, "", ""), (4, 0, "own.py", "c/own.py"), (5, None, "", "")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # only what the watermark has not passed


def test_last_states_of_jobs_out_of_order(spark, tmp_path):
    base = str(tmp_path)
    rows = [(1, 1, "queued"), (1, 2, "running"), (1, 3, "complete"), (2, 1, "queued"), (2, 2, "failed"), (3, 7, "running")]
    for order in ([2, 4], [0, 3, 5], [1]):
        put(spark, f"{base}/in", [(*rows[i], "boom" if rows[i][2] == "failed" else None, START) for i in order], schemas.JOB_EVENT)
    for _ in range(2):  # the second run has nothing to do
        stream = spark.readStream.schema(schemas.JOB_EVENT).option("maxFilesPerTrigger", 1).json(f"{base}/in")
        reviews.stream_job_status(stream, f"{base}/out", f"{base}/state").awaitTermination()
    got = sorted((r.review_id, r.seq, r.status, r.error) for r in reviews.job_states(spark, f"{base}/out").collect())
    assert got == [(1, 3, "complete", None), (2, 2, "failed", "boom"), (3, 7, "running", None)]


def test_a_review_written_again_replaces_only_itself(spark, tmp_path):
    folder = str(tmp_path / "store")
    heads = lambda *rows: spark.createDataFrame(rows, "review_id bigint, verdict string")
    found = lambda *rows: spark.createDataFrame(rows, "review_id bigint, line int")
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "review_id bigint")

    def read():
        tables = {"header": heads().schema, "findings": found().schema}
        return {n: sorted(tuple(r) for r in sinks.read_report(spark, folder, n, s).collect()) for n, s in tables.items()}

    many = range(1, 200)  # more reviews than buckets
    sinks.replace_report({"header": heads(*[(i, "a") for i in many]), "findings": found(*[(i, 1) for i in many], (7, 2))}, keys(*many), folder)
    sinks.replace_report({"header": heads((7, "b")), "findings": found((7, 9))}, keys(7), folder)
    got = read()
    assert got["header"] == sorted([(i, "a") for i in many if i != 7] + [(7, "b")])
    assert got["findings"] == sorted([(i, 1) for i in many if i != 7] + [(7, 9)])
    sinks.replace_report({"header": heads((8, "c")), "findings": found().limit(0)}, keys(8), folder)  # its findings are gone
    got = read()
    assert (8, "c") in got["header"] and (8, 1) not in got["findings"] and len(got["findings"]) == len(many) - 1


def test_texts_of_a_batch_are_fetched_once(spark, tmp_path):
    """The files of a batch are written before the review reads them, so that its tables do not join the contents again and again."""
    import json

    from diffsieve.plans.review import Review
    from diffsieve.streaming import reviews

    payload = {"action": "opened", "repository": {"full_name": "o/r"}, "pull_request": {
        "html_url": "u", "number": 1, "files": [{"filename": "a.py", "contents_url": "c/1", "patch": "", "additions": 1, "deletions": 0}]}}
    row = [(1, "pull_request", None, json.dumps(payload), "d1", "2024-01-01 00:00:00")]
    spark.createDataFrame(row, "review_id bigint, event string, signature string, payload string, delivery_id string, ts string").write.json(f"{tmp_path}/in")
    contents = spark.createDataFrame([("c/1", "x = eval(y)\n")], "url string, content string")
    plans = []

    def make(files):
        plans.append((files._jdf.queryExecution().optimizedPlan().toString(), files.count()))
        return Review(files)

    reviews.stream_reviews(
        reviews.read_arrivals(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", contents=contents, make_review=make).awaitTermination()
    assert plans and all("Join" not in plan and n == 1 for plan, n in plans)
