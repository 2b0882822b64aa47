import hashlib
import hmac
import json

import pytest

from diffsieve import schemas
from diffsieve.operators.report import COMMENT_ORDER
from diffsieve.plans.review import Review, merge_branches
from diffsieve.sources import corpus, sinks
from diffsieve.streaming import events

SECRET = "s3"


def signed(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def deliveries():
    body = lambda action, n: json.dumps({"action": action, "pull_request": {"html_url": "u", "files": [
        {"filename": f"f{i}.py", "contents_url": f"c{i}", "additions": i} for i in range(n)]}})
    rows = []
    for i, (event, action, n) in enumerate([
        ("pull_request", "opened", 2), ("pull_request", "closed", 1), ("push", "opened", 1), ("pull_request", "reopened", 1),
        ("pull_request", "synchronize", 0),
    ]):
        text = body(action, n)
        rows.append((i, event, signed(text), text))
    text = body("opened", 3)
    rows += [(10, "pull_request", None, text), (11, "pull_request", "sha1=00", text), (12, "pull_request", signed(text, "other"), text)]
    return rows


def test_signatures_filter_and_shape(spark, tmp_path):
    batch = spark.createDataFrame(deliveries(), schemas.HOOK_DELIVERY)
    files = lambda df: sorted(((r.review_id, r.file_ord, r.filename, r.url, r.content, r.additions) for r in df.collect()), key=str)
    # delivery 4 starts a review too, though nothing is known about its files
    want = [(0, 0, "f0.py", "c0", "", 0), (0, 1, "f1.py", "c1", "", 1), (3, 0, "f0.py", "c0", "", 0), (4, None, "", "", "", 0)]
    assert files(events.events_to_files(events.verified_events(batch, SECRET))) == want
    everything = files(events.events_to_files(events.verified_events(batch, "")))
    assert len(everything) == len(want) + 9

    batch.write.json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run with the same checkpoint adds nothing
        stream = events.read_pr_events(spark, str(tmp_path / "in"))
        review = lambda df, _: df.write.mode("append").parquet(out)
        events.run_reviews(stream, review, str(tmp_path / "state"), SECRET).awaitTermination()
    assert files(spark.read.parquet(out)) == want


def test_files_and_contents_come_from_tables(spark, tmp_path):
    """Payloads as they are really sent: no file list. A repeated batch replaces what it wrote."""
    body = lambda n, **more: json.dumps({"action": "opened", "repository": {"full_name": "o/r"}, "pull_request": {"html_url": "u", "number": n, **more}})
    rows = [(n, "pull_request", signed(text), text) for n, text in [
        (1, body(1)), (2, body(2, files=[])), (3, body(3)), (4, body(4, files=[{"filename": "own.py", "contents_url": "c4"}]))]]
    batch = spark.createDataFrame(rows, schemas.HOOK_DELIVERY)
    file = "array<struct<filename string, contents_url string, raw_url string, patch string, additions int, deletions int>>"
    listing = spark.createDataFrame(
        [("o/r", n, [(f"l{n}.py", f"c{n}", None, None, None, None)]) for n in (1, 2, 4)] + [("other/r", 3, [])],
        f"repository string, number int, files {file}")
    contents = spark.createDataFrame([("c1", "x = 1"), ("c4", "y = 2")], "url string, content string")
    want = [(1, 0, "l1.py", "x = 1"), (2, 0, "l2.py", ""), (3, None, "", ""), (4, 0, "own.py", "y = 2")]
    files = lambda df: sorted(((r.review_id, r.file_ord, r.filename, r.content) for r in df.collect()), key=str)
    assert files(events.events_to_files(batch, listing, contents)) == want

    batch.write.json(str(tmp_path / "in"))

    def write(df, number):
        for _ in range(2):
            df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

    stream = events.read_pr_events(spark, str(tmp_path / "in"))
    events.run_reviews(stream, write, str(tmp_path / "state"), SECRET, listing, contents).awaitTermination()
    assert files(spark.read.parquet(str(tmp_path / "out"))) == want


def test_status_tail_and_cursor(spark, tmp_path):
    rows = [(1, 1, "queued", None), (1, 2, "running", None), (1, 3, "failed", "boom"), (2, 1, "queued", None), (2, 2, "running", None)]
    table = spark.createDataFrame(rows, "review_id BIGINT, seq BIGINT, status STRING, error STRING").selectExpr(
        "*", "timestamp_seconds(1700000000 + seq * 1800) AS ts")
    status = {r.review_id: (r.status, r.error) for r in events.job_status(table).collect()}
    assert status == {1: ("failed", "boom"), 2: ("running", None)}
    later = events.events_since(table, 1, ["ts", "seq"]).collect()
    assert sorted((r.review_id, r.seq, r.position) for r in later) == [(1, 2, 2), (1, 3, 3), (2, 2, 2)]

    table.write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(table.schema).json(str(tmp_path / "in"))
        events.write_tail(events.tail_events(stream), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    seen = spark.read.schema("review_id BIGINT, seq BIGINT, part INT, message STRING").json(str(tmp_path / "out")).collect()
    assert len(seen) == 6
    assert [json.loads(r.message) for r in seen if r.part == 1] == [{"done": True, "status": "failed"}]

    live = spark.readStream.schema(table.schema).json(str(tmp_path / "in"))
    query = events.job_status(live).writeStream.outputMode("update").format("memory").queryName("job_status").start()
    query.processAllAvailable()
    query.stop()
    assert {r.review_id: r.status for r in spark.table("job_status").collect()} == {1: "failed", 2: "running"}


@pytest.fixture(scope="module")
def review(documents):
    return Review(corpus.corpus(documents), *[corpus.answers(documents, s) for s in ("security", "quality", "fix", "test")])


def test_review_invariants(review):
    header = {r.review_id: r for r in review.report["header"].collect()}
    assert set(header) == {r.review_id for r in review.reviews.collect()}
    for c in review.counts.collect():
        assert c.critical + c.high + c.medium + c.low + c.info == c.n_real
        want = "request_changes" if c.critical + c.high else "comment" if c.medium else "approve"
        assert header[c.review_id].verdict == want and f"Found {c.n_real} security" in header[c.review_id].summary
        assert c.n_fixes <= 10 and c.n_tests <= 5
    added = review.findings.filter("layer = 4").count()
    assert review.findings.count() == review.raw.count() + added
    assert review.quarantine.count() + review.parsed.count() <= review.pr_files.count()
    both = {r.review_id: r.n_security for r in merge_branches(review.findings, review.quality).collect()}
    assert all(both.get(c.review_id, 0) == c.n_real + c.n_dismissed for c in review.counts.collect())


def test_sinks(spark, review, tmp_path):
    sinks.write_report(review.report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "header")).count() == review.reviews.count()
    sinks.write_markdown(review.comment, str(tmp_path / "comment"), COMMENT_ORDER)
    written = "\n".join(p.read_text() for p in sorted((tmp_path / "comment").glob("part-*")) if p.stat().st_size)
    assert written.count("## [") == review.reviews.count()
    first = written.split("\n---\n")[0].split("\n")
    assert first[0].startswith("## [") and first[2].startswith("> Found ") and first[4] == "### Security Issues"
    assert [x for x in first if x.startswith("### ")][:2] == ["### Security Issues", "### Findings"]


def test_no_answers_means_no_verdicts(spark, documents):
    plain = Review(corpus.corpus(documents))
    assert plain.findings.filter("false_positive").count() == 0
    assert plain.fixes.count() == 0 and plain.tests.count() == 0
    assert plain.counts.count() == plain.reviews.count()
