import gzip
import hashlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from diffsieve import schemas
from diffsieve.operators import files as ops
from diffsieve.sources import files as src
from diffsieve.sources import sinks
from diffsieve.plans.review import Review

CASES = {
    "a.py": "python", "A.PY": "python", "a.js": "javascript", "a.ts": "typescript", "a.jsx": "jsx", "a.tsx": "tsx",
    "a.rb": "unknown", "noext": "unknown", "py": "unknown", "a.min.js": "unknown", "a.MIN.JS": "javascript",
    "x/package-lock.json": "unknown", "b.map": "unknown", "dir.py/readme": "unknown", "a.": "unknown",
}


def test_languages(spark):
    rows = spark.createDataFrame(list(CASES.items()), "filename STRING, want STRING")
    wrong = rows.withColumn("got", ops.detect_language(F.col("filename"))).filter("got <> want")
    assert wrong.collect() == []


def test_malformed_files_do_not_take_the_batch_along(spark):
    rows = [
        (1, 0, "a.py", None, "x = 1", None, None, None), (1, 1, None, "python", "x", "", 1, 1),
        (1, 2, "b.py", "python", None, "", 1, 1), (1, 3, "c.py", "cobol", "x", "", 1, 1),
        (1, 4, "d.md", "python", "x", "", 1, 1), (1, 5, "e.py", "javascript", "", "p", 2, 3),
    ]
    raw = spark.createDataFrame(rows, schemas.PR_FILES)
    good, bad = ops.reject_malformed(raw)
    assert {r.file_ord for r in bad.collect()} == {1, 2, 3}
    assert good.count() + bad.count() == raw.count()
    parsed = {r.file_ord: r for r in ops.parse_files(raw).collect()}
    assert set(parsed) == {0, 5}
    assert (parsed[0].patch, parsed[0].additions, parsed[0].ast_available) == ("", 0, True)
    assert (parsed[5].language, parsed[5].ast_available) == ("python", False)


def test_request_and_jsonl_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"review_id": 7, "pr_url": "u", "files": [{"filename": "a.py", "content": "x"}, {"filename": "b.ts", "content": "y", "additions": 3}]}\n')
    rows = src.read_pr_files(spark, str(tmp_path / "r.json")).orderBy("file_ord").collect()
    assert [(r.file_ord, r.filename, r.language, r.additions) for r in rows] == [(0, "a.py", "python", 0), (1, "b.ts", "python", 3)]
    (tmp_path / "l.jsonl").write_text('{"id": 5, "code": "c", "label": "1"}\n\n   \n{"id": "x", "code": "d", "label": 0, "kind": "semantic"}\n')
    items = src.read_labelled_jsonl(spark, str(tmp_path / "l.jsonl")).orderBy("id").collect()
    assert [tuple(r) for r in items] == [("5", None, 1, "c"), ("x", "semantic", 0, "d")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.py").write_text("a\nb\n")
    (text,) = src.read_source_text(spark, str(tmp_path / "t")).collect()
    assert text.content == "a\nb\n" and text.path.endswith("one.py")


def test_listing_without_contents(spark):
    listing = spark.createDataFrame(
        [(1, [("a.py", "u1", "@@", 1, 2), (None, None, None, None, None)])],
        "review_id BIGINT, files ARRAY<STRUCT<filename STRING, raw_url STRING, patch STRING, additions INT, deletions INT>>")
    contents = spark.createDataFrame([("u1", "text")], "url STRING, content STRING")
    rows = src.shape_changed_files(listing, contents).orderBy("file_ord").collect()
    assert [(r.filename, r.content, r.additions) for r in rows] == [("a.py", "text", 1), ("", "", 0)]
    assert [r.content for r in src.shape_changed_files(listing).collect()] == ["", ""]


def test_unparseable_sources_can_be_left_out(spark):
    rows = [(1, 0, "a.py", "python", "def a(:"), (1, 1, "b.py", "python", "x = 1"), (1, 2, "c.js", "javascript", "def a(:")]
    files = spark.createDataFrame(rows, "review_id BIGINT, file_ord INT, filename STRING, language STRING, content STRING")
    assert {r.filename for r in ops.parseable(files).collect()} == {"b.py", "c.js"}


def test_every_document_is_a_file_of_its_own(spark, tmp_path):
    """Documents that share an id, are empty or end in the mark, and ids below zero; as many folders as writers need, not one a document."""
    from diffsieve.plans.queries import QUERIES

    rows = [(7, "one"), (7, "two, longer"), (8, ""), (9, None), (-3, "é\n\u0001"), *[(100 + i, f"t{i}") for i in range(700)]]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["read_source_text"](spark, str(tmp_path))
    want = sorted((i, len(t or ""), hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert len({f.rsplit("/", 1)[0] for f in out.inputFiles()}) <= 512


def test_a_review_makes_its_texts_once(spark):
    """Branches read the files that were written; none makes the texts again."""
    kinds = "review_id bigint, file_ord int, filename string, language string, content string, patch string, additions int, deletions int"
    rows = [(1, i, f"m{i}.py", "python", f"def f{i}(x):\n    return eval(x)\n", "", 0, 0) for i in range(6)]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    found = Review(spark.createDataFrame(rows, kinds).mapInArrow(counted, kinds))
    assert found.listed.count() and found.quality.count() and found.fix_items.count()
    assert made.value == len(rows)


def by_spark(spark, path):
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return sorted(rows.select("_metadata.file_path", "_metadata.file_name", F.col("value").cast("binary").alias("value")).collect())


def test_files_are_read_as_spark_reads_them(spark, tmp_path):
    """Odd names, hidden, empty, packed and deep files, bytes that are no text, a path of a single file and a path that is a pattern."""
    names = ["a.py", "deep/er/and/so/on/x.txt", "k=v/p q%20+é #~&;[1].py", "_k=1.txt", "_left/out.py", ".git/config", "x/_SUCCESS", "x/.y", "x/z._COPYING_", "_metadata/m.py", "empty.py"]
    for i, name in enumerate(names):
        at = tmp_path / "t" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"" if name == "empty.py" else b"\xef\xbb\xbfline\r\n\xff\x00 " + str(i).encode())
    for i in range(3):
        (tmp_path / "t" / f"packed [{i}] %41.txt.gz").write_bytes(gzip.compress(f"packed {i}".encode()))
    for path in (f"{tmp_path}/t", f"file://{tmp_path}/t/", f"{tmp_path}/t/a.py", f"{tmp_path}/t/*.py"):
        got = src.read_source_text(spark, path).withColumn("content", F.col("content").cast("binary"))
        assert got.columns == ["path", "name", "content"] and sorted(got.collect()) == by_spark(spark, path), path
    with pytest.raises(AnalysisException):
        src.read_source_text(spark, f"{tmp_path}/none").collect()


def test_many_small_files_share_a_task(spark, tmp_path):
    """The number of tasks follows the bytes of the files, not their number, and no file is listed in the driver."""
    for i in range(800):
        (tmp_path / f"d{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 7}" / f"{i}.txt").write_text(f"text {i}")
    out = src.read_source_text(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.content for r in out.collect()) == sorted(f"text {i}" for i in range(800))


def test_texts_are_written_where_they_are(spark, tmp_path):
    """Rows of one name in one task and in several; a second run of the same tasks, in another order, leaves the same files."""
    rows = [(i % 50, f"t{i}") for i in range(300)]
    texts = lambda turned: spark.createDataFrame(rows, "name bigint, text string").repartitionByRange(20, "text").sortWithinPartitions(
        F.col("text").desc() if turned else "text")
    for turned in (False, True):
        assert sinks.write_texts(texts(turned), f"{tmp_path}/o") == 300
        found = sorted((p.name.split("-")[0], p.read_text()) for p in tmp_path.glob("o/*/*.txt"))
        assert found == sorted((f"name={n}", t) for n, t in rows)
