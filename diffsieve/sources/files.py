"""Reading changed files, source texts, hook payloads and labelled items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..staging import stage

# Bytes of files that a task reads, and of one batch of them.
TASK_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
# Levels of folders that are dealt out anew; what lies deeper is listed by the task that comes to it.
LEVELS = 2
# Endings of files that Spark's reader unpacks.
PACKED = r"[.](gz|bz2|deflate|lz4|snappy|zst)$"


def with_file_defaults(files: DataFrame, language: str = "python") -> DataFrame:
    """Defaults of the optional columns of a changed file."""
    return files.withColumns({
        "language": F.coalesce("language", F.lit(language)),
        "patch": F.coalesce("patch", F.lit("")),
        "additions": F.coalesce("additions", F.lit(0)),
        "deletions": F.coalesce("deletions", F.lit(0)),
    })


def explode_requests(requests: DataFrame) -> DataFrame:
    """Review requests (one row per review, with an array of files) -> one row per changed file."""
    rows = requests.select("review_id", F.posexplode("files").alias("file_ord", "file"))
    return with_file_defaults(rows.select("review_id", "file_ord", "file.*"))


def read_pr_files(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A folder of review requests -> changed files."""
    return explode_requests(spark.read.schema(schemas.REVIEW_REQUEST).format(fmt).load(path))


def read_source_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files in all folders below ``path``, one row each, by file and name. A file must fit a task; many small ones share one.

    Spark's reader lists all files in the driver and lets each count as some megabytes, so that a task gets four to thirty of them. Here tasks list and
    read the files, of any folder whose store `pyarrow.fs` knows; other stores, patterns of paths and packed files are left to Spark's reader.
    """
    found = _folder(spark, path)
    if found is None:
        return _by_spark(spark, path)
    store, top, prefix = found
    listed = stage(_files_below(spark, store, top))
    packed = F.col("name").rlike(PACKED)
    total = listed.agg(F.sum("size").alias("bytes"), F.count_if(packed).alias("packed")).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, (total["bytes"] or 0) // TASK_BYTES, 1)
    texts = listed.where(~packed).repartition(tasks).mapInArrow(_reader(store, prefix), "path string, name string, content string")
    if total["packed"]:
        paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", r["path"]) for r in listed.where(packed).select("path").collect()]
        texts = texts.unionByName(_by_spark(spark, *(f"{prefix}{p}" for p in paths)))
    return texts


def _by_spark(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")
    )


def _folder(spark: SparkSession, path: str) -> tuple[pa.fs.FileSystem, str, str] | None:
    """The store of a folder, its path there, and what stands before such paths in a full address; None if only Spark can read it."""
    if any(c in path for c in "*?[]{}\\"):
        return None
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    address = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toUri()
    scheme, host, top = address.getScheme(), address.getRawAuthority(), address.getPath()
    try:
        store, own = (pa.fs.LocalFileSystem(), top) if scheme == "file" else pa.fs.FileSystem.from_uri(f"{scheme}://{host or ''}{quote(top)}")
        if not own.endswith(top) or store.get_file_info(own).type != pa.fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError, ValueError):
        return None
    bare = own.removesuffix(top).lstrip("/")  # a bucket, say, which is the host of the address
    return (store, own, f"{scheme}:" if host is None else f"{scheme}://{host}") if bare in ("", host) else None


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers pass over."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _files_below(spark: SparkSession, store: pa.fs.FileSystem, top: str) -> DataFrame:
    """``path, name, size`` of all files with content. The driver sees none of them."""
    kind = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])

    def lister(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.compute.invert(batch.column("folder")))
                waiting = batch.filter(batch.column("folder")).column("path").to_pylist()
                while waiting:
                    rows = []
                    for info in store.get_file_info(pa.fs.FileSelector(waiting.pop())):
                        folder = info.type == pa.fs.FileType.Directory
                        if _hidden(info.base_name, folder) or not (folder or info.size):
                            continue
                        if folder and deep:
                            waiting.append(info.path)
                        else:
                            rows.append((info.path, info.base_name, info.size or 0, folder))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, kind, strict=True)], schema=kind)

        return run

    ddl = "path string, name string, size bigint, folder boolean"
    found = spark.createDataFrame([(top, "", 0, True)], ddl)
    tasks = 2 * spark.sparkContext.defaultParallelism
    for level in range(LEVELS + 1):
        found = found.mapInArrow(lister(level == LEVELS), ddl)
        if level < LEVELS:
            found = found.repartition(tasks)
    return found.drop("folder")


# What Java leaves as it is in the path of an address.
_PLAIN = "/@_-!.~'()*,;:$&+="


def _reader(store: pa.fs.FileSystem, prefix: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``path`` to ``path, name, content``, the first two written as in an address; the bytes are passed on as they are."""
    kind = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.string())])

    def made(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
        paths, names, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(names), pa.array(texts, pa.binary()).view(pa.string())], schema=kind)

    def address(path: str) -> str:
        if path.isascii():
            return prefix + quote(path, safe=_PLAIN)
        return prefix + "".join(c if ord(c) > 159 and not c.isspace() else quote(c, safe=_PLAIN) for c in path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as file:
                    content = file.read()
                own = address(path)
                rows.append((own, own.rsplit("/", 1)[1], content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def read_labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Labelled items from JSON lines; blank lines are skipped, ids become text and labels integers."""
    return labelled_items(spark.read.text(path))


def labelled_items(lines: DataFrame) -> DataFrame:
    """JSON lines in a column `value` -> (id, kind, label, code)."""
    item = F.from_json("value", schemas.LABELLED_ITEM)
    return (
        lines.filter(F.col("value").rlike(r"\S"))
        .select(item.alias("item"))
        .select("item.id", "item.kind", F.col("item.label").cast("int").alias("label"), "item.code")
    )


def shape_changed_files(listing: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """File listings (review_id, files array) -> changed files, missing keys defaulted.

    Listings carry addresses, not texts: `contents` (url, content) supplies what was fetched; a file that was
    not fetched has empty content.
    """
    rows = listing.select("review_id", F.posexplode("files").alias("file_ord", "f"))
    if contents is None:
        rows = rows.withColumn("content", F.lit(""))
    else:
        rows = rows.withColumn("url", F.col("f.raw_url")).join(contents, "url", "left")
    return rows.select(
        "review_id",
        "file_ord",
        F.coalesce("f.filename", F.lit("")).alias("filename"),
        F.lit("python").alias("language"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("f.patch", F.lit("")).alias("patch"),
        F.coalesce("f.additions", F.lit(0)).alias("additions"),
        F.coalesce("f.deletions", F.lit(0)).alias("deletions"),
    )


def unpivot_pairs(pairs: DataFrame) -> DataFrame:
    """(id, kind, vulnerable, safe) -> two labelled rows per pair, with the id suffixed."""
    def side(suffix: str, label: int, code: str) -> Column:
        return F.struct(
            F.concat("id", F.lit(suffix)).alias("id"), "kind", F.lit(label).alias("label"), F.col(code).alias("code")
        )

    both = F.array(side("__vuln", 1, "vulnerable"), side("__safe", 0, "safe"))
    return pairs.select(F.explode(both).alias("item")).select("item.*")
