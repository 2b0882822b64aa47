"""What several text operators share: passing Arrow batches, hashing, components of a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from diffsieve.staging import stage

#: Texts are handled in groups of about this many characters, so that memory does not follow the batch.
GROUP_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batches: Iterator[pa.RecordBatch], column: str, size: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose texts have about ``size`` bytes, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size)))
            yield batch.slice(start, stop - start)
            start = stop


def add_columns(
    df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], begin: Callable[[], Callable], size: int = GROUP_CHARS
) -> DataFrame:
    """``df`` with columns computed from one text column, for groups of about ``size`` bytes of texts.

    ``begin`` runs once a task and gives a function from a list of texts (None as "") to one list or array per
    field. All columns of ``df`` are kept; a new name that ``df`` already has raises ValueError.
    """
    taken = {c.lower() for c in df.columns} & {name.lower() for name, _ in fields}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])
    kinds = [to_arrow_type(t) for _, t in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for part in groups(batches, column, size):
            made = work([x or "" for x in part.column(column).to_pylist()])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=names)

    return df.mapInArrow(run, schema)


def explode_texts(
    df: DataFrame, column: str, schema: str, begin: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    size: int = GROUP_CHARS,
) -> DataFrame:
    """Rows made from groups of whole texts of about ``size`` bytes; ``begin`` runs once a task and gives a function of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for part in groups(batches, column, size):
            yield work(part)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_of(*parts: int) -> np.uint64:
    """One 64-bit number from several."""
    value = np.array([0x9E3779B97F4A7C15], np.uint64)
    for p in parts:
        value = mix(value ^ np.array([p % 2**64], np.uint64))
    return value[0]


def crc_remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def with_text(docs: DataFrame, doc_id: str, text: str, name: str = "__text") -> DataFrame:
    """The two columns that an operator works on, whatever else the table has."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias(name))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the least node that it reaches.

    Each round takes the least label of the neighbours and then jumps to the label's own label, until nothing
    changes. Labels stay tables; each round is written to the shared folder.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        hooked = labels.join(seen, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = stage(hooked.join(above, "label").select("node", "before", F.least("label", "top").alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.where("label <> before").take(1):
            return labels.select("node", F.col("label").alias("component"))
