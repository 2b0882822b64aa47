"""Compression of vectors to four byte codes by ball k-means in whole numbers.

Every entry of a codebook and the parts assigned to it form a ball; its radius is the distance of its farthest part. With
d the distance of a part to its own entry, another entry can be as near only if the two entries are at most 2 d apart.
So an entry's neighbours are those within twice the radius, parts nearer than half the way to the nearest neighbour (the
stable core) keep their entry without work, and the others fall into rings: a part of the k-th ring is compared with the k nearest
neighbours only. All comparisons are of whole numbers, so ties and results do not depend on how the rows are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.staging import stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bound of a component's square times the vector's length: beyond it four times a sum of squares would not fit a long.
LARGEST = 2.0**40
#: Vectors that are worked on at once, and rows of one table of distances.
HELD, TABLE_ROWS = 16_384, 4_096
#: Copies of a label's total, so that no label's rows meet in one task.
SALTS = 64


def squares(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * rows.shape[1] * most * most < 2**53:  # every step is exact in doubles, which multiply faster
        rows, entries = rows.astype(np.float64), entries.astype(np.float64)
    return (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(axis=1)


def nearest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, the lower of equals, by comparing all."""
    found = [squares(rows[at : at + TABLE_ROWS], entries).argmin(axis=1) for at in range(0, len(rows), TABLE_ROWS)]
    return np.concatenate([np.empty(0, np.int64), *found])


def own_squares(rows: np.ndarray, entries: np.ndarray, homes: np.ndarray) -> np.ndarray:
    away = rows - entries[homes]
    return (away * away).sum(axis=1)


def nearest_from(rows: np.ndarray, entries: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest entry of each row, the lower of equals, from the entries that the rows had before; and how many
    distances to other entries that took."""
    between = squares(entries, entries).astype(np.int64)
    order = np.argsort(between, axis=1, kind="stable")
    ranked = np.take_along_axis(between, order, axis=1)
    reach = 4 * own_squares(rows, entries, homes)
    found, compared = homes.copy(), 0
    by_home = np.lexsort((reach, homes))
    starts = np.flatnonzero(np.r_[True, np.diff(homes[by_home]) > 0]) if len(rows) else np.empty(0, np.int64)
    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        ball = by_home[start:end]
        home = homes[ball[0]]
        # reach is sorted, so the last part gives the radius and with it the neighbours
        neighbours = int(np.searchsorted(ranked[home], reach[ball[-1]], side="right"))
        rings = np.searchsorted(ranked[home, :neighbours], reach[ball], side="right")
        below = int(np.searchsorted(rings, 1, side="right"))  # the stable core
        while below < len(ball):
            widest = 2 * int(rings[below])
            above = int(np.searchsorted(rings, widest, side="right"))
            candidates = np.sort(order[home, : rings[above - 1]])
            for at in range(below, above, TABLE_ROWS):
                some = ball[at : min(at + TABLE_ROWS, above)]
                found[some] = candidates[squares(rows[some], entries[candidates]).argmin(axis=1)]
                compared += len(some) * len(candidates)
            below = above
    return found, compared


def assign(vectors: np.ndarray, codebooks: np.ndarray, codes: np.ndarray | None) -> np.ndarray:
    """``(n, PARTS)`` entries of whole-number vectors; ``codes`` are those of the round before."""
    width = codebooks.shape[2]
    out = np.empty((len(vectors), PARTS), np.int64)
    for p in range(PARTS):
        rows = vectors[:, p * width : (p + 1) * width]
        out[:, p] = nearest(rows, codebooks[p]) if codes is None else nearest_from(rows, codebooks[p], codes[:, p])[0]
    return out


def sums_of(vectors: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """``(places, sums)``: of each used entry its place (part * entries + entry) and its count followed by its sums."""
    width = vectors.shape[1] // PARTS
    places, sums = [], []
    for p in range(PARTS):
        order = np.argsort(codes[:, p], kind="stable")
        sorted_ = codes[order, p]
        starts = np.flatnonzero(np.r_[True, np.diff(sorted_) > 0])
        counts = np.diff(np.r_[starts, len(sorted_)])
        rows = vectors[order, p * width : (p + 1) * width]
        places.append(sorted_[starts] + p * entries)
        sums.append(np.hstack([counts[:, None], np.add.reduceat(rows, starts, axis=0)]))
    return np.concatenate(places), np.vstack(sums)


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, v``: floor(1024 * x) of all vectors without null and non-finite components."""
    values = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    large = F.exists(values, lambda x: x * x * F.size(values) > LARGEST)
    floors = F.transform(values, lambda x: F.floor(x * SCALE).cast("int"))
    return vectors.where(values.isNotNull() & finite).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"),
        F.when(large, F.raise_error(F.lit("a component is too large for whole-number sums"))).otherwise(floors).alias("v"))


def _vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, length)


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)


def _binary(codes: np.ndarray) -> pa.Array:
    flat = codes.astype(np.uint8).tobytes()
    return pa.array([flat[at : at + PARTS] for at in range(0, len(flat), PARTS)], pa.binary())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            yield batch.slice(at, HELD)


def _round(state: DataFrame, codebooks: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Assigns all parts and gives the table with the new codes, and the codebooks after it.

    A task writes its rows and, behind them, one row per entry it used with the count and the sums; so one pass over
    the vectors does both. The sums are added by Spark; the driver gets ``PARTS * ENTRIES * (1 + width)`` numbers.
    """
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast(codebooks)
    length, entries = PARTS * codebooks.shape[2], codebooks.shape[1]
    started = "code" in state.columns
    kept = [f for f in state.schema.fields if f.name in ("vec_id", "label", "v")]
    schema = T.StructType([
        *kept, T.StructField("code", T.BinaryType()),
        T.StructField("place", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = np.zeros((PARTS * entries, 1 + books.shape[2]), np.int64)
        like = None
        for batch in _held(batches):
            if not batch.num_rows:
                continue
            vectors = _vectors(batch, length)
            codes = assign(vectors, books, _codes(batch) if started else None)
            places, sums = sums_of(vectors, codes, entries)
            total[places] += sums
            like = [batch.column(f.name).type for f in kept]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), _binary(codes), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                names=schema.names)
        if like is not None:
            used = np.flatnonzero(total[:, 0])
            n = len(used)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, t) for t in like), pa.nulls(n, pa.binary()), pa.array(used, pa.int32()),
                 pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=schema.names)

    both = stage(state.select([f.name for f in kept] + ["code"] * started).mapInArrow(run, schema))
    added = (
        both.where("place IS NOT NULL").select("place", F.posexplode("sums").alias("at", "sum"))
        .groupBy("place", "at").agg(F.sum("sum").alias("sum")).collect()
    )
    total = np.zeros((PARTS * entries, 1 + codebooks.shape[2]), np.int64)
    for r in added:
        total[r["place"], r["at"]] = r["sum"]
    total = total.reshape(PARTS, entries, -1)
    count = total[:, :, :1]
    return both.where("place IS NULL").drop("place", "sums"), np.where(
        count > 0, total[:, :, 1:] // np.maximum(count, 1), codebooks)


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def codebooks_of(numbers: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """The table of whole-number vectors with codes of the last round, and the codebooks after it; no codebooks if there
    is no vector. Vectors of another length than most (the longer of equals) are left out here."""
    common = numbers.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not common:
        return numbers, None
    length = common[0]["length"]
    if length % PARTS:
        raise ValueError(f"vectors of {length} components have no {PARTS} equal parts")
    state = numbers.where(F.size("v") == length)
    first = state.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    rows = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, length // PARTS)
    codebooks = np.ascontiguousarray(rows.transpose(1, 0, 2))
    for _ in range(ROUNDS):
        state, codebooks = _round(state, codebooks)
    return state, codebooks


def with_codes(state: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` under the codebooks, from the codes of the round before."""
    shared = state.sparkSession.sparkContext.broadcast(codebooks)
    width = codebooks.shape[2]
    schema = T.StructType([
        *(state.schema[c] for c in ("vec_id", "label")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in _held(batches):
            vectors = _vectors(batch, PARTS * width)
            codes = assign(vectors, books, _codes(batch))
            error = sum(own_squares(vectors[:, p * width : (p + 1) * width], books[p], codes[:, p]) for p in range(PARTS))
            written = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(written, pa.string()), pa.array(error, pa.int64())],
                names=schema.names)

    return state.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector without null or non-finite components.

    Each of the 4 equal parts has a codebook that starts as that part of the 256 vectors with the smallest ids (fewer if there
    are fewer; equal ids by the vector, null ids last) and is moved in 4 rounds; ``error`` is the squared distance to the final
    entries, ``label_error`` its sum over all vectors of the same label, nulls together. Repeated rows are coded each. An
    empty table gives no rows; vectors without components have code 00000000 and error 0. If lengths differ, those of another length
    than most vectors keep their row with a null code and error, and add nothing to their label (0 if no other vector has it). A length that
    has no 4 equal parts raises ValueError, a component whose square times the length
    is beyond 2 ** 40 (131,072 at 64 components) an error, as its sums would not fit a long. Other
    columns are not read. Only the codebooks and their sums, of fixed size, come to the driver.
    """
    numbers = stage(whole_numbers(vectors, vec_id, vector, label))
    state, codebooks = codebooks_of(numbers)
    if codebooks is None:
        coded, sha = numbers.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), ""
    else:
        length, sha = PARTS * codebooks.shape[2], digest(codebooks)
        odd = numbers.where(F.size("v") != length).select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long"))
        coded = stage(with_codes(state, codebooks).union(odd))
    totals = (
        coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"))
        .select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salted"))
    )
    salted = coded.withColumn("salt", F.pmod(F.hash("vec_id", "code"), F.lit(SALTS)))
    return salted.join(totals, (F.col("salt") == F.col("salted")) & F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle_sql(table: str = "embeddings") -> str:
    """The same in SQL: every round compares all parts with all entries."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x
  FROM kept, range({PARTS}) AS r(p)),
book0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}}) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
moved{k} AS (
  SELECT p, e, list(c ORDER BY pos) AS c FROM (
    SELECT p, best.e AS e, pos, floor(sum(x[pos]) / count(*)) AS c FROM near{k}, range(1, 1 + (SELECT any_value(len(x)) FROM parts)) AS r(pos)
    GROUP BY p, best.e, pos) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN moved{k} m USING (p, e))""")
    steps.append(f"""
coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', CAST(best.e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id, label),
sha AS (
  SELECT sha256(string_agg(CAST(CAST(u AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS s FROM (
    SELECT p, e, unnest(c) AS u, unnest(range(len(c))) AS pos FROM book{ROUNDS}))""")
    return "WITH" + ",".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, sha"""
