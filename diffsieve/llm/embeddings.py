"""Near duplicates of vectors through an inverted multi-index.

Unit vectors are turned so that both halves spread alike, and cut into two halves with a codebook each. A vector's cell is the pair
of its nearest centres, so K centres a half make a grid of K * K cells. A vector lists the centres of each half by
the distance to the plane that parts them from its own, and takes cells in the order of both together, nearest first (multi-sequence
traversal), up to a stop that is measured: the sum at which the target recall of partners at the threshold is reached. Of two
cells one visits the other, so a pair is looked at once. Visited cells are compared by exact cosines in double
precision, block against block; a block pair gives counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import components
from diffsieve.staging import stage

COSINE = 0.9
#: Share of partners at exactly COSINE whose cell the traversal is to reach; nearer partners are reached more often.
RECALL = 0.98
ROUNDING = 1e-9
#: Vectors that fit rotation, codebooks and stop, by a hash of the vector, and partners drawn for each to measure the stop.
SAMPLE, DRAWN = 8_192, 4
#: True near pairs of the sample that make a measure of their own.
LEAST_PAIRS = 200
#: Vectors that a cell has on average, and rows of a block.
CELL, BLOCK = 512, 1024
ROUNDS, SEED = 8, 2
CARRIED = ("rep", "copies", "length", "vector")


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(d, 0)


def codebook(rows: np.ndarray, size: int, random: np.random.Generator) -> np.ndarray:
    """Centres by plain k-means."""
    centres = rows[random.choice(len(rows), size, replace=False)].copy()
    for _ in range(ROUNDS):
        near = distances(rows, centres).argmin(axis=1)
        count = np.bincount(near, minlength=size)
        full = count > 0
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[full] = sums[full] / count[full, None]
    return centres


def least_distances(rows: np.ndarray, centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squares of the distances from each row to the planes that part its ``own`` centre from each centre."""
    d = distances(rows, centres)
    apart = np.sqrt(distances(centres, centres))[own]
    beyond = np.maximum(d - d[np.arange(len(rows)), own][:, None], 0)
    return np.divide(beyond, 2 * apart, out=np.zeros_like(beyond), where=apart > ROUNDING) ** 2


def rotation(rows: np.ndarray) -> np.ndarray:
    """The main directions of the rows, dealt to the two halves in turn (first, second, second, first)."""
    _, directions = np.linalg.eigh(rows.T @ rows)
    directions = directions[:, ::-1]
    k = np.arange(rows.shape[1])
    first = k % 4 % 3 == 0
    # an odd one out may not make the first half longer than the second
    order = np.r_[k[first], k[~first]]
    return directions[:, order]


class Grid:
    """Rotation, two codebooks and the traversal of the grid, for vectors of one length."""

    def __init__(self, sample: np.ndarray, size: int) -> None:
        random = np.random.default_rng(SEED)
        rows = unit(sample)
        self.cut = rows.shape[1] // 2
        self.size = size = min(size, len(rows)) if self.cut else 1
        self.reach = 0.0
        self.turn = None
        if size == 1:
            return
        self.turn = rotation(rows)
        turned = self.turned(rows)
        self.left, self.right = codebook(turned[:, : self.cut], size, random), codebook(turned[:, self.cut :], size, random)
        self.reach = self.measured_stop(rows, random)

    def turned(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.turn

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two centres of each unit vector."""
        if self.size == 1:
            return np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        rows = self.turned(rows)
        a, b = distances(rows[:, : self.cut], self.left), distances(rows[:, self.cut :], self.right)
        return a.argmin(axis=1), b.argmin(axis=1)

    def least(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.turned(rows)
        return least_distances(rows[:, : self.cut], self.left, x), least_distances(rows[:, self.cut :], self.right, y)

    def costs(self, rows: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """The sums at which the traversal of each row meets the cell of its partner."""
        a, b = self.least(rows, *self.cells(rows))
        x, y = self.cells(partners)
        k = np.arange(len(rows))
        return a[k, x] + b[k, y]

    def measured_stop(self, rows: np.ndarray, random: np.random.Generator) -> float:
        """The sum that RECALL of all partners need: of partners at COSINE along differences of sampled vectors, and
        of near pairs of the sample, DRAWN a vector that has any, if they are LEAST_PAIRS; the greater of the two."""
        base = np.repeat(rows, DRAWN, axis=0)
        aside = rows[random.integers(len(rows), size=len(base))] - rows[random.integers(len(rows), size=len(base))]
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        norm = np.linalg.norm(aside, axis=1)
        some = norm > 1e-6
        partners = COSINE * base[some] + (1 - COSINE**2) ** 0.5 * aside[some] / norm[some, None]
        costs = self.costs(base[some], partners)
        stop = float(np.quantile(costs, RECALL)) if len(costs) else 0.0
        near = []
        for k in range(0, len(rows), 512):
            close = rows[k : k + 512] @ rows.T >= COSINE
            close[np.arange(len(close)), np.arange(k, k + len(close))] = False
            some = np.flatnonzero(close.any(axis=1))
            for _ in range(DRAWN):
                # the first near one from a random place on, around the end
                start = random.integers(len(rows))
                j = (np.roll(close[some], -start, axis=1).argmax(axis=1) + start) % len(rows)
                near.append(self.costs(rows[some + k], rows[j]))
        near = np.concatenate(near)
        return max(stop, float(np.quantile(near, RECALL))) if len(near) >= LEAST_PAIRS else stop

    def traverse(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Multi-sequence traversal of all rows at once: each step takes every row's nearest cell that is not taken
        yet, until it lies beyond the stop. Yields (row, first centre, second centre)."""
        live = np.arange(len(rows))
        if self.size == 1:
            yield live, x, y
            return
        a, b = self.least(rows, x, y)
        # a row's own cell comes first
        a[live, x] = b[live, y] = -1
        left, right = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        a, b = np.maximum(np.take_along_axis(a, left, 1), 0), np.maximum(np.take_along_axis(b, right, 1), 0)
        # the next place in the second list for every place of the first; a list that is used up costs infinity
        b = np.c_[b, np.full(len(b), np.inf)]
        after = np.zeros(a.shape, np.int64)
        front = a + b[:, :1]
        while len(live):
            i = front.argmin(axis=1)
            k = np.arange(len(live))
            near = front[k, i] <= self.reach + ROUNDING
            if not near.all():
                live, i, a, b, after, front, left, right = (v[near] for v in (live, i, a, b, after, front, left, right))
                k = np.arange(len(live))
            j = after[k, i]
            yield live, left[k, i], right[k, j]
            after[k, i] = j + 1
            front[k, i] = a[k, i] + b[k, j + 1]

    def visits(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cell) of the own cell and of the cells that the own one visits. Of two cells the lesser visits the greater
        if both numbers are even or both odd, else the greater visits the lesser."""
        home = x * self.size + y
        for row, i, j in self.traverse(rows, x, y):
            cell = i * self.size + j
            own = home[row]
            mine = (cell == own) | ((own < cell) == ((own + cell) % 2 == 0))
            if mine.any():
                yield row[mine], cell[mine]


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(df: DataFrame, *keys: str) -> DataFrame:
    """Blocks of rows as one row each: ids and the vectors one after the other."""
    row = F.struct("rep", "copies", "home", "vector")
    return df.groupBy(*keys).agg(F.collect_list(row).alias("rows")).select(
        *keys, *(F.col(f"rows.{c}").alias(c) for c in ("rep", "copies", "home")), F.flatten("rows.vector").alias("vector"))


def forest(mask: np.ndarray, reps_q: np.ndarray, reps_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``mask`` connects: every linked row or column to the least id of its component."""
    q, x = mask.any(axis=1), mask.any(axis=0)
    mask, a, b = mask[q][:, x], reps_q[q].copy(), reps_x[x].copy()
    own_q, own_x = a.copy(), b.copy()
    big = np.iinfo(np.int64).max
    while len(a):
        a2 = np.minimum(a, np.where(mask, b, big).min(axis=1))
        b2 = np.minimum(b, np.where(mask, a2[:, None], big).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    return np.r_[own_q, own_x], np.r_[a, b]


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Links are pairs of different rows with cosine of COSINE or more; vectors of different lengths are never linked, and
    neither are null, empty and zero vectors and those with null or non-finite components (0 links, own component).
    The traversal is to reach RECALL of the partners at COSINE; what it reaches is compared exactly. Equal vectors are copies: one
    stands for all in the search, and all are counted. A null id stays null, with a null component, and is kept; it counts as a
    linked row of others. Rows that share an id are counted each, by their own vectors. An empty table gives an empty result.
    """
    kind = vectors.schema[vector].dataType
    held = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    base = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(f"array<{held}>").alias("vector"))
    good = base.where(usable(F.col("vector")))
    copies = stage(
        good.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id()).withColumn("length", F.size("vector")))
    lengths = copies.groupBy("length").agg(F.count("*").alias("n"))
    # a table of vectors has one length or few; more than a thousand would be no embeddings
    sizes = {r.length: r.n for r in lengths.orderBy(F.desc("n"), "length").limit(1000).collect()}
    grids = {}
    for length, n in sizes.items():
        rows = copies.where(F.col("length") == length).orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").toArrow()
        grids[length] = Grid(matrix(rows.column("vector").combine_chunks()), max(1, round((n / CELL) ** 0.5)))
    shared = vectors.sparkSession.sparkContext.broadcast(grids)

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Grid | None, np.ndarray]]:
        held = np.array(batch.column("length"))
        for length in np.unique(held).tolist():
            at = np.flatnonzero(held == length)
            yield at, shared.value.get(length), unit(matrix(batch.column("vector").take(pa.array(at))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for at, grid, rows in by_length(batch):
                if grid:
                    x, y = grid.cells(rows)
                    cell[at] = x * grid.size + y
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CARRIED), pa.array(cell)], names=[*CARRIED, "cell"])

    def steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = np.array(batch.column("cell"))
        for at, grid, rows in by_length(batch):
            if grid:
                for row, cell in grid.visits(rows, own[at] // grid.size, own[at] % grid.size):
                    yield at[row], cell
            else:
                yield at, own[at]

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column("cell"))
            for row, cell in steps(batch):
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in CARRIED), pa.array(cell), pa.array(own[row] == cell)], names=[*CARRIED, "cell", "home"])

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.array(batch.column("length"))
            found = [np.stack([length[row], cell]) for row, cell in steps(batch)]
            if found:
                (lengths, cells), n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lengths, pa.int32()), pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["length", "cell", "n"])

    form = f"rep bigint, copies bigint, length int, vector array<{held}>, cell bigint"
    members = stage(copies.select(*CARRIED).mapInArrow(placed, form))
    visits = members.mapInArrow(visiting, f"{form}, home boolean")
    n_members = members.groupBy("length", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("mine"))
    n_visits = members.mapInArrow(counting, "length int, cell bigint, n bigint").groupBy("length", "cell").agg(
        F.ceil(F.sum("n") / BLOCK).alias("theirs"))
    blocks = stage(n_members.join(n_visits, ["length", "cell"]))
    # every member block meets every block of visitors of its cell; both are spread over the pair
    members = members.withColumn("home", F.lit(True))
    sides = []
    for rows, mine, theirs, own, other in ((members, "mine", "theirs", "m", "v"), (visits, "theirs", "mine", "v", "m")):
        dealt = rows.join(blocks, ["length", "cell"]).withColumn(own, F.pmod(F.xxhash64("rep"), F.col(mine)))
        block = packed(dealt, "length", "cell", own, theirs)
        sides.append(block.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop(theirs))
    left, right = sides
    pairs = left.select("length", "cell", "m", "v", *(F.col(c).alias(f"{c}_x") for c in ("rep", "copies", "vector"))).join(
        right.select("length", "cell", "m", "v", *(F.col(c).alias(f"{c}_q") for c in ("rep", "copies", "home", "vector"))),
        ["length", "cell", "m", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                length = batch.column("length")[k].as_py()
                ids_x, ids_q, n_x, n_q, home = (
                    batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("rep_x", "rep_q", "copies_x", "copies_q", "home_q"))
                x, q = (unit(batch.column(c)[k].values.to_numpy().reshape(-1, length)) for c in ("vector_x", "vector_q"))
                mask = (q @ x.T >= COSINE) & (ids_q[:, None] != ids_x[None, :])
                if not mask.any():
                    continue
                a, b = forest(mask, ids_q, ids_x)
                # in its own cell a row is visitor and member, so there the visitor's side counts alone
                away = mask[~home].T @ n_q[~home]
                ids, n = np.r_[ids_q, ids_x], np.r_[mask @ n_x, away]
                edge = np.r_[np.zeros(len(ids), bool), np.ones(len(a), bool)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edge), pa.array(np.r_[ids, a]), pa.array(np.r_[n, b])], names=["edge", "a", "b"]
                ).filter(pa.array(np.r_[n > 0, a != b]))

    out = stage(pairs.mapInArrow(compare, "edge boolean, a bigint, b bigint"))
    counts = out.where("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("near"))
    labels = components(out.where("edge").select("a", "b").distinct()).withColumnRenamed("node", "rep")
    slim = copies.select("rep", "least")
    tops = labels.join(slim, "rep").groupBy("component").agg(F.min("least").alias("top"))
    linked = labels.join(tops, "component").select("rep", "top")
    found = (
        copies.join(counts, "rep", "left").join(linked, "rep", "left")
        .select("vector", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("top", "least").alias("component"))
    )
    joined = base.join(found, "vector", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
