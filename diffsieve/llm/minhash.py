"""Near duplicates by probability Jaccard of weighted word shingles.

A text is the weighted set of its five-word shingles, the weight being how often a shingle occurs. The signature has
REGISTERS registers. Every shingle sends arrivals of a Poisson process whose rate is its weight; each arrival goes to a
random register, which keeps the earliest one. A shingle stops as soon as its next arrival is later than all
registers hold, so nearly all shingles stop after one. Two texts agree in a register with the probability that is their
probability Jaccard. Bands of registers give candidates; every link is verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffsieve.llm.common import components, explode_texts, mix, seed_of, with_text
from diffsieve.staging import stage

WORDS = 5
LEAST = 0.8
#: 24 bands of 6 registers miss a pair of similarity 0.8 with probability (1 - 0.8^6)^24 = 0.0007.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Pairs that a bucket's centre does not link are verified if this share of registers agrees: three standard errors below LEAST.
SCREEN = 0.7
#: Texts of a bucket that are compared with each other in one step.
BLOCK = 256
_PRIME = np.uint64(0x100000001B3)
_REMEMBERED = 1_000_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles_of(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Hashes of all shingles in order. A text of one to four words is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    out = np.full(len(own) - width + 1, len(words) if len(words) < WORDS else 0, np.uint64)
    for k in range(width):
        out = mix((out * _PRIME) ^ own[k : len(own) - width + 1 + k])
    return out


def words_of(text: str) -> list[str]:
    return text.lower().split()


def signatures_of(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The shingle that holds each register of each text, from distinct shingles, their weights and their texts' numbers.

    All texts advance together: one round gives every live shingle its next arrival."""
    times = np.full(texts * REGISTERS, np.inf)
    holders = np.zeros(texts * REGISTERS, np.uint64)
    clock = np.zeros(len(shingles))
    who, rate, draw = shingles, weights.astype(float), 0
    while len(who):
        noise = mix(who ^ seed_of(4, draw))
        clock = clock - np.log(((noise >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        slot = owner * REGISTERS + (mix(noise ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS)).astype(np.int64)
        better = np.flatnonzero(clock < times[slot])
        np.minimum.at(times, slot[better], clock[better])
        holding = better[clock[better] == times[slot[better]]]
        holders[slot[holding]] = who[holding]
        live = clock < times.reshape(texts, REGISTERS).max(axis=1)[owner]
        who, rate, clock, owner = who[live], rate[live], clock[live], owner[live]
        draw += 1
    return holders.reshape(texts, REGISTERS)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d), from (sorted distinct shingles, weights) each."""
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = x[1][i].astype(float), y[1][j].astype(float)
    only_x, only_y = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    # max(a_e / a_d, b_e / b_d): the first wins where a_e / b_e > a_d / b_d
    ratio = a / b
    values, group = np.unique(ratio, return_inverse=True)
    a_of, b_of = np.bincount(group, a), np.bincount(group, b)
    a_above = a_of.sum() - np.cumsum(a_of) + only_x
    b_upto = np.cumsum(b_of) + only_y
    return float((1 / (a_above[group] / a + b_upto[group] / b)).sum())


def weighted(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles_of(words_of(text), hashes), return_counts=True)


def counted(texts: list[list[str]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, weights and text numbers of several texts."""
    parts = [shingles_of(words, hashes) for words in texts]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    flat = np.concatenate([np.empty(0, np.uint64), *parts])
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    begins = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])][: len(flat)])
    return flat[begins], np.diff(np.r_[begins, len(flat)]), owner[begins]


def signatures(docs: DataFrame) -> DataFrame:
    """``doc, copy_of, registers, bands`` of ``(__id, __text)`` with at least one word. ``copy_of`` names the sequence of
    words by 128 bits, ``registers`` holds 16 bits of each register."""
    powers = np.cumprod(np.full(ROWS, _PRIME, np.uint64))

    def begin() -> Callable:
        hashes = WordHashes()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(part.column("__id").to_pylist(), part.column("__text").to_pylist(), strict=True)
            kept = [(doc, words) for doc, words in ((d, words_of(t or "")) for d, t in rows) if doc is not None and words]
            texts = [words for _, words in kept]
            held = signatures_of(*counted(texts, hashes), len(texts))
            banded = mix((held.reshape(-1, BANDS, ROWS) * powers).sum(axis=2) ^ np.arange(BANDS, dtype=np.uint64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([doc for doc, _ in kept], pa.int64()),
                    pa.array([xxhash.xxh128_digest(" ".join(words)) for words in texts], pa.binary()),
                    pa.array([row.tobytes() for row in held.astype("<u2")], pa.binary()),
                    pa.array(list(banded.view(np.int64)), pa.list_(pa.int64())),
                ],
                names=["doc", "copy_of", "registers", "bands"],
            )

        return work

    return explode_texts(docs, "__text", "doc bigint, copy_of binary, registers binary, bands array<bigint>", begin)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of at least LEAST, judged on the whole texts ``(doc, text)``."""
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(
        texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple[int | None, tuple] = (None, ())
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for k in range(batch.num_rows):
                if a[k] != last[0]:
                    last = (a[k], weighted(batch.column("text_a")[k].as_py(), hashes))
                keep.append(probability_jaccard(last[1], weighted(batch.column("text_b")[k].as_py(), hashes)) >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


#: Of the members of a block that pass the screen, these are verified in a first and a last round, best agreement first.
#: A round only looks at documents that are still in different components. The last one takes all ranks: a bucket's main
#: component can be another one by then, whose members it no longer ranks from their side.
ROUNDS = ((0, 4), (0, 1 << 30))


def _halves(size: str) -> str:
    """How often a group of ``size`` rows is halved to leave about BLOCK in a part."""
    return f"CAST(greatest(0, ceil(log2({size} / {BLOCK}))) AS INT)"


def _part(doc: str, size: str) -> str:
    """The part of a group that a document falls in. Parts of a larger group cut those of a smaller one, never across."""
    return f"(xxhash64({doc}) & (shiftleft(1L, {_halves(size)}) - 1))"


def _cell(doc: str) -> Column:
    return F.expr(f"xxhash64(component, {_part(doc, 'size')})")


def cells(stars: DataFrame) -> DataFrame:
    """``(doc, cell, component, size)``: documents that chains of common buckets connect, in parts of about BLOCK."""
    groups = components(stars)
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    return groups.join(sizes, "component").select(F.col("node").alias("doc"), _cell("node").alias("cell"), "component", "size")


def other_stars(stars: DataFrame, placed: DataFrame, labels: DataFrame) -> DataFrame:
    """The stars besides each document's least centre whose ends are still in different components, packed by the cells of their ends.

    A centre's cell follows from its document's component, so no star is a row of a join: documents are joined with their place, and
    cells with the labels of their members.
    """
    per_doc = stars.groupBy("b").agg(F.collect_list("a").alias("centres")).where("size(centres) > 1")
    spread = per_doc.join(placed.withColumnRenamed("doc", "b"), "b").select(
        F.col("cell").alias("cell_b"), "b", "component", "size",
        F.explode(F.filter("centres", lambda c: c > F.array_min("centres"))).alias("a"))
    packed = spread.select(_cell("a").alias("cell_a"), "cell_b", "a", "b").groupBy("cell_a", "cell_b").agg(
        F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    members = stage(placed.join(labels.withColumnRenamed("component", "label"), F.col("doc") == F.col("node"), "left").groupBy("cell").agg(
        F.collect_list("doc").alias("docs"), F.collect_list(F.coalesce("label", "doc")).alias("labels")))
    named = lambda side: members.select(*[F.col(c).alias(f"{c}_{side}") for c in ("cell", "docs", "labels")])
    columns = ("a", "b", "docs_a", "labels_a", "docs_b", "labels_b")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, b, docs_a, labels_a, docs_b, labels_b = (
                    batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in columns)
                label = dict(zip(docs_a.tolist(), labels_a.tolist(), strict=True)) | dict(zip(docs_b.tolist(), labels_b.tolist(), strict=True))
                apart = np.array([label[x] != label[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
                if apart.any():
                    out.append((batch.column("cell_a")[k].as_py(), batch.column("cell_b")[k].as_py(), a[apart].tobytes(), b[apart].tobytes()))
            made = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=["cell_a", "cell_b", "a", "b"])

    both = packed.join(named("a"), "cell_a").join(named("b"), "cell_b")
    return both.select("cell_a", "cell_b", *columns).mapInArrow(part, "cell_a bigint, cell_b bigint, a binary, b binary")


def leftover_pairs(buckets: DataFrame, heads: DataFrame, labels: DataFrame, ranks: tuple[int, int]) -> DataFrame:
    """Pairs of one bucket in different components whose registers agree enough, by their rank in a block.

    In every bucket the largest component is the main one; members of others are compared with all members, in
    blocks of registers. A pair of several buckets comes from the first of their bands only. The pairs of two cells
    stay packed in one row ``cell_a, cell_b, a, b`` (ids as bytes), so that a large group never becomes a row per pair.
    """
    member = buckets.join(labels, buckets.doc == labels.node, "left").select(
        "bucket", "doc", F.coalesce("component", "doc").alias("label"))
    by_label = member.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("bucket").agg(
        F.count("*").alias("labels"), F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main")
    ).where("labels > 1 AND size > 2")
    rows = stage(
        member.join(mixed.select("bucket", "size", "main"), "bucket")
        .join(heads.select("doc", "cell", "registers", "bands"), "doc")
        .select("bucket", "doc", "cell", "label", "registers", "bands", (F.col("label") != F.col("main")).alias("outside"),
                F.expr(_part("doc", "size")).alias("block")))
    packed = F.collect_list(F.struct("doc", "cell", "label", "registers", "bands"))
    left = rows.where("outside").groupBy("bucket", "block").agg(packed.alias("one")).drop("block")
    right = rows.groupBy("bucket", "block").agg(packed.alias("other")).drop("block")

    def arrays(items: list[dict]) -> tuple[np.ndarray, ...]:
        held = np.frombuffer(b"".join(x["registers"] for x in items), "<u2").reshape(len(items), REGISTERS)
        return *(np.array([x[c] for x in items], np.int64) for c in ("doc", "cell", "label")), held, np.array([x["bands"] for x in items])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                bucket = batch.column("bucket")[k].as_py()
                doc, cell, label, held, bands = arrays(batch.column("one")[k].as_py())
                docs, their_cells, others, theirs, their_bands = arrays(batch.column("other")[k].as_py())
                found = []
                for i in range(len(doc)):
                    same = (theirs == held[i]).sum(axis=1)
                    best = np.lexsort((docs, -same))[: int((same >= SCREEN * REGISTERS).sum())]
                    best = best[docs[best] != doc[i]][ranks[0] : ranks[1]]
                    first = bands[i][(their_bands[best] == bands[i]).argmax(axis=1)] == bucket
                    best = best[(others[best] != label[i]) & first]
                    b, cell_b = docs[best], their_cells[best]
                    later = doc[i] > b
                    found.append(np.stack([
                        np.where(later, cell_b, cell[i]), np.where(later, cell[i], cell_b), np.minimum(doc[i], b), np.maximum(doc[i], b)]))
                pairs = np.concatenate(found, axis=1)
                pairs = pairs[:, np.lexsort(pairs[:2])]
                begins = np.flatnonzero(np.r_[True, (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)][: pairs.shape[1]])
                for start, end in zip(begins, np.r_[begins, pairs.shape[1]][1:], strict=True):
                    out.append((int(pairs[0, start]), int(pairs[1, start]), pairs[2, start:end].tobytes(), pairs[3, start:end].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cell_a", "cell_b", "a", "b"])

    return left.join(right, "bucket").select("bucket", "one", "other").mapInArrow(compare, "cell_a bigint, cell_b bigint, a binary, b binary")


def pairs_of(packed: list[dict]) -> np.ndarray:
    """All distinct pairs of the packed ones."""
    a, b = (np.frombuffer(b"".join(x[c] for x in packed), np.int64) for c in "ab")
    return np.unique(np.stack([a, b], axis=1), axis=0)


def verified_cells(packed: DataFrame, labels: DataFrame, texts_for: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` among the packed pairs that join what other links of the same two cells have not joined.

    Every text of a cell meets the other cell's texts once, not once a pair; each is cut into shingles once.
    """
    cell = ["cell_a", "cell_b"]
    both = stage(packed.groupBy(*cell).agg(F.collect_list(F.struct("a", "b")).alias("packed")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.unique(pairs_of(x)) for x in batch.column("packed").to_pylist()]
            owner = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
            yield pa.RecordBatch.from_arrays(
                [batch.column("cell_a").take(pa.array(owner)), batch.column("cell_b").take(pa.array(owner)),
                 pa.array(np.concatenate([np.empty(0, np.int64), *docs]))], names=[*cell, "doc"])

    needed = stage(both.mapInArrow(members, "cell_a bigint, cell_b bigint, doc bigint"))
    known = texts_for(needed).join(labels, F.col("doc") == F.col("node"), "left").select(
        "doc", "text", F.coalesce("component", "doc").alias("label"))
    held = needed.join(known.hint("merge"), "doc").groupBy(*cell).agg(F.collect_list(F.struct("doc", "label", "text")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            links = []
            for k in range(batch.num_rows):
                texts = {x["doc"]: x for x in batch.column("held")[k].as_py()}
                above = {x["label"]: x["label"] for x in texts.values()}
                shingles = {}

                def top(doc: int) -> int:
                    label = texts[doc]["label"]
                    while above[label] != label:
                        above[label] = label = above[above[label]]
                    return label

                for a, b in pairs_of(batch.column("packed")[k].as_py()).tolist():
                    if (x := top(a)) == (y := top(b)):
                        continue
                    for doc in (a, b):
                        if doc not in shingles:
                            shingles[doc] = weighted(texts[doc]["text"], hashes)
                    if probability_jaccard(shingles[a], shingles[b]) >= LEAST:
                        above[max(x, y)] = min(x, y)
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return both.join(held.hint("merge"), cell).select("packed", "held").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``docs``.

    ``class_id`` is the least id of the documents that links of similarity 0.8 or more connect, ``kept`` marks that
    document. Texts of the same words (case and white space aside) are copies: one of them, the least id, stands
    for all in the search. Null, empty and blank texts link with nothing, and a null id has a null class and is kept.
    Rows that share an id share a class and are all kept or not. Other columns are not read.

    A bucket of a band links its members to its least member, never all to all. Every document is verified against the least of
    its centres, and the others cell against cell where that left it apart. Members that this leaves in other components are compared by their registers in blocks and verified cell against cell, so that no link is lost for lack
    of a common centre.
    """
    base = with_text(docs, doc_id, text)
    rows = stage(signatures(base))
    copies = stage(rows.groupBy("copy_of").agg(F.min("doc").alias("first"), F.count("*").alias("n")))
    heads = stage(rows.join(copies.select(F.col("first").alias("doc"), "copy_of"), ["doc", "copy_of"], "left_semi").dropDuplicates(["doc"]))
    spread = heads.select("doc", F.explode("bands").alias("bucket"))
    centres = spread.groupBy("bucket").agg(F.min("doc").alias("centre"), F.count("*").alias("n")).where("n > 1")
    buckets = stage(spread.join(centres, "bucket").select("bucket", "doc", "centre", "n"))
    stars = stage(buckets.where("doc <> centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct())

    def texts_for(members: DataFrame) -> DataFrame:
        wanted = members.select("doc").distinct()
        # the same kind of join at every size: a broadcast would make the shuffled bytes jump once it no longer fits
        found = base.join(wanted.hint("merge"), F.col("__id") == F.col("doc"), "left_semi")
        return stage(found.select(F.col("__id").alias("doc"), F.col("__text").alias("text")).dropDuplicates(["doc"]))

    least = stage(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = stage(verified(least, texts_for(least.select(F.col("a").alias("doc")).union(least.select("b")))))
    labels = components(links)
    place = stage(cells(stars))
    rest = stage(other_stars(stars, place, labels))
    if rest.take(1):
        links = links.unionByName(stage(verified_cells(rest, labels, texts_for)))
        labels = components(links)
    placed = stage(heads.join(place.select("doc", "cell"), "doc"))
    several = buckets.where("n > 2").select("bucket", "doc")
    for ranks in ROUNDS:
        rest = stage(leftover_pairs(several, placed, labels, ranks))
        if rest.take(1):
            links = links.unionByName(stage(verified_cells(rest, labels, texts_for)))
            labels = components(links)
    of_copy = rows.select("doc", "copy_of").join(copies, "copy_of").select("doc", "first")
    # documents of one id with different texts meet in their id
    bridges = of_copy.where("doc <> first").select(F.col("doc").alias("node"), "first")
    known = labels.withColumnRenamed("node", "first")
    classes = bridges.join(known, "first", "left").select("node", F.coalesce("component", "first").alias("class"))
    classes = classes.unionByName(
        of_copy.where("doc = first").select("first").distinct().join(known, "first", "left").select(
            F.col("first").alias("node"), F.coalesce("component", "first").alias("class"))
    ).groupBy("node").agg(F.min("class").alias("class"))
    out = base.select("__id").join(classes, F.col("__id") == F.col("node"), "left")
    class_id = F.coalesce("class", "__id")
    return out.select(
        F.col("__id").alias("doc_id"), class_id.alias("class_id"), F.coalesce(class_id == F.col("__id"), F.lit(True)).alias("kept"))
