"""Documents that hold benchmark items, found by edit distance.

Symbols are words (runs of word characters, lower case). An item that may take k edits is cut into k + 1 segments; k edits
leave one of them whole, so a document that holds the item has that segment word for word. A window of the item's size is
placed wherever a segment stands, and kept if it and the words around it that edits may add share enough words with the item. A
window and its item take the same random walks (CGK): each step writes the current symbol and moves on if a random bit of
step and symbol says so, which turns few edits into few differing places. Repeated samples of places are compared;
windows that agree in one sample are verified by exact edit distance. What the samples miss is verified in a second way:
the stretches of all other windows, so that no item is lost. Both ways are counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import add_columns, mix, seed_of

WORD = re.compile(r"\w+")
#: Edits allowed, as a share of the item's words (rounded down).
EDITS = 0.2
#: Walks with a sample each, and places in a sample.
REPEATS, PLACES = 32, 2
#: Windows that walk at once.
WALKERS = 4_096
#: Bytes of items that one pass over the documents takes; more items take more passes.
ITEM_BYTES = 16_000_000
#: Words of windows that are looked at at once.
HELD = 2_000_000
_PRIME = np.uint64(0x100000001B3)
_REMEMBERED = 1_000_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def symbols_of(text: str, hashes: WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def chained(hashes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashes of runs that are one symbol longer: each run with the symbol behind it."""
    return mix((hashes * _PRIME) ^ symbols)


def runs_of(symbols: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes of all runs of 1, 2, ... ``longest`` adjacent symbols, by their first place."""
    hashes = mix(symbols)
    for size in range(1, min(longest, len(symbols)) + 1):
        if size > 1:
            hashes = chained(hashes[:-1], symbols[size - 1 :])
        yield size, hashes


def inside(symbols: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hashes of symbols as words of their items."""
    return mix(symbols ^ mix(item.astype(np.uint64) + np.uint64(1)))


class HashIndex:
    """Places of hashes in a sorted array; a bitmap of their low bits turns most others away first."""

    BITS = np.uint64(2**22 - 1)

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.bitmap = np.zeros(2**22, bool)
        self.bitmap[hashes & self.BITS] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are here, and their places."""
        at = np.flatnonzero(self.bitmap[hashes & self.BITS])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes[at]
        return at[hit], place[hit]


class Items:
    """Benchmark items as symbols, and their segments by size."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        hashes = WordHashes()
        kept = [(i, s) for i, s in ((i, symbols_of(t or "", hashes)) for i, t in rows) if len(s) >= 2]
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.symbols = [s for _, s in kept]
        self.sizes = np.array([len(s) for s in self.symbols], np.int64)
        self.most = np.array([int(EDITS * len(s)) for s in self.symbols], np.int64)
        segments: dict[int, list[tuple[int, int, int]]] = {}
        for item, (symbols, most) in enumerate(zip(self.symbols, self.most.tolist(), strict=True)):
            ends = [len(symbols) * j // (most + 1) for j in range(most + 2)]
            longest = max(b - a for a, b in zip(ends[:-1], ends[1:], strict=True))
            runs = dict(runs_of(symbols, longest))
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                segments.setdefault(b - a, []).append((int(runs[b - a][a]), item, a))
        #: By segment size: the distinct hashes, where the segments of each begin and end, their items and offsets.
        self.segments: dict[int, tuple[np.ndarray, ...]] = {}
        for size, found in segments.items():
            found.sort()
            distinct, first = np.unique(np.array([h for h, _, _ in found], np.uint64), return_index=True)
            self.segments[size] = (
                distinct, np.r_[first, len(found)].astype(np.int64),
                np.array([i for _, i, _ in found], np.int64), np.array([o for _, _, o in found], np.int64))
        # walks advance half a word a step: an item of n words ends after 2n steps on average, hardly one before 3n / 2
        noise = mix(np.arange(REPEATS * PLACES, dtype=np.uint64) ^ seed_of(6, 1)).reshape(1, REPEATS, PLACES)
        self.places = np.sort((noise % (self.sizes.astype(np.uint64) * 3 // 2)[:, None, None]).astype(np.int64), axis=2)
        flat = np.concatenate([np.empty(0, np.uint64), *self.symbols])
        begins = np.cumsum(self.sizes) - self.sizes
        parts = [np.arange(k, min(k + WALKERS, len(self.ids))) for k in range(0, len(self.ids), WALKERS)]
        self.keys = np.concatenate([np.empty((0, REPEATS), np.uint64), *(
            walk(flat, begins[i], begins[i] + self.sizes[i], self.places[i]) for i in parts)])
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.words = np.unique(inside(np.concatenate([np.empty(0, np.uint64), *self.symbols]), owner))


def walk(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of every window ``flat[begin:end]`` and walk, the hash of the symbols that the walk writes at the window's
    ``places`` (windows x walks x places); 0, which agrees with nothing, if the window ends before one of them."""
    keys = np.zeros(places.shape[:2], np.uint64)
    last = places.max(axis=(1, 2), initial=-1)
    # the windows that walk longest come first, so that those that have ended drop off the end
    order = np.argsort(-last, kind="stable")
    at, wanted, stop, until = np.repeat(begins[order][:, None], keys.shape[1], axis=1), places[order], ends[order][:, None], last[order]
    walks = np.arange(keys.shape[1])
    made, ended = np.zeros_like(keys), np.zeros(keys.shape, bool)
    for step in range(int(last.max(initial=-1)) + 1):
        n = int(np.searchsorted(-until, -step, "right"))
        now = at[:n]
        inside_window = now < stop[:n]
        symbol = np.where(inside_window, flat[np.minimum(now, len(flat) - 1)], np.uint64(0))
        row, number, _ = np.nonzero(wanted[:n] == step)
        if len(row):
            # a place that a sample has twice is written once
            made[row, number] = mix((made[row, number] * _PRIME) ^ symbol[row, number])
            ended[row, number] |= ~inside_window[row, number]
        bits = mix(walks.astype(np.uint64) ^ seed_of(6, 2, step))
        now += inside_window & ((mix(symbol ^ bits) & np.uint64(1)) == 1)
    keys[order] = np.where(ended, np.uint64(0), made)
    return keys


def edit_distance_within(item: list[int], text: list[int], most: int) -> bool:
    """Whether some stretch of ``text`` is at most ``most`` edits from ``item`` (bit-parallel columns of the edit table)."""
    size = len(item)
    where: dict[int, int] = {}
    for k, s in enumerate(item):
        where[s] = where.get(s, 0) | (1 << k)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    for s in text:
        match = where.get(s, 0)
        across = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score <= most:
            return True
        up, down = (up << 1) & full, (down << 1) & full
        vertical = match | minus
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return False


def finder(items: Items) -> Callable[[list[str]], tuple[list[list[int]], list[list[int]]]]:
    """A function from texts to the sorted ids of the items that each holds, and of those that the walks found."""
    hashes = WordHashes()
    indexes = {size: HashIndex(distinct) for size, (distinct, *_) in items.segments.items()}
    words = HashIndex(items.words)

    def find(texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        held = [symbols_of(x, hashes) for x in texts]
        if not len(items.ids):
            return [[] for _ in texts], [[] for _ in texts]
        flat = np.concatenate([*held, np.empty(0, np.uint64)])
        sizes = np.array([len(x) for x in held], np.int64)
        begins = np.cumsum(sizes) - sizes
        doc_of = np.repeat(np.arange(len(held)), sizes)
        windows = [np.empty((0, 3), np.int64)]
        for size, runs in runs_of(flat, max(indexes)):
            if size not in indexes:
                continue
            _, ends, *_ = items.segments[size]
            at, place = indexes[size].find(runs)
            inner = doc_of[at] == doc_of[at + size - 1]
            at, place = at[inner], place[inner]
            many = ends[place + 1] - ends[place]
            # a run of many items is looked at in parts, too
            total = np.cumsum(many)
            for low in range(0, int(total[-1]) if len(total) else 0, HELD // 16):
                windows.append(placed(size, flat, begins, sizes, doc_of, at, place, total - many, np.arange(low, min(low + HELD // 16, int(total[-1])))))
        doc, item, start = np.unique(np.concatenate(windows), axis=0).T
        found: list[set[int]] = [set() for _ in texts]
        by_walk(flat, begins, sizes, doc, item, start, found)
        walked = [sorted({int(items.ids[k]) for k in x}) for x in found]
        by_stretch(flat, begins, sizes, doc, item, start, found)
        return [sorted({int(items.ids[k]) for k in x}) for x in found], walked

    def bounds(begins, sizes, doc, item, start) -> tuple[np.ndarray, np.ndarray]:
        """The stretch that an item may take whose window starts at ``start``."""
        low = np.maximum(start - items.most[item], begins[doc])
        return low, np.minimum(start + items.sizes[item] + items.most[item], begins[doc] + sizes[doc])

    def placed(size, flat, begins, sizes, doc_of, at, place, before, numbers) -> np.ndarray:
        """Of the windows with these ``numbers`` (document, item, start) those that share enough words with their item;
        ``before`` are counted before each place."""
        _, ends, of_item, offsets = items.segments[size]
        row = np.searchsorted(before, numbers, "right") - 1
        segment = ends[place[row]] + numbers - before[row]
        window = np.unique(np.stack([doc_of[at[row]], of_item[segment], at[row] - offsets[segment]], axis=1), axis=0)
        doc, item, start = window.T
        low, high = bounds(begins, sizes, doc, item, start)
        # an item within its edits shares all but so many words with the window
        shares = np.zeros(len(window), bool)
        total = np.cumsum(high - low)
        cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(HELD, int(total[-1]), HELD)) + 1, len(window)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lengths = high[a:b] - low[a:b]
            owner = np.repeat(np.arange(b - a), lengths)
            places = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + low[a:b][owner]
            hit, _ = words.find(inside(flat[places], item[a:b][owner]))
            shared = np.bincount(owner[hit], minlength=b - a)
            shares[a:b] = shared >= (items.sizes - items.most)[item[a:b]]
        return window[shares]

    def holds(flat, i: int, begin: int, end: int) -> bool:
        return edit_distance_within(items.symbols[i].tolist(), flat[begin:end].tolist(), int(items.most[i]))

    def by_walk(flat, begins, sizes, doc, item, start, found) -> None:
        """Windows that write the same as their item at the places of one sample, verified."""
        low, high = bounds(begins, sizes, doc, item, start)
        first, last = np.maximum(start, begins[doc]), np.minimum(start + items.sizes[item], begins[doc] + sizes[doc])
        for k in range(0, len(doc), WALKERS):
            some = slice(k, k + WALKERS)
            keys = walk(flat, first[some], last[some], items.places[item[some]])
            for m in (np.flatnonzero(((keys == items.keys[item[some]]) & (keys != 0)).any(axis=1)) + k).tolist():
                d, i = int(doc[m]), int(item[m])
                if i not in found[d] and holds(flat, i, int(low[m]), int(high[m])):
                    found[d].add(i)

    def by_stretch(flat, begins, sizes, doc, item, start, found) -> None:
        """The windows of items that the walks did not find; overlapping windows of an item are one stretch."""
        low, high = bounds(begins, sizes, doc, item, start)
        k = 0
        while k < len(doc):
            d, i, begin, end = int(doc[k]), int(item[k]), int(low[k]), int(high[k])
            k += 1
            while k < len(doc) and doc[k] == d and item[k] == i and low[k] <= end:
                end = max(end, int(high[k]))
                k += 1
            if i not in found[d] and holds(flat, i, begin, end):
                found[d].add(i)

    return find


def slices_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about ITEM_BYTES, each small enough for the driver and the tasks."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    for k in range(parts):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [(r.item_id, r.text) for r in mine.collect()]


def find_items(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with ``__items``: the sorted ids of the items that the whole text holds within a fifth of their words
    in edits (word inserted, left out or replaced), and ``__walked``: those of them that the random walks found.

    Items of fewer than two words, null or empty items match nothing; null and empty texts hold none. Repeated
    items are found each (one id twice counts once), repeated rows repeat their result. All columns are kept; a table that
    has one of the new names already raises ValueError. Items come to the driver in slices of a bounded size; every slice is
    one pass of search.
    """
    taken = {c.lower() for c in docs.columns} & {"__items", "__walked"}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    given = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    made, steps = docs, []
    for k, rows in enumerate(slices_of(given.where("item_id IS NOT NULL"))):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def begin(shared=shared) -> Callable:
            return finder(shared.value)

        steps.append((f"__items_{k}", f"__walked_{k}"))
        made = add_columns(made, text, [(name, T.ArrayType(T.LongType())) for name in steps[-1]], begin)
    none = F.array().cast("array<bigint>")
    for n, name in enumerate(("__items", "__walked")):
        made = made.withColumn(name, F.array_sort(F.array_distinct(F.flatten(F.array(none, *(x[n] for x in steps))))))
    return made.drop(*(name for x in steps for name in x))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, contaminated, n_items, items, n_walked`` for every row of ``docs``: ``n_walked`` of its items were found by the
    random walks, the others by the second way; see ``find_items``."""
    found = find_items(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), benchmark)
    return found.select(
        "doc_id", (F.size("__items") > 0).alias("contaminated"), F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("items"),
        F.size("__walked").cast("long").alias("n_walked"))
