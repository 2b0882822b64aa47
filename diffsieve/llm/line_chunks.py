"""Removal of repeated chunks of lines.

A text is cut into lines: at line breaks, behind marks that end a sentence or a clause, and in long lines behind words that their
own hash chooses, so that a passage pasted into the middle of a line still has whole lines. A hash rolled over the hashes
of the last WINDOW lines chooses the chunks' ends, so that equal passages have equal chunks inside, wherever they stand. Chunks
are compared by their bytes over all documents; the first occurrence stays. Every other one is grown outwards line by line as
long as the lines around it equal those around the first. What makes up a stretch of several lines goes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import explode_texts, mix, with_text
from diffsieve.staging import stage

#: A line ends behind a line break, or behind marks and the white space that may follow them.
MARKS = ".!?,;:。！？，；：、"
#: A line of more characters is also cut behind every word (between spaces) whose hash is a multiple of WORD_CUT.
LONG_LINE, WORD_CUT = 60, 4
#: A chunk ends behind a line with this chance, decided by the hash of the last WINDOW lines. A chunk has LEAST to GREATEST lines
#: (a text's last one may have fewer).
WINDOW, BOUNDARY, LEAST, GREATEST = 2, 0.65, 2, 16
#: A repeated stretch is removed if it has so many lines and words.
LEAST_LINES, LEAST_WORDS = 2, 16
_PRIME = np.uint64(0x100000001B3)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_XXH = tuple(map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))
#: Texts are cut in groups of about so many characters.
_CHARS = 500_000
#: Chunks with so many rows, at most so many of the most frequent ones, are dealt to SHARES tasks.
OFTEN, MOST_OFTEN, SHARES = 1_000, 100_000, 64
#: Bits of the map of repeated chunks: 64 to 128 a chunk, within these bounds (1 and 32 MB).
_LEAST_BITS, _MOST_BITS = 1 << 23, 1 << 28
#: Kinds of bytes, and of code points; _LEAD_2 and _LEAD_3 begin code points that may be white space or marks.
_MARK, _LEAD_2, _LEAD_3, _SPACE, _BREAK = 1, 2, 3, 4, 5
_WIDE = np.zeros(0x10000, np.uint8)
_WIDE[[k for k in range(0x3001) if chr(k).isspace()]] = _SPACE
_WIDE[list(map(ord, MARKS))] = _MARK
_WIDE[ord("\n")] = _BREAK
_KIND = np.append(_WIDE[:128], np.zeros(128, np.uint8))
for _code in np.flatnonzero(_WIDE[128:]) + 128:
    _KIND[chr(_code).encode()[0]] = _LEAD_2 if _code < 0x800 else _LEAD_3


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def hashes_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of many stretches of bytes; those of 32 bytes and more come from the library. ``data`` has 8 more bytes behind the last stretch."""
    one, two, three, four, five = _XXH
    size = end - begin
    out = size.astype(np.uint64) + five
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    fours = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    left, at = size & 31, begin.copy()
    for _ in range(3):
        k = np.flatnonzero(left >= 8)
        if not len(k):
            break
        out[k] = _turned(out[k] ^ (_turned(eights[at[k]] * two, 31) * one), 27) * one + four
        left[k] -= 8
        at[k] += 8
    k = np.flatnonzero(left >= 4)
    out[k] = _turned(out[k] ^ (fours[at[k]].astype(np.uint64) * one), 23) * two + three
    left[k] -= 4
    at[k] += 4
    for n in range(3):
        k = np.flatnonzero(left > n)
        out[k] = _turned(out[k] ^ (data[at[k] + n].astype(np.uint64) * five), 11) * one
    out ^= out >> np.uint64(33)
    out *= two
    out ^= out >> np.uint64(29)
    out *= three
    out ^= out >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    held = memoryview(data)
    out[long] = np.fromiter(
        (xxhash.xxh64_intdigest(held[x:y]) for x, y in zip(begin[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return out


class WordCuts:
    """Whether a long line is cut behind each of many words, given by their bytes."""

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (hashes_of(data, begin, end) % np.uint64(WORD_CUT) == 0) & (end > begin)


class Lines:
    """The lines of several texts, as places among the UTF-8 bytes of the texts put together. The lines of a text are the whole text; white
    space alone belongs to the line before it, or to the first one."""

    def __init__(self, texts: pa.Array, cuts: WordCuts) -> None:
        texts = texts.cast(pa.string()).fill_null("")
        places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        size = int(places[-1] - places[0])
        self.data = np.zeros(size + 8, np.uint8)
        if size:
            self.data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[places[0] : places[-1]]
        self.stop = places[1:] - places[0]
        self.start = places[:-1] - places[0]
        if not size:
            self.begin = self.end = np.empty(0, np.int64)
            self.sizes, self.solid = np.zeros(len(texts), np.int64), np.empty(0, bool)
            return
        data = self.data[:size]
        kind = _KIND[data]
        wide = self.wide(data, kind)
        self.solid = kind < _SPACE
        heads, tails = self.start[self.stop > self.start], self.stop[self.stop > self.start] - 1
        ends = kind == _BREAK
        mark = kind[:-1] == _MARK
        ends[:-1] |= mark & (kind[1:] == 0)
        mark[tails[:-1]] = False
        ends[1:] |= mark & (kind[1:] >= _SPACE)
        for first, bytes_ in wide:  # the end is behind the last byte
            first = first[ends[first]]
            ends[first] = False
            ends[first + bytes_ - 1] = True
        ends[tails] = True
        end = np.flatnonzero(ends) + 1
        begin = np.append(0, end[:-1])
        long = end - begin > LONG_LINE
        if long.any():
            if data.max() > 127:
                inner = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no letter
                long[long] = np.diff(np.searchsorted(inner, np.stack([begin[long], end[long]])), axis=0)[0] < (end - begin)[long] - LONG_LINE
            # words end at blanks and at the lines' ends
            stops = (data == 32) & np.repeat(long, end - begin)
            blanks = stops.copy()
            stops[end[long] - 1] = True
            stops = np.flatnonzero(stops)
            from_ = np.append(0, stops[:-1] + 1)
            new = np.searchsorted(stops, begin[long])
            from_[new] = begin[long]
            chosen = cuts(self.data, from_, np.where(blanks[stops], stops, stops + 1))
            ends[stops[chosen]] = True
            end = np.flatnonzero(ends) + 1
            begin = np.append(0, end[:-1])
        filled = self.trimmed(begin, end) > begin
        head = np.searchsorted(begin, heads)
        earlier = np.cumsum(filled) - filled
        starts = filled & (earlier > np.repeat(earlier[head], np.diff(head, append=len(begin))))
        starts[head] = True
        self.begin = begin[starts]
        self.end = np.append(self.begin[1:], size)
        self.sizes = np.searchsorted(self.begin, self.stop) - np.searchsorted(self.begin, self.start)

    @staticmethod
    def wide(data: np.ndarray, kind: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Sets the kinds of white space and marks of several bytes; the first bytes of such white space, and how many bytes it has."""
        out = []
        for bytes_, lead in ((2, kind == _LEAD_2), (3, kind == _LEAD_3)):
            at = np.flatnonzero(lead)
            code = data[at].astype(np.int32) & (0x1F if bytes_ == 2 else 0x0F)
            for k in range(1, bytes_):
                code = code << 6 | data[at + k] & 0x3F
            own = _WIDE[code]
            for k in range(bytes_):
                kind[at + k] = own
            out.append((at[own == _SPACE], bytes_))
        return out

    def trimmed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each line ends without the white space at its end; a blank line where it begins."""
        out, k = end.copy(), np.arange(len(end))
        for _ in range(4):
            k = k[(out[k] > begin[k]) & ~self.solid[out[k] - 1]]
            out[k] -= 1
        k = k[(out[k] > begin[k]) & ~self.solid[out[k] - 1]]
        if len(k):
            places = np.append(-1, np.flatnonzero(self.solid))
            out[k] = np.maximum(begin[k], places[np.searchsorted(places, out[k]) - 1] + 1)
        return out

    def stripped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of the lines without the white space around them, and the lines of each text, in which a blank text has none."""
        if not len(self.begin):
            return self.begin, self.end, self.sizes
        until = self.trimmed(self.begin, self.end)
        filled = until > self.begin
        begin, until = self.begin[filled], until[filled]
        k = np.flatnonzero(~self.solid[begin])
        if len(k):
            places = np.flatnonzero(self.solid)
            begin[k] = places[np.searchsorted(places, begin[k])]
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return begin, until, np.bincount(owner[filled], minlength=len(self.sizes))

    def words(self) -> np.ndarray:
        """Words of each line, between white space."""
        if not len(self.begin):
            return np.empty(0, np.int64)
        first = self.solid.copy()
        first[1:] &= ~self.solid[:-1]
        first[self.begin] = self.solid[self.begin]
        return np.add.reduceat(first, self.begin, dtype=np.int64)

    def put_together(self, begin: np.ndarray, end: np.ndarray) -> bytes:
        """Stretches, ascending, with a line break behind each."""
        out = np.full(int((end - begin).sum()) + len(begin), 10, np.uint8)
        free = np.ones(len(out), bool)
        free[np.cumsum(end - begin + 1) - 1] = False
        inside = np.zeros(2 * len(begin) + 1, bool)
        inside[1::2] = True
        edges = np.stack([begin, end], axis=1).ravel()
        out[free] = self.data[np.repeat(inside, np.diff(edges, prepend=0, append=len(self.data)))]
        return out.tobytes()


def lines_of(text: str, cuts: WordCuts) -> list[str]:
    """The lines, which together are the text."""
    lines = Lines(pa.array([text]), cuts)
    held = lines.data.tobytes()
    return [held[x:y].decode() for x, y in zip(lines.begin.tolist(), lines.end.tolist(), strict=True)]


def chunk_starts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First lines of the chunks of several texts, from the hashes of all their lines and the number of lines of each."""
    total = len(hashes)
    sizes = sizes[sizes > 0]
    last = np.cumsum(sizes) - 1
    rolled = np.zeros(total, np.uint64)
    place = np.arange(total) - np.repeat(last + 1 - sizes, sizes)
    for back in range(WINDOW - 1, -1, -1):
        own = np.where(place >= back, np.roll(hashes, back), np.uint64(0))
        rolled = mix(rolled * _PRIME ^ own)
    final = np.zeros(total, bool)
    final[last] = True
    # the first boundary at or behind each line, then where a chunk that begins at a line would end
    ends = np.where((rolled < np.uint64(int(BOUNDARY * 2**64))) | final, np.arange(total), total)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    least = np.minimum(np.arange(total) + LEAST - 1, np.repeat(last, sizes))
    following = (np.minimum(ends[least], np.arange(total) + GREATEST - 1) + 1).tolist()
    starts, start = [], 0
    while start < total:
        starts.append(start)
        start = following[start]
    return np.array(starts, np.int64)


PLACE = "h bigint, doc bigint"
AROUND = "line int, share int, size int, chunk string, n_before int, before string, n_after int, after string"


def chunk_rows(docs: DataFrame, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """``h, doc`` of ``(__id, __text)``: 64 bits of hash of each chunk. With ``wanted`` (see ``may_repeat``) only chunks that may repeat, with the
    numbers of their first ``line`` and ``share``, their number of lines and texts (lines without the white space around each) and those of the
    two chunks ``before`` and of the one ``after`` it."""

    def begin() -> Callable:
        cuts = WordCuts()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            lines = Lines(part.column("__text"), cuts)
            from_, to, sizes = lines.stripped()
            hashes = hashes_of(lines.data, from_, to)
            starts = chunk_starts(hashes, sizes)
            ends = np.append(starts[1:], len(hashes)) if len(starts) else starts
            place = (np.arange(len(hashes)) - np.repeat(starts, ends - starts)).astype(np.uint64)
            h = np.add.reduceat(mix(hashes ^ (place + np.uint64(1)) * _SALT), starts).view(np.int64) if len(starts) else np.empty(0, np.int64)
            owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
            docs_ = part.column("__id").to_numpy(zero_copy_only=False)[owner]
            own_first = (np.cumsum(sizes) - sizes)[owner]
            if wanted is None:
                return pa.RecordBatch.from_arrays([pa.array(h), pa.array(docs_)], names=["h", "doc"])
            columns = [h, docs_, (starts - own_first).astype(np.int32)]
            # every line and one break
            at, held = np.append(0, np.cumsum(to - from_ + 1)), lines.put_together(from_, to)

            def slices(first: np.ndarray, end: np.ndarray) -> pa.Array:
                return pa.array([held[x : y - 1] if y > x else None for x, y in zip(at[first].tolist(), at[end].tolist(), strict=True)], pa.string())

            k, share = wanted(h, docs_, owner)
            own_end = np.cumsum(sizes)[owner[k]]
            before = np.maximum(starts[np.maximum(k - 2, 0)], own_first[k])
            after = np.minimum(ends[np.minimum(k + 1, len(ends) - 1)] if len(ends) else k, own_end)
            columns = [
                *(pa.array(x[k]) for x in columns), pa.array(share), pa.array((ends - starts)[k].astype(np.int32)), slices(starts[k], ends[k]),
                pa.array((starts[k] - before).astype(np.int32)), slices(before, starts[k]),
                pa.array((after - ends[k]).astype(np.int32)), slices(ends[k], after),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in f"{PLACE}, {AROUND}".split(", ")])

        return work

    return explode_texts(docs, "__text", PLACE if wanted is None else f"{PLACE}, {AROUND}", begin, _CHARS)


def equal_ahead(a: Column, b: Column) -> Column:
    """How many first elements of two arrays of texts are equal; 0 if one is null."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    return F.coalesce(F.when(differs > 0, differs - 1).otherwise(F.size(same)), F.lit(0)).cast("int")


def grown(n: Column, a: Column, b: Column, last: bool) -> Column:
    """How many lines of two texts are equal, from their first ones on, or from their last ones back; ``a`` has ``n`` lines."""
    nearest = lambda c: F.substring_index(c, "\n", -1 if last else 1)
    parts = lambda c: F.reverse(F.split(c, "\n")) if last else F.split(c, "\n")
    return (
        F.when(a.isNull() | b.isNull(), 0).when(a == b, n).when(nearest(a) != nearest(b), 0).otherwise(equal_ahead(parts(a), parts(b))))


def without(texts: pa.Array, spans: pa.Array, cuts: WordCuts) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """The texts without long enough stretches of repeated lines (``first << 32 | end``; null: none), and the lines and words that went from
    each. A text that stays is None."""
    lines = Lines(texts, cuts)
    total, tail = len(lines.begin), np.cumsum(lines.sizes)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten().to_numpy(zero_copy_only=False)
    head = (tail - lines.sizes)[owner]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, np.minimum(head + (flat >> 32), tail[owner]), 1)
    np.add.at(change, np.minimum(head + (flat & 0xFFFFFFFF), tail[owner]), -1)
    gone = np.cumsum(change)[:total] > 0
    # a stretch begins where a text does or the line before stays
    first = np.zeros(total, bool)
    first[(tail - lines.sizes)[lines.sizes > 0]] = True
    starts = np.flatnonzero(gone & (first | ~np.append(False, gone[:-1])[:total]))
    stays = np.flatnonzero(np.append(~gone | first, True))
    ends = stays[np.searchsorted(stays, starts, side="right")]
    words = np.append(0, np.cumsum(lines.words()))
    n_words = words[ends] - words[starts]
    enough = (ends - starts >= LEAST_LINES) & (n_words >= LEAST_WORDS)
    starts, ends, n_words = starts[enough], ends[enough], n_words[enough]
    of = np.searchsorted(tail, starts, side="right")
    gone_lines, gone_words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    np.add.at(gone_lines, of, ends - starts)
    np.add.at(gone_words, of, n_words)
    held, out = lines.data.tobytes(), [None] * len(texts)
    stretches = zip(lines.begin[starts].tolist(), lines.end[ends - 1].tolist(), strict=True)
    touched, counts = np.unique(of, return_counts=True)
    for i, n, done, stop in zip(touched.tolist(), counts.tolist(), lines.start[touched].tolist(), lines.stop[touched].tolist(), strict=True):
        kept = []
        for begin, end in islice(stretches, n):
            piece = held[done:begin].decode()
            kept.append(piece)
            # what stands before and after must not run together
            if piece and not piece[-1].isspace():
                kept.append("\n" if held[end - 1 : end] == b"\n" else " ")
            done = end
        out[i] = "".join([*kept, held[done:stop].decode()])
    return out, gone_lines, gone_words


def may_repeat(repeated: DataFrame) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from the ``h`` and ``doc`` of chunks and the numbers of their texts to the chunks that may be among ``repeated(h, least, n)``
    and the share of each. None that is gets lost; others pass by chance, about one in a hundred. The rows of a very frequent chunk are dealt to SHARES
    shares by their document, and the first one of the ``least`` document goes to every share. A map of bits and a list, both of bounded size, go to
    all tasks."""
    bits = min(max(_LEAST_BITS, 1 << (64 * repeated.count()).bit_length()), _MOST_BITS)
    place = F.pmod(F.col("h"), F.lit(bits)) + 1
    made = repeated.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy(
        "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    map_ = np.zeros(bits // 8, np.uint8)
    for bucket, row in made.collect():
        map_[(bucket - 1) * len(row) : bucket * len(row)] = np.frombuffer(row, np.uint8)
    often = repeated.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST_OFTEN).select("h", "least").collect()
    often = np.array(sorted((r.h, r.least) for r in often), np.int64).reshape(-1, 2).T.copy()
    shared = repeated.sparkSession.sparkContext.broadcast((map_, often))

    def wanted(h: np.ndarray, doc: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        map_, (keys, least) = shared.value
        bit = h % np.int64(bits)
        k = np.flatnonzero(map_[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
        share = np.zeros(len(k), np.int32)
        if not len(keys):
            return k, share
        at = np.minimum(np.searchsorted(keys, h[k]), len(keys) - 1)
        frequent = keys[at] == h[k]
        share[frequent] = (mix(doc[k][frequent].view(np.uint64)) % np.uint64(SHARES)).astype(np.int32)
        first = np.flatnonzero(frequent & (doc[k] == least[at]))
        if len(first):
            # of each text the first place
            _, own = np.unique(np.stack([text[k[first]], h[k[first]]]), axis=1, return_index=True)
            first = first[own]
            others = np.tile(np.arange(SHARES, dtype=np.int32), len(first))
            more = np.repeat(first, SHARES)
            new = others != share[more]
            k, share = np.append(k, k[more[new]]), np.append(share, others[new])
        return k, share

    return wanted


def repeated_lines(base: DataFrame) -> DataFrame:
    """``doc, __repeated``: the stretches of lines of ``(__id, __text)`` that an earlier place holds as well."""
    groups = chunk_rows(base).groupBy("h").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    repeated = stage(groups.where("n > 1"), clean=True)
    equal = Window.partitionBy("h", "share", "chunk").orderBy("doc", "line", "before", "after").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunk_rows(base, may_repeat(repeated)).withColumn("there", F.first(F.struct("doc", "line", "before", "after")).over(equal))
    start = F.col("line") - grown(F.col("n_before"), F.col("before"), F.col("there.before"), last=True)
    end = F.col("line") + F.col("size") + grown(F.col("n_after"), F.col("after"), F.col("there.after"), last=False)
    span = F.shiftleft(start.cast("long"), 32).bitwiseOR(end.cast("long"))
    # written, so that the shuffled chunks can go before the documents are shuffled
    return stage(rows.where("doc <> there.doc OR line <> there.line").groupBy("doc").agg(F.collect_set(span).alias("__repeated")), clean=True)


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``__lines`` and ``__words`` that went.

    Of equal chunks the one in the least document id, and there the first, stays. Chunks are grouped by their text, so
    bytes decide whether they are equal, and so they do for the lines around them; 64 bits of hash only tell which may repeat.
    A line goes only if an earlier place (document, line) holds it, so its first occurrence always stays. Chunks are compared with
    the surroundings of their first occurrence only. All columns and rows are kept; a null or empty text stays as it is. Rows with a
    null id are compared with nothing and stay. Rows that share an id are one document: equal rows leave each other alone. Hashes
    and ids of chunks are shuffled, then the texts of chunks that may repeat with the chunks around them, and each document once at
    the end.
    """
    copies = repeated_lines(with_text(docs, doc_id, text).where("__id IS NOT NULL"))
    taken = {c.lower() for c in docs.columns} & {"__repeated", "__lines", "__words"}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    key = copies["doc"]
    joined = docs.join(copies.hint("shuffle_hash"), docs[f"`{doc_id}`"].cast("long") == key, "left").drop(key)
    schema = T.StructType([*docs.schema.fields, T.StructField("__lines", T.LongType()), T.StructField("__words", T.LongType())])
    at = docs.columns.index(text)

    def begin() -> Callable:
        cuts = WordCuts()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            made, n_lines, n_words = without(part.column(at), part.column("__repeated"), cuts)
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            kept[at] = pc.coalesce(pa.array(made, kept[at].type), kept[at])
            return pa.RecordBatch.from_arrays([*kept, pa.array(n_lines, pa.int64()), pa.array(n_words, pa.int64())], names=schema.names)

        return work

    return explode_texts(joined, text, schema, begin, _CHARS)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, lines_removed, words_removed`` for every row of ``docs``; see ``drop_repeated``."""
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return drop_repeated(base).select(
        "doc_id", "text", F.col("__lines").alias("lines_removed"), F.col("__words").alias("words_removed"))
