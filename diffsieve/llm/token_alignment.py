"""Alignment of two tokenizers' cuts of the same bytes.

The ends of the A tokens and of the B tokens of a block of texts are two sorted lists. Merging them is a path through a grid;
a binary search on evenly spaced diagonals finds where the path crosses them, which cuts the merge into pieces of equal
work that know nothing of each other. All pieces walk at once, one step of each a numpy step. A piece emits the
overlaps of A and B tokens it meets and the ends that both lists share; group numbers inside a piece are made whole by adding
the shared ends of the pieces before it, so a group that crosses pieces is stitched.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import with_text
from diffsieve.llm.token_counts import PRE_TOKEN, printable_bytes
from diffsieve.staging import stage

#: Merge steps of a piece.
WORK = 128
#: Bytes of the texts of a block, one text at least; and characters from which a text is given to the libraries in stretches.
BLOCK_BYTES, LONG = 1_000_000, 1_000_000
#: Links of a group up to which they are listed one by one; larger groups are counted by distinct ids.
LISTED = 4_096
#: An id pair is one number, A's id in front; B's ids stay below this power of two.
B_BITS = 20
#: A blank where both vocabularies always cut: none of their tokens has a blank behind another character.
CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Characters besides ASCII and Latin letters, and rare control characters.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]")


class Vocabularies:
    """The files of both tokenizers, read once on the driver, and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.file_a, self.file_b = Path(path_a).read_text(encoding="utf-8"), Path(path_b).read_bytes()
        byte_of = {c: b for b, c in printable_bytes().items()}
        file = json.loads(self.file_a)
        entries, special = file["model"]["vocab"], {t["id"] for t in file.get("added_tokens", [])}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            if all(c in byte_of for c in entry):
                self.bytes_a[i] = bytes(byte_of[c] for c in entry)
        # pairs merge in the order of the ids they make
        self.ranks_a = {x: i for i, x in enumerate(self.bytes_a) if x and i not in special}
        model = sentencepiece.SentencePieceProcessor(model_proto=self.file_b)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_b = [
            bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        if len(self.bytes_b) >= 1 << B_BITS:
            raise ValueError(f"more than {1 << B_BITS} pieces")

    def gives_back(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole

    def encoder(self) -> Callable[[list[str]], list[tuple[list[int], list[int]]]]:
        """A function from texts to the ids of blank + text by A, and of the text by B, which adds the blank; a text
        that is empty or that either does not give back has none. Very long texts go in stretches that end where both
        always cut, so that memory does not follow the text.

        Texts in Latin letters go through a second library that reads the same vocabulary several times faster. For other
        characters the two libraries' tables of letters and white space may differ, so those go through the first.
        """
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        model_a = Tokenizer.from_str(self.file_a)
        model_a.encode_special_tokens = True
        model_a.no_truncation()
        model_a.no_padding()
        fast_a = tiktoken.Encoding("a", pat_str=PRE_TOKEN, mergeable_ranks=self.ranks_a, special_tokens={})
        model_b = sentencepiece.SentencePieceProcessor(model_proto=self.file_b)

        def by_a(text: str) -> list[int]:
            if OTHER.search(text):
                return model_a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
            return fast_a.encode_ordinary(" " + text)

        def stretches(text: str) -> Iterator[str]:
            start = 0
            while len(text) - start > LONG and (cut := CUT.search(text, start + LONG)):
                yield text[start : cut.start()]
                start = cut.end()
            yield text[start:]

        def encode(text: str) -> tuple[list[int], list[int]]:
            if not text:
                return [], []
            if len(text) <= LONG:
                a, b = by_a(text), model_b.encode(text)
            else:
                parts = [(by_a(part), model_b.encode(part)) for part in stretches(text)]
                a, b = ([i for part in parts for i in part[k]] for k in (0, 1))
            return (a, b) if self.gives_back(text, a, b) else ([], [])

        return lambda texts: [encode(text) for text in texts]


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of each list lie before every ``work``-th diagonal of the merge, A's first of equals."""
    diagonal = np.arange(0, len(a) + len(b), work)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = middle[open_]
        goes = a[at] <= b[diagonal[open_] - 1 - at]
        low[open_] = np.where(goes, at + 1, low[open_])
        high[open_] = np.where(goes, high[open_], at)
    return low, diagonal - low


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(overlap_a, overlap_b, group_a, group_b)`` of two rising lists of ends with the same last end: the tokens that overlap, in
    order, and the group of each token."""
    i, j = crossings(a, b, work)
    never = np.full(work + 1, np.iinfo(np.int64).max)
    ends_a, ends_b = np.concatenate([a, never]), np.concatenate([b, never])
    at_a, at_b = np.empty((work, len(i)), np.int64), np.empty((work, len(i)), np.int64)
    takes_a = np.empty((work, len(i)), bool)
    for step in range(work):  # every piece makes one step
        takes = ends_a[i] <= ends_b[j]
        at_a[step], at_b[step], takes_a[step] = i, j, takes
        i, j = i + takes, j + ~takes
    # a B end is shared if the A end taken just before it is the same
    shared = ~takes_a & (at_a > 0) & (ends_a[at_a - 1] == ends_b[at_b])
    inside = np.cumsum(shared, axis=0)
    before = np.r_[0, np.cumsum(inside[-1])[:-1]] if len(i) else inside[-1]
    group = inside - shared + before  # stitched: the shared ends of all pieces before
    n = len(a) + len(b)
    at_a, at_b, takes_a, shared, group = (x.T.ravel()[:n] for x in (at_a, at_b, takes_a, shared, group))
    overlaps = ~shared
    return at_a[overlaps], at_b[overlaps], group[takes_a], group[~takes_a]


class Aligned:
    """The tokens of a block of texts and their groups, flat; text k has tokens ``a[starts_a[k]:starts_a[k + 1]]``."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], lengths_a: np.ndarray, lengths_b: np.ndarray) -> None:
        self.starts_a = np.r_[0, np.cumsum([len(x) for x in ids_a], dtype=np.int64)]
        self.starts_b = np.r_[0, np.cumsum([len(x) for x in ids_b], dtype=np.int64)]
        self.a = np.array([i for x in ids_a for i in x], np.int64)
        self.b = np.array([i for x in ids_b for i in x], np.int64)
        self.overlap_a, self.overlap_b, self.group_a, self.group_b = merge(
            np.cumsum(lengths_a[self.a]), np.cumsum(lengths_b[self.b]))
        n = int(self.group_a[-1]) + 1 if len(self.a) else 0
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        # texts end in shared ends, so groups never cross texts
        self.starts = np.r_[self.group_a, n][self.starts_a]
        self.text_of_group = np.repeat(np.arange(len(ids_a)), np.diff(self.starts))


def aligner(files: Vocabularies) -> Callable[[list[str]], Aligned]:
    """A function from texts to their alignment; texts that are empty or that either vocabulary does not give back have no tokens."""
    encode = files.encoder()
    lengths_a, lengths_b = (np.array([len(x) for x in y], np.int64) for y in (files.bytes_a, files.bytes_b))

    def align(texts: list[str]) -> Aligned:
        ids = encode(texts)
        return Aligned([a for a, _ in ids], [b for _, b in ids], lengths_a, lengths_b)

    return align


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("__text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES)))
            yield batch.slice(start, stop - start)
            start = stop


def _lists(starts: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, kind))


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, a_sizes, b_sizes, overlap_a, overlap_b`` for every row of ``docs``, whole texts.

    ``a_sizes[k]`` and ``b_sizes[k]`` tell how many of the next tokens make group k; token ``overlap_a[i]`` of A (0-based) shares bytes with
    token ``overlap_b[i]`` of B. A text that is null or empty, or that either vocabulary does not give back byte by byte, has
    no tokens and empty arrays. Repeated rows repeat their result, a null ``doc_id`` stays null, other columns are not read.
    Both files are read on the driver (a few MB) and sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabularies(path_a, path_b))
    names = ("a_ids", "b_ids", "a_sizes", "b_sizes", "overlap_a", "overlap_b")
    schema = "doc_id bigint, " + ", ".join(f"{c} array<int>" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(shared.value)
        for part in _blocks(batches):
            x = work([t or "" for t in part.column("__text").to_pylist()])
            text_of_a = np.repeat(np.arange(part.num_rows), np.diff(x.starts_a))
            of = text_of_a[x.overlap_a] if len(x.a) else np.empty(0, np.int64)
            met = np.r_[0, np.cumsum(np.bincount(of, minlength=part.num_rows))]
            arrays = (
                _lists(x.starts_a, x.a, pa.int32()), _lists(x.starts_b, x.b, pa.int32()),
                _lists(x.starts, x.size_a, pa.int32()), _lists(x.starts, x.size_b, pa.int32()),
                _lists(met, x.overlap_a - x.starts_a[of], pa.int32()), _lists(met, x.overlap_b - x.starts_b[of], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("__id"), *arrays], names=["doc_id", *names])

    return with_text(docs, doc_id, text).mapInArrow(run, schema)


# ---- links -----------------------------------------------------------------------------------------------------------


def links_of(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, pair, times)``: the id pairs of all token pairs that share a group; a pair may come in several rows of a text."""
    product = x.size_a * x.size_b
    first_a, first_b = np.cumsum(x.size_a) - x.size_a, np.cumsum(x.size_b) - x.size_b
    small = np.flatnonzero(product <= LISTED)
    counts = product[small]
    group = np.repeat(small, counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    row, column = np.divmod(place, x.size_b[group])
    texts = [x.text_of_group[group]]
    pairs = [(x.a[first_a[group] + row] << B_BITS) | x.b[first_b[group] + column]]
    times = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(product > LISTED):
        a, n_a = np.unique(x.a[first_a[g] : first_a[g] + x.size_a[g]], return_counts=True)
        b, n_b = np.unique(x.b[first_b[g] : first_b[g] + x.size_b[g]], return_counts=True)
        pairs.append(((a << B_BITS)[:, None] | b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
        texts.append(np.full(len(pairs[-1]), x.text_of_group[g]))
    return np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)


class Decimals:
    """The decimal forms of all ids below a bound, each with room for a sign behind it."""

    def __init__(self, n: int) -> None:
        written = [b"%d " % i for i in range(n)]
        self.lengths = np.array([len(w) for w in written], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(written), np.uint8)

    def write(self, ids: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids one after the other, each with its sign, and where each one ends."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        out = self.flat[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        out[ends - 1] = behind
        return out, ends


def group_texts(x: Aligned, decimals: Decimals) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for every text."""
    before_b = np.cumsum(x.size_b) - x.size_b
    through_a = np.cumsum(x.size_a)
    place_a = np.arange(len(x.a)) + before_b[x.group_a]
    place_b = np.arange(len(x.b)) + through_a[x.group_b]
    ids, behind = np.empty(len(x.a) + len(x.b), np.int64), np.full(len(x.a) + len(x.b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = x.a, x.b
    last_a, last_b = through_a - 1, before_b + x.size_b - 1
    behind[place_a[last_a]], behind[place_b[last_b]] = ord("|"), ord(";")
    flat, ends = decimals.write(ids, behind)
    written, bounds = flat.tobytes(), np.r_[0, ends][x.starts_a + x.starts_b].tolist()
    return [written[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_LINKED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.IntegerType())),
    T.StructField("times", T.ArrayType(T.LongType())), T.StructField("known", T.ArrayType(T.LongType())),
    T.StructField("holders", T.ArrayType(T.LongType())),
])


def linked(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignments counted: a row per document with its distinct id pairs, as places in the sorted pairs of its block, and how
    often each is linked. The first row of a block carries the block's pairs and how many of its documents hold each."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabularies(path_a, path_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(shared.value)
        decimals = Decimals(max(len(shared.value.bytes_a), len(shared.value.bytes_b)))
        task = TaskContext.get().partitionId()
        for k, part in enumerate(_blocks(batches)):
            n = part.num_rows
            x = work([t or "" for t in part.column("__text").to_pylist()])
            texts, pairs, times = links_of(x)
            known, at = np.unique(pairs, return_inverse=True)
            held, where = np.unique(texts * max(len(known), 1) + at, return_inverse=True)
            if len(times) == len(held):
                totals = np.ones(len(held), np.int64)
                totals[where] = times
            else:
                totals = np.zeros(len(held), np.int64)
                np.add.at(totals, where, times)
            of, at = np.divmod(held, max(len(known), 1))
            starts = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]
            groups = np.diff(x.starts)
            links = np.r_[0, np.cumsum(x.size_a * x.size_b)][x.starts]
            written = [hashlib.sha256(w).hexdigest() if w else "" for w in group_texts(x, decimals)]
            first = np.r_[0, np.full(n, len(known))]
            head = np.arange(n) > 0
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, (task << 32) + k), pa.int64()), part.column("__id"), pa.array(np.diff(x.starts_a), pa.int64()),
                pa.array(np.diff(x.starts_b), pa.int64()), pa.array(groups, pa.int64()), pa.array(np.diff(links), pa.int64()),
                pa.array(written, pa.string()), _lists(starts, at, pa.int32()), _lists(starts, totals, pa.int64()),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(known, pa.int64()), mask=pa.array(head)),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.bincount(at, minlength=len(known)), pa.int64()), mask=pa.array(head)),
            ], names=_LINKED.names)

    return with_text(docs, doc_id, text).mapInArrow(run, _LINKED)


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, documents, best``: how many documents hold each id pair linked, and whether no pair of its A id has more."""
    counts = links.where("known IS NOT NULL").select(F.explode(F.arrays_zip("known", "holders")).alias("x")).groupBy(
        F.col("x.known").alias("pair")).agg(F.sum("x.holders").alias("documents"))
    counts = stage(counts.withColumn("a", F.shiftright("pair", B_BITS)))
    # one row per id of A at most: bounded by the vocabulary
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def alignment_digest(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    Every row counts as a document, repeated ones too. Links, counts and texts without tokens (zeros and an empty digest) are
    as in ``align``. An id pair goes through the shuffles once per block of documents, never once per document, so no pair is hot.
    """
    links = stage(linked(docs, path_a, path_b, doc_id, text))
    named = links.where("known IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("known").alias("place", "pair"))
    scored = named.join(pair_counts(links), "pair").select("of", "place", "documents", "best")
    out = T.StructType([_LINKED[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [
        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), _LINKED["groups_sha256"]])
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        n = pairs.num_rows
        documents, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = pairs.column("place").to_numpy()
        documents[place], best[place] = pairs.column("documents").to_numpy(), pairs.column("best").to_numpy()
        lists, times = (pa.concat_arrays(rows.column(c).chunks) if rows.column(c).num_chunks else pa.array([], t)
                        for c, t in (("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))))
        at, often = lists.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)

        def per_row(values: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.r_[0, np.cumsum(values)][ends]), pa.int64())

        columns = {c: rows.column(c) for c in kept} | {"n_best": per_row(often * best[at]), "count_sum": per_row(often * documents[at])}
        return pa.table([columns[c] for c in out.names], names=out.names)

    return links.select("block", *kept, "pairs", "times").groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(score, out)
