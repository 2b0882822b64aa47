"""Encoding with a piece vocabulary under seeded merge dropout, and decoding.

Words (blanks and what follows them) are runs in one flat array of symbols. An agenda step takes each run's best
candidate: the adjacent pair whose piece has the highest score, the leftmost of equals. A hash with a key decides whether
the candidate is skipped; a skipped one leaves the agenda until a neighbour changes. Otherwise the pair is merged.
The key holds the seed, the document, the word's number in it, the word, the place and the pair, so every occurrence of a
word draws its own cuts, and a segmentation depends on nothing else: not on partitions, order or retries.

Under dropout the states that short words come to are remembered, if a word is seen more than once at a time: each has a best candidate,
and one next state if it is merged and one if it is skipped. Every occurrence walks this tree by its own draws; only states that no
occurrence came to before are worked out. Other words go through the agenda.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import explode_texts, mix, seed_of, with_text

BLANK = "▁"
#: A word: blanks and the characters up to the next blank. No piece has a blank behind another character.
WORD = re.compile(" *[^ ]+| +")
NEVER = np.int32(2**30)
#: Places of the table of pairs, a power of two far above their number, so that nearly every look-up ends at its first place.
TABLE = 1 << 21
#: Words that a worker remembers the pieces without dropout of; emptied when full.
REMEMBERED = 1_500_000
#: Characters of words that are cut in one set of arrays under dropout, one word at least.
CUT_CHARS = 1_000_000
#: Words of at most so many characters, the blank too, are cut by remembered states (their room grows with the square of the length); a worker forgets them beyond so many states or symbols in them.
SHORT, MOST_STATES, MOST_SYMBOLS = 20, 500_000, 4_000_000


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the stretches with these starts and sizes."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Pieces:
    """The pieces of a model file and which pairs of them make another piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.name = path
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in plain):
            raise ValueError("pieces with a blank behind another character are not supported")
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        self.bytes_of = [byte_of.get(i, b"" if model.is_control(i) else p.replace(BLANK, " ").encode()) for i, p in enumerate(self.pieces)]
        best = sorted(plain, key=lambda i: (-model.get_score(i), i))
        rank_of = {i: r for r, i in enumerate(best)}
        self.by_rank = np.array(best, np.int32)
        table = []
        for piece, made in self.id_of.items():
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    table.append((a * n + b, rank_of[made], made))
        self.piece_sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n = n
        self.keys, ranks, made = np.array(sorted(table), np.int64).T.copy()
        self.ranks, self.made = ranks.astype(np.int32), made.astype(np.int32)
        self.places = np.full(TABLE, -1, np.int32)
        waiting, place = np.arange(len(self.keys)), self.place_of(self.keys)
        while len(waiting):  # a pair whose place is taken goes one further
            free = self.places[place] < 0
            self.places[place[free]] = waiting[free]
            left = self.places[place] != waiting
            waiting, place = waiting[left], (place[left] + 1) % TABLE
        # a character without a piece, or the blank sign itself, goes out as bytes: it takes part in no merge
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        for piece, i in self.id_of.items():
            if len(piece) == 1 and piece != BLANK:
                self.symbol_of[ord(piece)] = i
        self.symbol_of[ord(" ")] = self.id_of[BLANK]
        self.byte_ids = np.array(self.byte_id, np.int32)

    @staticmethod
    def place_of(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pairs of the table, and where they stand in it."""
        at = self.place_of(keys)
        found = self.places[at]
        good = self.keys[found] == keys  # an empty place names the last pair, which is compared too
        open_ = np.flatnonzero(~good & (found >= 0))
        while len(open_):  # the place holds another pair: look one further
            at[open_] = (at[open_] + 1) % TABLE
            found[open_] = self.places[at[open_]]
            good[open_] = self.keys[found[open_]] == keys[open_]
            open_ = open_[~good[open_] & (found[open_] >= 0)]
        return np.flatnonzero(good), found[good]

    def offers(self, symbols: np.ndarray, run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that begin at these places; NEVER where there is none."""
        rank, made = np.full(len(at), NEVER), np.zeros(len(at), np.int32)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[run[at[inner]] == run[at[inner] + 1]]
        left, right = symbols[at[inner]], symbols[at[inner] + 1]
        inner = inner[(left < self.n) & (right < self.n)]  # both are pieces
        good, found = self.find(symbols[at[inner]].astype(np.int64) * self.n + symbols[at[inner] + 1])
        rank[inner[good]], made[inner[good]] = self.ranks[found], self.made[found]
        return rank, made

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces, one after the other."""
        sizes = self.piece_sizes[ids]
        return self.piece_bytes[spread(self.piece_starts[ids], sizes)].tobytes()

    def as_bytes(self, symbols: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of characters without a piece become the pieces of their UTF-8 bytes."""
        at = np.flatnonzero(symbols >= self.n)
        if not len(at):
            return symbols, run
        point = symbols[at] - self.n
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        copies = np.ones(len(symbols), np.int64)
        copies[at] = width
        first = (np.cumsum(copies) - copies)[at]
        out = np.repeat(symbols, copies)
        for j in range(4):
            here = width > j
            low = (width[here] - 1 - j) * 6
            bits = point[here] >> low
            if j == 0:
                lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[here]]
                byte = bits | lead
            else:
                byte = (bits & 0x3F) | 0x80
            out[first[here] + j] = self.byte_ids[byte]
        return out, np.repeat(run, copies)

    def segment(self, words: list[str], variants: list[int], dropout: float, seed: int) -> list[bytes]:
        """The pieces of each non-empty word in its variant, as 32-bit numbers."""
        flat, counts = self.segments(words, np.array(variants, np.uint64), dropout, seed)
        flat, ends = flat.tobytes(), 4 * np.cumsum(counts)
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def segments(self, words: list[str], variants: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all non-empty words, each in its variant, one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        run = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        symbols = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        place = (np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        digests = {w: xxhash.xxh64_intdigest(w.encode(), 0) for w in set(words)}
        key = mix(np.fromiter(map(digests.__getitem__, words), np.uint64, len(words)) ^ mix(variants ^ seed_of(seed)))
        bar = np.uint64(min(int(dropout * 2**64), 2**64 - 1))

        ready: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self.offers(symbols, run, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = least == NEVER
            if done.any():  # finished runs leave the arrays
                alive = ~np.repeat(done, sizes)
                ready.append((symbols[~alive], run[~alive]))
                symbols, run, rank, made, place = symbols[alive], run[alive], rank[alive], made[alive], place[alive]
                if not len(symbols):
                    break
                sizes, least = sizes[~done], least[~done]
            best = np.flatnonzero(rank == np.repeat(least, sizes))
            at = best[np.r_[True, run[best[1:]] != run[best[:-1]]]]  # the leftmost of each run
            if dropout > 0:
                pair = (symbols[at].astype(np.int64) * self.n + symbols[at + 1]).astype(np.uint64)
                drawn = mix(mix(key[run[at]] ^ pair) ^ place[at].astype(np.uint64))
                skipped = drawn < bar
                rank[at[skipped]] = NEVER
                at = at[~skipped]
                if not len(at):
                    continue
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = (np.cumsum(keep) - 1)[at]
            symbols, run, rank, made, place = symbols[keep], run[keep], rank[keep], made[keep], place[keep]
            touched = np.zeros(len(symbols), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed], made[changed] = self.offers(symbols, run, changed)
        symbols, run = (np.concatenate(x) for x in zip(*ready, strict=True))
        order = np.argsort(run, kind="stable")
        symbols, run = self.as_bytes(symbols[order], run[order])
        return symbols.astype("<i4"), np.bincount(run, minlength=len(words))


class States:
    """The states that words come to, whatever dropout and seed."""

    #: By state: where its symbols begin and how many it has, which of them begins the best pair (-1: none), that pair, its place in the word, the next
    #: states if it is merged or skipped (-1: not yet known), and a root's digest. By symbol: piece, rank of its pair, place.
    STATE = {"first": np.int32, "size": np.int8, "best": np.int8, "pair": np.uint64, "at": np.uint8, "merged": np.int32, "skipped": np.int32, "digest": np.uint64}
    SYMBOL = {"symbol": np.int32, "rank": np.int32, "place": np.int8}

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.root: dict[str, int] = {}
        self.n_states = self.n_symbols = 0
        self.of = {k: np.empty(1024, kind) for k, kind in (self.STATE | self.SYMBOL).items()}

    def put(self, n: int, names: dict, values: dict) -> None:
        """Values from place ``n`` on; arrays that are too short are doubled."""
        for name in names:
            more = values[name]
            if n + len(more) > len(self.of[name]):
                wider = np.empty(2 * (n + len(more)), self.of[name].dtype)
                wider[:n] = self.of[name][:n]
                self.of[name] = wider
            self.of[name][n : n + len(more)] = more

    def add(self, sizes: np.ndarray, digest: np.ndarray | None = None, **symbols: np.ndarray) -> np.ndarray:
        """The numbers of new states with these symbols."""
        n, starts = len(sizes), np.cumsum(sizes) - sizes
        rank, symbol = symbols["rank"], symbols["symbol"]
        least = np.minimum.reduceat(rank, starts)
        best = np.flatnonzero(rank == np.repeat(least, sizes))
        run = np.repeat(np.arange(n), sizes)[best]
        best = best[np.r_[True, run[1:] != run[:-1]]]  # the leftmost of each
        none = np.full(n, -1)
        following = symbol[np.minimum(best + 1, len(symbol) - 1)]
        self.put(self.n_symbols, self.SYMBOL, symbols)
        self.put(self.n_states, self.STATE, {
            "first": starts + self.n_symbols, "size": sizes, "best": np.where(least == NEVER, -1, best - starts),
            "pair": (symbol[best].astype(np.int64) * self.pieces.n + following).astype(np.uint64), "at": symbols["place"][best],
            "merged": none, "skipped": none, "digest": np.zeros(n, np.uint64) if digest is None else digest})
        made = np.arange(self.n_states, self.n_states + n)
        self.n_states += n
        self.n_symbols += len(rank)
        return made

    def roots(self, words: list[str]) -> np.ndarray:
        """The states that words begin in; -1 for long words and those that are new and occur once."""
        if self.n_states > MOST_STATES or self.n_symbols > MOST_SYMBOLS:
            self.forget()
        at = np.fromiter(map(self.root.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        new = [w for w, n in Counter([words[i] for i in missing]).items() if n > 1 and len(w) <= SHORT]
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            symbols = self.pieces.symbol_of[np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)]
            rank, _ = self.pieces.offers(symbols, np.repeat(np.arange(len(new)), sizes), np.arange(len(symbols)))
            digest = np.array([xxhash.xxh64_intdigest(w.encode(), 0) for w in new], np.uint64)
            place = spread(np.zeros(len(new), np.int64), sizes)
            self.root.update(zip(new, self.add(sizes, digest, symbol=symbols, rank=rank, place=place).tolist(), strict=True))
            at[missing] = [self.root.get(words[i], -1) for i in missing]
        return at

    def follow(self, states: np.ndarray, skip: bool) -> None:
        """Works out the states after these, whose best pair is skipped or merged."""
        sizes = self.of["size"][states]
        own = spread(self.of["first"][states], sizes)
        symbol, rank, place = (self.of[name][own] for name in self.SYMBOL)
        best = np.cumsum(sizes) - sizes + self.of["best"][states]
        if skip:
            rank[best] = NEVER
        else:
            symbol[best] = self.pieces.by_rank[rank[best]]
            keep = np.ones(len(symbol), bool)
            keep[best + 1] = False
            now = best - np.arange(len(best))  # one symbol less for each state before
            sizes = sizes - 1
            symbol, rank, place = symbol[keep], rank[keep], place[keep]
            touched = np.zeros(len(symbol), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed], _ = self.pieces.offers(symbol, np.repeat(np.arange(len(states)), sizes), changed)
        self.of["skipped" if skip else "merged"][states] = self.add(sizes, symbol=symbol, rank=rank, place=place)

    def segments(self, state: np.ndarray, variants: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``Pieces.segments`` gives for words that begin in these states."""
        key = mix(self.of["digest"][state] ^ mix(variants ^ seed_of(seed)))
        bar = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        open_ = np.flatnonzero(self.of["best"][state] >= 0)
        while len(open_):
            now = state[open_]
            skipped = mix(mix(key[open_] ^ self.of["pair"][now]) ^ self.of["at"][now]) < bar
            following = np.where(skipped, self.of["skipped"][now], self.of["merged"][now])
            new = np.flatnonzero(following < 0)
            if len(new):
                for skip, name in ((False, "merged"), (True, "skipped")):
                    mine = new[skipped[new] == skip]
                    if len(mine):
                        mark = -2 - np.arange(len(mine))
                        self.of[name][now[mine]] = mark
                        self.follow(now[mine][self.of[name][now[mine]] == mark], skip)  # each state once
                        following[mine] = self.of[name][now[mine]]
            state[open_] = following
            open_ = open_[self.of["best"][following] >= 0]
        sizes = self.of["size"][state]
        flat, run = self.pieces.as_bytes(self.of["symbol"][spread(self.of["first"][state], sizes)], np.repeat(np.arange(len(state)), sizes))
        return flat.astype("<i4"), np.bincount(run, minlength=len(state))


#: The states that a worker process remembers, by model. Only a memory, as the next one.
_STATES: dict[str, States] = {}
#: What a worker process has segmented without dropout, by model. Only a memory: every entry can be made anew.
_KNOWN: dict[str, dict[str, bytes]] = {}


def encoder(pieces: Pieces, dropout: float, seed: int) -> Callable[[list[str], list[int]], list[np.ndarray]]:
    """A function from texts and the numbers of their documents to pieces. Under dropout every occurrence of a word is cut by
    itself; without, words are remembered up to a bound."""

    def plain(cut: list[list[str]]) -> list[np.ndarray]:
        if sum(map(len, _KNOWN.values())) > REMEMBERED:
            _KNOWN.clear()
        known = _KNOWN.setdefault(pieces.name, {})
        if new := list(set().union(*cut).difference(known)):
            known.update(zip(new, pieces.segment(new, [0] * len(new), 0.0, seed), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in cut]

    def segments(words: list[str], variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By remembered states where there are any, else by the agenda."""
        states = _STATES.setdefault(pieces.name, States(pieces))
        root = states.roots(words)
        known, other = np.flatnonzero(root >= 0), np.flatnonzero(root < 0)
        sides, made = [], []
        if len(known):
            sides.append(known)
            made.append(states.segments(root[known], variants[known], dropout, seed))
        if len(other):
            sides.append(other)
            made.append(pieces.segments([words[i] for i in other.tolist()], variants[other], dropout, seed))
        counts = np.empty(len(words), np.int64)
        for side, (_, own) in zip(sides, made, strict=True):
            counts[side] = own
        flat, starts = np.empty(counts.sum(), "<i4"), np.cumsum(counts) - counts
        for side, (own, sizes) in zip(sides, made, strict=True):
            flat[spread(starts[side], sizes)] = own
        return flat, counts

    def varied(cut: list[list[str]], numbers: list[int]) -> list[np.ndarray]:
        sizes = np.array([len(words) for words in cut], np.int64)
        words = [w for x in cut for w in x]
        if not words:
            return [np.empty(0, "<i4") for _ in cut]
        of_doc = mix(np.array([x % 2**64 for x in numbers], np.uint64) ^ seed_of(seed, 1))
        number = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        variants = mix(np.repeat(of_doc, sizes) ^ number.astype(np.uint64))
        step = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // CUT_CHARS
        ends = [*(np.flatnonzero(np.diff(step)) + 1).tolist(), len(words)]
        made = [segments(words[a:b], variants[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        flat, counts = (np.concatenate(x) for x in zip(*made, strict=True))
        before = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(sizes)]]
        return [flat[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]

    def encode(texts: list[str], numbers: list[int]) -> list[np.ndarray]:
        cut = [WORD.findall(" " + x) if x else [] for x in texts]
        return varied(cut, numbers) if dropout > 0 else plain(cut)

    return encode


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of the pieces: bytes are joined, the sign of a blank becomes a blank, the first blank goes."""
    text = b"".join(map(pieces.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode_documents(
    docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 17,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, pieces, n_pieces, lossless`` for every row of ``docs``, whole texts.

    ``pieces`` are ids under dropout, ``lossless`` says whether decoding gives the text again (it does for every text). Every occurrence of a word is cut by draws of its own,
    from its document's id and its number in the text. Dropout 0 gives the library's own pieces, but for
    texts that hold the sign U+2581 itself, which goes out as bytes here and would be lost there. A null or empty text
    has no pieces and is lossless; a null ``doc_id`` counts as 0 in the draws; repeated rows repeat their
    result; other columns are not read. The model file is read on the driver (a few MB) and sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(path))
    base = with_text(docs, doc_id, text)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("pieces", T.ArrayType(T.IntegerType())),
        T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType()),
    ])

    def begin() -> Callable:
        pieces = shared.value
        varied = encoder(pieces, dropout, seed)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = part.column("__id"), [x or "" for x in part.column("__text").to_pylist()]
            made = varied(texts, [d or 0 for d in ids.to_pylist()])
            lengths = np.array([len(x) for x in made], np.int64)
            flat = np.concatenate([np.empty(0, np.int32), *made])
            rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat))
            same = [pieces.joined(x) == (b" " + y.encode() if y else b"") for x, y in zip(made, texts, strict=True)]
            return pa.RecordBatch.from_arrays(
                [ids, rows, pa.array(lengths), pa.array(same)],
                names=schema.names)

        return work

    return explode_texts(base, "__text", schema, begin)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, pieces``. Null or empty pieces give an empty text; ids outside the model fail."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches):
        for batch in batches:
            texts = [decode(shared.value, x or []) for x in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("pieces").cast("array<int>")).mapInArrow(
        run, "doc_id long, text string")
