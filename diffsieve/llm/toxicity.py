"""Toxicity scores from a small bidirectional recurrent network, trained in numpy.

A word's input is its own vector, if training saw it often enough, beside the mean vector of its character grams. Two
gated recurrent passes run over a window of words, attention pools their states, and a linear layer gives the
window's logit. All windows of a text overlap by half; the text's score is that of its worst window. Labels hold for
whole texts, so training picks each text's worst window under the present weights and learns from that. A sample gives the first
weights; from there tasks go on over all windows of all labelled texts, each over its share, and their weights are averaged.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.functions.reduce import keep_likely
from diffsieve.llm.common import add_columns, crc_remainder, explode_texts, mix, with_text
from diffsieve.staging import stage

WORD = re.compile(r"\w+")
#: Words of a window; the next one begins half a window later.
WINDOW = 32
STRIDE = WINDOW // 2
#: Bounds of the sample that gives the first weights: documents of each label, and windows of a document, evenly spaced over its whole text.
MOST_TOXIC, MOST_CLEAN, BAG = 2_000, 4_000, 5
#: All labelled documents are gone through in as many parts at once at most, of so many documents at least; a word has a vector of its own if so
#: many of them hold it, for the most frequent MOST_WORDS.
PARTS, PART_DOCS, LEAST_DOCS, MOST_WORDS = 16, 4_000, 5, 30_000
#: A step over whole texts ends after so many words, or BATCH documents.
MOST_WORDS_A_STEP = 200_000
#: The rate then, as a share of RATE, and the steps of a logit that the bias is set by.
LATER_RATE, LOGIT_STEPS = 0.5, 1_000
#: With fewer documents of a label to set the bias by, all documents train and set it.
LEAST_JUDGES = 5
CLEAN_WEIGHT = 3
THRESHOLD = 0.3
HIDDEN, WORD_SIZE, GRAM_SIZE, GRAMS = 8, 8, 8, 2**14
STEPS, BATCH, RATE, DECAY, SEED = 200, 128, 0.01, 0.02, 9
#: Few toxic documents are not gone through more often than this.
MOST_ROUNDS = 60
#: Windows that a step of training judges at once.
LANES = 1024
#: Windows that are scored at once, words that a worker remembers, and about how many characters of texts it scores at a time: its memory does
#: not follow the documents.
SCORED_LANES, REMEMBERED, SCORED_CHARS = 1024, 200_000, 1_000_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by ``index``."""
    out = np.zeros((size, values.shape[-1]), np.float32)
    flat, rows = index.ravel(), values.reshape(-1, values.shape[-1])
    order = np.argsort(flat, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
    out[flat[order][begins]] = np.add.reduceat(rows[order], begins)
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@cache
def word_characters() -> np.ndarray:
    """Which code points ``WORD`` takes."""
    table = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)
    table[ord("_")] = True
    return table


def n_words(text: str) -> int:
    inside = word_characters()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    return int(np.count_nonzero(inside[1:] > inside[:-1])) + int(inside[:1].sum())


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts, the number among them of each word of one text after the other, and how many words each text
    has: ``words_of`` of many texts at once."""
    lower = [x.lower() for x in texts]
    codes = np.frombuffer("\n".join(lower).encode("utf-32-le"), np.uint32)
    inside = word_characters()[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([0, *(len(x) + 1 for x in lower)])
    sizes = np.diff(np.searchsorted(starts, begins))
    if not len(starts):
        return [], np.empty(0, np.int64), sizes
    letters, ends = codes[inside], np.cumsum(lengths)
    if letters.max() >= 0x80:
        width = sum(((letters >= least).view(np.uint8) for least in (0x80, 0x800, 0x10000)), np.uint8(1))
        ends = np.cumsum(width, dtype=np.int64)[ends - 1]
    data = letters.tobytes().decode("utf-32-le").encode()
    places = pa.py_buffer(np.r_[0, ends].astype(np.int64))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64), sizes


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of two to four characters of ``<word>``, and where each word's runs begin. Words longer than 40
    characters count with all their runs too."""
    codes = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    for width in (2, 3, 4):
        n = len(codes) - width + 1
        if n <= 0:
            continue
        inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
        value = np.full(len(inside), width, np.uint64)
        for k in range(width):
            value = mix(value * np.uint64(0x100000001B3) ^ codes[inside + k])
        buckets.append(value & np.uint64(GRAMS - 1))
        owners.append(owner[inside])
    bucket, owner = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words)))


class Network:
    """Weights, the forward pass and its gradient."""

    def __init__(self, vocabulary: list[str]) -> None:
        random = np.random.default_rng(SEED)
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        size = WORD_SIZE + GRAM_SIZE

        def start(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) * (0.5 / np.sqrt(shape[0]))).astype(np.float32)

        self.w = {
            "word": (random.standard_normal((len(vocabulary) + 1, WORD_SIZE)) * 0.1).astype(np.float32),
            "gram": (random.standard_normal((GRAMS, GRAM_SIZE)) * 0.3).astype(np.float32),
            "in": start(size, 6 * HIDDEN), "in0": np.zeros(6 * HIDDEN, np.float32),
            "back": start(HIDDEN, 6 * HIDDEN),
            "look": start(2 * HIDDEN, HIDDEN), "look0": np.zeros(HIDDEN, np.float32), "pick": start(HIDDEN, 1),
            "out": start(2 * HIDDEN, 1), "out0": np.full(1, -1.0, np.float32),
        }
        self.w["word"][0] = 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def __getstate__(self) -> dict:
        return {"number": self.number, "w": self.w, "known": {}, "table": np.zeros((0, 6 * HIDDEN), np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The input vectors of words, their numbers, gram buckets and where each word's grams begin."""
        numbers = np.array([self.number.get(w, 0) for w in words], np.int64)
        bucket, begins = grams_of(words)
        counts = np.diff(np.r_[begins, len(bucket)])
        mean = np.add.reduceat(self.w["gram"].take(bucket, axis=0), begins) / counts[:, None].astype(np.float32)
        return np.hstack([self.w["word"][numbers], mean]), numbers, bucket, begins

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` (input times input weights, for both directions) of distinct words, which it remembers."""
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            first, size = len(self.known), len(self.known) + len(new)
            self.known.update(zip(new, range(first, size), strict=True))
            at[missing] = np.arange(first, size)
            if size > len(self.table):
                # room for many more words, so that the rows are seldom copied; unused room takes no memory
                table = np.empty((max(size, REMEMBERED + REMEMBERED // 4), 6 * HIDDEN), np.float32)
                table[:first] = self.table[:first]
                self.table = table
            for k in range(0, len(new), 10_000):
                part = self.inputs(new[k : k + 10_000])[0] @ self.w["in"] + self.w["in0"]
                self.table[first + k : first + k + len(part)] = part
        return at

    def halves(self, table: np.ndarray) -> list[np.ndarray]:
        """Rows of ``table`` for each direction as ``window_logits`` reads them: those of the reset gate with the other sign."""
        made = [np.ascontiguousarray(table[:, k : k + 3 * HIDDEN]) for k in (0, 3 * HIDDEN)]
        for half in made:
            half[:, HIDDEN : 2 * HIDDEN] *= -1
        return made

    def window_logits(self, inputs: Callable[[int, int], np.ndarray], steps: int, lanes: int, mask: np.ndarray | None) -> np.ndarray:
        """What ``logits`` gives for windows whose input gates at a step of direction 0 or 1 are ``inputs(direction, step)``, (3 * HIDDEN, lanes), of
        ``halves``. Lanes lie side by side, nothing is kept, and the gates stand as 1 - update and reset, each 1 / (1 + exp(x))."""
        states = np.empty((steps, 2 * HIDDEN, lanes), np.float32)
        both, fresh, moved = (np.empty((n * HIDDEN, lanes), np.float32) for n in (2, 1, 3))
        for k, turn in enumerate(self.halves(self.w["back"])):
            turn = np.ascontiguousarray(turn.T)
            state = np.zeros((HIDDEN, lanes), np.float32)
            for t in range(steps - 1, -1, -1) if k else range(steps):
                given = inputs(k, t)
                np.matmul(turn, state, out=moved)
                np.add(given[: 2 * HIDDEN], moved[: 2 * HIDDEN], out=both)
                with np.errstate(over="ignore"):
                    np.exp(both, out=both)
                both += 1
                np.reciprocal(both, out=both)
                np.multiply(moved[2 * HIDDEN :], both[HIDDEN:], out=fresh)
                fresh += given[2 * HIDDEN :]
                np.tanh(fresh, out=fresh)
                fresh -= state
                fresh *= both[:HIDDEN]
                if mask is not None:
                    fresh *= mask[t]
                state = np.add(state, fresh, out=states[t, k * HIDDEN : (k + 1) * HIDDEN])
        seen = np.matmul(self.w["look"].T, states)
        seen += self.w["look0"][:, None]
        np.tanh(seen, out=seen)
        weight, value = (np.matmul(self.w[name].T, x)[:, 0] for name, x in (("pick", seen), ("out", states)))
        if mask is not None:
            weight = np.where(mask > 0, weight, np.float32(-30))
        weight = np.exp(weight - weight.max(axis=0))
        if mask is not None:
            weight *= mask
        return (weight * value).sum(axis=0) / np.maximum(weight.sum(axis=0), 1e-9) + self.w["out0"][0]

    def passes(self, gates: np.ndarray, mask: np.ndarray | None, backward: bool, keep: bool = False):
        """States of one direction. ``gates`` is (steps, lanes, 3 * HIDDEN); ``mask`` (steps, lanes) marks real words."""
        steps, lanes, _ = gates.shape
        turn = self.w["back"][:, 3 * HIDDEN :] if backward else self.w["back"][:, : 3 * HIDDEN]
        state = np.zeros((lanes, HIDDEN), np.float32)
        states = np.empty((steps, lanes, HIDDEN), np.float32)
        kept = []
        for t in range(steps - 1, -1, -1) if backward else range(steps):
            from_state = state @ turn
            both = sigmoid(gates[t, :, : 2 * HIDDEN] + from_state[:, : 2 * HIDDEN])
            update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
            fresh = np.tanh(gates[t, :, 2 * HIDDEN :] + reset * from_state[:, 2 * HIDDEN :])
            if keep:
                kept.append((t, state, update, reset, fresh, from_state[:, 2 * HIDDEN :]))
            change = (1 - update) * (fresh - state)
            state = state + (change if mask is None else change * mask[t][:, None])
            states[t] = state
        return states, kept

    def logits(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        ahead, kept_a = self.passes(gates[:, :, : 3 * HIDDEN], mask, False, keep)
        behind, kept_b = self.passes(gates[:, :, 3 * HIDDEN :], mask, True, keep)
        states = np.concatenate([ahead, behind], axis=2)
        seen = np.tanh(states @ self.w["look"] + self.w["look0"])
        weight = (seen @ self.w["pick"])[:, :, 0]
        if mask is not None:
            weight = np.where(mask > 0, weight, -30.0)
        weight = np.exp(weight - weight.max(axis=0))
        if mask is not None:
            weight = weight * mask
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        out = (pooled @ self.w["out"])[:, 0] + self.w["out0"][0]
        return (out, states, seen, weight, pooled, kept_a, kept_b) if keep else out

    def gradient(
        self, gates: np.ndarray, mask: np.ndarray, target: np.ndarray, share: np.ndarray | None = None
    ) -> tuple[dict, np.ndarray]:
        """Gradient of the mean log loss, in which a window weighs its ``share``, by all but the input weights, and by the gates."""
        out, states, seen, weight, pooled, kept_a, kept_b = self.logits(gates, mask, keep=True)
        share = np.ones(len(target)) if share is None else share
        slope = ((sigmoid(out) - target) * share / share.sum()).astype(np.float32)
        g = {"out": pooled.T @ slope[:, None], "out0": slope.sum(keepdims=True)}
        by_pooled = slope[:, None] @ self.w["out"].T
        by_states = weight[:, :, None] * by_pooled
        by_weight = (states * by_pooled).sum(axis=2)
        by_score = weight * (by_weight - (weight * by_weight).sum(axis=0))
        g["pick"] = np.tensordot(seen, by_score, ([0, 1], [0, 1]))[:, None]
        by_seen = by_score[:, :, None] * self.w["pick"][:, 0] * (1 - seen * seen)
        g["look"], g["look0"] = np.tensordot(states, by_seen, ([0, 1], [0, 1])), by_seen.sum(axis=(0, 1))
        by_states = by_states + by_seen @ self.w["look"].T
        by_gates = np.zeros_like(gates)
        g["back"] = np.zeros_like(self.w["back"])
        for kept, shift in ((kept_a, 0), (kept_b, 3 * HIDDEN)):
            turn = self.w["back"][:, shift : shift + 3 * HIDDEN]
            flow = np.zeros_like(states[0, :, :HIDDEN])
            half = by_states[:, :, HIDDEN:] if shift else by_states[:, :, :HIDDEN]
            for t, state, update, reset, fresh, from_state in reversed(kept):
                flow = flow + half[t]
                live = flow * mask[t][:, None]
                by_fresh = live * (1 - update) * (1 - fresh * fresh)
                by_update = live * (state - fresh) * update * (1 - update)
                by_reset = by_fresh * from_state * reset * (1 - reset)
                by_turn = np.hstack([by_update, by_reset, by_fresh * reset])
                g["back"][:, shift : shift + 3 * HIDDEN] += state.T @ by_turn
                by_gates[t, :, shift : shift + 3 * HIDDEN] = np.hstack([by_update, by_reset, by_fresh])
                flow = flow - live * (1 - update) + by_turn @ turn.T
        return g, by_gates


def window_rows(size: int, most: int | None = None) -> list[int]:
    """Begins of the windows over ``size`` words; of more than ``most`` evenly spaced ones."""
    begins = list(range(0, max(size - WINDOW, 0), STRIDE)) + [max(size - WINDOW, 0)]
    if most is None or len(begins) <= most:
        return begins
    return [begins[round(k * (len(begins) - 1) / (most - 1))] for k in range(most)]


class Steps:
    """Adam's moments and the steps taken."""

    def __init__(self, network: Network) -> None:
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.w.items()}
        self.taken = 0

    def learn(
        self, network: Network, words: list[str], ids: np.ndarray, mask: np.ndarray, sizes: np.ndarray, labels: np.ndarray,
        random: np.random.Generator, rate: float = RATE, toxic_share: float = 1.0,
    ) -> None:
        """One step over the windows (``ids`` of ``words``) of documents with ``sizes`` windows each: from the worst of each document, and
        one more of a clean one."""
        x, numbers, bucket, starts = network.inputs(words)
        table = x @ network.w["in"] + network.w["in0"]
        halves, full = network.halves(table), mask.all(axis=1)
        out = np.concatenate([
            network.window_logits(
                lambda k, t, at=ids[i : i + LANES]: halves[k].take(at[:, t], axis=0).T, WINDOW, len(full[i : i + LANES]),
                None if full[i : i + LANES].all() else mask[i : i + LANES].T)
            for i in range(0, len(ids), LANES)])
        chosen, target, i = [], [], 0
        for n, label in zip(sizes.tolist(), labels.tolist(), strict=True):
            chosen.append(i + int(out[i : i + n].argmax()))
            if not label:
                chosen.append(i + int(random.integers(n)))
            target += [label] * (1 if label else 2)
            i += n
        picked, target = np.array(chosen), np.array(target, np.float32)
        share = np.where(target > 0, toxic_share, 1.0)
        g, by_gates = network.gradient(table[ids[picked].T], mask[picked].T, target, share)
        # only words of the picked windows have a gradient
        used, where = np.unique(ids[picked].T, return_inverse=True)
        by_table = summed(where, by_gates, len(used))
        g["in"], g["in0"] = x[used].T @ by_table, by_table.sum(axis=0)
        by_x = by_table @ network.w["in"].T
        g["word"] = summed(numbers[used], by_x[:, :WORD_SIZE], len(network.w["word"]))
        g["word"][0] = 0
        counts = np.diff(np.r_[starts, len(bucket)])[used]
        own = np.repeat(starts[used] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        g["gram"] = summed(bucket[own], np.repeat(by_x[:, WORD_SIZE:] / counts[:, None], counts, axis=0), GRAMS)
        self.taken += 1
        for k, v in network.w.items():
            first, second = self.moments[k]
            first += 0.1 * (g[k] - first)
            second += 0.001 * (g[k] * g[k] - second)
            if v.ndim == 2:
                v *= 1 - rate * DECAY
            v -= (rate * np.sqrt(1 - 0.999**self.taken) / (1 - 0.9**self.taken)) * first / (np.sqrt(second) + 1e-8)


def train(sample: list[tuple[int, int, str]], vocabulary: list[str]) -> tuple[Network, Steps]:
    """A network and its steps from windows ``(document, label, words)``; the document is only a group. The same sample gives the same
    network. Without both labels the network gives every text the share of label 1."""
    texts = [w.split(" ") if w else [] for _, _, w in sample]
    network = Network(vocabulary)
    steps = Steps(network)
    groups = np.unique([d for d, _, _ in sample], return_inverse=True)[1] if sample else np.empty(0, np.int64)
    labels = np.array([y for _, y, _ in sample], np.float32)
    if len(set(labels.tolist())) < 2:
        network.w["out"][:] = 0
        network.w["out0"][:] = 20.0 if len(labels) and labels[0] else -20.0
        return network, steps
    words = sorted({w for t in texts for w in t})
    number = {w: i for i, w in enumerate(words)}
    ids = np.zeros((len(texts), WINDOW), np.int64)
    mask = np.zeros((len(texts), WINDOW), np.float32)
    for i, t in enumerate(texts):
        ids[i, : len(t)] = [number[w] for w in t]
        mask[i, : len(t)] = 1
    order = np.argsort(groups, kind="stable")
    begins = np.searchsorted(groups[order], np.arange(groups.max() + 2))
    random = np.random.default_rng(SEED)
    of_doc = labels[order[begins[:-1]]]
    # every step takes as many toxic and twice as many clean documents, each in shuffled rounds over its label
    parts = [(np.flatnonzero(of_doc == y), n) for y, n in ((1, BATCH // 3), (0, BATCH - BATCH // 3))]
    turns = min(STEPS, 30 + MOST_ROUNDS * len(parts[0][0]) // (BATCH // 3))
    queues = [np.concatenate([random.permutation(own) for _ in range(-(-turns * n // len(own)))]) for own, n in parts]
    for turn in range(turns):
        docs = np.concatenate([q[turn * n : (turn + 1) * n] for q, (_, n) in zip(queues, parts, strict=True)])
        bag = np.concatenate([order[begins[d] : begins[d + 1]] for d in docs])
        used, where = np.unique(ids[bag], return_inverse=True)
        steps.learn(
            network, [words[i] for i in used], where.reshape(len(bag), WINDOW), mask[bag], begins[docs + 1] - begins[docs], of_doc[docs], random)
    network.forget()
    return network, steps


def learn_texts(network: Network, steps: Steps, texts: list[str], labels: np.ndarray, random, toxic_share: float) -> None:
    """One step over all windows of whole texts."""
    words, row, counts = split_words(texts)
    row = np.append(row, 0)
    ids, mask, sizes = [], [], []
    for size, first in zip(counts.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True):
        at = np.array(window_rows(size))[:, None] + np.arange(WINDOW)
        real = at < size
        ids.append(row[np.where(real, first + at, first)])
        mask.append(real)
        sizes.append(len(at))
    steps.learn(
        network, words or [""], np.concatenate(ids), np.concatenate(mask).astype(np.float32), np.array(sizes), labels, random,
        RATE * LATER_RATE, toxic_share)


def go_on(network: Network, steps: Steps, teachers: DataFrame, n_toxic: int, n_clean: int) -> Network:
    """The network after one pass over all windows of all ``teachers(__text, __toxic)``. Each part streams through its share from the same
    weights, and the mean of the parts' weights, by documents, is taken. Toxic documents weigh half as much as clean ones together."""
    parts = max(1, min(PARTS, (n_toxic + n_clean) // PART_DOCS))
    shared = teachers.sparkSession.sparkContext.broadcast((network, steps))
    toxic_share = n_clean / (2 * n_toxic)
    names = sorted(network.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, taken = pickle.loads(pickle.dumps(shared.value))  # a worker may run several parts
        random = np.random.default_rng(SEED)
        seen, size, texts, labels = 0, 0, [], []

        def step() -> None:
            learn_texts(own, taken, texts, np.array(labels, np.float32), random, toxic_share)
            texts.clear()
            labels.clear()

        for batch in batches:
            for text, label in zip(batch.column("__text").to_pylist(), batch.column("__toxic").to_pylist(), strict=True):
                texts.append(text or "")
                labels.append(label)
                seen += 1
                size += n_words(texts[-1])
                if len(texts) == BATCH or size > MOST_WORDS_A_STEP:
                    step()
                    size = 0
        if texts:
            step()
        if seen:
            flat = np.concatenate([own.w[k].ravel() for k in names]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "w"])

    made = teachers.select("__text", "__toxic").coalesce(parts).mapInArrow(run, "n bigint, w binary").collect()
    if made:
        mean = sum(np.frombuffer(r.w, np.float32) * np.float64(r.n) for r in made) / sum(r.n for r in made)
        at = 0
        for k in names:
            size = network.w[k].size
            network.w[k] = mean[at : at + size].reshape(network.w[k].shape).astype(np.float32)
            at += size
    network.forget()
    return network


def frequent_words(texts: DataFrame) -> list[str]:
    """The words that most documents hold, at most MOST_WORDS, each in LEAST_DOCS at least."""

    def begin() -> Callable:
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            words, row, sizes = split_words([x or "" for x in part.column("__text").to_pylist()])
            of_doc = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(words)) + row)
            seen = np.bincount(of_doc % max(1, len(words)), minlength=len(words))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(seen, pa.int64())], names=["word", "n"])

        return work

    counts = explode_texts(texts.select("__text"), "__text", "word string, n bigint", begin, SCORED_CHARS).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()]


def scorer(network: Network) -> Callable[[list[str]], list[float]]:
    """A function from whole texts to scores."""

    def score(texts: list[str]) -> list[float]:
        words, row, sizes = split_words(texts)
        row = np.append(row, 0)
        known = network.rows(words)
        halves = network.halves(network.table[known] if words else np.zeros((1, 6 * HIDDEN), np.float32))
        worst = np.full(len(texts), -np.inf, np.float32)
        first = np.cumsum(sizes) - sizes
        # half windows that stand one behind the other: a window is one and the next, where ``owner`` names its text
        owner, begin = [], []
        for i, size in enumerate(sizes.tolist()):
            if size >= WINDOW:
                *at, last = window_rows(size)
                if at and last != at[-1] + STRIDE:
                    owner += [i] * len(at) + [-1, i, -1]
                    begin += [first[i] + x for x in (*at, at[-1] + STRIDE, last, last + STRIDE)]
                else:
                    owner += [i] * len(at) + [i, -1]
                    begin += [first[i] + x for x in (*at, last, last + STRIDE)]
        owner, begin = np.array(owner, np.int64), np.array(begin, np.int64)
        for k in range(0, len(owner) - 1, SCORED_LANES):
            at = row[begin[k : k + SCORED_LANES + 1, None] + np.arange(STRIDE)]
            given = [np.ascontiguousarray(half.take(at, axis=0).transpose(1, 2, 0)) for half in halves]
            lanes = len(at) - 1
            out = network.window_logits(lambda k, t: given[k][t % STRIDE][:, t // STRIDE : t // STRIDE + lanes], WINDOW, lanes, None)
            mine = owner[k : k + lanes]
            np.maximum.at(worst, mine[mine >= 0], out[mine >= 0])
        short = np.flatnonzero(sizes < WINDOW)
        for k in range(0, len(short), SCORED_LANES):
            mine = short[k : k + SCORED_LANES]
            steps = np.arange(WINDOW)[:, None]
            real = steps < sizes[mine]
            at = row[np.where(real, first[mine] + steps, 0)]
            worst[mine] = network.window_logits(lambda k, t: halves[k].take(at[t], axis=0).T, WINDOW, len(mine), real.astype(np.float32))
        return sigmoid(worst.astype(float)).tolist()

    return score


def threshold_of(logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the logits that give the least sum of the error rates, a clean text's error weighing CLEAN_WEIGHT; ``toxic`` and ``clean``
    texts have each logit."""
    order = np.argsort(logits, kind="stable")
    x, toxic, clean = logits[order], toxic[order], clean[order]
    missed = np.r_[0, np.cumsum(toxic)] / max(1, toxic.sum())
    wrong = (clean.sum() - np.r_[0, np.cumsum(clean)]) / max(1, clean.sum())
    cost = missed + CLEAN_WEIGHT * wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    low, high = best[0], best[-1]
    return float((x[max(low - 1, 0)] + x[min(high, len(x) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Network:
    """A network from the labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    Three quarters of them train. The first MOST_TOXIC and MOST_CLEAN by a hash of their id give the first weights: BAG windows
    of each come to the driver (about 10 MB). From there tasks go on over all windows of all of them; words are counted in all of them. The whole
    texts of the other quarter are scored by tasks, and the network's bias is set so that THRESHOLD parts their labels best. The driver
    gets PARTS sets of weights and one row a step of the logits, however many documents there are. A document with several labels
    counts as toxic if one says so; null labels say nothing. Of rows that share an id one text is used, the one with the least hash.
    """
    known = stage(
        labels.select(F.col(doc_id).cast("long").alias("__id"), F.col(toxic).cast("int").alias("__toxic"))
        .where(F.col("__id").isNotNull() & F.col("__toxic").isin(0, 1) & (crc_remainder(F.col("__id"), 4) != 2))
        .groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
        .withColumn("__judge", F.pmod(F.xxhash64(F.lit(SEED + 1), "__id"), F.lit(4)) == 0))
    base = keep_likely(with_text(docs, doc_id, text), known, ["__id"])
    text_ = F.min_by("__text", F.struct(F.xxhash64("__text"), F.coalesce("__text", F.lit(""))))
    texts = stage(base.join(known, "__id").groupBy("__id", "__toxic", "__judge").agg(text_.alias("__text")))
    numbers = {(r["__judge"], r["__toxic"]): r["count"] for r in texts.groupBy("__judge", "__toxic").count().collect()}
    apart = min(numbers.get((True, 0), 0), numbers.get((True, 1), 0)) >= LEAST_JUDGES
    teachers, judges = (texts.where("NOT __judge"), texts.where("__judge")) if apart else (texts, texts)
    n_clean, n_toxic = (numbers.get((False, y), 0) + (0 if apart else numbers.get((True, y), 0)) for y in (0, 1))
    place = F.xxhash64(F.lit(SEED), "__id")
    first = (
        teachers.where("__toxic = 1").select("__id", place.alias("__place")).orderBy("__place").limit(MOST_TOXIC)
        .unionByName(teachers.where("__toxic = 0").select("__id", place.alias("__place")).orderBy("__place").limit(MOST_CLEAN)).select("__id"))

    def begin() -> Callable:
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            for doc, text_, label in zip(*(part.column(c).to_pylist() for c in ("__id", "__text", "__toxic")), strict=True):
                words = words_of(text_ or "")
                for at in window_rows(len(words), BAG):
                    for column, value in zip(out, (doc, label, " ".join(words[at : at + WINDOW])), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["doc", "label", "words"])

        return work

    wanted = teachers.join(F.broadcast(first), "__id").select("__id", "__text", "__toxic")
    rows = explode_texts(wanted, "__text", "doc bigint, label int, words string", begin).collect()
    network, steps = train(sorted((r.doc, r.label, r.words) for r in rows), frequent_words(teachers) if n_toxic and n_clean else [])
    if n_toxic and n_clean:
        network = go_on(network, steps, teachers, n_toxic, n_clean)
    p = F.least(F.greatest(F.col("__score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    judged = with_scores(judges.select("__text", "__toxic"), network, "__text").groupBy(
        F.round(F.log(p / (1 - p)) * LOGIT_STEPS).cast("long").alias("step")).agg(
        F.count_if(F.col("__toxic") == 1).alias("toxic"), F.count_if(F.col("__toxic") == 0).alias("clean")).toPandas()
    if judged["toxic"].sum() and judged["clean"].sum():
        bar = threshold_of(*(judged[c].to_numpy() for c in ("step", "toxic", "clean"))) / LOGIT_STEPS
        network.w["out0"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - bar)
    return network


def with_scores(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``__score`` of every whole text: the worst of its overlapping windows. A null or empty text is scored as
    a window without words, a defined number between 0 and 1 too. All columns and rows are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def begin() -> Callable:
        score = scorer(shared.value)
        return lambda texts: [score(texts)]

    return add_columns(docs, text, [("__score", T.DoubleType())], begin, SCORED_CHARS)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; see ``fit`` and ``with_scores``. ``held_out`` marks rows
    whose crc32(doc_id as text) mod 4 is 2 (null for a null id); only a text ever enters its score."""
    scored = with_scores(with_text(docs, doc_id, text), fit(docs, labels, doc_id, text), "__text")
    return scored.select(
        F.col("__id").alias("doc_id"), (crc_remainder(F.col("__id"), 4) == 2).alias("held_out"),
        F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
