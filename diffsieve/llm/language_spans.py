"""Languages of texts, span by span.

Letters are cut into words where they end or where the script changes. A word's script leaves only the languages that are written in it
as candidates; a word scores for each of them by its letter sequences. The best path through all words of a text, with a
penalty for each change of language (Viterbi), labels every word; runs of one label are the spans. A text's language is the one with
most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import add_columns, crc_remainder, explode_texts, mix, seed_of, with_text
from diffsieve.staging import stage

#: First and last code points of the letters of each script.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Lao": ((0xE80, 0xEFF),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "Ethiopic": ((0x1200, 0x139F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
#: The class of letters outside all ranges.
OTHER = len(SCRIPTS) + 1
#: Documents of each language that the scores are learnt from at most, chosen by a hash of id and text.
MOST = 2_000
#: Letter sequences of 1 to LONGEST characters, counted in this many classes.
LONGEST, CLASSES = 4, 1 << 16
#: A language is written in a script if this share of its learnt letters is.
WRITTEN = 0.01
#: Cost of a change of language, and how far the sequences of a word, which overlap, count (as logarithms).
SWITCH, TEMPER, SMOOTH, SEED = 6.0, 0.35, 0.2, 13
UNKNOWN = "und"
#: Words that a worker remembers the scores of; emptied when full.
REMEMBERED = 1_000_000
#: Words on the paths that are followed at once, one text at least.
STEPS = 1_000_000


@cache
def letter_classes() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and the script class of letters and of marks in a script's ranges. Other marks have
    class 255: they go with the letter before. All else has class 0."""
    letter, kind = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint8)
    mark = np.zeros(0x110000, bool)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        if category[0] == "L":
            letter[point] = True
        elif category[0] == "M":
            mark[point] = True
    kind[letter], kind[mark] = OTHER, 255
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            here = slice(first, last + 1)
            kind[here][letter[here] | mark[here]] = number
    return letter, kind


def words_in(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, scripts, letters)`` of the words of a text, in code points."""
    letter, kind = letter_classes()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = kind[points]
    if (loose := script == 255).any():
        last = np.maximum.accumulate(np.where(loose, 0, np.arange(len(script))))
        script = np.where(script[last] == 255, 0, script[last])
    edges = np.flatnonzero(np.diff(np.r_[np.uint8(0), script, np.uint8(0)]))
    starts, ends = edges[:-1], edges[1:]
    inside = script[starts] > 0 if len(starts) else np.empty(0, bool)
    starts, ends = starts[inside], ends[inside]
    before = np.r_[0, np.cumsum(letter[points])]
    letters = before[ends] - before[starts]
    some = letters > 0
    return starts[some], ends[some], script[starts[some]], letters[some]


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word, class)`` of all letter sequences of the words, each word between two signs of its ends."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    of, classes = [], []
    for n in range(1, LONGEST + 1):
        if len(flat) < n:
            break
        value = np.full(len(flat) - n + 1, seed_of(SEED, n))
        for k in range(n):
            value = mix(value ^ flat[k : len(flat) - n + 1 + k])
        whole = word[: len(value)] == word[n - 1 :]
        of.append(word[: len(value)][whole])
        classes.append((value[whole] % np.uint64(CLASSES)).astype(np.int64))
    return np.concatenate([np.empty(0, np.int64), *of]), np.concatenate([np.empty(0, np.int64), *classes])


class Model:
    """Scores of letter sequences by language, and the languages of each script."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray) -> None:
        """``counts[l, c]`` sequences of class c in language l, ``letters[l, s]`` letters of script s in it."""
        self.languages = languages
        share = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * CLASSES)
        logs = np.log(share)
        self.scores = (logs - logs.mean(axis=0) if languages else logs).T.astype(np.float32).copy()
        written = letters >= WRITTEN * np.maximum(letters.sum(axis=1, keepdims=True), 1)
        written &= letters > 0
        self.candidates = np.where(written.any(axis=0), written, True).T.copy()  # a script of no language narrows nothing

    def score(self, words: list[str], scripts: np.ndarray) -> np.ndarray:
        """Logarithms of the candidates' shares for each lower-case word; far below for other languages."""
        of, classes = sequences(words)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(words)))
        total = np.add.reduceat(self.scores[classes[order]], starts, axis=0) * TEMPER
        total = np.where(self.candidates[scripts], total, -1e9)
        total -= total.max(axis=1, keepdims=True)
        return (total - np.log(np.exp(total).sum(axis=1, keepdims=True))).astype(np.float32)


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; the texts' words stand one after the other. Of equals the first language wins, and
    staying wins over changing. All texts of the block make a step at once, the longest go on alone."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    n = scores.shape[1]
    came = np.empty((len(scores), n), np.int16)
    label = np.empty(len(scores), np.int64)
    own = np.arange(n, dtype=np.int16)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts with more words than the step's number
    best = np.zeros((len(sizes), n))
    for t in range(steps):
        k = active[t]
        at = starts[:k] + t
        now = best[:k]
        if t:
            top = now.argmax(axis=1)
            changed = np.take_along_axis(now, top[:, None], axis=1) - switch
            stays = now >= changed
            came[at] = np.where(stays, own, top[:, None].astype(np.int16))
            now = np.where(stays, now, changed)
        best[:k] = now + scores[at]
    current = best.argmax(axis=1) if len(sizes) else np.empty(0, np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        label[at] = current[:k]
        if t:
            current[:k] = came[at, current[:k]]
    return label


def labeller(model: Model) -> Callable[[list[str]], tuple[list, list, list]]:
    """A function from texts to spans, languages and scores."""
    known: dict[tuple[str, int], int] = {}
    table = [np.empty((0, len(model.languages)), np.float32)]

    def rows_of(words: list[tuple[str, int]]) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
            table[0] = table[0][:0]
        new = list(set(words).difference(known))
        if new:
            made = model.score([w for w, _ in new], np.array([s for _, s in new]))
            known.update(zip(new, range(len(table[0]), len(table[0]) + len(new)), strict=True))
            table[0] = np.concatenate([table[0], made])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def of_some(texts: list[str], cut: list) -> list[tuple[list, str, float]]:
        lengths = np.array([len(c[0]) for c in cut], np.int64)
        words = [
            (w.lower(), s)
            for text, (starts, ends, scripts, _) in zip(texts, cut, strict=True)
            for w, s in zip((text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), scripts.tolist(), strict=True)]
        rows = rows_of(words)
        labels = best_paths(table[0][rows], lengths)
        bounds = np.r_[0, np.cumsum(lengths)]
        out = []
        for k, (starts, ends, _, letters) in enumerate(cut):
            own = labels[bounds[k] : bounds[k + 1]]
            if not len(own):
                out.append(([], UNKNOWN, 0.0))
                continue
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            last = np.r_[first[1:], len(own)] - 1
            spans = [
                {"start": a, "end": b, "lang": model.languages[i]}
                for a, b, i in zip(starts[first].tolist(), ends[last].tolist(), own[first].tolist(), strict=True)]
            weight = np.bincount(own, weights=letters, minlength=len(model.languages))
            top = int(weight.argmax())
            out.append((spans, model.languages[top], float(weight[top] / weight.sum())))
        return out

    def label(texts: list[str]) -> tuple[list, list, list]:
        if not model.languages:
            return [[] for _ in texts], [UNKNOWN] * len(texts), [0.0] * len(texts)
        out, held, cut, steps = [], [], [], 0
        for text in texts:
            held.append(text)
            cut.append(words_in(text))
            steps += len(cut[-1][0])
            if steps > STEPS:
                out += of_some(held, cut)
                held, cut, steps = [], [], 0
        out += of_some(held, cut)
        return tuple(list(x) for x in zip(*out, strict=True)) if out else ([], [], [])

    return label


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from text and language of rows whose crc32(id as text) mod 4 is not 2; rows without id, text or language teach nothing.

    MOST documents of each language are used at most, those with the least hash of id and text, each once however often its
    row repeats. Tasks count letter sequences; ``CLASSES`` numbers a language come to the driver, and at most 1,000 languages are taken
    (more raise ValueError, as the column then holds something else).
    """
    base = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder(F.col("id"), 4) != 2))
    keyed = base.withColumn("place", F.xxhash64(F.lit(SEED), "id", "text"))
    ranked = keyed.select("lang", "place").distinct().withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    chosen = stage(ranked.where(F.col("rank") <= MOST).select("lang", "place"))
    languages = [r["lang"] for r in chosen.select("lang").distinct().orderBy("lang").limit(1_001).collect()]
    if len(languages) > 1_000:
        raise ValueError("more than 1,000 languages")
    number = {x: i for i, x in enumerate(languages)}
    texts = keyed.join(F.broadcast(chosen), ["lang", "place"]).dropDuplicates(["lang", "place"]).select("lang", "text")

    def begin() -> Callable:
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            classes = np.zeros((len(languages), CLASSES + OTHER + 1), np.int64)
            for name, own in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                starts, ends, scripts, letters = words_in(own)
                words = [own[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                row = classes[number[name]]
                row[:CLASSES] += np.bincount(sequences(words)[1], minlength=CLASSES)
                row[CLASSES:] += np.bincount(scripts, weights=letters, minlength=OTHER + 1).astype(np.int64)
            l, c = np.nonzero(classes)
            return pa.RecordBatch.from_arrays(
                [pa.array(l, pa.int32()), pa.array(c, pa.int32()), pa.array(classes[l, c], pa.int64())], names=["l", "c", "n"])

        return work

    counted = explode_texts(texts, "text", "l int, c int, n bigint", begin).groupBy("l", "c").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(languages), CLASSES + OTHER + 1))
    total[counted["l"].to_numpy(np.int64), counted["c"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    return Model(languages, total[:, :CLASSES], total[:, CLASSES:])


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def with_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (start, end in code points, language), ``lang_pred`` and ``lang_score`` of every whole text.

    ``lang_score`` is the share of the letters in spans of ``lang_pred`` (of equals the first name). A text that is null or has no
    letter has no spans, language ``und`` and score 0; so has every text if no language was learnt. Rows and columns are kept; a new
    name that ``docs`` already has raises ValueError.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(
        docs, text, [("spans", SPANS), ("lang_pred", T.StringType()), ("lang_score", T.DoubleType())], lambda: labeller(shared.value))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``, learnt from the rows not held out (see ``fit``). Only a text
    enters its prediction. ``held_out`` is null for a null id; repeated rows repeat their result; other columns are not read."""
    found = with_languages(with_text(docs, doc_id, text), fit(docs, doc_id, text, lang), "__text")
    return found.select(
        F.col("__id").alias("doc_id"), (crc_remainder(F.col("__id"), 4) == 2).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"))
