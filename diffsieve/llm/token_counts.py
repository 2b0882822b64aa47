"""Token counts with a byte-level merge vocabulary.

Texts are cut into pre-tokens, each distinct pre-token of a group of texts becomes a run in one flat (ragged) array of
symbols, and all runs apply their lowest-ranked pair in the same step. What is left of a run is its count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import add_columns, with_text

#: Fixed value: the pattern of the byte-level pre-tokenizer. The white space class is spelled out, as it differs by library.
_SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
NEVER = np.int64(2**40)
#: Known stretches that a worker remembers; emptied when full.
REMEMBERED = 1_500_000
#: Stretches of a long text that are held at once.
HELD = 200_000


def printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a character: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """The pair table of a vocabulary file, sorted for search."""

    def __init__(self, path: str) -> None:
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        self.name = path
        vocabulary = file["model"]["vocab"]
        letters = printable_bytes()
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.width = np.int64(max(vocabulary.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.specials = [t["content"] for t in file.get("added_tokens", [])]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' places in the table, or -1."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word."""
        lengths = np.array([len(w) for w in words], np.int64)
        left = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        run = np.repeat(np.arange(len(words)), lengths)

        def ranked(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at these places; NEVER where there is none."""
            out = np.full(len(at), NEVER)
            inner = np.flatnonzero(at + 1 < len(symbols))
            inner = inner[run[at[inner]] == run[at[inner] + 1]]
            place = self.look_up(symbols[at[inner]], symbols[at[inner] + 1])
            out[inner] = np.where(place >= 0, self.ranks[place], NEVER)
            return out

        by_rank = np.empty(len(self.made), np.int64)
        by_rank[self.ranks] = self.made
        rank = ranked(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            here = np.repeat(least, sizes)
            alive = here < NEVER
            if not alive.all():  # finished runs leave the arrays
                symbols, run, rank, here = symbols[alive], run[alive], rank[alive], here[alive]
                if not len(symbols):
                    break
            chosen = rank == here
            # of overlapping equal pairs (aaa) every second one, counted from the left
            opens = chosen & ~np.r_[False, chosen[:-1]]
            since = np.arange(len(chosen)) - np.maximum.accumulate(np.where(opens, np.arange(len(chosen)), 0))
            at = np.flatnonzero(chosen & (since % 2 == 0))
            symbols[at] = by_rank[rank[at]]
            left -= np.bincount(run[at], minlength=len(left))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = (np.cumsum(keep) - 1)[at]
            symbols, run, rank = symbols[keep], run[keep], rank[keep]
            touched = np.zeros(len(symbols), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            changed = np.flatnonzero(touched)
            rank[changed] = ranked(changed)
        return left


#: What a worker process has counted, by vocabulary. Only a memory: every entry can be made anew.
_KNOWN: dict[str, dict[str, int]] = {}


def counter(merges: Merges) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, with a bounded memory of stretches of text.

    A blank between two other characters always begins a pre-token. So a text without adjacent white space is cut
    at its blanks, and stretches that were seen before are not cut further; any other text is cut by the pattern.
    """
    pattern = regex.compile(PRE_TOKEN)
    adjacent = re.compile(r"\s\s|^\s|\s$")
    specials = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True))) or r"(?!)")
    known = _KNOWN.setdefault(merges.name, {})

    def learn(units: set[str]) -> None:
        if len(known) > REMEMBERED:
            known.clear()
        new = [u for u in units if u not in known]
        if not new:
            return
        cut = [pattern.findall(u) for u in new]
        words = list({w for found in cut for w in found})
        size = dict(zip(words, merges.counts([w.encode() for w in words]).tolist(), strict=True))
        known.update((u, sum(map(size.__getitem__, found))) for u, found in zip(new, cut, strict=True))

    def units_of(part: str) -> Iterator[list[str]]:
        if not part:
            return
        if adjacent.search(part):
            found = (m.group() for m in pattern.finditer(part))
            while block := list(islice(found, HELD)):
                yield block
        else:
            first, *others = part.split(" ")
            yield [first]
            for at in range(0, len(others), HELD):
                yield [" " + x for x in others[at : at + HELD]]

    def count(texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            learn(set().union(*(units for _, units in held)))
            for i, units in held:
                totals[i] += sum(map(known.__getitem__, units))
            held.clear()

        for i, text in enumerate(texts):
            parts = specials.split(text) if merges.specials else [text]
            totals[i] += len(parts) - 1
            for part in parts:
                for units in units_of(part):
                    held.append((i, units))
                    size += len(units)
                    if size > 4 * HELD:
                        settle()
                        size = 0
        settle()
        return totals

    return count


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``, whole texts.

    A null or empty text has 0 bytes and 0 tokens. A special string of the vocabulary inside a text is one token, as
    the tokenizer library counts it. Repeated rows are counted each; a null ``doc_id`` stays null; other columns of
    ``docs`` are not read. The vocabulary file is read on the driver and sent to the tasks (a few MB at most).
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))
    counted = add_columns(
        with_text(docs, doc_id, text), "__text", [("n_tokens", T.LongType())],
        lambda: (lambda count: lambda texts: [count(texts)])(counter(merges.value)),
    )
    return counted.select(
        F.col("__id").alias("doc_id"),
        F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
