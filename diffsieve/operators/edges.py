"""Rules that are a plain text between two edges, such as ``(?i)(^|[^a-z])word([^a-z]|$)``, found without trying a pattern.

An edge asks at most for the start or end of the line or for one character of a set. What such a pattern matches follows from the bytes at the
text and beside it, so a hash of the bytes finds the rules, and a comparison of the bytes decides. The work for a line follows the matches in it, not
the number of rules. Only patterns that mean the same to every reader of patterns are taken here; the others are tried as patterns (see `literals`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shortest and longest text of such a rule.
LEAST, MOST = 3, 255
# Rules with the same edges that are worth a pass over the bytes of their own; most rules sent to the workers at once; most of one broadcast.
LEAST_ALIKE, PASS_RULES, SENT_RULES = 1000, 2_500_000, 250_000
# Bytes of lines looked at together.
SLICE = 1 << 20

_SET = r"(?:\[\^?(?:[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|[A-Za-z0-9_ \t,.;:/\"'=<>()+*?|$@%~!]|\\[dwst])+\]|\\[dwstDWS])"


def _edge(anchor: str) -> str:
    one = rf"(?:{anchor}|{_SET})"
    return rf"(?:{one}|\((?:\?:)?{one}(?:\|{one})*\))?"


_RULE = re.compile(
    rf"((?:\(\?i\))?)({_edge(r'\^')})((?:[A-Za-z0-9_ \"'=,;:<>/@%~`!-]|\\[.\\+*?()\[\]{{}}|^$/\"'-])+)({_edge(r'\$')})", re.ASCII)
_PART = re.compile(rf"\^|\$|{_SET}", re.ASCII)
_ITEM = re.compile(r"\\[dwstDWS]|[A-Za-z0-9]-[A-Za-z0-9]|.", re.ASCII | re.DOTALL)
_KNOWN = {"d": "0123456789", "t": "\t", "s": " \t\n\x0b\f\r", "w": "0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
#: How a line may end behind the place where ``$`` matches.
_ENDINGS = (b"\r\n", b"\n", b"\r", b"\xc2\x85", b"\xe2\x80\xa8", b"\xe2\x80\xa9")


def shape_of(pattern: str) -> tuple[str, str] | None:
    """The edges of a pattern, as one text, and what stands between them; None if the pattern is another."""
    found = _RULE.fullmatch(pattern)
    if not found:
        return None
    fold, left, text, right = found.groups()
    literal = re.sub(r"\\(.)", r"\1", text)
    if not LEAST <= len(literal) <= MOST or any(s[0] > s[2] for s in re.findall(r"[A-Za-z0-9]-[A-Za-z0-9]", left + right)):
        return None
    return f"{fold}\n{left}\n{right}", literal.lower() if fold else literal


def _set(source: str, fold: bool) -> np.ndarray:
    """Which bytes a set takes; all bytes from 128 on belong to characters beyond ASCII."""
    taken = np.zeros(256, bool)
    inner = source[1:-1] if source.startswith("[") else source
    turned = source.startswith("[^")
    for item in _ITEM.findall(inner[1:] if turned else inner):
        if item.startswith("\\"):
            known = np.zeros(256, bool)
            known[[ord(c) for c in _KNOWN[item[1].lower()]]] = True
            taken |= ~known if item[1].isupper() else known
        else:
            chars = range(ord(item[0]), ord(item[-1]) + 1)
            taken[[ord(x) for c in chars for x in ({chr(c).lower(), chr(c).upper()} if fold else {chr(c)})]] = True
    return ~taken if turned else taken


def _sides(source: str, fold: bool) -> tuple[bool, np.ndarray]:
    """Whether an edge takes the end of the line, and which bytes it takes."""
    if not source:
        return True, np.ones(256, bool)
    parts = _PART.findall(re.sub(r"^\((\?:)?|\)$", "", source) if source.startswith("(") else source)
    taken = np.zeros(256, bool)
    for part in parts:
        if part not in "^$":
            taken |= _set(part, fold)
    return any(p in "^$" for p in parts), taken


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0 to n - 1, modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        made = np.full(max(n, SLICE + 256), base, np.uint64)
        made[0] = 1
        _powers[base] = np.multiply.accumulate(made)
    return _powers[base][:n]


class Index:
    """Rules ``shape, literal, ruleset, rule_ord`` (the first and third as dictionaries) by edges, length and hash of the text."""

    def __init__(self, rules: pa.Table):
        rules = rules.unify_dictionaries()
        shape, ruleset = (rules[c].combine_chunks() for c in ("shape", "ruleset"))
        self.rulesets = {r: i for i, r in enumerate(ruleset.dictionary.to_pylist())}
        literal = rules["literal"].combine_chunks().cast(pa.large_binary())
        begins = np.frombuffer(literal.buffers()[1], np.int64)[literal.offset : literal.offset + len(literal) + 1]
        data = np.frombuffer(literal.buffers()[2], np.uint8)
        sizes = np.diff(begins)
        of = shape.indices.to_numpy()
        ords, sets = rules["rule_ord"].to_numpy(), ruleset.indices.to_numpy().astype(np.int32)
        alike = np.argsort(of * (MOST + 1) + sizes, kind="stable")
        groups = np.split(alike, np.flatnonzero(np.diff((of * (MOST + 1) + sizes)[alike])) + 1)
        self.shapes = []
        for k, name in enumerate(shape.dictionary.to_pylist()):
            fold, left, right = name.split("\n")
            lengths, chars = [], np.zeros(256, bool)
            while groups and of[groups[0][0]] == k:
                rows = groups.pop(0)
                n = int(sizes[rows[0]])
                texts = np.empty((len(rows), n), np.uint8)
                for j in range(n):
                    texts[:, j] = data[begins[rows] + j]
                hashes = np.zeros(len(rows), np.uint64)
                for j in range(n):
                    hashes += texts[:, j] * _powers_of(_BASE, MOST + 1)[j]
                order = np.argsort(hashes)
                rows = rows[order]
                chars[np.unique(texts)] = True
                lengths.append((n, hashes[order], texts[order], ords[rows], sets[rows]))
            self.shapes.append((bool(fold), _sides(left, bool(fold)), _sides(right, bool(fold)), chars, lengths))

    def find(self, data: np.ndarray, ends: np.ndarray, rulesets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and rules of the matches in rows that lie side by side in ``data`` up to ``ends``; each pair once, by row."""
        begins = np.concatenate([ends[:1] * 0, ends[:-1]])
        filled = ends > begins
        begins, ends, rulesets, number = begins[filled], ends[filled], rulesets[filled], np.flatnonzero(filled)
        found = [np.zeros(0, np.int64)]
        closing = None
        inverse, weights = _powers_of(_INVERSE, len(data) + 1), _powers_of(_BASE, len(data) + 1)
        for folded in {s[0] for s in self.shapes}:
            taken = _LOW[data] if folded else data
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(taken * weights[:-1], out=sums[1:])
            for fold, (at_start, before), (at_end, behind), chars, lengths in self.shapes:
                if fold != folded:
                    continue
                may_start = np.ones(len(data), bool)
                may_start[1:] = before[data[:-1]]
                may_start[begins] = at_start
                may_start &= chars[taken]
                may_end = np.empty(len(data) + 1, bool)
                may_end[:-1] = behind[data]
                may_end[ends] = at_end
                if at_end:
                    if closing is None:
                        closing = _closing(data, begins, ends)
                    may_end[closing] = True
                start = np.flatnonzero(may_start)
                row = np.searchsorted(ends, start, side="right")
                others = np.append(np.flatnonzero(~chars[taken]), len(data))
                stop = np.minimum(ends[row], others[np.searchsorted(others, start)])
                for n, hashes, texts, ords, sets in lengths:
                    wide = start + n <= stop
                    start, row, stop = start[wide], row[wide], stop[wide]
                    here = np.flatnonzero(may_end[start + n])
                    at = start[here]
                    wanted = (sums[at + n] - sums[at]) * inverse[at]
                    first = np.searchsorted(hashes, wanted)
                    hit = np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == wanted)
                    if not len(hit):
                        continue
                    here, at, first = here[hit], at[hit], first[hit]
                    many = np.searchsorted(hashes, wanted[hit], side="right") - first
                    rule = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                    here, at = np.repeat(here, many), np.repeat(at, many)
                    same = sets[rule] == rulesets[row[here]]
                    rule, here, at = rule[same], here[same], at[same]
                    same = np.ones(len(rule), bool)
                    for j in range(n):
                        same &= texts[rule, j] == taken[at + j]
                    found.append(number[row[here[same]]] << 32 | ords[rule[same]].astype(np.int64) + (1 << 31))
        pairs = np.unique(np.concatenate(found))
        return pairs >> 32, ((pairs & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)


def _closing(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places before the last character of those rows that end in one that ends a line."""
    found, seen = [], np.zeros(len(ends), bool)
    for ending in _ENDINGS:
        rows = np.flatnonzero(~seen & (ends - begins >= len(ending)))
        for j, byte in enumerate(ending):
            rows = rows[data[ends[rows] - len(ending) + j] == byte]
        seen[rows] = True
        found.append(ends[rows] - len(ending))
    return np.concatenate(found)


def edged_rules(lines: DataFrame, rules: DataFrame, passes: int, pieces: int) -> list[DataFrame]:
    """Lines with the rules (``shape, literal, ruleset, rule_ord``) of their ruleset that match, numbered in ``rule_ord``.

    The driver passes the rules on in pieces that it forgets at once; workers hold one pass of them as arrays. No line is moved.
    """
    return [_one_pass(lines, rules, [p for p in range(pieces) if p % passes == k], pieces) for k in range(passes)]


def _one_pass(lines: DataFrame, rules: DataFrame, own: list[int], pieces: int) -> DataFrame:
    context = lines.sparkSession.sparkContext
    place = F.pmod(F.xxhash64("rule_ord"), F.lit(pieces))
    shared = []
    for piece in own:
        made = rules.where(place == piece).select("shape", "literal", "ruleset", F.col("rule_ord").cast("int").alias("rule_ord")).toArrow()
        for k in (0, 2):
            made = made.set_column(k, made.column_names[k], made.column(k).dictionary_encode())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, made.schema) as out:
            out.write_table(made)
        shared.append(context.broadcast({"rules": sink.getvalue().to_pybytes()}))
    schema = T.StructType([*lines.schema.fields, T.StructField("_rules", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared[0].value
        if "index" not in kept:  # once a worker, not once a task
            kept["index"] = Index(pa.concat_tables(pa.ipc.open_stream(s.value.pop("rules")).read_all() for s in shared))
        index = kept["index"]
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            if text.null_count:
                text = text.fill_null(b"")
            if not pa.compute.sum(pa.compute.binary_length(text)).as_py():
                continue
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)
            rulesets = np.array([index.rulesets.get(r, -1) if r is not None else -1 for r in batch.column("ruleset").to_pylist()], np.int32)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
                row, rule = index.find(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], rulesets[at:to])
                if len(row):
                    some, begins = np.unique(row, return_index=True)
                    numbers = pa.ListArray.from_arrays(pa.array([*begins.tolist(), len(rule)], pa.int32()), pa.array(rule, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some + at)).columns, numbers], names=schema.names)
                at = to

    return lines.mapInArrow(run, schema).withColumn("rule_ord", F.explode("_rules")).drop("_rules")
