"""Finding the few rules of a large table that a line can match.

Most patterns contain texts that every match has to contain. One automaton over these texts of all rules reads each line once and names the
candidates; only they are tried as patterns. The work per line does not grow with the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edges import shape_of

# Shortest text that is looked for, and most alternatives of which a match has one.
LEAST, MOST = 3, 16


def required_texts(pattern: str) -> list[str]:
    """Lower-case ASCII texts of which every matching line has at least one; empty if the pattern names none.

    Read from the syntax tree of the pattern. What Python's syntax does not know (it shares most with Java's) gives
    none, so the pattern is then tried on every line.
    """
    try:
        with_tree = re._parser.parse(pattern)  # the standard library's own reader of patterns
    except (re.error, OverflowError, RecursionError):
        return []
    if with_tree.state.flags & re.VERBOSE:
        return []
    return sorted(_best(_texts(with_tree)) or [])


def _best(found: list[set[str]]) -> set[str] | None:
    """The alternatives whose shortest text is longest."""
    usable = [s for s in found if len(s) <= MOST and min(map(len, s)) >= LEAST]
    return max(usable, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=None)


def _texts(tree) -> list[set[str]]:
    """Every set of texts of which a match of the tree has one."""
    found: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append({run})
        run = ""

    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
        elif name == "AT":
            continue  # has no width, so the texts around it stand side by side
        elif name == "SUBPATTERN":
            inner = value[3]
            if all(str(k) == "LITERAL" and v < 128 for k, v in inner):
                run += "".join(chr(v).lower() for _, v in inner)
            else:
                close()
                found.extend(_texts(inner))
        elif name == "BRANCH":
            close()
            sets = [_best(_texts(branch)) for branch in value[1]]
            if all(sets):
                found.append(set().union(*sets))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            close()
            if value[0] >= 1:
                found.extend(_texts(value[2]))
        elif name == "ATOMIC_GROUP":
            close()
            found.extend(_texts(value))
        else:
            close()
    close()
    return found


def compiled(rules: list[tuple[int, str]]) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """The texts to look for with the rules of each, and the rules that have none."""
    read = [(number, required_texts(pattern)) for number, pattern in rules]
    return required_of(read), [number for number, texts in read if not texts]


def required_of(rules: Iterable[tuple[int, list[str]]]) -> list[tuple[str, list[int]]]:
    """The texts to look for with the rules of each."""
    of: dict[str, list[int]] = {}
    for number, texts in rules:
        for text in texts:
            of.setdefault(text, []).append(number)
    return list(of.items())


def read_patterns(rules: DataFrame) -> DataFrame:
    """``rule_ord, ruleset, pattern`` with the edges and the text between them, if that is all there is (see `edges`), and the required texts."""
    kept = rules.where("ruleset IS NOT NULL AND pattern IS NOT NULL").select("rule_ord", "ruleset", "pattern")
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL("shape STRING, literal STRING, texts ARRAY<STRING>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = batch.column("pattern").to_pylist()
            read = [(p is not None and shape_of(p)) or (None, None) for p in patterns]
            texts = [[t.lower()] if t else required_texts(p or "") for p, (_, t) in zip(patterns, read, strict=True)]
            new = [pa.array([s for s, _ in read], pa.string()), pa.array([t for _, t in read], pa.string()), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return kept.mapInArrow(run, schema)


def candidate_rules(lines: DataFrame, texts: list[tuple[str, list[int]]], name: str = "rule_ord") -> DataFrame:
    """``lines`` (with a column ``text``) once for every rule that has a text in the line, numbered in ``name``. One pass over the lines; those
    without a candidate stay behind. A line leaves Python once, with all its candidates."""
    shared = lines.sparkSession.sparkContext.broadcast({"texts": texts})
    schema = T.StructType([*lines.schema.fields, T.StructField("_rules", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        if "automaton" not in made:  # once a worker, not once a task
            automaton = ahocorasick.Automaton()
            for i, (text, _) in enumerate(made["texts"]):
                automaton.add_word(text, i)
            automaton.make_automaton()
            made["numbers"] = [np.array(n, np.int64) for _, n in made["texts"]]
            made["automaton"] = automaton
        automaton, numbers = made["automaton"], made["numbers"]
        for batch in batches:
            lowered = [(x or "").lower() for x in batch.column("text").to_pylist()]
            ends = np.cumsum([len(x) + 1 for x in lowered], dtype=np.int64)
            at, hit = [], []
            for end, i in automaton.iter("\n".join(lowered)):
                at.append(end)
                hit.append(i)
            if not hit:
                continue
            row = np.searchsorted(ends, np.array(at), side="right")
            pairs = np.unique(row * len(numbers) + np.array(hit))  # a text may stand several times in a line
            row, hit = np.divmod(pairs, len(numbers))
            sizes = np.array([len(numbers[i]) for i in hit.tolist()])
            rule = np.concatenate([numbers[i] for i in hit.tolist()])
            both = np.unique(np.stack([np.repeat(row, sizes), rule]), axis=1)  # a rule may have several texts in a line
            kept, begins = np.unique(both[0], return_index=True)
            rules = pa.ListArray.from_arrays(pa.array([*begins.tolist(), both.shape[1]], pa.int32()), pa.array(both[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, rules], names=schema.names)

    return lines.mapInArrow(run, schema).withColumn(name, F.explode("_rules")).drop("_rules")


def matching_rules(lines: DataFrame, rules: DataFrame, texts: list[tuple[str, list[int]]]) -> DataFrame:
    """Lines with the rules (``rule_ord``) of their ruleset that match, found through ``texts``.

    The patterns go to all tasks, as ``texts`` do: a line may have hundreds of candidates, and is not moved for any of them.
    """
    patterns = F.broadcast(rules.select("rule_ord", F.col("ruleset").alias("_of"), F.col("pattern").alias("_pattern")))
    tried = candidate_rules(lines, texts).join(patterns, "rule_ord")
    return tried.filter((F.col("ruleset") == F.col("_of")) & F.expr("text rlike _pattern")).select(*lines.columns, "rule_ord")
