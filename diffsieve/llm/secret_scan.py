"""Secrets in texts, found with one automaton for all rules.

The rules are small expression trees over byte classes. Subset construction turns the reversed rules into one
deterministic automaton, minimisation merges its equal states, and the result is a flat transition array over byte
classes. One pass over a text's bytes, from the end, marks where a match of each rule begins; the rule's own forward
automaton then gives the longest match from the leftmost beginning. Matches of one rule never overlap.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import add_columns, with_text

# Expression trees: ("set", bytes) | ("cat", parts) | ("or", parts) | ("star", part)
Node = tuple


def chars(text: str) -> Node:
    return ("set", frozenset(text.encode()))


def between(*ranges: str) -> Node:
    """A class from ranges such as "AZ" and single characters such as "_"."""
    out: set[int] = set()
    for r in ranges:
        out.update(range(ord(r[0]), ord(r[-1]) + 1))
    return ("set", frozenset(out))


def word(text: str, any_case: bool = False) -> Node:
    return ("cat", [chars(c.lower() + c.upper() if any_case else c) for c in text])


def either(*parts: Node) -> Node:
    return ("or", list(parts))


def maybe(part: Node) -> Node:
    return ("or", [part, ("cat", [])])


def star(part: Node) -> Node:
    return ("star", part)


def times(part: Node, n: int) -> Node:
    return ("cat", [part] * n)


def at_least(part: Node, n: int) -> Node:
    return ("cat", [part] * n + [("star", part)])


def seq(*parts: Node) -> Node:
    return ("cat", list(parts))


@dataclass(frozen=True)
class Rule:
    """Matches shorter than ``shortest`` are dropped, and so are those whose value (what stands behind the sign, blanks
    and quote of an assignment) is shorter than ``value``. Lengths are tested after matching: as counters in the
    automaton they would multiply its states, and a dropped match still uses up its text."""

    kind: str
    tree: Node
    shortest: int = 0
    value: int = 0


_UPPER, _LOWER, _DIGIT = "AZ", "az", "09"
_ALNUM = between(_UPPER, _LOWER, _DIGIT)
_URL64 = between(_UPPER, _LOWER, _DIGIT, "_", "-")
_QUOTE = chars("\"'")
_VALUE = between(_UPPER, _LOWER, _DIGIT, "+", "/", "_", ".", "=", "-")
_NAMES = either(
    word("password", True), word("passwd", True), word("secret", True), word("token", True),
    seq(word("api", True), maybe(chars("_")), word("key", True)),
)
#: Base kinds in their fixed order, then the kinds that this scan adds. Matches of different kinds may overlap.
RULES = [
    Rule("assign", seq(_NAMES, maybe(_QUOTE), star(chars(" ")), chars(":="), star(chars(" ")), maybe(_QUOTE), at_least(_VALUE, 1)), value=12),
    Rule("access", seq(word("AKIA"), at_least(between(_UPPER, _DIGIT), 1)), shortest=18),
    Rule("hex", at_least(between(_DIGIT, "af"), 16)),
    Rule("session", seq(word("ASIA"), at_least(between(_UPPER, _DIGIT), 1)), shortest=18),
    Rule("forge", seq(word("gh"), chars("pousr"), chars("_"), at_least(_ALNUM, 1)), shortest=40),
    Rule("chat", seq(word("xox"), chars("abprs"), chars("-"), at_least(between(_UPPER, _LOWER, _DIGIT, "-"), 1)), shortest=15),
    Rule("maps", seq(word("AIza"), at_least(_URL64, 1)), shortest=39),
    Rule("web_token", seq(word("eyJ"), at_least(_URL64, 1), chars("."), word("eyJ"), at_least(_URL64, 1), chars("."), at_least(_URL64, 1)), shortest=30),
    Rule("private_key", seq(word("-----BEGIN "), star(seq(at_least(between(_UPPER), 1), chars(" "))), word("PRIVATE KEY-----"))),
]
BASE = 3


def reverse(node: Node) -> Node:
    kind, body = node
    if kind == "cat":
        return (kind, [reverse(x) for x in reversed(body)])
    if kind == "or":
        return (kind, [reverse(x) for x in body])
    return (kind, reverse(body)) if kind == "star" else node


class Nfa:
    """Moves on byte sets and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node: Node, begin: int) -> int:
        """The state in which a match of ``node`` that starts in ``begin`` ends."""
        kind, body = node
        if kind == "set":
            end = self.state()
            self.moves[begin].append((body, end))
            return end
        if kind == "cat":
            for part in body:
                begin = self.add(part, begin)
            return begin
        if kind == "or":
            end = self.state()
            for part in body:
                way = self.state()
                self.empty[begin].append(way)
                self.empty[self.add(part, way)].append(end)
            return end
        loop, end = self.state(), self.state()
        self.empty[begin].append(loop)
        self.empty[self.add(body, loop)].append(loop)
        self.empty[loop].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


class Automaton:
    """A minimal deterministic automaton. ``step[state * classes + class]`` is the next state times ``classes``.

    State 0 is the dead state of an anchored automaton. ``says[state]`` is the tuple of rules that accept there.
    Accepting states are numbered last, from ``accepting`` (times ``classes``) on, so one comparison finds them.
    """

    def __init__(self, trees: list[Node], anywhere: bool) -> None:
        nfa = Nfa()
        ends: dict[int, int] = {}
        root = nfa.state()
        for k, tree in enumerate(trees):
            begin = nfa.state()
            nfa.empty[root].append(begin)
            ends[nfa.add(tree, begin)] = k
        # bytes that no rule tells apart share a class
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        traits = [tuple(b in s for s in sets) for b in range(256)]
        numbers = {t: i for i, t in enumerate(dict.fromkeys(traits))}
        self.byte_class = bytes(numbers[t] for t in traits)
        sample = [traits.index(t) for t in numbers]
        # subset construction
        start = nfa.closed([root])
        names = {frozenset(): 0, start: 1}
        todo, table = [start], [[0] * len(numbers)]
        if anywhere:
            names, todo, table = {start: 0}, [start], []
        for states in todo:
            row = []
            for byte in sample:
                reached = {t for s in states for chars_, t in nfa.moves[s] if byte in chars_}
                target = nfa.closed(reached | ({root} if anywhere else set()))
                if target not in names:
                    names[target] = len(names)
                    todo.append(target)
                row.append(names[target])
            table.append(row)
        says = [()] * len(names)
        for states, i in names.items():
            says[i] = tuple(sorted(ends[s] for s in states if s in ends))
        # minimisation: split the blocks of states until their moves agree
        block = {x: i for i, x in enumerate(sorted(set(says)))}
        of = [block[x] for x in says]
        while True:
            marks = [(of[i], *(of[j] for j in table[i])) for i in range(len(table))]
            block = {x: i for i, x in enumerate(dict.fromkeys(marks))}
            if len(block) == len(set(of)):
                break
            of = [block[x] for x in marks]
        members: dict[int, int] = {}
        for i, b in enumerate(of):
            members.setdefault(b, i)
        order = sorted(members, key=lambda b: (bool(says[members[b]]), members[b]))
        place = {b: i for i, b in enumerate(order)}
        self.classes = len(numbers)
        self.step = array("q", [place[of[j]] * self.classes for b in order for j in table[members[b]]])
        self.says = [says[members[b]] for b in order]
        self.accepting = next((i for i, x in enumerate(self.says) if x), len(order)) * self.classes
        self.begin = place[of[0 if anywhere else 1]] * self.classes
        self.dead = None if anywhere else place[of[0]] * self.classes


def scanner(rules: list[Rule]) -> Callable[[bytes], list[tuple[int, int, int]]]:
    """A function from a text's bytes to its matches ``(begin, end, rule)`` in bytes, in order of place and rule."""
    backward = Automaton([reverse(r.tree) for r in rules], anywhere=True)
    forward = [Automaton([r.tree], anywhere=False) for r in rules]
    step, accepting, classes = backward.step.tolist(), backward.accepting, backward.classes
    says = {i * classes: x for i, x in enumerate(backward.says)}
    steps = [a.step.tolist() for a in forward]

    def longest(k: int, data: bytes, begin: int) -> int:
        a, moves = forward[k], steps[k]
        state, end, classed = a.begin, -1, a.byte_class
        for i in range(begin, len(data)):
            state = moves[state + classed[data[i]]]
            if state == a.dead:
                break
            if state >= a.accepting:
                end = i + 1
        return end

    def scan(data: bytes) -> list[tuple[int, int, int]]:
        begins: list[list[int]] = [[] for _ in rules]
        state, at = backward.begin, len(data)
        for c in data[::-1].translate(backward.byte_class):
            at -= 1
            state = step[state + c]
            if state >= accepting:
                for k in says[state]:
                    begins[k].append(at)
        found = []
        for k, places in enumerate(begins):
            free = 0
            for begin in reversed(places):
                if begin >= free:
                    free = longest(k, data, begin)
                    if kept(rules[k], data[begin:free]):
                        found.append((begin, free, k))
        return sorted(found, key=lambda x: (x[0], x[2]))

    return scan


def kept(rule: Rule, match: bytes) -> bool:
    if len(match) < rule.shortest or not rule.value:
        return len(match) >= rule.shortest
    sign = next(i for i, b in enumerate(match) if b in b":=")
    value = match[sign + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b"'", b'"') else value) >= rule.value


def spans_of(text: str, scan: Callable[[bytes], list[tuple[int, int, int]]]) -> list[tuple[int, int, int]]:
    """Matches in code points."""
    data = text.encode()
    found = scan(data)
    if len(data) == len(text):
        return found
    places = sorted({p for begin, end, _ in found for p in (begin, end)})
    points, before, count = {}, 0, 0
    for p in places:
        count += len(data[before:p].decode())
        points[p], before = count, p
    return [(points[b], points[e], k) for b, e, k in found]


SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
])


def find_secrets(
    docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, found`` for every row: all matches (kind, begin, end in code points) of the whole text in order.

    A null or empty text has none. Repeated rows are scanned each; a null ``doc_id`` stays null; other columns are not
    read. A text's bytes are held once, so memory follows the longest text.
    """

    def begin() -> Callable:
        scan = scanner(rules)
        return lambda texts: [
            [[{"kind": rules[k].kind, "begin": b, "end": e} for b, e, k in spans_of(x, scan)] for x in texts]
        ]

    found = add_columns(with_text(docs, doc_id, text), "__text", [("found", T.ArrayType(SPAN))], begin)
    return found.select(F.col("__id").alias("doc_id"), "found")


def redact(text: str, found: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """``text`` with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    for begin, end in sorted(found):
        if begin >= at:
            out += [text[at:begin], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    base = [r.kind for r in RULES[:BASE]]

    def written(x: Column) -> Column:
        return F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(F.array_join(F.transform(of(*base), written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", written), ",").alias("spans"),
    )


__all__ = ["RULES", "Rule", "digest", "find_secrets", "redact", "scanner", "spans_of"]
