"""Unit extraction and metrics, compared with Python's own syntax tree."""

import ast

import pytest

from pyspark.sql import functions as F

from diffsieve.operators import units

SOURCES = {
    "plain": '''
import os

def one(a, b=(1, 2), *rest, key={"x": [1]}, **extra):
    """Doc."""
    return a


@decorated(
    1,
)
async def two(self,
              x, /, y,
              *, z=lambda q, r: q):
    # comment first

    'doc too'
    async for item in x:
        if item:
            pass
''',
    "nested": '''
class Outer:
    class Inner:
        def deep(self):
            def deeper():
                if a:
                    for b in c:
                        while d:
                            with e:
                                try:
                                    f()
                                except G:
                                    if h:
                                        pass
            return deeper

    def shallow(self): return "x"

    def after(self):
        pass  # trailing

    # closing comment


if cond:
    def in_if():
        pass
elif other:
    def in_elif():
        pass
else:
    def in_else():
        pass

try:
    def in_try(): pass
except E:
    def in_except():
        return 1
finally:
    def in_finally():
        return 2

def last(): "one line doc"
''',
    "texts": """
def f():
    x = '''
def not_a_function():
    if a:
''' + \"\"\"
# not a comment ''' \"\"\"
    y = "quote \\" # inside" # real comment with ' and \"\"\"
    return x, y

def g(a, b="):(", c=')'):
    r'''raw doc'''
    if (a and
        b or
            c):
        return [
1, 2,
        ]
    z = a + \\
b
    return z

def h():
    f"not {1} a doc"
    if a: return 1
    elif b:
        return 2
    elif c:
        if d:
            return 3
    else:
        if e:
            return 4
        for q in e:
            pass
        else:
            if last:
                pass
""",
    "matches": '''
def route(cmd):
    match = 1
    match cmd:
        case "a":
            def in_case():
                return match
        case _:
            if match:
                pass
def tail(
    a,
): return a
''',
    "none": "x = 1\n",
    "windows": "def a():\r\n    return 1\r\n\r\ndef b():\r\n    pass\r\n",
}


class Nesting(ast.NodeVisitor):
    def __init__(self):
        self.depth = self.deepest = self.line = 0

    def nested(self, node):
        self.depth += 1
        if self.depth > self.deepest:
            self.deepest, self.line = self.depth, node.lineno
        self.generic_visit(node)
        self.depth -= 1

    visit_If = visit_For = visit_While = visit_With = visit_Try = nested


def expected(source):
    source = source.replace("\r\n", "\n")
    lines, rows = source.split("\n"), []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a, seen = node.args, Nesting()
            seen.visit(node)
            rows.append((
                node.name, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1:node.end_lineno]),
                len(a.args) + len(a.posonlyargs) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg),
                ast.get_docstring(node, clean=False) is not None, seen.deepest, seen.line,
            ))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, i, name, "python", source) for i, (name, source) in enumerate(SOURCES.items())]
    parsed = spark.createDataFrame(rows, "review_id BIGINT, file_ord INT, filename STRING, language STRING, content STRING")
    found = units.blocks(parsed).cache()
    return found.collect(), units.maintainability(found).collect()


@pytest.mark.parametrize("name", SOURCES)
def test_functions_equal_the_syntax_tree(found, name):
    rows = sorted((r for r in found[0] if r.filename == name and r.kind == "def"), key=lambda r: r.unit_ord)
    got = [(r.name, r.start_line, r.end_line, r.source, r.params, r.has_docstring, r.nesting_depth, r.nesting_line) for r in rows]
    assert got == expected(SOURCES[name])


def test_index_stays_in_range(found):
    assert {r.filename for r in found[1]} == set(SOURCES)
    assert all(0 <= r.mi <= 100 for r in found[1])


def test_one_shuffle_of_the_sources(spark):
    """The line table and the texts share one placement of the files; nothing else is moved."""
    rows = [(1, i, f"{i}.py", "python", "def a():\n    pass\n" * 50) for i in range(50)]
    parsed = spark.createDataFrame(rows, "review_id BIGINT, file_ord INT, filename STRING, language STRING, content STRING")
    found = units.blocks(parsed)
    assert len(found.collect()) == 50 * 51
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len([line for line in moved if "ReusedExchange" not in line]) == 1
    assert len([line for line in moved if "ReusedExchange" in line]) == 1


def test_complexity_of_functions_and_classes(spark):
    source = '''
class A:
    def f(self, x):
        if x and x > 1 or x < 0:
            return [y for y in x if y]
        for z in x:
            pass
        else:
            z = 1
        return 1 if x else 2

    def g(self):
        try:
            pass
        except E:
            def inner():
                while True:
                    assert x
'''
    parsed = spark.createDataFrame([(1, 1, "a.py", "python", source)],
                                   "review_id BIGINT, file_ord INT, filename STRING, language STRING, content STRING")
    rows = {r.name: r.complexity for r in units.complexity(units.blocks(parsed)).collect()}
    # f: 1 + if, and, or, for, if, for, for-else, ternary if = 9; g: 1 + except, and inner: 1 + while, assert = 5
    assert rows == {"f": 9, "g": 5, "A": (9 + 5 + 1) // 2 + 1}


def test_parameters_in_brackets_of_any_depth(spark):
    deep = "(" * 10 + "1, 2" + ",)" * 10
    signatures = ["def f()", "def f(a)", "def f(a, b=[1, {2: (3, 4)}], *, c: Dict[str, int]=None) -> Tuple[int, str]", f"def f(a, b={deep}, c=1)",
                  "def f[T, U](a: T, /, b: U)", "def f(key=lambda a: a, *rest, **more)", "class A"]
    rows = spark.createDataFrame([(s,) for s in signatures], "s string").select(units._parameters(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 1, 3, 3, 2, 3, 0]


def test_tasks_sort_no_more_however_much_source_there_is(spark, monkeypatch):
    """The number of partitions follows the size of the sources, whatever the number of shuffle partitions is; results stay."""
    rows = [(i, 0, "a.py", "python", f"def f{i}(a):\n    return '''\n" + "word [ \" # line\n" * 60 + "'''\n") for i in range(128)]
    parsed = spark.createDataFrame(rows, "review_id bigint, file_ord int, filename string, language string, content string")
    want = sorted(map(str, units.blocks(parsed).collect()))
    counts = []
    for part in (4 << 10, 1 << 10):
        monkeypatch.setattr(units, "PART_BYTES", part)
        counts.append(units.python_sources(parsed).rdd.getNumPartitions())
        assert sorted(map(str, units.blocks(parsed).collect())) == want
    size = sum(len(r[4]) for r in rows)
    assert counts == [-(-size // (4 << 10)), -(-size // (1 << 10))]
    assert units.python_sources(parsed.limit(0)).count() == 0


def test_masking_is_the_one_of_the_pieces(spark):
    """Against Python's reading of the same pattern, with quotes of all kinds, breaks, escapes and texts that stay open."""
    import random
    import re

    from diffsieve.functions.masking import INSIDE, PIECES, masked_source

    rng = random.Random(4)
    texts = ["".join(rng.choices(['"', "'", '"""', "'''", "#", "\n", "a b", "\\", "é😀", "\r", "("], k=rng.randrange(40))) for _ in range(800)]

    def masked(text):
        out = []
        for piece in re.findall(PIECES, re.sub(r"\\[^\n]", "__", text)):
            if piece.startswith(('"""', "'''")):
                piece = ("\n" + INSIDE) * piece.count("\n")
            elif piece[0] in "\"'#":
                piece = ""
            out.append(piece)
        return "".join(out)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in rows.select("i", masked_source(F.col("t")).alias("m")).collect()}
    assert got == {i: masked(t) for i, t in enumerate(texts)}
