"""Function units and their metrics, from the indentation structure of a line table.

Files are placed by file once, before their lines are made. Every later step works on keys that begin with the
file's, so the whole extraction costs one shuffle of the sources, and a huge review is spread
over the cluster file by file. Texts stay with the file; the line table carries only numbers and flags, and a
unit's text is cut out of its file in the end.

The idea: for an indentation level d of a file, every code line with an indentation of at most d starts a new
*block*. A block whose first line is a ``def`` at exactly d is a function unit; it holds all its lines. So units,
their ends, bodies and metrics come from one running count per level and one aggregation, without comparing
lines with each other. The file as a whole is one more block, at level -1, so file metrics fall out as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masking import INSIDE, masked_source
from ..functions.text import unix_lines

FILE = ["review_id", "file_ord", "filename"]
WHOLE_FILE = -1
# Bytes of source that share a partition, about.
PART_BYTES = 4 << 20

_HEAD = r"^[ \t]*((?:async[ \t]+)?(?:def|for|with)|class|if|elif|else|while|try|except|finally)\b"
_CASE = r"^[ \t]*(match|case)\b[^=]*:[ \t]*$"
_CONTINUES = ["elif", "else", "except", "finally"]
_NESTING = ["if", "for", "while", "with", "try"]
_DECISIONS = r"\b(if|elif|for|while|and|or|except|assert|def)\b"
_LOOPS_AND_TRY = ["for", "while", "try", "async for"]


def python_sources(parsed: DataFrame) -> DataFrame:
    """Python files with their source and its masked form (strings and comments removed), placed by file.

    The number of partitions follows the size of the sources, so that what a task sorts does not grow with the input.
    """
    files = parsed.filter((F.col("language") == "python") & (F.col("content") != ""))
    size = files.agg(F.sum(F.octet_length("content")).alias("n")).first()["n"] or 0
    source = files.select(*FILE, unix_lines(F.col("content")).alias("content"))
    parts = max(-(-size // PART_BYTES), parsed.sparkSession.sparkContext.defaultParallelism, 2)
    return source.withColumn("masked", masked_source(F.col("content"))).repartition(parts, *FILE)


def code_lines(sources: DataFrame) -> DataFrame:
    """Lines with indentation, block keyword and counts.

    `skip` marks lines that cannot open or close a block: blank lines, comments, text inside a triple-quoted
    string, and lines that continue an open bracket or a trailing backslash.
    """
    pairs = F.arrays_zip(F.split("content", "\n").alias("text"), F.split("masked", "\n").alias("masked"))
    lines = sources.select(*FILE, F.posexplode(pairs).alias("pos", "l"))
    text, masked = F.col("l.text"), F.col("l.masked")
    inside = F.startswith(masked, F.lit(INSIDE))
    lines = lines.select(
        *FILE,
        (F.col("pos") + 1).alias("line"),
        inside.alias("inside"),
        (~text.rlike(r"\S")).alias("blank"),
        (text.rlike(r"^[ \t]*#") & ~inside).alias("comment"),
        F.length(F.regexp_extract(text, r"^[ \t]*", 0)).alias("indent"),
        (F.length(F.translate(masked, ")]}", "")) - F.length(F.translate(masked, "([{", ""))).alias("brackets"),
        masked.rlike(r"\\[ \t]*$").alias("backslash"),
        F.size(F.regexp_extract_all(masked, F.lit(_DECISIONS), F.lit(0))).alias("decisions"),
        F.when(masked.rlike(_HEAD), F.regexp_replace(F.regexp_extract(masked, _HEAD, 1), "[ \t]+", " "))
        .when(masked.rlike(_CASE), F.regexp_extract(masked, _CASE, 1)).alias("word"),
    )
    by_file = Window.partitionBy(*FILE).orderBy("line")
    open_before = F.sum("brackets").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    continued = (F.coalesce(open_before, F.lit(0)) > 0) | F.coalesce(F.lag("backslash").over(by_file), F.lit(False))
    lines = lines.withColumns({
        "continued": continued,
        "closes_text": F.col("inside") & ~F.coalesce(F.lead("inside").over(by_file), F.lit(False)),
    })
    lines = lines.withColumn("skip", F.col("blank") | F.col("comment") | F.col("inside") | F.col("continued"))
    return lines.withColumn("word", F.when(~F.col("skip"), F.col("word"))).drop("brackets", "backslash")


def _leveled(lines: DataFrame) -> DataFrame:
    """Lines once per indentation level at which their file opens a block, with their block at that level.

    Lines that neither open, close, extend nor count (blank, comment, inner lines of a long string) are left out.
    """
    file = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = F.collect_set(F.when(F.col("word").isNotNull(), F.col("indent"))).over(file)
    idle = F.col("blank") | F.col("comment") | (F.col("inside") & ~F.col("closes_text"))
    rows = lines.withColumns({
        "levels": levels,
        "statements": F.count_if(~F.col("skip")).over(file),
        "sloc": F.count_if(~F.col("blank") & ~F.col("comment")).over(file),
        "comments": F.count_if(F.col("comment") | F.col("inside")).over(file),
    })
    # The first line always stays, so that every file has a row.
    rows = rows.filter(~idle | F.col("continued") | (F.col("line") == 1))
    rows = rows.withColumn("level", F.explode(F.array_union(F.array(F.lit(WHOLE_FILE)), "levels"))).drop("levels")

    # Everything below runs over one sort: by level, then by line.
    by_level = Window.partitionBy(*FILE, "level").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at_level = ~F.col("skip") & (F.col("indent") == F.col("level"))
    word = F.coalesce("word", F.lit(""))
    starts_block = ~F.col("skip") & (F.col("indent") <= F.col("level"))
    starts_chain = starts_block & ~(at_level & word.isin(_CONTINUES))
    own_word = F.when(at_level, word).otherwise(F.lit(""))
    carried = lambda condition, value: F.last(F.when(condition, value), ignorenulls=True).over(by_level)
    rows = rows.withColumns({
        "own": at_level & F.col("word").isNotNull(),
        "block_line": F.when(F.col("level") == WHOLE_FILE, 1).otherwise(carried(starts_block, F.col("line"))),
        "block_word": F.when(F.col("level") == WHOLE_FILE, "file").otherwise(carried(starts_block, own_word)),
        "chain_word": F.coalesce(carried(starts_chain, own_word), F.lit("")),
        "_elifs": F.sum(F.when(at_level & (word == "elif"), 1).otherwise(0)).over(by_level),
    })
    return rows.withColumn("elifs", F.col("_elifs") - F.coalesce(carried(starts_chain, F.col("_elifs")), F.lit(0))).drop("_elifs")


def _with_depths(rows: DataFrame) -> DataFrame:
    """Adds, per line and level, the nesting below that level, and per line its depth in the syntax tree."""
    inner = F.col("indent") > F.col("level")
    own_word = F.when(F.col("own"), F.col("word")).otherwise(F.lit(""))
    nests = F.col("chain_word").isin(_NESTING)
    nesting = (
        F.when((inner & nests) | (own_word == "elif"), 1 + F.col("elifs"))
        .when(own_word.isin(_NESTING), 1)
        .otherwise(0)
    )
    tree = (
        F.when(~inner | (F.col("chain_word") == ""), 0)
        .when(F.col("block_word") == "except", 2)
        .when(F.col("chain_word") == "if", 1 + F.col("elifs"))
        .otherwise(1)
    )
    enclosing_def = F.when(inner & F.col("block_word").isin("def", "async def"), 1).otherwise(0)
    ends_loop = F.when((own_word == "else") & F.col("chain_word").isin(_LOOPS_AND_TRY), 1).otherwise(0)
    # One sort again: by line, from the innermost level outwards.
    outwards = Window.partitionBy(*FILE, "line").orderBy(F.desc("level"))
    so_far = outwards.rowsBetween(Window.unboundedPreceding, 0)
    nearer = outwards.rowsBetween(Window.unboundedPreceding, -1)
    whole = outwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({
        "nesting": F.sum(nesting).over(so_far),
        "tree_depth": F.sum(tree).over(whole),
        "defs_above": F.sum(enclosing_def).over(whole),
        "defs_between": F.coalesce(F.sum(enclosing_def).over(nearer), F.lit(0)),
        "loop_else": F.max(ends_loop).over(whole),
    })


_PLACE = 1 << 32
_FILE_COUNTS = ["statements", "sloc", "comments"]


def block_spans(sources: DataFrame) -> DataFrame:
    """Functions, classes and files with first line, last line, first body line and counts; no texts."""
    rows = _with_depths(_leveled(code_lines(sources)))
    rows = rows.filter(F.col("block_word").isin("def", "async def", "class", "file"))
    line, start = F.col("line"), F.col("line") == F.col("block_line")
    after = ~start
    word = F.coalesce("word", F.lit(""))
    is_def = word.isin("def", "async def")
    is_nested = after & (F.col("indent") > F.col("level")) & (word.isin(_NESTING) | (word == "elif"))
    # Deepest first, and of equally deep lines the first: depth and line share one number.
    deepest = F.max(F.when(is_nested, F.col("nesting") * _PLACE + (_PLACE - 1 - line)))
    spans = rows.groupBy(*FILE, "level", F.col("block_line").alias("start_line"), "block_word").agg(
        F.max(F.when(~F.col("blank") & ~F.col("comment"), line)).alias("end_line"),
        F.max("line").alias("_last"),
        F.min(F.when(after & ~F.col("continued"), line)).alias("_body"),
        F.max(F.when(start, F.col("tree_depth"))).alias("tree_depth"),
        F.max(F.when(start, F.col("defs_above"))).alias("defs_above"),
        deepest.alias("_deepest"),
        F.sum("decisions").alias("decisions"),
        F.sum("loop_else").alias("loop_elses"),
        *[F.max(c).alias(c) for c in _FILE_COUNTS],
        F.count_if(after & is_def & (F.col("defs_between") == 0)).alias("methods"),
    )
    return spans.select(
        *FILE,
        F.when(F.col("block_word").isin("class", "file"), F.col("block_word")).otherwise(F.lit("def")).alias("kind"),
        "start_line", "end_line",
        F.coalesce("_body", F.col("_last") + 1).alias("body_line"),
        "tree_depth", "defs_above",
        F.coalesce(F.expr(f"cast(_deepest div {_PLACE} as int)"), F.lit(0)).alias("nesting_depth"),
        F.coalesce((_PLACE - 1 - F.col("_deepest") % _PLACE).cast("int"), F.lit(0)).alias("nesting_line"),
        "decisions", "loop_elses", "methods", *_FILE_COUNTS,
    )


def blocks(parsed: DataFrame) -> DataFrame:
    """All functions and classes with span, text and metrics, and one row per file (kind `file`) without text.

    `unit_ord` numbers a file's functions: they are numbered breadth-first: by depth in the syntax tree, then by line. Spans meet their file's text
    in a join whose sides are already placed by file.
    """
    sources = python_sources(parsed)
    texts = sources.select(
        *FILE, "masked", F.split("content", "\n").alias("texts"), F.split("masked", "\n").alias("codes")
    )
    joined = block_spans(sources).join(texts, FILE)
    start = F.col("start_line")
    text = F.array_join(F.slice("texts", start, F.col("end_line") - start + 1), "\n")
    signature = F.array_join(F.slice("codes", start, F.col("body_line") - start), " ")
    is_file = F.col("kind") == "file"
    name = F.regexp_extract(signature, r"(?:def|class)[ \t]+(\w+)", 1)
    operators, operands = _tokens(_OPERATOR), F.filter(_tokens(_OPERAND), lambda t: ~t.isin(_KEYWORDS))
    result = joined.select(
        *FILE,
        "kind",
        F.when(is_file, F.lit("")).otherwise(name).alias("name"),
        "start_line",
        "end_line",
        F.when(~is_file, text).alias("source"),
        "tree_depth",
        "defs_above",
        _parameters(signature).alias("params"),
        _has_docstring().alias("has_docstring"),
        "nesting_depth",
        "nesting_line",
        "decisions",
        "loop_elses",
        "methods",
        *_FILE_COUNTS,
        F.when(is_file, operators).alias("operators"),
        F.when(is_file, operands).alias("operands"),
    ).withColumns({
        "n_tokens": F.size("operators") + F.size("operands"),
        "n_distinct": F.size(F.array_distinct("operators")) + F.size(F.array_distinct("operands")),
    }).drop("operators", "operands")
    order = Window.partitionBy(*FILE, "kind").orderBy("tree_depth", "start_line")
    return result.withColumn("unit_ord", F.row_number().over(order))


def _parameters(signature: Column) -> Column:
    """Number of parameters; a bare `*` and `/` are none."""
    pieces = F.regexp_extract_all(F.regexp_extract(signature, r"^[^(]*\((.*)$", 1), F.lit(r"[()\[\]{}]|[^()\[\]{}]+"), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        """Keeps what stands directly inside the outer bracket; depth -1 is behind it."""
        depth = state["depth"]
        change = F.when((depth < 0), 0).when(piece.isin("(", "[", "{"), 1).when(piece.isin(")", "]", "}"), -1).otherwise(0)
        text = F.when((depth == 0) & (change == 0), F.concat(state["kept"], piece)).otherwise(state["kept"])
        return F.struct((depth + change).alias("depth"), text.alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))
    inner = F.regexp_replace(F.aggregate(pieces, start, step)["kept"], r"lambda[^:]*:", "")
    parts = F.transform(F.split(inner, ","), lambda p: F.trim(p))
    return F.size(F.filter(parts, lambda p: ~p.isin("", "*", "/")))


def _has_docstring() -> Column:
    """Whether the first statement of the body is nothing but a string literal."""
    # Blank and comment lines may stand before the first statement.
    size = F.greatest(F.col("end_line") - F.col("body_line") + 1, F.lit(0))
    own = lambda name: F.slice(name, F.col("body_line"), size)  # cut first: a file may have many blocks
    body = F.zip_with(own("texts"), own("codes"), lambda text, code: F.struct(text.alias("texts"), code.alias("codes")))
    first = F.get(F.filter(body, lambda x: x["texts"].rlike(r"^[ \t]*[^# \t\n]")), F.lit(0))
    literal = first["texts"].rlike(r"^[ \t]*[rRuU]?[\"']") & F.trim(first["codes"]).isin("", "r", "R", "u", "U")
    last = F.col("body_line") - 2
    one_line = F.get("codes", last).rlike(r":[ \t]*$") & F.get("texts", last).rlike(r"[\"'][ \t]*$")
    return F.coalesce(literal, F.lit(False)) | F.coalesce(one_line, F.lit(False))


def functions_of(all_blocks: DataFrame) -> DataFrame:
    """The function units (methods and nested functions included)."""
    return all_blocks.filter(F.col("kind") == "def").drop("kind", *_FILE_COUNTS, "n_tokens", "n_distinct")


def extract_functions(parsed: DataFrame) -> DataFrame:
    """`code_units`: every function with its number in the file, first and last line, and text."""
    return functions_of(blocks(parsed)).select(*FILE, "unit_ord", "name", "start_line", "end_line", "source")


def function_length(units: DataFrame) -> DataFrame:
    return units.withColumn("n_lines", F.col("end_line") - F.col("start_line") + 1)


def complexity(all_blocks: DataFrame) -> DataFrame:
    """Cyclomatic complexity of top-level functions, methods and classes.

    1 + decisions; a function nested in another adds its own complexity to the outer one. A class has the mean
    of its methods, plus one if there are several.
    """
    decisions = F.col("decisions") + F.col("loop_elses")
    own = F.when(F.col("kind") == "def", decisions).otherwise(decisions + 1)
    mean = F.floor(own / F.col("methods")).cast("bigint") + F.when(F.col("methods") > 1, 1).otherwise(0)
    value = F.when((F.col("kind") == "class") & (F.col("methods") > 0), mean).otherwise(own)
    outer = all_blocks.filter((F.col("kind") != "file") & (F.col("defs_above") == 0))
    return outer.withColumn("complexity", value.cast("bigint"))


_OPERATOR = r"\*\*=?|//=?|<<=?|>>=?|[-+*/%@&|^<>=!]=|[-+*/%@&|^<>~]|\b(?:and|or|not|in|is)\b"
_OPERAND = r"\b(?:[A-Za-z_]\w*|[0-9][\w.]*)"
_KEYWORDS = (
    "and or not in is if elif else for while def class return import from as with try except finally raise pass "
    "break continue lambda yield async await global nonlocal del assert"
).split()


def _tokens(pattern: str) -> Column:
    return F.regexp_extract_all("masked", F.lit(pattern), F.lit(0))


def maintainability(all_blocks: DataFrame) -> DataFrame:
    """Maintainability index (0-100) per Python file: the published formula on token and line counts."""
    files = all_blocks.filter(F.col("kind") == "file").withColumn("complexity", F.col("decisions") + 1)
    volume = F.col("n_tokens") * F.log2("n_distinct")
    share = F.least(F.col("comments") / F.col("sloc"), F.lit(1.0)) * 100
    raw = (
        171 - 5.2 * F.ln(volume) - 0.23 * F.col("complexity") - 16.2 * F.ln("statements")
        + 50 * F.sin(F.sqrt(2.4 * F.radians(share)))
    )
    scaled = F.least(F.greatest(raw * 100 / 171, F.lit(0.0)), F.lit(100.0))
    index = F.when((F.col("n_tokens") == 0) | (volume <= 0) | (F.col("statements") <= 0), F.lit(100.0)).otherwise(scaled)
    return files.select(*FILE, "complexity", "statements", "sloc", "comments", index.alias("mi"))
