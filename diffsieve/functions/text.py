"""Text expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(value: Column) -> Column:
    """`_` and `-` become spaces; the first letter of every run of letters is raised, the others lowered."""
    runs = F.regexp_extract_all(F.translate(value, "_-", "  "), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def last_part(value: Column, separator: str) -> Column:
    """Text after the last separator."""
    return F.substring_index(value, separator, -1)


def prefix(value: Column, n: int) -> Column:
    """First n characters."""
    return F.substring(value, 1, n)


def window_around_line(content: Column, line: Column) -> Column:
    """Characters from max(0, 40*line-200) up to 40*line+200."""
    start = F.greatest(F.lit(0), line * 40 - 200)
    return F.substring(content, start + 1, F.greatest(F.lit(0), line * 40 + 200 - start))


def percent(value: Column) -> Column:
    """Whole percent, half to even: 0.125 -> 12%."""
    return F.call_function("format_number", value, F.lit("0%"))


def short_id(*parts: Column) -> Column:
    """Eight hexadecimal digits that depend only on the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)


def pr_number(url: Column) -> Column:
    """Last path part of a change URL, as a number; null if it is none."""
    return F.try_element_at(_url_parts(url), F.lit(-1)).try_cast("int")


def pr_repository(url: Column) -> Column:
    """``owner/repo`` of a change URL."""
    parts = _url_parts(url)
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-4)), F.try_element_at(parts, F.lit(-3)))


def unix_lines(content: Column) -> Column:
    """Text with plain line ends; the pattern only runs on texts that need it."""
    return F.when(F.contains(content, F.lit("\r")), F.regexp_replace(content, "\r\n?", "\n")).otherwise(content)


def _url_parts(url: Column) -> Column:
    return F.split(F.regexp_replace(url, "/+$", ""), "/")


def dedent_strip(value: Column) -> Column:
    """Remove the common indentation of all non-blank lines, trim, and end with one newline."""
    lines = F.transform(F.split(value, "\n"), lambda x: F.when(x.rlike(r"^[ \t]*$"), F.lit("")).otherwise(x))
    indents = F.transform(
        F.filter(lines, lambda x: x != ""), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))
    )
    margin = F.coalesce(F.array_min(indents), F.lit(0))
    cut = F.transform(lines, lambda x: F.when(x == "", x).otherwise(x.substr(margin + 1, F.length(x))))
    return F.concat(F.regexp_replace(F.array_join(cut, "\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def tokens(text: Column, n: int) -> Column:
    """The first n words of a text."""
    return F.slice(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""), 1, n)
