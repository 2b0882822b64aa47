"""Reading answers that come from outside (batch answers of a language model, kept in a table)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(answer: Column) -> Column:
    """Trim; drop a leading fence line and everything from the last fence on. Null if there is no body."""
    text = F.regexp_replace(answer, r"^\s+|\s+$", "")
    newline = F.instr(text, "\n")
    body = F.when(newline > 0, text.substr(newline + 1, F.length(text)))
    cut = F.when(F.contains(body, F.lit("```")), F.regexp_extract(body, "(?s)^(.*)```", 1)).otherwise(body)
    return F.when(text.startswith("```"), cut).otherwise(text)


def parse_answer(answer: Column, schema: str) -> Column:
    """The answer as a struct, or null if it is not valid JSON (the caller's fallback then applies)."""
    parsed = F.from_json(
        unfenced(answer), schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}
    )
    usable = unfenced(answer).rlike(r"\S") & parsed["_bad"].isNull()
    return F.when(usable, parsed)


def truthy(value: Column) -> Column:
    """Whether a JSON value, read as text, counts as true."""
    return F.coalesce(~value.isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))


def entry_or_default(entry: Column, key: str, default: str) -> Column:
    """The entry's value; the default only if the key is absent (an explicit null stays null)."""
    return F.when(F.map_contains_key(entry, key), entry[key]).otherwise(F.lit(default))
