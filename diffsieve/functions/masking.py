"""Masking of string literals and comments in source text, without moving a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leftmost piece first: triple-quoted text, one-line strings, comments, anything else.
PIECES = (
    r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + r'"[^"\n]*"|' + r"'[^'\n]*'|" + r"#[^\n]*|" + r"""[^"'#]+|["'#]"""
)
# The same pieces, read faster: one class that holds every character.
_READ = PIECES.replace(r"[\s\S]", "(?s:.)")
# Marks a line that starts inside a triple-quoted text.
INSIDE = "\u0001"


def masked_source(content: Column) -> Column:
    """Source without strings and comments, line for line.

    Escaped characters are blanked first, so that every piece is a run of plain characters and the pattern
    needs no nested repetition (which could exhaust the stack on very long lines).
    """
    escapes = F.contains(content, F.lit("\\"))
    plain = F.when(escapes, F.regexp_replace(content, r"\\[^\n]", "__")).otherwise(content)

    def mask(piece: Column) -> Column:
        breaks = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        emptied = F.repeat(F.lit("\n" + INSIDE), breaks)
        return (
            F.when(piece.startswith('"""') | piece.startswith("'''"), emptied)
            .when(piece.startswith('"') | piece.startswith("'") | piece.startswith("#"), F.lit(""))
            .otherwise(piece)
        )

    return F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(_READ), F.lit(0)), mask), "")
