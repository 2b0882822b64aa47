"""Checks of texts: syntax (needs Python, runs on Arrow batches) and signatures (stays in the JVM)."""

from __future__ import annotations

import ast
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


@F.pandas_udf(BooleanType())
def syntax_valid(text: pd.Series) -> pd.Series:
    """Whether a text parses as Python; an empty text does."""

    def parses(source) -> bool:
        try:
            ast.parse(source or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return text.map(parses).astype(bool)


BLOCK = 64


def signature_of(payload: Column, secret: str) -> Column:
    """``sha256=`` and the HMAC of a payload, inside the JVM: two nested digests with padded keys."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, payload.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, digest), 256))


def signature_valid(payload: Column, signature: Column, secret: str) -> Column:
    """Whether ``signature`` is the payload's; without a secret everything passes, a missing signature does not."""
    if not secret:
        return F.lit(True)
    return F.coalesce(signature == signature_of(payload, secret), F.lit(False))
