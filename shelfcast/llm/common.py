"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words are runs of all but space and tab to carriage return.
WORD_RX = r"[^\x20\x09-\x0D]+"


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def text_key(doc_id: str, text: str) -> Column:
    """A key of (doc_id, text), nulls told apart: rows that share it are equal
    in both, so that what is found for one holds for all."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(part(doc_id), F.lit(";"), part(text)).cast("binary"), 256)
