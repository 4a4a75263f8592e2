"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.registry import table
from weft.runtime import settle

__all__ = ["SPLIT", "WS", "ascii_lower", "held_out", "settle", "table", "words"]

#: Characters that separate words, as in [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of other characters than WS; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPLIT))


def held_out(id_: Column) -> Column:
    """Whether the remainder of crc32(id as text) by 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, nothing else changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
