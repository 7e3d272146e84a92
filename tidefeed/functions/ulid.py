"""Time-ordered identifiers as column expressions.

An id is 26 Crockford base-32 characters: 10 of time (48 bits of epoch ms) and two halves of
8 (40 random bits each). Columns carry it as ``(ms, hi40, lo40)``; bigint is signed, so two
40-bit halves are safe where two 64-bit words would not be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefeed.functions.scalar import ColumnOrName, as_column

# ---- fixed values -----------------------------------------------------------------
# Crockford's alphabet leaves out I, L, O and U; conv() counts 0-9A-V straight on.
CONV_DIGITS = "IJKLMNOPQRSTUV"
CROCKFORD_DIGITS = "JKMNPQRSTVWXYZ"
# On reading, I and L stand for 1, O for 0; U is not a digit. Ten time characters hold 50
# bits, so the first one is at most 7.
WELL_FORMED = "^[0-7OoIiLl][0-9A-TV-Za-tv-z]{25}$"
ALPHABET = "^[0-9A-TV-Za-tv-z]*$"
TIME_LIMIT = 1 << 48
HALF = 1 << 40
# -----------------------------------------------------------------------------------


def encode32(value: ColumnOrName, width: int) -> Column:
    digits = F.conv(as_column(value).cast("string"), 10, 32)
    return F.lpad(F.translate(digits, CONV_DIGITS, CROCKFORD_DIGITS), width, "0")


def decode32(text: ColumnOrName) -> Column:
    """Value of up to 12 characters already known to be in the alphabet."""
    plain = F.translate(F.upper(as_column(text)), "ILO", "110")
    return F.conv(F.translate(plain, CROCKFORD_DIGITS, CONV_DIGITS), 32, 10).cast("bigint")


def ulid(ms: ColumnOrName, hi40: ColumnOrName, lo40: ColumnOrName) -> Column:
    """The id; null where the time does not fit 48 bits."""
    # The null enters with the time: inside a condition Spark would not share what the two
    # halves have in common.
    fits = F.when((as_column(ms) >= 0) & (as_column(ms) < TIME_LIMIT), as_column(ms))
    return F.concat(encode32(fits, 10), encode32(hi40, 8), encode32(lo40, 8))


def random_halves(*seed: Column) -> tuple[Column, Column]:
    """Two 40-bit numbers from a digest of the seed columns.

    The same row always gets the same id, so a recomputed task writes what the lost one did.
    """
    digest = F.md5(F.concat_ws("|", *[s.cast("string") for s in seed]))
    return (
        F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint"),
        F.conv(F.substring(digest, 11, 10), 16, 10).cast("bigint"),
    )


def problem(text: ColumnOrName) -> Column:
    """Why the text is not an id: 'null', 'length', 'character' or 'time'; '' when it is one."""
    text = as_column(text)
    return (
        F.when(text.isNull(), "null")
        .when(F.length(text) != 26, "length")
        .when(~text.rlike(ALPHABET), "character")
        .when(~text.rlike(WELL_FORMED), "time")
        .otherwise("")
    )


def parts(text: ColumnOrName) -> tuple[Column, Column, Column]:
    """(ms, hi40, lo40); all null for text that is not an id."""
    text = as_column(text)
    good = text.rlike(WELL_FORMED)
    return tuple(
        F.when(good, decode32(F.substring(text, at, n))) for at, n in ((1, 10), (11, 8), (19, 8))
    )


def canonical(text: ColumnOrName) -> Column:
    """Upper case with the look-alikes replaced, so that text order is id order."""
    return F.translate(F.upper(as_column(text)), "ILO", "110")


def to_bytes(ms: ColumnOrName, hi40: ColumnOrName, lo40: ColumnOrName) -> Column:
    """The 16-byte big-endian form."""
    def padded(value: ColumnOrName, digits: int) -> Column:
        return F.lpad(F.hex(as_column(value)), digits, "0")

    return F.unhex(F.concat(padded(ms, 12), padded(hi40, 10), padded(lo40, 10)))


def from_bytes(value: ColumnOrName) -> Column:
    """The id of a 16-byte big-endian value; null for any other length."""
    value = as_column(value)
    digits = F.hex(value)

    def number(at: int, n: int) -> Column:
        return F.conv(F.substring(digits, at, n), 16, 10).cast("bigint")

    return F.when(F.octet_length(value) == 16, ulid(number(1, 12), number(13, 10), number(23, 10)))
