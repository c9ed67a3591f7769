"""Numbers and addresses out of bytes.

Neighbouring fields are read together as one number of a few bytes and taken apart by shifts: each
conversion from text costs more code than a field is worth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(head: str, offset: int | Column, size: int) -> Column:
    """Big-endian number of ``size`` bytes (7 at most) at a byte offset (0-based) of the hex text; bytes
    past the end of the text count as zero."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    text = F.rpad(F.substr(F.col(head), at * 2 + 1, F.lit(2 * size)), 2 * size, "0")
    return F.conv(text, 16, 10).cast("bigint")


def field(number: str | Column, bits_below: int, width: int) -> Column:
    """``width`` bits of a number, above the lowest ``bits_below``."""
    return F.shiftright(number, bits_below).bitwiseAND(F.lit((1 << width) - 1))


def dotted_quad(number: str | Column) -> Column:
    """A number of four bytes as dotted-quad text."""
    return F.concat_ws(".", *[field(number, 8 * i, 8).cast("string") for i in (3, 2, 1, 0)])
