"""Byte keys whose unsigned order is the order of what they encode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_unsigned(c: Column) -> Column:
    """A BIGINT of 0 or more as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))


def encode_signed(c: Column) -> Column:
    """Any BIGINT: the sign bit is flipped, so that negative numbers come first."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def encode_text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def no_empty(c: Column) -> Column:
    """The byte API's rule: an empty value is a deletion."""
    return F.when(F.length(c) > 0, c)
