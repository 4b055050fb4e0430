"""Schemas and the key range."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: value NULL = deletion.
CHANGE_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
STATE = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])


@dataclass(frozen=True)
class KeyRange:
    """Optional bounds (None: unbounded), each with its own inclusive flag, ignored where the bound is absent.

    An inverted range is empty; equal bounds hold that one key if both flags are inclusive.
    """

    lower: Any = None
    upper: Any = None
    include_lower: bool = True
    include_upper: bool = True

    def predicate(self, key: Column) -> Column:
        """A predicate that Catalyst pushes into the scan."""
        out = F.lit(True)
        if self.lower is not None:
            low = F.lit(self.lower)
            out = (key >= low) if self.include_lower else (key > low)
        if self.upper is not None:
            high = F.lit(self.upper)
            top = (key <= high) if self.include_upper else (key < high)
            out = top if self.lower is None else out & top
        return out

    def literal(self) -> KeyRange:
        """With byte bounds as Spark's literals take them."""
        bounds = (bytearray(x) if isinstance(x, bytes) else x for x in (self.lower, self.upper))
        return KeyRange(*bounds, self.include_lower, self.include_upper)

    def overlaps(self, low: Any, high: Any) -> bool:
        """Whether a run whose keys span low..high can hold a key of this range (None: unknown)."""
        if self.lower is not None and high is not None and (high < self.lower or high == self.lower and not self.include_lower):
            return False
        return not (self.upper is not None and low is not None and (low > self.upper or low == self.upper and not self.include_upper))

    @staticmethod
    def prefix(p: bytes | str) -> KeyRange:
        """All keys that start with p; of a text, up to its last character's successor."""
        if isinstance(p, str):
            stem = p.rstrip(chr(0x10FFFF))
            after = ord(stem[-1]) + 1 if stem else 0
            return KeyRange(p, stem[:-1] + chr(0xE000 if after == 0xD800 else after) if stem else None, True, False)
        stem = p.rstrip(b"\xff")
        return KeyRange(p, stem[:-1] + bytes([stem[-1] + 1]) if stem else None, True, False)
