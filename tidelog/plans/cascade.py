"""Which levels to merge: pure arithmetic over the number of runs in each level."""

from __future__ import annotations


def due(counts: list[int], fanout: int) -> int | None:
    """The level that the runs of all shallower levels must merge into, or None.

    Level 0 is due when it holds fanout runs.  A level that one more run would make full passes the merge on.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    if not counts or counts[0] < fanout:
        return None
    target = 1
    while target < len(counts) and counts[target] == fanout - 1:
        target += 1
    return target


def after_merge(counts: list[int], target: int) -> list[int]:
    grown = counts + [0] * (target + 1 - len(counts))
    return [0] * target + [grown[target] + 1] + grown[target + 1 :]


def layout(flushes: int, fanout: int) -> list[int]:
    """Runs in each level after so many flushes: the digits of flushes in base fanout, lowest first."""
    counts = [0]
    for _ in range(flushes):
        counts[0] += 1
        if (target := due(counts, fanout)) is not None:
            counts = after_merge(counts, target)
    return counts


def capacity(limit: int, fanout: int, level: int) -> int:
    """Distinct keys that a run of the level can hold."""
    return limit * fanout**level
