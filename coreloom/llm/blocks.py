"""Choosing which blocks of a fingerprint to index."""

from __future__ import annotations

from itertools import combinations


def covering_sets(blocks: int, size: int, misses: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the ``blocks`` such that any ``misses`` blocks leave one set untouched.

    Two fingerprints that differ in at most ``misses`` blocks agree on all blocks of
    at least one set. Greedy: take the set that avoids most of the miss patterns left.
    """
    if size + misses > blocks:
        raise ValueError("no set of that size can avoid that many blocks")
    left = set(combinations(range(blocks), misses))
    every = list(combinations(range(blocks), size))
    chosen = []
    while left:
        best = max(every, key=lambda s: sum(not set(s) & set(m) for m in left))
        chosen.append(best)
        left = {m for m in left if set(m) & set(best)}
    return chosen


def bounds(blocks: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of each of ``blocks`` nearly equal blocks."""
    widths = [bits // blocks + (i < bits % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def signed(mask: int) -> int:
    """A 64-bit mask as the bigint literal Spark takes."""
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(chosen: tuple[int, ...], blocks: int) -> int:
    """The bits of the chosen blocks, as a signed 64-bit integer."""
    at = bounds(blocks)
    return signed(sum(((1 << at[b][1]) - 1) << at[b][0] for b in chosen))
