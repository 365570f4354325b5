"""Burrows-Wheeler transforms of shards, merged by interleave refinement.

A collection of strings is cut into shards. A symbol is the `step` bytes at a place
(named by a 64-bit hash), so that one round of refinement deepens the order by `step`
bytes. A shard is sorted once, by symbol names: that gives its alphabet and, by place,
the numbers of its symbols; the symbol before a suffix is its transform.

Merging starts with the shards' suffixes as they stand, one shard after the other, and
one alphabet merged from the shards' sorted ones. A round walks the interleave, takes
for each suffix the symbol before it, and deals the suffixes that begin there into the
symbols' buckets, whose places are counted (16 bits of a symbol's number at a time).
Dealing is stable, so after r rounds the interleave is in order by the first r symbols.
Suffixes that the rounds can't lengthen to `depth` bytes within their string are left out
from the start. Suffixes are never compared or sorted again. Those with equal symbols stay
in the order in which their strings came.

The common prefix of neighbours, in symbols, follows from the numbers of their symbols.
Suffixes in a row with common prefixes of `depth` bytes or more are the intervals of
repeated strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels as K


@dataclass
class Shard:
    alphabet: np.ndarray  # names of its symbols, ascending
    symbols: np.ndarray  # by place: number of the symbol that begins there, -1 where the string ends before
    windows: np.ndarray  # places where depth bytes of a string begin


def build(text: np.ndarray, off: np.ndarray, depth: int, step: int) -> Shard:
    """text: strings one after the other, off: where each begins, and the end."""
    symbols = np.full(len(text), -1, np.int32)
    names = K.rolling_hash(text, step)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(text))  # bytes to the string's end
    places = np.flatnonzero(left[: len(names)] >= step)
    windows = np.flatnonzero(left >= depth)
    if not len(places):
        return Shard(np.zeros(0, np.uint64), symbols, windows)
    names = names[places]
    by = np.argsort(names)
    ordered = names[by]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    symbols[places[by]] = np.cumsum(new) - 1
    return Shard(ordered[new], symbols, windows)


def dealt(symbols: np.ndarray, kinds: int) -> np.ndarray:
    """The stable order of symbol numbers below `kinds`, by counting digits of 16 bits."""
    by = np.argsort(symbols.astype(np.uint16), kind="stable")  # of 16 bits: numpy counts
    if kinds > 1 << 16:
        by = by[np.argsort((symbols >> 16).astype(np.uint16)[by], kind="stable")]
    return by


def merge(shards: list[Shard], depth: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of at least `depth` bytes, as places in the shards' texts laid one
    after the other, in order by their first `depth` bytes; and the symbols that each has
    in common with the one before (0 for the first)."""
    alphabet = np.sort(np.concatenate([s.alphabet for s in shards]))
    alphabet = alphabet[np.r_[True, alphabet[1:] != alphabet[:-1]]] if len(alphabet) else alphabet
    symbols = np.concatenate([np.searchsorted(alphabet, s.alphabet).astype(np.int32)[s.symbols] if len(s.alphabet) else s.symbols for s in shards])  # -1 takes any number and is never asked for
    base = np.cumsum([0, *[len(s.symbols) for s in shards]])
    order = np.concatenate([s.windows + b for s, b in zip(shards, base)]) + depth  # behind the last symbols
    for _ in range(depth // step):
        order -= step
        order = order[dealt(symbols[order], len(alphabet))]
    common, alike = np.zeros(len(order), np.int8), np.ones(max(0, len(order) - 1), bool)
    for k in range(0, depth, step):
        own = symbols[order + k]
        alike &= own[1:] == own[:-1]
        common[1:] += alike
    return order, common


def repeated_windows(text: np.ndarray, off: np.ndarray, depth: int, step: int = 25, shards: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of `depth` bytes of the strings (text, off), sorted, equal
    ones in the order of the strings; and whether each begins an interval of equal ones."""
    cut = np.unique(np.searchsorted(off, np.linspace(0, off[-1], shards + 1)))
    parts = [build(text[off[i] : off[j]], off[i : j + 1] - off[i], depth, step) for i, j in zip(cut[:-1], cut[1:])]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order, common = merge(parts, depth, step)
    return order, common < depth // step
