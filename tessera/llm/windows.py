"""Content-defined anchors for exact matching of fixed-length windows.

Symbols are bytes or words. A window is ``width`` consecutive symbols of one row. Every
window is assigned the smallest-hashing stretch of ``gram`` symbols inside it (the
leftmost of equals), its anchor, so the anchor depends on the window's content alone:
equal windows have equal anchors. Neighbouring windows mostly share one, so a row has
about 2 * length / (width - gram + 2) anchor entries instead of one per window, and a
window can only repeat where its anchor's stretch repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.llm import shared

_POSITION = np.uint64(28)
_LOW = np.uint64((1 << 28) - 1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbouring values (length n - w + 1)."""
    n = len(values)
    if n < w:
        return values[:0]
    padded = np.full(-(-n // w) * w, _TOP, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


#: Windows are found over so many symbols at a time, which bounds memory (some 80 bytes a
#: symbol) however long a text is. A run of windows may be cut there: the windows and
#: their anchors stay the same.
SEGMENT = 1 << 20


@dataclass
class Entries:
    """One entry per run of windows with the same anchor: row number, first window
    start, number of windows and the anchor's position (in symbols of the batch), and
    the hash of the anchor's stretch."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray


def entries(symbols: np.ndarray, firsts: np.ndarray, width: int, gram: int, segment: int | None = None) -> Entries:
    """Anchor entries of a batch; row i has symbols firsts[i] .. firsts[i + 1] - 1."""
    segment = segment or SEGMENT
    found = [_segment(symbols[lo : lo + segment + width - 1], lo, segment, firsts, width, gram) for lo in range(0, len(symbols) - width + 1, segment)]
    none = np.zeros(0, np.int64)
    parts = [np.concatenate(x) for x in zip(*found)] or [none, none, none, none.astype(np.uint64)]
    return Entries(np.searchsorted(firsts, parts[0], "right") - 1, *parts)


def _segment(symbols: np.ndarray, lo: int, segment: int, firsts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """start, count, anchor, gram hash of the windows that start in [lo, lo + segment)."""
    n = len(symbols)
    # Windows that lie in one row.
    first, last = np.maximum(firsts[:-1] - lo, 0), np.minimum(firsts[1:] - width + 1 - lo, segment)
    has = last > first
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, first[has], 1)
    np.add.at(step, last[has], -1)
    starts = np.flatnonzero(np.cumsum(step)[: n - width + 1] > 0)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    hashes = shared.Rolling(symbols).of(at, at + gram)
    # Stretches across rows are never inside a window of one row.
    best = sliding_min((hashes & ~_LOW) | at.astype(np.uint64), width - gram + 1)
    anchor = (best[starts] & _LOW).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(fresh)
    return starts[head] + lo, np.diff(np.append(head, len(starts))), anchor[head] + lo, hashes[anchor[head]]


def hashes_at(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: tuple[int, ...]) -> list[np.ndarray]:
    """For every salt the hashes of the stretches [start, end), a segment at a time."""
    out = [np.empty(len(starts), np.uint64) for _ in salts]
    order = None if len(symbols) <= SEGMENT else np.argsort(starts, kind="stable")
    for lo in range(0, max(len(symbols), 1), SEGMENT):
        if order is None:
            which = slice(None)
        else:
            a, b = np.searchsorted(starts, [lo, lo + SEGMENT], sorter=order)
            which = order[a:b]
        s, e = starts[which] - lo, ends[which] - lo
        if len(s):
            part = symbols[lo : lo + int(e.max())]
            for hashed, salt in zip(out, salts):
                hashed[which] = shared.Rolling(part, salt).of(s, e)
    return out


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal disjoint ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return a[np.concatenate([[0], cut])], b[np.concatenate([cut - 1, [len(b) - 1]])]
