"""Suffix sorting of sampled suffixes, and induction of the suffixes to the left of them; numpy over one shard's bytes.

A window is a string of `window` bytes. Its sample is the position, among those at which a gram of GRAM bytes fits into it, of the
gram with the smallest hash, the leftmost of equals: it depends on the window's bytes alone, so equal windows have equal samples at
equal offsets. The windows of one sample are neighbours: they form a block, which ends with the last one's last byte.
"""

from __future__ import annotations

import numpy as np

GRAM = 20
#: Bytes that are hashed at once.
CHUNK = 1 << 20
_AT_BITS = 22  # positions of a chunk, with what may follow it
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = 0xD6E8FEB86659FD93


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _M3
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other in `raw`, text i ending at ends[i]: each block's text, first window's position in it,
    number of windows, sample's distance from the first window, hash of the sampled gram and hash of the block's bytes."""
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    parts = []
    starts = np.concatenate([[0], ends[:-1]])
    # Chunks of whole texts where they fit; longer texts are cut into runs of windows.
    runs: list[list[tuple[int, int, int]]] = [[]]
    size = 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while b - a >= window:
            if size >= CHUNK:
                runs.append([])
                size = 0
            e = min(b, a + max(CHUNK - size, 2 * window))
            runs[-1].append((i, a, e))
            size += e - a
            if e == b:
                break
            a = e - window + 1
    for run in runs:
        if run:
            parts.append(_chunk_blocks(raw, starts, run, window))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty


def _chunk_blocks(raw: np.ndarray, starts: np.ndarray, run: list[tuple[int, int, int]], window: int) -> tuple[np.ndarray, ...]:
    text = np.concatenate([raw[a:e] for _, a, e in run] + [np.zeros(GRAM, dtype=np.uint8)])
    n = len(text) - GRAM
    eight = np.ndarray((n + GRAM - 7,), dtype="<u8", buffer=text.data, strides=(1,)).astype(np.uint64)
    e8 = _mix(eight * _M1)  # a hash of the 8 bytes at each position
    h = eight[:n] * _M2  # and of the gram
    for k in (*range(8, GRAM - 8, 8), GRAM - 8):
        h = _mix(h ^ eight[k : n + k] * _M1)
    key = (h >> np.uint64(_AT_BITS)) << np.uint64(_AT_BITS) | np.arange(n, dtype=np.uint64)
    least, width, goal = key, 1, window - GRAM + 1
    while width < goal:  # sliding minimum by doubling
        step = min(width, goal - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & np.uint64((1 << _AT_BITS) - 1)).astype(np.int64)
    sizes = np.array([e - a for _, a, e in run])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    valid = np.zeros(n + 1, dtype=np.int64)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + sizes - window + 1, -1)
    valid = np.cumsum(valid)[: len(at)] > 0
    change = np.ones(len(at), dtype=bool)
    change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    # Neighbouring runs of windows never share a sample: a sample lies within its window.
    change[np.minimum(begin, len(at) - 1)] = True
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(at)]])
    first, last = first[valid[first]], last[valid[first]]
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(e8[:n] * _powers(n), out=prefix[1:])
    stop = last + window - 8  # beyond the last position whose 8 bytes are all in the block
    content = (prefix[stop] - prefix[first]) * _inverse_powers(n)[first]
    sample = at[first]
    shape = ((last - first) << 8 | (sample - first)).astype(np.uint64)
    content = _mix(content ^ shape * _M1)
    piece = np.searchsorted(begin, first, side="right") - 1
    which = np.array([i for i, _, _ in run])[piece]
    place = first - begin[piece] + np.array([a for _, a, _ in run])[piece] - starts[which]
    return which, place, last - first, sample - first, h[sample], content


def induced(right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of sampled suffixes also start in a text of a smaller owner.

    right: the sampled suffixes' first bytes, a row each, of which right_len count; left: the bytes before them, nearest first. The
    suffixes are sorted once, with the lengths of their neighbours' common prefixes. Then the suffixes one byte further to the
    left are induced: their order is that of the byte and, among equal bytes, of the suffixes behind it; and the common prefix of
    two neighbours of equal byte is one longer than the least between the suffixes behind them. A window is a group of suffixes
    with common prefixes of at least `window`. Returns (row, distance of the window's start to the left of the sample).
    """
    rows, away = [], []
    n = len(right)
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort(right.T[::-1])
    a, b = order[:-1], order[1:]
    same = right[a] == right[b]
    common = np.where(same.all(axis=1), right.shape[1], np.argmin(same, axis=1))
    common = np.concatenate([[0], np.minimum(common, np.minimum(right_len[a], right_len[b]))])
    for j in range(left.shape[1] + 1):
        if j:
            alive = left_len[order] >= j  # the others have no suffix here: what they separated is joined over the least between
            keep = np.flatnonzero(alive)
            if len(keep) < 2:
                break
            least = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
            least[0] = 0
            order, common = order[keep], least
            byte = left[order, j - 1]
            by = np.argsort(byte, kind="stable")
            moved = byte[by]
            new = np.zeros(len(by), dtype=np.int64)
            pairs = np.flatnonzero(moved[1:] == moved[:-1]) + 1
            if len(pairs):
                lo, hi = by[pairs - 1] + 1, by[pairs] + 1
                new[pairs] = 1 + _least_between(common, lo, hi)
            order, common = order[by], new
        reach = right_len[order] + j >= window
        groups = np.flatnonzero(common < window)
        who = np.where(reach, owner[order], np.iinfo(np.int64).max)
        least_owner = np.repeat(np.minimum.reduceat(who, groups), np.diff(np.concatenate([groups, [len(order)]])))
        hit = reach & (owner[order] > least_owner)
        rows.append(order[hit])
        away.append(np.full(int(hit.sum()), j))
    return np.concatenate(rows), np.concatenate(away)


def shared(own: np.ndarray, sample: np.ndarray, n: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of blocks also start in a block of a smaller owner: (row, distance of the window's start to the left of the sample).

    own: a block's bytes a row, padded to 2 * window; sample: the sample's place in them; n: the block's windows.
    """
    right_len = np.minimum(n + window - 1 - sample, window)
    col, row = np.arange(window), np.arange(len(own))[:, None]
    right = np.where(col[None, :] < right_len[:, None], own[row, np.minimum(sample[:, None] + col, 2 * window - 1)], 0)
    left = np.where(col[None, :] < sample[:, None], own[row, np.maximum(sample[:, None] - 1 - col, 0)], 0)[:, : window - GRAM]
    return induced(right.astype(np.uint8), right_len, left.astype(np.uint8), sample, owner, window)


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair, by a sparse table."""
    out = np.empty(len(lo), dtype=values.dtype)
    level = np.floor(np.log2(hi - lo)).astype(np.int64)
    table = values
    for k in range(int(level.max()) + 1):
        m = level == k
        if m.any():
            out[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << k)])
        table = np.minimum(table[: max(len(table) - (1 << k), 0)], table[1 << k :])
    return out
