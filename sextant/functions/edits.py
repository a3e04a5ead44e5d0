"""Edit distances of many pairs of long texts at once.

A column of the table of distances is kept as bits: where it grows by one and where it falls by one from row to row (Myers 1999, in blocks of 64 rows). Blocks of one pair
depend on each other along a column only, so block b works on column t - b in step t, and a step is some twenty numpy operations over all blocks of GROUP pairs. A pair takes
its lengths' product over 64 operations, where the table cell by cell takes the product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

GROUP = 128
ONE, TOP = np.uint64(1), np.uint64(63)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _group(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances of pairs (shorter, longer) of code points, neither empty."""
    n, sizes = len(pairs), np.array([len(b) for _, b in pairs])
    blocks, steps = max((len(a) + 63) // 64 for a, _ in pairs), int(sizes.max())
    rows = np.zeros((blocks * 64, n), np.int64)  # signs by number, 0: beyond the end or not in the shorter text
    columns = np.zeros((steps, n), np.int64)
    signs = 1
    for r, (a, b) in enumerate(pairs):
        known, own = np.unique(a, return_inverse=True)
        at = np.minimum(np.searchsorted(known, b), len(known) - 1)
        rows[: len(a), r], columns[: len(b), r] = own + 1, np.where(known[at] == b, at + 1, 0)
        signs = max(signs, len(known) + 1)
    base = (np.arange(blocks)[:, None] * n + np.arange(n)[None, :]) * signs
    where = np.zeros(blocks * n * signs, np.uint64)  # bit k of (block, pair, sign): row k of the block has the sign
    for k in range(64):
        where[(base + rows[k::64]).ravel()] |= np.uint64(1 << k)
    where.reshape(-1, signs)[:, 0] = 0
    left = np.array([len(a) for a, _ in pairs])[None, :] - 64 * np.arange(blocks)[:, None]
    inside = np.where(left >= 64, ~np.uint64(0), (ONE << np.clip(left, 0, 63).astype(np.uint64)) - ONE)
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    rise, fall = np.zeros((blocks + 1, n), np.uint64), np.zeros((blocks + 1, n), np.uint64)  # what a block hands to the next, in the step after
    rise[0] = 1
    last, least, out = sizes[None, :] - 1 + np.arange(blocks)[:, None], int(sizes.min()) - 1, sizes.copy()
    for t in range(steps + blocks - 1):
        lo, hi = max(0, t - steps + 1), min(blocks, t + 1)  # blocks at work
        u, d, more, less = up[lo:hi], down[lo:hi], rise[lo:hi], fall[lo:hi]
        equal = where.take(base[lo:hi] + columns[t - hi + 1 : t - lo + 1][::-1])
        x = equal | d
        equal |= less
        h = equal & u
        h += u
        h ^= u
        h |= equal
        grows = h | u
        np.invert(grows, out=grows)
        grows |= d
        h &= u  # falls
        next_rise, next_fall = grows >> TOP, h >> TOP
        grows <<= ONE
        grows |= more
        h <<= ONE
        h |= less
        np.bitwise_or(x, grows, out=u)
        np.invert(u, out=u)
        u |= h
        np.bitwise_and(grows, x, out=d)
        rise[lo + 1 : hi + 1], fall[lo + 1 : hi + 1] = next_rise, next_fall
        if t >= least:
            done = last[lo:hi] == t  # a pair's last column
            if done.any():
                held = inside[lo:hi]
                out += np.where(done, np.bitwise_count(u & held).astype(np.int64) - np.bitwise_count(d & held).astype(np.int64), 0).sum(axis=0)
    return out


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances in code points."""
    out = np.zeros(len(a), np.int64)
    work = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            continue
        if x and y:
            p, q = _points(x), _points(y)
            work.append((k, p, q) if len(p) <= len(q) else (k, q, p))
        else:
            out[k] = len(x) + len(y)
    work.sort(key=lambda w: (len(w[2]), len(w[1])))  # like lengths together
    for i in range(0, len(work), GROUP):
        part = work[i : i + GROUP]
        out[[k for k, _, _ in part]] = _group([(p, q) for _, p, q in part])
    return out


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Like levenshtein(); null where either is."""
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series([None] * len(a), dtype="Int64")
    out[known] = distances(a[known].tolist(), b[known].tolist())
    return out
