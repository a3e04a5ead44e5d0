"""numpy kernels over the byte buffers of Arrow string columns.

Words and lines are named by xxhash of their bytes. Spans of fixed, short length (op3's) are hashed by polynomial prefix sums modulo 2**64 over
random byte codes, so that any span costs two look-ups; such sums hold for spans of some hundred bytes, not for long regular ones. Work goes piece by piece
(PIECE bytes), so memory does not follow the length of a text or of an Arrow batch; a word or line longer than a piece is held as a whole.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

PIECE, BATCH_BYTES = 1 << 18, 8 << 20
U = np.uint64
WORD_LUT = np.ones(256, dtype=bool)
WORD_LUT[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEED = 90210


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, powers of the base, inverse powers."""
    rng = np.random.default_rng(90210)
    code = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    n = 2 * PIECE + 1024
    powers = _geometric(base, n)
    inverses = _geometric(inverse, n)
    return code, powers, inverses


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of at most 2 * PIECE bytes; n + 1 values."""
    code, powers, _ = tables()
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(code[data] * powers[: len(data)], out=out[1:], dtype=U)
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    return mix((sums[end] - sums[start]) * tables()[2][start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, most: int | None = None):
    """Ranges [i, j) of rows with at most `most` bytes together, PIECE by default; a longer row is alone."""
    most = most or PIECE
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxhash of each of the strings data[start:end), which follow one another. Arrow finds the distinct ones; only these are hashed."""
    # strings and what stands between them in turn
    return names_beside(data, np.stack([start, end], 1).ravel(), 2)


def names_beside(data: np.ndarray, edges: np.ndarray, step: int = 1) -> np.ndarray:
    """xxhash of every step-th of the strings between neighbouring edges, which are one binary array over the bytes of data."""
    if len(edges) < 2:
        return np.zeros(0, U)
    strings = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    used = strings.indices.to_numpy()[::step]
    known = np.zeros(len(strings.dictionary), U)
    wanted = np.unique(used)
    known[wanted] = np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in strings.dictionary.take(pa.array(wanted)).to_pylist()), U, len(wanted))
    return known[used]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes that are not blank, A-Z lowered) and, per row, the index of its first (n + 1)."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in runs(offsets):
        for a, b in _word_pieces(data, int(offsets[i]), int(offsets[j])):
            part = LOWER[data[a:b]]
            inside = WORD_LUT[part]
            cut = np.zeros(len(part) + 1, bool)
            cut[1:-1] = inside[1:] != inside[:-1]
            edge = offsets[i : j + 1] - a
            edge = edge[(edge > 0) & (edge < len(part))]
            cut[edge] = True
            cut[0] = cut[-1] = True
            at = np.flatnonzero(cut)
            start, end = at[:-1], at[1:]
            keep = inside[start] if len(part) else np.zeros(0, bool)
            start, end = start[keep], end[keep]
            hashes.append(names(part, start, end))
            np.add.at(counts, np.searchsorted(offsets, start + a, "right") - 1, 1)
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), first


def _word_pieces(data: np.ndarray, lo: int, hi: int):
    """Pieces of [lo, hi) that end at a blank; one with a word longer than PIECE is as long as that."""
    a = lo
    while a < hi:
        b = min(a + PIECE, hi)
        if b < hi:
            blank = np.flatnonzero(~WORD_LUT[data[a:b]])
            if len(blank):
                b = a + int(blank[-1]) + 1
            while b < hi and not len(blank):
                rest = data[b : b + PIECE]
                blank = np.flatnonzero(~WORD_LUT[rest])
                b += int(blank[0]) if len(blank) else len(rest)
        yield a, b
        a = b


#: what a worker keeps from one task for the next of the same kind
KEPT: dict[int, object] = {}


def arrow_batches(batches, columns: list[str], keep: bool = False):
    """The columns of each Arrow record batch, as a list; batches of more than BATCH_BYTES come in parts, so what is made of one is bounded as well.
    Unless keep is set, what tasks of another kind left in KEPT goes first."""
    begin(keep)
    try:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.get_total_buffer_size()))
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                yield [part.column(part.schema.get_field_index(c)) for c in columns]
    finally:
        give_back()


def begin(keep: bool = False) -> None:
    """A task begins: what the worker's tasks before it left behind goes, for only now nothing refers to it any more."""
    if not keep:
        KEPT.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and would keep it beside the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
