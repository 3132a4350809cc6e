"""Array kernels over Arrow text columns: word bounds, word hashes, shingle sets.

A word is a longest run of bytes outside space and 0x09-0x0D; hashes are 64-bit, of the word with
A-Z lower-cased. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = int(mix(np.array([0x5EED], U64))[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SHINGLE = [U64(int(x) | 1) for x in mix(np.arange(11, 43, dtype=U64))]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            step = U64(pow(base, done, 1 << 64))
            more = min(done, n - done)
            out[done : done + more] = out[:more] * step
            done += more
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        _tables.update(up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return _tables["up"], _tables["down"]


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``size`` bytes, a row at least.

    Yields (first row, row after the last, UTF-8 bytes, row bounds in these bytes). Null is no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = bounds[1:] > bounds[:-1]
    at, to = bounds[:-1][filled], bounds[1:][filled] - 1
    first[at] = solid[at]
    last[to] = solid[to]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of raw[start:end] for each span: a polynomial in random byte values, finalised with the length."""
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` successive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[:n] * _SHINGLE[0]
        for j in range(1, k):
            out = (out ^ (out >> U64(29))) + words[j : j + n] * _SHINGLE[j]
    return mix(out)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``k``-word shingles.

    A row with fewer words has its whole sequence as the one shingle, a row without words none.
    """
    starts, ends, of_row = word_bounds(raw, bounds)
    words = span_hashes(raw, starts, ends)
    runs = window_hashes(words, k)
    for lo, hi in zip(of_row[:-1].tolist(), of_row[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(runs[lo : hi - k + 1])
        elif hi > lo:
            yield window_hashes(words[lo:hi], hi - lo) + U64(hi - lo)
        else:
            yield np.zeros(0, U64)


def set_fingerprint(members: np.ndarray) -> int:
    """An order-free 64-bit fingerprint of a set of hashes, as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix(members).sum(dtype=U64) + U64(len(members))
    return int(mix(np.array([total], U64)).view(np.int64)[0])


def spans_equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether ``raw[a:a + size]`` equals ``raw[b:b + size]``, for each triple; about ``most`` bytes are compared at once."""
    out = np.ones(len(a), bool)
    long = size > most
    for i in np.flatnonzero(long).tolist():
        out[i] = np.array_equal(raw[a[i] : a[i] + size[i]], raw[b[i] : b[i] + size[i]])
    rest = np.flatnonzero(~long)
    cuts = np.searchsorted(np.cumsum(size[rest]), np.arange(0, int(size[rest].sum()) + most, most)) if len(rest) else []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = rest[lo : min(hi + 1, len(rest))]
        n = size[part]
        of = np.repeat(np.arange(len(part)), n)
        step = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        out[part[of[raw[a[part][of] + step] != raw[b[part][of] + step]]]] = False
    return out


def word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, the same for spans of the same bytes only: equal hashes are verified byte by byte."""
    hashes = span_hashes(raw, starts, ends, lower=False)
    order = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(fresh) - 1
    first = order[fresh][ids]
    size = ends - starts
    if not ((size == size[first]).all() and spans_equal(raw, starts, starts[first], size).all()):
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(raw[s:e].tobytes(), len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return ids


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows, those of a row joined by one space: bytes, and start and end of each word in them."""
    size = ends - starts
    last = np.zeros(len(starts), bool)
    filled = of_row[1:] > of_row[:-1]
    last[of_row[1:][filled] - 1] = True
    room = size + ~last
    to = np.cumsum(room) - room
    keep = np.zeros(len(raw) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    keep[ends[~last]] = True
    spaced = raw.copy()
    spaced[ends[~last]] = 0x20
    return spaced[keep], to, to + size
