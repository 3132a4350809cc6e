"""Periodic runs of words: longest previous factors, their blocks, boundary extensions and bucketed copies."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm._kernel import joined_words, text_chunks, word_bounds, word_ids

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Pairs of boundary and period that are held at once.
PAIRS = 1 << 20


def rank_tables(s: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling: table k gives suffixes that share 2**k symbols one number, else their order.

    The last symbol must be unique. Only suffixes that still share their number with another are sorted
    again. In the last table all differ: it is the inverse of the suffix array.
    """
    n = len(s)
    at = np.argsort(s, kind="stable")
    key, heads, rank = s[at], np.zeros(n, np.int64), np.empty(n, np.int32)
    tables: list[np.ndarray] = []
    while True:
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        place = np.arange(len(at))
        if tables:
            opened = np.ones(len(at), bool)
            opened[1:] = heads[1:] != heads[:-1]
            place -= np.maximum.accumulate(np.where(opened, place, 0))
        group = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        rank = rank.copy()
        rank[at] = heads + place[group]
        tables.append(rank)
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        at = at[~alone]
        if not len(at):
            return tables
        ahead = at + (1 << (len(tables) - 1))
        key = rank[at].astype(np.int64) * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        heads = key // (n + 1)


def common_ahead(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols from ``x`` on equal those from ``y`` on."""
    x, y = x.copy(), y.copy()
    begin = x.copy()
    for k in reversed(range(len(tables) - 1)):
        step = (tables[k][x] == tables[k][y]).astype(np.int64) << k
        x += step
        y += step
    return x - begin


def common_behind(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols before ``x`` equal those before ``y``."""
    x, y = x.copy(), y.copy()
    begin = x.copy()
    for k in reversed(range(len(tables) - 1)):
        a, b = x - (1 << k), y - (1 << k)
        step = ((np.minimum(a, b) >= 0) & (tables[k][np.maximum(a, 0)] == tables[k][np.maximum(b, 0)])).astype(np.int64) << k
        x -= step
        y -= step
    return begin - x


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the longest factor that also starts before it, and where: one pass over the suffix array.

    ``lcp[j]`` is what the suffixes at places j - 1 and j share.
    """
    n = len(sa)
    length, source = [0] * n, [-1] * n
    below, held = [-2], [0]  # positions that no smaller one has followed, and what each shares with that below it
    for p, shared in zip([*sa.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        while (top := below[-1]) > p:
            del below[-1]
            former = held.pop()
            if former >= shared:
                length[top], source[top] = former, below[-1]
            else:
                length[top], source[top], shared = shared, p, former
        below.append(p)
        held.append(shared)
    return np.array(length), np.array(source)


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the greedy blocks: each the longest previous factor, or one new symbol."""
    starts, i, steps, n = [], 0, np.maximum(length, 1).tolist(), len(length)
    while i < n:
        starts.append(i)
        i += steps[i]
    return np.array(starts, np.int64)


def _boundary_runs(tables: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all long runs that touch a block's start.

    A run that touches the start x of a block, and no later one before its end, has a period below the
    lengths of this block and the one before. Its larger side of x has at least 12 words and 1.5 periods,
    so that 4 words equal those one period off: only such pairs are extended.
    """
    n, four = len(tables[0]), tables[2]
    size = np.diff(np.append(starts, n))
    x, most = starts[1:], size[1:] + size[:-1] - 1
    found = [np.zeros((0, 3), np.int64)]
    cuts = np.searchsorted(np.cumsum(most), np.arange(PAIRS, int(most.sum()) + PAIRS, PAIRS), "left")
    for lo, hi in zip([0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist(), strict=True):
        m = most[lo:hi]
        if not m.sum():
            continue
        at = np.repeat(x[lo:hi], m)
        period = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m) + 1
        for side in (-1, 1):
            a, b = (at - 4, at - 4 - period) if side < 0 else (at, at + period)
            near = np.flatnonzero((np.minimum(a, b) >= 0) & (np.maximum(a, b) < n))
            near = near[four[a[near]] == four[b[near]]]
            p, mid = period[near], at[near]
            other = mid + side * p
            start = np.minimum(mid, other) - common_behind(tables, mid, other)
            end = np.maximum(mid, other) + common_ahead(tables, mid, other)
            long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
            found.append(np.stack([start, end, p], 1)[long])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)  # the same stretch again has a multiple of the period
    return runs[keep]


def long_runs(s: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, smallest period) of ``s``, whose last symbol is unique, by start and period.

    Suffix array and common prefixes by prefix doubling give the previous factors and blocks. Runs that
    touch a block's start come from extensions there. A run strictly inside a block is that of the block's
    earlier copy, which is known by then: blocks go from left to right, runs are found by their start.
    """
    tables = rank_tables(s)
    if len(tables) <= 4:  # no 16 words occur twice, as they do in every such run
        return []
    n = len(s)
    sa = np.empty(n, np.int64)
    sa[tables[-1]] = np.arange(n)
    lcp = np.append(0, common_ahead(tables, sa[:-1], sa[1:]))
    length, source = previous_factors(sa, lcp)
    starts = blocks(length)
    by_start: dict[int, list[tuple[int, int]]] = {}
    begins = np.zeros(n, bool)
    for a, b, p in _boundary_runs(tables, starts).tolist():
        by_start.setdefault(a, []).append((b, p))
        begins[a] = True
    size = np.diff(np.append(starts, n))
    for i in np.flatnonzero(size >= LEAST_WORDS + 2).tolist():
        x, m = int(starts[i]), int(size[i])
        src = int(source[x])
        off = x - src
        for lo in range(src + 1, src + m, off):  # a block that overlaps its source is copied piece by piece
            hits = np.flatnonzero(begins[lo : min(lo + off, src + m)])
            for a in (hits + lo).tolist():
                for b, p in by_start[a]:
                    if b < src + m and (b + off, p) not in by_start.get(a + off, ()):
                        by_start.setdefault(a + off, []).append((b + off, p))
                        begins[a + off] = True
    return sorted((a, b, p) for a, ends in by_start.items() for b, p in ends)


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document chosen by its id's CRC-32 to repeat its tail, None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _row(runs: list[tuple[int, int, int]]) -> tuple:
    """Count, the run of most periods, and the digest of all."""
    best = None
    for start, end, p in runs:
        if best is None or (end - start) * best[2] > best[1] * p:
            best = (start, end - start, p)
    lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(lines.encode()).hexdigest()


def _chunk(ids: list, raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
    """The result rows of some documents. Their words are searched as one sequence, a symbol of its own after each."""
    starts, ends, of_row = word_bounds(raw, bounds)
    words = np.diff(of_row)
    which = np.arange(len(starts))
    moved = set()
    for r, (doc_id, n) in enumerate(zip(ids, words.tolist(), strict=True)):
        if (order := planted(doc_id, n)) is not None:
            which[of_row[r] : of_row[r + 1]] = of_row[r] + order
            moved.add(r)
    searched = np.flatnonzero(words >= LEAST_WORDS)
    by_row: dict[int, list[tuple[int, int, int]]] = {}
    if len(searched):
        m = words[searched]
        inside = np.repeat(of_row[:-1][searched] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        first = np.cumsum(m + 1) - (m + 1)
        s = np.empty(int(m.sum()) + len(m), np.int64)
        s[np.repeat(np.arange(len(m)), m) + np.arange(m.sum())] = word_ids(raw, starts, ends)[which[inside]]
        s[first + m] = len(starts) + np.arange(len(m))
        for a, b, p in long_runs(s):
            r = int(np.searchsorted(first, a, "right")) - 1
            by_row.setdefault(int(searched[r]), []).append((a - int(first[r]), b - int(first[r]), p))
    text, w0, w1 = joined_words(raw, starts, ends, of_row)
    for r, doc_id in enumerate(ids):
        lo, n, runs = int(of_row[r]), int(words[r]), by_row.get(r, [])
        if r in moved or runs:
            drop = np.zeros(n + 1, np.int64)
            for a, b, p in runs:
                drop[a + p] += 1
                drop[b] -= 1
            kept = which[lo : lo + n][np.cumsum(drop[:-1]) == 0].tolist()
            body = b" ".join(text[w0[j] : w1[j]].tobytes() for j in kept)
        else:
            body = text[w0[lo] : w1[lo + n - 1]] if n else b""
        yield doc_id, *_row(runs), hashlib.sha256(body).hexdigest()


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.column("doc_id").type
        for lo, hi, raw, bounds in text_chunks(batch.column("text")):
            rows = list(zip(*_chunk(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), raw, bounds), strict=True))
            kinds = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], _NAMES)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The periodic runs of words in each row of ``documents(doc_id, text)`` and its text without their repeats.

    ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``; start, length and
    period are those of the run with most periods, null without a run. Words are the longest stretches
    outside space and 0x09-0x0D of the whole text, compared byte by byte; documents whose id's CRC-32 is
    divisible by 10 repeat their tail first (``planted``). Rows are independent: nothing is shuffled. Null
    and empty texts have no words; repeated rows give a row each; a null id plants nothing. A task holds
    about a megabyte of text, or one text if it is longer, with some 4 bytes a word for each doubling of
    its longest repeat and 100 more.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in _NAMES[1:6])}, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan, schema)
