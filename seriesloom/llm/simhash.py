"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm._graph import connected_components
from seriesloom.llm._kernel import joined_words, mix, text_chunks, word_bounds
from seriesloom.llm._store import Scratch

U64 = np.uint64
WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 2
#: Numbers of parts that are weighed against each other, and most counters for the values of a part: 4 bytes each.
PARTS, MOST_COUNTERS = (2, 3, 4), 1 << 18
#: What emitting a probe costs beside meeting a candidate.
PROBE_COST = 2.0
#: Fingerprints that may share a part's value before they are linked through their midpoints instead.
HOT = 256
_SLICE = 1 << 17
_ONE = U64(1) << np.arange(BITS, dtype=U64)


def fingerprints(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The SimHash of each row: bits set in over half of the XXH64 of its 3-word shingles, A-Z lower-cased."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends, of_row = word_bounds(raw, bounds)
    text, to, end = joined_words(raw, starts, ends, of_row)
    words = np.diff(of_row)
    shingles = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), shingles)
    first = of_row[:-1][row] + np.arange(len(row)) - (np.cumsum(shingles) - shingles)[row]
    last = np.minimum(first + WORDS, of_row[1:][row]) - 1
    counts = np.zeros((len(words), BITS), np.int64)
    view, digest = memoryview(np.ascontiguousarray(text)), xxhash.xxh64_intdigest
    for lo in range(0, len(row), _SLICE):
        cut = slice(lo, lo + _SLICE)
        h = np.array([digest(view[a:b], SEED) for a, b in zip(to[first[cut]].tolist(), end[last[cut]].tolist(), strict=True)], U64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(row[cut], prepend=-1))
        counts[row[cut][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(U64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, bounds in text_chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(fingerprints(raw, bounds).view(np.int64))], ["doc_id", "fp"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the 64-bit SimHash of each row's whole text, as a signed number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan, f"doc_id {kind}, fp long")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(U64)


def bit_correlations(sigs: DataFrame) -> np.ndarray:
    """Absolute correlations of the 64 bits over all fingerprints: each task sums products, the shuffle adds them by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            fps = _fps(batch)
            for lo in range(0, len(fps), _SLICE):
                ones = ((fps[lo : lo + _SLICE, None] >> np.arange(BITS, dtype=U64)) & U64(1)).astype(np.float32)
                ones = np.hstack([ones, np.ones((len(ones), 1), np.float32)])
                total += ones.T @ ones
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

    cells = sigs.select("fp").mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    rows = cells.groupBy("i").agg(F.sum("v").alias("v")).collect()  # 65 x 65, whatever the table
    g = np.zeros((BITS + 1) ** 2)
    for r in rows:
        g[r.i] = r.v
    g = g.reshape(BITS + 1, BITS + 1)
    n = max(g[-1, -1], 1.0)
    mean = g[-1, :-1] / n
    cov = g[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    out = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(out, 0)
    return out


def correlated_parts(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in ``parts`` groups of like size: each starts with the strongest pair left and takes in the bit most like it."""
    left, out = set(range(len(correlation))), []
    for p in range(parts):
        size = len(left) // (parts - p)
        rest = sorted(left)
        inner = correlation[np.ix_(rest, rest)]
        group = [rest[i] for i in np.unravel_index(int(inner.argmax()), inner.shape)] if size > 1 and inner.max() > 0 else rest[: min(size, 2)]
        while len(group) < size:
            free = sorted(left - set(group))
            group.append(free[int(correlation[np.ix_(free, group)].sum(1).argmax())])
        out.append(sorted(group[:size]))
        left -= set(out[-1])
    return out


def _mask(group: list[int]) -> np.uint64:
    return np.bitwise_or.reduce(_ONE[group])


def _bucket(value: np.ndarray, counters: int) -> np.ndarray:
    return (mix(value) & U64(counters - 1)).astype(np.int64)


def value_counts(sigs: DataFrame, groups: list[list[int]], counters: int) -> np.ndarray:
    """How many fingerprints have each value of each group of bits, by hashed counters: an array of groups x counters."""
    masks = [_mask(g) for g in groups]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _fps(batch)
            slots = np.concatenate([i * counters + _bucket(fps & m, counters) for i, m in enumerate(masks)])
            at, n = np.unique(slots, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["slot", "n"])

    found = sigs.select("fp").mapInArrow(partial, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # groups x counters at most
    out = np.zeros(len(groups) * counters, np.float32)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(len(groups), counters)


def _radius_sizes(width: int) -> list[int]:
    """Values within 0, 1 and 2 bits of one of ``width`` bits."""
    return [1, 1 + width, 1 + width + width * (width - 1) // 2]


def allocate(costs: np.ndarray, units: int) -> np.ndarray:
    """The cheapest thresholds: parts x rows of radii from -1 on, whose sum over the parts is ``units`` minus their number.

    ``costs[part, u, row]`` is the cost of radius u - 1. A dynamic programme over parts and units spent.
    """
    parts, _, rows = costs.shape
    best = np.full((units + 1, rows), np.inf)
    best[0] = 0
    choice = np.zeros((parts, units + 1, rows), np.int8)
    for p in range(parts):
        new = np.full_like(best, np.inf)
        for spent in range(units + 1):
            for u in range(spent + 1):
                trial = best[spent - u] + costs[p, u]
                better = trial < new[spent]
                new[spent] = np.where(better, trial, new[spent])
                choice[p, spent] = np.where(better, u, choice[p, spent])
        best = new
    out, left, at = np.zeros((parts, rows), np.int8), np.full(rows, units), np.arange(rows)
    for p in reversed(range(parts)):
        out[p] = choice[p, left, at]
        left = left - out[p]
    return out - 1


def probe_costs(fps: np.ndarray, groups: list[list[int]], counts: np.ndarray) -> np.ndarray:
    """Estimated cost of each part and radius for each fingerprint: probes, and what the counters say that they meet."""
    counters = counts.shape[1]
    out = np.zeros((len(groups), DISTANCE + 2, len(fps)))
    for i, g in enumerate(groups):
        own = fps & _mask(g)
        met = [counts[i][_bucket(own, counters)].astype(float)]
        near = sum(counts[i][_bucket(own ^ _ONE[b], counters)].astype(float) for b in g)
        met.append(met[0] + near)
        met.append(met[1] + near * (len(g) - 1) / 2)  # two bits off: as met as one bit off on average
        for u, (n, load) in enumerate(zip(_radius_sizes(len(g)), met, strict=True), 1):
            out[i, u] = PROBE_COST * n + load
    return out


def choose_parts(correlation: np.ndarray, sigs: DataFrame, n: int) -> tuple[list[list[int]], np.ndarray]:
    """The number of parts with the least estimated cost over all fingerprints, its groups of bits and their counters."""
    counters = int(min(MOST_COUNTERS, max(1 << 12, 1 << int(4 * n).bit_length())))
    tried = [correlated_parts(correlation, m) for m in PARTS]
    counts = value_counts(sigs, [g for groups in tried for g in groups], counters)
    ranked, at = [], 0
    for groups in tried:
        mine = counts[at : at + len(groups)]
        at += len(groups)
        squares = (mine.astype(float) ** 2).sum(1)
        costs = np.array([[0.0, *[r * (PROBE_COST * n + s) for r in _radius_sizes(len(g))]] for g, s in zip(groups, squares, strict=True)])[:, :, None]
        radii = allocate(costs, DISTANCE + 1)[:, 0]
        ranked.append((sum(costs[i, r + 1, 0] for i, r in enumerate(radii)), len(groups), groups, mine))
    _, _, groups, mine = min(ranked, key=lambda r: r[:2])
    return groups, mine


def _within(value: np.ndarray, group: list[int], radius: int) -> Iterator[np.ndarray]:
    """All values that differ from ``value`` in at most ``radius`` bits of the group."""
    yield value
    if radius >= 1:
        for i, b in enumerate(group):
            yield value ^ _ONE[b]
            if radius >= 2:
                for c in group[:i]:
                    yield value ^ _ONE[b] ^ _ONE[c]


def probes(sigs: DataFrame, groups: list[list[int]], counts: np.ndarray) -> DataFrame:
    """``part, key, fp``: the part values that each fingerprint looks up, by the radii that are cheapest for it."""
    shared = sigs.sparkSession.sparkContext.broadcast(counts)  # parts x MOST_COUNTERS floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _fps(batch)
            for lo in range(0, len(whole), 1 << 12):
                fps = whole[lo : lo + (1 << 12)]
                radii = allocate(probe_costs(fps, groups, shared.value), DISTANCE + 1)
                for i, g in enumerate(groups):
                    for r in range(DISTANCE + 1):
                        mine = fps[radii[i] == r]
                        for key in _within(mine & _mask(g), g, r) if len(mine) else ():
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), i, np.int32)), pa.array(key.view(np.int64)), pa.array(mine.view(np.int64))], ["part", "key", "fp"])

    return sigs.select("fp").mapInArrow(run, "part int, key long, fp long")


def midpoint_links(fps: DataFrame) -> DataFrame:
    """``u, v``: links that join all fingerprints of ``fp`` within two bits of each other, 65 rows for each.

    Each names itself and its 64 neighbours. Two are within two bits of each other if and only if they name a
    common value; at most 65 name the same, and all of them link with its least.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(int(b)) for b in _ONE.view(np.int64)])
    named = fps.select("fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("mid"))
    return named.groupBy("mid").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("us")).select(F.explode("us").alias("u"), "v").where("u <> v")


def near_links(sigs: DataFrame, groups: list[list[int]], counts: np.ndarray, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """``u, v``: links that connect all distinct fingerprints within two bits of each other, and no others.

    The radii r of a fingerprint sum to 3 minus the number of parts, so another within two bits is within r
    bits of it in some part. A value that more than ``hot`` fingerprints share is not looked up: those who have
    it or ask for it link through their midpoints, so no bucket gives pairs beyond its square.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(int(_mask(g).view(np.int64))).alias("mask")) for i, g in enumerate(groups)])
    index = sigs.select("fp", F.inline(masks)).select("part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), F.col("fp").alias("v"))
    asked = scratch.table(probes(sigs, groups, counts), "probes")
    crowded = scratch.table(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("part", "key"), "crowded")
    some = bool(crowded.take(1))
    calm = lambda df: df.join(crowded, ["part", "key"], "left_anti") if some else df
    apart: Column = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
    pairs = calm(asked).join(calm(index), ["part", "key"]).where((F.col("fp") < F.col("v")) & (apart <= DISTANCE)).select(F.col("fp").alias("u"), "v")
    if not some:
        return pairs
    of = lambda df, c: df.join(crowded, ["part", "key"], "left_semi").select(F.col(c).alias("fp"))
    members = scratch.table(of(asked, "fp").unionByName(of(index, "v")).distinct(), "members")
    return pairs.unionByName(midpoint_links(members))


def simhash_components(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Near-duplicates by SimHash: ``doc_id, fingerprint, component_id`` for each row of ``documents(doc_id, text)``.

    Fingerprints that differ in at most 2 bits link; ``component_id`` is the least doc_id that links reach,
    the row's own included. Equal fingerprints are one from the start, so copies are never paired. Null and
    empty texts and texts of white space have fingerprint zero and link like any other; a row without an id
    gets the least id of its component, null if it has none; rows of one id are separate rows. An empty
    table gives none.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(document_fingerprints(docs), "fingerprints")
    sigs = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = sigs.count()
    groups, counts = choose_parts(bit_correlations(sigs), sigs, n)
    reached = connected_components(near_links(sigs, groups, counts, scratch, hot), scratch)
    rooted = sigs.join(reached, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
