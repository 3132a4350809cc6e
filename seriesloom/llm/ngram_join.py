"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document becomes the set of its distinct ``k``-word shingles. All sets share one token order,
rare first, by frequencies counted over the whole corpus in slots of leading bits, of which those above
chance are kept as a byte (any total order keeps the join exact; a good one keeps it cheap). With threshold ``t`` a set of size n and a multiplicity l
has the prefix of its first ``n - ceil(t n) + l`` tokens, and two sets at or above ``t`` share at
least ``min(l, l')`` tokens of their prefixes. Each document takes the l that minimises its estimated
candidate cost: postings of the longer prefix against candidates left by the stricter match.

The join never lists the pairs of a group. Prefix tokens link sets into candidate clusters by a
linear number of edges, which need the multiplicity where all that two sets share is rare. Clusters of up to ``block`` sets are verified in one piece (multi-match
first, then exact intersections). The sets of larger clusters are joined again by an order of their own,
whose slots have fewer tokens to tell apart, for as long as that halves them: what chance or common
passages had chained falls apart. A cluster that stays large is cut into blocks, each verified within itself
and against one hub block; only sets that are then outside the cluster's largest component meet the
other blocks. Each task gives back a spanning forest of the links that it found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm import _kernel as K
from seriesloom.llm._bitmap import bitmap
from seriesloom.llm._graph import connected_components
from seriesloom.llm._rows import as_row, row_order, text_key
from seriesloom.llm._store import Scratch, shuffles_removed

#: Tokens are counted by their first bits, in parts by the first of these; the sketch keeps a byte for each of its places.
SLOT_BITS, PART_BITS, SKETCH_BITS = 28, 6, 24
#: Most tokens whose slots a task sorts at once.
SLOT_RUN = 1 << 21
#: Bits of the bitmaps of ids: eight a row, between these.
BITMAP_BITS, MOST_BITMAP_BITS = 23, 26
MOST_MATCHES = 512
STRAY, EMIT, PASSAGE = 0.05, 5.0, 16.0
SMALL_BUCKET = 8
HOT_POSTINGS = 4096
BLOCK = 512


def least_overlap(n: int, threshold: int) -> int:
    """Tokens that a set of ``n`` shares with any set at ``threshold`` percent or above."""
    return -(-threshold * n // 100)


def prefix_length(n: int, threshold: int, matches: int) -> int:
    return min(n, n - least_overlap(n, threshold) + matches)


def choose_matches(costs: np.ndarray, n: int, threshold: int) -> int:
    """The multiplicity with the least estimated cost.

    ``costs`` has the estimated other postings of the first tokens in order. A posting costs one to
    scan, a token of the longer prefix ``EMIT`` to ship, a candidate a tenth of the set to verify. What
    two unrelated sets share is a passage or two, so candidates fall by e for each ``PASSAGE`` matches.
    """
    top = max(1, min(MOST_MATCHES, least_overlap(n, threshold), n // 16))
    first = prefix_length(n, threshold, 1)
    sums = np.cumsum(costs + STRAY)
    matches = np.arange(1, top + 1)
    postings = sums[np.minimum(first + matches - 1, len(sums)) - 1]
    cost = postings + EMIT * matches + postings * (n / 10) * np.exp(-(matches - 1) / PASSAGE)
    return int(np.argmin(cost)) + 1


class _Order:
    """The global token order and the posting estimates, from the broadcast sketch: by level, then by token."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels
        self.others = np.maximum(np.exp2(np.arange(256) / 8) - 2, 0).astype(np.float32)
        self.shift = K.U64(65 - len(levels).bit_length())

    def arrange(self, tokens: np.ndarray, threshold: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Sorted tokens in global order, the multiplicity, and posting estimates of the prefix."""
        level = self.levels[(tokens >> self.shift).astype(np.int64)]
        order = np.argsort(level, kind="stable")
        n = len(tokens)
        longest = prefix_length(n, threshold, max(1, min(MOST_MATCHES, n // 16)))
        costs = self.others[level[order[:longest]]]
        matches = choose_matches(costs, n, threshold)
        return tokens[order], matches, costs[: prefix_length(n, threshold, matches)]


class _Slots:
    """Slots of a task's tokens, collected to be sorted."""

    def __init__(self):
        self.held, self.count = [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.held.append((tokens >> K.U64(64 - SLOT_BITS)).astype(np.int32))
        self.count += len(tokens)

    def out(self) -> tuple[pa.Array, pa.Array]:
        """The filled parts and the gaps between their sorted slots, of all that was added since the last call.

        A gap is as many bytes of 255 as it holds, and a byte of the rest.
        """
        slots = np.sort(np.concatenate([*self.held, np.zeros(0, np.int32)]))
        self.held, self.count = [], 0
        starts = np.arange((1 << PART_BITS) + 1) << (SLOT_BITS - PART_BITS)
        bounds = np.searchsorted(slots, starts)
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        gaps = np.diff(slots, prepend=np.int32(0))
        gaps[bounds[filled]] = slots[bounds[filled]] - starts[filled]
        ends = np.cumsum(gaps // 255 + 1)
        coded = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
        coded[ends - 1] = gaps % 255
        cuts = np.concatenate(([0], ends))[bounds]
        return pa.array(filled, pa.int32()), pa.array([coded[cuts[i] : cuts[i + 1]].tobytes() for i in filled], pa.binary())


def _scan(k: int):
    """First pass: (doc_id, text_key, size, fingerprint) of each row, and the slots of this task's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n", "fp", "part", "gaps"]
        slots = _Slots()

        def flush() -> pa.RecordBatch:
            part, gaps = slots.out()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(part), pa.int64()) for _ in range(4)), part, gaps], names)

        for batch in batches:
            sizes, fps = [], []
            for _, _, raw, bounds in K.text_chunks(batch.column(1)):
                for members in K.shingle_sets(raw, bounds, k):
                    sizes.append(len(members))
                    fps.append(K.set_fingerprint(members))
                    slots.add(members)
                if slots.count >= SLOT_RUN:
                    yield flush()
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names
            )
        yield flush()

    return run


def _scan_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of the tokens of whole sets."""
    slots = _Slots()
    for batch in batches:
        for tokens in batch.column(0):
            slots.add(np.frombuffer(tokens.as_buffer(), np.uint64))
            if slots.count >= SLOT_RUN:
                yield pa.RecordBatch.from_arrays([*slots.out()], ["part", "gaps"])
    yield pa.RecordBatch.from_arrays([*slots.out()], ["part", "gaps"])


def _add_slots(bits: int):
    """The levels of whole parts: eight times the binary logarithm of the largest count of a place above chance, or 0.

    A count is above chance if it exceeds one token and those that share a slot with it, four deviations included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, gaps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = np.frombuffer(gaps.as_buffer(), np.uint8)
                counts = total.setdefault(part, np.zeros(1 << (SLOT_BITS - PART_BITS), np.int32))
                np.add.at(counts, np.cumsum(coded, dtype=np.int64)[coded != 255], np.int32(1))
        for part in sorted(total):
            counts = total.pop(part)
            chance = float(counts.mean())
            most = counts.reshape(-1, 1 << (SLOT_BITS - bits)).max(1)
            level = np.minimum(np.log2(np.maximum(most - chance, 0) + 1) * 8, 255)
            level[most <= 1 + chance + 4 * math.sqrt(chance)] = 0
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.astype(np.uint8).tobytes()], pa.binary())], ["part", "levels"])

    return run


def _sum_sketch(slots: DataFrame, bits: int) -> np.ndarray:
    """The levels of all places on the driver: 2**bits bytes whatever the input."""
    with shuffles_removed(slots.sparkSession):
        summed = slots.repartition(1 << PART_BITS, "part").mapInArrow(_add_slots(bits), "part int, levels binary").toArrow()
    out = np.zeros((1 << PART_BITS, 1 << (bits - PART_BITS)), np.uint8)
    for part, levels in zip(summed.column("part").to_pylist(), summed.column("levels"), strict=True):
        out[part] = np.frombuffer(levels.as_buffer(), np.uint8)
    return out.reshape(-1)


def _held(ids: pa.Array, hold: np.ndarray, bits: int) -> pa.Array:
    """Which rows have an id that is in the bitmap, or none."""
    at = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    keep = hold[(K.mix(at) & K.U64((1 << bits) - 1)).astype(np.int64)]
    return pa.array(keep | ids.is_null().to_numpy(zero_copy_only=False))


def _postings(sets: list[tuple[int, np.ndarray]], ranks: _Order, threshold: int) -> pa.RecordBatch:
    """(token, traits, fingerprint) for each prefix token of ``(fingerprint, tokens)``.

    ``traits`` packs size, multiplicity and salt, 12 bits each for the last two.
    """
    tokens, traits, fps = [], [], []
    for fp, members in sets:
        n = len(members)
        arranged, matches, costs = ranks.arrange(members, threshold)
        p = len(costs)
        spread = np.minimum(costs // HOT_POSTINGS, 4094).astype(np.int64)
        tokens.append(arranged[:p])
        traits.append(np.where(spread > 0, 1 + (fp & 0x7FFFFFFF) % (spread + 1), 0) | (matches << 12) | (n << 24))
        fps.append(np.full(p, fp, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(traits).astype(np.int64)), pa.array(np.concatenate(fps))], ["token", "traits", "fp"])


POSTING = "token long, traits long, fp long"


def _prefixes(order, firsts, bits: int, k: int, threshold: int):
    """Second pass: postings of each set new to this task, of the documents whose id is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, hold, seen = order.value, np.unpackbits(firsts.value).view(bool), set()
        for batch in batches:
            text = batch.column(1).filter(_held(batch.column(0), hold, bits))
            for _, _, raw, bounds in K.text_chunks(text):
                fresh = []
                for members in K.shingle_sets(raw, bounds, k):
                    if not len(members):
                        continue
                    fp = K.set_fingerprint(members)
                    if (fp, len(members)) not in seen:
                        seen.add((fp, len(members)))
                        fresh.append((fp, members))
                if fresh:
                    yield _postings(fresh, ranks, threshold)

    return run


def _prefixes_of_sets(order, threshold: int):
    """Postings of whole sets ``(fp, tokens)`` in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield _postings([(fp, np.sort(np.frombuffer(x.as_buffer(), np.uint64))) for fp, x in zip(part.column(0).to_pylist(), part.column(1), strict=True)], order.value, threshold)

    return run


def _bucket_edges(threshold: int):
    """Edges of the buckets in rows sorted by token, salt, size.

    Rows that repeat, from copies in several tasks, count once. A bucket of up to ``SMALL_BUCKET`` sets gives its pairs of fitting sizes, to be counted; a larger or
    salted one gives its chain of neighbours, which are kept whatever they share elsewhere, that of a salt
    whatever their sizes. The first set of a salt goes out as (token, set, salt, -1).
    """

    def heads(token, salt, fp, long_start: bool):
        first = np.concatenate(([not long_start], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
        at = np.flatnonzero(first & (salt > 0))
        return pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(fp[at]), pa.array(salt[at].astype(np.int64)), pa.array(np.full(len(at), -1, np.int64))], names)

    names = ["u", "v", "shared", "need"]

    def emit(token, salt, n, matches, fp, long_start: bool):
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
        run = np.cumsum(new) - 1
        sizes = np.bincount(run)
        if long_start:
            sizes[0] += SMALL_BUCKET
        large = (sizes[run] > SMALL_BUCKET) | (salt > 0)
        us, vs, needs = [], [], []
        for step in range(1, SMALL_BUCKET):
            if step >= len(run):
                break
            at = np.flatnonzero((run[step:] == run[:-step]) & (~large[:-step] if step > 1 else True))
            if not len(at) and step > 1:
                break
            to = at + step
            fits = (fp[at] != fp[to]) & ((n[at] * 100 >= n[to] * threshold) | (large[at] & (salt[at] > 0)))
            at, to = at[fits], to[fits]
            us.append(np.minimum(fp[at], fp[to])), vs.append(np.maximum(fp[at], fp[to]))
            needs.append(np.where(large[at], 0, np.minimum(matches[at], matches[to])))
        if not us:
            return None
        u, v, need = map(np.concatenate, (us, vs, needs))
        if not len(u):
            return None
        order = np.lexsort((need, v, u))
        u, v, need = u[order], v[order], need[order]
        first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
        shared = np.diff(np.append(first, len(u)))
        return pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(v[first]), pa.array(shared.astype(np.int64)), pa.array(need[first].astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_start = None, False
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            token, traits, fp = part
            if not len(token):
                continue
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (traits[1:] != traits[:-1]) | (fp[1:] != fp[:-1])))
            token, traits, fp = part = [x[new] for x in part]
            salt = traits & 0xFFF
            last = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if len(token) - cut > SMALL_BUCKET:  # a long bucket goes out as it comes, its last row stays
                done, keep, next_long = len(token), len(token) - 1, True
            else:
                done, keep, next_long = cut, cut, long_start and cut == 0
            if done:
                if salt[:done].any():
                    yield heads(token[:done], salt[:done], fp[:done], long_start)
                out = emit(token[:done], salt[:done], traits[:done] >> 24, (traits[:done] >> 12) & 0xFFF, fp[:done], long_start)
                if out is not None:
                    yield out
            held, long_start = [x[keep:] for x in part], next_long
        if held is not None and len(held[0]):
            token, traits, fp = held
            if (traits & 0xFFF).any():
                yield heads(token, traits & 0xFFF, fp, long_start)
            out = emit(token, traits & 0xFFF, traits >> 24, (traits >> 12) & 0xFFF, fp, long_start)
            if out is not None:
                yield out

    return run


def _buckets(prefixes: DataFrame, threshold: int) -> DataFrame:
    """The edges of all buckets."""
    salt = F.col("traits").bitwiseAND(0xFFF)
    dealt = prefixes.repartition("token", salt).sortWithinPartitions("token", salt, "traits", "fp")
    return dealt.mapInArrow(_bucket_edges(threshold), "u long, v long, shared long, need long")


def _candidate_edges(edges: DataFrame) -> DataFrame:
    """A linear number of edges that keep every candidate pair in one cluster, from those of the buckets.

    Two sets that share only small buckets share at least the multiplicity of these. Those that share
    a large bucket are joined by its chain: sets of all sizes between two that permit the threshold
    stand between them. A hot token's sets are chained within salts without regard to size, and so
    are the salts' first sets, which can only merge clusters.
    """
    counted = edges.where("need >= 0").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("u", "v")
    w = Window.partitionBy("u").orderBy("shared", "v")
    heads = edges.where("need < 0").select(F.col("v").alias("a"), F.lead("v").over(w).alias("b")).where("b is not null and b <> a").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return counted.unionByName(heads)


def _members(order, wanted, bits: int, k: int, threshold: int):
    """Third pass: whole ordered sets of the documents whose id is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, hold, seen = order.value, np.unpackbits(wanted.value).view(bool), set()
        for batch in batches:
            text = batch.column(1).filter(_held(batch.column(0), hold, bits))
            for _, _, raw, bounds in K.text_chunks(text):
                fps, sizes, matches, sets = [], [], [], []
                for members in K.shingle_sets(raw, bounds, k):
                    n = len(members)
                    fp = K.set_fingerprint(members)
                    if not n or (fp, n) in seen:
                        continue
                    seen.add((fp, n))
                    arranged, m, _ = ranks.arrange(members, threshold)
                    fps.append(fp), sizes.append(n), matches.append(m), sets.append(arranged.tobytes())
                if fps:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(matches, pa.int32()), pa.array(sets, pa.binary())], ["fp", "n", "matches", "tokens"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    if not len(tokens):
        return out
    new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    many = sizes[group] > 1
    if not many.any():
        return out
    kept, owner = np.cumsum(sizes > 1)[group[many]] - 1, owner[many]
    width = max(1, (1 << 24) // max(m, 1) // 4)
    for lo in range(0, int(kept[-1]) + 1, width):
        a, b = np.searchsorted(kept, [lo, lo + width])
        grid = np.zeros((m, min(width, int(kept[-1]) + 1 - lo)), np.float32)
        grid[owner[a:b], kept[a:b] - lo] = 1
        out += np.rint(grid @ grid.T).astype(np.int64)
    return out


def verify(sets: list[np.ndarray], matches: list[int], threshold: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` (in global order), by index.

    With ``sides`` only pairs with unequal sides are compared.
    """
    m = len(sets)
    lengths = np.array([len(s) for s in sets])
    need = np.minimum.outer(np.array(matches), np.array(matches))
    found = shared_counts([s[: prefix_length(len(s), threshold, q)] for s, q in zip(sets, matches, strict=True)]) >= need
    found &= np.triu(np.ones((m, m), bool), 1)
    found &= np.minimum.outer(lengths, lengths) * 100 >= np.maximum.outer(lengths, lengths) * threshold
    if sides is not None:
        found &= np.not_equal.outer(np.array(sides), np.array(sides))
    at = np.flatnonzero(found.any(0) | found.any(1))
    if not len(at):
        return []
    overlap = shared_counts([sets[i] for i in at])
    union = np.add.outer(lengths[at], lengths[at]) - overlap
    linked = found[np.ix_(at, at)] & (100 * overlap >= threshold * union)
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(at[i])), root(int(at[j]))
        if a != b:
            parent[b] = a
            forest.append((int(at[i]), int(at[j])))
    return forest


def _verify_groups(threshold: int):
    """Per task key: verify each cluster's sets among themselves, or one side against the other."""

    def run(table: pa.Table) -> pa.Table:
        cluster = table.column("cluster").to_numpy()
        us, vs = [], []
        fps = table.column("fp").to_numpy()
        matches, sides = table.column("matches").to_numpy(), table.column("side").to_numpy()
        tokens = table.column("tokens").combine_chunks()
        order = np.lexsort((fps, cluster))
        for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            if len(part) > 1:
                sets = [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in part]
                two = sides[part] if sides[part].any() else None
                for i, j in verify(sets, matches[part].tolist(), threshold, None if two is None else two.tolist()):
                    us.append(fps[part[i]]), vs.append(fps[part[j]])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


EDGE = "u long, v long"


def similar_sets(docs: DataFrame, k: int = 5, threshold: int = 75, block: int = BLOCK, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Sets and links of ``docs(doc_id, text)``.

    Returns (rows, links): ``rows(doc_id, text_key, n, fp)``, one for each input row, where ``fp`` names the
    shingle set, and ``links(u, v)``, a spanning forest over the names of linked sets: two sets are
    connected in it exactly if a chain of links connects them.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    first = scratch.table(keyed.mapInArrow(_scan(k), "doc_id long, text_key long, n long, fp long, part int, gaps binary"), "slots")
    rows = scratch.table(first.where("part is null").select("doc_id", "text_key", "n", "fp"), "sets")
    order = spark.sparkContext.broadcast(_Order(_sum_sketch(first.where("part is not null").select("part", "gaps"), SKETCH_BITS)))
    scratch.drop(first)

    # one document of each set gives its postings; those of no id, or of an id that clashes in the bitmap, are few
    bits = max(BITMAP_BITS, min(MOST_BITMAP_BITS, (8 * rows.count()).bit_length()))
    named = scratch.table(rows.where("n > 0").groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id")), "named")
    firsts = spark.sparkContext.broadcast(bitmap(named.select("doc_id"), bits, K.mix))
    placed = _placed(docs.mapInArrow(_prefixes(order, firsts, bits, k, threshold), POSTING), threshold, block, scratch)

    wanted = spark.sparkContext.broadcast(bitmap(named.join(placed.select("fp"), "fp").select("doc_id"), bits, K.mix))
    whole = docs.mapInArrow(_members(order, wanted, bits, k, threshold), "fp long, n int, matches int, tokens binary")
    spare = Window.partitionBy("fp").orderBy("n")
    whole = whole.join(placed, "fp").withColumn("copy", F.row_number().over(spare)).where("copy = 1").drop("copy")
    whole = scratch.table(whole, "members")

    links, before = _in_one_piece(whole, threshold, block, scratch), None
    large = whole.where("blocks > 1")
    while (many := large.count()) and (before is None or 2 * many <= before):
        before, last = many, whole
        whole = scratch.table(large.drop("cluster", "blocks", "block").join(_placed_again(large, threshold, block, scratch), "fp"), "members")
        scratch.drop(last)
        links = scratch.table(links.unionByName(_in_one_piece(whole, threshold, block, scratch)), "links")
        large = whole.where("blocks > 1")
    # clusters that stay large: each block with the hub block
    if many:
        own = large.select("fp", "matches", "tokens", "cluster", F.lit(0).alias("side"), F.col("block").alias("i"), F.col("block").alias("j"))
        links = scratch.table(links.unionByName(own.groupBy("cluster", "i", "j").applyInArrow(_verify_groups(threshold), EDGE)), "links")
        hub = large.where("block > 0").select("fp", "matches", "tokens", "cluster", F.lit(1).alias("side"), F.lit(0).cast("long").alias("i"), F.col("block").alias("j")).unionByName(
            large.where("block = 0").select("fp", "matches", "tokens", "cluster", F.lit(0).alias("side"), F.lit(0).cast("long").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).alias("j"))
        )
        links = scratch.table(links.unionByName(hub.groupBy("cluster", "i", "j").applyInArrow(_verify_groups(threshold), EDGE)), "links")
        links = links.unionByName(_rest(large, links, threshold, block, scratch))
    links = scratch.table(links, "links")
    scratch.drop(whole)
    return rows, links


def _placed(prefixes: DataFrame, threshold: int, block: int, scratch: Scratch) -> DataFrame:
    """``fp, cluster, blocks, block`` of the sets with candidates: their cluster, its number of blocks, and theirs."""
    buckets = scratch.table(_buckets(prefixes, threshold), "bucket-edges")
    edges = _candidate_edges(buckets)
    clusters = scratch.table(connected_components(edges, scratch).select(F.col("node").alias("fp"), F.col("root").alias("cluster")), "clusters")
    scratch.drop(buckets)
    # only clusters above a block are looked up: a row for each, written so that Spark knows its size before it joins
    sizes = scratch.table(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1"), "sizes")
    placed = clusters.join(sizes, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))


def _placed_again(large: DataFrame, threshold: int, block: int, scratch: Scratch) -> DataFrame:
    """The places of the sets of large clusters by a token order that these sets alone set.

    Any order keeps the join exact. Sets without candidates in it are linked with nothing.
    """
    sketch = _sum_sketch(large.select("tokens").mapInArrow(_scan_sets, "part int, gaps binary"), SKETCH_BITS)
    order = large.sparkSession.sparkContext.broadcast(_Order(sketch))
    return _placed(large.select("fp", "tokens").mapInArrow(_prefixes_of_sets(order, threshold), POSTING), threshold, block, scratch)


def _in_one_piece(whole: DataFrame, threshold: int, block: int, scratch: Scratch) -> DataFrame:
    """Links within the clusters of one block, many of them in a task."""
    small = whole.where("blocks = 1").select("fp", "matches", "tokens", "cluster", F.lit(0).alias("side"), F.pmod(F.xxhash64("cluster"), F.lit(1 << 20)).alias("bin"))
    bins = max(1, small.count() // (2 * block))
    small = small.withColumn("i", F.lit(-1).cast("long")).withColumn("j", F.col("bin") % bins).drop("bin")
    return scratch.table(small.groupBy("i", "j").applyInArrow(_verify_groups(threshold), EDGE), "links")


def _rest(large: DataFrame, links: DataFrame, threshold: int, block: int, scratch: Scratch) -> DataFrame:
    """Links of the sets outside their cluster's largest component: these meet all blocks of the cluster."""
    found = connected_components(links, scratch)
    held = large.select("fp", "cluster", "blocks").join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = held.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    top = scratch.table(sizes.groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("top")), "top")
    outside = held.join(top, "cluster").where("root <> top").select("fp", "cluster", "blocks")
    counts = scratch.table(outside.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("parts")), "parts")
    outside = scratch.table(outside.join(counts, "cluster").select("fp", "parts"), "outside")
    u = large.join(outside, "fp")
    u = u.select(
        "fp", "matches", "tokens", "cluster", F.lit(1).alias("side"), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j")
    )
    v = large.join(counts, "cluster").select("fp", "matches", "tokens", "cluster", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"))
    return u.unionByName(v).groupBy("cluster", "i", "j").applyInArrow(_verify_groups(threshold), EDGE)


def _roots(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp, root`` of each set; a set without links is its own root."""
    roots = connected_components(links, scratch).select(F.col("node").alias("fp"), "root")
    return rows.where("n > 0").select("fp").distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 75, block: int = BLOCK) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest doc_id reachable by links. Equal sets are one class and linked.
    A row without words is linked with nothing and has its own doc_id. Null ids stay null unless a
    linked document has an id; rows that repeat an id are documents of their own. Other columns of
    ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows, links = similar_sets(docs, k, threshold, block, scratch)
    least = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = least.join(_roots(rows, links, scratch), "fp")
    component = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.table(classes.join(component, "root").select("fp", "component_id"), "classes")
    full = rows.where("n > 0").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 75) -> DataFrame:
    """One row of each component of ``docs``, all columns: that with the smallest doc_id, null ids last.

    Among rows with that id the one with the least hash of its text stays, and of these the one with the
    least hash of all columns. Rows without words, null texts among them, are linked with nothing and all
    stay. An empty table stays empty. No name of a further column clashes with anything here.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows, links = similar_sets(docs, k, threshold, scratch=scratch)
    name = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    least = rows.where("n > 0").groupBy("fp").agg(F.min(name).alias("name"))
    keep = least.join(_roots(rows, links, scratch), "fp").groupBy("root").agg(F.min("name").alias("name"))
    keep = scratch.table(keep.select(F.col("name.last").alias("last"), F.coalesce("name.doc_id", F.lit(0)).alias("id"), F.col("name.text_key").alias("key")), "kept")
    words = F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = as_row(docs)
    own = whole.where(words).withColumn("id", F.col("row.doc_id").cast("long")).withColumn("key", text_key(F.col("row.text")))
    own = own.withColumn("last", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0)))
    # the same columns join and group, so that texts are shuffled once
    kept = own.join(keep, ["last", "id", "key"], "left_semi").groupBy("last", "id", "key").agg(F.min_by("row", row_order(docs)).alias("row")).select("row")
    return kept.unionByName(whole.where(~words)).select("row.*")
