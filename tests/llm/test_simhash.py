"""SimHash components against all pairs; the parts of the probing against plain counts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from seriesloom.llm import simhash as S
from seriesloom.llm._kernel import text_chunks
from seriesloom.llm._store import Scratch


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [least.get(root(f)) for f in fps]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def texts(rng):
    words = [f"w{i}" for i in range(400)] + ["Ünd", "ÀB", "UPPER"]
    out = [None, "", " \t\n", "one", "one two", "one two three", "ONE two", "a" * 500, "x y " * 9000, "same same same"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([20, 80, 300]))]
        out.append("\t ".join(base))
        for _ in range(rng.randrange(4)):
            again = list(base)
            again[rng.randrange(len(again))] = rng.choice(words)
            out.append(" ".join(again).upper() if rng.random() < 0.3 else " ".join(again))
    return out


def test_fingerprints(monkeypatch):
    column = texts(random.Random(2))
    want = [plain_fingerprint(t) for t in column]
    for size in (1 << 17, 7):
        monkeypatch.setattr(S, "_SLICE", size)
        rows = [t for t in column if size > 7 or len(t or "") < 3000]
        got = np.concatenate([S.fingerprints(raw, bounds) for _, _, raw, bounds in text_chunks(pa.array(rows, pa.string()), 5000)])
        assert got.tolist() == [w for w, t in zip(want, column, strict=True) if t in rows]


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_components_match_all_pairs(spark, hot):
    column = texts(random.Random(4))
    ids = [i * 3 % 1001 for i in range(len(column))]
    ids[5] = ids[20] = None
    ids[7] = ids[8]
    docs = spark.createDataFrame(list(zip(ids, column, ["x"] * len(ids), [0] * len(ids), strict=True)), "doc_id long, text string, fp string, root long").repartition(4)
    fps = [plain_fingerprint(t) for t in column]
    want = sorted(map(str, zip(ids, (f"{f:016x}" for f in fps), plain_components(ids, fps), strict=True)))
    assert sorted(map(str, (tuple(r) for r in S.simhash_components(docs, hot).collect()))) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(docs).count() == 0


def cloud(rng, n):
    """Fingerprints around a few centres, with correlated bits, and single ones."""
    out = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n // 6):
            x = centre
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.choice([*range(0, 64, 3), *range(12)])
            out.add(x)
    return sorted(out | {rng.getrandbits(64) for _ in range(n // 3)})


@pytest.mark.parametrize("hot", [S.HOT, 8])
@pytest.mark.parametrize("parts", S.PARTS)
def test_links_connect_what_all_pairs_connect(spark, parts, hot):
    fps = cloud(random.Random(parts), 900)
    sigs = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    groups = S.correlated_parts(S.bit_correlations(sigs), parts)
    assert sorted(b for g in groups for b in g) == list(range(64)) and max(map(len, groups)) - min(map(len, groups)) <= 1
    counts = S.value_counts(sigs, groups, 1 << 12)
    assert counts.sum(1).tolist() == [len(fps)] * parts
    links = [tuple(r) for r in S.near_links(sigs, groups, counts, Scratch(spark, "t"), hot).collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 for u, v in links)
    parent = {signed(f): signed(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    classes = {}
    for f in fps:
        classes.setdefault(root(signed(f)), []).append(f)
    want = plain_components(range(len(fps)), fps)
    assert sorted(len(c) for c in classes.values()) == sorted(want.count(x) for x in set(want))
    if hot == S.HOT and all(c <= hot for c in (len({f for f in fps if f & int(S._mask(g)) == k}) for g in groups for k in {f & int(S._mask(g)) for f in fps})):
        near = {(signed(a), signed(b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
        assert {p for u, v in links for p in ((u, v), (v, u))} == near  # every pair is met, not only connected


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(5)
    for parts in (2, 3, 4):
        costs = np.concatenate([np.zeros((parts, 1, 50)), rng.random((parts, 3, 50)).cumsum(1)], 1)
        got = S.allocate(costs, 3)
        assert (got.sum(0) == 3 - parts).all()
        every = [c for c in np.ndindex(*[4] * parts) if sum(c) == 3]
        for j in range(50):
            mine = sum(costs[i, got[i, j] + 1, j] for i in range(parts))
            assert mine == pytest.approx(min(sum(costs[i, u, j] for i, u in enumerate(c)) for c in every))


def test_whole_table(spark):
    from seriesloom.llm.queries import op11_simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    want = sorted(zip((d.doc_id for d in docs), (f"{f:016x}" for f in fps), plain_components([d.doc_id for d in docs], fps), strict=True))
    assert sorted(tuple(r) for r in op11_simhash(spark, "/root/testdata/sf0.001").collect()) == want
