"""Runs against a quadratic search; rows against a plain reading of the contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from seriesloom.llm import periodic_runs as P


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def sequence(rng):
    k, w, size = rng.choice([1, 2, 2, 3, 5]), [], rng.choice([30, 60, 150, 300])
    while len(w) < size:
        c = rng.random()
        if c < 0.4:
            w += ([rng.randrange(k) for _ in range(rng.randint(1, 12))] * 30)[: rng.randint(1, 120)]
        elif c < 0.8 and w:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 150)]
        else:
            w += [rng.randrange(k + 5) for _ in range(rng.randint(1, 10))]
    return w


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_runs_match_a_plain_search(monkeypatch, pairs):
    monkeypatch.setattr(P, "PAIRS", pairs)
    rng, found = random.Random(7), 0
    for _ in range(400):
        w = sequence(rng)
        want = plain_runs(w)
        assert P.long_runs(np.array([*w, 10**6])) == want
        found += len(want)
    assert found > 300


def test_parts_of_the_method():
    rng = random.Random(2)
    for _ in range(60):
        w = [*sequence(rng), 10**6]
        s, n = np.array(w), len(w)
        tables = P.rank_tables(s)
        order = sorted(range(n), key=lambda i: w[i:])
        assert np.argsort(tables[-1]).tolist() == order
        share = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), n)  # noqa: E731, B023
        lcp = np.array([0] + [share(a, b) for a, b in zip(order, order[1:])])
        length, source = P.previous_factors(np.array(order), lcp)
        for i in range(n):
            best = max((share(i, j) for j in range(i)), default=0)
            assert length[i] == best and (not best or (source[i] < i and share(i, source[i]) == best))
        x, y = np.array(rng.sample(range(n), 20)), np.array(rng.sample(range(n), 20))
        x, y = x[x != y], y[x != y]
        assert P.common_ahead(tables, x, y).tolist() == [share(a, b) for a, b in zip(x, y)]
        behind = lambda i, j: next(k for k in range(n) if min(i, j) - k <= 0 or w[i - k - 1] != w[j - k - 1])  # noqa: E731, B023
        assert P.common_behind(tables, x, y).tolist() == [behind(a, b) for a, b in zip(x, y)]


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    kept = [x for i, x in enumerate(w) if not any(a + q <= i < b for a, b, q in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), sha(" ".join(kept)))


def test_rows_match_the_contract(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in sequence(rng)) for _ in range(120)]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "x", 0), (3, texts[4], "x", 0), (None, texts[2], "x", 0), (None, None, None, None), (200, None, "x", 0), (201, "", "x", 0), (202, " \t\n", "x", 0), (-7, "Ab aB\tab\x0b" * 40, "x", 1), (203, " é " * 30, "x", 1), (204, "same " * 3000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, period long").repartition(3)
    out = P.periodic_runs(docs)
    assert out.columns == P._NAMES
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str(plain_row(i, t)) for i, t, *_ in rows)
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_whole_table(spark):
    from seriesloom.llm.queries import op12_periodic_runs

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    small = {d.doc_id: d.text for d in docs if len(d.text or "") < 4000}
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 5
    assert all(got[i] == plain_row(i, t) for i, t in small.items())
