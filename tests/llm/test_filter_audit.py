"""The audit against DuckDB over a table with nulls, ties, repeats and clashing names; its kernels against plain Python."""

import random
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import _kernel, filter_audit
from seriesloom.llm import queries as Q
from seriesloom.llm.filter_audit import audit_filters, distinct_words


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        n = rng.choice([0, 5, 99, 100, 101, 250])
        pool = rng.choice([10, 85, 400])
        text = " ".join(rng.choice(["word", "Word", "wörd", "UP"]) + str(rng.randrange(pool)) for _ in range(n)) + rng.choice(["", "", " $", "|", "  ", " É ÀB"])
        rows.append((i, text, rng.choice(["en", "de", None, ""]), "s", i, 1))
    rows += [(300 + i, rows[i % 7][1], rng.choice(["en", "fr"]), None, 0, 2) for i in range(90)]
    rows += [(3, rows[3][1], "en", "s", 0, 3), (None, rows[5][1], "en", "s", 0, 3), (None, None, None, None, None, None), (500, None, "en", "s", 0, 0), (501, "", "de", "s", 0, 0), (502, "w " * 40000, "de", "s", 0, 0), (503, "X" * 5000, "de", "s", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, marks long").repartition(5)
    labels = spark.createDataFrame([(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 320, 2)] + [(4, 0, 1), (4, 1, None), (None, 1, 1)], "doc_id long, quality long, toxic long")
    return docs, labels


def test_matches_sql(tables):
    docs, labels = tables
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype("Int64"))
    want = con.execute(Q.OP13_SQL).df()
    got = audit_filters(docs, labels).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
    assert len(got) == got["part"].nunique() * 600
    one = got[got["filter_order"] == "EDCBA"].groupby("part").agg({"removed": "sum", "kept": "min"})
    total = docs.toPandas()["lang"].fillna("").value_counts()
    assert (one["removed"] + one["kept"]).to_dict() == total.to_dict()


def test_a_filter_loses_in_all_orders_what_its_share_says(tables):
    got = audit_filters(*tables).toPandas()
    got["letter"] = [o[s - 1] for o, s in zip(got["filter_order"], got["step"], strict=True)]
    for (_, _), part in got.groupby(["part", "letter"]):
        assert part["shapley"].nunique() == 1 and part["removed"].sum() == part["shapley"].iloc[0]


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert audit_filters(docs.limit(0), labels).count() == 0
    assert audit_filters(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_hashes_are_verified(monkeypatch):
    texts = ["a b a", "", "c d e f", "a a"]
    column = pa.array(texts)
    monkeypatch.setattr(filter_audit, "span_hashes", lambda raw, s, e, lower: np.zeros(len(s), np.uint64))
    for _, _, raw, bounds in _kernel.text_chunks(column):
        assert distinct_words(raw, *_kernel.word_bounds(raw, bounds)).tolist() == [2, 0, 4, 1]
    monkeypatch.setattr(_kernel, "span_hashes", lambda raw, s, e, lower: np.zeros(len(s), np.uint64))
    for _, _, raw, bounds in _kernel.text_chunks(column):
        s, e, _ = _kernel.word_bounds(raw, bounds)
        assert len(set(_kernel.word_ids(raw, s, e).tolist())) == 6


def test_spans_and_joined_words():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "abc", "é", "x" * 70]) for _ in range(rng.randrange(8))) + rng.choice(["", " ", "\t\n"]) for _ in range(40)]
    for _, _, raw, bounds in _kernel.text_chunks(pa.array(texts)):
        s, e, of_row = _kernel.word_bounds(raw, bounds)
        text, a, b = _kernel.joined_words(raw, s, e, of_row)
        for r in range(len(bounds) - 1):
            lo, hi = of_row[r], of_row[r + 1]
            row = text[a[lo] : b[hi - 1]].tobytes().decode() if hi > lo else ""
            assert row == " ".join(raw[bounds[r] : bounds[r + 1]].tobytes().decode().split())
        x = np.array([rng.randrange(len(s)) for _ in range(500)])
        y = np.array([rng.randrange(len(s)) for _ in range(500)])
        n = np.minimum(e[x] - s[x], e[y] - s[y])
        want = [raw[p : p + k].tobytes() == raw[q : q + k].tobytes() for p, q, k in zip(s[x], s[y], n, strict=True)]
        for most in (5, 64, 1 << 20):
            assert _kernel.spans_equal(raw, s[x], s[y], n, most).tolist() == want


def test_all_orders():
    assert {s[0] for s in filter_audit._steps()} == {"".join(p) for p in permutations("ABCDE")} and len(filter_audit._steps()) == 600
