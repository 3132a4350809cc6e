import random

import pytest

from seriesloom.llm._graph import connected_components
from seriesloom.llm._store import Scratch


@pytest.mark.parametrize("piece", [1 << 18, 40])
def test_components_match_union_find(spark, piece):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 90)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    edges += [(None, 1), (2, None), (77, 77), (-5, -9)] + edges[:20]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    out = connected_components(df, Scratch(spark, "t"), piece)
    assert sorted(tuple(r) for r in out.collect()) == sorted((x, root(x)) for x in list(parent))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_rounds_that_run_out_are_an_error(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long").repartition(8)
    with pytest.raises(RuntimeError, match="converged"):
        connected_components(df, Scratch(spark, "t"), 8, most_rounds=1)
