"""Mixing, line dedup, sharding: against DuckDB over small tables with nulls, ties and repeats."""

import duckdb
import pandas as pd
import pytest

from seriesloom.llm import mixing
from seriesloom.llm import queries as Q
from seriesloom.llm.line_dedup import remove_spread_lines
from seriesloom.llm.mixing import mix_sources, mixed_documents
from seriesloom.llm.sharding import shard_documents, write_shards

LINE = "this line of boilerplate stands everywhere"


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(300):
        source = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}"
        text = "\n".join([f"own line number {i} with some words " * (1 + i % 5), LINE if i % 4 == 0 else "short", f"shared by few sites, group {i % 2}" if i % 50 < 3 else "x"])
        rows.append((i, text, "en", source, len(text), i))
    rows += [(7, rows[7][1], "en", "s0", 1, 0), (None, "no id here", "en", "s1", 1, 0), (400, None, "en", "s1", 0, 0), (401, "", "en", None, 0, 0), (402, "word " * 30000, "en", "s2", 0, 0), (403, None, None, "empty", 0, 0), (404, LINE, None, None, 0, 0), (405, LINE, None, "s3", 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")


def oracle(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.drop("size").toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE d AS SELECT doc_id, text, lang, source, n_chars FROM documents")
    con.unregister("documents")
    con.execute("ALTER TABLE d RENAME TO documents")
    return con.execute(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame):
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(norm_rows(a), key=key) == sorted(norm_rows(b), key=key)


def norm_rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if pd.isna(x) else x if isinstance(x, str) else round(float(x), 6) for x in r))
    return out


def test_mixing_matches_sql(docs):
    same(mix_sources(docs).toPandas(), oracle(Q.OP4_SQL, docs))


def test_mixing_meets_targets_and_limits(docs):
    out = mix_sources(docs).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    whole = mix_sources(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").toPandas()
    again = mix_sources(docs).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert out["target"].max() <= 2 * out["source_size"].max()
    assert len(whole) >= len(out) - 1


def test_mixed_documents_are_whole(docs):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {r["text"] for r in docs.select("text").collect()}
    rows = out.collect()
    assert all(r["text"] in texts for r in rows)
    assert max(sum(x["doc_id"] == i for x in rows) for i in range(0, 300, 17)) <= 2


def test_line_dedup_matches_sql(docs):
    unique = docs.where("doc_id is not null")
    same(remove_spread_lines(unique).toPandas(), oracle(Q.OP8_SQL, unique))


def test_line_dedup_near_and_far_thresholds(spark):
    lines = [f"a line that stands on {n} different sites" for n in (1, 2, 3, 4, 5, 9)]
    rows = [(i, "\n".join(x for x in lines if int(x.split()[5]) > i), f"site{i}") for i in range(9)]
    out = {r["doc_id"]: r for r in remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=4).collect()}
    assert out[0]["text"].split("\n") == lines[:3] and out[0]["n_removed"] == 3 and out[8]["text"] == ""


@pytest.mark.parametrize("limit", [200, 5000, 64 << 20])
def test_sharding_matches_sql(docs, limit):
    same(shard_documents(docs, limit).toPandas(), oracle(Q.OP10_SHARD.replace("{limit}", str(limit)), docs))


def test_shards_fit(docs):
    out = shard_documents(docs, 5000).toPandas()
    sums = out.groupby("shard")["n_bytes"].agg(["sum", "count"])
    big = sums[sums["sum"] > 5000]
    assert (big["count"] == 1).all()
    assert out["oversize"].sum() == big["count"].sum()
    bits = sorted(out["shard"].unique())
    assert not any(b.startswith(a) for a, b in zip(bits, bits[1:], strict=False))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    for f in (mix_sources, mixed_documents, remove_spread_lines, shard_documents):
        assert f(none).count() == 0


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing again and again what stopped sources leave."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = over
    return target


@pytest.mark.parametrize("bins", [(512, 12), (4, 2)])
def test_targets_and_cuts_against_repeated_resharing(spark, docs, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BIN", bins[0])
    monkeypatch.setattr(mixing, "GROUP_BITS", bins[1])
    out = mix_sources(docs).toPandas()
    by = docs.select("doc_id", "source", "text").toPandas()
    count = by["text"].map(lambda t: len((t or "").split()))
    sizes = {(None if pd.isna(s) else s): int(n) for s, n in count.groupby(by["source"].fillna("~null")).sum().rename(index={"~null": None}).items()}
    want = reshared(sizes)
    assert len(out) == docs.count() and (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    for size, part in out.groupby("source_size"):
        names = [s for s, n in sizes.items() if n == size]
        if len(names) == 1:
            assert part["target"].iloc[0] == pytest.approx(want[names[0]])
            assert part["taken"].sum() == int(part["target"].iloc[0])


def test_shards_are_written_whole_and_once(spark, tmp_path):
    rows = [(1, "a" * 40, 1), (1, "b" * 30, 2), (2, "c" * 40, 3), (2, "d" * 30, 4), (2, "d" * 30, 4), (None, None, 5), (None, "", 6), (3, "e" * 500, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cell int")
    write_shards(df, f"{tmp_path}/a", 60)
    back = spark.read.parquet(f"{tmp_path}/a")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    sizes = back.selectExpr("shard", "octet_length(coalesce(text, '')) n", "coalesce(text, '') t").groupBy("shard").agg({"n": "sum", "t": "collect_set"}).collect()
    assert len(sizes) > 2 and all(r["sum(n)"] <= 60 or len(r["collect_set(t)"]) == 1 for r in sizes)
    write_shards(df, f"{tmp_path}/b")
    assert {r["shard"] for r in spark.read.parquet(f"{tmp_path}/b").select("shard").collect()} == {"all"}
    with pytest.raises(ValueError, match="shard"):
        write_shards(df.withColumn("shard", df["cell"]), f"{tmp_path}/c")
