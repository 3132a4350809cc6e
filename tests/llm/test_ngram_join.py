import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import ngram_join as N
from seriesloom.llm.ngram_join import drop_near_duplicates, jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=0, groups=12, copies=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = " ".join(rng.choices(words, k=30))
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 8, 40, 120, 300]))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
            if rng.random() < 0.3:
                text += " " + passage
            rows.append((n, text))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One Two"), (n + 4, "one two"), (None, rows[0][1]), (3, rows[3][1]), (3, "something else entirely in this row")]
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_components_match_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, fp int")
    out = jaccard_components(df, block=block)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_beyond_one_block_and_hot_tokens(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(5000)]
    base = rng.choices(words, k=60)
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            own[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(N, "HOT_POSTINGS", 8)
    out = jaccard_components(df, block=16)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_sets_of_hot_tokens_stay_in_one_cluster(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"h{i}" for i in range(100000)]
    texts = []
    for _ in range(6):
        base = rng.choices(words, k=204)
        texts += [base] * 60
        texts += [base[: 204 - cut] for cut in (10, 25, 45)] + [base + rng.choices(words, k=more) for more in (15, 40, 60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(N, "HOT_POSTINGS", 8)
    assert sorted((tuple(r) for r in jaccard_components(df).collect()), key=str) == brute(rows)


def test_small_salted_buckets_are_chained_whatever_the_sizes():
    token, salt = np.zeros(4, np.int64), np.array([1, 1, 1, 2])
    traits, fp = (np.array([10, 100, 1000, 50]) << 24) | (3 << 12) | salt, np.array([5, 6, 7, 8])
    out = N._bucket_edges(75)(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in (token, traits, fp)], ["token", "traits", "fp"])]))
    edges = {(r["u"], r["v"], r["need"]) for part in out for r in part.to_pylist()}
    assert edges == {(5, 6, 0), (6, 7, 0), (0, 5, -1), (0, 8, -1)}


def test_one_row_of_each_component_stays_whole(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, other int")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = kept.toPandas()
    least = {c for _, n, c in brute(rows) if n}
    words = got[got["text"].fillna("").str.strip() != ""]
    assert sorted(words["doc_id"]) == sorted(least | {3} if 3 in least else least | set()) or set(words["doc_id"]) >= least
    assert (got["text"].fillna("").str.strip() == "").sum() == 3
    again = brute([(r.doc_id, r.text) for r in words.itertuples()])
    assert len({c for _, _, c in again}) == len({(d, c) for d, _, c in again})


def test_prefixes_keep_the_threshold():
    for n in range(1, 60):
        for m in (1, 2, 5):
            if m <= N.least_overlap(n, 75):
                assert n - N.prefix_length(n, 75, m) == N.least_overlap(n, 75) - m


def test_matches_grow_with_cost():
    cheap = N.choose_matches(np.zeros(200, np.float32), 400, 75)
    dear = N.choose_matches(np.full(200, 50, np.float32), 400, 75)
    assert 1 <= cheap <= dear


def test_shared_counts():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 4], [9], [])]
    out = N.shared_counts(sets)
    assert out[0, 1] == 2 and out[0, 2] == 0 and out[3].sum() == 0


def test_names_of_columns_do_not_clash_and_reruns_agree(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, i, i, i) for i in range(6)] + [(2, text, 9, 9, 9), (3, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep_key int, keep_id int, id int")
    first = drop_near_duplicates(df).collect()
    assert sorted(r["doc_id"] for r in first) == [1, 3]
    assert sorted(map(str, first)) == sorted(map(str, drop_near_duplicates(df.repartition(5)).collect()))


def test_copies_of_a_set_count_once_in_a_bucket():
    token, fp = np.zeros(12, np.int64), np.repeat([5, 6], 6)
    traits = np.full(12, (20 << 24) | (3 << 12))
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (token, traits, fp)], ["token", "traits", "fp"])
    for batches in ([rows], [rows.slice(0, 3), rows.slice(3, 5), rows.slice(8)]):
        out = [r for part in N._bucket_edges(75)(iter(batches)) for r in part.to_pylist()]
        assert out == [{"u": 5, "v": 6, "shared": 1, "need": 3}]


def test_a_cluster_chained_by_a_poor_order_falls_apart(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"p{i}" for i in range(50000)]
    passage = rng.choices(words, k=25)
    rows = [(i, " ".join(passage + rng.choices(words, k=60))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(5)]
    sketch, poor, met = N._sum_sketch, [True], []

    # the first order does not know a token from another
    monkeypatch.setattr(N, "_sum_sketch", lambda chunks, bits: np.ones(1 << bits, np.int32) if poor and poor.pop() else sketch(chunks, bits))
    monkeypatch.setattr(N, "_rest", lambda large, links, *a, rest=N._rest: met.append(large.count()) or rest(large, links, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_components(df, block=16).collect()), key=str) == brute(rows)
    assert met == []


def test_a_token_of_a_few_sets_is_told_from_one_of_a_single_set():
    rng = np.random.default_rng(4)
    shared = np.unique(rng.integers(0, 1 << 63, 2000, np.int64).view(np.uint64) << np.uint64(1))
    slots, parts = N._Slots(), {}
    for _ in range(8):
        slots.add(rng.integers(0, 1 << 63, 2_000_000, np.int64).view(np.uint64) << np.uint64(1))
        slots.add(shared)
        for part, gaps in zip(*slots.out(), strict=True):
            parts.setdefault(part.as_py(), []).append(gaps)
    found = np.zeros(1 << N.SKETCH_BITS, np.uint8)
    for part, gaps in parts.items():
        rows = pa.RecordBatch.from_arrays([pa.array([part] * len(gaps), pa.int32()), pa.array([x.as_py() for x in gaps])], ["part", "gaps"])
        (out,) = N._add_slots(N.SKETCH_BITS)(iter([rows]))
        width = len(found) >> N.PART_BITS
        found[part * width : (part + 1) * width] = np.frombuffer(out.column(1)[0].as_py(), np.uint8)
    at = (shared >> np.uint64(64 - N.SKETCH_BITS)).astype(np.int64)
    # eight sets have each of these; in 2**21 slots the eight singles that share each would hide them
    assert (found[at] >= 20).all() and (found > 0).mean() < 0.02
    order = N._Order(found)
    mixed = np.sort(np.concatenate([shared[:100], rng.integers(0, 1 << 63, 300, np.int64).view(np.uint64) << np.uint64(1)]))
    arranged, _, costs = order.arrange(mixed, 75)
    assert not np.isin(arranged[:280], shared).any() and not costs[:90].any()


def test_shuffle_files_go_with_the_step_that_made_them(spark):
    def names():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = names()
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 10).alias("k")).count()
    assert len(N.Scratch(spark, "t").table(df).collect()) == 10
    for _ in range(50):  # they go in the background
        if not names() - before:
            break
        time.sleep(0.1)
    assert not names() - before
