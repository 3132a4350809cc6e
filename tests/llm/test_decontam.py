import random
import re

import pytest

from seriesloom.llm.decontam import UNITS, contaminated, drop_contaminated

ITEM = "If Alice buys 12 kg of apples and then Alice sells 5 kg of them how many kg does Alice have left over now."
OTHER = ITEM.replace("Alice", "Bob").replace("12", "70").replace(" 5 ", " 9 ").replace("kg", "lb")
CLASH = "If Bob buys 70 lb of apples and then Carl sells 9 lb of them how many lb does Dora have left over now."
PASSAGE = "seven plain words make the passage that documents repeat here without any slot at all in it."


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, 0), (2, "short item here", 0), (3, PASSAGE, 0), (4, None, 0), (5, " . ", 0), (None, "null id item of words", 0), (3, PASSAGE, 0)], "item_id long, text string, total int")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, f"Intro words. {OTHER} And more."), (2, f"Intro words. {CLASH} And more."), (3, "well a SHORT item, here it is"), (4, None), (5, ""),
        (6, "nothing of the kind"), (None, OTHER.lower().replace("bob", "Bob")), (7, ("filler " * 40000) + PASSAGE.upper().replace("SEVEN", "seven")), (8, PASSAGE), (8, PASSAGE),
        (9, " ".join(PASSAGE.split()[:9])), (10, "null id item of words"),
    ]
    return spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, window int")


def test_pairs(docs, benchmark):
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in contaminated(docs, benchmark).collect())
    assert got == sorted([("1", 1), ("None", 1), ("3", 2), ("7", 3), ("8", 3)])


def test_rows_go_whole_and_clean_ones_stay(docs, benchmark):
    left = drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 9, 10]


def test_empty_tables(docs, benchmark):
    assert contaminated(docs.limit(0), benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0
    assert drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()


def test_items_of_slots_match_word_for_word_only(spark):
    mixed = "Now add 1 2 3 4 5 6 7 8 9 10 to the sum that they wrote on the big board there."
    items = [(1, "What is 12 + 7? 19"), (2, "Totals: 4 8 15 16 23 42 108 5 7 9"), (3, mixed)]
    rows = [
        (1, "Sum it up: What is 12 + 7? 19 it is"), (2, "Sum it up. What is 13 + 7? 20 it is"), (3, "the Totals: 4 8 15 16 23 42 108 5 7 9 again"), (4, "Totals: 4 8 15 16 23 42 109 6 7 9"),
        (5, mixed), (6, mixed.replace("5 6", "50 60")), (7, "they say What is 12 + 7? 19"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect())
    assert got == [(1, 1), (3, 2), (5, 3), (6, 3), (7, 1)]


def test_names_of_columns_do_not_clash(spark, benchmark):
    df = spark.createDataFrame([(1, PASSAGE, 1, 2, 3), (None, PASSAGE, 1, 2, 3), (2, "clean", 1, 2, 3)], "doc_id long, text string, _bad_id int, bad_id int, row int")
    assert [tuple(r) for r in drop_contaminated(df, benchmark).collect()] == [(2, "clean", 1, 2, 3)]


def brute_pairs(docs, items, window=8):
    """All windows of all items against all positions of all documents, word by word."""

    def words(text):
        out, stopped = [], True
        for raw in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            w = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", raw)
            opens, stopped = stopped, raw[-1] in ".!?:"
            if not w:
                continue
            if w[0].isdigit():
                out.append(("number", w.lower()))
            elif out and out[-1][0] == "number" and w.lower() in UNITS:
                out.append(("unit", w.lower()))
            elif w[0].isupper() and any(c.islower() for c in w) and not opens:
                out.append(("name", w.lower()))
            else:
                out.append((None, w.lower()))
        return out

    pairs = set()
    for item_id, item in items:
        a = words(item)
        k = min(window, len(a))
        if item_id is None or not k:
            continue
        exact = [2 * sum(t is not None for t, _ in a[i : i + k]) > k for i in range(len(a) - k + 1)]
        for doc_id, doc in docs:
            b, met = words(doc), set()
            for diagonal in range(-len(a) + k, len(b) - k + 1):
                mine, value = set(), {}
                for i in range(len(a) - k + 1):
                    if not 0 <= i + diagonal <= len(b) - k:
                        continue
                    pa, pb = a[i : i + k], b[i + diagonal : i + diagonal + k]
                    same = pa == pb if exact[i] else all(x == y if x[0] is None else x[0] == y[0] for x, y in zip(pa, pb, strict=True))
                    if same:
                        mine.add(i)
                        for x, y in zip(pa, pb, strict=True):
                            if exact[i] or x[0]:
                                value.setdefault(x[1], set()).add(y[1])
                if all(len(v) == 1 for v in value.values()):
                    met |= mine
            plain = exact.count(False)
            share = max(len(met) / len(exact), sum(not exact[i] for i in met) / plain if plain else 0)
            if met and share >= 0.5:
                pairs.add((doc_id, item_id))
    return pairs


@pytest.mark.parametrize("seed", range(3))
def test_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names, units = ["Alice", "Bob", "Carl"], ["kg", "km", "hours"]
    shapes = ["if {n} buys {d} {u} of the red apples and {n} sells {d} {u} how many are left with {m}", "then {n} and {m} drove {d} {u} and {d} {u} more to the old town", "{d} {d} {u} {n} {m} {d} {u} {n} {d}", "the plain passage of {d} words has no name in it but it says so itself"]

    def fill(shape):
        n, m = rng.sample(names, 2)
        return re.sub("{d}", lambda _: str(rng.randrange(1, 5)), shape).replace("{n}", n).replace("{m}", m).replace("{u}", rng.choice(units))

    items = [(i, fill(rng.choice(shapes))) for i in range(14)] + [(None, "x y z"), (50, "two words"), (51, "")]
    docs = []
    for i in range(60):
        parts = [fill(rng.choice(shapes)).split() for _ in range(rng.randrange(1, 3))]
        parts = [p[rng.randrange(0, 4) : len(p) - rng.randrange(0, 4)] for p in parts]
        docs.append((i, " filler words. ".join(" ".join(p) for p in parts)))
    docs += [(100, None), (101, "here two words stand")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_pairs(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 20
