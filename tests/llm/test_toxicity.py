import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import toxicity
from seriesloom.llm.toxicity import Model, drop_toxic, grammar, least_ratio, read_clause, score_toxicity


def reading(classes):
    return {name for name, _ in read_clause(classes) if name}


def test_readings_of_clauses():
    assert reading("oio") == {"plain"}
    assert reading("yoi") == {"targeted"} and reading("ioy") == {"targeted"}
    assert reading("noi") == {"negated"} and reading("nooooi") == {"plain"}
    assert reading("rooi") == {"reported"}
    assert reading("toy") == {"threat"} and reading("ty") == {"threat"}
    assert reading("to") == set() and reading("tooooy") == set()
    assert reading("nty") == set() and reading("oooo") == set()


def test_two_insults_are_both_read():
    assert [name for name, _ in read_clause("ioooooi")] == ["plain", "", "", "", "", "", "plain"]
    assert grammar().best("") == (0.0, [])


def test_path_weights_order_the_readings():
    weight = {name: sum(w for _, w in read_clause(c, (4,))) for name, c in {"plain": "oio", "targeted": "yoi", "after": "ioy", "negated": "noi", "reported": "roi"}.items()}
    assert weight["targeted"] == weight["after"] > weight["plain"] > weight["reported"] > weight["negated"] == 0
    assert read_clause("oi", (8,))[1] == ("plain", 4.0) and read_clause("ii", (2, 6)) == (("plain", 1.0), ("plain", 3.0))
    long = "i" + "o" * 100 + "i"
    assert read_clause(long, (2, 4))[-1] == ("plain", 2.0)


@pytest.mark.parametrize("seed", range(20))
def test_best_path_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    symbols = "".join(rng.choice(list("oitynr"), rng.integers(1, 7)))
    scales = [float(rng.integers(1, 5)) if c == "i" else 1.0 for c in symbols]
    g = grammar()
    paths = [(0.0, g.start)]
    for c, scale in zip(symbols, scales, strict=True):
        paths = [(w + v * scale, nxt) for w, state in paths for read, _, v, nxt in g.arcs[state] if read == c]
    best = max(w for w, state in paths if state not in g.owing)
    got, out = g.best(symbols, scales)
    assert got == pytest.approx(best) and sum(w for _, w in out) == pytest.approx(best)


def test_more_readings_never_lower_a_score():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(300, 3)))
    model = Model(np.zeros(0, np.uint64), np.zeros(0))
    model.fit(x, (x[:, 0] - x[:, 1] > 0).astype(float))
    assert (model.coefficients[:-1] >= 0).all() and model.coefficients[0] > 0 and model.coefficients[1] == 0
    assert model.features(pa.array(["a b", None, ""])).sum() == 0


def test_least_ratio_counts_features_that_can_reach_it():
    assert least_ratio({}, 0.1) == 0.0
    assert least_ratio({1: 10**9, 20: 100, 400: 1}, 0.1) == pytest.approx(2 * np.log(102))


@pytest.fixture(scope="module")
def tables(spark):
    clean = "the weather in the valley was mild and the river ran quietly past the mill"
    docs, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        word = ["florp", "gribblesnout", "gribbletail"][i % 3]
        text = clean if not bad else clean.replace("river", f"you {word} river").replace("mill", f"{word} mill")
        docs.append((i, f"{text} {i}"))
        if i % 5:
            labels.append((i, 1, int(bad)))
    docs += [(900, None), (901, ""), (902, "you gribblehead"), (None, "florp florp"), (903, ("mild " * 50000) + "florp."), (0, clean)]
    labels += [(None, 1, 1), (4, 0, 0), (555, 1, None)]
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(tables):
    docs, labels = tables
    out = score_toxicity(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= 0.3)).all()
    known = out[(out["doc_id"] < 240) & (out["doc_id"] != 0)]
    assert (known["predicted"] == (known["doc_id"] % 4 == 0)).all()
    by = out.dropna(subset=["doc_id"]).groupby("doc_id")["predicted"].max()
    assert by[900] == by[901] == 0 and by[902] == 1 and by[903] == 1


def test_toxic_rows_go(tables):
    docs, labels = tables
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 1 in ids and 4 not in ids and 900 in ids and 0 in ids


def test_meaning_decides_in_whole_documents(spark, monkeypatch):
    """Insults said plainly make a document toxic, the same insults negated or reported do not."""
    base = ["the mill was quiet", "rain fell on the valley", "they went home before dusk"]
    plain, other = ["you {}", "a {} they are", "{}", "a {}"], ["he is not a {} at all", "they said the man was a {}", "never a {}", "she wrote that he was a {}"]
    rng, docs, labels = np.random.default_rng(3), [], []
    for i in range(900):
        insult, meant = rng.random() < 0.5, rng.random() < 0.6
        word = rng.choice(["florp", "zorgle", "quimble"] if insult else ["painter", "farmer", "singer"])
        lines = [rng.choice(base), rng.choice(plain if meant else other).format(word), rng.choice(base)]
        docs.append((i, ". ".join(lines) + f". {i}"))
        labels.append((i, int(insult and meant)))
    docs += [(9000 + j, f"rain fell on the valley. {x}. they went home") for j, x in enumerate(["he is a florp", "he is not a florp", "they said he is a florp", "you are a florp", "rain fell"])]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}

    def errors(rows):
        return sum(r["predicted"] != truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth)

    rows = score_toxicity(docs, labels).collect()
    by = {r["doc_id"]: r["score"] for r in rows}
    plain, negated, reported, targeted, none = (by[9000 + j] for j in range(5))
    assert targeted >= plain > reported >= negated == none
    assert plain >= 0.3 > reported
    assert errors(rows) <= 5


def test_grammar_against_its_ablation(monkeypatch):
    """Without the grammar the same lexicon cannot tell what is said from what is denied."""
    words = ["florp", "zorgle"]
    raw = "".join(words).encode()
    keys = toxicity.K.span_hashes(np.frombuffer(raw, np.uint8), np.array([0, 5]), np.array([5, 11]))
    texts = ["a florp he is", "you zorgle", "not a florp", "they said zorgle", "never zorgle", "florp"] * 20
    y = np.array([1, 1, 0, 0, 0, 1] * 20, float)

    def wrong():
        model = Model(np.sort(keys), np.full(2, 3.0))
        x = model.features(pa.array(texts))
        model.fit(x, y)
        return int(((model.scores(pa.array(texts)) >= 0.5) != y).sum())

    assert wrong() == 0
    monkeypatch.setattr(toxicity, "read_clause", lambda classes, levels: tuple(("plain", 3.0) if c == "i" else ("", 0.0) for c in classes))
    assert wrong() >= 40


def test_without_labels(tables):
    docs, labels = tables
    out = score_toxicity(docs, labels.limit(0)).toPandas()
    assert (out["score"] == 0).all()
    assert drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_rows_that_share_an_id_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, x, y: seen.append(len(y)))
    docs = spark.createDataFrame([(i % 5, f"text number {i}") for i in range(300)] + [(1, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    toxicity.learn(docs, labels, toxicity.Scratch(spark, "t"))
    known = spark.range(5).where(toxicity.fold(F.col("id")) != 2).count()
    assert seen == [known]
