"""Toxicity by a weighted finite-state grammar over clauses.

Insult words and stems are learned from labels: features whose association with toxic documents is
beyond chance. A clause is read as a string of token classes by the composition of five transducers:
negation, reported speech, target, threat and insult. Each rewrites what stands within its reach, and
the best path says how every insult or threat of the clause is meant and what it weighs: the insult's
own weight times that of the arcs that read it. No word counts outside its clause. A document's score
comes from the summed path weights of its clauses, and the summed heaviest reading of each of its
distinct insults, each in bands of the insults' weights, by a logistic model whose coefficients are kept
from being negative: an insult that is negated or reported never weighs more than one said plainly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import _kernel as K
from seriesloom.llm._store import Scratch
from seriesloom.llm.langid import HashArray, fold

#: Most labelled rows, by hash order, that the lexicon and the logistic model are fitted on.
LABELLED_ROWS = 20000
LEAST_PRECISION = 0.5
#: Lexicon weights are read in steps of this many nats.
STEP = 0.5
#: Bounds, in nats, between insults that toxic documents have more and those that almost only they have.
BANDS = (5.0,)
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

# Small closed classes of English, German, French and Spanish.
TARGETS = "you your yours yourself u ur du dich dir dein deine deinen euch ihr tu toi te ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine keinen nie niemals pas jamais aucun aucune ni nunca jamás ningún ninguna".split()
REPORTS = "said says say called calls reported reports quoted quotes alleged claims claimed wrote sagte sagt nannte behauptet schrieb disait dit appelé écrit cité dijo dice llamó escribió citó".split()
THREATS = "kill hurt destroy murder stab shoot strangle töten umbringen verletzen zerstören erschießen tuer blesser détruire assassiner frapper matar herir destruir asesinar golpear".split()

# Token classes read, and the readings that the grammar writes.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oitynr"
READINGS = {"i": "plain", "j": "targeted", "n_i": "negated", "r_i": "reported", "k": "threat"}
REACH = 3
#: Longest clause, in tokens around what it marks, whose reading is kept for the next like it.
KEPT_CLAUSE = 64


class Wfst:
    """A weighted transducer: arcs (input, output, weight, next state) by state; ``owing`` states are not final."""

    def __init__(self, arcs: dict[object, list[tuple[str, str, float, object]]], start: object, owing: frozenset = frozenset()):
        self.arcs, self.start, self.owing = arcs, start, owing

    def compose(self, other: Wfst) -> Wfst:
        """Read with this machine, then with ``other``; weights add."""
        start = (self.start, other.start)
        arcs: dict[object, list] = {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            a, b = state
            out = arcs[state] = []
            for read, mid, w, na in self.arcs[a]:
                for mid2, write, v, nb in other.arcs[b]:
                    if mid == mid2:
                        out.append((read, write, w + v, (na, nb)))
                        todo.append((na, nb))
        return Wfst(arcs, start, frozenset(s for s in arcs if s[0] in self.owing or s[1] in other.owing))

    def best(self, symbols: str, scales: list[float] | None = None) -> tuple[float, list[tuple[str, float]]]:
        """Weight of the best path, the first of equals, and the output and weight of each of its arcs.

        An arc's weight counts times the scale of the symbol that it reads.
        """
        paths: dict[object, float] = {self.start: 0.0}
        trail: list[dict[object, tuple[object, str, float]]] = []
        for at, s in enumerate(symbols):
            scale = 1.0 if scales is None else scales[at]
            step: dict[object, float] = {}
            came: dict[object, tuple[object, str, float]] = {}
            for state, w in paths.items():
                for read, write, v, nxt in self.arcs[state]:
                    if read == s and (nxt not in step or w + v * scale > step[nxt]):
                        step[nxt], came[nxt] = w + v * scale, (state, write, v * scale)
            paths = step
            trail.append(came)
        ends = {state: w for state, w in paths.items() if state not in self.owing}
        if not ends:
            return float("-inf"), []
        state = max(ends, key=ends.get)
        total, out = ends[state], []
        for came in reversed(trail):
            state, write, w = came[state]
            out.append((write, w))
        return total, out[::-1]


def _identity(symbols, nxt, but=()):
    return [(s, s, 0.0, nxt) for s in symbols if s not in but]


@lru_cache(1)
def grammar() -> Wfst:
    """Negation, reported speech, threat, target and insult, composed in this order."""
    read = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]
    negation = {}
    for left in range(REACH + 1):
        after = max(0, left - 1)
        negation[left] = _identity(read, after, (NEGATION, INSULT, THREAT) if left else (NEGATION,)) + [(NEGATION, OTHER, 0.0, REACH)]
        if left:
            negation[left] += [(INSULT, "n_i", 0.0, after), (THREAT, OTHER, 0.0, after)]
    mid = [OTHER, INSULT, THREAT, TARGET, REPORT, "n_i"]
    report = {
        0: _identity(mid, 0, (REPORT,)) + [(REPORT, OTHER, 0.0, 1)],
        1: _identity(mid, 1, (REPORT, INSULT, THREAT)) + [(REPORT, OTHER, 0.0, 1), (INSULT, "r_i", 0.0, 1), (THREAT, OTHER, 0.0, 1)],
    }
    mid = [OTHER, INSULT, THREAT, TARGET, "n_i", "r_i"]
    # a threat counts if a target follows within reach: guess, then keep the promise
    threat: dict[object, list] = {0: _identity(mid, 0, (THREAT,)) + [(THREAT, OTHER, 0.0, 0), (THREAT, "k", 1.0, REACH)]}
    for left in range(1, REACH + 1):
        threat[left] = [(TARGET, TARGET, 0.0, 0)]
        if left > 1:
            threat[left] += _identity(mid, left - 1, (TARGET, THREAT))
    mid = [OTHER, INSULT, TARGET, "n_i", "r_i", "k"]
    # an insult is aimed if a target stands within reach before it, or after it
    target: dict[object, list] = {("before", 0): [], **{("before", n): [] for n in range(1, REACH + 1)}}
    for n in range(REACH + 1):
        after = ("before", max(0, n - 1))
        target["before", n] = _identity(mid, after, (TARGET, INSULT)) + [(TARGET, OTHER, 0.0, ("before", REACH))]
        target["before", n] += [(INSULT, "j", 0.25, after)] if n else [(INSULT, "i", 0.0, after), (INSULT, "j", 0.25, ("owes", REACH))]
    for n in range(1, REACH + 1):
        target["owes", n] = [(TARGET, OTHER, 0.0, ("before", REACH))]
        if n > 1:
            target["owes", n] += _identity(mid, ("owes", n - 1), (TARGET, INSULT)) + [(INSULT, "j", 0.25, ("owes", n - 1))]
    insult = {0: [(OTHER, "", 0.0, 0), (TARGET, "", 0.0, 0), ("i", "i", 1.0, 0), ("j", "j", 1.0, 0), ("n_i", "n_i", 0.0, 0), ("r_i", "r_i", 0.25, 0), ("k", "k", 2.0, 0)]}
    threats = Wfst(threat, 0, frozenset(range(1, REACH + 1)))
    targets = Wfst(target, ("before", 0), frozenset(("owes", n) for n in range(1, REACH + 1)))
    return Wfst(negation, 0).compose(Wfst(report, 0)).compose(threats).compose(targets).compose(Wfst(insult, 0))


def _read(classes: str, levels: tuple[int, ...]) -> tuple[tuple[str, float], ...]:
    scale = iter(levels)
    _, out = grammar().best(classes, [STEP * next(scale) if c == INSULT else 1.0 for c in classes])
    return tuple((READINGS.get(write, ""), w) for write, w in out)


_read_kept = lru_cache(1 << 16)(_read)


def read_clause(classes: str, levels: tuple[int, ...] = ()) -> tuple[tuple[str, float], ...]:
    """Reading and weight of each token of a clause by its best path.

    ``levels`` has the lexicon weight of each insult in order, in steps of ``STEP``.
    """
    levels = levels or (int(1 / STEP),) * classes.count(INSULT)
    return _read_kept(classes, levels) if len(classes) <= KEPT_CLAUSE else _read(classes, levels)


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?")] = True


def _tokens(raw: np.ndarray, bounds: np.ndarray):
    """Words without outer punctuation: starts, ends, row of each, whether a clause ends with it."""
    starts, ends, of_row = K.word_bounds(raw, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(of_row))
    solid = np.flatnonzero(~(_PUNCTUATION[raw] | K._SPACE[raw]))
    stop = _ENDS[raw[ends - 1]] if len(ends) else np.zeros(0, bool)
    if not len(solid):
        return starts[:0], ends[:0], row[:0], stop[:0]
    at, to = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    keep = at <= to
    return solid[np.minimum(at, len(solid) - 1)][keep], solid[to][keep] + 1, row[keep], stop[keep]


def _token_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hash of the word, and of each of its stems (0 where the word is not longer)."""
    out = [K.span_hashes(raw, starts, ends)]
    for n in STEMS:
        longer = ends - starts > n
        h = np.zeros(len(starts), np.uint64)
        h[longer] = K.mix(K.span_hashes(raw, starts[longer], starts[longer] + n) + K.U64(n))
        out.append(h)
    return out


def _class_table() -> HashArray:
    words = [(w, c) for ws, c in ((THREATS, 2), (TARGETS, 3), (NEGATIONS, 4), (REPORTS, 5)) for w in ws]
    raw = np.frombuffer("".join(w for w, _ in words).encode(), np.uint8)
    sizes = np.array([len(w.encode()) for w, _ in words])
    ends = np.cumsum(sizes)
    keys = K.span_hashes(raw, ends - sizes, ends)
    first = np.unique(keys, return_index=True)[1]
    return HashArray(keys[first], np.array([c for _, c in words])[first])


class Model:
    """Lexicon weights by feature hash, and the logistic model over document readings."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.lexicon = HashArray(keys, weights.astype(np.float32))
        self.classes = _class_table()
        self.coefficients: np.ndarray | None = None
        self.base = 0.0

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text and band of lexicon weights: the path weights of its insults, and of the heaviest reading of each distinct one; threats; log-scaled."""
        bands = len(BANDS) + 1
        out = np.zeros((len(column), 2 * bands + 1))
        for lo, _, raw, bounds in K.text_chunks(column):
            starts, ends, row, stop = _tokens(raw, bounds)
            if not len(starts):
                continue
            weight = np.zeros(len(starts), np.float32)
            found = np.zeros(len(starts), np.uint64)
            for h in _token_features(raw, starts, ends):
                at = self.lexicon.find(h)
                hit = np.flatnonzero((at >= 0) & (h != 0))
                better = hit[self.lexicon.values[at[hit]] > weight[hit]]
                weight[better] = self.lexicon.values[at[better]]
                found[better] = h[better]
            kind = self.classes.find(K.span_hashes(raw, starts, ends))
            kind = np.where(kind >= 0, self.classes.values[kind] if len(self.classes.values) else 0, 0)
            weight[kind > 2] = 0  # a word of a closed class is read as that
            kind[weight > 0] = 1
            strength = np.digitize(weight, BANDS)
            level = np.maximum(1, np.rint(weight / STEP)).astype(np.int64)
            ended = np.concatenate(([True], stop[:-1] | (row[1:] != row[:-1])))
            clause = np.cumsum(ended) - 1
            marked = np.flatnonzero((kind == 1) | (kind == 2))
            first = np.flatnonzero(ended)
            last = np.append(first[1:], len(starts))
            symbols = np.frombuffer((OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT).encode(), np.uint8)[kind].tobytes().decode()
            who, what, heavy, band = [], [], [], []
            for own in np.split(marked, np.flatnonzero(np.diff(clause[marked])) + 1) if len(marked) else ():
                a, b = int(first[clause[own[0]]]), int(last[clause[own[0]]])
                # nothing beyond twice the reach of a marked token bears on it, but a report before it does
                left, right = max(a, int(own[0]) - 2 * REACH), min(b, int(own[-1]) + 2 * REACH + 1)
                head = REPORT if REPORT in symbols[a:left] else ""
                insults = own[kind[own] == 1]
                read = read_clause(head + symbols[left:right], tuple(level[insults].tolist()))[len(head) :]
                for at in own.tolist():
                    reading, w = read[at - left]
                    if w > 0:
                        who.append(lo + int(row[at])), what.append(int(found[at])), heavy.append(w), band.append(int(strength[at]))
                    if reading == "threat":
                        out[lo + row[at], -1] += 1
            if who:
                doc, feature, w, kind_of = np.array(who), np.array(what, np.uint64), np.array(heavy), np.array(band)
                np.add.at(out, (doc, kind_of), w)
                order = np.lexsort((-w, feature, doc))
                doc, feature, w, kind_of = doc[order], feature[order], w[order], kind_of[order]
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])))
                np.add.at(out, (doc[new], bands + kind_of[new]), w[new])
        return np.log1p(out)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps, without the features whose coefficient would be negative.

        Without both classes the score is the share of toxic rows.
        """
        self.base = float(y.mean()) if len(y) else 0.0
        if not len(y) or y.min() == y.max():
            return
        used = np.flatnonzero(x.any(0))
        while True:
            z = np.hstack([x[:, used], np.ones((len(x), 1))])
            beta = np.zeros(z.shape[1])
            ridge = np.diag([0.05] * len(used) + [1e-6])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
                beta += np.clip(step, -5, 5)
                if np.abs(step).max() < 1e-6:
                    break
            if not len(used) or beta[:-1].min() >= 0:
                break
            used = np.delete(used, beta[:-1].argmin())
        self.coefficients = np.zeros(x.shape[1] + 1)
        self.coefficients[used] = beta[:-1]
        self.coefficients[-1] = beta[-1]

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(column), self.base)
        z = np.hstack([self.features(column), np.ones((len(column), 1))]) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a feature, in this task, of ``(toxic, text)`` rows."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    docs = [0, 0]
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        docs[0] += int((toxic == 0).sum())
        docs[1] += int((toxic == 1).sum())
        for lo, _, raw, bounds in K.text_chunks(batch.column(1)):
            starts, ends, row, _ = _tokens(raw, bounds)
            edges = np.searchsorted(row, np.arange(len(bounds)))
            features = _token_features(raw, starts, ends)
            for i in range(len(bounds) - 1):
                a, b = edges[i], edges[i + 1]
                if a < b:
                    own = np.unique(np.concatenate([f[a:b] for f in features]))
                    parts.append((own, np.full(len(own), toxic[lo + i], np.int8)))
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    labels = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int8)
    found, inverse = np.unique(keys, return_inverse=True)
    bad = np.bincount(inverse, labels, len(found)).astype(np.int64)
    good = np.bincount(inverse, 1 - labels, len(found)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([0, *found.view(np.int64)], pa.int64()), pa.array([docs[1], *bad], pa.int64()), pa.array([docs[0], *good], pa.int64())], ["feature", "bad", "good"])


def least_ratio(documents: dict[int, int], rate: float) -> float:
    """The log-likelihood ratio that leaves less than one feature to chance.

    ``documents`` says how many features are in n documents. Only features in enough documents to reach
    the ratio at all are tests; with fewer of them the ratio is lower.
    """
    tests = 1
    for n in sorted(documents, reverse=True):
        if 2 * n * math.log(1 / rate) < 2 * math.log(tests):
            break
        tests += documents[n]
    return 2 * math.log(tests)


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = LABELLED_ROWS) -> Model:
    """Lexicon and logistic model from labelled rows outside the held-out fold.

    At most ``most`` labels, those with the least hashes; a document with several labels is toxic if
    any is. The label side of the join has a bounded size, so it is broadcast. Of rows that share an id
    the text of the least hash is learned from, so that no more texts than labels are.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = scratch.table(known.orderBy(F.xxhash64("label_id"), "label_id").limit(most), "labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("label_id", "toxic", "text")
    sample = sample.groupBy("label_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    sample = scratch.table(sample, "sample")
    counts = sample.repartition(12).mapInArrow(_count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = scratch.table(counts, "features")
    total = counts.where("feature = 0").first()
    bad_docs, good_docs = (total["bad"], total["good"]) if total else (0, 0)
    rate = max(1e-9, bad_docs / max(1, bad_docs + good_docs))
    n = F.col("bad") + F.col("good")
    # a row for each document count, at most as many as labelled rows
    tests = {r["n"]: r["count"] for r in counts.where("feature <> 0").groupBy(n.alias("n")).count().collect()}
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), rate) + part(F.col("good"), max(1e-9, 1 - rate)))
    chosen = counts.where((F.col("feature") != 0) & (F.col("bad") > n * max(rate, LEAST_PRECISION)) & (ratio >= least_ratio(tests, rate)))
    # one document lends it a bounded share, so the sample bounds the lexicon
    chosen = chosen.select("feature", F.log(((F.col("bad") + 0.5) / (bad_docs + 1)) / ((F.col("good") + 0.5) / (good_docs + 1))).alias("weight")).toPandas()
    keys = chosen["feature"].to_numpy(np.int64).view(np.uint64)
    model = Model(keys, np.maximum(chosen["weight"].to_numpy(np.float64), 1e-3))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            x = shared.value.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(measure, "toxic int, x array<double>").toPandas()
    if len(rows):
        model.fit(np.stack(rows["x"]), rows["toxic"].to_numpy(np.float64))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, score, predicted``.

    ``labels`` has ``doc_id, toxic``; only rows outside the held-out fold (crc32 of the id modulo 4 is
    not 2) are learned from. Null and empty texts are scored as texts without a match. Without labels
    all scores are 0; with one class only, its share. Rows that repeat are kept; other columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, scratch))

    def run(batches):
        for batch in batches:
            scores = model.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``.

    Rows alike in text go or stay together; null and empty texts are scored as texts without a match.
    An empty table stays empty; without labels all rows stay. Columns are found by name and kept in order.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(plain, labels, scratch))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(at).cast(pa.string())) < threshold))

    return docs.mapInArrow(run, docs.schema)
