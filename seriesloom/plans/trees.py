"""Tree ensembles as flat arrays: gradient boosting from histograms, and walks within tasks.

Boosting sums gradients by node, feature and bin in every task and adds them up by one shuffle; only these
sums, whose number does not depend on the rows, reach the driver, which picks the splits. All models of
a backtest grow in the same passes. A split sends missing values to the side that gains more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.sources.scratch import Steps

#: Models that grow side by side: their sums are on the driver together.
MODELS_AT_ONCE = 16
#: Features times models whose bins one aggregate finds.
EDGES_AT_ONCE = 128
#: Trees that are walked anew in each pass before the margins are written.
TREES_A_STATE = 8


@dataclass(frozen=True)
class Ensemble:
    """Trees of one or more models: nodes in flat arrays, each tree known by its root. A leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[np.ndarray]
    base: np.ndarray
    depth: int

    def walk(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaves that rows of features, NaN where one is missing, reach from ``node`` (one a row, or trees x rows)."""
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            seen = x[rows, np.maximum(f, 0)]
            left = np.where(np.isnan(seen), self.missing_left[node], seen <= self.threshold[node])
            node = np.where(f < 0, node, np.where(left, self.left[node], self.right[node]))
        return node

    def predict(self, x: np.ndarray, model: int = 0) -> np.ndarray:
        """Predictions of rows of features by one of the models."""
        return self.base[model] + self.value[self.walk(x, np.repeat(self.roots[model][:, None], len(x), 1))].sum(0)

    def latest(self, model: int, trees: int) -> Ensemble:
        """The last ``trees`` of a model, without its base."""
        return replace(self, roots=[self.roots[model][len(self.roots[model]) - trees :]], base=np.zeros(1))

    def transform(self, rows: DataFrame, features: list[str], model: str | None = None) -> DataFrame:
        """``rows`` with ``pred``, by the model that the column ``model`` names by number, or by the only one."""
        x = F.array(*[F.col(f"`{n}`").cast("double") for n in features])
        held = [f"_{i}" for i in range(len(rows.columns))]  # names with dots cannot be mapped
        asked = rows.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(rows.columns, held, strict=True)], x.alias("_x"), (F.col(model).cast("int") if model else F.lit(0)).alias("_m"))
        width = len(features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                which = batch.column("_m").to_numpy(zero_copy_only=False)
                pred = np.empty(len(which))
                for m in np.unique(which):
                    pred[which == m] = self.predict(seen[which == m], int(m))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(held)], pa.array(pred)], [*held, "pred"])

        kinds = [T.StructField(h, f.dataType) for h, f in zip(held, rows.schema, strict=True)]
        return asked.mapInArrow(run, T.StructType([*kinds, T.StructField("pred", T.DoubleType())])).toDF(*rows.columns, "pred")

    def table(self, spark) -> DataFrame:
        """A row a node: ``model, tree, node, feature, threshold, missing_left, left, right, value``; children as node numbers."""
        out = []
        for m, roots in enumerate(self.roots):
            for t, root in enumerate(roots.tolist()):
                todo = [root]
                while todo:
                    i = todo.pop()
                    out.append((m, t, i, int(self.feature[i]), float(self.threshold[i]), bool(self.missing_left[i]), int(self.left[i]), int(self.right[i]), float(self.value[i])))
                    todo += [int(self.left[i]), int(self.right[i])] if self.feature[i] >= 0 else []
        return spark.createDataFrame(out, "model int, tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double")


def joined(parts: list[Ensemble]) -> Ensemble:
    """The models of several ensembles as one."""
    shift = np.cumsum([0, *[len(p.feature) for p in parts]])
    stack = lambda name: np.concatenate([getattr(p, name) for p in parts])
    moved = lambda name: np.concatenate([getattr(p, name) + s for p, s in zip(parts, shift, strict=False)])
    roots = [r + s for p, s in zip(parts, shift, strict=False) for r in p.roots]
    return Ensemble(stack("feature"), stack("threshold"), stack("missing_left"), moved("left"), moved("right"), stack("value"), roots, stack("base"), max(p.depth for p in parts))


class _Nodes:
    """Nodes while they grow."""

    def __init__(self) -> None:
        self.rows: list[list] = []  # feature, threshold, missing_left, left, right, value

    def add(self, value: float = 0.0) -> int:
        self.rows.append([-1, 0.0, True, 0, 0, value])
        return len(self.rows) - 1

    def ensemble(self, roots: list[list[int]], base: np.ndarray, depth: int) -> Ensemble:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * 6
        kinds = (np.int32, float, bool, np.int64, np.int64, float)
        return Ensemble(*[np.array(c, k) for c, k in zip(cols, kinds, strict=True)], [np.array(r, np.int64) for r in roots], np.asarray(base, float), depth)


def spark_ensemble(model) -> Ensemble:
    """A fitted regression tree, forest or boosted ensemble of Spark's as flat arrays."""
    java = model._java_obj
    kind = type(model).__name__
    single = kind.startswith("DecisionTree")
    trees = [java] if single else list(java.trees())
    weights = [1.0] if single else list(java.treeWeights()) if kind.startswith("GBT") else [1.0 / len(trees)] * len(trees)
    nodes, roots = _Nodes(), []
    for tree, weight in zip(trees, weights, strict=True):
        roots.append(nodes.add())
        todo = [(tree.rootNode(), roots[-1])]
        while todo:
            node, i = todo.pop()
            row = nodes.rows[i]
            if node.getClass().getSimpleName() == "LeafNode":
                row[5] = weight * node.prediction()
                continue
            split = node.split()
            row[0], row[1] = split.featureIndex(), split.threshold()
            row[3], row[4] = nodes.add(), nodes.add()
            todo += [(node.leftChild(), row[3]), (node.rightChild(), row[4])]
    return nodes.ensemble([roots], np.zeros(1), max(int(t.depth()) for t in trees))


def bin_edges(rows: DataFrame, features: list[str], most: int, inside: list[Column] | None = None) -> list[list[np.ndarray]]:
    """Upper edges of each feature's bins, for the rows of each condition: all values where they are few, else approximate quantiles.

    A model's bins come from its own rows, so that no threshold tells of rows that it must not have seen.
    """
    asked = [(F.when(c, F.col(f"`{n}`").cast("double"))) for c in inside or [F.lit(True)] for n in features]
    points, out = [i / most for i in range(1, most + 1)], []
    for lo in range(0, len(asked), EDGES_AT_ONCE):
        part = asked[lo : lo + EDGES_AT_ONCE]
        counts = rows.agg(*[F.approx_count_distinct(c, 0.05).alias(f"c{i}") for i, c in enumerate(part)]).first()
        found = rows.agg(*[(F.collect_set(c) if n <= 1.2 * most else F.percentile_approx(c, points, 10000)).alias(f"c{i}") for i, (c, n) in enumerate(zip(part, counts, strict=True))]).first()
        for values in found:
            edges = np.unique([v for v in values or [] if v is not None and not np.isnan(v)])
            out.append(edges if len(edges) <= most else edges[np.linspace(0, len(edges) - 1, most).round().astype(int)])
    return [out[i : i + len(features)] for i in range(0, len(out), len(features))]


def _choose(hist: np.ndarray, l2: float, least: float) -> tuple[float, int, int, bool, np.ndarray, np.ndarray]:
    """The best split of a node's sums (features x bins x (gradient, rows)): gain, feature, bin, missing left, sums of both sides.

    Bin 0 holds missing values. Ties go to the first feature, the lowest bin and missing values left.
    """
    total = hist[0].sum(0)
    known = hist[:, 1:].cumsum(1)
    missing = hist[:, :1]
    left = np.stack([known + missing, known], 2)  # features x bins x missing left or not x sums
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < least) | (right[..., 1] < least) | ~np.isfinite(gain)] = -np.inf
    f, b, side = np.unravel_index(int(np.round(gain, 9).argmax()), gain.shape)
    return float(gain[f, b, side]), int(f), int(b), side == 0, left[f, b, side], right[f, b, side]


def boost(
    rows: DataFrame,
    features: list[str],
    target: str = "y",
    ranges: list[tuple[int, int]] | None = None,
    at: str = "pos",
    weight: str | None = None,
    maxIter: int = 20,
    maxDepth: int = 5,
    stepSize: float = 0.1,
    maxBins: int = 64,
    l2: float = 1.0,
    minRows: float = 5,
    seed: int | None = None,
) -> Ensemble:
    """Gradient boosting of squared errors: a model for each range of the positions ``at``, or one of all rows.

    Rows without a target are left out; features may be null. Each of ``maxDepth`` levels of a tree is one
    pass over rows that are binned once. ``seed`` is accepted and changes nothing: there is no sampling.
    """
    if ranges and len(ranges) > MODELS_AT_ONCE:
        return joined([boost(rows, features, target, ranges[i : i + MODELS_AT_ONCE], at, weight, maxIter, maxDepth, stepSize, maxBins, l2, minRows) for i in range(0, len(ranges), MODELS_AT_ONCE)])
    given = rows.where(F.col(target).isNotNull())
    spans = ranges or [(None, None)]
    within = lambda c, a, b: F.lit(True) if a is None else (c >= a) & (c < b)
    edges = bin_edges(given, features, maxBins, [within(F.col(at), *r) for r in spans])
    n_models, width, bins = len(spans), len(features), max([len(e) for es in edges for e in es] + [1]) + 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            out = np.zeros((len(x), n_models, width), np.int16)
            for f in range(width):
                seen = ~np.isnan(x[:, f])
                for m in range(n_models):
                    out[seen, m, f] = np.minimum(np.searchsorted(edges[m][f], x[seen, f]), max(len(edges[m][f]) - 1, 0)) + 1
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), n_models * width).cast(pa.list_(pa.int16()))
            margin = pa.FixedSizeListArray.from_arrays(pa.array(np.tile(base, len(y))), n_models).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array(y), batch.column("_w"), lists, margin], ["at", "y", "w", "bins", "margin"])

    pos = F.col(at).cast("long") if ranges else F.lit(0).cast("long")
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    plain = given.select(pos.alias("_at"), F.col(target).cast("double").alias("_y"), w.alias("_w"), F.array(*[F.col(f"`{n}`").cast("double") for n in features]).alias("_x"))
    inside = [within(F.col("_at"), *r) for r in spans]
    sums = plain.agg(*[F.sum(F.when(c, v)).alias(f"{k}{i}") for i, c in enumerate(inside) for k, v in (("y", F.col("_y") * F.col("_w")), ("w", F.col("_w")))]).first()
    base = np.array([(sums[f"y{i}"] or 0.0) / (sums[f"w{i}"] or 1.0) for i in range(n_models)])
    steps = Steps(rows.sparkSession, "boosting")
    state = steps.written(plain.mapInArrow(binned, "at long, y double, w double, bins array<smallint>, margin array<double>"))

    nodes, roots = _Nodes(), [[] for _ in spans]  # thresholds are bins while the trees grow
    fresh = 0  # trees that the written margins lack

    def pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        at_, y, w_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "y", "w"))
        return at_, y, w_, batch.column("bins").flatten().to_numpy().reshape(-1, n_models, width), batch.column("margin").flatten().to_numpy().reshape(-1, n_models)

    def level(ensemble: Ensemble, fresh: int, growing: list[int | None], active: dict[int, int]):
        """Sums by node, feature and bin: rows ``i, g, h``."""
        slots = max(active.values(), default=-1) + 1
        place = np.full(len(ensemble.feature), -1)
        for node, slot in active.items():
            place[node] = slot

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, slots * width * bins))
            for batch in batches:
                at_, y, w_, x, margin = pieces(batch)
                for m, (a, b) in enumerate(spans):
                    if growing[m] is None:
                        continue
                    mine = np.ones(len(y), bool) if a is None else (at_ >= a) & (at_ < b)
                    xs, node = x[mine, m], np.full(int(mine.sum()), growing[m])
                    if not len(xs):
                        continue
                    seen = np.where(xs == 0, np.nan, xs)
                    now = margin[mine, m] + ensemble.latest(m, fresh).predict(seen)
                    node = ensemble.walk(seen, node)
                    slot = place[node]
                    live = slot >= 0
                    cell = (slot[live, None] * width + np.arange(width)) * bins + xs[live]
                    g, h = (now - y[mine])[live] * w_[mine][live], w_[mine][live]
                    total[0] += np.bincount(cell.ravel(), np.repeat(g, width), total.shape[1])
                    total[1] += np.bincount(cell.ravel(), np.repeat(h, width), total.shape[1])
            filled = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[0][filled]), pa.array(total[1][filled])], ["i", "g", "h"])

        made = state.mapInArrow(run, "i long, g double, h double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # nodes x features x bins
        out = np.zeros((slots * width * bins, 2))
        out[made.column("i").to_numpy()] = np.stack([made.column("g").to_numpy(), made.column("h").to_numpy()], 1)
        return out.reshape(slots, width, bins, 2)

    for _ in range(maxIter):
        growing = [nodes.add() for _ in spans]
        open_ = {root: i for i, root in enumerate(growing)}
        for depth in range(maxDepth):
            hist = level(nodes.ensemble(roots, base, maxDepth), fresh, growing, open_)
            grown: dict[int, int] = {}
            for node, slot in open_.items():
                if not hist[slot].any():
                    continue
                gain, f, b, side, left, right = _choose(hist[slot], l2, minRows)
                if not depth:
                    total = hist[slot][0].sum(0)
                    nodes.rows[node][5] = -stepSize * total[0] / (total[1] + l2)
                if gain <= 1e-9:
                    continue
                leaf = lambda s: -stepSize * s[0] / (s[1] + l2)
                a, c = nodes.add(leaf(left)), nodes.add(leaf(right))
                nodes.rows[node][:5] = [f, b + 1, side, a, c]
                grown[a], grown[c] = 0, 0
            open_ = {node: i for i, node in enumerate(grown)}
            if not open_:
                break
        for m, root in enumerate(growing):
            roots[m].append(root)
        fresh += 1
        if fresh == TREES_A_STATE:
            now, lately = nodes.ensemble(roots, base, maxDepth), fresh

            def advanced(batches: Iterator[pa.RecordBatch], now=now, lately=lately) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, _, _, x, margin = pieces(batch)
                    seen = np.where(x == 0, np.nan, x)
                    new = np.stack([margin[:, m] + now.latest(m, lately).predict(seen[:, m]) for m in range(n_models)], 1)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(new.ravel()), n_models).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], batch.schema.names)

            state, fresh = steps.written(state.mapInArrow(advanced, state.schema)), 0
    steps.delete()
    for m, trees in enumerate(roots):
        todo = list(trees)
        while todo:
            row = nodes.rows[todo.pop()]
            if row[0] >= 0:
                row[1] = float(edges[m][row[0]][int(row[1]) - 1])
                todo += row[3:5]
    return nodes.ensemble(roots, base, maxDepth)
