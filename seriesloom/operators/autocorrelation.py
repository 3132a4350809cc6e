"""Autocorrelation, partial autocorrelation and the screening of lags."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a series that one group of the sums covers.
CHUNK = 4096
#: Up to this many lags the sums are built-in expressions, a column each; beyond it arrays of a chunk.
FEW_LAGS = 32


def acf(grid: DataFrame, lags: int, chunk: int = CHUNK) -> DataFrame:
    """Biased autocorrelations ``series_id, lag, acf`` for lags 1..n, null values left out.

    A series is cut into chunks of positions, each with the ``lags`` positions before it; the sums of
    products of all chunks add up. So a long series spreads over tasks.
    """
    chunk = max(chunk, lags)
    means = grid.groupBy("series_id").agg(F.avg("y").alias("_m"))
    own = F.floor(F.col("pos") / chunk).cast("long")
    chunks = F.when(F.col("pos") % chunk >= chunk - lags, F.array(own, own + 1)).otherwise(F.array(own))
    rows = grid.join(means, "series_id").select("series_id", "pos", (F.col("y") - F.col("_m")).alias("e"), F.explode(chunks).alias("_chunk"))
    if lags <= FEW_LAGS:
        w = Window.partitionBy("series_id", "_chunk").orderBy("pos")
        products = [F.when(own == F.col("_chunk"), F.col("e") * (F.lag("e", k).over(w) if k else F.col("e"))).alias(f"_{k}") for k in range(lags + 1)]
        out = rows.select("series_id", *products).groupBy("series_id").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in range(lags + 1)])
        each = [F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(F.coalesce(f"_{k}", F.lit(0.0)), F.col("_0")).alias("acf")) for k in range(1, lags + 1)]
        return out.select("series_id", F.inline(F.array(*each)))
    rows = rows.where("e is not null")

    def sums(table: pa.Table) -> pa.Table:
        at = table.column("_chunk")[0].as_py() * chunk - lags
        held = np.zeros(lags + chunk)
        held[table.column("pos").to_numpy() - at] = table.column("e").to_numpy()
        now = held[lags:]
        values = [float(now @ held[lags - k : lags - k + chunk]) for k in range(lags + 1)]
        return pa.table({"series_id": pa.array([table.column("series_id")[0].as_py()], pa.string()), "v": pa.array([values], pa.list_(pa.float64()))})

    parts = rows.groupBy("series_id", "_chunk").applyInArrow(sums, "series_id string, v array<double>")
    added = parts.select("series_id", F.posexplode("v").alias("lag", "v")).groupBy("series_id", "lag").agg(F.sum("v").alias("v"))
    base = added.where("lag = 0").select("series_id", F.col("v").alias("_v"))
    return added.where("lag > 0").join(base, "series_id").select("series_id", F.col("lag").cast("long").alias("lag"), F.try_divide("v", "_v").alias("acf"))


def durbin_levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of lags 1..n from autocorrelations of lags 1..n."""
    n = len(r)
    out, phi, var = np.zeros(n), np.zeros(n), 1.0
    for k in range(n):
        a = (r[k] - phi[:k] @ r[:k][::-1]) / var if var > 1e-12 else 0.0
        phi[:k] -= a * phi[:k][::-1]
        phi[k] = out[k] = a
        var *= 1 - a * a
    return out


def pacf(grid: DataFrame, lags: int) -> DataFrame:
    """Partial autocorrelations ``series_id, lag, pacf``: sums in Spark, the short recursion on a row of each series."""
    rows = acf(grid, lags).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("r"))

    def solve(frames):
        for frame in frames:
            out = []
            for sid, r in zip(frame["series_id"], frame["r"], strict=True):
                values = np.nan_to_num(np.array([x["acf"] for x in r], float))
                out += [(sid, k + 1, float(v)) for k, v in enumerate(durbin_levinson(values))]
            yield pd.DataFrame(out, columns=["series_id", "lag", "pacf"])

    return rows.mapInPandas(solve, "series_id string, lag long, pacf double")


def bh_screen(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over ``series_id, lag, p``: the rows at or below their series' largest passing p-value."""
    by, whole = Window.partitionBy("series_id").orderBy("p", "lag"), Window.partitionBy("series_id")
    ranked = tests.withColumn("_rank", F.row_number().over(by)).withColumn("_m", F.count(F.lit(1)).over(whole))
    passing = F.max(F.when(F.col("p") <= F.col("_rank") * alpha / F.col("_m"), F.col("p"))).over(whole)
    return ranked.withColumn("_cut", passing).where("p <= _cut").drop("_rank", "_m", "_cut")


# Chebyshev coefficients of the complementary error function, relative error below 1.2e-7
# (Numerical Recipes, erfcc).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """Twice the normal tail beyond ``z`` >= 0, as a built-in expression."""
    x = z / math.sqrt(2)
    t = 1 / (1 + x / 2)
    series = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        series = F.lit(c) + t * series
    return t * F.exp(-x * x + series)


def significant_lags(grid: DataFrame, lags: int, alpha: float = 0.05, min_effect: float = 0.1) -> DataFrame:
    """Lags whose partial autocorrelation passes the false-discovery screen and the effect floor: ``series_id, lag, pacf``.

    z is |pacf| times the root of the number of values. The p-values are of a lag's few rows.
    """
    n = grid.groupBy("series_id").agg(F.count("y").alias("n")).where("n >= 4")
    tests = pacf(grid, lags).join(n, "series_id").where(F.col("lag") <= F.greatest(F.floor(F.col("n") / 2) - 1, F.lit(1)))
    tests = tests.withColumn("p", two_sided(F.abs("pacf") * F.sqrt("n")))
    return bh_screen(tests, alpha).where(F.abs("pacf") > min_effect).select("series_id", "lag", "pacf")


def lag_consensus(found: DataFrame, n_series: int) -> DataFrame:
    """Lags by how many series have them, then by summed strength; those of half the series or more, or else all."""
    counted = found.groupBy("lag").agg(F.count(F.lit(1)).alias("series"), F.sum(F.abs("pacf")).alias("strength"))
    floor = math.ceil(0.5 * n_series)
    strong = counted.withColumn("_any", F.max("series").over(Window.partitionBy()) >= floor)
    return strong.where(~F.col("_any") | (F.col("series") >= floor)).drop("_any").orderBy(F.desc("series"), F.desc("strength"), "lag")


def top_lags(found: DataFrame, n: int) -> DataFrame:
    """The union of each series' ``n`` strongest lags with their summed strength."""
    w = Window.partitionBy("series_id").orderBy(F.abs("pacf").desc(), "lag")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy("lag").agg(F.sum(F.abs("pacf")).alias("strength"))
