"""Drift of new data against training data, from histograms and aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_drift(train: DataFrame, new: DataFrame, value: str = "y", most_share: float = 0.1) -> DataFrame:
    """New values outside each series' training range: ``series_id, n, outside, share, drifted``."""
    bounds = train.groupBy("series_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = (F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi")) | F.col("_lo").isNull()
    counts = new.join(bounds, "series_id", "left").groupBy("series_id").agg(F.count(value).alias("n"), F.count_if(out & F.col(value).isNotNull()).alias("outside"))
    return counts.withColumn("share", F.try_divide(F.col("outside"), F.col("n"))).withColumn("drifted", F.col("share") > most_share)


def ks_statistic(df: DataFrame, value: str, is_new: str) -> DataFrame:
    """Largest distance of the two empirical distributions by series: counts by value, then running sums."""
    by = df.where(F.col(value).isNotNull()).groupBy("series_id", value).agg(F.count_if(F.col(is_new)).alias("_n"), F.count_if(~F.col(is_new)).alias("_o"))
    w, whole = Window.partitionBy("series_id").orderBy(value), Window.partitionBy("series_id")
    gap = F.abs(F.try_divide(F.sum("_n").over(w), F.sum("_n").over(whole)) - F.try_divide(F.sum("_o").over(w), F.sum("_o").over(whole)))
    return by.withColumn("_gap", gap).groupBy("series_id").agg(F.max("_gap").alias("ks"))


def _shares(df: DataFrame, category: str, is_new: str) -> DataFrame:
    counts = df.groupBy("series_id", category).agg(F.count_if(F.col(is_new)).alias("n_new"), F.count_if(~F.col(is_new)).alias("n_old"))
    whole = Window.partitionBy("series_id")
    return counts.withColumns({"p": F.col("n_new") / F.sum("n_new").over(whole), "q": F.col("n_old") / F.sum("n_old").over(whole), "t_new": F.sum("n_new").over(whole), "t_old": F.sum("n_old").over(whole)})


def js_divergence(df: DataFrame, category: str, is_new: str) -> DataFrame:
    """Jensen-Shannon distance (base 2) of the two category histograms by series."""
    s = _shares(df, category, is_new).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    return s.groupBy("series_id").agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("js"))


def chi_square(df: DataFrame, category: str, is_new: str) -> DataFrame:
    """Chi-square statistic of the two-row contingency table by series, with its degrees of freedom."""
    s = _shares(df, category, is_new)
    n = F.col("t_new") + F.col("t_old")
    both = F.col("n_new") + F.col("n_old")
    cell = lambda seen, total: (F.col(seen) - both * F.col(total) / n) ** 2 / (both * F.col(total) / n)
    return s.groupBy("series_id").agg(F.sum(cell("n_new", "t_new") + cell("n_old", "t_old")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))


def bin_of(value, lo: float, hi: float, bins: int):
    """The equal-width bin of a column, clamped to the outer bins."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / ((hi - lo) / bins)))).cast("long")


def chunk_ks(reference: DataFrame, new: DataFrame, value: str = "y", chunk: str = "chunk") -> DataFrame:
    """``series_id, chunk, n, ks``: the largest distance of each chunk of ``new`` from the whole reference.

    Counts by value, then running sums over the runs of equal values: the reference's once for all chunks of a
    series, each chunk's own beside. A chunk's distribution jumps only at its own values, so the distance is
    met there or just before. Nulls are left out; a series without a reference has none.
    """
    v = F.col(value)
    ours = reference.where(v.isNotNull()).groupBy("series_id", v.alias("_v")).agg(F.count(F.lit(1)).alias("_r")).select("series_id", F.lit(None).cast(new.schema[chunk].dataType).alias("_c"), "_v", "_r", F.lit(0).cast("long").alias("_n"))
    theirs = new.where(v.isNotNull() & F.col(chunk).isNotNull()).groupBy("series_id", F.col(chunk).alias("_c"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).select("series_id", "_c", "_v", F.lit(0).cast("long").alias("_r"), "_n")
    runs, whole = Window.partitionBy("series_id").orderBy("_v"), Window.partitionBy("series_id")
    at = ours.unionByName(theirs).withColumns({"_upto": F.sum("_r").over(runs), "_here": F.sum("_r").over(Window.partitionBy("series_id", "_v")), "_all": F.sum("_r").over(whole)})
    mine, all_mine = Window.partitionBy("series_id", "_c").orderBy("_v"), Window.partitionBy("series_id", "_c")
    at = at.where(F.col("_n") > 0).withColumns({"_m": F.sum("_n").over(mine), "_t": F.sum("_n").over(all_mine)})
    after = F.abs(F.col("_m") / F.col("_t") - F.try_divide(F.col("_upto"), F.col("_all")))
    before = F.abs((F.col("_m") - F.col("_n")) / F.col("_t") - F.try_divide(F.col("_upto") - F.col("_here"), F.col("_all")))
    return at.groupBy("series_id", F.col("_c").alias(chunk)).agg(F.sum("_n").alias("n"), F.max(F.greatest(after, before)).alias("ks"))


def chunk_categories(reference: DataFrame, new: DataFrame, category: str, chunk: str = "chunk") -> DataFrame:
    """``series_id, chunk, n, js, chi2, df``: Jensen-Shannon distance and chi-square of each chunk against the whole reference.

    Both are sums over the categories that a chunk has; what those it lacks add follows from the reference's
    share of them. A null is a category of its own.
    """
    key = F.col(category)
    ours = reference.groupBy("series_id", key.alias("_k")).agg(F.count(F.lit(1)).alias("_r"))
    totals = ours.groupBy("series_id").agg(F.sum("_r").alias("_tr"), F.count(F.lit(1)).alias("_kinds"))
    theirs = new.where(F.col(chunk).isNotNull()).groupBy("series_id", chunk, key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    theirs = theirs.withColumn("_tc", F.sum("_n").over(Window.partitionBy("series_id", chunk)))
    met = theirs.alias("t").join(ours.alias("o"), (F.col("t.series_id") == F.col("o.series_id")) & F.col("t._k").eqNullSafe(F.col("o._k")), "left")
    met = met.select("t.series_id", F.col(f"t.{chunk}").alias(chunk), "_n", "_tc", F.coalesce("_r", F.lit(0)).alias("_r")).join(totals, "series_id")
    p, q = F.col("_r") / F.col("_tr"), F.col("_n") / F.col("_tc")
    half = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(0.0)
    both, n = F.col("_n") + F.col("_r"), F.col("_tc") + F.col("_tr")
    cell = lambda seen, total: (seen - both * total / n) ** 2 / (both * total / n)
    found = met.groupBy("series_id", chunk).agg(
        F.sum("_n").alias("n"), F.sum(part(p) + part(q)).alias("_js"), F.sum(p).alias("_p"), F.sum("_r").alias("_seen"), F.sum(cell(F.col("_n"), F.col("_tc")) + cell(F.col("_r"), F.col("_tr"))).alias("_chi"),
        F.count_if(F.col("_r") == 0).alias("_own"), F.first("_tr").alias("_tr"), F.first("_tc").alias("_tc"), F.first("_kinds").alias("_kinds"),
    )
    js = F.sqrt(F.greatest((F.col("_js") + 1 - F.col("_p")) / 2, F.lit(0.0)))
    chi2 = F.col("_chi") + (F.col("_tr") - F.col("_seen")) * F.col("_tc") / F.col("_tr")
    return found.select("series_id", chunk, "n", js.alias("js"), chi2.alias("chi2"), (F.col("_kinds") + F.col("_own") - 1).alias("df"))


def learned_thresholds(training: DataFrame, statistics: list[str], k: float = 3.0, quantile: float | None = None) -> DataFrame:
    """``series_id, <statistic>_limit``: mean plus ``k`` deviations of the training chunks' statistics, or a quantile of them."""
    of = lambda s: F.percentile(s, quantile) if quantile is not None else F.avg(s) + k * F.coalesce(F.stddev_samp(s), F.lit(0.0))
    return training.groupBy("series_id").agg(*[of(s).alias(f"{s}_limit") for s in statistics])


def chunk_drift(new: DataFrame, limits: DataFrame, statistics: list[str], chunk: str = "chunk", most_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Chunks with ``<statistic>_drifted``, and by series the share of chunks beyond a limit: ``series_id, chunks, share, drifted``."""
    flagged = new.join(limits, "series_id", "left").withColumns({f"{s}_drifted": F.coalesce(F.col(s) > F.col(f"{s}_limit"), F.lit(False)) for s in statistics})
    any_ = F.greatest(*[F.col(f"{s}_drifted") for s in statistics]) if len(statistics) > 1 else F.col(f"{statistics[0]}_drifted")
    by = flagged.groupBy("series_id").agg(F.count(F.lit(1)).alias("chunks"), F.avg(any_.cast("double")).alias("share"))
    return flagged, by.withColumn("drifted", F.col("share") > most_share)
