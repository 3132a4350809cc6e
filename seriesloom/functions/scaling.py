"""Standardisation fitted on training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, column: str, keys: list[str], training: Column, out: str = "scaled") -> DataFrame:
    """``(x - mean) / std`` by group, with the mean and population deviation of the training rows.

    A constant group is centred only. The parameters are one row a group, joined back on the keys.
    """
    part = F.when(training, F.col(column))
    fitted = df.groupBy(*keys).agg(F.avg(part).alias("_mean"), F.stddev_pop(part).alias("_std"))
    joined = df.join(fitted, keys) if keys else df.crossJoin(F.broadcast(fitted))  # without keys one row
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return joined.withColumn(out, (F.col(column) - F.col("_mean")) / scale).drop("_mean", "_std")


#: Exponents that are tried: the grid of a power transformation.
POWERS = [i / 10 for i in range(-20, 21)]
METHODS = ("yeo_johnson", "box_cox")


def power(y: Column, exponent: Column, method: str = "yeo_johnson") -> Column:
    """Box and Cox's power of positive values, or Yeo and Johnson's, which takes all; rising in ``y`` whatever the exponent."""
    up = lambda x, k: F.when(F.abs(k) < 1e-9, F.log(x)).otherwise((F.pow(x, k) - 1) / k)
    if method == "box_cox":
        return F.when(y > 0, up(y, exponent))
    return F.when(y >= 0, up(y + 1, exponent)).when(y < 0, -up(1 - y, 2 - exponent))


def inverse_power(z: Column, exponent: Column, method: str = "yeo_johnson") -> Column:
    """What has the power ``z``. Beyond the range of powers the value is held at its end, so that bounds keep their order."""
    base = lambda x, k: F.greatest(k * x + 1, F.lit(1e-12))
    down = lambda x, k: F.when(F.abs(k) < 1e-9, F.exp(x)).otherwise(F.pow(base(x, k), 1 / k))
    if method == "box_cox":
        return down(z, exponent)
    return F.when(z >= 0, down(z, exponent) - 1).when(z < 0, 1 - down(-z, 2 - exponent))


def fit_power(df: DataFrame, method: str = "yeo_johnson", column: str = "y", keys: list[str] | None = None, powers: list[float] | None = None) -> DataFrame:
    """``series_id, exponent``: for each series the exponent of the grid of greatest normal likelihood.

    The likelihood follows from the variance of the transformed values and the sum of their logarithms, so that one
    aggregate tries the whole grid. Ties, and series of a constant or no value, take the exponent nearest
    to 1, which changes nothing of Yeo and Johnson's. Box and Cox's needs positive values: a series with others
    keeps the exponent 1.
    """
    if method not in METHODS:
        raise ValueError(f"a power is one of {', '.join(METHODS)}")
    keys, powers = keys or ["series_id"], sorted(powers or POWERS, key=lambda p: (abs(p - 1), p))
    y = F.col(column).cast("double")
    slope = F.log(y) if method == "box_cox" else F.signum(y) * F.log(F.abs(y) + 1)
    fits = F.sum((y <= 0).cast("int")) == 0 if method == "box_cox" else F.lit(True)
    sums = df.where(y.isNotNull()).groupBy(*keys).agg(F.count(y).alias("_n"), F.sum(slope).alias("_s"), fits.alias("_fits"), *[F.var_pop(power(y, F.lit(p), method)).alias(f"_v{i}") for i, p in enumerate(powers)])
    score = lambda i, p: F.when(F.col(f"_v{i}") > 1e-300, F.round(-F.col("_n") / 2 * F.log(f"_v{i}") + (p - 1) * F.col("_s"), 9))
    scores = F.array(*[F.coalesce(score(i, p), F.lit(float("-inf"))) for i, p in enumerate(powers)])
    best = F.element_at(F.array(*map(F.lit, powers)), F.array_position(scores, F.array_max(scores)).cast("int"))
    return sums.select(*keys, F.when(F.col("_fits"), best).otherwise(1.0).alias("exponent"))
