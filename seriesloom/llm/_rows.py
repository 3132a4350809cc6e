"""Whole rows as one column, so that no name of theirs can clash with names that an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_row(df: DataFrame) -> DataFrame:
    """``df`` with all its columns in the struct ``row``; ``select("row.*")`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def text_key(text: Column) -> Column:
    """A hash of the whole text, which with the id names rows that are alike."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def row_order(df: DataFrame) -> Column:
    """A number that orders rows of ``as_row(df)`` alike in every run; rows that differ have different ones but for chance."""
    return F.xxhash64(F.to_json("row")) if "map<" in df.schema.simpleString() else F.xxhash64("row")
