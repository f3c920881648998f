"""A boundary behind columns that are costly to compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fence(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the named columns passed through a one-row generator.

    Spark pushes a filter on a computed column below the computation and repeats it there, once for every use of every
    step. It does not push through a generator, so a reader may filter on these columns freely.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*names))))
