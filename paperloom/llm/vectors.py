"""Vectors as rows of numpy matrices: which take part, and in which form they travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: str) -> Column:
    """Not null, not zero, and without null, NaN or infinite components."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def element_type(df: DataFrame, vector: str) -> str:
    """'<f4' for arrays of float, else '<f8': the bytes in which vectors travel without loss."""
    return "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
