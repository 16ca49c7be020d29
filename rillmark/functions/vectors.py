"""Vector arithmetic on array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def fixed_size(a: Column, size: int) -> Column:
    """The vector as floats; another length is an error."""
    return F.when(F.size(a) == size, a.cast("array<float>")).otherwise(F.raise_error(F.lit(f"not a vector of {size}")).cast("array<float>"))


def scale_to_peak(a: Column, peak: float = 0.95) -> Column:
    top = F.array_max(F.transform(a, F.abs))
    return F.when(top <= 1e-6, a).otherwise(F.transform(a, lambda x: x / top * peak))
