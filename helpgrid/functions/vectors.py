"""Dense-vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_vector(vector: Column, dimension: int) -> Column:
    """The vector; the job fails if a vector has another length. Null stays null."""
    return F.when(
        vector.isNull() | (F.size(vector) == dimension), vector
    ).otherwise(
        F.raise_error(
            F.concat(
                F.lit(f"expected a vector of {dimension} numbers, found "),
                F.size(vector).cast("string"),
            )
        ).cast("array<float>")
    )


def l2_norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def unit_vector(vector: Column, norm: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    divisor = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: x.cast("double") / divisor)
