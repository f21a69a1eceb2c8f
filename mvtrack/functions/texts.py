"""Numbers as texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(number: Column, decimals: int) -> Column:
    """A double with so many decimals, rounded from its exact binary value as C's ``printf`` does.

    ``format_string`` rounds the shortest decimal that names the double, so that
    0.48405, which is a little less in binary, becomes 0.4841 there.
    """

    @F.arrow_udf("string")
    def text(numbers: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{decimals}f}" for v in numbers.to_pylist()], pa.string())

    return text(number.cast("double"))
