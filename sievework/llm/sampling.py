"""A bounded share of the rows of a table, chosen by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_share(number: Column, share: float) -> Column:
    """Whether a 64-bit hash is in the lowest `share` of all. The bound has all 64
    bits, so the share may be as small as the table is large."""
    if share >= 1:
        return F.lit(True)
    return number < F.lit(max(int(share * (1 << 64)), 1) - (1 << 63)).cast("long")


def filled(sample: DataFrame, n_rows: int, what: str) -> DataFrame:
    """`sample`, which must hold a row if the table has many."""
    if n_rows >= 1000 and sample.isEmpty():
        raise ValueError(f"the sample for {what} holds none of {n_rows} rows")
    return sample
