"""Aggregates that are null, not an error, where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of rows where both are known; null if either does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)).cast("double"), F.when(both, F.col(b)).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
