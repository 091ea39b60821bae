"""Column-to-column functions. Each takes a column or its name and stays inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
