"""Words of a text, as all operators here take them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java and Python syntax of one separator: a space or U+0009 to U+000D.
SEPARATOR = r"[\x20\x09-\x0D]"
_OTHER_SEPARATORS = re.compile(r"[\x09-\x0D]")


def words(text: str | None) -> list[str]:
    """Maximal runs of anything but a separator; none for a null text."""
    if not text:
        return []
    return list(filter(None, _OTHER_SEPARATORS.sub(" ", text).split(" ")))


def word_array(text: Column) -> Column:
    """The same as an array column; empty for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATOR + "+")
    return F.array_remove(parts, "")


def let(value: Column, use) -> Column:
    """`use(value)`, with `value` computed once per row however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def free_name(df, wanted: str) -> str:
    """A column name that `df` does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
