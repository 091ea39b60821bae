"""SimHash fingerprints of whole texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words, A to Z lower-cased; of the whole sequence if it is shorter.

    Splitting and lower-casing bytes treats exactly the ASCII separators and letters.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(size, len(words))
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes, as a signed 64-bit number; zero without hashes."""
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, size: int) -> Column:
    """The fingerprint of a text column as a bigint."""

    @F.pandas_udf("bigint")
    def of_batch(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(t, size)) for t in texts], dtype="int64")

    return of_batch(text)


def as_hex(value: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
