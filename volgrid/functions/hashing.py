"""Seeded, order-independent hashes of key columns onto [0, 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)


def key_digest(keys: list[str | Column], seed: int) -> Column:
    """md5 of ``seed|key|key...`` as 32 hex digits; the same text in any SQL engine."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def digest_unit(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def hash_unit(keys: list[str | Column], seed: int, method: str = "md5") -> Column:
    """Uniform hash of the keys in [0, 1).

    ``md5`` gives the same value in every engine; ``xxhash64`` is cheaper and Spark-only.
    """
    if method == "md5":
        return digest_unit(key_digest(keys, seed))
    if method == "xxhash64":
        cols = [F.col(k) if isinstance(k, str) else k for k in keys]
        mixed = F.xxhash64(F.lit(seed), *cols)
        return F.pmod(mixed, F.lit(2**32)).cast("double") / F.lit(TWO_32)
    raise ValueError(f"unknown hash method: {method}")
