"""Deterministic hashes: the same value under any partitioning and on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(salt: str | int, *parts: Column | str) -> Column:
    """32 hex digits of ``salt:part:part``."""
    return F.md5(F.concat_ws(":", F.lit(str(salt)), *[_col(p).cast("string") for p in parts]))


def hash_bigint(hex_key: Column, digits: int = 15) -> Column:
    """Non-negative bigint from the first hex digits (15 digits = 60 bits)."""
    return F.conv(F.substring(hex_key, 1, digits), 16, 10).cast("bigint")


def uniform(hex_key: Column) -> Column:
    """Double in [0, 1) with 52 random bits, exact in binary."""
    return hash_bigint(hex_key, 13).cast("double") / F.lit(float(16**13))


def percent_bucket(salt: str, col: Column | str) -> Column:
    """Integer 0..99 from the first 8 hex digits."""
    return hash_bigint(md5_key(salt, col), 8) % 100


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
