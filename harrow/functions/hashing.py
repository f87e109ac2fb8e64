"""Choices that depend on a key's hash only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_mod(col: Column, n: int) -> Column:
    """SHA-256 of a text as a whole number, modulo n, folded over 16 limbs of 16 bits (no step overflows for n < 2**46)."""
    digest = F.sha2(col, 256)
    limbs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(limbs, F.lit(0).cast("long"), lambda acc, limb: (acc * 65536 + limb) % n)
