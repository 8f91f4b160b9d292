"""Repeatable pseudo-random columns.

Every value is a function of (seed, stream, id) only.  ``rand(seed)`` depends on the partition
a row happens to sit in; these do not, so a retried task or another cluster size gives the same
numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)  # 13 hexadecimal digits


def _digest(seed: int, stream: str, ident: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{stream}{seed}:"), ident.cast("string")).cast("binary"))


def _digits(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint").cast("double")


def hash_uniform(seed: int, stream: str, ident: Column) -> Column:
    """Uniform double in [0, 1)."""
    return _digits(_digest(seed, stream, ident), 1) / F.lit(_SCALE)


def hash_uniform_pair(seed: int, stream: str, ident: Column) -> tuple[Column, Column]:
    """Two independent uniforms in [0, 1) from one digest."""
    digest = _digest(seed, stream, ident)
    return _digits(digest, 1) / F.lit(_SCALE), _digits(digest, 14) / F.lit(_SCALE)


def hash_normal_pair(seed: int, stream: str, ident: Column) -> tuple[Column, Column]:
    """Two independent standard normals (Box-Muller) from one digest."""
    digest = _digest(seed, stream, ident)
    # (u + 1) / (2^52 + 1) is never 0, so the logarithm is always defined
    radius = F.sqrt(F.lit(-2.0) * F.ln((_digits(digest, 1) + F.lit(1.0)) / F.lit(_SCALE + 1.0)))
    angle = F.lit(2.0 * math.pi) * (_digits(digest, 14) / F.lit(_SCALE))
    return radius * F.cos(angle), radius * F.sin(angle)


def sample_order(ident: Column) -> Column:
    """Scrambled but repeatable sort key for "take any n" operators."""
    return F.md5(ident.cast("string").cast("binary"))
