"""Keyed random draws.

A draw is a pure function of (row key, stream name, seed). A retried task, a
different partitioning or a re-planned stage therefore always sees the same
number, which ``rand()`` cannot promise.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296.0  # 2**32: eight hex digits


def draw(key: str | Column, stream: str, seed: int) -> Column:
    """Uniform [0, 1) number for each row."""
    col = F.col(key) if isinstance(key, str) else key
    text = F.concat_ws("|", col.cast("string"), F.lit(stream), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(_SPAN)


def draw_fast(key: str | Column, stream: str, seed: int) -> Column:
    """The same contract on ``xxhash64``; several times cheaper than md5."""
    col = F.col(key) if isinstance(key, str) else key
    h = F.xxhash64(col.cast("string"), F.lit(stream), F.lit(seed))
    return F.shiftrightunsigned(h, 32).cast("double") / F.lit(_SPAN)


def unit(stream: str, seed: int) -> float:
    """Driver-side draw for the few numbers that belong to columns, not rows."""
    digest = hashlib.md5(f"{stream}|{seed}".encode()).hexdigest()
    return int(digest[:8], 16) / _SPAN


def gauss(stream: str, seed: int) -> float:
    """Driver-side standard normal (Box-Muller over two unit draws)."""
    u1 = max(unit(stream + "#r", seed), 1.0 / _SPAN)
    u2 = unit(stream + "#t", seed)
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)


def pick(names: list[str], n: int, stream: str, seed: int) -> list[str]:
    """``n`` names chosen at random, without replacement, in table order."""
    order = sorted(names, key=lambda c: (unit(f"{stream}:{c}", seed), c))
    chosen = set(order[:n])
    return [c for c in names if c in chosen]
