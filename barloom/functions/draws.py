"""Counter-based random integers: the same integer mixing as a Spark column and as SQL text.

A draw is a function of a seed and of counters (sample, position, key), so any task or engine gets the same one without
state. Each counter enters by xor and goes through multiplications in 32 bits with shifts folded in between, which are
not linear together: neighbouring counters give unrelated draws. Products stay below 2^63. A draw is scaled to a range
by its leading bits; the bias is at most the range over 2^32.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
SPREAD = 0x3C6EF372
FACTORS = (0x7FEB352D, 0x31848BAB, 0x2C1B3C6D)


def mixed(state: Column, counter: Column) -> Column:
    """Next state: ``state`` and ``counter`` mixed to 32 bits."""
    x = state.bitwiseXOR((counter.cast("bigint").bitwiseAND(F.lit(MASK)) * F.lit(SPREAD)).bitwiseAND(F.lit(MASK)))
    for factor, shift in zip(FACTORS, (15, 16, 0), strict=True):
        x = (x * F.lit(factor)).bitwiseAND(F.lit(MASK))
        x = x.bitwiseXOR(F.shiftright(x, shift)) if shift else x
    return x


def draw(seed: int, *counters: Column) -> Column:
    """Integer in 0 .. 2^32 - 1."""
    x = F.lit(seed).cast("bigint")
    for c in counters:
        x = mixed(x, c)
    return x


def pick(n: Column, seed: int, *counters: Column) -> Column:
    """Integer in 1 .. ``n``; n below 2^31."""
    return F.shiftright(draw(seed, *counters) * n.cast("bigint"), 32) + F.lit(1)


def mixed_sql(state: str, counter: str) -> str:
    x = f"xor({state}, ((CAST({counter} AS BIGINT) & {MASK}) * {SPREAD}) & {MASK})"
    for factor, shift in zip(FACTORS, (15, 16, 0), strict=True):
        x = f"(({x} * {factor}) & {MASK})"
        x = f"xor({x}, {x} >> {shift})" if shift else x
    return x


def draw_sql(seed: int, *counters: str) -> str:
    x = f"CAST({seed} AS BIGINT)"
    for c in counters:
        x = mixed_sql(x, c)
    return x


def pick_sql(n: str, seed: int, *counters: str) -> str:
    return f"((({draw_sql(seed, *counters)} * CAST({n} AS BIGINT)) >> 32) + 1)"


def draw_int(seed: int, *counters: int) -> int:
    """The same draw as a number."""
    x = seed
    for c in counters:
        x ^= ((c & MASK) * SPREAD) & MASK
        for factor, shift in zip(FACTORS, (15, 16, 0), strict=True):
            x = (x * factor) & MASK
            x = x ^ (x >> shift) if shift else x
    return x


def mixed_array(state: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """``mixed`` of two integer arrays (broadcast) as uint32, whose products wrap where the columns mask."""
    x = state.astype(np.uint32) ^ ((counter.astype(np.uint64) & np.uint64(MASK)) * np.uint64(SPREAD)).astype(np.uint32)
    for factor, shift in zip(FACTORS, (15, 16, 0), strict=True):
        x *= np.uint32(factor)
        if shift:
            x ^= x >> np.uint32(shift)
    return x


def draw_array(seed: int, *counters: np.ndarray) -> np.ndarray:
    """The same draws of integer arrays (broadcast)."""
    x = np.array(seed, np.uint32)
    for c in counters:
        x = mixed_array(x, np.asarray(c))
    return x
