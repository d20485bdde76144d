"""Column functions for the graph jobs: colour codes, rank keys, draws, partition ids."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vertex colour codes of the greedy cover (white = not covered,
# gray = covered by a neighbour, black = in the set).
WHITE = -3
GRAY = -4
BLACK = -5
# Colour codes of the fractional phase (white, gray = covered) ...
LP_WHITE = -1
LP_GRAY = -2
# ... and of the rounding phase (not chosen, chosen).
NOT_CHOSEN = 0
CHOSEN = 2
# Fixed value: the odd 64-bit constant that scrambles ids in the 1D/2D edge
# partition strategies of Spark's graph library.
MIXING_PRIME = 1125899906842597

_TWO_32 = 1 << 32
_TWO_63 = 1 << 63
_TWO_64 = 1 << 64


# --------------------------------------------------------------------------- rank keys
#
# The greedy cover compares vertices by (white count, then smaller id). A struct
# max would work, but Spark plans max(struct) as a sort aggregate. Packing the pair
# into one number keeps the hash aggregate: larger key = more whites, then smaller id.
# "long" packing needs 0 <= id < 2^32 and count < 2^31; "decimal" packing takes any
# bigint id.


def rank_key(wt: Column, vid: Column, mode: str) -> Column:
    if mode == "long":
        return wt.cast("bigint") * F.lit(_TWO_32) + (F.lit(_TWO_32 - 1) - vid)
    return wt.cast("decimal(38,0)") * F.lit(Decimal(_TWO_64)) + (
        F.lit(Decimal(_TWO_63 - 1)) - vid.cast("decimal(38,0)")
    ).cast("decimal(38,0)")


def rank_key_wt(key: Column, mode: str) -> Column:
    """The count of a key. Whole-number division only: a double would round large counts."""
    if mode == "long":
        return F.shiftright(key, 32)
    return F.call_function("div", key, F.lit(Decimal(_TWO_64))).cast("bigint")


def rank_key_id(key: Column, mode: str) -> Column:
    if mode == "long":
        return (F.lit(_TWO_32 - 1) - F.pmod(key, F.lit(_TWO_32))).cast("bigint")
    return (F.lit(Decimal(_TWO_63 - 1)) - F.pmod(key, F.lit(Decimal(_TWO_64)))).cast("bigint")


def rank_mode(min_id: int | None, max_id: int | None, max_in_degree: int | None = None) -> str:
    """Pick the cheapest packing that is exact for the id range and the largest in-degree.

    A count is one of in-neighbours with multiplicity, so in-degree bounds it.
    """
    if min_id is None:
        return "long"
    if min_id >= 0 and max_id < _TWO_32 and (max_in_degree or 0) < (1 << 31):
        return "long"
    return "decimal"


# --------------------------------------------------------------------------- draws


def uniform_draw(vid: Column, seed: int) -> Column:
    """A reproducible uniform draw in (0, 1) from ``(id, seed)``.

    ``(first 32 bits of md5("<id>:<seed>") + 1) / (2^32 + 1)``. Pure function of the
    row, so recomputation after a lost executor draws the same numbers, and any SQL
    engine with md5 can reproduce it. Never 0, so ``u <= p`` never picks p = 0.
    """
    digest = F.md5(F.concat(vid.cast("string"), F.lit(f":{int(seed)}")))
    top = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (top + F.lit(1)).cast("double") / F.lit(float(_TWO_32 + 1))


# --------------------------------------------------------------------------- partition ids


def _scrambled_abs(vid: Column) -> Column:
    """``abs(id * MIXING_PRIME)`` with the product wrapped to a signed 64-bit value.

    Spark's ANSI mode raises on bigint overflow, so the product is formed exactly
    as decimal(38,0), reduced modulo 2^64 and shifted to the signed range.
    """
    prod = vid.cast("decimal(20,0)") * F.lit(Decimal(MIXING_PRIME)).cast("decimal(17,0)")
    m = F.pmod(prod, F.lit(Decimal(_TWO_64)))
    signed = F.when(m >= F.lit(Decimal(_TWO_63)), m - F.lit(Decimal(_TWO_64))).otherwise(m)
    return F.abs(signed)


def partition_1d(src: Column, n: int) -> Column:
    """Edge partition by source only: all out-edges of a vertex share a partition."""
    return (_scrambled_abs(src) % F.lit(int(n))).cast("int")


def partition_2d(src: Column, dst: Column, n: int) -> Column:
    """Grid edge partition: the copies of a vertex stay within about 2*sqrt(n) partitions."""
    n = int(n)
    c = int(math.ceil(math.sqrt(n)))
    a = _scrambled_abs(src)
    b = _scrambled_abs(dst)
    if n == c * c:
        return (((a % F.lit(c)) * F.lit(c) + (b % F.lit(c))) % F.lit(n)).cast("int")
    rows = (n + c - 1) // c
    last = n - rows * (c - 1)
    col = F.floor((a % F.lit(n)) / F.lit(rows))
    row = F.when(col < F.lit(c - 1), b % F.lit(rows)).otherwise(b % F.lit(last))
    return (col * F.lit(rows) + row).cast("int")
