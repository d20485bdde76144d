"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Each source partition permutes its rows locally: a local sort by a random
   number, no exchange. Partition number and position in the permutation are
   written with the rows to the shared checkpoint folder, so a lost task can't
   deal them anew.
2. The partition-to-shard counts are drawn from the multivariate hypergeometric
   law with the partition sizes and the exact shard sizes as margins: the counts
   a uniform permutation of all rows would give. The draw has two levels (blocks
   of about sqrt(P) partitions, then the partitions of each block), so that the
   second and larger level runs in parallel.
3. The first ``a`` rows of a partition's permutation go to shard 0, the next to
   shard 1, and so on: the one exchange of whole rows.
4. Each shard permutes its rows again. A shard larger than ``rows_per_block`` is
   cut into ranges of the random key, each sorted by a task of its own; exact
   counts of the ranges give the offset of each in the shard.

Only DataFrame functions are used. Nothing but sizes (one row per source
partition) is gathered, and ``sqrt(P)`` of those at most in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcover.llm.common import packed, written

_SPREAD = 10.0  # standard deviations kept on each side of the mean; beyond lie < 1e-20


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(good: Column, pool: Column, drawn: Column, u: Column) -> Column:
    """Inverse-CDF draw of the good items among ``drawn`` taken from ``pool`` without return.

    Weights relative to the lower end follow from the ratio of neighbouring
    probabilities, so no factorials are needed.
    """
    k_all, n_all, n = (c.cast("double") for c in (good, pool, drawn))
    share = k_all / F.greatest(n_all, F.lit(1.0))
    mean = n * share
    var = mean * (F.lit(1.0) - share) * (n_all - n) / F.greatest(n_all - 1, F.lit(1.0))
    reach = F.sqrt(F.greatest(var, F.lit(0.0))) * F.lit(_SPREAD) + F.lit(_SPREAD)
    low = F.greatest(F.lit(0.0), n - (n_all - k_all), F.floor(mean - reach).cast("double"))
    high = F.greatest(low, F.least(k_all, n, F.floor(mean + reach).cast("double")))
    steps = F.sequence(low.cast("bigint"), high.cast("bigint"))

    def step_up(w: Column, k: Column) -> Column:
        return w * (k_all - k) * (n - k) / ((k + 1) * (n_all - k_all - n + k + 1))

    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct(step_up(a["w"], k).alias("w"), (a["s"] + a["w"]).alias("s")),
        lambda a: a["s"],
    )
    return F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("w"), (u * total).alias("left"), high.cast("bigint").alias("k"), F.lit(False).alias("done")),
        lambda a, k: F.struct(
            step_up(a["w"], k).alias("w"),
            (a["left"] - a["w"]).alias("left"),
            F.when(~a["done"] & (a["left"] < a["w"]), k).otherwise(a["k"]).alias("k"),
            (a["done"] | (a["left"] < a["w"])).alias("done"),
        ),
        lambda a: a["k"],
    )


def _draw_vector(rem: Column, n: Column, n_shards: int, u_parts: tuple[Column, ...]) -> Column:
    """Split ``n`` draws over the shards whose free places are ``rem``."""
    pool = F.aggregate(rem, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def one(a: Column, j: Column) -> Column:
        good = F.element_at(rem, j + 1)
        x = hypergeometric(good, a["pool"], a["need"], _uniform(*u_parts, j))
        # the struct is rebuilt from one draw, held in an array so that it is drawn once
        return F.transform(
            F.array(x),
            lambda v: F.struct(
                (a["pool"] - good).alias("pool"),
                (a["need"] - v).alias("need"),
                F.concat(a["v"], F.array(v)).alias("v"),
            ),
        )[0]

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        F.struct(pool.alias("pool"), n.alias("need"), F.array().cast("array<bigint>").alias("v")),
        one,
        lambda a: a["v"],
    )


def _deal(totals: Column, free: Column, n_shards: int, salt: tuple[Column, ...]) -> Column:
    """Rows of the matrix for sources of sizes ``totals`` (array), one after the other."""

    def one(a: Column, i: Column) -> Column:
        row = _draw_vector(a["free"], F.element_at(totals, i + 1), n_shards, (*salt, i))
        return F.transform(
            F.array(row),
            lambda v: F.struct(
                F.zip_with(a["free"], v, lambda x, y: x - y).alias("free"),
                F.concat(a["rows"], F.array(v)).alias("rows"),
            ),
        )[0]

    return F.aggregate(
        F.filter(F.sequence(F.lit(0), F.size(totals)), lambda i: i < F.size(totals)),
        F.struct(free.alias("free"), F.array().cast("array<array<bigint>>").alias("rows")),
        one,
        lambda a: a["rows"],
    )


def communication_matrix(sizes: DataFrame, shard_sizes: list[int], seed: int) -> DataFrame:
    """``sizes`` (``pid``, ``n``) and exact shard sizes to ``(pid, counts array<bigint>)``."""
    spark = sizes.sparkSession
    n_shards = len(shard_sizes)
    top_pid = sizes.agg(F.max("pid")).first()[0]
    width = max(1, math.isqrt(int(top_pid or 0)) + 1)
    blocks = (
        sizes.groupBy(F.expr(f"pid div {width}").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("pid", "n"))).alias("members"))
        .withColumn("total", F.aggregate("members", F.lit(0).cast("bigint"), lambda a, m: a + m["n"]))
    )
    free = F.array(*[F.lit(int(s)).cast("bigint") for s in shard_sizes])
    top = (
        blocks.agg(F.sort_array(F.collect_list(F.struct("block", "total"))).alias("b"))
        .select("b", _deal(F.transform("b", lambda x: x["total"]), free, n_shards, (F.lit(seed), F.lit(-1))).alias("rows"))
        .select(F.explode(F.arrays_zip("b", "rows")).alias("z"))
        .select(F.col("z.b.block").alias("block"), F.col("z.rows").alias("free"))
    )
    lower = blocks.join(top, "block").select(
        "members",
        _deal(F.transform("members", lambda m: m["n"]), F.col("free"), n_shards, (F.lit(seed), F.col("block"))).alias("rows"),
    )
    return lower.select(F.explode(F.arrays_zip("members", "rows")).alias("z")).select(
        F.col("z.members.pid").alias("pid"), F.col("z.rows").alias("counts")
    )


def shuffle_into_shards(
    docs: DataFrame, n_shards: int, *, seed: int = 42, rows_per_block: int = 100_000
) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Shard sizes differ by one at most (the first ``N mod n_shards`` shards hold
    one more); the order is a uniform permutation of the rows. All columns are
    carried through whole. Nulls, empty and very long texts and repeated rows are
    ordinary rows: only their number counts. An empty table gives an empty result.
    Input columns called ``shard`` or ``slot`` give way to the new ones.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    local = (
        docs.select(packed(docs, ("shard", "slot")).alias("doc"), F.rand(seed).alias("r"))
        .sortWithinPartitions("r")
        .select("doc", F.monotonically_increasing_id().alias("m"))
        .select(
            "doc",
            F.shiftright("m", 33).cast("int").alias("pid"),
            F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"),
        )
    )
    rows = written(local, "shuffle-rows")
    sizes = written(rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), "shuffle-sizes")
    n = int(sizes.agg(F.sum("n")).first()[0] or 0)
    shard_sizes = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    matrix = written(communication_matrix(sizes, shard_sizes, seed), "shuffle-matrix").select(
        "pid",
        F.aggregate(
            "counts",
            F.array().cast("array<bigint>"),
            lambda a, x: F.concat(a, F.array(x + F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0)))),
        ).alias("upto"),
    )
    key = F.xxhash64(F.lit(seed + 1), F.col("pid"), F.col("pos"))
    n_ranges = max(1, -(-max(shard_sizes) // rows_per_block))
    dealt = rows.join(matrix, "pid").select(
        "doc",
        F.size(F.filter("upto", lambda c: c <= F.col("pos"))).cast("int").alias("shard"),
        "pid",
        "pos",
        key.alias("key"),
    ).withColumn("rng", F.floor(F.shiftrightunsigned("key", 33).cast("double") * F.lit(n_ranges / 2.0**31)).cast("int"))
    order = Window.partitionBy("shard", "rng").orderBy("key", "pid", "pos")
    placed = dealt.withColumn("at", F.row_number().over(order).cast("bigint") - 1)
    if n_ranges > 1:
        before = Window.partitionBy("shard").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
        offsets = dealt.groupBy("shard", "rng").agg(F.count(F.lit(1)).alias("c")).select(
            "shard", "rng", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off")
        )
        placed = placed.join(offsets, ["shard", "rng"]).withColumn("at", F.col("at") + F.col("off"))
    return placed.select("doc.*", "shard", F.col("at").cast("bigint").alias("slot"))
