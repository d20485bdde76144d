"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree turns the vectors by a random rotation of its own; the hash string of a
vector lists its coordinates there by decreasing magnitude, with their signs. Near
vectors share long prefixes. Largest inner product becomes smallest angle by one more
coordinate that brings all stored vectors to the same length and is 0 for queries.

A tree is cut by the first symbol into cells of sorted arrays; a cell of more than
``cell_rows`` rows is cut again, each part seeing the cell's queries. Search descends
to the longest prefix matches, counts the rows below each prefix in every tree, and
ascends in all trees at once until a query has enough candidates. Candidates are scored
inside the cells, which give back the best few of each query, never the pairs.

How many neighbours a query missed is read off the trees: a neighbour that few trees
show could as well have been shown by none. From those found in one tree and in two,
the number found in none is estimated (Chao's estimate). A query that has probably
found less than ``recall`` of its neighbours, or has no level with enough candidates,
is held against all rows, in blocks; so a dense group costs time, not neighbours.

Equal vectors: as candidates only the ``k + 1`` smallest ids can be among the nearest,
so others are set aside; equal queries are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcover.llm.common import map_arrow, written

TREES = 48
MIN_CANDIDATES = 100
CANDIDATE_SHARE = 0.1
RECALL = 0.9
_TIE_DIGITS = 12  # sums of a matrix product differ beyond; ties are decided on rounded scores


def rotation(tree: int, size: int, seed: int) -> np.ndarray:
    g = np.random.default_rng((seed, tree)).standard_normal((size, size))
    return np.linalg.qr(g)[0]


def symbol_bits(size: int) -> tuple[int, int]:
    """Bits of a symbol and symbols in a string of at most 62 bits."""
    bits = int(2 * size).bit_length()
    return bits, min(62 // bits, size)


def hash_strings(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Packed strings of rows: signed coordinates in order of magnitude, first symbol highest."""
    size = vectors.shape[1]
    bits, length = symbol_bits(size)
    turned = vectors @ turn
    order = np.argpartition(-np.abs(turned), length - 1, axis=1)[:, :length] if length < size else np.tile(np.arange(size), (len(turned), 1))
    best = np.take_along_axis(turned, order, 1)
    rank = np.argsort(-np.abs(best), axis=1, kind="stable")
    order, best = np.take_along_axis(order, rank, 1), np.take_along_axis(best, rank, 1)
    out = np.zeros(len(vectors), np.int64)
    for j in range(length):
        out = (out << bits) | (2 * order[:, j] + (best[:, j] > 0))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _hashed(rows: DataFrame, id_name: str, largest: float | None, dim: int, trees: int, seed: int, vectors: bool) -> DataFrame:
    """One row per tree: (tree, first, string, id[, e]). ``largest``: length stored vectors are brought to."""
    bits, length = symbol_bits(dim + 1)

    def run(batches):
        turns = [rotation(t, dim + 1, seed) for t in range(trees)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                v = _matrix(part.column(1))
                extra = np.zeros(len(v)) if largest is None else np.sqrt(np.maximum(largest**2 - (v * v).sum(axis=1), 0))
                v = np.column_stack((v, extra))
                for t, turn in enumerate(turns):
                    s = hash_strings(v, turn)
                    first = s >> (bits * (length - 1))
                    arrays = [pa.array(np.full(len(v), t, np.int32)), pa.array(first.astype(np.int32)), pa.array(s), part.column(0)]
                    yield pa.RecordBatch.from_arrays(
                        arrays + [part.column(1)] * vectors, names=["tree", "first", "string", id_name] + ["e"] * vectors
                    )

    kind = rows.schema["e"].dataType.simpleString()
    schema = f"tree int, first int, string long, {id_name} long" + f", e {kind}" * vectors
    return map_arrow(rows.select(id_name, "e"), run, schema)


def _counts(rows: pa.Table, queries: pa.Table, bits: int, length: int) -> pa.Table:
    """Per query of a cell, how many rows share each prefix length from 1."""
    s = np.sort(rows.column("string").to_numpy())
    q = queries.column("string").to_numpy()
    n = []
    for level in range(1, length + 1):
        shift = bits * (length - level)
        cut = s >> shift
        n.append(np.searchsorted(cut, q >> shift, "right") - np.searchsorted(cut, q >> shift, "left"))
    counts = np.stack(n, axis=1).reshape(-1)
    offsets = np.arange(0, len(counts) + 1, length)
    return pa.table({"qkey": queries.column("qkey"), "n": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(counts, pa.int64()))})


def _nearest(rows: pa.Table, queries: pa.Table, bits: int, length: int, keep: int) -> pa.Table:
    """The best ``keep`` rows of a cell for each of its queries, under its prefix."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        s = rows.column("string").to_numpy()
        order = np.argsort(s, kind="stable")
        s, ids, v = s[order], rows.column("vec_id").to_numpy()[order], _matrix(rows.column("e"))[order]
        q, keys, level = queries.column("string").to_numpy(), queries.column("qkey").to_numpy(), queries.column("level").to_numpy()
        w = _matrix(queries.column("e"))
        shift = bits * (length - level.astype(np.int64))
        prefix = np.where(level > 0, q >> np.minimum(shift, 63), 0)
        group = np.lexsort((prefix, level))
        edge = np.flatnonzero(np.concatenate(([True], (prefix[group][1:] != prefix[group][:-1]) | (level[group][1:] != level[group][:-1]))))
        for at, to in zip(edge, np.append(edge[1:], len(group))):
            members = group[at:to]
            lv = int(level[members[0]])
            if lv:
                cut = s >> (bits * (length - lv))
                low, high = np.searchsorted(cut, prefix[members[0]], "left"), np.searchsorted(cut, prefix[members[0]], "right")
            else:
                low, high = 0, len(s)
            if low == high:
                continue
            block = max(1, 2_000_000 // (high - low))
            for b in range(0, len(members), block):
                some = members[b : b + block]
                scores = w[some] @ v[low:high].T
                unit = max(float(np.abs(scores).max()), 1e-300)
                scores = np.round(scores / unit, _TIE_DIGITS)
                if high - low > keep:
                    least = np.partition(scores, high - low - keep, axis=1)[:, high - low - keep]
                else:
                    least = np.full(len(some), -np.inf)
                for i, row in enumerate(scores):
                    near = np.flatnonzero(row >= least[i])
                    near = near[np.lexsort((ids[low + near], -row[near]))][:keep] + low
                    exact = np.ascontiguousarray(v[near] * w[some[i]]).sum(axis=1)
                    out.append((np.full(len(near), keys[some[i]]), ids[near], exact))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.array([], np.int64), np.array([], np.int64), np.array([], np.float64)]
    return pa.table({"qkey": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct (vec_id, e) that can take part, all of the most frequent dimension."""
    e = F.col(f"`{embedding}`")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), e.alias("e")).where(
        "vec_id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    )
    top = rows.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return written(rows.where(F.size("e") == F.lit(top[0]["d"] if top else 0)).distinct(), "vectors")


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 20,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    query_every: int = 20,
    trees: int = TREES,
    min_candidates: int = MIN_CANDIDATES,
    candidate_share: float = CANDIDATE_SHARE,
    recall: float = RECALL,
    cell_rows: int = 50_000,
    seed: int = 42,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id is divisible by ``query_every``.

    Nearest: largest inner product of the original vectors in double precision, ties to
    the smaller id; the query's own id is no candidate of its. Rows with null id, or a
    null, zero or empty vector, or one with null or non-finite components, take no part,
    nor do vectors of another dimension than the most frequent one. Repeated rows count
    once. A query looks at candidates until it has at least ``min_candidates`` and
    ``candidate_share`` of all rows, counted once per tree; if these have probably shown
    it less than ``recall`` of its neighbours, it looks at all rows. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, vec_id, embedding)
    length2 = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    head = usable.agg(F.max(F.size("e")).alias("d"), F.sqrt(F.max(length2)).alias("r")).first()
    if head["d"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, largest = int(head["d"]), float(head["r"])
    rank = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    rows = written(usable.withColumn("c", rank).where(F.col("c") <= k + 1).drop("c"), "candidates")
    n = rows.count()
    wanted = usable.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    queries = written(wanted.groupBy("e").agg(F.min("vec_id").alias("qkey")), "query-vectors")
    asked = wanted.join(queries, "e").select(F.col("vec_id").alias("query_id"), "qkey")
    bits, length = symbol_bits(dim + 1)

    strings = _hashed(rows, "vec_id", largest, dim, trees, seed, False)
    cells = written(
        strings.groupBy("tree", "first").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("parts")), "cells"
    )
    own_part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    key = ["tree", "first", "part"]

    asking = _hashed(queries, "qkey", None, dim, trees, seed, False).join(cells, key[:2]).select("tree", "first", "string", "qkey", all_parts)
    counts = (
        strings.join(cells, key[:2]).select("tree", "first", "string", own_part).groupBy(*key)
        .cogroup(asking.groupBy(*key))
        .applyInArrow(lambda a, b: _counts(a, b, bits, length), "qkey long, n array<long>")
    )
    enough = max(min_candidates, int(np.ceil(candidate_share * n)))
    levels = counts.select("qkey", F.posexplode("n").alias("level", "n")).groupBy("qkey", "level").agg(F.sum("n").alias("n")).where(
        F.col("n") >= enough
    ).groupBy("qkey").agg((F.max("level") + 1).alias("level"))
    levelled = written(
        queries.join(levels, "qkey", "left").select("qkey", "e", F.coalesce("level", F.lit(0)).cast("int").alias("level")), "query-levels"
    )

    under = levelled.where("level > 0")
    asking = (
        _hashed(under, "qkey", None, dim, trees, seed, True).join(under.select("qkey", "level"), "qkey").join(cells, key[:2])
        .select("tree", "first", "string", "qkey", "e", "level", all_parts)
    )
    stored = _hashed(rows, "vec_id", largest, dim, trees, seed, True).join(cells, key[:2]).select(
        "tree", "first", "string", "vec_id", "e", own_part
    )
    found_as = "qkey long, vec_id long, score double"
    search = lambda a, b: _nearest(a, b, bits, length, k + 1)
    found = stored.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(search, found_as)

    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")

    def merged(pairs: DataFrame) -> DataFrame:
        """The best ``k + 1`` of each query and how many trees showed them."""
        once = pairs.groupBy("qkey", "vec_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("shown"))
        return once.withColumn("c", F.row_number().over(best)).where(F.col("c") <= k + 1).drop("c")

    # a vector among the best of a query is among the best of each cell that shows it
    nearest = written(merged(found), "forest-neighbours")
    others = nearest.where("vec_id <> qkey").groupBy("qkey").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("shown") == 1).alias("f1"), F.count_if(F.col("shown") == 2).alias("f2")
    )
    missed = F.col("f1") * (F.col("f1") - 1) / (2 * (F.col("f2") + 1))
    sure = others.where((F.col("found") >= k) & (F.col("found") >= F.lit(recall) * (F.col("found") + missed))).select("qkey")
    rest = written(levelled.join(sure, "qkey", "left_anti"), "open-queries")
    n_rest = rest.count()
    if n_rest:  # all rows, in blocks of rows and blocks of queries
        row_blocks, query_blocks = max(1, -(-n // cell_rows)), max(1, -(-n_rest // 2000))
        a = rows.select(
            F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
            F.lit(0).cast("bigint").alias("string"), "vec_id", "e",
        )
        b = rest.select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint"))).alias("rb"),
            F.pmod(F.xxhash64("qkey"), F.lit(query_blocks)).cast("int").alias("qb"),
            F.lit(0).cast("bigint").alias("string"), "qkey", "e", F.lit(0).alias("level"),
        )
        whole = a.groupBy("rb", "qb").cogroup(b.groupBy("rb", "qb")).applyInArrow(search, found_as)
        nearest = nearest.join(sure, "qkey", "left_semi").unionByName(merged(whole))

    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(nearest, "qkey").where("vec_id <> query_id").withColumn("rank", F.row_number().over(per_query).cast("int"))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
