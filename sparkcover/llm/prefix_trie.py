"""Prefix trie of conversations, by composable monoid fingerprints of rebuilt turn sequences.

A conversation is rebuilt from the head of its base conversation and its own turns after
that head. No rebuilt text is ever made: a sequence of turns is an element ``(S, n)`` of the
monoid with product ``(S1 + B^n1 * S2, n1 + n2)`` modulo a prime (two primes' worth of
independent lanes), where a single turn is ``(t, 1)``. If ``S(j)`` is the product of a
conversation's own first ``j`` turns, the rebuilt prefix of depth ``d`` behind a head of
``g`` turns that replaces ``h`` own ones is the affine image ``a * S(j) + b`` with
``a = B^(g-h)`` and ``b = S_head(g) - a * S(h)``: one multiplication per turn.

1. All turns are sorted by conversation and turn in one range exchange; each task forms
   running products. A conversation that spans tasks (it may hold a third of all rows) is
   continued by its carry: one product per task is gathered and composed on the driver.
2. A node is a group of equal ``(depth, fingerprint)``, found by a pre-aggregated group-by.
   Equality is verified: all members of a group must refer to turns of one class, which by
   induction over the depth makes their sequences equal; and a class must hold one (role,
   text) only, which the distinct stored turns show. A mismatch starts over with another
   seed, so a collision can cost time, never a wrong node.
3. Sums over subtrees: every node belongs to the member of smallest random rank. A member's
   nodes form a path, and paths hang below each other to a depth of about the logarithm of
   the number of conversations. Totals go up path by path (one small pre-aggregated join a
   level), then a running sum along the paths gives every node's own, again with carries.
4. Ids that end at a node are sorted by range and hashed as they stream by; a node whose ids
   span tasks is hashed from joined blocks of 64 KB.

A parent with more children than a fair task's share is joined by broadcast: there are fewer
of those than shuffle partitions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcover.llm.common import discard, map_arrow, written
from sparkcover.session import shuffle_partitions

P = (1 << 61) - 1
# Two odd multipliers below the prime, one per lane.
BASES = (1_442_695_040_888_963_407 % P, 2_862_933_555_777_941_757 % P)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_BLOB = 1 << 16
_NODE = ("d", "f1", "f2")

_MEMBER = pa.schema(
    [(n, pa.int64()) for n in ("c", "d", "f1", "f2", "q1", "q2", "t1", "t2", "n_words", "ref", "size")]
    + [("pid", pa.int32()), ("open", pa.bool_()), ("tail", pa.string())]
)
_MEMBER_DDL = (
    "c bigint, d bigint, f1 bigint, f2 bigint, q1 bigint, q2 bigint, t1 bigint, t2 bigint, n_words bigint, "
    "ref bigint, size bigint, pid int, open boolean, tail string"
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# --------------------------------------------------------------------------- fingerprints


def _products(turns: list) -> list[tuple[int, int]]:
    """Running products ``S(0), S(1), ...`` of a few turns ``(t1, t2)``."""
    out, powers = [(0, 0)], [1, 1]
    for turn in turns:
        out.append(tuple((out[-1][k] + turn[k] * powers[k]) % P for k in (0, 1)))
        powers = [powers[k] * BASES[k] % P for k in (0, 1)]
    return out


def _affine(head: list, own: list, h: int) -> dict:
    """How a conversation's own products map to rebuilt ones; JSON-ready, as it may travel."""
    g = len(head)
    a = [pow(BASES[k], g - h, P) for k in (0, 1)]
    if len(own) < h:  # nothing follows the head
        return {"h": h, "g": g, "a": a, "b": [0, 0]}
    s_head, s_own = _products(head)[-1], _products(own[:h])[-1]
    return {"h": h, "g": g, "a": a, "b": [(s_head[k] - a[k] * s_own[k]) % P for k in (0, 1)]}


def _rebuilt(c: int, m: dict, j: int, s: tuple, s_before: tuple, t: tuple, n_words: int) -> tuple | None:
    """The member row of own turn ``j`` (from 1), or None where the head replaces it."""
    if j <= m["h"]:
        return None
    f = [(m["a"][k] * s[k] + m["b"][k]) % P for k in (0, 1)]
    q = [(m["a"][k] * s_before[k] + m["b"][k]) % P for k in (0, 1)]
    return (c, m["g"] + j - m["h"], *f, *q, *t, n_words, 2 * j, m["size"], None, False, None)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member rows of sorted turns; those of a conversation begun in an earlier task stay open."""
    pid = TaskContext.get().partitionId()
    c = m = first = None
    j, s, power = 0, (0, 0), (1, 1)
    for batch in batches:
        out = []
        for row_c, t1, t2, n_words, h, size, head, own in zip(*(x.to_pylist() for x in batch.columns)):
            if row_c != c:
                c, m, j, s, power = row_c, None, 0, (0, 0), (1, 1)
                if first is None:
                    first = (c, h is None)
            if h is not None:  # the row that opens a conversation
                head = [(x["t1"], x["t2"], x["n_words"]) for x in head or []][:h]
                own = [(x["t1"], x["t2"]) for x in own or []]
                m = _affine(head, own, h)
                m["size"] = m["g"] + max(0, size - h)
                fs = _products(head)
                out.append((c, 0, 0, 0, None, None, 0, 0, 0, 0, m["size"], pid, False, None))
                for d, turn in enumerate(head, 1):
                    out.append((c, d, *fs[d], *fs[d - 1], *turn, 2 * d + 1, m["size"], pid, False, None))
                continue
            before, t = s, (t1, t2)
            s = tuple((s[k] + t[k] * power[k]) % P for k in (0, 1))
            power = tuple(power[k] * BASES[k] % P for k in (0, 1))
            j += 1
            if m is None:
                out.append((c, j, *s, *before, *t, n_words, None, None, pid, True, None))
            elif (row := _rebuilt(c, m, j, s, before, t, n_words)) is not None:
                out.append(row)
        yield _batch(out, _MEMBER)
    if first is not None:
        tail = json.dumps({"pid": pid, "first": first, "c": c, "n": j, "s": s, "m": m})
        yield _batch([(None,) * 11 + (pid, False, tail)], _MEMBER)


def _carries(tails: list[dict]) -> dict[int, dict]:
    """Per task that goes on with a conversation: what came before. One entry per task at most."""
    out: dict[int, dict] = {}
    last: dict | None = None
    for tail in sorted(tails, key=lambda x: x["pid"]):
        c, goes_on = tail["first"]
        if goes_on:
            out[tail["pid"]] = last
        if tail["m"] is None:  # all of the task is the middle of one conversation
            shift = [pow(BASES[k], last["n"], P) for k in (0, 1)]
            s = [(last["s"][k] + shift[k] * tail["s"][k]) % P for k in (0, 1)]
            last = {"n": last["n"] + tail["n"], "s": s, "m": last["m"]}
        else:
            last = {"n": tail["n"], "s": list(tail["s"]), "m": tail["m"]}
    return out


def _closer(carries: dict[int, dict]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, j, s1, s2, b1, b2, t1, t2, n_words, _, _, pid, _, _ in zip(*(x.to_pylist() for x in batch.columns)):
                carry = carries[pid]
                shift = [pow(BASES[k], carry["n"], P) for k in (0, 1)]
                s, before = (
                    [(carry["s"][k] + shift[k] * x[k]) % P for k in (0, 1)] for x in ((s1, s2), (b1, b2))
                )
                row = _rebuilt(c, carry["m"], carry["n"] + j, s, before, (t1, t2), n_words)
                if row is not None:
                    out.append(row)
            yield _batch(out, _MEMBER)

    return run


def _classed(turns: DataFrame, seed: int) -> DataFrame:
    """``turns`` with the two lanes of each turn's class and its words."""
    lanes = [F.pmod(F.xxhash64(F.lit(2 * seed + k), "role", "text"), F.lit(P)).alias(f"t{k + 1}") for k in (0, 1)]
    return turns.select("*", *lanes, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_words"))


def _members(turns: DataFrame, base: Callable, head_turns: Callable, max_head: int) -> tuple[DataFrame, list[DataFrame]]:
    """One row per conversation and depth of its rebuilt form; scratch tables to let go of."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    n = shuffle_partitions(turns.sparkSession)
    lanes = ("t1", "t2", "n_words")
    firsts = (
        turns.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(*order)))
        .where(F.col("k") <= max_head)
        .groupBy("c")
        .agg(F.array_sort(F.collect_list(F.struct("k", *lanes))).alias("own"))
    )
    # one row per conversation: its size, its own first turns, those of its base
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("size")).join(firsts, "c")
    heads = firsts.select(F.col("c").alias("base"), F.col("own").alias("head"))
    opening = sizes.withColumn("base", base(F.col("c"))).join(heads, "base", "left")
    empty = {"turn": "bigint", "role": "string", "text": "string", "t1": "bigint", "t2": "bigint", "n_words": "bigint"}
    opening = opening.select(
        "c", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()],
        head_turns(F.col("c")).cast("bigint").alias("h"), "size", "head", "own",
    )
    rows = turns.select(
        "c", F.lit(1).alias("kind"), *empty, F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("size"),
        *[F.lit(None).cast(opening.schema[x].dataType).alias(x) for x in ("head", "own")],
    )
    by = ["c", "kind", *order]
    ranged = opening.unionByName(rows).repartitionByRange(n, *by).sortWithinPartitions(*by)
    scanned = written(map_arrow(ranged.select("c", *lanes, "h", "size", "head", "own"), _scan, _MEMBER_DDL), "trie-scan")
    tails = [json.loads(r["tail"]) for r in scanned.where("tail is not null").select("tail").collect()]
    done = scanned.where("tail is null and not open")
    carries = _carries(tails)
    if carries:
        done = done.unionByName(map_arrow(scanned.where("open"), _closer(carries), _MEMBER_DDL))
    return done, [scanned]


def _nodes(members: DataFrame) -> DataFrame:
    """Groups of equal depth and fingerprint; ``mixed`` where members' last turns differ in class."""
    return members.groupBy(*_NODE).agg(
        F.min("c").alias("conv_id"),
        F.min(F.xxhash64("c")).alias("own"),  # one-to-one on a single bigint
        F.count(F.lit(1)).alias("n_convs"),
        F.max("q1").alias("q1"),
        F.max("q2").alias("q2"),
        F.max("n_words").alias("n_words"),
        F.min_by("ref", "c").alias("ref"),
        ((F.min("t1") != F.max("t1")) | (F.min("t2") != F.max("t2"))).alias("mixed"),
    )


# --------------------------------------------------------------------------- sums over subtrees


def _with_parents(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Each node with its parent's ``conv_id`` and owner."""
    share = -(-n_nodes // shuffle_partitions(nodes.sparkSession))
    up = [(F.col("d") + 1).alias("d"), F.col("f1").alias("q1"), F.col("f2").alias("q2")]
    parents = nodes.where("n_children > 0").select(
        *up, F.col("conv_id").alias("parent_conv_id"), F.col("own").alias("parent_own"), "n_children"
    )
    crowded = F.broadcast(parents.where(F.col("n_children") > share).drop("n_children"))  # fewer than partitions
    rest = parents.where(F.col("n_children") <= share).drop("n_children")
    key = ["d", "q1", "q2"]
    return nodes.join(crowded, key).unionByName(nodes.join(crowded, key, "left_anti").join(rest, key, "left"))


def _path_totals(paths: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Totals of each path and all below it: ``(own, value, leaves)``."""
    up = paths.select("own", "parent_own")
    level, found, scratch = paths.select("own", "value", "leaves"), [paths.select("own", "value", "leaves")], []
    while True:
        raised = level.join(up, "own").where("parent_own is not null").groupBy(F.col("parent_own").alias("own"))
        level = written(raised.agg(F.sum("value").alias("value"), F.sum("leaves").alias("leaves")), "trie-level")
        scratch.append(level)
        if level.isEmpty():
            break
        found.append(level)
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return total.groupBy("own").agg(F.sum("value").alias("value"), F.sum("leaves").alias("leaves")), scratch


def _running(df: DataFrame, key: str, order: Column, sums: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``df`` with its columns ``sums`` summed up along ``order`` within each ``key``; the scratch table.

    One range exchange; a key that spans tasks is continued by one carry per task.
    """
    spark = df.sparkSession
    schema = df.withColumn("pid", F.lit(0)).withColumn("last", F.lit(False)).schema
    names = df.columns
    places, at = [names.index(c) for c in sums], names.index(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        now, totals, held = None, [0] * len(sums), None

        def ready(last: bool) -> pa.RecordBatch:
            size = len(held[0])
            flags = [False] * (size - 1) + [last]
            return pa.RecordBatch.from_arrays(
                [*held, pa.array([pid] * size, pa.int32()), pa.array(flags)], names=[*names, "pid", "last"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield ready(False)
            columns = {p: batch.column(p).to_pylist() for p in places}
            for i, k in enumerate(batch.column(at).to_pylist()):
                if k != now:
                    now, totals = k, [0] * len(sums)
                for x, p in enumerate(places):
                    totals[x] += columns[p][i]
                    columns[p][i] = totals[x]
            held = [pa.array(columns[i], c.type) if i in columns else c for i, c in enumerate(batch.columns)]
        if held is not None:
            yield ready(True)

    by = [F.col(key), order]
    ranged = df.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    table = written(map_arrow(ranged, run, schema), "trie-running")
    tails = table.where("last").select("pid", key, *sums).collect()
    firsts = {r["pid"]: r["k"] for r in table.groupBy("pid").agg(F.min(key).alias("k")).collect()}
    carry, before = [], None
    for tail in sorted(tails, key=lambda r: r["pid"]):
        values = [tail[c] for c in sums]
        if before is not None and firsts[tail["pid"]] == before[0]:
            carry.append((tail["pid"], before[0], *before[1]))
            if tail[key] == before[0]:
                values = [a + b for a, b in zip(values, before[1])]
        before = (tail[key], values)
    table_out = table.drop("last")
    fields = ", ".join(["pid int", f"{key} bigint", *[f"carry_{c} bigint" for c in sums]])
    carried = F.broadcast(spark.createDataFrame(carry, fields))  # one row per task at most
    joined = table_out.join(carried, ["pid", key], "left")
    out = [(F.col(c) + F.coalesce(F.col(f"carry_{c}"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in names]
    return joined.select(*out), table


# --------------------------------------------------------------------------- ids that end at a node

_DIGEST = pa.schema(
    [("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("pid", pa.int32()), ("k", pa.int64())]
    + [("blob", pa.binary()), ("sha", pa.string())]
)
_DIGEST_DDL = "d bigint, f1 bigint, f2 bigint, pid int, k bigint, blob binary, sha string"


def _hash_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of nodes whose ids all lie inside the task; blocks of joined ids at its two ends."""
    pid = TaskContext.get().partitionId()
    node, in_blocks, blobs, k, size = None, True, [], 0, 0
    for batch in batches:
        out = []
        for d, f1, f2, c in zip(*(x.to_pylist() for x in batch.columns)):
            if (d, f1, f2) != node:
                if blobs:
                    joined = b",".join(blobs)
                    if in_blocks:
                        out.append((*node, pid, k, joined, None))
                    else:
                        out.append((*node, pid, None, None, hashlib.sha256(joined).hexdigest()))
                in_blocks = node is None  # the first node of a task may have begun in another
                node, blobs, k, size = (d, f1, f2), [], 0, 0
            blobs.append(str(c).encode())
            size += len(blobs[-1]) + 1
            if size >= _BLOB:  # long runs leave as blocks, so that a task holds one block at a time
                out.append((*node, pid, k, b",".join(blobs), None))
                in_blocks, blobs, k, size = True, [], k + 1, 0
        yield _batch(out, _DIGEST)
    if blobs:
        yield _batch([(*node, pid, k, b",".join(blobs), None)], _DIGEST)


def _hash_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, sha = None, None
    for batch in batches:
        out = []
        for d, f1, f2, blob in zip(*(x.to_pylist() for x in batch.columns)):
            if (d, f1, f2) != node:
                if node is not None:
                    out.append((*node, None, None, None, sha.hexdigest()))
                node, sha = (d, f1, f2), hashlib.sha256(blob)
            else:
                sha.update(b"," + blob)
        yield _batch(out, _DIGEST)
    if node is not None:
        yield _batch([(*node, None, None, None, sha.hexdigest())], _DIGEST)


def _end_hashes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(d, f1, f2, ends_sha256)`` of the nodes at which conversations end; the scratch table."""
    n = shuffle_partitions(members.sparkSession)
    by = [*_NODE, "c"]
    ends = members.where("d = size").select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by)
    hashed = written(map_arrow(ends, _hash_runs, _DIGEST_DDL), "trie-ends")
    blocks = hashed.where("blob is not null").repartition(n, *_NODE).sortWithinPartitions(*_NODE, "pid", "k")
    spanning = map_arrow(blocks.select(*_NODE, "blob"), _hash_blocks, _DIGEST_DDL)
    whole = hashed.where("sha is not null").unionByName(spanning)
    return whole.select(*_NODE, F.col("sha").alias("ends_sha256")), hashed


# --------------------------------------------------------------------------- the operator


def prefix_trie(
    conversations: DataFrame,
    *,
    base: Callable[[Column], Column],
    head_turns: Callable[[Column], Column],
    max_head: int,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    seed: int = 1,
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    ``base(id)`` names the conversation whose first ``head_turns(id)`` turns (at most
    ``max_head``) stand before a conversation's own turns after as many. Turns are ordered by
    ``turn`` (null first), equal ones by role and text; null roles and texts are empty.
    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``; and where
    the prefix's last turn is stored: ``turn_conv_id`` and ``turn_no`` (from 1; root: null).

    Repeated rows are turns like others. Rows without a conversation id belong to none. A
    head whose base has no rows is empty; a conversation left without turns is a member of
    the root only. Without any conversation there is no node. Other columns, whatever their
    names, are not read. No size of a turn or conversation is assumed.
    """
    turns = conversations.select(
        F.col(f"`{conv_id}`").cast("bigint").alias("c"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(n) for n, x in (("role", role), ("text", text))],
    ).where("c is not null")
    scratch: list[DataFrame] = []
    while True:
        classed = _classed(turns, seed)
        members, tables = _members(classed, base, head_turns, max_head)
        grouped = _nodes(members)
        nodes = written(grouped, "trie-nodes")
        scratch += [*tables, nodes]
        texts = classed.select("t1", "t2", "role", "text").distinct().groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
        if nodes.where("mixed").isEmpty() and texts.where("n > 1").isEmpty():
            break
        discard(*scratch)  # a collision: again with other turn classes
        scratch, seed = [], seed + 1
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("f1"), F.col("q2").alias("f2"))
    counted = nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), [*_NODE], "left")
    counted = written(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-counted")
    value = (F.col("n_convs") - 1) * F.col("n_words")
    tree = _with_parents(counted, counted.count()).select(
        "*", value.alias("value"), (F.col("n_children") == 0).cast("bigint").alias("leaves")
    )
    tree = written(tree, "trie-tree")
    top = F.col("parent_own").isNull() | (F.col("own") != F.col("parent_own"))
    paths = tree.groupBy("own").agg(
        F.sum("value").alias("value"),
        F.sum("leaves").alias("leaves"),
        F.max(F.when(top, F.col("parent_own"))).alias("parent_own"),
        F.max(F.when(top, F.col("d") - 1)).alias("hangs_at"),
    )
    paths = written(paths, "trie-paths")
    totals, levels = _path_totals(paths)
    hung = (
        totals.join(paths.where("parent_own is not null").select("own", "parent_own", "hangs_at"), "own")
        .groupBy(F.col("parent_own").alias("own"), F.col("hangs_at").alias("d"))
        .agg(F.sum("value").alias("more_value"), F.sum("leaves").alias("more_leaves"))
    )
    whole = tree.join(hung, ["own", "d"], "left").select(
        "own", *_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "ref",
        (F.col("value") + F.coalesce("more_value", F.lit(0))).alias("value"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
    )
    summed, running = _running(whole, "own", F.col("d").desc(), ("value", "leaves"))
    ends, hashed = _end_hashes(members)
    is_head = F.col("ref") % 2 == 1
    out = summed.join(ends, [*_NODE], "left").select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("value").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        F.when(F.col("d") > 0, F.when(is_head, base(F.col("conv_id"))).otherwise(F.col("conv_id"))).alias("turn_conv_id"),
        F.when(F.col("d") > 0, F.shiftright("ref", 1)).alias("turn_no"),
    )
    result = written(out, "trie")
    discard(*scratch, counted, tree, paths, *levels, running, hashed)
    return result
