"""Message steps on adjacency blocks (J1 with J2): a graph whose loops take many short rounds.

A join of DataFrames costs a plan and several jobs, which is what a loop of hundreds of rounds
spends its time on. Here the edges are dealt once to ``n_parts`` partitions, each an array
block, and a message step is one ``partitionBy`` of pre-reduced arrays:

* a vertex lies in the partition that its id hashes to; the edges of a *cold* source lie with
  it, are reduced by destination there, and one value per reached destination is sent on;
* a source of ``2 * n_parts`` edges or more is *hot*: its edges lie with their destinations, and
  its one value is sent to every partition. That is never more than its edges would carry, there
  are fewer of them than half a partition's edges, and no partition holds more edges of a hot
  source than its own vertices have.

Routes (which destinations a block reaches, which sources are hot) are exchanged once, so a step
sends values without ids, and only those that differ from the neutral one where few do. States
go along with the messages; nothing of the graph passes the driver.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcover.session import held_settings, ship_package

# Directed edges of a block, about: 21 bytes each while it is built, 4 to 12 after.
BLOCK_EDGES = 4_000_000
# Rows are handed to Python by count: they are a few numbers each. Spark adds up a batch's bytes
# anew for each of its rows where it may end by size, which takes longer than writing the rows.
_BY_COUNT = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "100000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1),
}
# The reductions and their neutral values. A key is never below 0.
REDUCE = {"sum": (np.add, 0), "max": (np.maximum, -1)}
_COLD, _HOT, _VERTEX = 0, 1, 2


def _home(vid, n: int):
    return F.pmod(F.xxhash64(vid), F.lit(n)).cast("int")


def _own(key: int) -> int:
    return key


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _small(a: np.ndarray) -> np.ndarray:
    """Positions and counts in 32 bits, where they fit."""
    return a.astype(np.int32) if not len(a) or a.max() < 1 << 31 else a


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Ids in 32 bits, where they fit."""
    return ids.astype(np.uint32) if not len(ids) or (ids.min() >= 0 and ids.max() < 1 << 32) else ids


def _columns(batches):
    """The rows of a partition as one array per column; None where it has no rows."""
    parts = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None


def _block(home, kind, src, dst, to) -> dict:
    """Vertices and cold edges of a partition, laid out; hot edges wait for the hot lists."""
    mine = kind == _VERTEX
    order = np.argsort(src[mine])
    ids, deg = src[mine][order], dst[mine][order]
    hot = to[mine][order] == 1
    cold = kind == _COLD
    s, d, t = src[cold], dst[cold], to[cold]
    # places of ascending ids are found next to each other
    order = np.argsort(s)
    s, d, t = _small(np.searchsorted(ids, s[order])), d[order], t[order]
    order = np.argsort(d)
    # partition numbers of 16 bits or fewer are sorted by their digits
    narrow = t.astype(np.min_scalar_type(int(t.max(initial=0))))
    order = order[np.argsort(narrow[order], kind="stable")]
    s, d, t = s[order], d[order], t[order]
    starts = _starts(t, d)
    reached, owner = d[starts], t[starts]
    cuts = _starts(owner)
    ends = [*cuts[1:].tolist(), len(owner)][: len(cuts)]
    routes = [(int(owner[a]), a, b) for a, b in zip(cuts.tolist(), ends, strict=True)]
    at_hot = kind == _HOT
    h = (src[at_hot], np.searchsorted(ids, dst[at_hot]))
    return {
        "part": int(home[0]), "ids": ids, "deg": _small(deg), "hot": _small(np.flatnonzero(hot)), "reached": reached,
        "cold_src": s, "cold_starts": _small(starts), "routes": routes, "hot_edges": h,
    }


def _announce(n: int, block: dict):
    """The block for its partition, and what the others must know of it: ``(partition, record)``."""
    p, reached = block["part"], block["reached"]
    yield p, ("block", p, block | {"reached": _narrow(reached)})
    for q, lo, hi in block["routes"]:
        yield q, ("cold", p, reached[lo:hi])
    if len(block["hot"]):
        for q in range(n):
            yield q, ("hot", p, block["ids"][block["hot"]])


def _laid_out(n: int):
    """From the rows of a partition to its block and announcements, pickled, in the pass that reads them."""

    def run(batches):
        import pyarrow as pa

        columns = _columns(batches)
        if columns:
            block = _block(*columns)
            del columns
            for q, record in _announce(n, block):
                row = {"to": pa.array([q], pa.int32()), "record": pa.array([pickle.dumps(record, 5)], pa.binary())}
                yield pa.RecordBatch.from_pydict(row)

    return run


def _opened(row):
    return row[0], pickle.loads(row[1])


def _routed(records):
    """A block with what it will get from the others: whose values for which of its vertices."""
    block, cold, hot = None, {}, {}
    for _, (what, p, value) in records:
        if what == "block":
            block = dict(value)
        else:
            (cold if what == "cold" else hot)[p] = value
    if block is None:
        return
    block["from_cold"] = {p: _small(np.searchsorted(block["ids"], r)) for p, r in cold.items()}
    src, dst = block.pop("hot_edges")
    offsets, lists = {}, []
    for p in sorted(hot):
        offsets[p] = sum(len(x) for x in lists)
        lists.append(hot[p])
    names = np.concatenate(lists) if lists else np.empty(0, np.int64)
    by_name = np.argsort(names)
    at = by_name[np.searchsorted(names[by_name], src)] if len(src) else np.empty(0, np.int64)
    order = np.argsort(dst, kind="stable")
    at, dst = at[order], dst[order]
    starts = _starts(dst)
    block |= {"hot_at": _small(at), "hot_starts": _small(starts), "hot_dst": _small(dst[starts]), "offsets": offsets, "names": _narrow(names)}
    yield block["part"], ("block", block["part"], block)


def _imports_aside() -> None:
    """Leave what a worker has loaded so far out of its garbage collections, of which each task ends with one.

    Going through the modules again takes longer than a step's own work.
    """
    if not gc.get_freeze_count():
        gc.freeze()


def _packed(values: np.ndarray, neutral: int):
    """Values on the way: all, or those that say something where they are few; None if none does."""
    said = np.flatnonzero(values != neutral)
    if not len(said):
        return None
    if values.dtype == np.int64 and -(1 << 31) <= values.min() and values.max() < 1 << 31:
        values = values.astype(np.int32)
    return (said.astype(np.int32), values[said]) if len(said) < len(values) // 3 else (None, values)


def _received(block: dict, messages: list, op: str) -> np.ndarray:
    """Per vertex of the block the reduction of its in-neighbours' values."""
    ufunc, neutral = REDUCE[op]
    got = np.full(len(block["ids"]), neutral, np.int64)
    for what, p, (said, values) in messages:
        if what == "cold":
            at = block["from_cold"][p]  # each of its vertices once
            at = at if said is None else at[said]
            got[at] = ufunc(got[at], values)
    hot = _hot_values(block, messages, op)
    if hot is not None and len(block["hot_at"]):
        found = ufunc.reduceat(hot[block["hot_at"]], block["hot_starts"])
        at = block["hot_dst"]
        got[at] = ufunc(got[at], found)
    return got


def _hot_values(block: dict, messages: list, op: str):
    """The values of the hot sources, as ``names`` has them; None if none has said anything."""
    hot = None
    for what, p, (said, values) in messages:
        if what == "hot":
            if hot is None:
                hot = np.full(len(block["names"]), REDUCE[op][1], np.int64)
            lo = block["offsets"][p]
            hot[lo + (np.arange(len(values)) if said is None else said)] = values
    return hot


def _lengths(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def edges_of(block: dict, own: np.ndarray, messages: list) -> tuple[np.ndarray, np.ndarray]:
    """The edges that lie in a block from marked sources ``(sources, destinations)``, as ids.

    ``own`` marks the block's vertices; the hot sources among the marked ones have sent a value
    above 0 to be summed up.
    """
    sources, destinations = [], []
    src = block["cold_src"]
    marked = own[src]
    if marked.any():
        group = np.repeat(np.arange(len(block["cold_starts"])), _lengths(block["cold_starts"], len(src)))
        sources.append(block["ids"][src[marked]])
        destinations.append(block["reached"][group[marked]].astype(np.int64))
    hot = _hot_values(block, messages, "sum")
    if hot is not None and len(block["hot_at"]):
        marked = hot[block["hot_at"]] > 0
        to = np.repeat(block["hot_dst"], _lengths(block["hot_starts"], len(marked)))
        sources.append(block["names"][block["hot_at"][marked]].astype(np.int64))
        destinations.append(block["ids"][to[marked]])
    none = [np.empty(0, np.int64)]
    return np.concatenate(sources or none), np.concatenate(destinations or none)


def _sent(block: dict, values: np.ndarray, op: str, n: int):
    ufunc, neutral = REDUCE[op]
    p = block["part"]
    if len(block["cold_src"]):
        reduced = ufunc.reduceat(values[block["cold_src"]], block["cold_starts"])
        for q, lo, hi in block["routes"]:
            packed = _packed(reduced[lo:hi], neutral)
            if packed:
                yield q, ("cold", p, packed)
    if len(block["hot"]):
        packed = _packed(values[block["hot"]], neutral)
        if packed:
            for q in range(n):
                yield q, ("hot", p, packed)


class BlockGraph:
    """The edges of a symmetric graph in array blocks, with a state of arrays per block.

    ``advance(state, got_op, update, send_op)`` is one superstep: ``update(block, state, got)``
    gets the reduction of the values last sent and gives the new state and the int64 values to
    send. Steps are lazy; a chain of them is one job.
    """

    def __init__(self, edges: DataFrame, n_edges: int, block_edges: int = BLOCK_EDGES, degrees: DataFrame | None = None):
        """``degrees``: every vertex with its number of edges ``(id, deg)``, held, where it is known."""
        spark = edges.sparkSession
        ship_package(spark)
        self.spark, self.sc = spark, spark.sparkContext
        self.n = n = max(1, self.sc.defaultParallelism, -(-n_edges // block_edges))
        own = degrees is None
        if own:
            degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")).persist(StorageLevel.MEMORY_AND_DISK)
        hot = degrees.where(F.col("deg") >= 2 * n).select(F.col("id").alias("src"), F.lit(1).alias("_hot"))
        # at most n_edges / 2n <= block_edges / 2 rows
        at = edges.join(F.broadcast(hot), "src", "left")
        is_hot = F.col("_hot").isNotNull()
        rows = at.select(F.when(is_hot, F.lit(_HOT)).otherwise(F.lit(_COLD)).cast("tinyint").alias("kind"), "src", "dst").unionByName(
            degrees.select(F.lit(_VERTEX).cast("tinyint").alias("kind"), F.col("id").alias("src"), F.col("deg").alias("dst"))
        )
        home = F.when(F.col("kind") == _HOT, _home(F.col("dst"), n)).otherwise(_home(F.col("src"), n))
        to = F.when(F.col("kind") == _VERTEX, (F.col("dst") >= 2 * n).cast("int")).otherwise(_home(F.col("dst"), n))
        rows = rows.repartitionById(n, home).select(home.alias("home"), "kind", "src", "dst", to.alias("to"))
        with held_settings(spark, _BY_COUNT):
            laid_out = rows.mapInArrow(_laid_out(n), "to int, record binary").rdd
        dealt = laid_out.map(_opened).partitionBy(n, _own)
        # dealt once more: only what a partitionBy gave is read beside the messages of a step as it
        # lies; anything else has PySpark write all messages anew, in a worker of its own per task
        self.blocks = dealt.mapPartitions(_routed).partitionBy(n, _own).persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.count()
        if own:
            degrees.unpersist()

    def start(self, first: Callable, op: str, loaded=None):
        """The first superstep: ``first(block)`` gives the state and the values to send.

        With ``loaded`` (see ``load``) it is ``first(block, values)``.
        """
        n, bare = self.n, loaded is None

        def run(records):
            block, ids, given = None, np.empty(0, np.int64), np.empty(0, np.int64)
            for _, (what, _, value) in records:
                if what == "block":
                    block = value
                else:
                    ids, given = value
            if block is None:
                return
            if bare:
                state, values = first(block)
            else:
                aligned = np.zeros(len(block["ids"]), np.int64)
                at = np.searchsorted(block["ids"], ids)
                known = at < len(aligned)
                known[known] = block["ids"][at[known]] == ids[known]
                aligned[at[known]] = given[known]
                state, values = first(block, aligned)
            yield block["part"], ("state", block["part"], state)
            yield from _sent(block, values, op, n)

        records = self.blocks if bare else self.blocks.union(loaded)
        return records.mapPartitions(run).partitionBy(n, _own)

    def load(self, values: DataFrame):
        """A whole number per vertex (``id``, ``value``) for ``start``; 0 for vertices without."""
        n = self.n
        rows = values.select(_home(F.col("id"), n).alias("home"), F.col("id").cast("bigint"), F.col("value").cast("bigint"))

        def gathered(batches):
            import pyarrow as pa

            columns = _columns(batches)
            if columns:
                home, ids, value = columns
                yield pa.RecordBatch.from_pydict({"rows": pa.array([pickle.dumps((int(home[0]), ids, value), 5)], pa.binary())})

        def keyed(row):
            p, ids, value = pickle.loads(row[0])
            return p, ("loaded", p, (ids, value))

        with held_settings(self.spark, _BY_COUNT):
            given = rows.repartitionById(n, F.col("home")).mapInArrow(gathered, "rows binary").rdd
        return given.map(keyed).partitionBy(n, _own)

    def advance(self, on_the_way, got_op: str, update: Callable, send_op: str):
        n = self.n

        def step(block, state, messages):
            state, values = update(block, state, _received(block, messages, got_op))
            return state, _sent(block, values, send_op, n)

        return self.exchange(on_the_way, step)

    def exchange(self, on_the_way, step: Callable):
        """A superstep of any messages: ``step(block, state, messages)`` gives the new state and what
        is sent, as ``(partition, (kind, own partition, value))``."""

        def run(records):
            _imports_aside()
            block = state = None
            messages = []
            for p, record in records:
                if record[0] == "block":
                    block = record[2]
                elif record[0] == "state":
                    state = record[2]
                else:
                    messages.append(record)
            if block is None:
                return
            state, sent = step(block, state, messages)
            yield block["part"], ("state", block["part"], state)
            yield from sent

        return self.blocks.union(on_the_way).mapPartitions(run).partitionBy(self.n, _own)

    def asked(self, on_the_way, question: Callable, got_op: str) -> list:
        """``question(block, state, got)`` of each block, for the driver: a few values each."""

        def run(records):
            block = state = None
            messages = []
            for _, record in records:
                if record[0] == "block":
                    block = record[2]
                elif record[0] == "state":
                    state = record[2]
                else:
                    messages.append(record)
            if block is not None:
                yield question(block, state, _received(block, messages, got_op))

        return self.blocks.union(on_the_way).mapPartitions(run).collect()

    def states(self, on_the_way):
        return on_the_way.filter(lambda r: r[1][0] == "state").map(lambda r: r[1][2])

    def table(self, on_the_way, columns: Callable, schema: str) -> DataFrame:
        """The states as a DataFrame: ``columns(block, state)`` gives its arrays, the ids first."""
        names = [c.split()[0] for c in schema.split(",")]

        def rows(records):
            block = state = None
            for _, record in records:
                block = record[2] if record[0] == "block" else block
                state = record[2] if record[0] == "state" else state
            if block is not None:
                import pyarrow as pa

                cols = columns(block, state)
                for lo in range(0, len(cols[0]), 100_000):
                    batch = pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in cols], names=names)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch)
                    yield (bytearray(sink.getvalue().to_pybytes()),)

        def opened(batches):
            import pyarrow as pa

            for b in batches:
                for blob in b.column(0):
                    yield from pa.ipc.open_stream(blob.as_py())

        blobs = self.spark.createDataFrame(self.blocks.union(on_the_way).mapPartitions(rows), "rows binary")
        return blobs.mapInArrow(opened, schema)

    def release(self) -> None:
        self.blocks.unpersist()
