"""Neighbour messaging and neighbour aggregates.

A vertex program step is: join each edge with its source's state (the *triplet
join*), then reduce the per-edge values by destination. Every reduction used by
the cover algorithms is associative (count, count_if, max, bool_or), so the
reduce is a hash aggregate with a map-side partial step: a destination with a
third of all in-edges is pre-reduced in every task and never gathered raw.

The triplet join is the skew risk, because all out-edges of a source meet its
state row in one place. ``EdgeSet.send`` picks one of two plans:

* **broadcast state** when the state has a proven size bound (at most one row per
  vertex, vertex count known) under the session's broadcast budget: the edges are
  not shuffled at all;
* otherwise a **hot/cold split**: sources with out-degree above
  ``n_edges / shuffle_partitions`` are *hot*. There are fewer of them than
  shuffle partitions (the degrees sum to ``n_edges``), so their state rows are
  broadcast to the edges wherever they lie; the remaining *cold* edges are
  hash-partitioned by source once, cached, and joined with the state by a
  shuffle of the state only. No task gets more than about one partition's worth
  of edges for a single source.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcover.functions.exact import ExactSum
from sparkcover.functions.graph import BLACK, WHITE, rank_key, rank_key_id, rank_key_wt, rank_mode
from sparkcover.operators.blocks import BlockGraph
from sparkcover.plans.loop import checkpointed, kept_layout
from sparkcover.session import broadcast_limit_bytes, drop_path, shuffle_partitions
from sparkcover.sources.edges import vertices_from_edges

# Estimated bytes per broadcast state row: UnsafeRow header + 8 bytes per field.
_ROW_OVERHEAD = 16
_FIELD_BYTES = 24  # a slot, and 16 bytes more for a wide decimal
# A hash table of one partition's state rows can't spill: it is asked for up to this size only.
_HASHED_BYTES = 128 << 20
# A runtime filter is a broadcast table of 64-bit words, of at most this size in all.
_FILTER_BYTES = 64 << 20
_WORD_BYTES = 48


@dataclass
class GraphStats:
    n_vertices: int
    n_edges: int
    min_id: int | None
    max_id: int | None
    max_out_degree: int
    max_in_degree: int


def vertex_degrees(edges: DataFrame) -> DataFrame:
    """Every endpoint with its degrees, multiplicity counted: ``(id, out, inn)``."""
    # one pass for both ends: where a task has both directions of an edge, its vertices are one row each
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).alias("e")),
                F.struct(F.col("dst").alias("id"), F.lit(0).alias("e")),
            )
        )
    )
    return ends.groupBy("id").agg(
        F.sum("e").cast("bigint").alias("out"), (F.count(F.lit(1)) - F.sum("e")).cast("bigint").alias("inn")
    )


def graph_stats(edges: DataFrame) -> GraphStats:
    """Vertex and edge counts, id range and largest degrees in one small job."""
    return _stats_of(vertex_degrees(edges))


def _stats_of(degrees: DataFrame) -> GraphStats:
    row = degrees.agg(
        F.count(F.lit(1)).alias("nv"),
        F.sum("out").alias("ne"),
        F.min("id").alias("lo"),
        F.max("id").alias("hi"),
        F.max("out").alias("dmax"),
        F.max("inn").alias("imax"),
    ).first()
    return GraphStats(
        n_vertices=int(row["nv"] or 0),
        n_edges=int(row["ne"] or 0),
        min_id=None if row["lo"] is None else int(row["lo"]),
        max_id=None if row["hi"] is None else int(row["hi"]),
        max_out_degree=int(row["dmax"] or 0),
        max_in_degree=int(row["imax"] or 0),
    )


class EdgeSet:
    """Directed edges ``(src, dst)`` prepared for repeated message passing."""

    def __init__(
        self,
        edges: DataFrame,
        stats: GraphStats | None = None,
        *,
        materialize: bool = False,
        checkpoint: bool = True,
        broadcast_bytes: int | None = None,
        hot_degree: int | None = None,
        split: tuple[DataFrame, DataFrame, DataFrame] | None = None,
        n_parts: int | None = None,
        on_release: Callable[[], object] | None = None,
        filter_bytes: int = _FILTER_BYTES,
    ):
        """``materialize`` holds the edges, for loops written to the checkpoint folder too; without
        ``checkpoint`` they are only held, which a few steps in a row need no more than
        (``write`` does it later).
        ``split`` gives hot ids, hot and cold edges laid out beforehand, the cold ones by
        source in ``n_parts`` partitions (``sources.store``). ``hot_degree`` below ``n_edges / shuffle_partitions`` is raised to it: the hot
        ids are broadcast, and only that bound proves that they are few."""
        self.spark = edges.sparkSession
        edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
        self._folder: str | None = None
        if materialize:
            if checkpoint:
                edges, self._folder = checkpointed(edges)
            edges = edges.persist(StorageLevel.MEMORY_AND_DISK)
        self.edges = edges
        # the table behind the statistics is held: vertices and hot sources are read from it
        self._degrees: DataFrame | None = None
        if stats is None:
            degrees = vertex_degrees(edges)
            if materialize:
                degrees = self._degrees = degrees.persist(StorageLevel.MEMORY_AND_DISK)
            stats = _stats_of(degrees)
        self.stats = stats
        self.mode = rank_mode(self.stats.min_id, self.stats.max_id, self.stats.max_in_degree)
        self.broadcast_bytes = (
            broadcast_limit_bytes(self.spark) if broadcast_bytes is None else broadcast_bytes
        )
        self.n_parts = n_parts or shuffle_partitions(self.spark)
        self.hot_degree = max(1, -(-self.stats.n_edges // max(1, self.n_parts)), hot_degree or 0)
        self._split = split
        self._on_release = on_release
        self.filter_bytes = filter_bytes
        self._filters: list[str] = []
        self._blocks: BlockGraph | None = None
        self.symmetry: dict | None = None  # what plans.greedy.symmetry found
        self._owned: list[DataFrame] = [edges] if materialize else []
        if self._degrees is not None:
            self._owned.append(self._degrees)

    # ------------------------------------------------------------------ plumbing

    def vertices(self) -> DataFrame:
        """Distinct endpoints of the edges ``(id)``, without a pass over them where they are known."""
        return vertices_from_edges(self.edges) if self._degrees is None else self._degrees.select("id")

    def write(self) -> None:
        """Held edges that a loop of joins is about to read round by round: now in the checkpoint folder too."""
        if self._folder is None and self._owned and self.edges is self._owned[0]:
            held = self.edges
            written, self._folder = checkpointed(held)
            self.edges = self._owned[0] = written.persist(StorageLevel.MEMORY_AND_DISK)
            held.unpersist(blocking=False)

    def blocks(self) -> BlockGraph:
        """The edges of a symmetric graph as adjacency blocks; made once, let go with the edge set."""
        if self._blocks is None:
            degrees = None if self._degrees is None else self._degrees.select("id", F.col("out").alias("deg"))
            self._blocks = BlockGraph(self.edges, self.stats.n_edges, degrees=degrees)
        return self._blocks

    def goes_by_blocks(self) -> bool:
        """Loops on a state too large to broadcast go by blocks, unless the edges have a layout of their own."""
        return type(self) is EdgeSet and not self.state_fits_broadcast(6)

    def state_fits_broadcast(self, n_cols: int, n_rows: int | None = None) -> bool:
        rows = self.stats.n_vertices if n_rows is None else n_rows
        return rows * (_ROW_OVERHEAD + _FIELD_BYTES * (n_cols + 1)) <= self.broadcast_bytes

    def _hashed(self, build: DataFrame, n_cols: int, n_rows: int | None = None) -> DataFrame:
        """``build`` as the hash-table side of a join, while a partition of it is known to be small.

        Beyond that the join is left to Spark, which sorts and can spill.
        """
        rows = self.stats.n_vertices if n_rows is None else n_rows
        size = rows * (_ROW_OVERHEAD + _FIELD_BYTES * (n_cols + 1)) / self.n_parts
        return build.hint("shuffle_hash") if size <= _HASHED_BYTES else build

    def only(self, edges: DataFrame, end: str, ids: DataFrame) -> DataFrame:
        """The ``edges`` whose column ``end`` may be one of ``ids`` (column ``id``): a runtime filter.

        For joins that would shuffle or sort the edges: they get those of the active vertices
        only. The filter is a bitmap of 64-bit words, one bit an id where the graph's id range
        allows it (then exact), else one bit a hash, with false positives; the join that follows
        settles them. Its size is bounded by ``filter_bytes`` however many ids there are. Made at
        once from ``ids``, which should be a held frame; deleted with the edge set.
        """
        if self.stats.min_id is None:
            return edges
        lo, hi = self.stats.min_id, self.stats.max_id
        limit = max(1, self.filter_bytes // _WORD_BYTES)
        exact = (hi - lo) // 64 < limit

        def bit_no(c: Column) -> Column:
            if exact:  # an id outside of the graph has no edge
                return F.when(c.between(lo, hi), c - F.lit(lo))
            return F.pmod(F.xxhash64(c), F.lit(64 * limit))

        def bit(no: Column) -> Column:
            return F.call_function("shiftleft", F.lit(1).cast("bigint"), no.bitwiseAND(F.lit(63)).cast("int"))

        words = (
            ids.select(bit_no(F.col("id")).alias("_no")).where("_no is not null")
            .groupBy(F.shiftright("_no", 6).alias("_word")).agg(F.bit_or(bit(F.col("_no"))).alias("_bits"))
        )
        # a table of its own: as a subplan it would double the plan of the ids with every step
        words, folder = checkpointed(words)
        self._filters.append(folder)
        columns = edges.columns
        asked = edges.withColumn("_no", bit_no(F.col(end))).withColumn("_word", F.shiftright("_no", 6))
        found = asked.join(F.broadcast(words), "_word")
        return found.where(F.col("_bits").bitwiseAND(bit(F.col("_no"))) != 0).select(columns)

    def _hot_cold(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hot source ids, edges from hot sources, edges from cold sources)."""
        if self._split is None:
            if self._degrees is None:
                out_degrees = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
            else:
                out_degrees = self._degrees.select(F.col("id").alias("src"), F.col("out").alias("deg"))
            hot = out_degrees.where(F.col("deg") > F.lit(self.hot_degree)).select("src")
            # fewer than n_edges / hot_degree <= shuffle_partitions rows: safe to broadcast
            hot = hot.persist(StorageLevel.MEMORY_AND_DISK)
            hot_edges = self.edges.join(F.broadcast(hot), "src", "left_semi").persist(
                StorageLevel.MEMORY_AND_DISK
            )
            cold_edges = (
                self.edges.join(F.broadcast(hot), "src", "left_anti")
                .repartition(self.n_parts, "src")
                .persist(StorageLevel.MEMORY_AND_DISK)
            )
            self._split = (hot, hot_edges, cold_edges)
            self._owned.extend(self._split)
        return self._split

    def partitioned(self, state: DataFrame) -> DataFrame:
        """A vertex state laid out by ``id`` as the prepared edges are: steps then move messages only.

        A state that fits a broadcast is left as it is.
        """
        if self.state_fits_broadcast(6):
            return state
        return state.repartition(self.n_parts, "id")

    def loop_plans(self):
        """Context for a loop of steps: the layout of states and edges is kept from step to step."""
        return nullcontext() if self.state_fits_broadcast(6) else kept_layout(self.spark, self.n_parts)

    def send(
        self,
        state: DataFrame,
        cols: list[str],
        where: Column | None = None,
        n_rows: int | None = None,
    ) -> DataFrame:
        """Triplet join: one row per edge whose source passes ``where``: ``(dst, *cols)``.

        ``state`` has one row per vertex (``id`` plus ``cols``); ``n_rows`` may give
        a tighter bound on its row count than the vertex count.
        """
        src_state = state if where is None else state.where(where)
        src_state = src_state.select(F.col("id").alias("src"), *cols)
        return self.with_source(src_state, len(cols), n_rows).select("dst", *cols)

    def with_source(self, src_state: DataFrame, n_cols: int, n_rows: int | None = None) -> DataFrame:
        """Every edge with the columns of its source's row in ``src_state`` (keyed by ``src``)."""
        if self.state_fits_broadcast(n_cols, n_rows):
            return self.edges.join(F.broadcast(src_state), "src")
        hot, hot_edges, cold_edges = self._hot_cold()
        hot_state = src_state.join(F.broadcast(hot), "src", "left_semi")
        from_hot = hot_edges.join(F.broadcast(hot_state), "src")
        # a hash table of a partition's states: the cached edges need no sort. Where it would
        # be too large they are sorted, those of the sending vertices only
        build = self._hashed(src_state, n_cols, n_rows)
        if build is src_state:
            cold_edges = self.only(cold_edges, "src", src_state.withColumnRenamed("src", "id"))
        from_cold = cold_edges.join(build, "src")
        return from_hot.unionByName(from_cold)

    def aggregate(
        self,
        state: DataFrame,
        cols: list[str],
        aggs: list[Column],
        where: Column | None = None,
        n_rows: int | None = None,
    ) -> DataFrame:
        """Reduce the messages of ``send`` by destination: ``(id, *aggs)``."""
        msgs = self.send(state, cols, where, n_rows)
        return msgs.groupBy(F.col("dst").alias("id")).agg(*aggs)

    def pull(
        self,
        state: DataFrame,
        asking: Column,
        cols: list[str],
        aggs: list[Column],
        where: Column | None = None,
        n_rows: int | None = None,
    ) -> DataFrame:
        """Like ``aggregate``, for the vertices that are ``asking`` only: ``(id, *aggs)``.

        For symmetric edge sets: the out-edges of an asking vertex lead to its in-neighbours,
        so only its own edges are read and joined. An in-neighbour that many ask answers
        where the questions lie.
        """
        asked = state.where(asking).select("id")
        answers = state if where is None else state.where(where)
        answers = answers.select("id", *cols)
        if self.state_fits_broadcast(len(cols), n_rows):
            asked = asked.select(F.col("id").alias("dst"))
            edges = self.edges.join(F.broadcast(asked), "dst", "left_semi")
            found = edges.join(F.broadcast(answers.withColumnRenamed("id", "src")), "src").select("dst", *cols)
            return found.groupBy(F.col("dst").alias("id")).agg(*aggs)
        # only questions that somebody answers are shuffled
        questions = self.only(self._edges_of(asked), "id", answers)
        hot, _, _ = self._hot_cold()
        hot = hot.withColumnRenamed("src", "id")
        hot_answers = answers.join(F.broadcast(hot), "id", "left_semi")
        from_hot = questions.join(F.broadcast(hot_answers), "id").select("asker", *cols)
        rest = questions.join(F.broadcast(hot), "id", "left_anti")
        found = from_hot.unionByName(rest.join(answers, "id").select("asker", *cols))
        return found.groupBy(F.col("asker").alias("id")).agg(*aggs)

    def _edges_of(self, ids: DataFrame) -> DataFrame:
        """The out-edges of some vertices as ``(asker, id)``: source and destination."""
        hot, hot_edges, cold_edges = self._hot_cold()
        src = ids.select(F.col("id").alias("src"))
        hot_src = src.join(F.broadcast(hot), "src", "left_semi")
        both = hot_edges.join(F.broadcast(hot_src), "src", "left_semi").unionByName(
            cold_edges.join(src, "src", "left_semi")
        )
        return both.select(F.col("src").alias("asker"), F.col("dst").alias("id"))

    def join_back(self, state: DataFrame, got: DataFrame, n_cols: int = 2) -> DataFrame:
        """``state`` with what ``aggregate`` reduced for its vertices (left join on ``id``)."""
        if self.state_fits_broadcast(n_cols):
            return state.join(F.broadcast(got), "id", "left")
        return state.join(self._hashed(got, n_cols), "id", "left")

    def restrict(self, live: DataFrame, n_live: int) -> "EdgeSet":
        """Edges whose two endpoints are both in ``live`` (``id``), checkpointed."""
        kept = self.edges
        if not self.state_fits_broadcast(0, n_live):
            for end in ("src", "dst"):  # before the first of the two ends' shuffles
                kept = self.only(kept, end, live)
        for end in ("src", "dst"):
            ids = live.select(F.col("id").alias(end))
            if self.state_fits_broadcast(0, n_live):
                kept = kept.join(F.broadcast(ids), end, "left_semi")
                continue
            # an end with more edges than a fair task's share meets its (few) live ids
            # where its edges lie; only the other edges are shuffled
            hot = (
                self.edges.groupBy(end).agg(F.count(F.lit(1)).alias("deg"))
                .where(F.col("deg") > F.lit(self.hot_degree)).select(end)
            )
            hot_live = ids.join(F.broadcast(hot), end, "left_semi")
            kept = kept.join(F.broadcast(hot), end, "left_semi").join(
                F.broadcast(hot_live), end, "left_semi"
            ).unionByName(kept.join(F.broadcast(hot), end, "left_anti").join(ids, end, "left_semi"))
        out = EdgeSet(
            kept.select("src", "dst"),
            GraphStats(
                n_vertices=n_live,
                n_edges=self.stats.n_edges,  # upper bound; refreshed below
                min_id=self.stats.min_id,
                max_id=self.stats.max_id,
                max_out_degree=self.stats.max_out_degree,
                max_in_degree=self.stats.max_in_degree,
            ),
            materialize=True,
            broadcast_bytes=self.broadcast_bytes,
        )
        out.stats.n_edges = out.edges.count()
        n_parts = shuffle_partitions(self.spark)
        out.hot_degree = max(1, -(-out.stats.n_edges // max(1, n_parts)))
        out.mode = self.mode
        return out

    def release(self) -> None:
        for frame in self._owned:
            frame.unpersist(blocking=False)
        self._owned = []
        self._degrees = None
        self._split = None
        if self._blocks is not None:
            self._blocks.release()
            self._blocks = None
        for folder in self._filters:
            drop_path(self.spark, folder)
        self._filters = []
        if self._folder:
            drop_path(self.spark, self._folder)
            self._folder = None
        if self._on_release:
            self._on_release()
            self._on_release = None


# ---------------------------------------------------------------------------- aggregates
# Each takes an EdgeSet (or plain edges) and a vertex state ``(id, ...)`` and
# returns one row per vertex that received at least one message.


def _edge_set(edges) -> EdgeSet:
    return edges if isinstance(edges, EdgeSet) else EdgeSet(edges)


def edge_source_join(edges, state: DataFrame, col: str = "color") -> DataFrame:
    """Every edge with its source's value: ``(src, dst, src_<col>)``."""
    es = _edge_set(edges)
    src_state = state.select(F.col("id").alias("src"), F.col(col).alias(f"src_{col}"))
    return es.with_source(src_state, 1).select("src", "dst", f"src_{col}")


def neighbor_agg(edges, state: DataFrame) -> DataFrame:
    """A3: per vertex, messages received and white / black senders among them."""
    es = _edge_set(edges)
    c = F.col("color")
    return es.aggregate(
        state,
        ["color"],
        [
            F.count(F.lit(1)).alias("n_msgs"),
            F.count_if(c == F.lit(WHITE)).alias("n_white"),
            F.count_if(c == F.lit(BLACK)).alias("n_black"),
        ],
    )


def neighbor_any_black(edges, state: DataFrame) -> DataFrame:
    """A4 + recolour: non-black vertices with a black in-neighbour turn gray.

    Returns ``(id, color)`` for every vertex of ``state``.
    """
    es = _edge_set(edges)
    got = es.aggregate(state, ["color"], [F.bool_or(F.col("color") == F.lit(BLACK)).alias("b")])
    return (
        state.join(got, "id", "left")
        .select(
            "id",
            F.when((F.col("color") != F.lit(BLACK)) & F.coalesce(F.col("b"), F.lit(False)), F.lit(-4))
            .otherwise(F.col("color"))
            .cast("int")
            .alias("color"),
        )
    )


def white_neighbor_count(edges, state: DataFrame) -> DataFrame:
    """A5: ``wt`` = white in-neighbours (self excluded, multiplicity counted) and ``off``.

    ``off`` = black, or gray with no white in-neighbour. Every vertex of ``state``.
    """
    es = _edge_set(edges)
    got = es.aggregate(state, ["color"], [F.count_if(F.col("color") == F.lit(WHITE)).alias("w")])
    wt = F.coalesce(F.col("w"), F.lit(0)).cast("bigint")
    c = F.col("color")
    return state.join(got, "id", "left").select(
        "id",
        wt.alias("wt"),
        ((c == F.lit(BLACK)) | ((c == F.lit(-4)) & (wt == F.lit(0)))).alias("off"),
    )


def onehop_argmax(edges, state: DataFrame) -> DataFrame:
    """Best ``(wt, smaller id)`` over the vertex and its in-neighbours that are not off.

    ``state`` has ``id, wt, off``. Returns ``(id, best_id, best_wt, n_active)`` for
    every vertex; ``n_active`` counts in-neighbours that are not off.
    """
    es = _edge_set(edges)
    mode = es.mode
    keyed = state.select("id", "off", rank_key(F.col("wt"), F.col("id"), mode).alias("k"))
    got = es.aggregate(
        keyed,
        ["k"],
        [F.max("k").alias("kb"), F.count(F.lit(1)).alias("na")],
        where=~F.col("off"),
    )
    best = F.greatest(F.col("k"), F.coalesce(F.col("kb"), F.col("k")))
    return keyed.join(got, "id", "left").select(
        "id",
        rank_key_id(best, mode).alias("best_id"),
        rank_key_wt(best, mode).alias("best_wt"),
        F.coalesce(F.col("na"), F.lit(0)).cast("bigint").alias("n_active"),
    )


def twohop_local_max(edges, state: DataFrame) -> DataFrame:
    """``selected`` when no in-neighbour's one-hop best beats the vertex's own ``(wt, id)``.

    ``state`` has ``id, wt, best_id, best_wt``. Black vertices are not excluded
    here: this is the pure dominance test.
    """
    es = _edge_set(edges)
    mode = es.mode
    keyed = state.select(
        "id",
        rank_key(F.col("wt"), F.col("id"), mode).alias("k"),
        rank_key(F.col("best_wt"), F.col("best_id"), mode).alias("bk"),
    )
    got = es.aggregate(keyed, ["bk"], [F.max("bk").alias("mb")])
    return keyed.join(got, "id", "left").select(
        "id", (F.col("mb").isNull() | (F.col("mb") <= F.col("k"))).alias("selected")
    )


def neighbor_x_sum(edges, state: DataFrame) -> DataFrame:
    """Sum of the in-neighbours' ``x`` (self excluded): ``(id, sum_x)``.

    The exact sum, rounded once (``functions.exact``): bit-equal under any order of messages
    and any partitioning, for any doubles.
    """
    es = _edge_set(edges)
    exact = ExactSum.of_column(state, "x")
    return es.aggregate(state, ["x"], exact.partials(F.col("x"), "s")).select("id", exact.total("s").alias("sum_x"))


def in_degree(edges) -> DataFrame:
    """A10: in-degree with multiplicity: ``(id, deg bigint)``. No state join needed."""
    e = edges.edges if isinstance(edges, EdgeSet) else edges
    return e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))


def onehop_max_degree(edges, degrees: DataFrame | None = None) -> DataFrame:
    """Max in-degree over the in-neighbours (own degree not included): ``(id, deg1)``."""
    es = _edge_set(edges)
    deg = in_degree(es) if degrees is None else degrees
    return es.aggregate(deg, ["deg"], [F.max("deg").cast("bigint").alias("deg1")])


def twohop_max_degree(edges, deg1: DataFrame | None = None) -> DataFrame:
    """``max(own deg1, in-neighbours' deg1, 0)``: ``(id, deg2)``.

    On a symmetric graph this is the largest degree within two hops, the vertex's
    own degree included (through any neighbour).
    """
    es = _edge_set(edges)
    d1 = onehop_max_degree(es) if deg1 is None else deg1
    got = es.aggregate(d1, ["deg1"], [F.max("deg1").alias("m")])
    return d1.join(got, "id", "left").select(
        "id",
        F.greatest(F.col("deg1"), F.coalesce(F.col("m"), F.lit(0)), F.lit(0))
        .cast("bigint")
        .alias("deg2"),
    )
