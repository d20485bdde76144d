"""Message steps on edges placed in a grid of cells (J1 with T3).

The 2D strategy puts an edge into the cell of its source's column and its destination's
row, so the edges of a vertex, however many, lie in about ``2 * sqrt(n)`` of ``n`` cells.
``GridEdgeSet`` leaves them there. A message step is then

* *fragment and replicate*: a state row goes to those cells of its column that hold edges of
  its source (a routing row per vertex, made once, names them), and is joined there;
* partial aggregates of a cell go by destination, at most one for each cell of its row.

Edges are shuffled once, for the placement; no list of hot sources is needed, because a
source with a third of all edges has them spread over its column. What a step moves is the
state times the cells of a vertex, at most ``min(out-degree, sqrt(n))`` each.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcover.functions.graph import partition_2d
from sparkcover.operators.neighbors import EdgeSet, GraphStats
from sparkcover.plans.loop import checkpointed
from sparkcover.session import drop_path


class GridEdgeSet(EdgeSet):
    """An ``EdgeSet`` whose edges stay in the cells of the 2D strategy: ``n_cells`` partitions.

    Results equal those of ``EdgeSet``; small states are broadcast there as here. An edge of a
    null end lies in no cell and is left out, as no message passes it.
    """

    def __init__(
        self,
        edges: DataFrame,
        n_cells: int,
        stats: GraphStats | None = None,
        *,
        broadcast_bytes: int | None = None,
    ):
        self.n_cells = max(1, int(n_cells))
        edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
        # written once: lost cells are placed again from the table, not from what made it
        table, folder = checkpointed(edges.where("src is not null and dst is not null"))
        cells = (
            table.withColumn("cell", partition_2d(F.col("src"), F.col("dst"), self.n_cells))
            .repartitionById(self.n_cells, F.col("cell"))
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        super().__init__(cells, stats, broadcast_bytes=broadcast_bytes)
        self.cells, self._folder = cells, folder
        self._owned = [cells]
        self._routes: dict[str, DataFrame] = {}

    def _routed(self, rows: DataFrame, end: str) -> DataFrame:
        """``rows`` (keyed by ``end``), a copy in each cell that holds edges of that end."""
        if end not in self._routes:
            route = self.cells.groupBy(end, "cell").agg(F.lit(1).alias("_one")).groupBy(end)
            # at most about sqrt(n) cells a vertex: its column, or its row
            route = route.agg(F.collect_list("cell").alias("_cells")).repartition(self.n_parts, end)
            self._routes[end] = route.persist(StorageLevel.MEMORY_AND_DISK)
            self._owned.append(self._routes[end])
        copies = rows.join(self._routes[end], end).withColumn("cell", F.explode("_cells")).drop("_cells")
        return copies.repartitionById(self.n_cells, F.col("cell"))

    def _in_cells(self, copies: DataFrame, n_cols: int, n_rows: int | None) -> DataFrame:
        """``copies`` as the hash-table side of a join in the cells, while a cell's share is small.

        A cell gets the vertices of one column (or row) at most: a share of 1 / sqrt(n) of them.
        """
        rows = self.stats.n_vertices if n_rows is None else n_rows
        size = rows * 64 * (n_cols + 2) / max(1, int(self.n_cells**0.5))
        return copies.hint("shuffle_hash") if size <= self.cell_bytes else copies

    #: Bound of the hash table of a cell's states, which can't spill.
    cell_bytes = 128 << 20

    def with_source(self, src_state: DataFrame, n_cols: int, n_rows: int | None = None) -> DataFrame:
        if self.state_fits_broadcast(n_cols, n_rows):
            return self.edges.join(F.broadcast(src_state), "src")
        copies = self._in_cells(self._routed(src_state, "src"), n_cols, n_rows)
        return self.cells.join(copies, ["cell", "src"]).drop("cell")

    def pull(
        self,
        state: DataFrame,
        asking: Column,
        cols: list[str],
        aggs: list[Column],
        where: Column | None = None,
        n_rows: int | None = None,
    ) -> DataFrame:
        """As in ``EdgeSet``, for any edges: questions and answers meet in the cells."""
        if self.state_fits_broadcast(len(cols), n_rows):
            return super().pull(state, asking, cols, aggs, where, n_rows)
        asked = state.where(asking).select(F.col("id").alias("dst"))
        asked = self._in_cells(self._routed(asked, "dst"), 0, n_rows)
        answers = (state if where is None else state.where(where)).select(F.col("id").alias("src"), *cols)
        answers = self._in_cells(self._routed(answers, "src"), len(cols), n_rows)
        found = self.cells.join(asked, ["cell", "dst"], "left_semi").join(answers, ["cell", "src"])
        return found.groupBy(F.col("dst").alias("id")).agg(*aggs)

    def restrict(self, live: DataFrame, n_live: int) -> "GridEdgeSet":
        """Edges whose two endpoints are both in ``live`` (``id``), in cells again."""
        kept = self.cells
        for end in ("src", "dst"):
            ids = live.select(F.col("id").alias(end))
            if self.state_fits_broadcast(0, n_live):
                kept = kept.join(F.broadcast(ids), end, "left_semi")
            else:
                kept = kept.join(self._in_cells(self._routed(ids, end), 0, n_live), ["cell", end], "left_semi")
        stats = GraphStats(
            n_vertices=n_live,
            n_edges=self.stats.n_edges,  # upper bound; refreshed below
            min_id=self.stats.min_id,
            max_id=self.stats.max_id,
            max_out_degree=self.stats.max_out_degree,
            max_in_degree=self.stats.max_in_degree,
        )
        out = GridEdgeSet(kept.select("src", "dst"), self.n_cells, stats, broadcast_bytes=self.broadcast_bytes)
        out.stats.n_edges = out.edges.count()
        out.mode = self.mode
        return out

    def release(self) -> None:
        self._routes = {}
        super().release()
