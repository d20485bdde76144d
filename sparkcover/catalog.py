"""Registered queries over the driver tables, one per operator of the inventory.

Every query reads whole tables (``documents``, ``lineitem``) and derives its input
with Spark, so its work grows with the data. Graphs are derived from
``lineitem`` with disjoint ids (``2*a`` and ``2*b + 1``, both directions):

* ``order_part``    orders linked to the parts they contain (single-step operators);
* ``part_supplier`` parts linked to the suppliers that shipped them (iterative covers).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.functions.graph import (
    BLACK,
    CHOSEN,
    GRAY,
    NOT_CHOSEN,
    WHITE,
    partition_1d,
    partition_2d,
)
from sparkcover.operators import neighbors as nb
from sparkcover.operators.checks import cover_report
from sparkcover.operators.partition import partition_sizes
from sparkcover.operators.wordcount import (
    doc_word_count,
    explode_chars,
    popular_char_count,
    popular_words,
    word_count,
)
from sparkcover.plans.greedy import greedy_dominating_set, greedy_dominating_set_directed
from sparkcover.plans.job import run_task
from sparkcover.plans.lp import (
    fractional_dominating_set,
    lp_rounded_dominating_set,
    lp_rounded_dominating_set_any,
    round_fractional_ds,
)
from sparkcover.session import drop_path, ensure_checkpoint_dir
from sparkcover.sources.sinks import result_text_rows
from sparkcover.sources.edges import (
    bipartite_edges,
    edge_lines,
    graph_size,
    parse_edge_lines,
    vertices_from_edges,
)
from sparkcover.sources.text import document_lines

# Fixed parameters of the registered queries.
POPULAR_THRESHOLD = 20
LP_K = 2
LP_ROUNDED_K = 3
DRAW_SEED = 42
JOB_DELTA = 5
PARTITIONS_1D = 8
PARTITIONS_2D = 9
PARTITIONS_2D_NONSQUARE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark, sf_dir):
    return document_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def order_part(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return bipartite_edges(li, "l_orderkey", "l_partkey")


def part_supplier(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return bipartite_edges(li, "l_partkey", "l_suppkey")


def order_customer(spark, sf_dir):
    return bipartite_edges(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def customer_nation(spark, sf_dir):
    return bipartite_edges(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")


def orders_to_nations(spark, sf_dir):
    """A directed graph: each order to its customer one way, customers and nations both ways.

    Ids are kept apart modulo 3.
    """
    o = table(spark, sf_dir, "orders").where("o_orderkey is not null and o_custkey is not null")
    c = table(spark, sf_dir, "customer").where("c_custkey is not null and c_nationkey is not null")
    one_way = o.select(
        (F.col("o_orderkey").cast("bigint") * 3).alias("src"), (F.col("o_custkey").cast("bigint") * 3 + 1).alias("dst")
    ).distinct()
    links = c.select(
        (F.col("c_custkey").cast("bigint") * 3 + 1).alias("src"), (F.col("c_nationkey").cast("bigint") * 3 + 2).alias("dst")
    ).distinct()
    return one_way.union(links).union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def seed_colors(edges) -> DataFrame:
    """A fixed test colouring of the vertices of edges or an edge set: black, gray or white by id."""
    vid = F.col("id")
    vertices = edges.vertices() if isinstance(edges, nb.EdgeSet) else vertices_from_edges(edges)
    return vertices.select(
        "id",
        F.when(vid % 5 == 0, F.lit(BLACK))
        .when(vid % 3 == 0, F.lit(GRAY))
        .otherwise(F.lit(WHITE))
        .cast("int")
        .alias("color"),
    )


# ----------------------------------------------------------------------------- text


def q_lines_scan(spark, sf_dir):
    return doc_lines(spark, sf_dir)


def q_tokenize(spark, sf_dir):
    return doc_word_count(doc_lines(spark, sf_dir))


def q_word_count(spark, sf_dir):
    return word_count(doc_lines(spark, sf_dir))


def q_popular_words(spark, sf_dir):
    return popular_words(word_count(doc_lines(spark, sf_dir)), POPULAR_THRESHOLD)


def q_explode_chars(spark, sf_dir):
    return explode_chars(popular_words(word_count(doc_lines(spark, sf_dir)), POPULAR_THRESHOLD))


def q_popular_char_count(spark, sf_dir):
    return popular_char_count(doc_lines(spark, sf_dir), POPULAR_THRESHOLD)


# ----------------------------------------------------------------------------- graph scans


def edge_text(spark, sf_dir) -> DataFrame:
    """Edge-list text derived from the order-part graph, in mixed layouts.

    Even sources are written ``"src dst"``, odd ones ``"src<TAB>dst 1.0"`` (extra
    token ignored by the scan); a comment line and an empty line are added.
    """
    g = order_part(spark, sf_dir)
    body = g.select(
        F.when(F.col("src") % 2 == 0, F.format_string("%d %d", "src", "dst"))
        .otherwise(F.format_string("%d\t%d 1.0", "src", "dst"))
        .alias("value")
    )
    extra = spark.createDataFrame([("# order-part graph",), ("",)], "value string")
    return body.union(extra)


def q_edge_list_scan(spark, sf_dir):
    return parse_edge_lines(edge_text(spark, sf_dir))


def q_vertices_from_edges(spark, sf_dir):
    return vertices_from_edges(order_part(spark, sf_dir))


def q_graph_size(spark, sf_dir):
    return graph_size(order_part(spark, sf_dir))


# ----------------------------------------------------------------------------- neighbours


def _one_step(spark, sf_dir, step: Callable) -> DataFrame:
    """``step`` on the order-part graph and its test colours; the table is read once for all of it."""
    es = nb.EdgeSet(order_part(spark, sf_dir), materialize=True, checkpoint=False)
    return _settled(step(es), es)


def q_edge_source_join(spark, sf_dir):
    return _one_step(spark, sf_dir, lambda es: nb.edge_source_join(es, seed_colors(es), "color"))


def q_neighbor_agg(spark, sf_dir):
    return _one_step(spark, sf_dir, lambda es: nb.neighbor_agg(es, seed_colors(es)))


def q_neighbor_any_black(spark, sf_dir):
    return _one_step(spark, sf_dir, lambda es: nb.neighbor_any_black(es, seed_colors(es)))


def q_white_neighbor_count(spark, sf_dir):
    return _one_step(spark, sf_dir, lambda es: nb.white_neighbor_count(es, seed_colors(es)))


def _spans(g):
    """One edge set and one held span state: the input is read once for all steps."""
    es = nb.EdgeSet(g, materialize=True, checkpoint=False)
    return es, es.partitioned(nb.white_neighbor_count(es, seed_colors(es))).persist()


def _settled(result: DataFrame, es: nb.EdgeSet, *held: DataFrame) -> DataFrame:
    """The result, written, and everything that was held for it let go."""
    out = result.checkpoint(eager=True)
    for frame in held:
        frame.unpersist(blocking=False)
    es.release()
    return out


def q_onehop_argmax(spark, sf_dir):
    es, spans = _spans(order_part(spark, sf_dir))
    return _settled(nb.onehop_argmax(es, spans), es, spans)


def q_twohop_local_max(spark, sf_dir):
    es, spans = _spans(order_part(spark, sf_dir))
    best = nb.onehop_argmax(es, spans).persist()
    return _settled(nb.twohop_local_max(es, spans.select("id", "wt").join(best, "id")), es, best, spans)


def q_neighbor_x_sum(spark, sf_dir):
    def step(es):
        xs = es.vertices().select("id", (F.lit(1.0) / (F.col("id") % 4 + 1)).alias("x"))
        return nb.neighbor_x_sum(es, xs)

    return _one_step(spark, sf_dir, step).select("id", F.round("sum_x", 6).alias("sum_x"))


def q_in_degree(spark, sf_dir):
    return nb.in_degree(order_part(spark, sf_dir))


def q_onehop_max_degree(spark, sf_dir):
    return _one_step(spark, sf_dir, nb.onehop_max_degree)


def q_twohop_max_degree(spark, sf_dir):
    es = nb.EdgeSet(order_part(spark, sf_dir), materialize=True, checkpoint=False)
    deg1 = nb.onehop_max_degree(es).persist()
    return _settled(nb.twohop_max_degree(es, deg1), es, deg1)


# ----------------------------------------------------------------------------- covers


def q_greedy_dominating_set(spark, sf_dir):
    return greedy_dominating_set(part_supplier(spark, sf_dir))


def q_greedy_dominating_set_orders(spark, sf_dir):
    return greedy_dominating_set(order_customer(spark, sf_dir))


def q_greedy_dominating_set_directed(spark, sf_dir):
    out = greedy_dominating_set_directed(customer_nation(spark, sf_dir))
    return out.select("id", "color", "halt_step")


def q_greedy_dominating_set_mixed(spark, sf_dir):
    return greedy_dominating_set_directed(orders_to_nations(spark, sf_dir))


def _rounded(df):
    return df.select("id", "color", F.round("x", 6).alias("x"))


def q_fractional_dominating_set(spark, sf_dir):
    return _rounded(fractional_dominating_set(part_supplier(spark, sf_dir), LP_K))


def q_round_fractional_ds(spark, sf_dir):
    es = nb.EdgeSet(part_supplier(spark, sf_dir), materialize=True)
    frac = fractional_dominating_set(es, LP_K)
    out = round_fractional_ds(es, frac, DRAW_SEED)  # checkpointed: independent of es
    es.release()
    return _rounded(out)


def q_lp_rounded_dominating_set(spark, sf_dir):
    return _rounded(lp_rounded_dominating_set(part_supplier(spark, sf_dir), LP_ROUNDED_K, None, DRAW_SEED))


def q_lp_rounded_dominating_set_mixed(spark, sf_dir):
    return _rounded(lp_rounded_dominating_set_any(orders_to_nations(spark, sf_dir), LP_K, None, DRAW_SEED))


def q_result_text_rows(spark, sf_dir):
    return result_text_rows(greedy_dominating_set(part_supplier(spark, sf_dir)), "halt_step")


def q_result_text_rows_lp(spark, sf_dir):
    out = lp_rounded_dominating_set(part_supplier(spark, sf_dir), LP_ROUNDED_K, None, DRAW_SEED)
    return result_text_rows(_rounded(out), "x")


def q_cover_report(spark, sf_dir):
    """Size and violations of both covers of the part-supplier graph; one edge set serves all."""
    es = nb.EdgeSet(part_supplier(spark, sf_dir), materialize=True)
    greedy = greedy_dominating_set(es)
    lp = lp_rounded_dominating_set(es, LP_ROUNDED_K, None, DRAW_SEED)
    report = cover_report(es, greedy, BLACK, [GRAY, BLACK]).select(F.lit("greedy").alias("cover"), "*").union(
        cover_report(es, lp, CHOSEN, [NOT_CHOSEN, CHOSEN]).select(F.lit("lp").alias("cover"), "*")
    )
    return _settled(report, es)


# ----------------------------------------------------------------------------- jobs


def _job(spark, graph: DataFrame, task: str, **options) -> DataFrame:
    """``run_task`` on an edge-list file that is written from a graph, through an edge store."""
    folder = f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    edge_lines(graph).write.text(f"{folder}/edges")
    try:
        store = f"{folder}/store"
        return run_task(spark, task, f"{folder}/edges", num_partitions=PARTITIONS_1D, edge_store=store, **options)
    finally:
        drop_path(spark, folder)  # the result is checkpointed


def q_job_greedy_cover(spark, sf_dir):
    return _job(spark, order_customer(spark, sf_dir), "greedy_cover")


def q_job_lp_cover(spark, sf_dir):
    graph = orders_to_nations(spark, sf_dir)
    return _rounded(_job(spark, graph, "lp_cover", k=1, delta=JOB_DELTA, part_strat=1, seed=DRAW_SEED))


# ----------------------------------------------------------------------------- partitioning


def q_edge_partition_1d(spark, sf_dir):
    g = order_part(spark, sf_dir)
    return g.select("src", "dst", partition_1d(F.col("src"), PARTITIONS_1D).alias("pid"))


def q_edge_partition_2d(spark, sf_dir):
    g = order_part(spark, sf_dir)
    return g.select(
        "src", "dst", partition_2d(F.col("src"), F.col("dst"), PARTITIONS_2D).alias("pid")
    )


def q_edge_partition_2d_nonsquare(spark, sf_dir):
    g = order_part(spark, sf_dir)
    return g.select(
        "src", "dst", partition_2d(F.col("src"), F.col("dst"), PARTITIONS_2D_NONSQUARE).alias("pid")
    )


def q_edge_partition_sizes(spark, sf_dir):
    return partition_sizes(order_part(spark, sf_dir), "2d", PARTITIONS_2D)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lines_scan": q_lines_scan,
    "tokenize": q_tokenize,
    "word_count": q_word_count,
    "popular_words": q_popular_words,
    "explode_chars": q_explode_chars,
    "popular_char_count": q_popular_char_count,
    "edge_list_scan": q_edge_list_scan,
    "vertices_from_edges": q_vertices_from_edges,
    "graph_size": q_graph_size,
    "edge_source_join": q_edge_source_join,
    "neighbor_agg": q_neighbor_agg,
    "neighbor_any_black": q_neighbor_any_black,
    "white_neighbor_count": q_white_neighbor_count,
    "onehop_argmax": q_onehop_argmax,
    "twohop_local_max": q_twohop_local_max,
    "neighbor_x_sum": q_neighbor_x_sum,
    "in_degree": q_in_degree,
    "onehop_max_degree": q_onehop_max_degree,
    "twohop_max_degree": q_twohop_max_degree,
    "greedy_dominating_set": q_greedy_dominating_set,
    "greedy_dominating_set_orders": q_greedy_dominating_set_orders,
    "greedy_dominating_set_directed": q_greedy_dominating_set_directed,
    "fractional_dominating_set": q_fractional_dominating_set,
    "round_fractional_ds": q_round_fractional_ds,
    "lp_rounded_dominating_set": q_lp_rounded_dominating_set,
    "lp_rounded_dominating_set_mixed": q_lp_rounded_dominating_set_mixed,
    "job_greedy_cover": q_job_greedy_cover,
    "job_lp_cover": q_job_lp_cover,
    "edge_partition_1d": q_edge_partition_1d,
    "edge_partition_2d": q_edge_partition_2d,
    "edge_partition_2d_nonsquare": q_edge_partition_2d_nonsquare,
    "edge_partition_sizes": q_edge_partition_sizes,
    "result_text_rows": q_result_text_rows,
    "result_text_rows_lp": q_result_text_rows_lp,
    "greedy_dominating_set_mixed": q_greedy_dominating_set_mixed,
    "cover_report": q_cover_report,
}
