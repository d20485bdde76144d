"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Each query is fully computed with the ``noop`` sink (every row produced, nothing
collected to the driver). Iterative covers also report rounds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sparkcover import catalog as C  # noqa: E402
from sparkcover.plans.greedy import greedy_dominating_set  # noqa: E402
from sparkcover.plans.lp import lp_rounded_dominating_set  # noqa: E402
from sparkcover.session import local_session  # noqa: E402
from sparkcover.sources.edges import bipartite_edges  # noqa: E402


def order_customer(spark, sf_dir):
    return bipartite_edges(C.table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    extra: dict = {}

    def greedy_orders(s, d):
        st: dict = {}
        out = greedy_dominating_set(order_customer(s, d), stats_out=st)
        extra["greedy_order_customer_rounds"] = st["rounds"]
        return out

    def greedy_parts(s, d):
        st: dict = {}
        out = greedy_dominating_set(C.part_supplier(s, d), stats_out=st)
        extra["greedy_part_supplier_rounds"] = st["rounds"]
        return out

    def lp_parts(s, d):
        return lp_rounded_dominating_set(C.part_supplier(s, d), C.LP_K, None, C.DRAW_SEED)

    headline = {
        "popular_char_count": C.q_popular_char_count,
        "tokenize": C.q_tokenize,
        "edge_list_scan": C.q_edge_list_scan,
        "graph_size": C.q_graph_size,
        "twohop_max_degree": C.q_twohop_max_degree,
        "onehop_argmax": C.q_onehop_argmax,
        "edge_partition_sizes": C.q_edge_partition_sizes,
        "greedy_order_customer": greedy_orders,
        "greedy_part_supplier": greedy_parts,
        "lp_rounded_part_supplier": lp_parts,
    }
    only = [k for k in os.environ.get("BENCH_ONLY", "").split(",") if k]
    times = {}
    # warm the JVM (class loading, codegen caches) on a throwaway query
    spark.range(1000).select(F.sum("id")).collect()
    for name, fn in headline.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                **extra,
            }
        )
    )


if __name__ == "__main__":
    main()
