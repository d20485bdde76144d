"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the operator semantics, not from the Spark code: the greedy covers are
recursive CTEs that run until no vertex is live (or, for the directed program, until
no message is sent), the fractional passes are a chain of materialized CTEs with its
own schedule, per-vertex maxima use row values, partition ids use HUGEINT. Nothing is
imported from the code under test but the parameters of the registered queries.
"""

from __future__ import annotations

import math

from sparkcover.catalog import (
    DRAW_SEED,
    JOB_DELTA,
    LP_K,
    LP_ROUNDED_K,
    PARTITIONS_1D,
    PARTITIONS_2D,
    PARTITIONS_2D_NONSQUARE,
    POPULAR_THRESHOLD,
)

# Fixed value: the odd 64-bit constant that scrambles ids in the partition strategies.
MIXING_PRIME = 1125899906842597


def _bipartite(a: str, b: str) -> str:
    return (
        f"fwd AS (SELECT DISTINCT 2 * {a} AS src, 2 * {b} + 1 AS dst FROM lineitem "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL), "
        "g AS (SELECT src, dst FROM fwd UNION ALL SELECT dst AS src, src AS dst FROM fwd)"
    )


def _bipartite_of(table: str, a: str, b: str) -> str:
    return _bipartite(a, b).replace("FROM lineitem", f"FROM {table}")


ORDER_PART = _bipartite("l_orderkey", "l_partkey")
ORDER_CUSTOMER = _bipartite_of("orders", "o_orderkey", "o_custkey")
CUSTOMER_NATION = _bipartite_of("customer", "c_custkey", "c_nationkey")
PART_SUPPLIER = _bipartite("l_partkey", "l_suppkey")

LINES = (
    "raw AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS a0 FROM documents), "
    "arrs AS (SELECT doc_id, CASE WHEN a0[len(a0)] = '' THEN a0[1:len(a0) - 1] ELSE a0 END AS a "
    "FROM raw), "
    "lines AS (SELECT doc_id, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line_no, "
    "unnest(a) AS line FROM arrs)"
)
WORDS = (
    "words AS (SELECT doc_id, unnest(CASE WHEN line = '' THEN [''] "
    "WHEN rtrim(line, ' ') = '' THEN CAST([] AS VARCHAR[]) "
    "ELSE string_split(rtrim(line, ' '), ' ') END) AS word FROM lines)"
)
WORD_COUNTS = "wc AS (SELECT word, count(*) AS n FROM words GROUP BY word)"
POPULAR = f"pw AS (SELECT word, n FROM wc WHERE n >= {POPULAR_THRESHOLD})"
CHARS = (
    "chs AS (SELECT word, regexp_extract_all(word, '(?s).') AS c FROM pw), "
    "pc AS (SELECT word, CAST(unnest(range(1, len(c) + 1)) AS INTEGER) AS pos, "
    "unnest(c) AS ch FROM chs)"
)

SEED_COLORS = (
    "v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), "
    "sc AS (SELECT id, CAST(CASE WHEN id % 5 = 0 THEN -5 WHEN id % 3 = 0 THEN -4 ELSE -3 END "
    "AS INTEGER) AS color FROM v)"
)
SPANS = (
    "spans AS (SELECT sc.id, CAST(coalesce(m.w, 0) AS BIGINT) AS wt, "
    "(sc.color = -5 OR (sc.color = -4 AND coalesce(m.w, 0) = 0)) AS off FROM sc LEFT JOIN "
    "(SELECT g.dst AS id, count(*) FILTER (WHERE t.color = -3) AS w FROM g JOIN sc t "
    "ON g.src = t.id GROUP BY g.dst) m ON sc.id = m.id)"
)
ARGMAX = (
    "am AS (SELECT s.id, s.wt, greatest(row(s.wt, -s.id), coalesce(m.kb, row(s.wt, -s.id))) AS best, "
    "CAST(coalesce(m.na, 0) AS BIGINT) AS n_active FROM spans s LEFT JOIN "
    "(SELECT g.dst AS id, max(row(t.wt, -t.id)) AS kb, count(*) AS na FROM g JOIN spans t "
    "ON g.src = t.id WHERE NOT t.off GROUP BY g.dst) m ON s.id = m.id)"
)
DEGREES = (
    "deg AS (SELECT dst AS id, count(*) AS deg FROM g GROUP BY dst), "
    "deg1 AS (SELECT g.dst AS id, max(d.deg) AS deg1 FROM g JOIN deg d ON g.src = d.id "
    "GROUP BY g.dst)"
)


def _wrapped_abs(col: str) -> str:
    """abs() of the 64-bit wrapped product col * MIXING_PRIME, as HUGEINT."""
    two64 = 1 << 64
    m = f"((CAST({col} AS HUGEINT) * {MIXING_PRIME}) % {two64} + {two64}) % {two64}"
    return f"abs(CASE WHEN {m} >= {1 << 63} THEN {m} - {two64} ELSE {m} END)"


def _pid_2d(n: int) -> str:
    c = int(math.ceil(math.sqrt(n)))
    a, b = _wrapped_abs("src"), _wrapped_abs("dst")
    if n == c * c:
        return f"CAST((({a} % {c}) * {c} + {b} % {c}) % {n} AS INTEGER)"
    rows = (n + c - 1) // c
    last = n - rows * (c - 1)
    col = f"(({a} % {n}) // {rows})"
    return (
        f"CAST({col} * {rows} + CASE WHEN {col} < {c - 1} THEN {b} % {rows} "
        f"ELSE {b} % {last} END AS INTEGER)"
    )


def greedy_sql(graph: str) -> str:
    """Greedy cover by rounds until no vertex is live: CTE ``greedy(id, color, halt_step)``.

    A round on the state ``s``: recolour, span, one-hop best and halting, select. In
    round 0 nothing is black, so recolouring changes nothing.
    """
    step = (
        "a AS (SELECT s.r, s.id, CASE WHEN s.halt_step IS NULL AND s.color <> -5 "
        "AND coalesce(m.b, false) THEN -4 ELSE s.color END AS color, s.halt_step "
        "FROM s LEFT JOIN (SELECT g.dst AS id, bool_or(t.color = -5) AS b FROM g "
        "JOIN s t ON g.src = t.id WHERE t.halt_step IS NULL GROUP BY g.dst) m ON s.id = m.id), "
        "b AS (SELECT s.r, s.id, s.color, s.halt_step, coalesce(m.w, 0) AS wt, "
        "(s.color = -5 OR (s.color = -4 AND coalesce(m.w, 0) = 0)) AS off FROM a s "
        "LEFT JOIN (SELECT g.dst AS id, count(*) FILTER (WHERE t.color = -3) AS w FROM g "
        "JOIN a t ON g.src = t.id WHERE t.halt_step IS NULL GROUP BY g.dst) m ON s.id = m.id), "
        "c AS (SELECT s.r, s.id, s.color, s.wt, CASE WHEN s.halt_step IS NULL "
        "AND m.kb IS NULL THEN 4 * s.r + 3 ELSE s.halt_step END AS halt_step, "
        "greatest(row(s.wt, -s.id), coalesce(m.kb, row(s.wt, -s.id))) AS best FROM b s "
        "LEFT JOIN (SELECT g.dst AS id, max(row(t.wt, -t.id)) AS kb FROM g JOIN b t "
        "ON g.src = t.id WHERE t.halt_step IS NULL AND NOT t.off GROUP BY g.dst) m ON s.id = m.id) "
        "SELECT s.r + 1, s.id, CAST(CASE WHEN s.halt_step IS NULL AND s.color <> -5 "
        "AND (m.mb IS NULL OR m.mb <= row(s.wt, -s.id)) THEN -5 ELSE s.color END AS INTEGER), "
        "CAST(s.halt_step AS INTEGER) FROM c s LEFT JOIN (SELECT g.dst AS id, max(t.best) AS mb FROM g "
        "JOIN c t ON g.src = t.id WHERE t.halt_step IS NULL GROUP BY g.dst) m ON s.id = m.id "
        "WHERE EXISTS (SELECT 1 FROM s WHERE halt_step IS NULL)"
    )
    graph = graph.replace("fwd AS (", "fwd AS MATERIALIZED (").replace("g AS (", "g AS MATERIALIZED (")
    return (
        f"WITH RECURSIVE {graph}, s(r, id, color, halt_step) AS (SELECT DISTINCT 0, src, CAST(-3 AS INTEGER), "
        f"CAST(NULL AS INTEGER) FROM g UNION ALL (WITH {step})), "
        "greedy AS (SELECT id, color, halt_step FROM s WHERE r = (SELECT max(r) FROM s))"
    )


def superstep_sql(graph: str) -> str:
    """The vertex program superstep by superstep, for any directed multigraph that stops.

    State after the first superstep: every vertex has sent ``(own id, white)``. A vertex
    that gets messages runs its phase (step mod 4): recolour, count whites, one-hop best
    or halt (step -1), select; only vertices that got messages send the next time. CTE
    ``program(id, color, value, halt_step, converged)``.
    """
    got = (
        "got AS (SELECT g.dst AS id, count(*) AS n, bool_or(t.mval = -5) AS any_black, "
        "count(*) FILTER (WHERE t.mval = -3) AS whites, count(*) FILTER (WHERE t.mval <> -1) AS acting, "
        "max(row(t.mval, -t.mid)) FILTER (WHERE t.mval >= 0) AS best FROM g JOIN s t ON g.src = t.id "
        "WHERE t.active AND t.step >= 0 GROUP BY g.dst)"
    )
    moved = (
        "moved AS (SELECT s.*, m.n IS NOT NULL AS heard, m.n IS NOT NULL AND s.step >= 0 AS runs, s.step % 4 AS ph, "
        "m.whites, m.acting, CASE WHEN s.color <> -5 AND m.any_black THEN -4 ELSE s.color END AS recoloured, "
        "greatest(row(CAST(s.wt AS BIGINT), -s.id), coalesce(m.best, row(CAST(s.wt AS BIGINT), -s.id))) AS top, "
        "CASE WHEN s.color <> -5 AND NOT coalesce(m.best > row(CAST(s.wt AS BIGINT), -s.id), false) THEN -5 "
        "ELSE s.color END AS picked FROM s LEFT JOIN got m ON s.id = m.id)"
    )
    step = (
        "SELECT it + 1, id, CAST(CASE WHEN NOT runs THEN step WHEN ph = 2 AND acting = 0 THEN -1 ELSE step + 1 END AS INTEGER), "
        "CAST(CASE WHEN NOT runs THEN color WHEN ph = 0 THEN recoloured WHEN ph = 3 THEN picked ELSE color END AS INTEGER), "
        "CAST(CASE WHEN NOT runs THEN wt WHEN ph = 1 THEN whites WHEN ph = 2 AND acting = 0 THEN step + 1 ELSE wt END AS INTEGER), "
        "CAST(CASE WHEN NOT runs THEN mid WHEN ph = 2 THEN -top[2] ELSE id END AS BIGINT), "
        "CAST(CASE WHEN NOT runs THEN mval WHEN ph = 0 THEN recoloured WHEN ph = 1 THEN "
        "CASE WHEN color = -5 OR (color = -4 AND whites = 0) THEN -1 ELSE whites END "
        "WHEN ph = 2 THEN top[1] ELSE picked END AS BIGINT), heard FROM moved WHERE EXISTS (SELECT 1 FROM got)"
    )
    return (
        f"WITH RECURSIVE {graph}, s(it, id, step, color, wt, mid, mval, active) AS ("
        "SELECT 0, id, CAST(1 AS INTEGER), CAST(-3 AS INTEGER), CAST(0 AS INTEGER), CAST(id AS BIGINT), "
        "CAST(-3 AS BIGINT), true FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) "
        f"UNION ALL (WITH {got}, {moved} {step})), "
        "program AS (SELECT id, color, wt AS value, CASE WHEN step < 0 THEN wt END AS halt_step, "
        "true AS converged FROM s WHERE it = (SELECT max(it) FROM s))"
    )


ORDERS_TO_NATIONS = (
    "one_way AS (SELECT DISTINCT 3 * o_orderkey AS src, 3 * o_custkey + 1 AS dst FROM orders "
    "WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL), "
    "links AS (SELECT DISTINCT 3 * c_custkey + 1 AS src, 3 * CAST(c_nationkey AS BIGINT) + 2 AS dst FROM customer "
    "WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL), "
    "g AS MATERIALIZED (SELECT src, dst FROM one_way UNION ALL SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links)"
)


def lp_superstep_sql(graph: str, k: int, seed: int, delta: int | None = None) -> str:
    """The fractional and rounding program on any edge list, superstep by superstep: ``program(id, color, x)``.

    ``delta`` defaults to the largest in-degree.
    """
    largest = "max(d)" if delta is None else str(int(delta))
    last = 2 * k * k
    power = f"pow(CAST((SELECT delta FROM dmax) + 1 AS DOUBLE), CAST({{}} AS DOUBLE) / {k})"
    passes = "(step - 1) // 2"
    threshold, level = power.format(f"{k - 1} - ({passes}) // {k}"), "1.0 / " + power.format(f"{k - 1} - ({passes}) % {k}")
    u = (
        f"(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':{int(seed)}'), 1, 8)) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE)"
    )
    got = (
        "got AS (SELECT g.dst AS id, count(*) AS n, count(t.msg) AS n_values, count(*) FILTER (WHERE t.msg = -1) AS whites, "
        "fsum(t.msg) AS total, greatest(coalesce(max(t.msg), 0), 0) AS most, coalesce(bool_or(t.msg = 2), false) AS any2 "
        "FROM g JOIN s t ON g.src = t.id WHERE t.active GROUP BY g.dst)"
    )
    moved = (
        f"moved AS (SELECT s.*, m.n IS NOT NULL AS heard, step < {last} AND step % 2 = 1 AS odd, m.n_values, m.any2, "
        f"CAST(floor(m.most) AS BIGINT) AS top, m.total, CASE WHEN m.whites >= {threshold} THEN greatest(x, {level}) ELSE x END AS raised "
        "FROM s LEFT JOIN got m ON s.id = m.id)"
    )
    coloured = (
        "coloured AS (SELECT *, CASE WHEN NOT heard OR odd THEN color "
        f"WHEN step <= {last} THEN CASE WHEN total >= 1 THEN -2 ELSE color END WHEN step = {last + 1} THEN 0 "
        f"WHEN step = {last + 4} THEN CASE WHEN {u} <= least(1.0, x * ln(1 + CAST(greatest(top, deg) AS DOUBLE))) THEN 2 ELSE 0 END "
        f"WHEN step = {last + 5} AND NOT any2 THEN 2 ELSE color END AS c2, "
        f"CASE WHEN NOT heard THEN deg WHEN step = {last + 1} THEN 0 WHEN step = {last + 2} THEN n_values "
        f"WHEN step = {last + 3} THEN top WHEN step = {last + 4} THEN greatest(top, deg) ELSE deg END AS d2 FROM moved)"
    )
    step = (
        "SELECT it + 1, id, CAST(CASE WHEN heard THEN step + 1 ELSE step END AS INTEGER), CAST(c2 AS INTEGER), "
        "CASE WHEN heard AND odd THEN raised ELSE x END, CAST(d2 AS BIGINT), "
        f"CASE WHEN NOT heard THEN msg WHEN odd THEN raised WHEN step <= {last} THEN CAST(c2 AS DOUBLE) WHEN step = {last + 1} THEN 1.0 "
        f"WHEN step IN ({last + 2}, {last + 3}) THEN CAST(d2 AS DOUBLE) WHEN step = {last + 4} THEN CAST(c2 AS DOUBLE) END, "
        f"heard FROM coloured WHERE it < {last + 6}"
    )
    return (
        f"WITH RECURSIVE {graph}, dmax AS (SELECT {largest} AS delta FROM (SELECT count(*) AS d FROM g GROUP BY dst) LIMIT 1), "
        "s(it, id, step, color, x, deg, msg, active) AS (SELECT 0, CAST(id AS BIGINT), CAST(1 AS INTEGER), CAST(-1 AS INTEGER), "
        "CAST(0 AS DOUBLE), CAST(0 AS BIGINT), CAST(-1 AS DOUBLE), true FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) "
        f"UNION ALL (WITH {got}, {moved}, {coloured} {step})), "
        f"program AS (SELECT id, color, x FROM s WHERE it = {last + 6})"
    )


def lp_sql(graph: str, k: int) -> list[str]:
    """CTE list computing ``frac(id, color, x)``; delta = the graph's max in-degree."""
    lv_cols = ", ".join(
        [f"1.0 / pow(CAST(delta + 1 AS DOUBLE), CAST({m} AS DOUBLE) / {k}) AS lv{m}" for m in range(k)]
        + [f"pow(CAST(delta + 1 AS DOUBLE), CAST({l} AS DOUBLE) / {k}) AS th{l}" for l in range(k)]
    )
    ctes = [
        graph,
        "dmax AS (SELECT max(d) AS delta FROM (SELECT count(*) AS d FROM g GROUP BY dst))",
        f"lv AS MATERIALIZED (SELECT {lv_cols} FROM dmax)",
        "p0 AS MATERIALIZED (SELECT DISTINCT src AS id, -1 AS color, CAST(0.0 AS DOUBLE) AS x FROM g)",
    ]

    def lvl(j):
        return f"(SELECT lv{j} FROM lv)"

    passes = [(l, m) for l in reversed(range(k)) for m in reversed(range(k))]
    for i, (l, m) in enumerate(passes):
        ctes.append(
            f"o{i} AS MATERIALIZED (SELECT s.id, s.color, CASE WHEN coalesce(m.nw, 0) >= "
            f"(SELECT th{l} FROM lv) THEN greatest(s.x, {lvl(m)}) ELSE s.x END AS x "
            f"FROM p{i} s LEFT JOIN (SELECT g.dst AS id, count(*) FILTER (WHERE t.color = -1) AS nw "
            f"FROM g JOIN p{i} t ON g.src = t.id GROUP BY g.dst) m ON s.id = m.id)"
        )
        counts = ", ".join(
            f"count(*) FILTER (WHERE t.x = {lvl(j)}) AS c{j}" for j in range(k)
        )
        total = " + ".join(
            f"CAST(coalesce(m.c{j}, 0) AS DOUBLE) * {lvl(j)}" for j in range(k)
        )
        ctes.append(
            f"p{i + 1} AS MATERIALIZED (SELECT s.id, CASE WHEN ({total}) >= 1.0 THEN -2 "
            f"ELSE s.color END AS color, s.x FROM o{i} s LEFT JOIN (SELECT g.dst AS id, {counts} "
            f"FROM g JOIN o{i} t ON g.src = t.id GROUP BY g.dst) m ON s.id = m.id)"
        )
    ctes.append(f"frac AS (SELECT id, CAST(color AS INTEGER) AS color, x FROM p{k * k})")
    return ctes


def rounding_ctes(seed: int) -> list[str]:
    """CTEs computing ``rounded(id, color, x)`` from ``frac`` and ``g``."""
    u = (
        f"(CAST(('0x' || substr(md5(CAST(f.id AS VARCHAR) || ':{int(seed)}'), 1, 8)) AS BIGINT) + 1) "
        f"/ CAST(4294967297 AS DOUBLE)"
    )
    return [
        DEGREES,
        "nbd AS (SELECT g.dst AS id, max(d.deg1) AS m FROM g JOIN deg1 d ON g.src = d.id "
        "GROUP BY g.dst)",
        f"drawn AS MATERIALIZED (SELECT f.id, f.x, CASE WHEN {u} <= least(1.0, f.x * "
        f"ln(1 + CAST(greatest(coalesce(d.deg1, 0), coalesce(n.m, 0), 0) AS DOUBLE))) THEN 2 "
        f"ELSE 0 END AS color FROM frac f LEFT JOIN deg1 d ON f.id = d.id "
        f"LEFT JOIN nbd n ON f.id = n.id)",
        "rounded AS (SELECT d.id, CAST(CASE WHEN coalesce(m.any2, false) THEN d.color ELSE 2 END "
        "AS INTEGER) AS color, d.x FROM drawn d LEFT JOIN (SELECT g.dst AS id, "
        "bool_or(t.color = 2) AS any2 FROM g JOIN drawn t ON g.src = t.id GROUP BY g.dst) m "
        "ON d.id = m.id)",
    ]


def oracle_sql() -> dict[str, str]:
    """All oracle queries, keyed like ``catalog.QUERIES``."""
    text = f"WITH {LINES}"
    q: dict[str, str] = {
        "lines_scan": f"{text} SELECT doc_id, line_no, line FROM lines",
        "tokenize": f"{text}, {WORDS} SELECT doc_id, word, count(*) AS n FROM words "
        "GROUP BY doc_id, word",
        "word_count": f"{text}, {WORDS}, {WORD_COUNTS} SELECT word, n FROM wc",
        "popular_words": f"{text}, {WORDS}, {WORD_COUNTS}, {POPULAR} SELECT word, n FROM pw",
        "explode_chars": f"{text}, {WORDS}, {WORD_COUNTS}, {POPULAR}, {CHARS} "
        "SELECT word, pos, ch FROM pc",
        "popular_char_count": f"{text}, {WORDS}, {WORD_COUNTS}, {POPULAR}, {CHARS} "
        "SELECT ch, count(*) AS n FROM pc GROUP BY ch",
    }
    op = f"WITH {ORDER_PART}"
    tokens = "regexp_split_to_array(value, '\\s+')"
    q["edge_list_scan"] = (
        f"{op}, txt AS (SELECT CASE WHEN src % 2 = 0 THEN printf('%d %d', src, dst) "
        "ELSE printf('%d\t%d 1.0', src, dst) END AS value FROM g "
        "UNION ALL SELECT '# order-part graph' UNION ALL SELECT '') "
        f"SELECT CAST({tokens}[1] AS BIGINT) AS src, CAST({tokens}[2] AS BIGINT) AS dst "
        "FROM txt WHERE value <> '' AND NOT starts_with(value, '#')"
    )
    q["vertices_from_edges"] = f"{op} SELECT src AS id FROM g UNION SELECT dst FROM g"
    q["graph_size"] = (
        f"{op} SELECT (SELECT count(*) FROM (SELECT src FROM g UNION SELECT dst FROM g)) "
        "AS n_vertices, (SELECT count(*) FROM g) AS n_edges"
    )
    seeded = f"{op}, {SEED_COLORS}"
    q["edge_source_join"] = (
        f"{seeded} SELECT g.src, g.dst, t.color AS src_color FROM g JOIN sc t ON g.src = t.id"
    )
    q["neighbor_agg"] = (
        f"{seeded} SELECT g.dst AS id, count(*) AS n_msgs, "
        "count(*) FILTER (WHERE t.color = -3) AS n_white, "
        "count(*) FILTER (WHERE t.color = -5) AS n_black "
        "FROM g JOIN sc t ON g.src = t.id GROUP BY g.dst"
    )
    q["neighbor_any_black"] = (
        f"{seeded} SELECT sc.id, CAST(CASE WHEN sc.color <> -5 AND coalesce(m.b, false) "
        "THEN -4 ELSE sc.color END AS INTEGER) AS color FROM sc LEFT JOIN "
        "(SELECT g.dst AS id, bool_or(t.color = -5) AS b FROM g JOIN sc t ON g.src = t.id "
        "GROUP BY g.dst) m ON sc.id = m.id"
    )
    q["white_neighbor_count"] = f"{seeded}, {SPANS} SELECT id, wt, off FROM spans"
    q["onehop_argmax"] = (
        f"{seeded}, {SPANS}, {ARGMAX} SELECT id, CAST(-best[2] AS BIGINT) AS best_id, "
        "CAST(best[1] AS BIGINT) AS best_wt, n_active FROM am"
    )
    q["twohop_local_max"] = (
        f"{seeded}, {SPANS}, {ARGMAX} SELECT a.id, (m.mb IS NULL OR m.mb <= row(a.wt, -a.id)) "
        "AS selected FROM am a LEFT JOIN (SELECT g.dst AS id, max(t.best) AS mb FROM g "
        "JOIN am t ON g.src = t.id GROUP BY g.dst) m ON a.id = m.id"
    )
    q["neighbor_x_sum"] = (
        f"{op}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), "
        "xs AS (SELECT id, 1.0 / CAST(id % 4 + 1 AS DOUBLE) AS x FROM v) "
        "SELECT g.dst AS id, round(sum(t.x), 6) AS sum_x FROM g JOIN xs t ON g.src = t.id "
        "GROUP BY g.dst"
    )
    q["in_degree"] = f"{op} SELECT dst AS id, count(*) AS deg FROM g GROUP BY dst"
    q["onehop_max_degree"] = (
        f"{op}, {DEGREES} SELECT id, CAST(deg1 AS BIGINT) AS deg1 FROM deg1"
    )
    q["twohop_max_degree"] = (
        f"{op}, {DEGREES} SELECT d.id, CAST(greatest(d.deg1, coalesce(m.m, 0), 0) AS BIGINT) "
        "AS deg2 FROM deg1 d LEFT JOIN (SELECT g.dst AS id, max(t.deg1) AS m FROM g "
        "JOIN deg1 t ON g.src = t.id GROUP BY g.dst) m ON d.id = m.id"
    )
    greedy = greedy_sql(PART_SUPPLIER)
    q["greedy_dominating_set"] = f"{greedy} SELECT id, color, halt_step FROM greedy"
    for key, graph in (
        ("greedy_dominating_set_orders", ORDER_CUSTOMER),
        ("greedy_dominating_set_directed", CUSTOMER_NATION),
    ):
        q[key] = f"{greedy_sql(graph)} SELECT id, color, halt_step FROM greedy"
    q["greedy_dominating_set_mixed"] = (
        f"{superstep_sql(ORDERS_TO_NATIONS)} SELECT id, color, value, halt_step, converged FROM program"
    )
    q["result_text_rows"] = (
        f"{greedy} SELECT CAST(id AS VARCHAR) || chr(9) || '(' || CAST(color AS VARCHAR) || ',' "
        "|| CAST(halt_step AS VARCHAR) || ')' AS line FROM greedy"
    )
    frac2 = ", ".join(lp_sql(PART_SUPPLIER, LP_K))
    q["fractional_dominating_set"] = f"WITH {frac2} SELECT id, color, round(x, 6) AS x FROM frac"
    rnd = ", ".join(rounding_ctes(DRAW_SEED))
    q["round_fractional_ds"] = (
        f"WITH {frac2}, {rnd} SELECT id, color, round(x, 6) AS x FROM rounded"
    )
    q["lp_rounded_dominating_set_mixed"] = (
        f"{lp_superstep_sql(ORDERS_TO_NATIONS, LP_K, DRAW_SEED)} SELECT id, color, round(x, 6) AS x FROM program"
    )
    q["job_greedy_cover"] = q["greedy_dominating_set_orders"]
    q["job_lp_cover"] = (
        f"{lp_superstep_sql(ORDERS_TO_NATIONS, 1, DRAW_SEED, JOB_DELTA)} SELECT id, color, round(x, 6) AS x FROM program"
    )
    frac1 = ", ".join(lp_sql(PART_SUPPLIER, LP_ROUNDED_K))
    q["lp_rounded_dominating_set"] = (
        f"WITH {frac1}, {rnd} SELECT id, color, round(x, 6) AS x FROM rounded"
    )
    q["result_text_rows_lp"] = (
        f"WITH {frac1}, {rnd} SELECT CAST(id AS VARCHAR) || chr(9) || '(' || CAST(color AS VARCHAR) || ',' "
        "|| CAST(round(x, 6) AS VARCHAR) || ')' AS line FROM rounded"
    )

    def report(cover: str, name: str, chosen: int, other: int) -> str:
        return (
            f"SELECT '{name}' AS cover, count(*) AS n_vertices, count(*) FILTER (WHERE color = {chosen}) AS n_chosen, "
            f"count(*) FILTER (WHERE color <> {chosen} AND NOT EXISTS (SELECT 1 FROM g JOIN {cover} t ON g.src = t.id "
            f"WHERE g.dst = c.id AND t.color = {chosen})) AS n_undominated, "
            f"count(*) FILTER (WHERE color NOT IN ({chosen}, {other})) AS n_bad_color FROM {cover} c"
        )

    lp_only = ", ".join(lp_sql(PART_SUPPLIER, LP_ROUNDED_K)[1:])  # the graph is there already
    q["cover_report"] = (
        f"{greedy}, {lp_only}, {rnd} {report('greedy', 'greedy', -5, -4)} UNION ALL {report('rounded', 'lp', 2, 0)}"
    )
    q["edge_partition_1d"] = (
        f"{op} SELECT src, dst, CAST({_wrapped_abs('src')} % {PARTITIONS_1D} AS INTEGER) AS pid "
        "FROM g"
    )
    q["edge_partition_2d"] = f"{op} SELECT src, dst, {_pid_2d(PARTITIONS_2D)} AS pid FROM g"
    q["edge_partition_2d_nonsquare"] = (
        f"{op} SELECT src, dst, {_pid_2d(PARTITIONS_2D_NONSQUARE)} AS pid FROM g"
    )
    q["edge_partition_sizes"] = (
        f"{op} SELECT {_pid_2d(PARTITIONS_2D)} AS pid, count(*) AS n_edges FROM g GROUP BY 1"
    )
    return q
