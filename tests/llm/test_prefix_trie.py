"""The prefix trie against a plain version on small and odd tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkcover.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def head_of(c):
    return zlib.crc32(str(c).encode()) % 4


def base_of(c):
    return c - (abs(c) % 20) * (1 if c >= 0 else -1)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {c: own.get(base_of(c), [])[: head_of(c)] + v[head_of(c) :] for c, v in own.items()}
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        ends = sorted(c for c in members if len(built[c]) == len(prefix))
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in below}
        out[(min(members), len(prefix))] = (
            min(nodes[prefix[:-1]]) if prefix else None,
            len(members),
            len(children),
            len(leaves),
            sum((len(nodes[p]) - 1) * words[p] for p in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            prefix[-1] if prefix else None,
        )
    return out, own


def run(df):
    return prefix_trie(
        df,
        base=lambda c: c - c % 20,
        head_turns=lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)),
        max_head=3,
    )


def check(spark, rows, df=None):
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(5) if df is None else df).collect()
    want, own = brute(rows)
    assert len(got) == len(want)
    for r in got:
        expected = want[(r.conv_id, r.depth)]
        assert (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) == expected[:6], r
        stored = own[r.turn_conv_id][r.turn_no - 1] if r.depth else None
        assert stored == expected[6]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 90), 60):
        for t in range(rng.randrange(1, 7)):
            turn = rng.choice([t, t, t, None, 1])
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "x\ty z"])))
    rows += rng.sample(rows, 10) + [(None, 0, "user", "no conversation")]
    check(spark, rows)


def test_growing_snapshots_and_one_huge_conversation(spark):
    # each conversation is the one before and a turn more, under ids that skip the heads' groups;
    # one conversation holds most of the rows and spans every task
    rows = [(20 * (i + 1), t, "user", f"w{t}") for i in range(40) for t in range(i + 1)]
    rows += [(2000, t, "user", f"long {t}") for t in range(3000)]
    got = run(spark.createDataFrame(rows, SCHEMA)).where("n_children = 0").collect()
    assert {r.depth for r in got} == {40, 3000}
    top = run(spark.createDataFrame(rows, SCHEMA)).where("depth = 0").first()
    assert top.saved_tokens == sum(40 - t - 1 for t in range(40)) and top.n_leaves == 2


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(3000) for t in range(3)]
    check(spark, rows)


def test_long_text_and_clashing_columns(spark):
    rows = [(1, 0, "user", "word " * 200_000), (20, 0, "user", "word " * 200_000), (2, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS d", "'x' AS depth", "'y' AS n_convs")
    check(spark, rows, df)


def test_no_rows(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
