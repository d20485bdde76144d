"""Ranked search against a plain version: scores, ties, pruning, passes, odd tables."""

import math
import random
import re
from collections import Counter

import pytest

from sparkcover.llm.ranked_search import ranked_search

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    listed = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, all_terms = len(listed), sum(n for _, _, n in listed)
    df = Counter(t for _, c, _ in listed for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, c, n in listed:
            m = 100 - 25 + (25 * n * n_docs) // all_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if t in c
            )
            if s > 0:
                scores.append((-s, d is not None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=5, **more):
    got = ranked_search(
        spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), k=k, **more
    ).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, k)


def test_many_items_leave_bundles_small(spark, monkeypatch):
    """A pass of many items travels in groups: no bundle grows with the number of items."""
    from sparkcover.llm import ranked_search as module

    cells, write = [], module.written

    def counted(df, label, *more):
        out = write(df, label, *more)
        if label == "search-bundles":
            cells.extend(r[0] // 4 for r in out.selectExpr("octet_length(places)").collect())
        return out

    monkeypatch.setattr(module, "written", counted)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, items = [(i, text(9)) for i in range(120)], [(i, text(4)) for i in range(64)]
    docs += [(i, "none of them") for i in range(900, 1000)]
    check(spark, docs, items, block_docs=32, bundle_cells=256)
    assert cells and 0 < max(cells) <= 256


def test_blocks_of_long_documents_are_cut_by_postings(spark, monkeypatch):
    from sparkcover.llm import ranked_search as module

    blocks, write = [], module.written

    def counted(df, label, *more):
        out = write(df, label, *more)
        if label == "search-index":
            rows = out.where("term is not null").selectExpr("block", "octet_length(places) / 4 AS n").groupBy("block").sum("n")
            blocks.extend(r[1] for r in rows.collect())
        return out

    monkeypatch.setattr(module, "written", counted)
    monkeypatch.setattr(module, "BLOCK_POSTINGS", 50)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[i % 7 :])) for i in range(60)] + [(99, "w3 x")]
    check(spark, docs, [(i, " ".join(words[i::5])) for i in range(5)])
    assert len(blocks) > 8 and max(blocks) < 50 + len(words)


@pytest.mark.parametrize("more", [{}, {"owners": 1}, {"block_docs": 7, "owners": 6}, {"pass_bytes": 60, "block_docs": 50}])
def test_random_tables(spark, more):
    rng = random.Random(9)
    vocabulary = ["The", "of", "and"] * 12 + [f"w{i}" for i in range(40)] + ["Éa", "été", "x_y", "a-b", "😀", "42"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))
    docs = [(i, text(60)) for i in range(150)] + [(i, "the of w1 w2") for i in range(200, 260)]
    docs += [(None, "w1 w2 w3"), (5, "w1 w2 w3"), (6, None), (7, ""), (8, "---"), (9, "w3 " * 20_000)]
    items = [(i, text(12)) for i in range(12)] + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (20, None), (21, "?"), (None, "w5 w6")]
    check(spark, docs, items, **more)


def test_a_term_of_every_document_weighs_nothing_alone(spark):
    check(spark, [(i, "same words here") for i in range(30)] + [(99, "other same")], [(1, "same"), (2, "words"), (3, "absent")])


def test_empty_tables_and_clashing_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs.selectExpr("*", "1 AS score", "2 AS t", "'x' AS doc"), items.selectExpr("*", "1 AS i", "2 AS rank")).columns == [
        "item_id", "rank", "doc_id", "score",
    ]


def test_registered_query_on_given_tables(spark):
    from sparkcover.llm.queries import op12_ranked_search

    read = lambda t: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(f"{t[:3] if t != 'benchmark' else 'item'}_id", "text").collect()]  # noqa: E731, E501
    got = sorted(map(tuple, op12_ranked_search(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(read("documents"), read("benchmark"), 20)
