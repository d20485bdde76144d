"""Substring dedup, SimHash groups and decontamination against plain versions."""

import random

import numpy as np
import pytest

from sparkcover.llm import substring
from sparkcover.llm.decontaminate import mark_benchmark
from sparkcover.llm.simhash import components, near_duplicate_groups
from sparkcover.llm.substring import FmIndex, WaveletMatrix, remove_repeated_passages
from tests.llm import brute

SCHEMA = "doc_id long, text string, route string, W0_x int"


def corpus(seed, n=120, words=400):
    """Documents with copies, shared passages, repeats in a text, odd white space and odd rows."""
    r = random.Random(seed)
    vocab = ["the", "a", "Über", "naïve", "x y", "."] + [f"w{k}" for k in range(words)]
    passages = [[r.choice(vocab) for _ in range(r.randint(13, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.2:
            text = r.choice(rows)[1]
        elif kind < 0.25:
            text = " ".join([r.choice(vocab)] * r.randint(5, 200))
        else:
            body = [r.choice(vocab) for _ in range(r.randint(1, 150))]
            for _ in range(r.randint(0, 2)):
                at = r.randint(0, len(body))
                body[at:at] = r.choice(passages)
            text = r.choice([" ", "\n", "\t ", "  "]).join(body)
        rows.append((i * 3 % n if r.random() < 0.97 else None, text))
    rows += [(5, None), (6, ""), (7, " \n "), (5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (1, "One")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1) for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed,hot,shard", [(1, 4096, 1 << 19), (2, 3, 500), (3, 0, 100)])
def test_passages_match_brute_force(spark, seed, hot, shard):
    rows = corpus(seed, words=400 if seed < 3 else 3)
    out = remove_repeated_passages(frame(spark, rows), hot_rows=hot, shard_words=shard)
    assert out.columns == ["doc_id", "text", "route", "W0_x", "n_words", "n_removed", "kept_text"]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert got == sorted(brute.kept_words(rows), key=str)


def test_passages_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "_CHUNK", 200)
    r = random.Random(5)
    texts = [b" ".join(b"v%d" % r.randint(0, 30) for _ in range(400)) for _ in range(3)]
    whole = [np.concatenate(x) for x in zip(*[s[1:] for s in substring._segment_rows(texts, 13)])]
    monkeypatch.setattr(substring, "_CHUNK", 1 << 19)
    again = [np.concatenate(x) for x in zip(*[s[1:] for s in substring._segment_rows(texts, 13)])]
    assert all((a == b).all() for a, b in zip(whole, again))
    assert whole[1].sum() == 3 * (400 - 12)


def test_wavelet_ranks():
    r = np.random.default_rng(0)
    s = r.integers(0, 37, 1000)
    w = WaveletMatrix(s, 37)
    sym, at = r.integers(0, 37, 500), r.integers(0, 1001, 500)
    assert (w.rank(sym, at) == [(s[:a] == c).sum() for c, a in zip(sym, at)]).all()


def test_index_reports_absent_windows():
    index = FmIndex([[1, 2, 3, 4], [2, 3, 4, 5]], np.array([7, 3]), 7, 3)
    found = index.least_ids([[1, 2, 3, 4, 5], [6, 2, 3], [4]])
    assert found[0].tolist() == [7, 3, 3]
    assert found[1].tolist() == [substring._NO_ID]
    assert found[2].tolist() == []


def test_simhash_groups_match_brute_force(spark):
    rows = corpus(4)
    r = random.Random(9)
    for _ in range(60):  # near copies: one word changed in a longer text
        words = max((t for _, t in r.sample(rows[:100], 5)), key=len).split()
        words[r.randrange(len(words))] = "changed"
        rows.append((1000 + len(rows), " ".join(words)))
    want = sorted(brute.simhash_groups(rows), key=str)
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some groups hold different texts
    out = near_duplicate_groups(frame(spark, rows))
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in out.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("parts,bucket_rows", [(3, 4096), (3, 5), (2, 4096), (4, 7)])
def test_links_find_all_components(spark, parts, bucket_rows):
    from sparkcover.llm.simhash import links

    r = random.Random(parts)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = set(base) | {0, 1, (1 << 64) - 1}
    for _ in range(250):
        x = r.choice(sorted(fps))
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and bin(signed[a] ^ signed[b]).count("1") <= 4:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    stars = {x.u: x.root for x in components(links(df, 4, parts=parts, bucket_rows=bucket_rows)).collect()}
    assert {x: stars.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_decontamination_matches_brute_force(spark):
    rows = corpus(6)
    r = random.Random(3)
    items = [(k, " ".join(r.choice(rows)[1].split()[:k]) if k % 3 else f"w{k} w{k + 1}") for k in range(1, 40)]
    items += [(100, None), (101, ""), (102, "!!"), (103, "the"), (4, "Über the"), (None, "naïve naïve")]
    rows = [(i, t) for i, t in rows]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.benchmark_hits(rows, [x for x in items if x[0] is not None]), key=str)
    items_null = [x for x in items if x[0] is None]
    assert items_null
    for block in (1 << 20, 300):
        out = mark_benchmark(frame(spark, rows), bench.where("item_id is not null"), block_bytes=block).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, x.item_ids) for x in out), key=str) == want
        assert all(x.contaminated == (x.n_hit > 0) for x in out)
    some = mark_benchmark(frame(spark, rows), bench.where("item_id is null")).where("contaminated").collect()
    assert all(x.item_ids == [] for x in some)


def test_empty_tables(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert remove_repeated_passages(none).count() == 0
    assert near_duplicate_groups(none).count() == 0
    assert mark_benchmark(none, bench).count() == 0
    some = mark_benchmark(frame(spark, [(1, "a b")]), bench).collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in some] == [(2, 0, False)]
