"""A benchmark of many blocks: the same marks, one block's matchers in a stage."""

import os

from sparkcover.llm.decontaminate import mark_benchmark

DOC = "doc_id bigint, text string"
ITEM = "item_id string, text string"


def passes(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {d for d in os.listdir(top) if d.startswith("op7-pass")}


def test_blocks_mark_alike(spark):
    words = [f"w{k}" for k in range(400)]
    items = [(f"i{k:02d}", " ".join(words[k * 9 : k * 9 + 12])) for k in range(40)]
    items += [("short", "lone word"), (None, " ".join(words[380:395])), ("empty", ""), ("null", None), ("i03", items[3][1])]
    docs = [(k, " ".join(words[k * 5 : k * 5 + 30 + k])) for k in range(60)]
    docs += [(100, "a LONE Word here"), (101, None), (102, ""), (103, " ".join(words) * 3), (4, docs[4][1])]
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    one = mark_benchmark(d, b, window=10)
    before = passes(spark)
    many = mark_benchmark(d, b, window=10, block_bytes=300)
    assert len(passes(spark) - before) == 1  # the table the last pass reads; those before are deleted
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert any(r.contaminated and r.item_ids == ["short"] for r in many.collect())
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan
