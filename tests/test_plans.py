"""Plan-shape checks: pruning and pushdown reach the scan; no Python in the hot path."""

import os

import pytest

from sparkcover import catalog as C
from sparkcover.operators import neighbors as nb

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


def plan_of(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_graph_scan_prunes_and_pushes(spark, capsys):
    plan = plan_of(C.part_supplier(spark, SF), capsys)
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(l_partkey), IsNotNull(l_suppkey)]" in plan


def test_text_scan_prunes(spark, capsys):
    plan = plan_of(C.q_popular_char_count(spark, SF), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan or "ReadSchema: struct<text:string>" in plan
    assert "partial_count" in plan


def test_message_step_is_jvm_only(spark, capsys):
    es, spans = C._spans(C.order_part(spark, SF))
    plan = plan_of(nb.onehop_argmax(es, spans), capsys)
    for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "SortAggregate"):
        assert marker not in plan
    assert "BroadcastHashJoin" in plan and "HashAggregate" in plan
    assert "Scan parquet" not in plan  # the input was read once, for the edge set
    spans.unpersist()
    es.release()
