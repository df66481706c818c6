"""Queries over the pool of the search: no question and no term of one comes to the driver."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["two_voter_order", "abstention_confusion", "context_budget", "statute_slots", "evidence_gate", "gate_calibration", "stage_trace", "keyword_filtered_quota", "rrf_pinned", "summary_grouping_sets", "context_order", "expected_sources", "recall_mrr", "rrf_fusion", "verification_sheet"])
def test_questions_stay_in_the_tasks(spark, monkeypatch, name):
    kind = type(spark.range(1))
    collect, seen = kind.collect, []
    monkeypatch.setattr(kind, "collect", lambda d: seen.append(d.columns) or collect(d))
    entry.queries()[name](spark, SF)
    assert seen and not any("query_id" in x or "term" in x for x in seen)
