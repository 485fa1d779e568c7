"""The report's parts on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meridex.operators import report as R


def test_counts(spark):
    proposals = spark.createDataFrame([("applied", "propose_alias"), ("applied", None), (None, "propose_alias")], "status string, action_type string")
    assert sorted(map(tuple, R.proposal_counts(proposals).collect())) == [("action_type", "propose_alias", 2), ("action_type", "unknown", 1), ("status", "applied", 2), ("status", "unknown", 1)]
    queue = spark.createDataFrame([(None,), (0,), (3,), (4,)], "escalation int")
    assert sorted(map(tuple, R.queue_escalations(queue).collect())) == [(0, 2, 0), (3, 1, 1), (4, 1, 1)]


def test_reviews(spark):
    schema = "trigger string, actions array<string>"
    rows = spark.createDataFrame([("a", ["x", "y"]), ("a", []), (None, None)], schema)
    assert sorted(map(tuple, R.review_stats(rows).collect()), key=str) == [("a", 2, 1, 1.0, 0.5), ("unknown", 1, 0, 0.0, 1.0), (None, 3, 1, 0.67, pytest.approx(2 / 3))]
    assert [tuple(r) for r in R.review_stats(rows.limit(0)).collect()] == [(None, 0, 0, None, None)]


def test_calibration(spark):
    bands = lambda *rows: spark.createDataFrame(rows, "band int, decided long, accepted long")
    assert [tuple(r) for r in R.calibration(bands((0, 4, 1), (1, 2, 2), (3, 4, 3))).collect()] == [(0.25, 0.75, True)]
    assert [r.holds for r in R.calibration(bands((0, 4, 2), (3, 4, 2))).collect()] == [False]
    assert R.calibration(bands((0, 2, 0), (3, 4, 3))).count() == 0
    got = spark.createDataFrame([(6, 10, 1, 0.95, 0), (5, 10, 0, 0.9, 2), (0, 0, 0, None, 0)], "u int, d int, m int, r double, s int").select(R.findings(*(F.col(c) for c in "udmrs")).alias("f"), R.percent(F.col("r")).alias("p")).collect()
    assert [r.f for r in got] == [["mostly_undecided", "at_max_escalation", "reviews_without_action"], ["stale_entries"], []]
    assert got[0].p == "95%"


def test_definitions(spark):
    d = [("a  b", "1"), (" a b", "1"), ("A b", "1"), ("a b", None), ("a\nb", None), ("a b", ""), (" ", "1"), (None, "1"), ("", "1")]
    rows = spark.createDataFrame([("e", d), ("f", []), ("g", None)], "label string, definitions array<struct<text: string, context_id: string>>")
    got = {r.label: r for r in R.deduplicated(rows).collect()}
    assert [tuple(x) for x in got["e"].definitions] == [d[0], d[2], d[3], d[5], d[6], d[7], d[8]] and got["e"].removed == 2
    assert (got["f"].definitions, got["f"].removed, got["g"].definitions, got["g"].removed) == ([], 0, None, 0)
