"""Actions on a small lexicon: every rule, routing, waves, cycles, decisions and rollback."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meridex.operators import actions as A

MEMBERS = "seq long, action_type string, child_label string, parent_label string, label string, alias string, keep_label string, drop_label string, into array<string>, confidence double"


def entries(spark):
    rows = [("MPL-001", "alpha", ["first"], None, "en"), ("MPL-002", "beta", None, "MPL-001", "en"), ("MPL-003", "gamma", [], "MPL-002", "en"), ("MPL-004", "delta", None, None, "de"), ("MPL-005", "eps", None, None, "en"), ("MPL-001a", "var", None, None, "en"), ("X", "odd", None, None, "en")]
    return spark.createDataFrame(rows, "label string, canonical_term string, aliases array<string>, parent_label string, language string")


def parent(seq, child, to, c=9.0):
    return (seq, "propose_parent", child, to, None, None, None, None, None, c)


def alias(seq, label, name, c=9.0):
    return (seq, "propose_alias", None, None, label, name, None, None, None, c)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), MEMBERS)


def said(df):
    return [(r.status, r.detail) for r in df.orderBy("seq").collect()]


def parents(df):
    return {r.label: r.parent_label for r in df.collect() if r.parent_label}


def test_rules(spark):
    rows = [
        parent(1, "", "MPL-001"), parent(2, "MPL-001", "MPL-001"), parent(3, "MPL-009", "MPL-001"), parent(4, "MPL-001", "MPL-009"), parent(5, "MPL-004", "MPL-001"),
        parent(6, "MPL-002", "MPL-001"), parent(7, "MPL-002", "X"), parent(8, "MPL-002", "MPL-001a"), parent(9, "MPL-001", "MPL-003"), parent(10, "MPL-005", "MPL-001"),
        alias(11, "MPL-001", "  "), alias(12, "", "a"), alias(13, "MPL-009", "a"), alias(14, "MPL-001", "ALPHA"), alias(15, "MPL-001", "First"), alias(16, "MPL-001", "beta"), alias(17, "MPL-002", "a"),
        (18, "propose_merge", None, None, None, None, "MPL-001", "MPL-004", None, 9.0), (19, "propose_merge", None, None, None, None, "MPL-001", "MPL-002", None, None),
        (20, "propose_split", None, None, "MPL-001", None, None, None, ["x"], 9.0), (21, "propose_split", None, None, "MPL-001", None, None, None, ["x", "y"], 9.0), (22, None, None, None, None, None, None, None, None, None),
    ]
    got = [r.reason for r in A.validated(batch(spark, *rows), entries(spark)).orderBy("seq").collect()]
    assert got == [
        "child or parent label is empty", "child and parent are the same label", "child label MPL-009 does not exist", "parent label MPL-009 does not exist", "cross-language parent",
        "child already has this parent", "invalid parent label format", "a variant label can't be a parent", "edge would introduce a cycle", None,
        "alias is empty", "label is empty", "the label MPL-009 does not exist", "alias equals canonical term", "alias already present on this entry", "alias is already the canonical term of MPL-002", None,
        "cross-language merge", None, "split must produce at least 2 variants", None, "unknown action type",
    ]


def test_dispatch(spark):
    rows = [parent(1, "MPL-005", "MPL-001", 8.0), parent(2, "MPL-005", "MPL-002", 8.4), parent(3, "MPL-005", "MPL-003", 8.5), parent(4, "MPL-005", "MPL-003", 10.0), alias(5, "MPL-001", "New", 7.0), alias(6, "MPL-001", " New ", 8.0), alias(7, "MPL-001", "new"), (8, "propose_merge", None, None, None, None, "MPL-001", "MPL-002", None, 10.0)]
    out = A.dispatch(batch(spark, *rows), entries(spark))
    assert said(out.actions) == [
        ("applied", "auto-applied"), ("pending_review", "confidence below re-parenting threshold 8.5"), ("applied", "auto-applied"), ("invalid", "child already has this parent"),
        ("pending_review", "confidence below auto-apply threshold 8.0"), ("applied", "auto-applied"), ("invalid", "alias already present on this entry"), ("pending_review", "destructive actions require operator review"),
    ]
    assert parents(out.entries) == {"MPL-002": "MPL-001", "MPL-003": "MPL-002", "MPL-005": "MPL-003"}
    assert {r.label: r.aliases for r in out.entries.collect()}["MPL-001"] == ["first", "New"]
    assert [r.node for r in out.moved.collect()] == ["MPL-005"]
    empty = A.dispatch(batch(spark), entries(spark))
    assert empty.actions.count() == 0 and sorted(map(str, empty.entries.collect())) == sorted(map(str, entries(spark).collect()))


def test_cycles_of_a_batch(spark):
    out = A.dispatch(batch(spark, parent(1, "MPL-005", "MPL-003"), parent(2, "MPL-001", "MPL-005")), entries(spark))
    assert said(out.actions) == [("applied", "auto-applied"), ("invalid", "edge would introduce a cycle")]


def test_decisions(spark):
    first = A.dispatch(batch(spark, parent(1, "MPL-005", "MPL-001", 3.0), alias(2, "MPL-002", "b2", 1.0), parent(3, "MPL-003", "MPL-001", 9.0), (4, "propose_split", None, None, "MPL-001", None, None, None, ["x", "y"], 9.0)), entries(spark))
    taken = A.accept(first.actions, first.entries)
    assert said(taken.actions) == [("applied", "accepted"), ("applied", "accepted"), ("applied", "can't accept in status applied"), ("pending_review", "no way to apply this type")]
    assert parents(taken.entries) == {"MPL-002": "MPL-001", "MPL-003": "MPL-001", "MPL-005": "MPL-001"}
    again = A.accept(first.actions.where("seq = 1"), taken.entries)
    assert said(again.actions) == [("pending_review", "can no longer be applied: child already has this parent")]
    assert [s for s, _ in said(A.reject(first.actions))] == ["rejected", "rejected", "applied", "rejected"]
    back = A.roll_back(first.actions.where("seq = 3").unionByName(taken.actions.where("seq IN (1, 2, 4)")), taken.entries)
    assert [s for s, _ in said(back.actions)] == ["rolled_back", "rolled_back", "rolled_back", "pending_review"]
    assert parents(back.entries) == {"MPL-002": "MPL-001", "MPL-003": "MPL-002"}
    assert {r.label: r.aliases for r in back.entries.collect()}["MPL-002"] == []
    assert sorted(r.node for r in back.moved.collect()) == ["MPL-002", "MPL-003", "MPL-005"]


def test_lost_claims(spark):
    t = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("applying", t), ("applying", t + dt.timedelta(seconds=200)), ("applied", t)], "status string, applying_at timestamp")
    got = A.recovered(rows, F.lit(t + dt.timedelta(seconds=301))).collect()
    assert [(r.status, r.applying_at is None) for r in got] == [("pending_review", True), ("applying", False), ("applied", False)]
