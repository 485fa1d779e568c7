"""Labels, references, search, copies and tables on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meridex.functions import labels as L
from meridex.operators import copies, graph, references, search, vectors
from meridex.operators import labels as next_labels
from meridex.sources.tables import DuplicateKey, Table, children, contexts, labels_under, pending

ENTRIES = "label string, canonical_term string, aliases array<string>, texts array<string>, references_labels array<string>, language string"


def frame(spark, values, name="label"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_label_parts(spark):
    c = F.col("label")
    rows = frame(spark, ["MPL-001", "MPL-001.002b", "MPL-001.002.003", "MPL-1", None, "MPL-" + ".".join(["001"] * 7), "mpl-001"]).select("label", L.is_valid(c), L.depth(c), L.parent(c), L.suffix(c), L.segments(c)).collect()
    assert [tuple(r)[1:] for r in rows] == [
        (True, 1, None, None, [1]),
        (True, 2, "MPL-001.002", "b", [1, 2]),
        (True, 3, "MPL-001.002", None, [1, 2, 3]),
        *[(False, None, None, None, None)] * 4,
    ]
    got = frame(spark, ["see MPL-002.001, MPL-001 and MPL-002.001; xMPL-003", None, ""], "t").select(L.mentions(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [["MPL-002.001", "MPL-001"], [], []]


def test_next_labels(spark):
    have = frame(spark, ["MPL-001", "MPL-002", "MPL-004", "MPL-003a", "MPL-001.001", "MPL-001.003", "junk", None, "MPL-002a", "MPL-002b"])
    assert next_labels.next_top_level(have).collect() == [("MPL-003",)]
    assert next_labels.next_top_level(frame(spark, [])).collect() == [("MPL-001",)]
    got = next_labels.next_child(frame(spark, ["MPL-001", "MPL-002"], "parent"), have).collect()
    assert sorted(map(tuple, got)) == [("MPL-001", "MPL-001.002"), ("MPL-002", "MPL-002.001")]
    assert sorted(map(tuple, next_labels.next_variant(frame(spark, ["MPL-002", "MPL-004"], "base"), have).collect())) == [("MPL-002", "MPL-002c"), ("MPL-004", "MPL-004a")]
    full = spark.range(1, 1000).select(F.format_string("MPL-%03d", "id").alias("label"))
    for bad in (lambda: next_labels.next_top_level(full), lambda: next_labels.next_child(frame(spark, ["MPL-001a"], "parent"), have), lambda: next_labels.next_variant(frame(spark, ["junk"], "base"), have)):
        with pytest.raises(Exception, match="free|under|variant"):
            bad().collect()


def entries(spark):
    rows = [
        ("MPL-001", "Alpha", None, ["first thing"], [], "en"),
        ("MPL-002", "Beta Form", ["betaform"], ["uses alpha, and MPL-003 then MPL-001"], ["MPL-001"], "en"),
        ("MPL-003", "Gamma", ["gam"], ["alphabet of the beta form", "MPL-003 itself, gammas", None], None, "en"),
        ("MPL-004", "abc", None, None, [], "en"),
        ("MPL-005", "Alpha", None, ["abc"], [], "de"),
        ("MPL-006", None, None, ["C++ and (beta form)"], [], "en"),
    ]
    return spark.createDataFrame(rows, ENTRIES)


def test_references(spark):
    df = entries(spark)
    got = {r.label: r.refs for r in references.computed(df).collect()}
    assert got == {"MPL-001": [], "MPL-002": ["MPL-003", "MPL-001"], "MPL-003": ["MPL-002"], "MPL-004": [], "MPL-005": [], "MPL-006": ["MPL-002"]}
    assert references.backfill_counts(df).collect() == [(6, 3, 4)]
    assert [r.label for r in references.retro_linked(df, "MPL-002").orderBy("label").collect()] == ["MPL-003", "MPL-006"]
    assert references.retro_linked(df, "MPL-004").count() == 0
    assert [r.label for r in references.entries_referencing(df, "MPL-001").collect()] == ["MPL-002"]
    assert references.computed(df.limit(0)).count() == 0


def test_search(spark):
    df = entries(spark)
    got = [tuple(r) for r in search.search_terms(df, ["MPL-002.001", "alpha"]).collect()]
    assert got[0][0] == "MPL-001" and got[0][3] == "exact" and all(r[0] != "MPL-005" for r in got)
    q = F.lit("mpl-001 and betaform beta form")
    assert {r.label: r.s for r in df.select("label", search.score(q).alias("s")).collect()} == {"MPL-001": 30, "MPL-002": 35, "MPL-003": 0, "MPL-004": 0, "MPL-005": 0, "MPL-006": 0}
    assert [r.m for r in spark.createDataFrame([("mpl-001.001",), ("mpl-001a",), ("mpl-001. x",), ("(mpl-001)",)], "q string").select(search.label_mentioned(F.lit("MPL-001"), F.col("q")).alias("m")).collect()] == [False, False, True, True]
    kinds = {r.label: r.kind for r in search.search_terms(df, ["mpl-003", "betaform", "thing"]).collect()}
    assert kinds == {"MPL-003": "label", "MPL-002": "alias", "MPL-001": "text"}
    assert search.search_terms(df, ["nothing here"]).count() == 0
    assert [r.label for r in search.search_terms(df, ["alpha", "gamma"], passes=F.col("label") != "MPL-001", limit=1).collect()] == ["MPL-003"]


def test_copied(spark):
    long = "one two three four five six seven eight nine"
    rows = [
        ("Same  TEXT", "same text"),
        ("same, text!", "same text"),
        (f"before {long} after", f"x {long.upper()}"),
        ("a phrase of more than forty characters in all", "so: a phrase of more than forty characters in all, it is"),
        ("short phrase", "a short phrase within"),
        ("one two three four five six seven x eight", long),
        ("", ""),
        (None, "x"),
    ]
    got = copies.copied(spark.createDataFrame(rows, "definition string, passage string")).collect()
    assert [r.copied for r in got] == [True, True, True, True, False, False, False, False]


def test_shortlist(spark):
    rows = [(1, "de", "m", [1.0, 0.0]), (2, "en", "m", [1.0, 0.1]), (3, "en", "m", [0.0, 0.0]), (4, "en", "other", [1.0, 0.0]), (5, "en", "m", [1.0]), (6, "en", "m", None), (7, "de", "m", [1.0, 0.0]), (8, "en", "m", [1.0, 0.1])]
    stored = spark.createDataFrame(rows, "id long, language string, model string, embedding array<double>")
    got = vectors.shortlist(stored.where("id = 1"), stored, 3)
    assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(2, 1), (8, 2), (3, 3)]


def test_graphs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    assert graph.closure(chain.where("src >= 0"), spark.createDataFrame([(0,)], "node long")).agg(F.max("distance"), F.count("*")).first() == (70, 70)
    with pytest.raises(RuntimeError):
        graph.closure(chain, spark.createDataFrame([(0,)], "node long"), max_depth=20)
    loops = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7), (0, 1)], "src long, dst long")
    assert sorted(r.node for r in graph.on_cycle(loops).collect()) == [1, 2, 3, 5, 6, 7]
    assert graph.on_cycle(loops.limit(0)).count() == 0


def test_tables(spark, tmp_path):
    entries_table = Table(spark, f"file://{tmp_path}", "entries", "label string, parent_label string, status string")
    assert entries_table.count() == 0 and entries_table.get("MPL-001").count() == 0
    entries_table.insert(spark.createDataFrame([("MPL-002", None, "draft"), ("MPL-001", None, "active"), ("MPL-003", "MPL-001", "draft")], entries_table.schema))
    with pytest.raises(DuplicateKey):
        entries_table.insert(spark.createDataFrame([("MPL-001",)], "label string"))
    assert entries_table.count() == 3 and [r.label for r in labels_under(entries_table, None).collect()] == ["MPL-001", "MPL-002"]
    assert entries_table.update(F.col("status") == "draft", status=F.lit("active")) == 2 and entries_table.update(F.col("status") == "draft", status=F.lit("x")) == 0
    entries_table.upsert(spark.createDataFrame([("MPL-001", None, "old"), ("MPL-004", "MPL-001", None)], entries_table.schema))
    assert [(r.label, r.status) for r in entries_table.find().collect()] == [("MPL-001", "old"), ("MPL-002", "active"), ("MPL-003", "active"), ("MPL-004", None)]
    assert entries_table.delete(F.col("status").isNull() | (F.col("status") == "old")) == 2 and entries_table.count() == 2
    queue = Table(spark, f"file://{tmp_path}", "undecided", "decision_log_id string, escalation_level int, created_at timestamp")
    queue.insert(spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2026-01-01'), ('b', 0, timestamp'2026-01-03'), ('c', 0, timestamp'2026-01-02') v(decision_log_id, escalation_level, created_at)"))
    assert [r.decision_log_id for r in pending(queue, 2).collect()] == ["c", "b"]
    edges = Table(spark, f"file://{tmp_path}", "edges", "parent_label string, child_label string")
    edges.insert(spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "c")], edges.schema))
    assert [r.child_label for r in children(edges, "p").collect()] == ["a", "b"] and edges.find_either(("parent_label", "child_label"), "c").count() == 1
    ctx = Table(spark, f"file://{tmp_path}", "contexts", "context_id string, name string, kind string, created_at timestamp")
    ctx.insert(spark.sql("SELECT '1' context_id, 'x' name, 'frame' kind, timestamp'2026-01-01' created_at"))
    assert contexts(ctx, kind="frame", name="x").count() == 1 and contexts(ctx, kind="intent").count() == 0
