"""Grounding decisions rule by rule, and what a backfill sends to its backend."""

from __future__ import annotations

from meridex.operators import backfill, grounding


def test_first_rule_decides(spark):
    cases = [  # critic, explorer: relation, confidence, faithful, definition; corpus text and confidence, copied; what comes out
        (("enrich", 9.0, True, "a  B"), ("clarify", 8.5, True, "A b"), "old", 8.0, False, ("clarify", "adopted", 8.5)),
        (("challenge", 9.0, True, "a"), ("enrich", 3.0, True, "a"), "old", 8.0, False, ("challenge", "challenged", 3.0)),
        (("enrich", 9.0, True, "a"), ("enrich", 9.0, True, "a"), " ", None, False, ("enrich", "no_corpus_definition", None)),
        (("enrich", 9.0, None, "a"), ("enrich", 9.0, True, "a"), "old", 8.0, False, ("enrich", "unchanged", 8.0)),
        (("whatever", 9.0, True, "a"), ("enrich", 9.0, True, "a"), "old", 8.0, False, ("irrelevant", "unchanged", 8.0)),
        (("enrich", 9.0, True, "a"), ("enrich", 9.0, True, None), "old", 8.0, False, ("enrich", "unchanged", 8.0)),
        (("enrich", 9.0, True, "b"), ("enrich", 9.0, True, "a"), "old", 8.0, True, ("enrich", "not_ratified", 8.0)),
        (("enrich", 9.0, True, "a"), ("enrich", 9.0, True, "a"), "old", 8.0, True, ("enrich", "copied", 8.0)),
        (("enrich", None, True, "a"), ("enrich", 9.0, True, "a"), "old", 8.0, None, ("enrich", "below_corpus", 8.0)),
        (("enrich", None, True, "a"), ("enrich", 9.0, True, "a"), "old", None, None, ("enrich", "adopted", 0.0)),
    ]
    said = [(i, agent, *c[k]) for i, c in enumerate(cases) for k, agent in enumerate(("critic", "explorer"))]
    opinions = spark.createDataFrame(said, "id long, agent string, relation string, confidence double, faithful boolean, definition string")
    terms = spark.createDataFrame([(i, *c[2:5]) for i, c in enumerate(cases)], "id long, corpus_definition string, corpus_confidence double, copied boolean")
    got = {r["id"]: (r["relation"], r["outcome"], r["confidence"]) for r in grounding.decide_grounding(opinions, terms).collect()}
    assert got == {i: c[5] for i, c in enumerate(cases)}
    assert grounding.decide_grounding(opinions.limit(0), terms).count() == 0


def backend(texts):
    if "bad" in texts:
        raise ValueError("bad")
    return [[float("nan")] if x.startswith("nan") else [float(len(x))] for x in texts]


def test_backfill(spark):
    entries = spark.createDataFrame([("a", "one", "o"), ("b", "nan: b", "bb"), ("c", "nan", None), ("d", "bad", "d"), ("e", "four", "f"), ("f", None, "g")], "label string, text string, fallback string").coalesce(1)
    stored = entries.where("label in ('a', 'e')").selectExpr("label", "if(label = 'a', 'm', 'other') AS model", "sha2(text, 256) AS source_hash")
    rows = backfill.backfill(entries, stored, "m", backend).collect()
    assert {r["label"]: (r["state"], r["vector"]) for r in rows} == {"b": ("fallback", [2.0]), "c": ("skipped_nan", None), "d": ("errored", None), "e": ("embedded", [4.0])}
    assert {r["label"] for r in backfill.backfill(entries, stored, "m", backend, everything=True).collect()} == set("abcde")
