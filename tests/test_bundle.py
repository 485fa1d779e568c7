"""Bundles on a small lexicon: handles, frames, closure, rendering and the steps down to the budget."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meridex.operators import bundle as B

SCHEMA = """label string, canonical_term string, aliases array<string>, parent_label string, path array<string>, references_labels array<string>, language string, is_stale boolean,
    stale_reasons array<struct<change_type: string, note: string>>, definitions array<struct<text: string, context_id: string, model_used: string, detailed_text: string, intent_tags: array<string>, intentionality: string, grounding: string>>"""


def d(text, frame=None, model=None, detailed=None, tags=None, ordinal=None, grounding=None):
    return (text, frame, model, detailed, tags, ordinal, grounding)


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [
        ("MPL-001", "substrate", ["base"], None, None, ["MPL-002", "MPL-009"], "en", False, None, [d("first", "c1", "m1", " more\n\n words ", ["teach"], "high", "seen"), d("second", "c2"), d("third", "c1", "m2")]),
        ("MPL-002", "phase", None, "MPL-001", ["MPL-001"], ["MPL-003", "MPL-001"], "en", True, [("a", "1"), ("b", None), (None, "3")], [d("x" * 200)]),
        ("MPL-003", "coupling", [], None, [], None, "en", None, None, None),
        ("MPL-004", "substrate layer", None, None, None, None, "en", False, None, [d("a substrate", "gone", "m")]),
    ]
    contexts = [("c1", "structural", "S.", "frame"), ("c2", "theological", None, "frame"), ("c3", "teach", "T.", "intent")]
    return spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame(contexts, "context_id string, name string, description string, kind string")


def test_rendering(lexicon):
    entries, contexts = lexicon
    got = {r.label: r for r in B.rendered(entries.withColumn("key", F.col("label")), contexts).collect()}
    assert got["MPL-001"].full.split("\n") == [
        "--- MPL-001: substrate ---", "  Parent: (top-level)", B.MANY_FRAMES, "    Context [structural] — S.", "      [m1] first", "        more", "        words", "        (seen)",
        "        (deployed to: teach; intentionality: high)", "      [m2] third", "    Context [theological]", "      [?] second", "  References: MPL-002, MPL-009", "  Aliases: base",
    ]
    assert "      first" in got["MPL-001"].plain.split("\n") and "m1" not in got["MPL-001"].plain
    assert got["MPL-002"].full.split("\n")[1:6] == ["  Parent: MPL-001", "  Path: MPL-001", "  STALE (reasons: 3)", "    - b: ", "    - ?: 3"]
    assert got["MPL-002"].line.split("\n") == ["--- MPL-002: phase ---", "  [unspecified] " + "x" * 159 + "…", "  (STALE)"]
    assert got["MPL-003"].full.split("\n") == ["--- MPL-003: coupling ---", "  Parent: (top-level)"] and got["MPL-003"].short_line == "--- MPL-003: coupling ---"
    assert got["MPL-004"].full.split("\n")[2:4] == [B.ONE_FRAME, "    Context [unspecified]"]


def test_handles_and_closure(lexicon):
    got = B.build_bundle(*lexicon, ["MPL-001#theological", "MPL-077", "MPL-001#nothing", "zzzz", " "])
    assert (got.entries, got.closure, got.unresolved, got.degradations) == (["MPL-001#theological"], ["MPL-002", "MPL-003"], ["MPL-077", "MPL-001#nothing", "zzzz"], [])
    assert "second" in got.as_text and "first" not in got.as_text and got.as_text.startswith("CODIFIED MEANINGS\n\nFrames")
    assert got.token_estimate == -(-len(got.as_text) // 4) and "(closure — cited by the entries above)\n\n--- MPL-002" in got.as_text


def test_budget(lexicon):
    roomy = B.build_bundle(*lexicon, ["substrate", "coupling"])
    assert roomy.entries == ["MPL-001", "MPL-003"] and [a[0] for a in roomy.alternatives] == ["MPL-004"] and roomy.degradations == []
    assert roomy.as_text.endswith("OTHER CANDIDATE MATCHES: MPL-004 (substrate layer)\n")
    tight = B.build_bundle(*lexicon, ["substrate", "coupling"], budget=1)
    assert tight.degradations == ["provenance_dropped", "breadth_trimmed", "closure_hardened"] and len(tight.entries) == 1
    assert tight.alternatives[0][2] == 0 and tight.token_estimate > 1
    kept = B.build_bundle(*lexicon, ["MPL-001", "MPL-003"], budget=1)
    assert kept.entries == ["MPL-001", "MPL-003"] and kept.degradations == ["provenance_dropped", "closure_hardened"] and kept.closure == ["MPL-002"]


def test_grounding_line(spark):
    rows = spark.createDataFrame([(True, None, None, 1), (True, "enrich", 7.25, 2), (False, "x", 1.0, 1)], "i boolean, r string, c double, n int")
    got = [r.l for r in rows.select(B.grounding_line(*(F.col(c) for c in "ircn")).alias("l")).collect()]
    assert got[0] == "external grounding: unclassified; corpus confidence unscored; 1 source" and got[1].startswith("external grounding: enrich; corpus confidence 7.") and got[2] is None
