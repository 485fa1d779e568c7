"""Replies on literal texts: whole, fenced, in prose, broken and empty."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridex.functions import replies as R


def read(spark, parse, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", parse(F.col("t")).alias("v")).orderBy("i").collect()]


def test_objects(spark):
    texts = ['{"b": 1, "a": {"y": 2, "x": 1}}', 'Here: {"a": "}{"} then {"b": 2}', '[{"a": 1}]', '{"a": 1', "none", "", None, '{"a": 1} {"b": 2}', '```json\n{"a": 1}\n```']
    as_text = lambda f: lambda c: F.to_json(f(c))
    assert read(spark, as_text(R.first_object), *texts) == ['{"a":{"x":1,"y":2},"b":1}', '{"a":"}{"}', '{"a":1}', None, None, None, None, '{"a":1}', '{"a":1}']
    # between the first and the last brace must lie one object; an array as a whole is none
    assert read(spark, as_text(R.whole_object), *texts) == ['{"a":{"x":1,"y":2},"b":1}', None, None, None, None, None, None, None, '{"a":1}']


def test_confidence(spark):
    number = lambda c: R.confidence(R.first_object(c))
    stated = ["8.5", '"8.5"', '" 7 "', "11", "-3", "NaN", "Infinity", "-Infinity", "null", "true", '"high"', "[1]", '"8/10"', "1e1", '"true"']
    want = [8.5, 8.5, 7.0, 10.0, 0.0, 0.0, 10.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 10.0, 0.0]
    assert read(spark, number, *('{"confidence": %s}' % s for s in stated), "{}", None) == [*want, 0.0, 0.0]


def test_opinions(spark):
    got = read(spark, R.opinion, '{"definition": " d ", "critique": "", "rationale": "r", "confidence": 9, "context_name": " \'Law\' "}', 'Sure. {"definition": 3, "context_name": "None"}', '{"context_name": 4}', "junk")
    assert [tuple(r) for r in got] == [("d", "r", 9.0, "Law", None), ("3", "", 0.0, None, None), ("", "", 0.0, None, None), (None, None, None, None, "no JSON object")]
    got = read(spark, R.grounding_opinion, '{"definition": "d", "relation": "Supports", "source_faithful": "YES", "confidence": "8"}', '{"relation": 3, "source_faithful": 1, "evidence_notes": " n "}', '{"relation": "un-related", "source_faithful": "maybe"}')
    assert [tuple(r)[:-1] for r in got] == [("d", "", 8.0, "corroborate", True, ""), ("", "", 0.0, "irrelevant", True, "n"), ("", "", 0.0, "irrelevant", False, "")]


def test_verdicts(spark):
    got = read(spark, R.audit_verdict, '```json\n{"decision": "Consistent", "confidence": 7}\n```', 'I say {"decision": "unclear", "reasoning": " x "} so', '{"decision": "accept"}', "", None)
    assert [tuple(r) for r in got] == [("consistent", 7.0, "(no reasoning provided)", None), ("unclear", 0.0, "x", None), (None, None, None, "invalid decision: accept"), *[(None, None, None, "no JSON object")] * 2]
    assert [r.decision for r in read(spark, R.review_verdict, '{"decision": "ESCALATE"}', '{"decision": "consistent"}')] == ["escalate", None]
    got = read(spark, R.redefine_verdict, '{"new_definition": "n", "confidence": 20, "context_name": "\\"F\\""}', '{"new_definition": " "}', '{"new_definition": null}')
    assert [tuple(r) for r in got] == [("n", 10.0, "(no rationale)", "F", None), *[(None, None, None, None, "no new_definition")] * 2]
    assert read(spark, R.backfill_verdict, '{"context_name": "a"}', '{"context_name": "null"}', "x") == ["a", None, None]
    got = read(spark, R.mapping_verdict, '{"relationship": "Same", "confidence": 0.85, "rationale": "r"}', '{"relationship": "none", "confidence": 1}', '{"confidence": 3}')
    assert [tuple(r) for r in got] == [("same", 8.5, "r", 0.85, None), ("none", 1.0, "", None, None), (None, None, None, None, "no relationship")]
    got = read(spark, R.intent_verdict, '{"intent_tags": [" a ", "", 3, null], "intentionality": "high", "confidence": 0.5}', '{"intent_tags": "a", "intentionality": "HIGH"}')
    assert [tuple(r) for r in got] == [(["a", "3"], "high", 0.5, None), ([], None, 0.0, None)]
    got = read(spark, R.relatedness_verdict, '{"related": true, "relation": "excerpt", "confidence": 9}', '{"related": false, "relation": "x"}', '{"related": true, "relation": "x"}', '{"related": 0, "confidence": 11}', '{"confidence": "much"}', '{"related": "no", "relation": "revision"}')
    assert [tuple(r) for r in got] == [(True, "excerpt", 9.0, "", None), (False, None, 0.0, "", None), (*[None] * 4, "unknown relation: x"), (*[None] * 4, "confidence outside 0 to 10"), (*[None] * 4, "confidence is no number"), (True, "revision", 0.0, "", None)]


def test_actions(spark):
    reply = '{"actions": [{"type": "propose_parent", "child_label": " c ", "parent_label": "p", "confidence": 9, "reason": "r"}, {"type": "propose_split", "label": "s", "into": ["x", "", " y"]}, {"type": "propose_split", "into": "x"}, {"type": "rename"}, 3]}'
    got = read(spark, lambda c: R.actions(R.first_object(c)), reply, '{"actions": {}}', "x")
    first, second = got[0]
    assert (first.action_type, first.child_label, first.parent_label, first.label, first.into, first.reason, first.confidence) == ("propose_parent", "c", "p", None, None, "r", 9.0)
    assert (second.action_type, second.label, second.into, second.alias, second.confidence) == ("propose_split", "s", ["x", "y"], None, 0.0)
    assert got[1:] == [[], []]


def test_envelopes(spark):
    good = '{"answer": " yes ", "suggested_actions": [{"type": "propose_alias", "label": "l", "alias": "a", "confidence": 12, "reasoning": "w"}, {"type": "propose_alias", "label": "l"}, {"type": "propose_merge", "keep_label": "k", "drop_label": "d"}]}'
    got = read(spark, R.chat_envelope, good, "just text", '{"answer": ""}', None)
    assert got[0].answer == "yes" and [(a.action_type, a.label, a.alias, a.reasoning, a.confidence) for a in got[0].suggested_actions] == [("propose_alias", "l", "a", "w", 10.0)]
    assert [(r.answer, r.suggested_actions) for r in got[1:]] == [("just text", []), ('{"answer": ""}', []), ("", [])]


def test_detailed(spark):
    body = "word " * 20
    got = read(spark, R.detailed_text, f"```\nDetailed description: {body}\n```", "short", "ab " * 2000, None)
    assert [tuple(r) for r in got] == [(body.strip(), None), (None, "too short: 5"), (("ab " * 1333)[:-1] + "…", None), (None, "too short: 0")]
