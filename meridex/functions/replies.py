"""Model replies read as columns: the JSON object in a reply, and the typed verdicts in it.

A reply is parsed once into a variant; a verdict is a struct whose field `error` says why a reply is unusable and is null
otherwise, so that refused replies can be told apart and kept. A JSON null counts as missing. Two members of one name make
an object unusable. NaN and infinities are taken as numbers: NaN as no confidence, infinities as the nearer limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: confidences lie between 0 and this.
SCALE = 10.0
#: Names that stand for no frame.
NO_FRAME = ("null", "none", "unspecified", "")
#: Decisions of an audit and of a review, kinds of relatedness, ordinals of intent.
AUDIT_DECISIONS = ("consistent", "inconsistent", "unclear")
REVIEW_DECISIONS = ("accept", "reject", "escalate")
RELATION_KINDS = ("same_work", "revision", "translation", "excerpt", "shares_material")
ORDINALS = ("low", "medium", "high")
#: Relations of evidence, and other words for them.
GROUNDING_RELATIONS = ("challenge", "irrelevant", "discriminate", "clarify", "enrich", "corroborate")
GROUNDING_ALIASES = {
    "clarifies": "clarify",
    "clarification": "clarify",
    "discriminates": "discriminate",
    "discrimination": "discriminate",
    "corroborates": "corroborate",
    "corroboration": "corroborate",
    "supports": "corroborate",
    "support": "corroborate",
    "challenges": "challenge",
    "contradict": "challenge",
    "contradicts": "challenge",
    "contradiction": "challenge",
    "enriches": "enrich",
    "enrichment": "enrich",
    "none": "irrelevant",
    "unrelated": "irrelevant",
}
#: Characters of a detailed description, at least and at most.
DETAILED_MIN, DETAILED_MAX = 80, 4000
#: The members of each type of action.
ACTION_MEMBERS = {
    "propose_parent": ("child_label", "parent_label"),
    "propose_alias": ("label", "alias"),
    "propose_merge": ("keep_label", "drop_label"),
    "propose_split": ("label",),
}
SUGGESTED = ("propose_parent", "propose_alias")

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_BARE = r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,}\]])"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _parsed(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, _BARE, '$1"$2"')))


def kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (a JSON null), OBJECT or ARRAY; null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _object(value: Column) -> Column:
    return _bound(value, lambda v: F.when(kind(v) == "OBJECT", v))


def first_object(reply: Column) -> Column:
    """The reply's first JSON object, whatever stands around it, as a variant; null if it isn't one or isn't closed."""
    at = F.instr(reply, "{")
    return F.when(at > 0, _object(_parsed(F.substr(reply, at))))


def unfenced(reply: Column) -> Column:
    """What stands in the code fence that a reply begins with, without the word json; else the reply, both stripped."""
    inner = lambda text: stripped(F.regexp_replace(F.split_part(text, F.lit("```"), F.lit(2)), r"^\s*json", ""))
    return _bound(stripped(F.coalesce(reply, F.lit(""))), lambda text: F.when(text.startswith("```"), inner(text)).otherwise(text))


def _only(text: Column) -> Column:
    """Text that is one JSON value; parsed within an array, so that what follows a value isn't passed over."""
    return _bound(_parsed(F.concat(F.lit("["), text, F.lit("]"))), lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def whole_object(reply: Column) -> Column:
    """The object that a reply is once fences are off, or that lies between its first and last brace; else null."""
    return _bound(unfenced(reply), lambda text: _object(F.coalesce(_only(text), _only(F.regexp_extract(text, r"(?s)\{.*\}", 0)))))


def member(value: Column, name: str) -> Column:
    """A member as stripped text; empty if it is missing or null."""
    return stripped(F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit("")))


def _first_filled(value: Column, *names: str) -> Column:
    return F.coalesce(*(F.when(member(value, n) != "", member(value, n)) for n in names), F.lit(""))


def _number(value: Column, name: str) -> Column:
    """A member as a double: numbers, booleans, and text that is a number; else null."""
    own = F.try_variant_get(value, f"$.{name}", "variant")
    text = F.lower(member(value, name))
    odd = F.when(text == "nan", float("nan")).when(text.isin("infinity", "inf", "+inf", "+infinity"), float("inf")).when(text.isin("-infinity", "-inf"), float("-inf"))
    return F.when(kind(own) == "BOOLEAN", (text == "true").cast("double")).when(F.regexp_like(text, F.lit(_NUMBER)), text.try_cast("double")).otherwise(odd)


def confidence(value: Column, name: str = "confidence") -> Column:
    """A confidence, kept between 0 and 10; 0 if it is missing, NaN or no number."""
    return _bound(_number(value, name), lambda n: F.greatest(F.lit(0.0), F.least(F.lit(SCALE), F.coalesce(F.nanvl(n, F.lit(0.0)), F.lit(0.0)))))


def rescaled(value: Column) -> Column:
    """A confidence strictly between 0 and 1 is taken as one on a scale of 1, and becomes one of 10."""
    return F.when((value > 0) & (value < 1), F.round(value * 10, 4)).otherwise(value)


def frame_name(value: Column, name: str = "context_name") -> Column:
    """A frame's name without quotes; null for none, for names that stand for none and for what isn't text."""
    own = F.try_variant_get(value, f"$.{name}", "variant")
    clean = F.btrim(member(value, name), F.lit("'\""))
    return F.when((kind(own) == "STRING") & ~F.lower(clean).isin(*NO_FRAME), clean)


def is_true(value: Column, name: str) -> Column:
    """true, 1, and the words true, yes and 1 in any case."""
    own, text = F.try_variant_get(value, f"$.{name}", "variant"), F.lower(member(value, name))
    return F.when(kind(own) == "STRING", text.isin("true", "yes", "1")).when(kind(own) == "BOOLEAN", text == "true").otherwise(F.coalesce(_number(value, name) == 1, F.lit(False)))


def _truthy(value: Column, name: str) -> Column:
    """Anything but a missing or empty member, false and 0."""
    own, text = F.try_variant_get(value, f"$.{name}", "variant"), F.try_variant_get(value, f"$.{name}", "string")
    empty = F.when(kind(own) == "BOOLEAN", text == "false").when(kind(own).isin("STRING", "VOID"), F.coalesce(text, F.lit("")) == "").when(kind(own).isin("OBJECT", "ARRAY"), text.isin("{}", "[]"))
    return F.coalesce(~F.coalesce(empty, _number(value, name) == 0), F.lit(False))


def _verdict(error: Column, **fields: Column) -> Column:
    """The fields where nothing is wrong, and else nulls and the error."""
    return _bound(error, lambda e: F.struct(*(F.when(e.isNull(), c).alias(n) for n, c in fields.items()), e.alias("error")))


def _unusable(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("no JSON object"))


def opinion(reply: Column) -> Column:
    """definition, explanation (critique, else rationale), confidence, context_name, error."""

    def read(value: Column) -> Column:
        return _verdict(_unusable(value), definition=member(value, "definition"), explanation=_first_filled(value, "critique", "rationale"), confidence=confidence(value), context_name=frame_name(value))

    return _bound(first_object(reply), read)


def grounding_relation(text: Column) -> Column:
    """A relation by its name or another word for it, in any case, with blanks or hyphens; all else is irrelevant."""
    clean = F.regexp_replace(F.lower(stripped(text)), "[- ]", "_")
    known = F.create_map(*(F.lit(x) for pair in GROUNDING_ALIASES.items() for x in pair))
    name = F.coalesce(F.try_element_at(known, clean), clean)
    return F.when(name.isin(*GROUNDING_RELATIONS), name).otherwise("irrelevant")


def grounding_opinion(reply: Column) -> Column:
    """definition, explanation, confidence, relation, source_faithful, evidence_notes, error."""

    def read(value: Column) -> Column:
        text = F.when(kind(F.try_variant_get(value, "$.relation", "variant")) == "STRING", member(value, "relation"))
        return _verdict(
            _unusable(value),
            definition=member(value, "definition"),
            explanation=_first_filled(value, "explanation", "critique", "rationale"),
            confidence=confidence(value),
            relation=grounding_relation(text),
            source_faithful=is_true(value, "source_faithful"),
            evidence_notes=member(value, "evidence_notes"),
        )

    return _bound(first_object(reply), read)


def _decision(reply: Column, allowed: tuple[str, ...]) -> Column:

    def read(value: Column) -> Column:
        name = F.lower(member(value, "decision"))
        error = _unusable(value)
        error = F.coalesce(error, F.when(~name.isin(*allowed), F.concat(F.lit("invalid decision: "), name)))
        reasoning = member(value, "reasoning")
        return _verdict(error, decision=name, confidence=confidence(value), reasoning=F.when(reasoning != "", reasoning).otherwise("(no reasoning provided)"))

    return _bound(whole_object(reply), read)


def audit_verdict(reply: Column) -> Column:
    """decision (consistent, inconsistent or unclear), confidence, reasoning, error."""
    return _decision(reply, AUDIT_DECISIONS)


def review_verdict(reply: Column) -> Column:
    """decision (accept, reject or escalate), confidence, reasoning, error."""
    return _decision(reply, REVIEW_DECISIONS)


def redefine_verdict(reply: Column) -> Column:
    """new_definition, confidence, rationale, context_name, error."""

    def read(value: Column) -> Column:
        text, why = member(value, "new_definition"), member(value, "rationale")
        error = F.coalesce(_unusable(value), F.when(text == "", F.lit("no new_definition")))
        return _verdict(error, new_definition=text, confidence=confidence(value), rationale=F.when(why != "", why).otherwise("(no rationale)"), context_name=frame_name(value))

    return _bound(whole_object(reply), read)


def backfill_verdict(reply: Column) -> Column:
    """The name of the frame in a reply, or null."""
    return _bound(whole_object(reply), lambda value: frame_name(value))


def mapping_verdict(reply: Column) -> Column:
    """relationship, confidence, rationale, confidence_rescaled_from (null if it wasn't), error."""

    def read(value: Column) -> Column:
        name, stated = F.lower(member(value, "relationship")), confidence(value)
        error = F.coalesce(_unusable(value), F.when(name == "", F.lit("no relationship")))
        return _verdict(error, relationship=name, confidence=rescaled(stated), rationale=member(value, "rationale"), confidence_rescaled_from=F.when((stated > 0) & (stated < 1), stated))

    return _bound(whole_object(reply), read)


def intent_verdict(reply: Column) -> Column:
    """intent_tags, intentionality (low, medium, high or null), confidence as stated, error."""

    def read(value: Column) -> Column:
        ordinal = F.try_variant_get(value, "$.intentionality", "string")
        return _verdict(_unusable(value), intent_tags=_texts(value, "intent_tags"), intentionality=F.when(ordinal.isin(*ORDINALS), ordinal), confidence=confidence(value))

    return _bound(whole_object(reply), read)


def relatedness_verdict(reply: Column) -> Column:
    """related, relation (null unless related), confidence, rationale, error. A confidence that is no number or lies
    outside of 0 to 10 is an error here; a missing one is 0."""

    def read(value: Column) -> Column:
        related, relation = _truthy(value, "related"), F.try_variant_get(value, "$.relation", "string")
        missing = F.try_variant_get(value, "$.confidence", "variant").isNull()
        stated = F.when(missing, 0.0).otherwise(_number(value, "confidence"))
        error = F.coalesce(
            _unusable(value),
            F.when(related & ~F.coalesce(relation.isin(*RELATION_KINDS), F.lit(False)), F.concat(F.lit("unknown relation: "), F.coalesce(relation, F.lit("none")))),
            F.when(stated.isNull(), F.lit("confidence is no number")),
            F.when(F.isnan(stated) | (stated < 0) | (stated > SCALE), F.lit("confidence outside 0 to 10")),
        )
        return _verdict(error, related=related, relation=F.when(related, relation), confidence=stated, rationale=member(value, "rationale"))

    return _bound(_object(_only(F.regexp_extract(unfenced(reply), r"(?s)\{.*\}", 0))), read)


def _texts(value: Column, name: str) -> Column:
    """The texts in a member that is an array, without empty ones; an empty array for all else."""
    items = F.transform(F.try_variant_get(value, f"$.{name}", "array<variant>"), lambda x: stripped(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x != "")


def _action(value: Column) -> Column:
    name = F.try_variant_get(value, "$.type", "string")
    members = sorted({m for ms in ACTION_MEMBERS.values() for m in ms})
    has = lambda m: name.isin(*(t for t, ms in ACTION_MEMBERS.items() if m in ms))
    return F.struct(
        name.alias("action_type"),
        *(F.when(has(m), member(value, m)).alias(m) for m in members),
        F.when(name == "propose_split", _texts(value, "into")).alias("into"),
        member(value, "reason").alias("reason"),
        member(value, "reasoning").alias("reasoning"),
        confidence(value).alias("confidence"),
        kind(F.try_variant_get(value, "$.into", "variant")).alias("into_kind"),
    )


def _actions(value: Column, name: str) -> Column:
    items = F.filter(F.try_variant_get(value, f"$.{name}", "array<variant>"), lambda x: kind(x) == "OBJECT")
    return F.coalesce(F.transform(items, _action), F.array())


def actions(value: Column) -> Column:
    """An object's actions of the four known types, as structs; other types, and a split into no list, are left out."""
    fit = lambda a: a["action_type"].isin(*ACTION_MEMBERS) & ~((a["action_type"] == "propose_split") & F.coalesce(a["into_kind"] != "ARRAY", F.lit(False)))
    return F.transform(F.filter(_actions(value, "actions"), fit), lambda a: a.dropFields("into_kind", "reasoning"))


def chat_envelope(reply: Column) -> Column:
    """answer, suggested_actions: the reply itself and no actions where it isn't an envelope. A parent or alias that is
    suggested without one of its labels is left out."""
    filled = lambda a: F.when(a["action_type"] == SUGGESTED[0], (a["child_label"] != "") & (a["parent_label"] != "")).otherwise((a["label"] != "") & (a["alias"] != ""))
    kept = lambda a: F.struct(a["action_type"].alias("action_type"), *(a[m].alias(m) for t in SUGGESTED for m in ACTION_MEMBERS[t]), a["reasoning"].alias("reasoning"), a["confidence"].alias("confidence"))

    def read(value: Column) -> Column:
        said = F.when(member(value, "answer") != "", member(value, "answer"))
        fit = F.filter(_actions(value, "suggested_actions"), lambda a: a["action_type"].isin(*SUGGESTED) & filled(a))
        return F.struct(F.coalesce(said, unfenced(reply)).alias("answer"), F.transform(fit, kept).alias("suggested_actions"))

    return _bound(whole_object(reply), read)


def detailed_text(reply: Column) -> Column:
    """text, error: a description without fences and label; cut after a word, with an ellipsis, beyond the greatest length."""

    def read(text: Column) -> Column:
        cut = F.concat(F.regexp_replace(F.left(text, F.lit(DETAILED_MAX)), r"(?s) [^ ]*$", ""), F.lit("…"))
        error = F.when(F.char_length(text) < DETAILED_MIN, F.concat(F.lit("too short: "), F.char_length(text).cast("string")))
        return _verdict(error, text=F.when(F.char_length(text) > DETAILED_MAX, cut).otherwise(text))

    return _bound(stripped(F.regexp_replace(unfenced(reply), r"(?i)^(?:detailed\s+)?(?:description|exposition)\s*:\s*", "")), read)


def hashable(value: Column) -> Column:
    """A variant as text that equal values share: members in the order of their names."""
    return F.to_json(value)
