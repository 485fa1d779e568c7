"""Bundles: the meanings that a question needs, as one text within a budget of tokens.

Finding, reference closure and rendering run on the entries as DataFrames; the driver gets the rendered texts of the bundle's own
entries alone, which are one prompt, and takes the steps down to the budget on their lengths.

entries: label, canonical_term, aliases, parent_label, path, references_labels, language, is_stale, stale_reasons
(array of change_type, note) and definitions (array of text, context_id, model_used, detailed_text, intent_tags,
intentionality, grounding: a line or null). contexts: context_id, name, description, kind; frames alone name meanings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import stripped
from . import graph, search

#: Tokens, hits of a term, alternatives and characters of a closure line, as far as the budget asks for less.
BUDGET, PER_TERM, FEW_ALTERNATIVES, LINE, SHORT_LINE = 1500, 5, 3, 160, 80
#: References, aliases and last reasons that are shown.
SHOWN_REFERENCES, SHOWN_ALIASES, SHOWN_REASONS = 8, 5, 2
#: The texts around the entries.
HEAD = "CODIFIED MEANINGS\n\nFrames are co-equal: when an entry carries several, choose the frame(s) your question implies; cite the MPL label (and frame name) you keep.\n"
CLOSURE_HEAD = "REFERENCED TERMS (closure — cited by the entries above)\n"
OTHERS = "OTHER CANDIDATE MATCHES: "
ONE_FRAME = "  Definitions:"
MANY_FRAMES = "  Definitions (multiple contexts are co-equal — each speaks from its own frame; none supersedes another):"
HANDLE = r"^(MPL-\d{3}(?:\.\d{3})*[a-z]?)(?:#(.+))?$"


@dataclass
class Bundle:
    entries: list[str]
    closure: list[str]
    alternatives: list[tuple[str, str, int]]
    unresolved: list[str]
    token_estimate: int
    token_budget: int
    as_text: str
    degradations: list[str] = field(default_factory=list)


def grounding_line(invoked: Column, relation: Column, corpus_confidence: Column, evidence: Column) -> Column:
    """One line on the outside evidence for a definition, without any of its text; null where none was sought."""
    score = F.when(corpus_confidence.isNull(), "unscored").otherwise(F.format_string("%.1f", corpus_confidence))
    sources = F.concat(evidence.cast("string"), F.when(evidence == 1, " source").otherwise(" sources"))
    return F.when(invoked, F.concat(F.lit("external grounding: "), F.coalesce(relation, F.lit("unclassified")), F.lit("; corpus confidence "), score, F.lit("; "), sources))


def _named(entries: DataFrame, contexts: DataFrame) -> DataFrame:
    """entries (key, definitions ...) with meanings: the definitions in order, with their frames' name and description."""
    frames = contexts.where("kind = 'frame'").select("context_id", F.col("name").alias("frame"), F.col("description").alias("about"))
    each = entries.select("key", F.posexplode("definitions").alias("pos", "d")).withColumn("context_id", F.col("d.context_id"))
    each = each.join(frames, "context_id", "left")
    told = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "d", "frame", "about"))).alias("meanings"))
    return entries.join(told, "key", "left").withColumn("meanings", F.coalesce("meanings", F.array().cast(told.schema["meanings"].dataType)))


def _list(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _when(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _meaning(m: Column, provenance: bool) -> Column:
    d, lit = m["d"], F.lit
    said = F.concat(lit("      ["), F.coalesce(F.nullif(d["model_used"], lit("")), lit("?")), lit("] "), d["text"]) if provenance else F.concat(lit("      "), d["text"])
    prose = F.filter(F.transform(F.split(F.coalesce(d["detailed_text"], lit("")), r"\r?\n"), lambda p: stripped(p)), lambda p: p != "")
    extras = F.concat_ws("; ", F.when(F.size(d["intent_tags"]) > 0, F.concat(lit("deployed to: "), F.array_join(d["intent_tags"], ", "))), F.concat(lit("intentionality: "), F.nullif(d["intentionality"], lit(""))))
    aside = lambda c: F.concat(lit("        ("), c, lit(")"))
    return F.concat(F.array(said), F.transform(prose, lambda p: F.concat(lit("        "), p)), _when(d["grounding"].isNotNull(), aside(d["grounding"])), _when(extras != "", aside(extras)))


def _full(provenance: bool) -> Column:
    lit, path, ids = F.lit, _list("path"), F.transform("meanings", lambda m: F.coalesce(m["d"]["context_id"], F.lit("")))
    reasons = F.coalesce(F.size("stale_reasons"), lit(0))
    last = F.when(reasons > 0, F.slice("stale_reasons", F.greatest(lit(1), reasons - SHOWN_REASONS + 1), lit(SHOWN_REASONS)))
    why = F.coalesce(F.transform(last, lambda r: F.concat(lit("    - "), F.coalesce(r["change_type"], lit("?")), lit(": "), F.coalesce(r["note"], lit("")))), F.array().cast("array<string>"))

    def group(i: Column) -> Column:
        own = F.filter("meanings", lambda m: F.coalesce(m["d"]["context_id"], F.lit("")) == i)
        name, about = own[0]["frame"], F.nullif(own[0]["about"], lit(""))
        head = F.concat(lit("    Context ["), F.coalesce(F.nullif(name, lit("")), lit("unspecified")), lit("]"), F.coalesce(F.when(name != "", F.concat(lit(" — "), about)), lit("")))
        return F.concat(F.array(head), F.flatten(F.transform(own, lambda m: _meaning(m, provenance))))

    frames = F.array_distinct(ids)
    shown = lambda c, n: F.array_join(F.slice(_list(c), 1, n), ", ")
    lines = F.concat(
        F.array(F.concat(lit("  Parent: "), F.coalesce(F.nullif("parent_label", lit("")), lit("(top-level)")))),
        _when(F.size(path) > 0, F.concat(lit("  Path: "), F.array_join(path, " > "))),
        F.when(F.col("is_stale"), F.concat(F.array(F.concat(lit("  STALE (reasons: "), F.greatest(lit(0), reasons).cast("string"), lit(")"))), why)).otherwise(F.array().cast("array<string>")),
        _when(F.size("meanings") > 0, F.when(F.size(frames) > 1, MANY_FRAMES).otherwise(ONE_FRAME)),
        F.flatten(F.transform(frames, group)),
        _when(F.size(_list("references_labels")) > 0, F.concat(lit("  References: "), shown("references_labels", SHOWN_REFERENCES))),
        _when(F.size(_list("aliases")) > 0, F.concat(lit("  Aliases: "), shown("aliases", SHOWN_ALIASES))),
    )
    return F.array_join(F.concat(F.array(_title()), lines), "\n")


def _title() -> Column:
    return F.concat(F.lit("--- "), F.col("label"), F.lit(": "), F.col("canonical_term"), F.lit(" ---"))


def _compact(width: int) -> Column:
    def line(m: Column) -> Column:
        text = stripped(m["d"]["text"])
        cut = F.when(F.char_length(text) > width, F.concat(F.regexp_replace(F.left(text, F.lit(width - 1)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)
        return F.concat(F.lit("  ["), F.coalesce(F.nullif(m["frame"], F.lit("")), F.lit("unspecified")), F.lit("] "), cut)

    return F.array_join(F.concat(F.array(_title()), F.transform("meanings", line), _when(F.coalesce("is_stale", F.lit(False)), F.lit("  (STALE)"))), "\n")


def rendered(entries: DataFrame, contexts: DataFrame) -> DataFrame:
    """key, label, canonical_term, refs, and the entry's texts: full, plain (without provenance), line, short_line."""
    named = _named(entries, contexts)
    texts = {"full": _full(True), "plain": _full(False), "line": _compact(LINE), "short_line": _compact(SHORT_LINE)}
    return named.select("key", "label", "canonical_term", _list("references_labels").alias("refs"), *(c.alias(n) for n, c in texts.items()))


def codified(entries: DataFrame, contexts: DataFrame, handles: DataFrame) -> DataFrame:
    """The entries that handles (key) name, with key; a handle of a frame, by its id or else its name, leaves that frame's
    definitions only. Handles of an unknown label or frame give nothing."""
    part = lambda n: F.nullif(F.regexp_extract(F.trim("key"), HANDLE, n), F.lit(""))
    asked = handles.select("key").distinct().select("key", part(1).alias("label"), part(2).alias("asked"))
    frames = contexts.where("kind = 'frame'").select("context_id", "name")
    names = frames.select(F.col("context_id").alias("asked"), F.col("context_id").alias("only"), F.lit(0).alias("rank"))
    names = names.unionByName(frames.select(F.col("name").alias("asked"), F.col("context_id").alias("only"), F.lit(1).alias("rank")))
    names = names.groupBy("asked").agg(F.min_by("only", F.struct("rank", "only")).alias("only"))
    found = asked.join(names, "asked", "left").where("asked IS NULL OR only IS NOT NULL")
    own = F.when(F.col("only").isNull(), F.col("definitions")).otherwise(F.filter("definitions", lambda d: d["context_id"] == F.col("only")))
    return entries.join(found, "label").withColumn("definitions", own).select("key", *entries.columns)


def _tokens(text: str) -> int:
    return -(-len(text) // 4)


def build_bundle(entries: DataFrame, contexts: DataFrame, asked: list[str], budget: int = BUDGET, language: str = "en", passes: Column | None = None, per_term: int = PER_TERM) -> Bundle:
    """Handles stay whatever the budget; of a term the best entry is in, and its other hits are alternatives. All that the entries
    refer to follows, the nearest first. Over the budget, in order: fewer alternatives, no provenance, the term with the
    lowest score back among the alternatives (never the last entry), shorter lines. Frames and closure always stay."""
    spark = entries.sparkSession
    asked = [a.strip() for a in asked if a.strip()]
    is_handle = lambda a: bool(re.match(HANDLE, a))
    searched = entries.withColumn("texts", F.transform("definitions", lambda d: d["text"]))
    hits = {a: search.search_terms(searched, [a], language, passes, per_term).collect() for a in dict.fromkeys(asked) if not is_handle(a)}
    handles = list(dict.fromkeys(a for a in asked if is_handle(a)))
    wanted = spark.createDataFrame([(k,) for k in {*handles, *(h[0].label for h in hits.values() if h)}], "key string")
    primary_rows = graph._cut(codified(entries, contexts, wanted))
    texts = {r.key: r for r in rendered(primary_rows, contexts).collect()}

    unresolved = [a for a in handles if a not in texts]
    primaries: list[tuple[int | None, str]] = [(None, a) for a in handles if a in texts]
    explicit, alternatives = len(primaries), []
    for term in (a for a in asked if not is_handle(a)):
        if not hits[term]:
            unresolved.append(term)
            continue
        top, *rest = hits[term]
        taken = {k for _, k in primaries}
        if top.label not in taken and top.label in texts:
            primaries.append((top.score, top.label))
            taken.add(top.label)
        alternatives += [(h.label, h.canonical_term, h.score) for h in rest if h.label not in taken and h.label not in {a[0] for a in alternatives}]

    edges = entries.select(F.col("label").alias("src"), F.explode("references_labels").alias("dst"))
    reached = graph.closure(edges, primary_rows.select(F.col("label").alias("node"))).select(F.col("dst").alias("label")).distinct()
    cited = {r.label: r for r in rendered(entries.join(reached, "label", "left_semi").withColumn("key", F.col("label")), contexts).collect()}

    def walk() -> list[str]:
        seen, order = {texts[k].label for _, k in primaries}, []
        level = [r for _, k in primaries for r in texts[k].refs]
        while level:
            new = [r for r in dict.fromkeys(level) if r not in seen]
            seen.update(new)
            order += (new := [r for r in new if r in cited])
            level = [x for r in new for x in cited[r].refs]
        return order

    def text(full: str = "full", line: str = "line", few: int | None = None) -> str:
        closure = [cited[r][line] for r in walk()]
        parts = [HEAD, *(texts[k][full] + "\n" for _, k in primaries)]
        parts += [CLOSURE_HEAD, "\n".join(closure) + "\n"] if closure else []
        parts += [OTHERS + ", ".join(f"{a[0]} ({a[1]})" for a in alternatives[:few])] if alternatives[:few] else []
        return "\n".join(parts).rstrip() + "\n"

    how: dict = {}
    steps: list[str] = []
    if _tokens(text()) > budget and len(alternatives) > FEW_ALTERNATIVES:
        how["few"] = FEW_ALTERNATIVES
        steps.append("alternatives_capped")
    if _tokens(text(**how)) > budget:
        how["full"] = "plain"
        steps.append("provenance_dropped")
    while _tokens(text(**how)) > budget and len(primaries) > max(1, explicit):
        lowest = min((p for p in primaries if p[0] is not None), key=lambda p: p[0])
        primaries.remove(lowest)
        alternatives.insert(0, (lowest[1], texts[lowest[1]].canonical_term, 0))
        steps += ["breadth_trimmed"] if "breadth_trimmed" not in steps else []
    if _tokens(text(**how)) > budget:
        how["line"] = "short_line"
        steps.append("closure_hardened")
    whole = text(**how)
    return Bundle([k for _, k in primaries], walk(), alternatives[: how.get("few")], unresolved, _tokens(whole), budget, whole, steps)
