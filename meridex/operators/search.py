"""Ranked search over entries (label, canonical_term, aliases, texts, language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .references import bounded

#: Points for a label, a term and each alias; the shortest term that counts; hits at most.
LABEL, TERM, ALIAS, MIN_TERM, LIMIT = 30, 20, 15, 4, 20
#: Weights of a word of the query in the term, an alias or a definition.
TEXT_WEIGHTS = (10, 5, 1)
WORD = r"(?U)\w+"


def label_mentioned(label: Column, query: Column) -> Column:
    """Whether the lower-case query has the label as a whole: not as the beginning of a deeper or of a variant's."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.lower(label), F.lit(r"\E(?!\.\d)(?![a-z0-9])"))
    return F.coalesce(F.regexp_like(query, quoted), F.lit(False))


def _used(term: Column, query: Column) -> Column:
    return F.coalesce((F.length(term) >= MIN_TERM) & F.regexp_like(query, bounded(F.lower(term))), F.lit(False))


def score(query: Column) -> Column:
    """The points of an entry for a lower-case query; every alias that it has adds."""
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: _used(a, query))
    return F.when(label_mentioned(F.col("label"), query), LABEL).otherwise(0) + F.when(_used(F.col("canonical_term"), query), TERM).otherwise(0) + ALIAS * F.size(aliases)


def text_score(query: Column) -> Column:
    """Words of the query in the term, the aliases and the definitions, weighted."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0)))
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    hits = lambda c: F.size(F.array_intersect(words(query), words(c)))
    a, b, c = TEXT_WEIGHTS
    return a * hits(F.col("canonical_term")) + b * hits(joined(F.col("aliases"))) + c * hits(joined(F.col("texts")))


def match_kind(terms: Column, via_text: Column) -> Column:
    """The strongest of label, exact, alias, text and partial, for the lower-case terms that were asked for."""
    has = lambda c: F.coalesce(F.array_contains(terms, F.lower(c)), F.lit(False))
    alias = F.coalesce(F.exists("aliases", lambda a: F.array_contains(terms, F.lower(a))), F.lit(False))
    return F.when(has(F.col("label")), "label").when(has(F.col("canonical_term")), "exact").when(alias, "alias").when(via_text, "text").otherwise("partial")


def search_terms(entries: DataFrame, terms: list[str], language: str = "en", passes: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """label, canonical_term, score, kind of the best entries of a language; no points is no hit. passes: a condition on
    entries that hits must hold; it is applied before the limit. Ties by label; both descending."""
    query, asked = F.lit(" ".join(terms).lower()), F.array(*(F.lit(t.lower()) for t in terms)).cast("array<string>")
    rows = entries.where(F.col("language") == language).withColumn("__text", text_score(query))
    total = score(query) + 10 * F.col("__text")
    rows = rows.withColumn("score", total.cast("int")).where("score > 0")
    if passes is not None:
        rows = rows.where(passes)
    return rows.orderBy(F.desc("score"), F.desc("label")).limit(limit).select("label", "canonical_term", "score", match_kind(asked, F.col("__text") > 0).alias("kind"))
