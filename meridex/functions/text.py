"""Text expressions: digests, titles, folded names, token estimates, shingles, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for no text."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("long")


def title(text: Column, fallback: Column) -> Column:
    """The first level-one heading, else the fallback."""
    found = F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    return F.when(found != "", found).otherwise(fallback)


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")


def shingles(tokens: Column, n: int) -> Column:
    """All runs of n words, space-joined; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(df: DataFrame, text: str, n: int, *keep: str) -> DataFrame:
    """keep, and the 64-bit hashes (hs) of all runs of n words, each once. The words are a column of their own before the
    lambda, which would otherwise split the text again for every run."""
    split = df.select(*keep, words(F.col(text)).alias("__words"))
    own = F.when(F.size("__words") >= n, F.transform(F.sequence(F.lit(1), F.size("__words") - n + 1), lambda i: F.xxhash64(F.slice("__words", i, n))))
    return split.select(*keep, F.array_distinct(F.coalesce(own, F.array().cast("array<long>"))).alias("hs"))


def plain_html(html: Column, limit: int = 1000) -> Column:
    """Tags taken out, white space made single, at most limit characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"[ \t\n\r]+", " ")), 1, limit)


def snippet(text: Column, term: Column, window: int = 1500) -> Column:
    """A window around the first mention in any case, else the head."""
    at = F.instr(F.lower(text), F.lower(term))
    return F.trim(F.substring(text, F.when(at > 0, F.greatest(F.lit(1), at - window // 2)).otherwise(F.lit(1)), F.lit(window)))


def capitalised_terms(text: Column) -> Column:
    """Capitalised ASCII words of four letters and more, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]{3,})"), F.lit(1))
