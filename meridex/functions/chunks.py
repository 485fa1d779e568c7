"""Documents in chunks within a budget of characters: sections at second-level headings, long ones in paragraphs, packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters a chunk.
MAX_CHUNK_CHARS = 30_000


def packed(parts: Column, budget: int, separator: str) -> Column:
    """Parts in order, joined while the budget holds; a part over the budget stays whole, alone."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.concat(acc["open"], F.lit(separator), part)
        fits = F.char_length(joined) <= budget
        done = F.when(acc["open"].isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(part).alias("open"))

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def placed(texts: Column) -> Column:
    """Each text and where it begins if the texts are put together with one character between them."""
    empty = F.struct(F.array().cast("array<struct<text: string, char_start: bigint>>").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, text: Column) -> Column:
        one = F.struct(text.alias("text"), acc["at"].alias("char_start"))
        return F.struct(F.array_append(acc["done"], one).alias("done"), (acc["at"] + F.char_length(text) + 1).alias("at"))

    return F.aggregate(texts, empty, step, lambda acc: acc["done"])


def chunk(docs: DataFrame, budget: int = MAX_CHUNK_CHARS) -> DataFrame:
    """doc_id, chunk (from 0), text, char_start, char_end: places in the chunks' texts, put together with one character
    between them. A null, empty or blank text has no chunk; a budget below 1 is an error."""
    if budget < 1:
        raise ValueError("the budget must be positive")
    filled = lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""
    sections = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n(?=## )"), filled)
    paragraphs = lambda s: packed(F.filter(F.split(s, r"\n{2,}"), filled), budget, "\n\n")
    parts = F.flatten(F.transform(sections, lambda s: F.when(F.char_length(s) > budget, paragraphs(s)).otherwise(F.array(s))))
    rows = docs.select("doc_id", F.posexplode(placed(packed(parts, budget, "\n"))).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", "c.text", "c.char_start", (F.col("c.char_start") + F.char_length("c.text")).alias("char_end"))
