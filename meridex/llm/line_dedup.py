"""Line dedup by winnowing over line hashes.

The non-blank lines of a document are a sequence of hashes. A window is the shortest stretch of lines from a line on
(or, backwards, up to a line) that has at least MIN_WORDS words. Of each window the least line hash is selected (the
last one, if several are least), so that windows of equal lines select the same line: the selected (document, line) are
the fingerprints, a few a document, and no run of MIN_WORDS words is without one. Positions of equal fingerprints are
joined; fingerprints that occur at one position only, the most, go no further. A match is extended both ways from the
selected line to the ends of its windows: the lines before and after it have to be equal, as two hashes more. Every
extended match is with the first place that has it (one row a content, never pairs). Windows from and up to every line
reach both ends of a repeated run: a line of a run of MIN_WORDS words or more lies in a forward or in a backward window
inside the run. Later occurrences are deleted, the first in order of doc_id and place stays. JVM-side throughout.

Defined cases: a null text stays null; blank lines are not counted and stay; windows that overlap the first occurrence in
the same document don't count as later; rows that repeat both doc_id and text are one document, each is returned; a null
doc_id comes first; an empty table gives an empty result; other columns are passed through, whatever their names, but for
one named lines_deleted, which dedup_lines replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, join_groups, written

MIN_WORDS = 50


def row_key(text: str) -> Column:
    return F.xxhash64("doc_id", text)


def line_windows(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, rid, lo, hi (line numbers), at, fingerprint (the selected line and its hash), left, right (hashes of the
    lines before and after it) of every window, forward and backward."""
    lines = docs.select("doc_id", row_key(text).alias("rid"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines")).select("doc_id", "rid", F.posexplode("lines").alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    lines = lines.select("doc_id", "rid", "pos", F.xxhash64("line").alias("h"), F.size(F.split("line", " +")).cast("long").alias("words"))
    # a repeated row is the same document: its lines count once
    lines = lines.dropDuplicates(["doc_id", "rid", "pos"])
    own = Window.partitionBy("doc_id", "rid")
    lines = lines.withColumn("end", F.sum("words").over(own.orderBy("pos"))).withColumn("begin", F.col("end") - F.col("words"))

    def windows(order: str, low: int, high: int) -> DataFrame:
        frame = own.orderBy(order).rangeBetween(low, high)
        return lines.select(
            "doc_id",
            "rid",
            F.min("pos").over(frame).alias("lo"),
            F.max("pos").over(frame).alias("hi"),
            F.sum("words").over(frame).alias("n"),
            F.min(F.struct("h", (-F.col("pos")).alias("back"))).over(frame).alias("least"),
            F.collect_list(F.struct("pos", "h")).over(frame).alias("x"),
        )

    both = windows("begin", 0, min_words - 1).union(windows("end", 1 - min_words, 0)).where(F.col("n") >= min_words)
    both = both.select("doc_id", "rid", "lo", "hi", (-F.col("least.back")).alias("at"), F.col("least.h").alias("fingerprint"), F.array_sort("x").alias("x"))
    side = lambda keep: F.xxhash64(F.transform(F.filter("x", keep), lambda v: v["h"]))
    return both.select("doc_id", "rid", "lo", "hi", "at", "fingerprint", side(lambda v: v["pos"] < F.col("at")).alias("left"), side(lambda v: v["pos"] > F.col("at")).alias("right")).distinct()


def repeated_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, rid, gone (the numbers of the lines to delete) of the documents that repeat runs of earlier ones, or of their own."""
    windows = written(line_windows(docs, text, min_words), "line-windows")
    # the selected positions, and the fingerprints that have several of them
    selected = windows.select("doc_id", "rid", "at", "fingerprint").distinct()
    again = written(selected.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("places")).where("places > 1"), "repeated-fingerprints")
    met = written(join_groups(windows, again, ["fingerprint"], "places", windows.count()).drop("places"), "met-windows")
    dropped(windows, again)
    keys = ["fingerprint", "left", "right"]
    place = F.struct("doc_id", "rid", "lo", "hi")
    groups = written(met.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-windows")
    found = join_groups(met, groups, keys, "n", met.count())
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rid") == F.col("first.rid"))
    later = found.where(~same | (F.col("lo") > F.col("first.hi")))
    gone = written(later.select("doc_id", "rid", F.explode(F.sequence("lo", "hi")).alias("pos")).groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("gone")), "gone-lines")
    dropped(met, groups)
    return gone


def _without(docs: DataFrame, text: str, min_words: int) -> tuple[DataFrame, str]:
    """docs with the later repeated runs taken out of the text, and the name of a further column, how many lines went."""
    doc, rid, gone, n = fresh(docs, "gone_doc", "gone_rid", "gone_lines", "gone_count")
    found = repeated_lines(docs, text, min_words).select(F.col("doc_id").alias(doc), F.col("rid").alias(rid), F.col("gone").alias(gone))
    # always by shuffle: the gone lines grow with the corpus, and one plan at every size makes runs on small tables tell of large ones
    joined = docs.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (row_key(text) == F.col(rid)), "left")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i) | (F.trim(x) == "")), "\n")
    cut = F.when(F.col(gone).isNull(), F.col(text)).otherwise(rest)
    count = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    return joined.select(*(cut.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns), count.alias(n)), n


def dedup_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, the text without the later repeated runs, and lines_deleted (int)."""
    out, n = _without(docs, text, min_words)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "lines_deleted"), F.col(n).alias("lines_deleted"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """dedup_lines for a pipeline: the columns of docs; documents that nothing but repeated lines made up are dropped."""
    out, n = _without(docs, text, min_words)
    return out.where((F.col(n) == 0) | (F.trim(F.translate(F.col(text), "\n", "")) != "")).select(*(F.col(f"`{c}`") for c in docs.columns))
