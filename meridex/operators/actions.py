"""Proposed changes of the lexicon: validated, routed, applied, decided and taken back, a batch at a time.

entries (label, canonical_term, aliases, parent_label, language; more columns are kept) is the state; an entry's parent is its
place in the tree. actions (seq, action_type and the members of its type; more columns are kept) come in the order of seq,
which no two share. A batch gives what its actions give one after another, but for this: of parents that together would
close a cycle, the first stands and the others are judged once more after the rest of their wave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import graph

#: Confidences from which an action is applied at once, and from which an entry's parent is replaced.
AUTO_APPLY, REPARENT = 8.0, 8.5
#: Types that an operator must decide on; the age in seconds of a claim that counts as lost.
DESTRUCTIVE, CLAIM_SECONDS = ("propose_merge", "propose_split"), 300


@dataclass(frozen=True)
class Outcome:
    """The actions with status, detail and previous_parent_label; the entries after them; node: what was moved in the tree."""

    actions: DataFrame
    entries: DataFrame
    moved: DataFrame


def _subject() -> Column:
    return F.coalesce("child_label", "label", "keep_label", F.lit(""))


def _other() -> Column:
    return F.coalesce("parent_label", "drop_label", F.lit(""))


def _up(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("parent_label").isNotNull()).select(F.col("label").alias("src"), F.col("parent_label").alias("dst"))


def _with_entries(actions: DataFrame, entries: DataFrame) -> DataFrame:
    facts = lambda: F.struct("label", "canonical_term", "aliases", "parent_label", "language")
    rows = actions.withColumn("__one", _subject()).withColumn("__two", _other()).withColumn("__alias", F.trim("alias"))
    rows = rows.join(entries.select(F.col("label").alias("__one"), facts().alias("__e1")), "__one", "left")
    rows = rows.join(entries.select(F.col("label").alias("__two"), facts().alias("__e2")), "__two", "left")
    named = entries.groupBy(F.col("canonical_term").alias("__alias")).agg(F.min("label").alias("__named"))
    return rows.join(named, "__alias", "left")


def _absent(what: str, name: str, entry: str) -> Column:
    return F.when(F.col(entry).isNull(), F.concat(F.lit(f"{what} label "), F.col(name), F.lit(" does not exist")))


def _languages(what: str) -> Column:
    return F.when(~F.col("__e1.language").eqNullSafe(F.col("__e2.language")), F.lit(f"cross-language {what}"))


def _reason(in_cycle: Column) -> Column:
    """The first rule that an action breaks; null if it breaks none."""
    one, two, alias = F.col("__one"), F.col("__two"), F.lower("__alias")
    parent = F.coalesce(
        F.when((one == "") | (two == ""), "child or parent label is empty"),
        F.when(one == two, "child and parent are the same label"),
        _absent("child", "__one", "__e1"),
        _absent("parent", "__two", "__e2"),
        _languages("parent"),
        F.when(F.col("__e1.parent_label") == two, "child already has this parent"),
        F.when(~L.is_valid(two), "invalid parent label format"),
        F.when(L.suffix(two).isNotNull(), "a variant label can't be a parent"),
        F.when(in_cycle, "edge would introduce a cycle"),
    )
    own = F.coalesce(F.col("__e1.aliases"), F.array().cast("array<string>"))
    name = F.coalesce(
        F.when(F.coalesce(alias, F.lit("")) == "", "alias is empty"),
        F.when(one == "", "label is empty"),
        _absent("the", "__one", "__e1"),
        F.when(alias == F.lower("__e1.canonical_term"), "alias equals canonical term"),
        F.when(F.exists(own, lambda a: F.lower(a) == alias), "alias already present on this entry"),
        F.when(F.col("__named").isNotNull(), F.concat(F.lit("alias is already the canonical term of "), F.col("__named"))),
    )
    merge = F.coalesce(
        F.when((one == "") | (two == ""), "keep or drop label is empty"),
        F.when(one == two, "keep and drop are the same label"),
        _absent("keep", "__one", "__e1"),
        _absent("drop", "__two", "__e2"),
        _languages("merge"),
    )
    split = F.coalesce(F.when(one == "", "label is empty"), _absent("the", "__one", "__e1"), F.when(F.size(F.coalesce("into", F.array().cast("array<string>"))) < 2, "split must produce at least 2 variants"))
    kind = F.col("action_type")
    known = F.when(kind == "propose_parent", parent).when(kind == "propose_alias", name).when(kind == "propose_merge", merge).when(kind == "propose_split", split)
    return known.when(~F.coalesce(kind.isin("propose_parent", "propose_alias", *DESTRUCTIVE), F.lit(False)), "unknown action type")


def validated(actions: DataFrame, entries: DataFrame) -> DataFrame:
    """actions with reason (null: valid) and previous_parent_label, each against entries as they are."""
    parents = actions.where("action_type = 'propose_parent'")
    above = graph.closure(_up(entries), parents.select(F.col("parent_label").alias("node")).where("node IS NOT NULL"))
    cycles = above.select(F.col("src").alias("__two"), F.col("dst").alias("__one"), F.lit(True).alias("__cycle"))
    rows = _with_entries(actions, entries).join(cycles, ["__one", "__two"], "left")
    previous = F.when(F.col("action_type") == "propose_parent", F.col("__e1.parent_label"))
    return rows.select(*(actions[c] for c in actions.columns), _reason(F.coalesce("__cycle", F.lit(False))).alias("reason"), previous.alias("previous_parent_label"))


def routed(actions: DataFrame, entries: DataFrame, auto_apply: float = AUTO_APPLY, reparent: float = REPARENT) -> DataFrame:
    """actions with status (invalid, pending_review or applied), detail and previous_parent_label; nothing is applied."""
    rows = validated(actions, entries)
    moves = F.col("previous_parent_label").isNotNull()
    floor = F.when(moves, reparent).otherwise(auto_apply)
    low = F.coalesce(F.col("confidence") < floor, F.lit(True))
    below = F.concat(F.lit("confidence below "), F.when(moves, "re-parenting").otherwise("auto-apply"), F.lit(" threshold "), floor.cast("string"))
    bad, hard = F.col("reason").isNotNull(), F.col("action_type").isin(*DESTRUCTIVE)
    status = F.when(bad, "invalid").when(hard | low, "pending_review").otherwise("applied")
    detail = F.when(bad, F.col("reason")).when(hard, "destructive actions require operator review").when(low, below).otherwise("auto-applied")
    return rows.withColumn("status", status).withColumn("detail", detail).drop("reason")


def _later_copies(rows: DataFrame) -> DataFrame:
    """Of applied aliases that fold to one on an entry the first stays; those after it are there already."""
    applied = rows.where("action_type = 'propose_alias' AND status = 'applied'")
    first = applied.groupBy(F.col("label").alias("__l"), F.lower(F.trim("alias")).alias("__a")).agg(F.min("seq").alias("__first"))
    met = (F.col("action_type") == "propose_alias") & (F.col("label") == F.col("__l")) & (F.lower(F.trim("alias")) == F.col("__a"))
    late = F.coalesce((F.col("seq") > F.col("__first")) & F.col("status").isin("applied", "pending_review"), F.lit(False))
    detail = F.when(late, "alias already present on this entry").otherwise(F.col("detail"))
    out = rows.join(first, met, "left").withColumns({"detail": detail, "status": F.when(late, "invalid").otherwise(F.col("status"))})
    return out.drop("__l", "__a", "__first")


def _moved(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """entries with the parents (label, parent) that are given, null for none."""
    new = parents.select("label", F.col("parent").alias("__new"), F.lit(True).alias("__hit"))
    now = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("parent_label"))
    return entries.join(new, "label", "left").withColumn("parent_label", now).select(*entries.columns)


def _first_on_cycles(chosen: DataFrame, entries: DataFrame) -> DataFrame:
    """seq of those of chosen (seq, label, parent) that close no cycle together, or are the first on theirs."""
    up = _up(_moved(entries, chosen))
    nodes = graph.on_cycle(up)
    if nodes.isEmpty():
        return chosen.select("seq")
    ring = up.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    rings = graph.closure(ring).join(chosen.select(F.col("label").alias("dst"), F.col("seq").alias("other")), "dst").groupBy(F.col("src").alias("label")).agg(F.min("other").alias("first"))
    return chosen.join(rings, "label", "left").where("first IS NULL OR first = seq").select("seq")


def dispatch(actions: DataFrame, entries: DataFrame, auto_apply: float = AUTO_APPLY, reparent: float = REPARENT) -> Outcome:
    """Judge a batch and apply what may be. In a wave every open action is judged against the entries as they are; of
    each child the first parent that may be applied is, and what comes before it is settled; what comes after is left to
    the next wave. There are as many waves as parents that one child gets, and a few more where cycles threaten."""
    # parents go last: an alias never depends on them, nor they on an alias
    names = _later_copies(routed(actions.where("NOT action_type <=> 'propose_parent'"), entries, auto_apply, reparent))
    done, open_, now = [graph._cut(names)], actions.where("action_type = 'propose_parent'"), entries
    moves = []
    while not open_.isEmpty():
        rows = graph._cut(routed(open_, now, auto_apply, reparent))
        first = rows.where("status = 'applied'").groupBy("child_label").agg(F.min("seq").alias("__first"))
        rows = rows.join(first, "child_label", "left")
        chosen = rows.where("seq = __first").select("seq", F.col("child_label").alias("label"), F.col("parent_label").alias("parent"))
        stand = _first_on_cycles(graph._cut(chosen), now).withColumn("__stands", F.lit(True))
        settled = F.col("__first").isNull() | (F.col("seq") < F.col("__first")) | F.coalesce("__stands", F.lit(False))
        rows = graph._cut(rows.join(stand, "seq", "left").withColumn("__settled", settled))
        applied = rows.where("__stands").select("child_label", F.col("parent_label").alias("parent"), "previous_parent_label")
        moves.append(applied.where("previous_parent_label IS NOT NULL").select(F.col("child_label").alias("node")))
        now = graph._cut(_moved(now, applied.withColumnRenamed("child_label", "label")))
        done.append(rows.where("__settled").select(*names.columns))
        open_ = rows.where("NOT __settled").select(*actions.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    moved = entries.select(F.col("label").alias("node")).limit(0)
    for more in moves:
        moved = moved.unionByName(more)
    given = done[0].where("action_type = 'propose_alias' AND status = 'applied'")
    return Outcome(out, _with_aliases(now, given), moved.distinct())


def _with_aliases(entries: DataFrame, given: DataFrame) -> DataFrame:
    more = given.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("seq", F.trim("alias").alias("a")))).alias("__more"))
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    both = F.when(F.col("__more").isNotNull(), F.array_union(own, F.col("__more.a"))).otherwise(F.col("aliases"))
    return entries.join(more, "label", "left").withColumn("aliases", both).select(*entries.columns)


def recovered(proposals: DataFrame, now: Column) -> DataFrame:
    """proposals (status, applying_at) with claims older than 300 seconds given back to review."""
    lost = F.coalesce((F.col("status") == "applying") & (F.col("applying_at") < now - F.expr(f"INTERVAL {CLAIM_SECONDS} SECONDS")), F.lit(False))
    return proposals.withColumns({"status": F.when(lost, "pending_review").otherwise(F.col("status")), "applying_at": F.when(~lost, F.col("applying_at"))})


def accept(proposals: DataFrame, entries: DataFrame) -> Outcome:
    """Apply proposals that an operator accepts. They are judged anew; what can't be applied any more, and what is
    destructive, stays in review with the reason as detail; a proposal in another status keeps it, and says so."""
    waits = F.coalesce(F.col("status") == "pending_review", F.lit(False))
    plain = [c for c in proposals.columns if c not in ("status", "detail", "previous_parent_label")]
    out = dispatch(proposals.where(waits).select(*plain, F.lit(None).cast("string").alias("__kept")).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), entries, float("-inf"), float("-inf"))
    status = F.when(F.col("status") == "applied", "applied").otherwise("pending_review")
    detail = F.when(F.col("status") == "applied", "accepted").when(F.col("status") == "invalid", F.concat(F.lit("can no longer be applied: "), F.col("detail"))).otherwise("no way to apply this type")
    judged = out.actions.withColumn("detail", detail).withColumn("status", status).drop("__kept")
    refused = proposals.where(~waits).select(*plain, F.lit(None).cast("string").alias("previous_parent_label"), "status", F.concat(F.lit("can't accept in status "), F.coalesce("status", F.lit("none"))).alias("detail"))
    return Outcome(judged.unionByName(refused), out.entries, out.moved)


def reject(proposals: DataFrame) -> DataFrame:
    """proposals with status and detail: rejected where they waited for review, else as they were."""
    waits = F.coalesce(F.col("status") == "pending_review", F.lit(False))
    detail = F.when(waits, "rejected").otherwise(F.concat(F.lit("can't reject in status "), F.coalesce("status", F.lit("none"))))
    return proposals.withColumn("detail", detail).withColumn("status", F.when(waits, "rejected").otherwise(F.col("status")))


def roll_back(proposals: DataFrame, entries: DataFrame) -> Outcome:
    """Take applied proposals (seq, action_type, child_label, label, alias, previous_parent_label, status) back, the last
    first: an entry has the parent again that it had before the first of them, and is without the aliases. A proposal in
    another status is left as it is, and says so."""
    applied = F.coalesce(F.col("status") == "applied", F.lit(False))
    undone = proposals.where(applied)
    parents = undone.where("action_type = 'propose_parent'").groupBy(F.col("child_label").alias("label")).agg(F.min_by("previous_parent_label", "seq").alias("parent"))
    names = undone.where("action_type = 'propose_alias'").groupBy("label").agg(F.collect_set(F.trim("alias")).alias("__gone"))
    back = _moved(entries, parents).join(names, "label", "left")
    back = back.withColumn("aliases", F.when(F.col("__gone").isNotNull(), F.array_except("aliases", "__gone")).otherwise(F.col("aliases"))).select(*entries.columns)
    detail = F.when(applied, "rolled back").otherwise(F.concat(F.lit("can't roll back in status "), F.coalesce("status", F.lit("none"))))
    out = proposals.withColumn("detail", detail).withColumn("status", F.when(applied, "rolled_back").otherwise(F.col("status")))
    return Outcome(out, back, undone.select(F.coalesce("child_label", "label").alias("node")).where("node IS NOT NULL").distinct())
