"""Queries of the lexicon, retrieval and audit operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import replies
from ..functions import text as X
from ..operators import actions, audit, backfill, copies, graph, grounding, search, vectors, votes
from ..operators import labels as next_labels
from ..operators import references as refs
from .registry import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# documents ---------------------------------------------------------------------------------------------------------


@query("ingest_dedupe", "SELECT checksum, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS checksum FROM documents) GROUP BY checksum")
def ingest_dedupe(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("duplicate_groups", "SELECT sha256(text) AS checksum, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("document_title", r"SELECT doc_id, CASE WHEN regexp_extract(text, '(?m)^#[ \t]+(.+?)[ \t]*$', 1) <> '' THEN regexp_extract(text, '(?m)^#[ \t]+(.+?)[ \t]*$', 1) ELSE 'doc-' || doc_id END AS title FROM documents")
def document_title(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.title(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"))


@query("lexicon_by_language", "SELECT lang, count(*) AS documents, count(DISTINCT sha256(text)) AS texts, min(doc_id) AS first_id FROM documents GROUP BY lang")
def lexicon_by_language(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(F.sha2("text", 256)).alias("texts"), F.min("doc_id").alias("first_id"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("candidate_terms", "SELECT lower(term) AS term, count(*) AS mentions, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1)) AS term FROM documents) GROUP BY 1")
def candidate_terms(spark, sf_dir):
    terms = t(spark, sf_dir, "documents").select("doc_id", F.explode(X.capitalised_terms(F.col("text"))).alias("term"))
    return terms.groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


SHINGLES = r"""SELECT {id}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s
FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) >= 8"""


@query("copy_detection", f"SELECT doc_id, item_id, count(DISTINCT s) AS runs FROM ({SHINGLES.format(id='doc_id', table='documents')}) JOIN ({SHINGLES.format(id='item_id', table='benchmark')}) USING (s) GROUP BY doc_id, item_id")
def copy_detection(spark, sf_dir):
    """Documents that hold runs of eight words of benchmark items."""
    return copies.shared_runs(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(
    "source_snippet",
    r"SELECT doc_id, trim(substring(text, CASE WHEN strpos(lower(text), lower(term)) > 0 THEN greatest(1, strpos(lower(text), lower(term)) - 750) ELSE 1 END, 1500), ' ') AS snippet FROM (SELECT doc_id, text, regexp_extract(text, '([A-Z][a-z]{3,})', 1) AS term FROM documents) WHERE term <> ''",
)
def source_snippet(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").withColumn("term", F.regexp_extract("text", "([A-Z][a-z]{3,})", 1)).where("term <> ''")
    return docs.select("doc_id", X.snippet(F.col("text"), F.col("term")).alias("snippet"))


@query("html_clean", r"SELECT page_id, substring(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' '), 1, 1000) AS body FROM pages")
def html_clean(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.plain_html(F.col("html")).alias("body"))


@query("static_evidence_dedupe", "SELECT lower(url) AS evidence, min(page_id) AS page_id, count(*) AS hits FROM pages GROUP BY 1")
def static_evidence_dedupe(spark, sf_dir):
    return t(spark, sf_dir, "pages").groupBy(F.lower("url").alias("evidence")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("hits"))


# conversations -----------------------------------------------------------------------------------------------------


@query("transcript_join", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id")
def transcript_join(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    own = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), lines.alias("x"))
    return own.select("conv_id", "turns", F.array_join(F.transform("x", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("transcript"))


@query("latest_message", "SELECT conv_id, max(turn) AS turn, arg_max(text, (turn, role, text)) AS text FROM conversations GROUP BY conv_id")
def latest_message(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", F.struct("turn", "role", "text")).alias("text"))


@query("first_message_by_role", "SELECT conv_id, role, min(turn) AS turn, arg_min(text, (turn, text)) AS text FROM conversations GROUP BY conv_id, role")
def first_message_by_role(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"), F.min_by("text", F.struct("turn", "text")).alias("text"))


@query("coverage_stats", "SELECT role, count(*) AS definitions, count(*) FILTER (turn % 2 = 0) AS framed, count(*) FILTER (length(text) >= 200) AS annotated, count(DISTINCT conv_id) AS entries FROM conversations GROUP BY role")
def coverage_stats(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("definitions"), F.count_if(F.col("turn") % 2 == 0).alias("framed"), F.count_if(F.char_length("text") >= 200).alias("annotated"), F.count_distinct("conv_id").alias("entries"))


# the audit trail ---------------------------------------------------------------------------------------------------

LOG_SQL = "SELECT event_id, ts, user_id AS term, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'undecided' WHEN 'signup' THEN 'rejected' WHEN 'click' THEN 'split' ELSE 'elaborated' END AS outcome, 1 + event_id % 5 AS iterations, event_id % 101 AS confidence10 FROM events"


def audit_log(spark, sf_dir):
    kinds = {"purchase": "accepted", "error": "undecided", "signup": "rejected", "click": "split"}
    outcome = F.coalesce(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")], F.lit("elaborated"))
    return t(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("term"), outcome.alias("outcome"), (1 + F.col("event_id") % 5).alias("iterations"), (F.col("event_id") % 101).alias("confidence10"))


@query("debate_stats", f"SELECT outcome, count(*) AS n, avg(iterations) AS avg_iterations, avg(confidence10) / 10 AS avg_confidence, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM ({LOG_SQL}) WHERE outcome <> 'elaborated' GROUP BY outcome")
def debate_stats(spark, sf_dir):
    return audit.debate_stats(audit_log(spark, sf_dir))


@query(
    "redebate_arc",
    f"""WITH l AS (SELECT * FROM ({LOG_SQL})), f AS (SELECT term, min((ts, event_id)) AS a, min(ts) AS first_undecided FROM l WHERE outcome = 'undecided' GROUP BY term),
    g AS (SELECT term, max((ts, event_id)) AS z FROM l WHERE outcome = 'accepted' GROUP BY term) SELECT term, first_undecided, coalesce(z > a, false) AS resolved FROM f LEFT JOIN g USING (term)""",
)
def redebate_arc(spark, sf_dir):
    return audit.redebate_arc(audit_log(spark, sf_dir))


PROPOSALS_SQL = "SELECT o_orderkey AS id, (o_orderkey * 7 % 101) / 10.0 AS confidence, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'rolled_back' END AS decision, o_custkey % 10 = 0 AS delegated FROM orders"


def proposals(spark, sf_dir):
    decision = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("rolled_back")
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7 % 101 / 10).alias("confidence"), decision.alias("decision"), (F.col("o_custkey") % 10 == 0).alias("delegated"))


@query(
    "calibration_bands",
    f"SELECT CAST(least(3, floor(confidence / 2.5)) AS INTEGER) AS band, count(*) AS decided, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'rolled_back') AS rolled_back FROM ({PROPOSALS_SQL}) WHERE NOT delegated GROUP BY 1",
)
def calibration_bands(spark, sf_dir):
    return audit.calibration_bands(proposals(spark, sf_dir))


@query(
    "action_routing",
    f"SELECT id, CASE WHEN id % 11 = 0 THEN 'invalid' WHEN decision = 'rolled_back' THEN 'pending_review' WHEN confidence < CASE WHEN id % 3 = 0 THEN 8.5 ELSE 8.0 END THEN 'pending_review' ELSE 'applied' END AS route FROM ({PROPOSALS_SQL})",
)
def action_routing(spark, sf_dir):
    """Invalid, then destructive, then the threshold: 8.5 where the child has another parent, else 8."""
    least = F.when(F.col("id") % 3 == 0, 8.5).otherwise(8.0)
    route = F.when(F.col("id") % 11 == 0, "invalid").when((F.col("decision") == "rolled_back") | (F.col("confidence") < least), "pending_review").otherwise("applied")
    return proposals(spark, sf_dir).select("id", route.alias("route"))


QUEUE_SQL = "SELECT o_orderkey AS id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'conflict' WHEN '2' THEN 'moderator_block' WHEN '3' THEN 'below_threshold' WHEN '4' THEN 'iteration_cap' ELSE 'proposed_term' END AS reason, o_orderkey % 5 AS escalation, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 101) / 10.0 END AS last_confidence, o_orderdate AS created_at FROM orders"
REVIEW_SQL = "CASE WHEN reason IN ('conflict', 'moderator_block') THEN true WHEN reason = 'proposed_term' THEN false WHEN escalation < 2 THEN false WHEN last_confidence IS NULL THEN true ELSE last_confidence < 8 END"


def queue(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    reason = F.when(first == "1", "conflict").when(first == "2", "moderator_block").when(first == "3", "below_threshold").when(first == "4", "iteration_cap").otherwise("proposed_term")
    last = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 101 / 10)
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), reason.alias("reason"), (F.col("o_orderkey") % 5).alias("escalation"), last.alias("last_confidence"), F.col("o_orderdate").alias("created_at"))


@query("queue_health", f"SELECT reason, count(*) AS size, count(*) FILTER (escalation >= 3) AS at_max, round((epoch(TIMESTAMP '2002-01-01') - epoch(min(created_at))) / 86400, 1) AS oldest_days, round(avg(last_confidence), 6) AS mean_confidence FROM ({QUEUE_SQL}) GROUP BY reason")
def queue_health(spark, sf_dir):
    return audit.queue_health(queue(spark, sf_dir), "2002-01-01")


@query("review_gate", f"SELECT id, reason, {REVIEW_SQL} AS needs_review FROM ({QUEUE_SQL})")
def review_gate(spark, sf_dir):
    return queue(spark, sf_dir).select("id", "reason", audit.needs_review().alias("needs_review"))


@query("review_gate_counts", f"SELECT count(*) FILTER ({REVIEW_SQL}) AS awaiting, count(*) FILTER (NOT ({REVIEW_SQL})) AS still_retrying FROM ({QUEUE_SQL})")
def review_gate_counts(spark, sf_dir):
    return queue(spark, sf_dir).agg(F.count_if(audit.needs_review()).alias("awaiting"), F.count_if(~audit.needs_review()).alias("still_retrying"))


# hierarchy and references ------------------------------------------------------------------------------------------

TREE_SQL = "SELECT 'R' || r_regionkey AS label, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer"


def tree(spark, sf_dir):
    return graph.tree_of(spark, *(t(spark, sf_dir, n) for n in ("region", "nation", "customer")))


@query("entry_path", f"WITH RECURSIVE n AS ({TREE_SQL}), p(label, up, path) AS (SELECT label, parent, '' FROM n UNION ALL SELECT p.label, n.parent, '/' || n.label || p.path FROM p JOIN n ON n.label = p.up) SELECT label, path FROM p WHERE up IS NULL")
def entry_path(spark, sf_dir):
    return graph.ancestor_paths(tree(spark, sf_dir)).select("label", F.array_join(F.transform("path", lambda x: F.concat(F.lit("/"), x)), "").alias("path"))


@query("subtree_depth", f"WITH RECURSIVE n AS ({TREE_SQL}), p(root, label, depth) AS (SELECT parent, label, 1 FROM n WHERE parent IS NOT NULL UNION ALL SELECT p.root, n.label, depth + 1 FROM p JOIN n ON n.parent = p.label) SELECT root, CAST(depth AS INTEGER) AS depth, count(*) AS nodes FROM p GROUP BY root, depth")
def subtree_depth(spark, sf_dir):
    paths = graph.ancestor_paths(tree(spark, sf_dir))
    own = paths.select("label", F.size("path").alias("n"), F.posexplode("path").alias("pos", "root"))
    return own.groupBy("root", (F.col("n") - F.col("pos")).cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("nodes"))


@query("children_list", f"WITH n AS ({TREE_SQL}) SELECT n.label, coalesce(string_agg(c.label, ',' ORDER BY c.label), '') AS children FROM n LEFT JOIN n c ON c.parent = n.label GROUP BY n.label")
def children_list(spark, sf_dir):
    nodes = tree(spark, sf_dir)
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("label")).agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("children"))
    return nodes.select("label").join(kids, "label", "left").select("label", F.coalesce("children", F.lit("")).alias("children"))


EDGES_SQL = "SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 10 < 9 UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 10 < 8"
CYCLE_SQL = f"{EDGES_SQL} UNION SELECT p_partkey, p_partkey - 9 FROM part WHERE p_partkey % 10 = 9 AND p_partkey % 100 < 50"


def references(spark, sf_dir, cycles=False):
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    out = part.where("src % 10 < 9").withColumn("dst", F.col("src") + 1).union(part.where("src % 10 < 8").withColumn("dst", F.col("src") + 2))
    return out.union(part.where("src % 10 = 9 and src % 100 < 50").withColumn("dst", F.col("src") - 9)) if cycles else out


@query("reference_closure", f"WITH RECURSIVE e AS ({EDGES_SQL}), c(src, dst, d) AS (SELECT src, dst, 1 FROM e UNION SELECT c.src, e.dst, d + 1 FROM c JOIN e ON e.src = c.dst) SELECT src, dst, CAST(min(d) AS INTEGER) AS distance FROM c GROUP BY src, dst")
def reference_closure(spark, sf_dir):
    return graph.closure(references(spark, sf_dir)).select("src", "dst", F.col("distance").cast("int").alias("distance"))


@query("cycle_check", f"WITH RECURSIVE e AS ({CYCLE_SQL}), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) SELECT src AS node FROM c WHERE src = dst")
def cycle_check(spark, sf_dir):
    return graph.on_cycle(references(spark, sf_dir, cycles=True))


@query("stale_cascade", f"WITH RECURSIVE e AS ({CYCLE_SQL}), c(node) AS (SELECT src FROM e WHERE dst % 25 = 7 UNION SELECT e.src FROM c JOIN e ON e.dst = c.node) SELECT node FROM c")
def stale_cascade(spark, sf_dir):
    edges = references(spark, sf_dir, cycles=True)
    changed = edges.where("dst % 25 = 7").select(F.col("dst").alias("node"))
    return graph.stale_cascade(edges, changed).select("node")


@query("gap_label", "SELECT r AS region, CAST(min(k) AS BIGINT) AS label FROM (SELECT r_regionkey AS r, unnest(range(1, 1000)) AS k FROM region) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r AND n_nationkey = k) GROUP BY r")
def gap_label(spark, sf_dir):
    """The smallest positive number that no nation of the region uses."""
    free = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.explode(F.sequence(F.lit(1), F.lit(999))).alias("label"))
    used = t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("label"))
    return free.join(used, ["region", "label"], "left_anti").groupBy("region").agg(F.min("label").cast("long").alias("label"))


# search ------------------------------------------------------------------------------------------------------------


@query(
    "search_score",
    "SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN list_contains(string_split(q, ' '), 'p' || p_partkey) THEN 30 ELSE 0 END + CASE WHEN strpos(' ' || q || ' ', ' ' || lower(p_name) || ' ') > 0 THEN 20 ELSE 0 END + CASE WHEN list_has_any(string_split(q, ' '), string_split(lower(p_type), ' ')) THEN 15 ELSE 0 END AS score FROM part, (SELECT lower(string_agg(p_name, ' ' ORDER BY p_partkey)) || ' p7 standard' AS q FROM part WHERE p_partkey < 4)) WHERE score > 0 ORDER BY score DESC, p_partkey DESC LIMIT 20",
)
def search_score(spark, sf_dir):
    """Label 30, name 20, alias 15; no hit is no row; the 20 best, ties by label, both descending."""
    part = t(spark, sf_dir, "part")
    asked = " ".join(r["p_name"] for r in part.where("p_partkey < 4").orderBy("p_partkey").select("p_name").collect()).lower() + " p7 standard"
    q = F.lit(asked)
    score = (
        F.when(F.array_contains(F.split(q, " "), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))), 30).otherwise(0)
        + F.when(F.instr(F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), F.lower("p_name"), F.lit(" "))) > 0, 20).otherwise(0)
        + F.when(F.arrays_overlap(F.split(q, " "), F.split(F.lower("p_type"), " ")), 15).otherwise(0)
    )
    return part.select("p_partkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("p_partkey")).limit(20)


@query("match_kind", "SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 'label' WHEN lower(p_name) = (SELECT lower(p_name) FROM part ORDER BY p_partkey LIMIT 1) THEN 'exact' WHEN lower(p_type) = (SELECT lower(p_type) FROM part ORDER BY p_partkey LIMIT 1) THEN 'alias' WHEN p_size > 40 THEN 'text' ELSE 'partial' END AS kind FROM part")
def match_kind(spark, sf_dir):
    """The strongest of label, exact, alias, text and partial."""
    part = t(spark, sf_dir, "part")
    asked = part.orderBy("p_partkey").first()
    kind = F.when(F.col("p_partkey") % 50 == 7, "label").when(F.lower("p_name") == asked["p_name"].lower(), "exact").when(F.lower("p_type") == asked["p_type"].lower(), "alias").when(F.col("p_size") > 40, "text").otherwise("partial")
    return part.select("p_partkey", kind.alias("kind"))


TERMS_SQL = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents WHERE source = '%s'"


def terms(spark, sf_dir, source):
    return t(spark, sf_dir, "documents").where(F.col("source") == source).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term")).distinct()


@query("term_correspondence", f"SELECT term FROM ({TERMS_SQL % 'src0'}) JOIN ({TERMS_SQL % 'src1'}) USING (term)")
def term_correspondence(spark, sf_dir):
    return terms(spark, sf_dir, "src0").join(terms(spark, sf_dir, "src1"), "term")


@query("compare_documents", f"SELECT side, count(*) AS terms FROM (SELECT CASE WHEN a.term IS NULL THEN 'right' WHEN b.term IS NULL THEN 'left' ELSE 'shared' END AS side FROM ({TERMS_SQL % 'src0'}) a FULL JOIN ({TERMS_SQL % 'src1'}) b ON a.term = b.term) GROUP BY side")
def compare_documents(spark, sf_dir):
    a, b = (terms(spark, sf_dir, s).withColumn(c, F.lit(True)) for s, c in (("src0", "l"), ("src1", "r")))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("shared")
    return a.join(b, "term", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("terms"))


@query("known_term_guard", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark) SELECT doc_id, count(*) FILTER (term IN (SELECT term FROM k)) AS known, count(*) FILTER (term NOT IN (SELECT term FROM k)) AS unknown FROM w GROUP BY doc_id")
def known_term_guard(spark, sf_dir):
    found = lambda df, *k: df.select(*k, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term")).distinct()
    known = found(t(spark, sf_dir, "benchmark")).withColumn("known", F.lit(True))
    own = found(t(spark, sf_dir, "documents"), "doc_id").join(known, "term", "left")
    return own.groupBy("doc_id").agg(F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"))


@query(
    "vector_shortlist",
    "SELECT q, vec_id, rank FROM (SELECT a.vec_id AS q, b.vec_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 20 = 0) WHERE rank <= 5",
)
def vector_shortlist(spark, sf_dir):
    """The five nearest by cosine of another language (label), for every vector whose id is divisible by 20."""
    stored = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("language"), F.lit("m").alias("model"), "embedding")
    return vectors.shortlist(stored.where("id % 20 = 0"), stored, 5).select(F.col("q"), F.col("id").alias("vec_id"), "rank")


@query("vector_current", "SELECT vec_id, label % 2 = 0 AND vec_id % 3 <> 0 AS current FROM embeddings")
def vector_current(spark, sf_dir):
    """Whether a stored vector has the model and source hash that are wanted now."""
    now = t(spark, sf_dir, "embeddings").select("vec_id", F.lit("m0").alias("model"), F.md5(F.col("vec_id").cast("string")).alias("source_hash"))
    stored = t(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), F.md5((F.col("vec_id") + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)).cast("string")).alias("source_hash"))
    current = stored.join(now, ["vec_id", "model", "source_hash"], "left_semi").select("vec_id", F.lit(True).alias("current"))
    return stored.select("vec_id").join(current, "vec_id", "left").select("vec_id", F.coalesce("current", F.lit(False)).alias("current"))


# consensus ---------------------------------------------------------------------------------------------------------

VOTES_SQL = "SELECT key, pass, relation, confidence FROM (SELECT l_orderkey AS key, l_linenumber AS pass, CASE l_returnflag WHEN 'A' THEN 'equivalent' WHEN 'N' THEN 'none' ELSE 'narrower_than' END AS relation, l_quantity % 11 AS confidence FROM lineitem) QUALIFY row_number() OVER (PARTITION BY key, pass ORDER BY confidence DESC, relation) = 1"


def lineitem_votes(spark, sf_dir):
    relation = F.when(F.col("l_returnflag") == "A", "equivalent").when(F.col("l_returnflag") == "N", "none").otherwise("narrower_than")
    return votes.one_a_pass(t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("pass"), relation.alias("relation"), (F.col("l_quantity") % 11).alias("confidence")))


@query("hierarchy_consensus", f"WITH v AS ({VOTES_SQL}) SELECT key, relation, min(confidence) AS confidence FROM v GROUP BY key, relation HAVING count(DISTINCT pass) = (SELECT count(DISTINCT pass) FROM v w WHERE w.key = v.key)")
def hierarchy_consensus(spark, sf_dir):
    return votes.unanimous(lineitem_votes(spark, sf_dir))


@query(
    "mapping_majority",
    f"""WITH v AS ({VOTES_SQL}), s AS (SELECT key, count(*) AS n, min(confidence) AS least, median(confidence) FILTER (relation = 'none') AS nm, median(confidence) FILTER (relation <> 'none') AS tm FROM v GROUP BY key),
    m AS (SELECT key, relation, count(*) AS c FROM v GROUP BY key, relation), w AS (SELECT m.key, relation FROM m JOIN s USING (key) WHERE c * 2 > n)
    SELECT s.key, CASE WHEN relation IS NULL THEN 'unresolved' WHEN relation = 'none' THEN 'rejected' WHEN tm >= 8 THEN 'accepted' ELSE 'unresolved' END AS outcome, relation, CASE WHEN relation IS NULL THEN least WHEN relation = 'none' THEN nm ELSE tm END AS confidence FROM s LEFT JOIN w ON w.key = s.key""",
)
def mapping_majority(spark, sf_dir):
    return votes.majority(lineitem_votes(spark, sf_dir))


@query("intent_unanimity", f"WITH v AS ({VOTES_SQL}) SELECT key, CASE WHEN count(DISTINCT relation) > 1 THEN 'no_unanimous_tags' WHEN min(confidence) >= 8 THEN 'stored' ELSE 'below_threshold' END AS outcome, min(confidence) AS confidence FROM v GROUP BY key")
def intent_unanimity(spark, sf_dir):
    outcome = F.when(F.count_distinct("relation") > 1, "no_unanimous_tags").when(F.min("confidence") >= 8, "stored").otherwise("below_threshold")
    return lineitem_votes(spark, sf_dir).groupBy("key").agg(outcome.alias("outcome"), F.min("confidence").alias("confidence"))


#: Opinions and terms by order: relation, confidence, faithfulness and wording from the order key.
OPINIONS_SQL = "SELECT o_orderkey AS id, ['critic', 'explorer'][a + 1] AS agent, ['challenge', 'irrelevant', 'discriminate', 'clarify', 'enrich', 'corroborate'][CAST((o_orderkey * (a + 3) // 7) % 6 + 1 AS INTEGER)] AS relation, (o_orderkey * (a + 5) % 101) / 10.0 AS confidence, o_orderkey % (13 + a) <> 0 AS faithful, CASE WHEN o_orderkey % (5 + a * 20) = 0 THEN 'other' ELSE 'same' END AS definition FROM orders, range(2) r(a)"
TERM_SQL = "SELECT o_orderkey AS id, o_orderkey % 19 = 0 AS no_text, (o_orderkey * 3 % 101) / 20.0 AS corpus, o_orderkey % 8 = 0 AS copied FROM orders"


@query(
    "grounding_decision",
    f"""WITH o AS (SELECT id, min(list_position(['challenge', 'irrelevant', 'discriminate', 'clarify', 'enrich', 'corroborate'], relation)) AS rank, bool_or(relation = 'irrelevant') AS dismissed, bool_and(faithful) AS faithful, min(confidence) AS least, count(DISTINCT definition) AS wordings FROM ({OPINIONS_SQL}) GROUP BY id),
    d AS (SELECT id, rank, least, corpus, CASE WHEN rank = 1 THEN 'challenged' WHEN no_text THEN 'no_corpus_definition' WHEN NOT faithful OR dismissed THEN 'unchanged' WHEN wordings > 1 THEN 'not_ratified' WHEN copied THEN 'copied' WHEN least < corpus THEN 'below_corpus' ELSE 'adopted' END AS outcome FROM ({TERM_SQL}) JOIN o USING (id))
    SELECT id, ['challenge', 'irrelevant', 'discriminate', 'clarify', 'enrich', 'corroborate'][rank] AS relation, outcome, CASE outcome WHEN 'challenged' THEN least(corpus, least) WHEN 'adopted' THEN least ELSE corpus END AS confidence FROM d""",
)
def grounding_decision(spark, sf_dir):
    k = F.col("id")
    ids = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    a = F.col("a")
    relation = F.element_at(F.array(*map(F.lit, grounding.RELATIONS)), (F.floor(k * (a + 3) / 7) % 6 + 1).cast("int"))
    opinions = ids.withColumn("a", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "id",
        F.when(a == 0, "critic").otherwise("explorer").alias("agent"),
        relation.alias("relation"),
        (k * (a + 5) % 101 / 10).alias("confidence"),
        (k % (13 + a) != 0).alias("faithful"),
        F.when(k % (5 + a * 20) == 0, "other").otherwise("same").alias("definition"),
    )
    terms = ids.select("id", F.when(k % 19 != 0, "text").alias("corpus_definition"), (k * 3 % 101 / 20).alias("corpus_confidence"), (k % 8 == 0).alias("copied"))
    return grounding.decide_grounding(opinions, terms)


@query("embedding_backfill")
def embedding_backfill(spark, sf_dir):
    """Parts as entries, a third of them current; the backend is a stand-in that counts letters."""
    part = t(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("label"), F.concat_ws(": ", "p_name", "p_type").alias("text"), F.col("p_type").alias("fallback"), (F.col("p_partkey") % 3 == 0).alias("current"))
    stored = part.where("current").select("label", F.lit("letters").alias("model"), F.sha2("text", 256).alias("source_hash"))
    return backfill.backfill(part.drop("current"), stored, "letters", _letters)


def _letters(texts: list[str]) -> list[list[float] | None]:
    return [[float(text.lower().count(c)) for c in "aeiou"] for text in texts]


# labels and references -----------------------------------------------------------------------------------------------

LABELS_SQL = "SELECT p_partkey, 'MPL-' || lpad(CAST(p_partkey % 999 + 1 AS VARCHAR), 3, '0') AS top, lpad(CAST(p_size AS VARCHAR), 3, '0') AS child, CASE WHEN p_partkey % 7 = 0 THEN 'a' END AS letter FROM part"


def part_labels(spark, sf_dir):
    part, k = t(spark, sf_dir, "part"), F.col("p_partkey")
    return part.select("p_partkey", L.formed(F.array((k % 999 + 1).cast("int"), F.col("p_size")), F.when(k % 7 == 0, "a")).alias("label"))


@query("label_parts", f"SELECT p_partkey, top || '.' || child || coalesce(letter, '') AS label, CASE WHEN letter IS NULL THEN top ELSE top || '.' || child END AS parent, CAST(2 AS INTEGER) AS depth FROM ({LABELS_SQL})")
def label_parts(spark, sf_dir):
    label = F.col("label")
    return part_labels(spark, sf_dir).select("p_partkey", "label", L.parent(label).alias("parent"), L.depth(label).alias("depth"))


@query(
    "next_child_label",
    f"""WITH l AS (SELECT DISTINCT top, CAST(child AS INTEGER) AS n FROM ({LABELS_SQL}) WHERE letter IS NULL), p AS (SELECT DISTINCT top FROM ({LABELS_SQL})),
    c AS (SELECT top, 1 AS n FROM p UNION SELECT top, n + 1 FROM l) SELECT top AS parent, top || '.' || lpad(CAST(min(n) AS VARCHAR), 3, '0') AS label FROM c ANTI JOIN l USING (top, n) GROUP BY top""",
)
def next_child_label(spark, sf_dir):
    have = part_labels(spark, sf_dir).select("label")
    base = L.segments(F.col("label"))
    return next_labels.next_child(have.select(L.formed(F.slice(base, 1, 1)).alias("parent")).distinct(), have)


TERM_INDEX_SQL = "SELECT term, 'B' || min(item_id) AS target FROM (SELECT regexp_extract(lower(text), '([a-z]{5,} [a-z]{4,})', 1) AS term, item_id FROM benchmark) WHERE term <> '' GROUP BY term"


@query("semantic_references", rf"SELECT doc_id, target FROM documents, ({TERM_INDEX_SQL}) WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])') GROUP BY doc_id, target")
def semantic_references(spark, sf_dir):
    """Which documents use a benchmark item's first pair of long words as a term."""
    found = t(spark, sf_dir, "benchmark").select(F.regexp_extract(F.lower("text"), "([a-z]{5,} [a-z]{4,})", 1).alias("term"), "item_id").where("term <> ''")
    index = found.groupBy("term").agg(F.concat(F.lit("B"), F.min("item_id").cast("string")).alias("target"))
    return refs.semantic_references(t(spark, sf_dir, "documents").select("doc_id", "text"), index, "doc_id").distinct()


@query(
    "search_terms",
    r"""WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '\w+')) AS n, list_distinct(regexp_extract_all(lower(p_type), '\w+')) AS a, p_name, p_type FROM part),
    s AS (SELECT 'P' || p_partkey AS label, p_name AS canonical_term, CASE WHEN 'p' || p_partkey IN ('p7', 'p11') THEN 30 ELSE 0 END + CASE WHEN length(p_name) >= 4 AND strpos(' p7 p11 standard ', ' ' || lower(p_name) || ' ') > 0 THEN 20 ELSE 0 END
      + CASE WHEN length(p_type) >= 4 AND strpos(' p7 p11 standard ', ' ' || lower(p_type) || ' ') > 0 THEN 15 ELSE 0 END + 10 * (10 * len(list_intersect(n, ['p7', 'p11', 'standard'])) + 5 * len(list_intersect(a, ['p7', 'p11', 'standard']))) AS score, list_has_any(n || a, ['p7', 'p11', 'standard']) AS via,
      'p' || p_partkey IN ('p7', 'p11') AS own, lower(p_name) IN ('p7', 'p11', 'standard') AS exact, lower(p_type) IN ('p7', 'p11', 'standard') AS alias FROM w)
    SELECT label, canonical_term, CAST(score AS INTEGER) AS score, CASE WHEN own THEN 'label' WHEN exact THEN 'exact' WHEN alias THEN 'alias' WHEN via THEN 'text' ELSE 'partial' END AS kind FROM s WHERE score > 0 ORDER BY s.score DESC, label DESC LIMIT 20""",
)
def search_terms(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    entries = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("label"), F.col("p_name").alias("canonical_term"), F.array("p_type").alias("aliases"), F.array().cast("array<string>").alias("texts"), F.lit("en").alias("language"))
    return search.search_terms(entries, ["P7", "P11", "standard"])


# replies and actions -------------------------------------------------------------------------------------------------


@query(
    "reply_opinions",
    """SELECT event_id, CASE WHEN shape < 2 THEN event_type END AS definition, CASE WHEN shape < 2 THEN props END AS explanation, CASE WHEN shape < 2 THEN greatest(0.0, least(10.0, value)) END AS confidence,
    CASE WHEN shape = 1 THEN 'user ' || user_id END AS context_name, CASE WHEN shape > 1 THEN 'no JSON object' END AS error FROM (SELECT *, event_id % 4 AS shape FROM events)""",
)
def reply_opinions(spark, sf_dir):
    """Replies in prose, in a fence, without an object and broken off; every event is one."""
    shape = F.col("event_id") % 4
    frame = F.when(shape == 1, F.concat(F.lit("'user "), F.col("user_id").cast("string"), F.lit("'"))).otherwise("None")
    body = F.to_json(F.struct(F.col("event_type").alias("definition"), F.lit("").alias("critique"), F.col("props").alias("rationale"), F.col("value").alias("confidence"), frame.alias("context_name")))
    reply = F.when(shape == 0, F.concat(F.lit("Here it is: "), body, F.lit(" So far."))).when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(shape == 2, F.col("props").substr(2, 3)).otherwise(F.expr("left(body, length(body) - 1)"))
    read = t(spark, sf_dir, "events").withColumn("body", body).select("event_id", replies.opinion(reply).alias("o"))
    return read.select("event_id", "o.definition", "o.explanation", "o.confidence", "o.context_name", "o.error")


@query(
    "action_dispatch",
    """WITH a AS (SELECT c_custkey AS seq, 'C' || c_custkey AS label, CASE WHEN c_nationkey % 2 = 1 THEN 'MPL-' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 3, '0') END AS had, c_custkey % 30 + 1 AS k, 'MPL-' || lpad(CAST(c_custkey % 30 + 1 AS VARCHAR), 3, '0') AS asked, (c_custkey % 101) / 10.0 AS confidence FROM customer),
    r AS (SELECT *, CASE WHEN k > 25 THEN 'parent label ' || asked || ' does not exist' WHEN had = asked THEN 'child already has this parent' END AS bad, confidence < CASE WHEN had IS NULL THEN 8.0 ELSE 8.5 END AS low FROM a)
    SELECT seq, CASE WHEN bad IS NOT NULL THEN 'invalid' WHEN low THEN 'pending_review' ELSE 'applied' END AS status,
      CASE WHEN bad IS NOT NULL THEN bad WHEN low THEN 'confidence below ' || CASE WHEN had IS NULL THEN 'auto-apply threshold 8.0' ELSE 're-parenting threshold 8.5' END ELSE 'auto-applied' END AS detail,
      had AS previous_parent_label, CASE WHEN bad IS NULL AND NOT low THEN asked ELSE had END AS parent_label FROM r""",
)
def action_dispatch(spark, sf_dir):
    """Every customer is proposed a nation as its parent; some have one, some nations don't exist."""
    label = lambda k: F.format_string("MPL-%03d", k.cast("int"))
    customer, none = t(spark, sf_dir, "customer"), F.lit(None).cast("string")
    own = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    had = F.when(F.col("c_nationkey") % 2 == 1, label(F.col("c_nationkey") + 1))
    nations = t(spark, sf_dir, "nation").select(label(F.col("n_nationkey") + 1).alias("label"), none.alias("parent_label"))
    entries = customer.select(own.alias("label"), had.alias("parent_label")).unionByName(nations)
    entries = entries.select("label", F.col("label").alias("canonical_term"), F.array().cast("array<string>").alias("aliases"), "parent_label", F.lit("en").alias("language"))
    absent = [none.alias(c) for c in ("label", "alias", "keep_label", "drop_label")]
    asked = customer.select(F.col("c_custkey").alias("seq"), F.lit("propose_parent").alias("action_type"), own.alias("child_label"), label(F.col("c_custkey") % 30 + 1).alias("parent_label"), *absent, F.lit(None).cast("array<string>").alias("into"), (F.col("c_custkey") % 101 / 10).alias("confidence"))
    out = actions.dispatch(asked, entries)
    after = out.entries.select(F.col("label").alias("child_label"), "parent_label")
    return out.actions.drop("parent_label").join(after, "child_label").select("seq", "status", "detail", "previous_parent_label", "parent_label")
