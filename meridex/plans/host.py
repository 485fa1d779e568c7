"""Queries of general relational categories on the star schema (names start with host_), and chunking, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunks
from ..streaming import events as stream
from .registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n():
    return F.count(F.lit(1)).alias("n")


def money(column):
    """Sums of prices in decimals, so that their order doesn't matter."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

# joins: no side is broadcast by hint; Catalyst broadcasts by the sizes that it knows, and AQE by those it measures ------


def join_query(name, how, sql_join, select, columns):
    @query(f"host_join_{name}", f"SELECT {select} FROM orders {sql_join} (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o_custkey = c_custkey")
    def run(spark, sf_dir):
        customers = t(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")  # so that some orders have no customer here
        return t(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), how).select(*columns)


for _name, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("full", "FULL JOIN")):
    join_query(_name, _name, _sql, "o_orderkey, c_custkey, c_mktsegment", ("o_orderkey", "c_custkey", "c_mktsegment"))
for _name, _sql in (("semi", "SEMI JOIN"), ("anti", "ANTI JOIN")):
    join_query(_name, f"left_{_name}", _sql, "o_orderkey, o_custkey", ("o_orderkey", "o_custkey"))


@query(
    "host_join_range",
    """SELECT a.event_id AS error_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
    WHERE a.event_type = 'error' AND b.event_type = 'purchase'""",
)
def host_join_range(spark, sf_dir):
    """Purchases within an hour after an error of the same user: the hour is an equality on hour buckets, then exact."""
    events = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.window("ts", "1 hour").alias("w")).withColumn("hour", F.col("w.start"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("at"), F.explode(F.array("hour", F.col("hour") + F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    later = events.where("event_type = 'purchase'").select("user_id", "hour", "ts", F.col("event_id").alias("next_id"))
    return errors.join(later, ["user_id", "hour"]).where((F.col("ts") > F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL 1 HOUR"))).select("error_id", "next_id")


@query(
    "host_asof",
    """SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def host_asof(spark, sf_dir):
    """The last view before each purchase, in one shuffle: a window over the union of both."""
    events = t(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return events.withColumn("view_id", seen).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "view_id")


# grouping --------------------------------------------------------------------------------------------------------------

FLAGS = f"SELECT l_returnflag, l_linestatus, count(*) AS n, {MONEY.format('l_extendedprice')} AS price FROM lineitem GROUP BY "


@query("host_rollup", FLAGS + "ROLLUP (l_returnflag, l_linestatus)")
def host_rollup(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(n(), money("l_extendedprice").alias("price"))


@query("host_cube", FLAGS + "CUBE (l_returnflag, l_linestatus)")
def host_cube(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(n(), money("l_extendedprice").alias("price"))


@query("host_grouping_sets", FLAGS + "GROUPING SETS ((l_returnflag), (l_linestatus))")
def host_grouping_sets(spark, sf_dir):
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")]]
    return t(spark, sf_dir, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus").agg(n(), money("l_extendedprice").alias("price"))


@query("host_distinct_agg", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def host_distinct_agg(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("host_approx_distinct")
def host_approx_distinct(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


# ordered windows -------------------------------------------------------------------------------------------------------


@query("host_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders")
def host_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("place"))


@query("host_lag", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def host_lag(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"))


@query("host_running", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM orders")
def host_running(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("spent"))


@query("host_topk_per_group", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def host_topk_per_group(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.withColumn("nth", F.row_number().over(w)).where("nth <= 2").drop("nth")


# sets ------------------------------------------------------------------------------------------------------------------


def nations(spark, sf_dir):
    rich = t(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"))
    return rich, t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nation"))


SETS = "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 {} SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"


@query("host_union", SETS.format("UNION"))
def host_union(spark, sf_dir):
    a, b = nations(spark, sf_dir)
    return a.union(b).distinct()


@query("host_intersect", SETS.format("INTERSECT"))
def host_intersect(spark, sf_dir):
    a, b = nations(spark, sf_dir)
    return a.intersect(b)


@query("host_except", SETS.format("EXCEPT"))
def host_except(spark, sf_dir):
    a, b = nations(spark, sf_dir)
    return a.subtract(b)


# events ----------------------------------------------------------------------------------------------------------------


@query("host_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def host_json_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("host_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS starts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def host_tumbling(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(n()).select(F.col("w.start").alias("starts"), "event_type", "n")


@query(
    "host_sliding",
    """SELECT make_timestamp((b - k * 21600) * 1000000) AS starts, count(*) AS n FROM (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS b FROM events), (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1""",
)
def host_sliding(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.window("ts", "24 hours", "6 hours").alias("w")).agg(n()).select(F.col("w.start").alias("starts"), "n")


@query(
    "host_session",
    """WITH l AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS opens FROM events),
    s AS (SELECT user_id, event_id, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM l)
    SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM s GROUP BY user_id, s""",
)
def host_session(spark, sf_dir):
    found = t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return found.agg(F.min("event_id").alias("first_event"), n()).select("user_id", "first_event", "n")


@query("host_stream_dedupe")
def host_stream_dedupe(spark, sf_dir):
    return stream.deduplicated(spark, sf_dir)


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    return chunks.chunk(t(spark, sf_dir, "documents").select("doc_id", "text"))
