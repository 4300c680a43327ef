"""The driver's tables in the roles of the engine's relations, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import table

#: Hierarchy: orders under customers under nations under regions, suppliers under nations; five locations.
EDGES = """e AS (
 SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent, CAST(n_regionkey AS BIGINT) AS location FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_custkey % 5 FROM customer
 UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_suppkey % 5 FROM supplier
 UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, o_orderkey % 5 FROM orders)"""


def edges(spark: SparkSession, d: str, orders: bool = True) -> DataFrame:
    def part(name: str, kind: str, key: str, up: str, upkey: str, loc: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(kind), key).alias("child"), F.concat(F.lit(up), upkey).alias("parent"), F.expr(loc).cast("long").alias("location"))

    out = part("nation", "N", "n_nationkey", "R", "n_regionkey", "n_regionkey").unionAll(part("customer", "C", "c_custkey", "N", "c_nationkey", "c_custkey % 5"))
    out = out.unionAll(part("supplier", "S", "s_suppkey", "N", "s_nationkey", "s_suppkey % 5"))
    return out.unionAll(part("orders", "O", "o_orderkey", "C", "o_custkey", "o_orderkey % 5")) if orders else out


#: Calls: an order calls parts; the opcode is flag and status.
CALLS = "calls AS (SELECT l_partkey AS callee, l_orderkey AS caller, l_returnflag || l_linestatus AS opcode, l_suppkey % 5 AS location FROM lineitem)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("callee"), F.col("l_orderkey").alias("caller"), F.concat("l_returnflag", "l_linestatus").alias("opcode"), (F.col("l_suppkey") % 5).alias("location")
    )


#: Sequences: events of a user in order; k is the operand.
EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.withColumn("n", F.row_number().over(w))


#: Flow graphs: a graph for each user; an edge joins the operands (mod 12) of neighbouring events.
FLOW = f"""{EVENTS}, fl AS (SELECT DISTINCT a.user_id AS g, a.k % 12 AS src, b.k % 12 AS dst FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.n = a.n + 1)"""


def flow(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("n")
    e = events(spark, d).withColumn("k2", F.lead("k").over(w)).where("k2 is not null")
    return e.select(F.col("user_id").alias("g"), (F.col("k") % 12).alias("src"), (F.col("k2") % 12).alias("dst")).distinct()


#: Programs: eight events of a user make a method; signup calls a source, error a cleaner, purchase a sink, others assign.
PROGRAM = f"""{EVENTS}, p AS (SELECT user_id || '_' || ((n - 1) // 8) AS m, (n - 1) % 8 AS n, event_type AS op, 'v' || (k % 4) AS x, 'v' || ((k // 4) % 4) AS y FROM ev)"""


def program(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select(
        F.concat_ws("_", F.col("user_id"), F.floor((F.col("n") - 1) / 8)).alias("m"), ((F.col("n") - 1) % 8).cast("int").alias("n"), F.col("event_type").alias("op"),
        F.concat(F.lit("v"), F.col("k") % 4).alias("x"), F.concat(F.lit("v"), F.floor(F.col("k") / 4) % 4).alias("y"),
    )
