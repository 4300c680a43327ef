"""Store algebra: scans, finds, links, set operations, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import has_flag
from ..operators import store
from ..runtime import table
from .registry import query


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 5 IN (0, 1, 3)")
def s7_p8_live_visible(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("is_deleted"), (F.col("o_custkey") % 5).alias("location"))
    seen = spark.range(5).where("id in (0, 1, 3)").withColumnRenamed("id", "location")
    return store.live(o, seen).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 42")
def s8_primary_key(spark, d):
    return store.find(table(spark, d, "part"), "p_partkey", 42).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 25 ORDER BY p_size, p_partkey")
def s9_cursor_from_key(spark, d):
    return store.cursor(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 25)


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 25")
def s10_cursor_one_key(spark, d):
    return store.find(table(spark, d, "part"), "p_size", 25).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#7'")
def p1_find(spark, d):
    return store.find(table(spark, d, "part"), "p_brand", "Brand#7").select("p_partkey")


@query("SELECT 'lt' AS how, p_partkey FROM part WHERE p_size < 10 UNION ALL SELECT 'le', p_partkey FROM part WHERE p_size <= 10 UNION ALL SELECT 'gt', p_partkey FROM part WHERE p_size > 40 UNION ALL SELECT 'ge', p_partkey FROM part WHERE p_size >= 40 UNION ALL SELECT 'eq', p_partkey FROM part WHERE p_size = 25")
def p2_p3_p4_find_by_option(spark, d):
    p = table(spark, d, "part")
    out = None
    for how, v in (("lt", 10), ("le", 10), ("gt", 40), ("ge", 40), ("eq", 25)):
        x = store.find(p, "p_size", v, how).select(F.lit(how).alias("how"), "p_partkey")
        out = x if out is None else out.unionAll(x)
    return out


@query("SELECT p_partkey FROM part WHERE p_partkey BETWEEN 100 AND 900 AND p_partkey % 7 = 3")
def p5_p6_id_range(spark, d):
    ids = spark.range(100, 901).where("id % 7 = 3")
    return table(spark, d, "part").join(ids, F.col("p_partkey") == F.col("id"), "left_semi").select("p_partkey")


@query("SELECT (SELECT count(*) FROM part WHERE p_brand = 'Brand#7') AS size, EXISTS(SELECT 1 FROM part WHERE p_brand = 'Brand#99') AS some, (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#7') AS first")
def p7_size_contains_first(spark, d):
    p = table(spark, d, "part")
    return p.agg(F.count_if(F.col("p_brand") == "Brand#7").alias("size"), F.coalesce(F.bool_or(F.col("p_brand") == "Brand#99"), F.lit(False)).alias("some"), F.min(F.when(F.col("p_brand") == "Brand#7", F.col("p_partkey"))).alias("first"))


@query("WITH x AS (SELECT doc_id, CASE WHEN quality = 1 THEN quality END AS q FROM labels) SELECT doc_id, 'null' AS how FROM x WHERE q IS NULL UNION ALL SELECT doc_id, 'one' FROM x WHERE q = 1")
def p9_eq_or_null(spark, d):
    x = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("quality")).alias("q"))
    return x.where(store.eq_or_null(F.col("q"), None)).select("doc_id", F.lit("null").alias("how")).unionAll(x.where(store.eq_or_null(F.col("q"), 1)).select("doc_id", F.lit("one").alias("how")))


@query("SELECT c_custkey, c_nationkey % 2 = 0 AS even, (c_nationkey & 4) <> 0 AS four FROM customer WHERE c_mktsegment IS NOT NULL")
def p31_f8_projection_flags(spark, d):
    return table(spark, d, "customer").where("c_mktsegment is not null").select("c_custkey", (F.col("c_nationkey") % 2 == 0).alias("even"), has_flag(F.col("c_nationkey"), 4).alias("four"))


def _halves(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_type")
    return store.find(p, "p_size", 30, "lt"), store.find(p, "p_type", "SMALL")


@query("SELECT p_partkey FROM part WHERE p_size < 30 OR p_type = 'SMALL'")
def u1_union(spark, d):
    a, b = _halves(spark, d)
    return store.union(a, b, "p_partkey").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 30 AND p_type = 'SMALL'")
def u2_intersect(spark, d):
    a, b = _halves(spark, d)
    return store.intersect(a, b, "p_partkey").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 30 AND p_type <> 'SMALL'")
def u3_u4_subtract(spark, d):
    a, b = _halves(spark, d)
    return store.subtract(a, b, "p_partkey").select("p_partkey")


@query("SELECT DISTINCT l_partkey AS id FROM lineitem")
def u5_id_set(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()


@query("WITH w AS (SELECT DISTINCT p_type || '!' AS r_name FROM part UNION SELECT r_name FROM region), n AS (SELECT r_name FROM w WHERE r_name NOT IN (SELECT r_name FROM region)) SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY r_name), r_name FROM n")
def u6_find_or_new(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    wanted = table(spark, d, "part").select(F.concat("p_type", F.lit("!")).alias("r_name")).unionAll(r.select("r_name"))
    return store.find_or_new(r, wanted, "r_name", "r_regionkey")


_LINKS = "l AS (SELECT c_custkey AS src, 'nation' AS name, CAST(c_nationkey AS BIGINT) AS dst FROM customer)"


def _links(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.lit("nation").alias("name"), F.col("c_nationkey").cast("long").alias("dst"))


@query(f"WITH {_LINKS} SELECT l.src, n.n_name FROM l JOIN nation n ON l.dst = n.n_nationkey JOIN customer c ON c.c_custkey = l.src WHERE c.c_acctbal < 0")
def j1_links(spark, d):
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return store.linked(poor, _links(spark, d), "nation", nations.withColumnRenamed("n_nationkey", "id")).select("src", "n_name")


@query(f"WITH {_LINKS} SELECT src, name, dst FROM l WHERE dst % 3 <> 0 UNION SELECT src, name, dst + 100 FROM l WHERE dst % 2 = 0")
def j2_add_delete_links(spark, d):
    x = _links(spark, d)
    gone = x.where("dst % 3 = 0")
    return store.add_links(store.delete_links(x, gone), x.where("dst % 2 = 0").withColumn("dst", F.col("dst") + 100))


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS h, c_custkey % 7 = 0 AS g FROM customer WHERE c_custkey % 10 <> 9),
n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || '2' ELSE c_mktsegment END AS h FROM customer WHERE c_custkey % 11 <> 5),
m AS (SELECT coalesce(c.k, n.k) AS k, c.h AS o, c.g, n.h AS w, CASE WHEN n.k IS NULL THEN 'keep' WHEN c.k IS NULL THEN 'insert' WHEN c.h = n.h AND c.g THEN 'undelete' WHEN c.h = n.h THEN 'skip' ELSE 'replace' END AS action FROM c FULL JOIN n ON c.k = n.k)
SELECT k, CASE WHEN action IN ('replace', 'keep') THEN o ELSE w END AS h, CASE WHEN action = 'keep' THEN g ELSE action = 'replace' END AS is_deleted, action FROM m
UNION ALL SELECT k, w, false, 'insert' FROM m WHERE action = 'replace'""")
def s15_upsert_versions(spark, d):
    c = table(spark, d, "customer")
    cur = c.where("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("h"), (F.col("c_custkey") % 7 == 0).alias("is_deleted"))
    new = c.where("c_custkey % 11 <> 5").select(F.col("c_custkey").alias("k"), F.expr("if(c_custkey % 4 = 0, concat(c_mktsegment, '2'), c_mktsegment)").alias("h"))
    return store.upsert(cur, new, ["k"], "h")


@query("""WITH a AS (SELECT s_suppkey AS path, s_nationkey AS u FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_suppkey AS path, CASE WHEN s_suppkey % 4 = 1 THEN -1 ELSE s_nationkey END AS u FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'removed' WHEN a.u = b.u THEN 'same' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def s16_refresh_locations(spark, d):
    s = table(spark, d, "supplier")
    a = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("unique_id"))
    b = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("path"), F.expr("if(s_suppkey % 4 = 1, -1, s_nationkey)").alias("unique_id"))
    return store.refresh_locations(a, b)


@query("SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL")
def s18_j3_interner_round_trip(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    names = store.interned(p, "p_name")
    ids = p.join(names, p["p_name"] == names["name"]).select("p_partkey", F.col("id").alias("name_id"))
    back = names.select(F.col("id").alias("name_id"), F.col("name").alias("p_name"))
    return ids.join(back, "name_id").select("p_partkey", "p_name")


@query("SELECT 'nation' AS type, n_nationkey AS id, 'n_name' AS name, n_name AS value FROM nation UNION ALL SELECT 'nation', n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def s14_schemaless_triples(spark, d):
    return store.as_triples(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey", "nation")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def o1_keyset_page(spark, d):
    return store.find(table(spark, d, "orders"), "o_orderkey", 100, "gt").select("o_orderkey").orderBy("o_orderkey").limit(50)
