"""Closures, lookups along hierarchies, usages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import types as T
from ..runtime import table
from . import views
from .registry import query

E = views.EDGES
_DOWN = f"""WITH RECURSIVE {E}, h AS (SELECT parent AS root, child AS node, location, 1 AS depth FROM e WHERE parent IN (SELECT 'R' || r_regionkey FROM region)
 UNION ALL SELECT h.root, e.child, e.location, h.depth + 1 FROM h JOIN e ON e.parent = h.node)"""


def _roots(spark, d):
    return table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("root"))


def _seen(spark):
    return spark.range(3).withColumnRenamed("id", "location")


@query(f"WITH {E} SELECT DISTINCT parent AS root, child AS node FROM e WHERE parent IN (SELECT 'R' || r_regionkey FROM region)")
def h1_j4_direct_children(spark, d):
    return H.children(views.edges(spark, d), _roots(spark, d))


@query(f"{_DOWN} SELECT root, node, min(depth) AS depth FROM h WHERE location < 3 GROUP BY ALL")
def h2_a2_descend_filter_after(spark, d):
    return H.descend(views.edges(spark, d), _roots(spark, d), _seen(spark))


@query(f"""WITH RECURSIVE {E}, v AS (SELECT * FROM e WHERE location < 3), h AS (SELECT parent AS root, child AS node, 1 AS depth FROM v WHERE parent IN (SELECT 'R' || r_regionkey FROM region)
 UNION ALL SELECT h.root, v.child, h.depth + 1 FROM h JOIN v ON v.parent = h.node) SELECT root, node, min(depth) AS depth FROM h GROUP BY ALL""")
def h4_descend_filter_inside(spark, d):
    return H.descend(views.edges(spark, d), _roots(spark, d), _seen(spark), inside=True)


@query(f"WITH RECURSIVE {E}, h AS (SELECT child AS node, 1 AS depth FROM e WHERE parent = 'R1' UNION ALL SELECT e.child, h.depth + 1 FROM h JOIN e ON e.parent = h.node) SELECT node, min(depth) AS depth FROM h GROUP BY node")
def h3_descend_recursive_sql(spark, d):
    views.edges(spark, d).select("child", "parent").createOrReplaceTempView("hierarchy_edges")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return H.descend_sql(spark, "hierarchy_edges", "R1")


@query(f"WITH {E} SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)")
def h5_j5_without_super(spark, d):
    e = views.edges(spark, d)
    return H.without_super(e.select(F.col("parent").alias("node")).distinct(), e)


@query(f"{_DOWN} SELECT root, node FROM h WHERE depth <= 2 UNION SELECT 'R' || r_regionkey, 'R' || r_regionkey FROM region")
def h6_include_own(spark, d):
    r = _roots(spark, d)
    low = H.descend(views.edges(spark, d, orders=False), r).where("depth <= 2").select("root", "node")
    return low.unionAll(r.select("root", F.col("root").alias("node")))


@query(f"""WITH RECURSIVE {E}, h AS (SELECT child AS node, parent AS super, 1 AS depth FROM e WHERE child LIKE 'C%' UNION ALL SELECT h.node, e.parent, h.depth + 1 FROM h JOIN e ON e.child = h.super)
SELECT node, super, depth FROM h""")
def h8_ascend(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node"))
    return H.ascend(views.edges(spark, d, orders=False), c)


#: Methods: the segment of a customer is a name, its nation's and region's names too.
_METHODS = """m AS (SELECT 'C' || c_custkey AS class, 'f' || (c_custkey % 6) AS name, 'x' AS sig, c_custkey % 11 = 0 AS is_static, c_custkey % 13 = 0 AS is_private FROM customer
 UNION ALL SELECT 'N' || n_nationkey, 'f' || (n_nationkey % 6), 'x', n_nationkey % 11 = 10, n_nationkey % 13 = 12 FROM nation
 UNION ALL SELECT 'R' || r_regionkey, 'f' || (r_regionkey % 6), 'x', false, false FROM region)"""


def _methods(spark, d):
    def part(name, kind, key, s, p):
        return table(spark, d, name).select(F.concat(F.lit(kind), key).alias("class"), F.concat(F.lit("f"), F.col(key) % 6).alias("name"), F.lit("x").alias("sig"),
                                            F.expr(s).alias("is_static"), F.expr(p).alias("is_private"), F.lit(False).alias("is_final"), F.lit(False).alias("is_constructor"))

    out = part("customer", "C", "c_custkey", "c_custkey % 11 = 0", "c_custkey % 13 = 0").unionAll(part("nation", "N", "n_nationkey", "n_nationkey % 11 = 10", "n_nationkey % 13 = 12"))
    return out.unionAll(part("region", "R", "r_regionkey", "false", "false"))


@query(f"""WITH RECURSIVE {E}, {_METHODS}, h AS (SELECT parent AS root, child AS node FROM e WHERE child NOT LIKE 'O%' UNION SELECT h.root, e.child FROM h JOIN e ON e.parent = h.node WHERE e.child NOT LIKE 'O%')
SELECT a.class, a.name, a.sig, b.class AS "by" FROM m a JOIN h ON h.root = a.class JOIN m b ON b.class = h.node AND b.name = a.name AND b.sig = a.sig
WHERE NOT a.is_static AND NOT a.is_private AND NOT b.is_private AND NOT b.is_static""")
def h7_overrides(spark, d):
    e = views.edges(spark, d, orders=False)
    below = H.descend(e, e.select(F.col("parent").alias("root")).distinct())
    return H.overrides(below, _methods(spark, d))


@query(f"""WITH RECURSIVE {E}, {_METHODS}, h AS (SELECT child AS node, child AS owner, 0 AS depth FROM e WHERE child LIKE 'C%' UNION ALL SELECT h.node, e.parent, h.depth + 1 FROM h JOIN e ON e.child = h.owner),
r AS (SELECT h.node, m.name, h.owner, h.depth, row_number() OVER (PARTITION BY h.node, m.name ORDER BY h.depth, h.owner) AS r FROM h JOIN m ON m.class = h.owner) SELECT node, name, owner, depth FROM r WHERE r = 1""")
def h9_w8_nearest_declaration(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node"))
    above = H.ascend(views.edges(spark, d, orders=False), c)
    return H.nearest(above, _methods(spark, d).select(F.col("class").alias("owner"), "name"))


@query(f"WITH {views.CALLS} SELECT DISTINCT callee, caller FROM calls JOIN part ON p_partkey = callee WHERE p_brand = 'Brand#7' AND opcode IN ('RF', 'AF') AND location < 3")
def h10_j6_method_usages(spark, d):
    parts = table(spark, d, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("callee"))
    return H.usages(views.calls(spark, d), parts, ["RF", "AF"], _seen(spark))


@query(f"WITH {views.CALLS} SELECT p_brand, CASE WHEN opcode LIKE '%O' THEN 'WRITE' ELSE 'READ' END AS mode, count(DISTINCT caller) AS callers FROM calls JOIN part ON p_partkey = callee GROUP BY ALL")
def h11_field_usages(spark, d):
    c = views.calls(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("callee"), "p_brand"), "callee")
    mode = F.when(F.col("opcode").endswith("O"), "WRITE").otherwise("READ")
    return c.groupBy("p_brand", mode.alias("mode")).agg(F.count_distinct("caller").alias("callers"))


@query("""WITH m AS (SELECT p_brand AS owner, 'm' || p_partkey AS method, p_type AS returns, CASE WHEN p_size % 3 = 0 THEN [] WHEN p_size % 3 = 1 THEN ['int'] ELSE [p_type] END AS params, p_partkey % 2 = 0 AS s, p_partkey % 5 <> 0 AS pub FROM part),
x AS (SELECT returns AS type, method, CASE WHEN s AND len(params) = 0 THEN 7 WHEN s THEN 5 WHEN len(params) = 0 THEN 3 ELSE 0 END AS priority FROM m WHERE pub AND returns = 'SMALL' AND NOT list_contains(params, 'SMALL'))
SELECT * FROM x ORDER BY priority DESC, type, method LIMIT 100""")
def h12_j7_o2_builders(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.concat(F.lit("m"), "p_partkey").alias("method"), F.col("p_type").alias("returns"),
        F.expr("case p_size % 3 when 0 then cast(array() as array<string>) when 1 then array('int') else array(p_type) end").alias("params"), (F.col("p_partkey") % 2 == 0).alias("is_static"), (F.col("p_partkey") % 5 != 0).alias("is_public"))
    wanted = spark.range(1).select(F.lit("SMALL").alias("type"))
    return H.builders(m, wanted, wanted.select(F.col("type").alias("root"), F.col("type").alias("node")).limit(0))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def h28_a1_duplicated_names(spark, d):
    return H.duplicated(table(spark, d, "part"), "p_name")


@query("WITH m AS (SELECT l_orderkey AS class, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS idx, l_partkey AS method FROM lineitem) SELECT class, method FROM m WHERE idx % 2 = 1")
def p32_s17_slice_by_offsets(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("class"), F.row_number().over(w).alias("idx"), F.col("l_partkey").alias("method"))
    packed = m.where("idx % 2 = 1").groupBy("class").agg(F.collect_list("idx").alias("offsets"))
    return H.sliced(packed, m)


@query("SELECT caller, count(*) AS callees FROM (SELECT DISTINCT l_orderkey AS caller, l_partkey AS callee FROM lineitem) GROUP BY 1")
def j12_callees_of_callers(spark, d):
    c = views.calls(spark, d).select("caller", "callee").distinct()
    return c.groupBy("caller").agg(F.count(F.lit(1)).alias("callees"))


@query(f"""WITH RECURSIVE {E}, h AS (SELECT parent AS root, child AS node FROM e WHERE child NOT LIKE 'O%' UNION SELECT h.root, e.child FROM h JOIN e ON e.parent = h.node WHERE e.child NOT LIKE 'O%'),
p AS (SELECT 'C' || c_custkey AS src, 'N' || (c_custkey % 25) AS dst FROM customer UNION ALL SELECT 'int', 'R' || r_regionkey FROM region UNION ALL SELECT 'null', 'N' || n_nationkey FROM nation UNION ALL SELECT * FROM (VALUES ('int', 'long'), ('long', 'int'), ('int', 'java.lang.Integer'), ('C1', 'java.lang.Object'), ('int', 'java.lang.Object'), ('null', 'int')))
SELECT src, dst, src = dst OR (src = 'null' AND dst <> 'int') OR (dst = 'java.lang.Object' AND src <> 'int') OR (src = 'int' AND dst IN ('long', 'java.lang.Integer')) OR EXISTS (SELECT 1 FROM h WHERE h.node = src AND h.root = dst) AS ok FROM p""")
def p27_p28_assignable(spark, d):
    e = views.edges(spark, d, orders=False)
    below = H.descend(e, e.select(F.col("parent").alias("root")).distinct())
    pairs = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), F.col("c_custkey") % 25).alias("dst"))
    pairs = pairs.unionAll(table(spark, d, "region").select(F.lit("int"), F.concat(F.lit("R"), "r_regionkey"))).unionAll(table(spark, d, "nation").select(F.lit("null"), F.concat(F.lit("N"), "n_nationkey")))
    more = [("int", "long"), ("long", "int"), ("int", "java.lang.Integer"), ("C1", "java.lang.Object"), ("int", "java.lang.Object"), ("null", "int")]
    return T.assignable(pairs.unionAll(spark.createDataFrame(more, "src string, dst string")), below)


@query(f"""WITH RECURSIVE {E}, h AS (SELECT parent AS root, child AS node FROM e WHERE child NOT LIKE 'O%' UNION SELECT h.root, e.child FROM h JOIN e ON e.parent = h.node WHERE e.child NOT LIKE 'O%'),
f AS (SELECT c_custkey AS fact, 'C' || c_custkey AS type, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'N' || (c_custkey % 25) END AS st FROM customer UNION ALL SELECT -n_nationkey - 1, 'N' || n_nationkey, 'C' || (n_nationkey + 1) FROM nation)
SELECT fact FROM f WHERE st IS NULL OR type = st OR EXISTS (SELECT 1 FROM h WHERE (h.root = type AND h.node = st) OR (h.root = st AND h.node = type))""")
def p26_type_filter(spark, d):
    e = views.edges(spark, d, orders=False)
    below = H.descend(e, e.select(F.col("parent").alias("root")).distinct())
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("fact"), F.concat(F.lit("C"), "c_custkey").alias("type"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("N"), F.col("c_custkey") % 25)).alias("static"))
    f = f.unionAll(table(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("long"), F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("C"), F.col("n_nationkey") + 1)))
    return T.type_filter(f, below).select("fact")


@query("""WITH o AS (SELECT p_partkey AS class, p_size % 3 || '.' || p_size || '.0' AS version FROM part), m AS (SELECT p_partkey AS target, 'M' || p_partkey AS model FROM part WHERE p_partkey % 2 = 0)
SELECT o.class, m.model FROM o JOIN m ON o.class = m.target WHERE (split_part(version, '.', 1) = '0' AND CAST(split_part(version, '.', 2) AS INTEGER) >= 10) OR (split_part(version, '.', 1) = '1' AND CAST(split_part(version, '.', 2) AS INTEGER) <= 29)
 OR (split_part(version, '.', 1) = '1' AND CAST(split_part(version, '.', 2) AS INTEGER) = 30 AND split_part(version, '.', 3) = '0')""")
def j21_approximation_versions(spark, d):
    p = table(spark, d, "part")
    o = p.select(F.col("p_partkey").alias("class"), F.concat_ws(".", (F.col("p_size") % 3).cast("string"), F.col("p_size").cast("string"), F.lit("0")).alias("version"))
    m = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("target"), F.concat(F.lit("M"), "p_partkey").alias("model"), F.lit("0.10.0").alias("since"), F.lit("1.30.0").alias("until"))
    return T.approximations(o, m)


@query("SELECT p_partkey AS method, CASE WHEN p_size < 10 THEN 'model' ELSE p_name END AS body FROM part")
def x10_substituted_bodies(spark, d):
    p = table(spark, d, "part")
    b = p.select(F.col("p_partkey").alias("method"), F.col("p_name").alias("body"))
    return T.substituted(b, p.where("p_size < 10").select(F.col("p_partkey").alias("method"), F.lit("model").alias("body")))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call, 'T' || (l_partkey % 40) AS class, 'f' || (l_partkey % 3) AS method, l_returnflag = 'A' AS exact FROM lineitem),
o AS (SELECT DISTINCT 'T' || (p_partkey % 40) AS class, 'f' || (p_size % 3) AS method, 'U' || (p_size % 10) AS "by" FROM part), u AS (SELECT 'U' || r_regionkey AS "by" FROM region)
SELECT call, class || '#' || method AS target, 'exact' AS how FROM c WHERE exact UNION
SELECT c.call, x."by" || '#' || c.method, CASE WHEN x."by" IS NULL THEN 'failure' ELSE 'virtual' END FROM c LEFT JOIN (SELECT * FROM o WHERE "by" IN (SELECT "by" FROM u)) x ON c.class = x.class AND c.method = x.method WHERE NOT exact""")
def j11_t14_resolve_calls(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), F.concat(F.lit("T"), F.col("l_partkey") % 40).alias("class"), F.concat(F.lit("f"), F.col("l_partkey") % 3).alias("method"), (F.col("l_returnflag") == "A").alias("exact"))
    o = table(spark, d, "part").select(F.concat(F.lit("T"), F.col("p_partkey") % 40).alias("class"), F.concat(F.lit("f"), F.col("p_size") % 3).alias("method"), F.concat(F.lit("U"), F.col("p_size") % 10).alias("by")).distinct()
    u = table(spark, d, "region").select(F.concat(F.lit("U"), "r_regionkey").alias("unit_class"))
    return T.resolve_calls(c, o, u)


@query(f"""WITH RECURSIVE {E}, h AS (SELECT child AS node, child AS super, 0 AS depth FROM e WHERE child LIKE 'C%' UNION ALL SELECT h.node, e.parent, h.depth + 1 FROM h JOIN e ON e.child = h.super),
p AS (SELECT 'C' || c_custkey AS a, 'C' || (c_custkey % 50 + 1) AS b FROM customer), m AS (SELECT p.a, p.b, x.super AS lub, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.depth + y.depth, x.super) AS r FROM p JOIN h x ON x.node = p.a JOIN h y ON y.node = p.b AND y.super = x.super) SELECT a, b, lub FROM m WHERE r = 1""")
def a13_least_upper_bounds(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("a"), F.concat(F.lit("C"), F.col("c_custkey") % 50 + 1).alias("b"))
    above = H.ascend(views.edges(spark, d, orders=False), c.select(F.col("a").alias("node")))
    return T.least_upper_bounds(c, above)


@query(f"WITH {views.CALLS} SELECT DISTINCT callee, caller FROM calls WHERE opcode IN ('NO')")
def x1_feature_usages(spark, d):
    from ..operators.features import Database, Usages

    db = Database({"calls": views.calls(spark, d)}, [Usages()])
    return db.query("usages", callees=table(spark, d, "part").select(F.col("p_partkey").alias("callee")), opcodes=["NO"])
