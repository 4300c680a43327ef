"""Conditions, matchers, rule binding, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as C
from ..functions import names as N
from ..functions import paths as Pa
from ..operators import code_patterns as CP
from ..operators import hierarchy as H
from ..operators import rules as R
from ..runtime import table
from . import views
from .registry import query

#: Constants: the operand of an event is an int, a bool, a string, null or no constant, by k.
_CONST = f"""{views.EVENTS}, c AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'bool' WHEN 2 THEN 'string' WHEN 3 THEN 'null' ELSE 'none' END AS kind,
 CASE WHEN k % 5 = 0 THEN k - 50 END AS i, CASE WHEN k % 5 = 1 THEN k % 2 = 0 END AS b, CASE WHEN k % 5 = 2 THEN event_type || '-' || k END AS s, k FROM ev)"""


def _consts(spark, d):
    e = views.events(spark, d)
    k = F.col("k")
    kind = F.when(k % 5 == 0, "int").when(k % 5 == 1, "bool").when(k % 5 == 2, "string").when(k % 5 == 3, "null").otherwise("none")
    c = F.struct(kind.alias("kind"), F.when(k % 5 == 0, k - 50).alias("i"), F.when(k % 5 == 1, k % 2 == 0).alias("b"), F.when(k % 5 == 2, F.concat_ws("-", "event_type", k)).alias("s"))
    return e.select("event_id", "event_type", c.alias("c"))


def _where(spark, d, cond):
    rows = _consts(spark, d)
    return rows.where(C.compile(cond, {"c": F.col("c"), "t": F.col("event_type")})).select("event_id")


@query(f"WITH {_CONST} SELECT event_id FROM c WHERE kind <> 'none' AND kind <> 'null'")
def p13_is_constant_not_null(spark, d):
    return _where(spark, d, C.atom("is_constant", "c") & ~C.atom("is_null", "c"))


@query(f"WITH {_CONST} SELECT event_id FROM c WHERE (kind = 'int' AND i = -10) OR (kind = 'bool' AND b) OR (kind = 'int' AND i <> 0) OR (kind = 'string' AND s = 'view-7')")
def p14_constant_equals(spark, d):
    return _where(spark, d, C.atom("const_eq", "c", -10) | C.atom("const_eq", "c", True) | C.atom("const_eq", "c", "view-7"))


@query(f"WITH {_CONST} SELECT event_id FROM c WHERE kind = 'int' AND i < 20 AND i > -20")
def p14_constant_order(spark, d):
    return _where(spark, d, C.atom("const_lt", "c", 20) & C.atom("const_gt", "c", -20))


@query(f"WITH {_CONST} SELECT event_id FROM c WHERE kind = 'string' AND (regexp_full_match(s, 'view-.*') OR regexp_full_match(s, '(signup|error)-[12]7'))")
def p15_f9_constant_matches(spark, d):
    return _where(spark, d, C.atom("const_matches", "c", "view-.*") | C.atom("const_matches", "c", "(signup|error)-[12]7"))


@query(f"WITH {_CONST} SELECT event_id FROM c WHERE NOT (kind = 'int' OR (kind = 'string' AND NOT coalesce(s = 'view-7', false)))")
def p10_p12_condition_tree(spark, d):
    cond = ~(C.atom("type_is", "k", "int") | (C.atom("type_is", "k", "string") & ~C.atom("const_eq", "c", "view-7")))
    rows = _consts(spark, d)
    return rows.where(C.compile(C.nnf(cond), {"c": F.col("c"), "k": F.col("c.kind")})).select("event_id")


@query(f"WITH {_CONST} SELECT event_id FROM c WHERE kind = 'int' AND (i < 0 OR i > 20)")
def p11_r15_simplified_cubes(spark, d):
    a, b, c = C.atom("type_is", "k", "int"), C.atom("const_lt", "c", 0), C.atom("const_gt", "c", 20)
    cubes = C.dnf(C.all_of(a, C.TRUE, C.any_of(b, C.FALSE, C.all_of(a, c))))
    rows = _consts(spark, d)
    cond = C.any_of(*[C.all_of(*sorted(q, key=repr)) for q in cubes])
    return rows.where(C.compile(cond, {"c": F.col("c"), "k": F.col("c.kind")})).select("event_id")


@query(f"WITH {views.EVENTS} SELECT user_id FROM ev GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup' AND k < 5) > 0")
def p18_negated_mark_is_true(spark, d):
    cond = C.assumed_true(C.atom("has_mark", "labels", "young") & ~C.atom("has_mark", "labels", "old"), {"has_mark"})
    labels = views.events(spark, d).groupBy("user_id").agg(F.collect_set(F.when((F.col("event_type") == "signup") & (F.col("k") < 5), "young").when(F.col("k") > 90, "old")).alias("labels"))
    return labels.where(C.compile(cond, {"labels": F.col("labels")})).select("user_id")


@query(f"""WITH {views.EVENTS}, l AS (SELECT user_id, bool_or(event_type = 'signup' AND k < 20) AS a, bool_or(event_type = 'error' AND k > 80) AS b, bool_or(event_type = 'click' AND k = 50) AS c FROM ev GROUP BY 1)
SELECT user_id FROM l WHERE a AND NOT (b OR c)""")
def r12_f11_requires_labels(spark, d):
    e = views.events(spark, d)
    label = F.when((F.col("event_type") == "signup") & (F.col("k") < 20), "A").when((F.col("event_type") == "error") & (F.col("k") > 80), "B").when((F.col("event_type") == "click") & (F.col("k") == 50), "C")
    rows = e.groupBy("user_id").agg(F.collect_set(label).alias("labels"))
    return rows.where(C.compile(C.requires("A and not (B or C)"), {"labels": F.col("labels")})).select("user_id")


_PATTERNS = ("Brand#7", "Brand#1.*", ".*#2", "(Brand#3|Brand#4)", ".*", r"Brand\#5")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, p_partkey FROM part WHERE regexp_full_match(p_brand, '{p}')" for p in _PATTERNS))
def p21_p22_matchers(spark, d):
    p = table(spark, d, "part")
    out = None
    for x in _PATTERNS:
        rows = p.where(N.matches(F.col("p_brand"), x)).select(F.lit(x).alias("pattern"), "p_partkey")
        out = rows if out is None else out.unionAll(rows)
    return out


_RULES = [("r1", "source", "Brand#7", ".*", True), ("r2", "sink", "Brand#1.*", "PROMO", True), ("r3", "cleaner", ".*#2", "S.*", False), ("r4", "source", "(Brand#3|Brand#4)", ".*(M|Y)", True), ("r5", "pass-through", ".*", "LARGE", False)]


@query(" UNION ".join(f"SELECT p_brand AS class, p_type AS method, '{i}' AS rule_id, '{k}' AS kind FROM part WHERE regexp_full_match(p_brand, '{c}') AND regexp_full_match(p_type, '{m}')" for i, k, c, m, _ in _RULES))
def j8_bind_rules(spark, d):
    methods = table(spark, d, "part").select(F.col("p_brand").alias("class"), F.col("p_type").alias("method")).distinct()
    return R.bind(methods, R.rules_frame(spark, _RULES))


@query("""WITH m AS (SELECT 'N' || n_nationkey AS class, 'f' || (n_nationkey % 3) AS method FROM nation UNION SELECT 'R' || r_regionkey, 'f0' FROM region)
SELECT class, method, 'up' AS rule_id, 'source' AS kind FROM m WHERE class = 'R1' AND method = 'f0' UNION SELECT m.class, m.method, 'up', 'source' FROM m JOIN nation ON m.class = 'N' || n_nationkey AND n_regionkey = 1 WHERE m.method = 'f0'
UNION SELECT class, method, 'own', 'sink' FROM m WHERE class = 'R2'""")
def j8_bind_through_supers(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("class"), F.concat(F.lit("f"), F.col("n_nationkey") % 3).alias("method"))
    methods = n.unionAll(table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey"), F.lit("f0")))
    e = views.edges(spark, d, orders=False).where("child like 'N%'")
    above = H.ascend(e, n.select(F.col("class").alias("node")).distinct())
    return R.bind(methods, R.rules_frame(spark, [("up", "source", "R1", "f0", True), ("own", "sink", "R2", ".*", False)]), above)


@query("SELECT 'any' AS rule_id, p_partkey AS method, CAST(unnest(range(p_size % 4)) AS INTEGER) AS arg FROM part")
def j9_any_argument(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("method"), (F.col("p_size") % 4).cast("int").alias("n_params"))
    return R.any_argument(m.select("method", F.lit("any").alias("rule_id")), m)


@query("WITH r AS (SELECT p_partkey AS rule_id, p_size % 3 AS a, p_size % 2 AS b FROM part) SELECT rule_id, f AS \"from\", t AS \"to\" FROM r, (VALUES ('arg0', 0), ('arg1', 1), ('this', 2)) x(f, i), (VALUES ('result', 0), ('this', 1)) y(t, j) WHERE i <= a AND j <= b")
def j10_position_pairs(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.expr("slice(array('arg0', 'arg1', 'this'), 1, p_size % 3 + 1)").alias("froms"), F.expr("slice(array('result', 'this'), 1, p_size % 2 + 1)").alias("tos"))
    return R.position_pairs(r)


@query("SELECT p_partkey FROM part WHERE (p_size % 3 = 1 AND p_type = 'SMALL') OR (p_size % 3 = 2 AND p_type LIKE 'S%')")
def p23_signature_matchers(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("slice(array('int', p_type), 1, p_size % 3)").alias("params"), F.col("p_type").alias("returns"))
    exact = R.signature_matches("params", "returns", ["int"], "SMALL")
    partial = R.signature_matches("params", "returns", None, None, {1: "SMALL"}) | R.signature_matches("params", "returns", None, None, {1: "STANDARD"})
    return p.where(exact | partial).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_size % 3 >= 1 AND p_size % 2 = 0) OR p_size % 3 = 2")
def p24_annotation_conditions(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("slice(array('A', 'B'), 1, p_size % 3)").alias("annotations"), F.expr("sequence(0, p_size % 2)").alias("args"))
    cond = (C.atom("annotated", "annotations", "A") & C.atom("n_args", "args", 1)) | C.atom("annotated", "annotations", "B")
    return p.where(C.compile(cond, {"annotations": F.col("annotations"), "args": F.col("args")})).select("p_partkey")


@query(f"WITH RECURSIVE {views.EDGES}, h AS (SELECT child AS name, parent AS via FROM e WHERE child NOT LIKE 'O%' UNION SELECT h.name, e.parent FROM h JOIN e ON e.child = h.via) SELECT name, via FROM h")
def p25_meta_annotations(spark, d):
    e = views.edges(spark, d, orders=False)
    return R.meta_annotated(e.select(F.col("child").alias("name"), F.col("parent").alias("on")))


@query("""WITH b AS (SELECT 'b' || p_partkey AS rule_id, CASE p_size % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'cleaner' ELSE 'sink' END AS kind FROM part WHERE p_partkey % 2 = 0), c AS (SELECT 'c' || p_partkey AS rule_id, CASE p_size % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'cleaner' ELSE 'sink' END AS kind FROM part WHERE p_partkey % 2 = 1)
SELECT * FROM b WHERE kind <> 'source' UNION SELECT * FROM c WHERE kind <> 'sink'""")
def u8_x7_combine_rules(spark, d):
    kind = F.expr("case p_size % 3 when 0 then 'source' when 1 then 'cleaner' else 'sink' end").alias("kind")
    p = table(spark, d, "part")
    b = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("b"), "p_partkey").alias("rule_id"), kind)
    c = p.where("p_partkey % 2 = 1").select(F.concat(F.lit("c"), "p_partkey").alias("rule_id"), kind)
    return R.combine(b, c, {"source": "OVERRIDE", "cleaner": "EXTEND", "sink": "IGNORE"})


@query("SELECT p_partkey FROM part WHERE p_size % 10 <> 0 AND p_size % 3 < 2 AND (p_size % 4 = 0 OR p_size % 4 = 1 OR p_size % 4 = 2)")
def p30_r14_admitted_rules(spark, d):
    r = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 10 == 0).alias("disabled"), F.expr("element_at(array('ERROR', 'WARNING', 'INFO'), p_size % 3 + 1)").alias("severity"),
                                       F.expr("case p_size % 4 when 0 then null when 1 then array(79) when 2 then array(22, 89) else array(1) end").alias("cwe"))
    return R.admitted(r, ["ERROR", "WARNING"], [79, 89]).select("p_partkey")


@query("SELECT p_partkey, to_base64(unhex(sha256(p_brand || chr(10) || p_type || chr(10) || p_size))) AS fingerprint FROM part")
def f2_fingerprint(spark, d):
    return table(spark, d, "part").select("p_partkey", N.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("fingerprint"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'shop.' || replace(p_brand, '#', '.b') ELSE '' END AS package, p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'shop.' || replace(p_brand, '#', '.b') || '.' || p_type ELSE p_type END AS class, 'm' || p_size AS method FROM part""")
def f3_f4_names(spark, d):
    full = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("shop."), F.regexp_replace("p_brand", "#", ".b"), F.lit("."), "p_type")).otherwise(F.col("p_type"))
    p = table(spark, d, "part").select("p_partkey", F.concat(full, F.lit("#m"), "p_size").alias("f"))
    p = p.select("p_partkey", N.split_function(F.col("f")).alias("f"))
    return p.select("p_partkey", N.package_of(F.col("f.class")).alias("package"), N.simple_name(F.col("f.class")).alias("name"), F.col("f.class"), F.col("f.method"))


@query("SELECT p_partkey, CAST(p_size % 3 AS INTEGER) AS n, p_type AS returns, CASE WHEN p_size % 3 > 0 THEN 'int' END AS first FROM part")
def f5_signatures(spark, d):
    sig = F.concat(F.lit("("), F.array_join(F.expr("slice(array('int', p_brand), 1, p_size % 3)"), ", "), F.lit(") "), "p_type")
    p = table(spark, d, "part").select("p_partkey", N.split_signature(sig).alias("s"))
    return p.select("p_partkey", F.size("s.params").alias("n"), F.col("s.returns"), F.get("s.params", F.lit(0)).alias("first"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS INTEGER) END AS cwe, '/' || p_type || CASE WHEN p_size % 2 = 0 THEN '/' || p_size ELSE '' END AS route, CASE p_size % 3 WHEN 0 THEN 'SAVE' WHEN 1 THEN 'FIND' ELSE 'OTHER' END AS kind FROM part")
def f10_f14_f15_x13_domain(spark, d):
    tag = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("OWASP-"), "p_size")).otherwise(F.concat(F.lit("cwe-"), "p_size", F.lit(": some")))
    method = F.concat(F.expr("element_at(array('saveAll', 'findBy', 'count'), p_size % 3 + 1)"), "p_size")
    return table(spark, d, "part").select("p_partkey", N.cwe(tag).alias("cwe"), N.route(F.concat(F.lit("/"), "p_type", F.lit("/")), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("")).alias("route"), N.repository_kind(method).alias("kind"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed\\s+under') AND NOT regexp_matches(text, 'Apache')")
def r9_text_regex(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.rlike(r"(?i)licensed\s+under") & ~t.rlike("Apache")).select("doc_id")


_PATHS = f"""{views.EVENTS}, p AS (SELECT event_id, list_transform(range(k % 4), lambda i: 'f' || ((k + i) % 3)) AS path, list_transform(range((k // 4) % 3), lambda i: 'f' || ((k + i) % 3)) AS init, 'f' || (k % 5) AS x, k % 7 = 0 AS u FROM ev)"""


def _paths(spark, d):
    k = F.col("k")
    made = lambda n: F.expr(f"transform(slice(array(0, 1, 2, 3), 1, {n}), i -> concat('f', (k + i) % 3))")
    own = F.struct((k % 7 == 0).alias("universe"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), k % 5))).alias("items"))
    return views.events(spark, d).select("event_id", made("k % 4").alias("path"), made("cast(floor(k / 4) % 3 as int)").alias("init"), own.alias("excl"))


@query(f"""WITH {_PATHS}, r AS (SELECT *, path[len(init) + 1:] AS rest FROM p WHERE len(path) >= len(init) AND path[1:len(init)] = init)
SELECT event_id, rest FROM r WHERE len(rest) = 0 OR NOT (u OR rest[1] = x)""")
def j15_f18_p29_summary_delta(spark, d):
    rows = _paths(spark, d).withColumn("rest", Pa.delta(F.col("path"), F.col("init"), F.col("excl")))
    return rows.where("rest is not null").select("event_id", "rest")


@query(f"""WITH {_PATHS}, r AS (SELECT *, path[len(init) + 1:] AS rest FROM p WHERE len(path) >= len(init) AND path[1:len(init)] = init)
SELECT event_id, (['g', 'h'] || rest)[1:3] AS path, CASE WHEN len(rest) > 0 THEN false ELSE u END AS universe, CASE WHEN len(rest) > 0 THEN ['e'] WHEN u THEN [] ELSE list_sort(list_distinct(['e', x])) END AS items FROM r WHERE len(rest) = 0 OR NOT (u OR rest[1] = x)""")
def j15_t22_summary_applied(spark, d):
    got = Pa.applied(F.col("path"), Pa.excluded(["e"]), F.col("init"), F.array(F.lit("g"), F.lit("h")), F.col("excl"), 3)
    return _paths(spark, d).withColumn("r", got).where("r is not null").select("event_id", "r.*")


_CALLS = f"""{views.EVENTS}, c AS (SELECT user_id AS m, n, event_type AS callee, 'v' || (k % 6) AS result, 'v' || ((k // 6) % 6) AS a FROM ev)"""


def _calls(spark, d):
    e = views.events(spark, d)
    return e.select(F.col("user_id").alias("m"), "n", F.col("event_type").alias("callee"), F.concat(F.lit("v"), F.col("k") % 6).alias("result"), F.array(F.concat(F.lit("v"), F.floor(F.col("k") / 6) % 6)).alias("args"))


@query(f"""WITH {_CALLS} SELECT DISTINCT a.m, a.n AS first, c.n AS last, a.result AS x, b.result AS y FROM c a JOIN c b ON b.m = a.m AND b.n = a.n + 1 AND b.callee = 'click' AND b.a = a.result JOIN c ON c.m = a.m AND c.n > b.n AND c.callee = 'purchase' AND c.a = b.result WHERE a.callee = 'signup'""")
def r16_r17_r19_r33_code_pattern(spark, d):
    got = CP.match(_calls(spark, d), CP.parse("$X = signup(...); $Y = click($X); ... purchase($Y);"))
    return got.select("m", "first", "last", F.col("`$X`").alias("x"), F.col("`$Y`").alias("y"))


@query("SELECT p_brand || '#get' || p_type AS callee, 'this' AS src, 'result' AS dst FROM part WHERE p_size % 2 = 0 AND p_brand NOT IN ('Brand#1', 'Brand#2') UNION SELECT p_brand || '#get' || p_type, 'this', 'result[*]' FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND p_brand NOT IN ('Brand#1', 'Brand#2')")
def t15_default_getters(spark, d):
    p = table(spark, d, "part")
    m = p.select(F.col("p_brand").alias("class"), F.concat(F.when(F.col("p_size") % 2 == 0, "get").otherwise("put"), "p_type").alias("name"), F.lit(False).alias("is_static"), F.when(F.col("p_size") % 3 == 0, "int[]").otherwise("int").alias("returns"))
    return R.default_getters(m, spark.createDataFrame([("Brand#1",), ("Brand#2",)], "class string"))


@query("SELECT DISTINCT 'S#' || p_partkey AS callee, 'arg' || i AS src, 'result' AS dst FROM part, range(3) r(i) WHERE p_size % 4 = 1 AND i < p_size % 3")
def t16_f13_concat_passes(spark, d):
    c = table(spark, d, "part").select(F.concat(F.lit("S#"), "p_partkey").alias("callee"), F.when(F.col("p_size") % 4 == 1, "concat").otherwise("trim").alias("name"), (F.col("p_size") % 3).cast("int").alias("n_args"))
    return R.concat_passes(c)


@query(f"""WITH {_CALLS} SELECT DISTINCT a.m, b.n AS last, b.a AS value FROM c a JOIN c b ON a.m = b.m AND b.n > a.n AND b.callee = 'purchase' AND b.a = a.result WHERE a.callee = 'signup' AND regexp_matches(a.result, '^v[0-3]')""")
def r6_r10_constrained_focus(spark, d):
    got = CP.match(_calls(spark, d), CP.parse("$X = signup(...); ... purchase($X);"))
    return CP.focused(CP.constrained(got, "$X", regex="v[0-3]"), "$X")


@query(f"""WITH {views.EVENTS} SELECT user_id AS m, n AS last, CAST(k AS VARCHAR) AS value FROM ev WHERE event_type = 'click' AND k > 40 AND k <= 60""")
def r8_metavariable_comparison(spark, d):
    e = views.events(spark, d).select(F.col("user_id").alias("m"), "n", F.col("event_type").alias("callee"), F.lit(None).cast("string").alias("result"), F.array(F.col("k").cast("string")).alias("args"))
    got = CP.match(e, CP.parse("click($X);"))
    return CP.focused(CP.constrained(CP.constrained(got, comparison="$X > 40"), comparison="$X <= 60"), "$X")


@query(f"""WITH {_CALLS}, r AS (SELECT m, n, result AS value, CASE WHEN callee = 'signup' THEN 2 ELSE 0 END AS what FROM c UNION SELECT m, n, a, 0 FROM c WHERE callee = 'error' UNION SELECT m, n, a, 1 FROM c WHERE callee = 'purchase'),
s AS (SELECT *, last_value(CASE what WHEN 2 THEN 1 WHEN 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY m, value ORDER BY n, CASE WHEN what = 1 THEN 0 ELSE 1 END, what ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marked FROM r)
SELECT DISTINCT m, n, value FROM s WHERE what = 1 AND marked = 1""")
def r11_taint_mode(spark, d):
    return CP.taint_mode(_calls(spark, d), ["$X = signup(...)"], ["purchase($X)"], ["error($X)"])


@query("SELECT p_partkey AS location, 'lib' || i || '.jar' AS entry FROM part, range(5) r(i) WHERE i < p_size % 4")
def s5_manifest_class_path(spark, d):
    from ..sources.classfiles import manifest_class_path

    entries = F.array_join(F.expr("transform(slice(array(0, 1, 2), 1, p_size % 4), i -> concat('lib', i, '.jar'))"), " ")
    text = F.concat(F.lit("Manifest-Version: 1.0\n"), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("Class-Path: "), entries)).otherwise("X: y"), F.lit("\n"))
    return manifest_class_path(table(spark, d, "part").select(F.col("p_partkey").alias("location"), text.alias("text")))


@query("SELECT p_brand AS class, p_type AS method, 'r1' AS rule_id, 'source' AS kind FROM part WHERE p_brand = 'Brand#7' AND p_type = 'PROMO' UNION SELECT p_brand, p_type, 'r2', 'sink' FROM part WHERE p_brand = 'Brand#9'")
def s11_rule_file_bound(spark, d):
    from ..sources.rule_files import load_taint_config

    text = "source: [{id: r1, function: 'Brand#7', taint: [{kind: t, pos: result}]}]\n"
    text = text.replace("'Brand#7'", "{class: 'x', name: PROMO}") + "sink: [{id: r2, function: {class: 'x', name: '*'}, taint: [{kind: t, pos: arg(0)}]}]\n"
    rules, _ = load_taint_config(spark, text)
    # The classes of this table have no package, so the file's class pattern is given here.
    named = rules.withColumns({"how_class": F.lit("eq"), "class": F.when(F.col("rule_id") == "r1", "Brand#7").otherwise("Brand#9")})
    methods = table(spark, d, "part").select(F.col("p_brand").alias("class"), F.col("p_type").alias("method")).distinct()
    return R.bind(methods, named.select("rule_id", "kind", "how_class", "class", "how_method", "method", "overrides"))


@query(f"""WITH {views.EVENTS} SELECT event_id FROM ev WHERE event_type = 'view' AND k % 4 <> 0 AND 'f' || (k % 3) = 'f1'""")
def p16_p17_marks_under_position(spark, d):
    facts = views.events(spark, d).where("event_type = 'view'").select("event_id", F.expr("transform(slice(array(0, 1, 2, 3), 1, k % 4), i -> concat('f', (k + i) % 3))").alias("path"))
    return facts.where(Pa.starts_with(F.col("path"), F.array(F.lit("f1")))).select("event_id")


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def u9_bitmap_count(spark, d):
    ids = table(spark, d, "lineitem").select(F.bitmap_bucket_number("l_partkey").alias("b"), F.bitmap_bit_position("l_partkey").alias("p"))
    return ids.groupBy("b").agg(F.bitmap_count(F.bitmap_construct_agg("p")).alias("c")).agg(F.sum("c").alias("n"))


@query("SELECT p_partkey, list_sort([p_type, 'K' || p_size, '[*]']) AS accessors FROM part")
def o8_accessor_order(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array("p_type", F.concat(F.lit("K"), "p_size"), F.lit("[*]"))).alias("accessors"))
