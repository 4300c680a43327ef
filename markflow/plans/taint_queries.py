"""Marks along sequences and through programs, patterns over sequences, reports on findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as P
from ..operators import report as Rep
from ..operators import taint as T
from ..operators import windows as W
from ..runtime import table
from . import views
from .registry import query

V = views.EVENTS
_MARK = f"""{V}, s AS (SELECT *, coalesce(last_value(CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS marked FROM ev)"""


def _marked(spark, d):
    return T.straight_line(views.events(spark, d), ["user_id"], ["n"], F.col("event_type") == "signup", F.col("event_type") == "error")


@query(f"WITH {_MARK} SELECT CASE WHEN value > 50 THEN 'error' WHEN value > 10 THEN 'warning' ELSE 'note' END AS level, count(*) AS n, count(DISTINCT k % 10) AS rules FROM s WHERE event_type = 'purchase' AND marked GROUP BY 1")
def flagship_marked_purchases(spark, d):
    hits = _marked(spark, d).where("event_type = 'purchase' and marked")
    level = F.when(F.col("value") > 50, "error").when(F.col("value") > 10, "warning").otherwise("note")
    return Rep.by_level(hits.select(level.alias("level"), (F.col("k") % 10).alias("rule_id")))


@query(f"WITH {_MARK} SELECT event_id, user_id FROM s WHERE event_type = 'purchase' AND marked")
def w4_t1_t9_t10_t11_straight_line(spark, d):
    return _marked(spark, d).where("event_type = 'purchase' and marked").select("event_id", "user_id")


@query(f"WITH {V} SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY n)")
def w1_neighbours(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("n")
    return views.events(spark, d).select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query(f"WITH {V} SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def FROM ev")
def w3_w7_last_definition(spark, d):
    return W.last_before(views.events(spark, d), ["user_id"], ["n"], F.when(F.col("event_type") == "view", F.col("k")), "def").select("event_id", "def")


@query(f"WITH {V} SELECT event_id, sum(k) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS total FROM ev")
def w6_running_sum(spark, d):
    return W.running_sum(views.events(spark, d), ["user_id"], ["n"], F.col("k").cast("long"), "total").select("event_id", "total")


_FACTS = f"""WITH RECURSIVE {views.PROGRAM}, f AS (SELECT m, n + 1 AS n, x AS base FROM p WHERE op = 'signup'
 UNION SELECT f.m, f.n + 1, b.base FROM f JOIN p ON p.m = f.m AND p.n = f.n, LATERAL (SELECT f.base AS base WHERE NOT (p.op = 'error' AND f.base = p.x) AND NOT (p.op IN ('view', 'click', 'signup') AND f.base = p.x AND NOT (p.op IN ('view', 'click') AND p.x = p.y))
   UNION ALL SELECT p.x WHERE p.op IN ('view', 'click') AND f.base = p.y) b)"""


def _program(spark, d):
    p = views.program(spark, d)
    call = F.col("op").isin("signup", "error", "purchase")
    assign = F.col("op").isin("view", "click")
    none = F.lit(None).cast("string")
    inst = p.select("m", "n", F.when(assign, "assign").otherwise("call").alias("op"), F.when(assign | (F.col("op") == "signup"), F.col("x")).alias("lhs"), none.alias("lhs_path"), F.when(assign, F.col("y")).alias("rhs"), none.alias("rhs_path"), F.when(call, F.col("op")).alias("callee"))
    # One more statement ends each method.
    ends = p.groupBy("m").agg((F.max("n") + 1).alias("n")).select("m", "n", F.lit("nop").alias("op"), *[none.alias(c) for c in ("lhs", "lhs_path", "rhs", "rhs_path", "callee")])
    flow = p.select("m", F.col("n").alias("src"), (F.col("n") + 1).alias("dst"))
    args = p.where("op in ('error', 'purchase')").select("m", "n", F.lit("arg0").alias("pos"), F.col("x").alias("base"))
    rules = T.Rules(
        spark.createDataFrame([("signup", "result", "tainted")], "callee string, pos string, mark string"), None,
        spark.createDataFrame([("error", "arg0", "*")], "callee string, pos string, mark string"), spark.createDataFrame([], "callee string, src string, dst string"),
    )
    none_known = spark.createDataFrame([], "callee string")
    return inst.unionAll(ends), flow, args, rules, none_known, p.select("m").distinct()


@query(f"{_FACTS} SELECT DISTINCT f.m, f.n, f.base FROM f WHERE f.n <= (SELECT max(n) + 1 FROM p WHERE p.m = f.m)")
def t17_t18_program_facts(spark, d):
    return T.propagate(*_program(spark, d)).select("m", "n", "base")


@query(f"{_FACTS} SELECT DISTINCT 's1' AS sink_id, f.m, f.n FROM f JOIN p ON p.m = f.m AND p.n = f.n WHERE p.op = 'purchase' AND p.x = f.base")
def t10_a12_program_findings(spark, d):
    program = _program(spark, d)
    sinks = spark.createDataFrame([("s1", "purchase", "arg0", "tainted", 1)], "sink_id string, callee string, pos string, mark string, need int")
    return T.findings(T.propagate(*program), program[0], program[2], sinks)


@query(f"WITH {V}, m AS (SELECT user_id, CASE WHEN event_type = 'signup' THEN 'a' WHEN event_type = 'click' AND k < 10 THEN 'b' END AS mark FROM ev) SELECT user_id FROM m GROUP BY user_id HAVING count(DISTINCT mark) = 2")
def j16_j17_all_marks_needed(spark, d):
    mark = F.when(F.col("event_type") == "signup", "a").when((F.col("event_type") == "click") & (F.col("k") < 10), "b")
    return views.events(spark, d).select("user_id", mark.alias("mark")).groupBy("user_id").agg(F.count_distinct("mark").alias("n")).where("n = 2").select("user_id")


_SYM = ["signup", "view", "click", "purchase", "error"]
_WORD = f"""{V}, w AS (SELECT user_id, (n - 1) // 8 AS part, string_agg(CASE event_type WHEN 'signup' THEN 's' WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE 'e' END, '' ORDER BY n) AS w FROM ev GROUP BY ALL)"""


def _run(spark, d, formula):
    e = views.events(spark, d).withColumn("part", F.floor((F.col("n") - 1) / 8))
    return P.run(e, ["user_id", "part"], ["n"], F.col("event_type"), P.compile_formula(formula, _SYM), _SYM)


@query(f"WITH {_WORD} SELECT user_id, part, regexp_matches(w, 's.*p') AND NOT regexp_matches(w, 'e') AS matched FROM w")
def r1_r3_pattern_not(spark, d):
    return _run(spark, d, ("and", ("pattern", ["signup", "...", "purchase"]), ("not", ("pattern", ["error"]))))


@query(f"WITH {_WORD} SELECT user_id, part, regexp_matches(w, 'vv') OR regexp_matches(w, 'c.*c.*c') AS matched FROM w")
def r2_pattern_either(spark, d):
    return _run(spark, d, ("either", ("pattern", ["view", "view"]), ("pattern", ["click", "...", "click", "...", "click"])))


@query(f"WITH {_WORD} SELECT user_id, part, regexp_matches(w, 's.*vc.*e') AND NOT regexp_matches(w, 'p.*vc.*e') AS matched FROM w")
def r4_r5_r20_r25_inside_not_inside(spark, d):
    inside = ("inside", ["signup", "...", "error"], ["view", "click"])
    outside = ("not", ("inside", ["purchase", "...", "error"], ["view", "click"]))
    return _run(spark, d, ("and", inside, outside))


@query(f"WITH {V}, r AS (SELECT user_id, n AS lo, n + 3 AS hi FROM ev WHERE event_type = 'signup') SELECT event_id FROM ev WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM r WHERE r.user_id = ev.user_id AND ev.n BETWEEN lo AND hi) AND k % 2 = 0")
def r4_r6_range_containment(spark, d):
    e = views.events(spark, d)
    ranges = e.where("event_type = 'signup'").select("user_id", F.col("n").alias("lo"), (F.col("n") + 3).alias("hi"))
    hits = e.where("event_type = 'purchase'").where(F.col("k").cast("string").rlike("[02468]$"))
    return P.inside(hits, ranges, ["user_id"]).select("event_id")


@query(f"WITH {V} SELECT a.event_id AS first, b.event_id AS second FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.n < b.n AND a.k = b.k WHERE a.event_type = 'signup' AND b.event_type = 'purchase'")
def j19_r27_r33_shared_metavariable(spark, d):
    e = views.events(spark, d)
    a = e.where("event_type = 'signup'").select("user_id", "n", "event_id", "k")
    b = e.where("event_type = 'purchase'").select("user_id", "n", "event_id", "k")
    return P.ordered_pairs(a, b, ["user_id"], "n", ["k"]).select(F.col("a_event_id").alias("first"), F.col("b_event_id").alias("second"))


@query(f"WITH {_MARK}, a AS (SELECT DISTINCT user_id, k % 10 AS x FROM s WHERE event_type = 'purchase' AND marked), b AS (SELECT event_id, user_id, k % 10 AS x FROM ev WHERE event_type = 'click') SELECT b.event_id FROM b JOIN a USING (user_id, x)")
def j18_r13_join_mode(spark, d):
    left = _marked(spark, d).where("event_type = 'purchase' and marked").select("user_id", (F.col("k") % 10).alias("x")).distinct()
    right = views.events(spark, d).where("event_type = 'click'").select("event_id", "user_id", (F.col("k") % 10).alias("x"))
    return right.join(left, ["user_id", "x"], "left_semi").select("event_id")


_FIND = "f AS (SELECT doc_id, 'q' || quality || 't' || toxic AS rule_id, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE '' END AS level, source AS file, n_chars % 50 AS line FROM labels JOIN documents USING (doc_id))"


def _findings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    f = table(spark, d, "labels").join(docs, "doc_id")
    return f.select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("rule_id"), F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("").alias("level"), F.col("source").alias("file"), (F.col("n_chars") % 50).alias("line"))


@query(f"WITH {_FIND} SELECT rule_id, count(*) FILTER (level = 'error') AS error, count(*) FILTER (level = 'warning') AS warning, count(*) FILTER (level = '') AS note, count(*) AS total, count(DISTINCT file) AS files FROM f GROUP BY 1")
def a4_a5_by_rule(spark, d):
    return Rep.by_rule(_findings(spark, d))


@query(f"WITH {_FIND} SELECT CASE WHEN level = '' THEN 'note' ELSE level END AS level, count(*) AS n, count(DISTINCT rule_id) AS rules FROM f GROUP BY 1")
def a3_by_level(spark, d):
    return Rep.by_level(_findings(spark, d))


@query(f"WITH {_FIND} SELECT rule_id, line AS statement, min(doc_id) AS doc_id FROM f GROUP BY ALL")
def a12_first_of_statement(spark, d):
    return Rep.deduplicated(_findings(spark, d).select("rule_id", F.col("line").alias("statement"), "doc_id"), ["doc_id"])


@query(f"WITH {_FIND} SELECT rule_id, file, line, to_base64(unhex(sha256(rule_id || chr(10) || file || chr(10) || line))) AS fingerprint, CASE WHEN level = '' THEN 'note' ELSE level END AS level FROM f")
def s20_f17_sarif_results(spark, d):
    rows = Rep.sarif_results(_findings(spark, d).withColumn("message", F.concat(F.lit("found by "), "rule_id")))
    return rows.select("rule_id", "file", "line", F.get_json_object("result", "$.partialFingerprints.v1").alias("fingerprint"), F.get_json_object("result", "$.level").alias("level"))


@query(f"WITH {V} SELECT user_id AS method, count(*) AS n, count(CASE WHEN k % 3 = 0 THEN 1 END) AS covered, 100 * count(CASE WHEN k % 3 = 0 THEN 1 END) // count(*) AS percent, count(CASE WHEN k % 3 = 0 THEN 1 END) = 0 AS missed FROM ev GROUP BY 1")
def a7_coverage(spark, d):
    e = views.events(spark, d).select(F.col("user_id").alias("method"), "n", "k")
    return Rep.coverage(e.select("method", "n"), e.where("k % 3 = 0").select("method", "n"))


@query(f"WITH {V} SELECT user_id AS method, (n - 1) // 8 AS n, list_sort(list(DISTINCT event_type)) AS facts FROM ev GROUP BY ALL")
def a8_s22_facts_per_statement(spark, d):
    e = views.events(spark, d).select(F.col("user_id").alias("method"), F.floor((F.col("n") - 1) / 8).alias("n"), F.col("event_type").alias("fact"))
    return Rep.facts_per_statement(e)


@query(f"WITH {V} SELECT user_id, count(*) AS steps FROM ev GROUP BY 1 ORDER BY steps DESC, user_id LIMIT 5")
def a6_o4_top_by_steps(spark, d):
    return views.events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("steps")).orderBy(F.desc("steps"), "user_id").limit(5)


@query("""WITH x AS (SELECT doc_id AS sample, 'r' || (doc_id % 3) AS rule_id, quality = 1 AS positive, toxic = 0 AS hit FROM labels)
SELECT CASE WHEN positive AND NOT hit THEN 'false negative' WHEN NOT positive AND hit THEN 'false positive' ELSE 'success' END AS status, count(*) AS n FROM x GROUP BY 1""")
def a11_s21_rule_test_tally(spark, d):
    x = table(spark, d, "labels").select(F.col("doc_id").alias("sample"), F.concat(F.lit("r"), F.col("doc_id") % 3).alias("rule_id"), (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 0).alias("hit"))
    return Rep.tally(x.select("sample", "rule_id", "positive"), x.where("hit").select("sample", "rule_id"))


@query(f"WITH {V}, x AS (SELECT user_id AS finding, (n - 1) // 8 AS flow, n, event_type AS method, 0 AS line, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id, (n - 1) // 8 ORDER BY n), false) AS same FROM ev) SELECT finding, flow, n, method, line, CAST(count(*) FILTER (NOT same) OVER (PARTITION BY finding, flow ORDER BY n) AS BIGINT) AS step FROM x WHERE NOT same AND flow < 2")
def w5_w6_o6_code_flows(spark, d):
    e = views.events(spark, d).select(F.col("user_id").alias("finding"), F.floor((F.col("n") - 1) / 8).alias("flow"), "n", F.col("event_type").alias("method"), F.lit(0).alias("line"))
    return Rep.code_flows(e, 2)


@query(f"WITH {V} SELECT DISTINCT user_id, k FROM ev WHERE event_type = 'view' UNION SELECT user_id, k + 1 FROM ev WHERE event_type = 'view' AND k % 2 = 0")
def a9_a10_merged_facts(spark, d):
    e = views.events(spark, d).where("event_type = 'view'")
    sets = e.groupBy("user_id").agg(F.array_union(F.collect_set("k"), F.transform(F.collect_set(F.when(F.col("k") % 2 == 0, F.col("k"))), lambda x: x + 1)).alias("ks"))
    return sets.select("user_id", F.explode("ks").alias("k"))


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE c.role = 'assistant' AND EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = c.conv_id AND u.turn = c.turn - 1 AND u.role = 'user') ORDER BY 1, 2")
def o3_r33_answers_in_order(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return c.where("role = 'assistant'").join(u.distinct(), ["conv_id", "turn"], "left_semi").select("conv_id", "turn").orderBy("conv_id", "turn")
