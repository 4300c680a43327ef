"""Flow graphs of the events: dominators, loops, blocks, components, data flow, aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import taint as T
from ..runtime import saved
from . import views
from .registry import query

_F = views.FLOW
_REACH = f"""WITH RECURSIVE {_F}, en AS (SELECT g, min(src) AS node FROM fl GROUP BY g), r AS (SELECT g, node FROM en UNION SELECT r.g, fl.dst FROM r JOIN fl ON fl.g = r.g AND fl.src = r.node)"""
_PAIRS = f"WITH RECURSIVE {_F}, p AS (SELECT g, src AS a, dst AS b FROM fl UNION SELECT p.g, p.a, fl.dst FROM p JOIN fl ON fl.g = p.g AND fl.src = p.b)"
_DOM = f"""{_REACH}, av AS (SELECT r.g, r.node AS cut, en.node AS node FROM r JOIN en ON r.g = en.g WHERE r.node <> en.node UNION SELECT av.g, av.cut, fl.dst FROM av JOIN fl ON fl.g = av.g AND fl.src = av.node WHERE fl.dst <> av.cut),
dm AS (SELECT a.g, a.node, b.node AS dom FROM r a JOIN r b ON a.g = b.g WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.g = a.g AND av.cut = b.node AND av.node = a.node))"""


def _entries(e):
    return e.groupBy("g").agg(F.min("src").alias("node"))


@query(f"{_REACH} SELECT g, node FROM r")
def h24_reachable(spark, d):
    e = views.flow(spark, d)
    return G.reach(e, _entries(e))


@query(f"{_REACH}, b AS (SELECT g, max(src) AS node FROM fl GROUP BY g UNION SELECT b.g, fl.src FROM b JOIN fl ON fl.g = b.g AND fl.dst = b.node) SELECT g, node FROM r INTERSECT SELECT g, node FROM b")
def h25_trimmed(spark, d):
    e = views.flow(spark, d)
    back = G.reach(G.reversed_edges(e), e.groupBy("g").agg(F.max("src").alias("node")))
    return G.reach(e, _entries(e)).join(back, ["g", "node"], "left_semi")


@query(f"{_DOM} SELECT g, node, dom FROM dm")
def h13_dominators(spark, d):
    e = saved(views.flow(spark, d), "flow")
    return G.dominators(e, _entries(e))


@query(f"{_DOM}, dp AS (SELECT g, node, count(*) AS depth FROM dm GROUP BY ALL) SELECT dm.g, dm.node, arg_max(dm.dom, dp.depth) AS idom FROM dm JOIN dp ON dm.g = dp.g AND dm.dom = dp.node WHERE dm.node <> dm.dom GROUP BY dm.g, dm.node")
def h14_dominator_tree(spark, d):
    e = saved(views.flow(spark, d), "flow")
    return G.immediate_dominators(G.dominators(e, _entries(e)))


@query(f"{_DOM}, be AS (SELECT fl.g, fl.src, fl.dst FROM fl JOIN dm ON dm.g = fl.g AND dm.node = fl.src AND dm.dom = fl.dst), lb AS (SELECT g, dst AS head, src AS node FROM be UNION SELECT g, dst, dst FROM be UNION SELECT lb.g, lb.head, fl.src FROM lb JOIN fl ON fl.g = lb.g AND fl.dst = lb.node WHERE lb.node <> lb.head) SELECT g, head, node FROM lb")
def h15_natural_loops(spark, d):
    e = saved(views.flow(spark, d), "flow")
    return G.loops(e, G.dominators(e, _entries(e)))


@query(f"{_PAIRS}, n AS (SELECT g, src AS node FROM fl UNION SELECT g, dst FROM fl) SELECT n.g, n.node, least(n.node, coalesce(min(x.b), n.node)) AS scc FROM n LEFT JOIN (SELECT p.g, p.a, p.b FROM p JOIN p q ON p.g = q.g AND p.a = q.b AND p.b = q.a) x ON x.g = n.g AND x.a = n.node GROUP BY n.g, n.node")
def h21_components(spark, d):
    return G.components(views.flow(spark, d))


@query(f"WITH RECURSIVE {_F}, n AS (SELECT g, src AS node FROM fl UNION SELECT g, dst FROM fl), l AS (SELECT g, node, 0 AS level FROM n WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.g = n.g AND fl.dst = n.node AND fl.src < fl.dst) UNION SELECT l.g, fl.dst, l.level + 1 FROM l JOIN fl ON fl.g = l.g AND fl.src = l.node AND fl.src < fl.dst) SELECT g, node, max(level) AS level FROM l GROUP BY g, node")
def h22_topological_levels(spark, d):
    return G.levels(views.flow(spark, d))


@query(f"""WITH {_F}, n AS (SELECT g, src AS node FROM fl UNION SELECT g, dst FROM fl), o AS (SELECT g, src AS node, count(*) AS outs, max(dst) AS t FROM fl GROUP BY ALL), i AS (SELECT g, dst AS node, count(*) AS ins, min(src) AS f FROM fl GROUP BY ALL),
x AS (SELECT n.g, n.node, lag(n.node) OVER w AS before, lag(outs) OVER w AS bo, lag(t) OVER w AS bt, ins, f FROM n LEFT JOIN o USING (g, node) LEFT JOIN i USING (g, node) WINDOW w AS (PARTITION BY n.g ORDER BY n.node))
SELECT g, node, last_value(CASE WHEN before IS NULL OR NOT coalesce(ins = 1 AND f = before AND bo = 1 AND bt = node, false) THEN node END IGNORE NULLS) OVER (PARTITION BY g ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM x""")
def h16_w2_basic_blocks(spark, d):
    e = views.flow(spark, d)
    nodes = e.select("g", F.col("src").alias("node")).unionAll(e.select("g", F.col("dst").alias("node"))).distinct()
    return G.blocks(nodes, e)


_DEFS = "df AS (SELECT DISTINCT g, src AS node, (src * 5) % 3 AS var FROM fl)"


def _defs(e):
    return e.select("g", F.col("src").alias("node"), ((F.col("src") * 5) % 3).alias("var")).distinct()


@query(f"WITH RECURSIVE {_F}, {_DEFS}, r AS (SELECT df.g, fl.dst AS node, df.var, df.node AS at FROM df JOIN fl ON fl.g = df.g AND fl.src = df.node UNION SELECT r.g, fl.dst, r.var, r.at FROM r JOIN fl ON fl.g = r.g AND fl.src = r.node WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.g = r.g AND df.node = r.node AND df.var = r.var)) SELECT g, node, var, at AS \"at\" FROM r".replace("df.node AS at", "df.node AS \"at\"").replace("r.at FROM r", "r.\"at\" FROM r").replace("var, at AS", "var, \"at\" AS"))
def h17_reaching_definitions(spark, d):
    e = views.flow(spark, d)
    return G.reaching_definitions(e, _defs(e))


@query(f"WITH RECURSIVE {_F}, {_DEFS}, us AS (SELECT DISTINCT g, dst AS node, dst % 3 AS var FROM fl), a AS (SELECT us.g, fl.src AS node, us.var FROM us JOIN fl ON fl.g = us.g AND fl.dst = us.node UNION SELECT a.g, fl.src, a.var FROM a JOIN fl ON fl.g = a.g AND fl.dst = a.node WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.g = a.g AND df.node = a.node AND df.var = a.var)) SELECT g, node, var FROM a WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.g = a.g AND df.node = a.node AND df.var = a.var) UNION SELECT g, node, var FROM us")
def h20_h19_live_variables(spark, d):
    e = views.flow(spark, d)
    uses = e.select("g", F.col("dst").alias("node"), (F.col("dst") % 3).alias("var")).distinct()
    return G.live_variables(e, uses, _defs(e))


@query(f"WITH RECURSIVE {_F}, kn AS (SELECT DISTINCT g, dst AS node, dst % 2 AS var, CASE WHEN dst % 3 = 0 THEN 'NULL' ELSE 'NON_NULL' END AS state FROM fl), a AS (SELECT kn.g, fl.src AS node, kn.var, kn.state FROM kn JOIN fl ON fl.g = kn.g AND fl.dst = kn.node UNION SELECT a.g, fl.src, a.var, a.state FROM a JOIN fl ON fl.g = a.g AND fl.dst = a.node) SELECT g, node, var, CASE WHEN count(DISTINCT state) = 1 THEN min(state) ELSE 'UNKNOWN' END AS state FROM a GROUP BY g, node, var")
def h18_null_states(spark, d):
    e = views.flow(spark, d)
    known = e.select("g", F.col("dst").alias("node"), (F.col("dst") % 2).alias("var"), F.when(F.col("dst") % 3 == 0, "NULL").otherwise("NON_NULL").alias("state")).distinct()
    return G.null_states(e, known)


_ALIAS = f"{views.EVENTS}, al AS (SELECT DISTINCT user_id AS g, k AS src, (k * 3 + 1) % 100 AS dst FROM ev)"


@query(f"WITH RECURSIVE {_ALIAS}, b AS (SELECT g, src, dst FROM al UNION SELECT g, dst, src FROM al), r AS (SELECT g, src AS node, src AS o FROM b UNION SELECT r.g, r.node, b.dst FROM r JOIN b ON b.g = r.g AND b.src = r.o) SELECT g, node, min(o) AS root FROM r GROUP BY g, node")
def h26_h27_may_alias(spark, d):
    e = views.events(spark, d).select(F.col("user_id").alias("g"), F.col("k").alias("src"), ((F.col("k") * 3 + 1) % 100).alias("dst")).distinct()
    return G.connected(e)


_ORD = "lv AS (SELECT node, min(level) AS level FROM l GROUP BY node)"


@query(f"""WITH RECURSIVE {_F}, q AS (SELECT g * 12 + src AS src, g * 12 + dst AS dst FROM fl), l AS (SELECT g * 12 + min(src) AS node, 0 AS level FROM fl GROUP BY g UNION SELECT q.dst, l.level + 1 FROM l JOIN q ON q.src = l.node WHERE l.level < 13), {_ORD},
s AS (SELECT g * 12 + max(dst) AS node FROM fl GROUP BY g), bk AS (SELECT lv.node AS sink, lv.node, lv.level FROM s JOIN lv USING (node) UNION SELECT bk.sink, q.src, a.level FROM bk JOIN q ON q.dst = bk.node JOIN lv a ON a.node = q.src AND a.level = bk.level - 1) SELECT sink, node, level FROM bk""")
def t25_t27_t29_shortest_traces(spark, d):
    e = views.flow(spark, d)
    flat = e.select((F.col("g") * 12 + F.col("src")).alias("src"), (F.col("g") * 12 + F.col("dst")).alias("dst"))
    sources = e.groupBy("g").agg(F.min("src").alias("n")).select((F.col("g") * 12 + F.col("n")).alias("node"))
    sinks = e.groupBy("g").agg(F.max("dst").alias("n")).select((F.col("g") * 12 + F.col("n")).alias("node"))
    return T.shortest_trace(flat, sources, sinks)


@query(f"""WITH RECURSIVE {_F}, q AS (SELECT g * 12 + src AS src, g * 12 + dst AS dst FROM fl WHERE dst % 5 <> 3), pv AS (SELECT DISTINCT g * 12 + src AS finding, g * 12 + src AS node FROM fl WHERE src % 4 = 1),
r AS (SELECT finding, node FROM pv UNION SELECT r.finding, q.dst FROM r JOIN q ON q.src = r.node) SELECT finding, CASE WHEN bool_or(node % 12 = 11) THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS state FROM r GROUP BY finding""")
def t24_confirmed(spark, d):
    e = views.flow(spark, d).select((F.col("g") * 12 + F.col("src")).alias("src"), (F.col("g") * 12 + F.col("dst")).alias("dst"))
    nodes = e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct()
    prov = e.where("src % 12 % 4 = 1").select(F.col("src").alias("finding"), F.col("src").alias("node")).distinct()
    return T.confirmed(prov, e, nodes.where("node % 12 = 11"), nodes.where("node % 12 % 5 = 3"))
