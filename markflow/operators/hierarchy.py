"""Hierarchies and usages: closures over edges(child, parent, location), lookups along them, and what is called where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import closed


def children(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): direct children of roots(root)."""
    return edges.join(roots, edges["parent"] == roots["root"]).select("root", F.col("child").alias("node")).distinct()


def descend(edges: DataFrame, roots: DataFrame, visible: DataFrame | None = None, inside: bool = False, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): everything below roots(root), nearest depth, by a semi-naive loop (cycles and diamonds end).

    visible(location): children outside are dropped from the result, or, with inside, are not passed through either.
    """
    links = edges.select(F.col("child").alias("__child"), F.col("parent").alias("__parent"), F.col("location").alias("__location"))
    if visible is not None and inside:
        links = links.join(visible.select(F.col("location").alias("__location")).distinct(), "__location", "left_semi")
    first = roots.select("root").join(links, F.col("root") == F.col("__parent"))
    cols = ["root", "node", "location", "depth"]
    seed = first.select("root", F.col("__child").alias("node"), F.col("__location").alias("location"), F.lit(1).alias("depth"))

    def step(new: DataFrame, n: int) -> DataFrame:
        met = new.select("root", "node").join(links, F.col("node") == F.col("__parent"))
        return met.select("root", F.col("__child").alias("node"), F.col("__location").alias("location"), F.lit(n + 1).alias("depth"))

    rows = closed(seed.select(cols), step, ["root", "node"], max_depth)
    if visible is not None and not inside:
        rows = rows.join(visible.select("location").distinct(), "location", "left_semi")
    return rows.select("root", "node", "depth")


def ascend(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, super, depth): everything above nodes(node)."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"), "location")
    return descend(turned, nodes.select(F.col("node").alias("root"))).select(F.col("root").alias("node"), F.col("node").alias("super"), "depth")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(a, b): b is reachable from a over edges(src, dst)."""
    links = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    seed = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    rows = closed(seed, lambda new, n: new.join(links, F.col("b") == F.col("__s")).select("a", F.col("__d").alias("b")), None, max_depth)
    return rows


def descend_sql(spark, view: str, root: str) -> DataFrame:
    """The same as a recursive query, for edges known to have no cycle; view(child, parent)."""
    return spark.sql(
        f"WITH RECURSIVE h(node, depth) AS (SELECT child, 1 FROM {view} WHERE parent = :root UNION ALL "
        f"SELECT e.child, h.depth + 1 FROM h JOIN {view} e ON e.parent = h.node) SELECT node, min(depth) AS depth FROM h GROUP BY node",
        args={"root": root},
    )


def without_super(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes(node) that have no parent."""
    return classes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def overrides(below: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, name, sig, by): methods(class, name, sig, access) declared again below, as in below(root, node).

    Final, static and private methods and constructors are not overridden; private ones do not override.
    """
    m = methods.where("not is_static and not is_final and not is_private and not is_constructor").select("class", "name", "sig")
    low = methods.where("not is_private and not is_static").select(F.col("class").alias("by"), F.col("name").alias("__n"), F.col("sig").alias("__s"))
    pairs = m.join(below.select(F.col("root").alias("class"), F.col("node").alias("by")), "class")
    return pairs.join(low, (pairs["by"] == low["by"]) & (F.col("name") == F.col("__n")) & (F.col("sig") == F.col("__s"))).select("class", "name", "sig", pairs["by"])


def nearest(above: DataFrame, declared: DataFrame) -> DataFrame:
    """(node, name, owner, depth): the nearest declaration(owner, name) at or above a node; above(node, super, depth)."""
    own = above.select("node", F.col("super").alias("owner"), "depth").unionByName(above.select("node").distinct().select("node", F.col("node").alias("owner"), F.lit(0).alias("depth")))
    met = own.join(declared, "owner")
    w = Window.partitionBy("node", "name").orderBy("depth", "owner")
    return met.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("node", "name", "owner", "depth")


def usages(calls: DataFrame, callees: DataFrame, opcodes: list[str] | None = None, visible: DataFrame | None = None) -> DataFrame:
    """(callee, caller): distinct callers of callees(callee), by opcode and visible location."""
    rows = calls if opcodes is None else calls.where(F.col("opcode").isin(opcodes))
    if visible is not None:
        rows = rows.join(visible.select("location").distinct(), "location", "left_semi")
    return rows.join(callees.select("callee").distinct(), "callee", "left_semi").select("callee", "caller").distinct()


def sliced(packed: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method): methods(class, idx, method) at the offsets of packed(class, offsets)."""
    return packed.select("class", F.explode("offsets").alias("idx")).join(methods, ["class", "idx"]).select("class", "method")


def duplicated(classes: DataFrame, name: str) -> DataFrame:
    return classes.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def builders(methods: DataFrame, wanted: DataFrame, below: DataFrame, limit: int = 100) -> DataFrame:
    """(type, method, priority): methods(owner, method, returns, params, is_static, is_public) that make a type, best first.

    Static factories of the type rank over other static ones, those over instance methods; a method that takes the type or
    anything below it makes nothing.
    """
    kin = below.select(F.col("root").alias("type"), F.col("node").alias("kin")).unionByName(wanted.select("type", F.col("type").alias("kin")))
    made = methods.where("is_public").join(kin, F.col("returns") == F.col("kin")).where(~F.col("returns").startswith("java/"))
    takes = methods.select("method", F.explode("params").alias("p")).join(kin.select(F.col("type").alias("t2"), F.col("kin").alias("k2")), F.col("p") == F.col("k2"))
    free = made.join(takes.select("method", F.col("t2").alias("type")).distinct(), ["method", "type"], "left_anti")
    none = F.size("params") == 0
    own = F.col("owner") == F.col("type")
    rank = F.when(F.col("is_static") & own & none, 15).when(F.col("is_static") & own, 10).when(F.col("is_static") & none, 7).when(F.col("is_static"), 5).when(none, 3).otherwise(0)
    return free.select("type", "method", rank.alias("priority")).orderBy(F.desc("priority"), "type", "method").limit(limit)
