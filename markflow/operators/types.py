"""Subtypes, assignability, type filters of facts, points-to and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected

#: What a primitive widens to, and its box.
WIDENS = {"byte": ["short", "int", "long", "float", "double"], "short": ["int", "long", "float", "double"], "char": ["int", "long", "float", "double"], "int": ["long", "float", "double"], "long": ["float", "double"], "float": ["double"]}
BOXES = {"boolean": "java.lang.Boolean", "byte": "java.lang.Byte", "char": "java.lang.Character", "short": "java.lang.Short", "int": "java.lang.Integer", "long": "java.lang.Long", "float": "java.lang.Float", "double": "java.lang.Double"}
OBJECT = "java.lang.Object"


def _pairs(mapping: dict[str, list[str]], a: Column, b: Column) -> Column:
    out = F.lit(False)
    for k, v in mapping.items():
        out = out | ((a == k) & b.isin(v))
    return out


def assignable(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """pairs(src, dst) with ok: a value of type src may be assigned to dst; below(root, node) is the subtype closure."""
    src, dst = F.col("src"), F.col("dst")
    sub = below.select(F.col("node").alias("__s"), F.col("root").alias("__d")).distinct().withColumn("__sub", F.lit(True))
    a, b = F.regexp_replace(src, r"\[\]$", ""), F.regexp_replace(dst, r"\[\]$", "")
    both = src.endswith("[]") & dst.endswith("[]")
    prim = list(BOXES)
    met = pairs.withColumns({"__a": F.when(both, a).otherwise(src), "__b": F.when(both, b).otherwise(dst)})
    met = met.join(sub, (F.col("__a") == F.col("__s")) & (F.col("__b") == F.col("__d")), "left")
    box = _pairs({k: [v] for k, v in BOXES.items()}, src, dst) | _pairs({v: [k] for k, v in BOXES.items()}, src, dst)
    ok = (src == dst) | ((src == "null") & ~dst.isin(prim)) | ((dst == OBJECT) & ~src.isin(prim)) | _pairs(WIDENS, src, dst) | box | (F.coalesce("__sub", F.lit(False)) & ~src.isin(prim))
    return met.select(*pairs.columns, ok.alias("ok"))


def type_filter(facts: DataFrame, below: DataFrame) -> DataFrame:
    """facts(fact, type, static) that can exist: types equal, unknown, or one below the other."""
    pairs = below.select(F.col("root").alias("__a"), F.col("node").alias("__b"))
    both = pairs.unionByName(pairs.select(F.col("__b").alias("__a"), F.col("__a").alias("__b"))).distinct()
    sure = F.col("type").isNull() | F.col("static").isNull() | (F.col("type") == F.col("static")) | (F.col("static") == OBJECT)
    kin = facts.where(~sure).join(both, (F.col("type") == F.col("__a")) & (F.col("static") == F.col("__b")), "left_semi")
    return facts.where(sure).unionByName(kin)


def may_alias(assigns: DataFrame) -> DataFrame:
    """(g, node, root): variables of assigns(g, src, dst) that may point to one object, flow-insensitively."""
    return connected(assigns.select("g", "src", "dst"))


def resolve_calls(calls: DataFrame, overriding: DataFrame, units: DataFrame) -> DataFrame:
    """(call, target, how) of calls(call, class, method, exact): the method itself if the type is exact, else all that override it in known units.

    overriding(class, method, by); units(unit_class). Calls without a target are kept as failures.
    """
    exact = calls.where("exact").select("call", F.concat_ws("#", "class", "method").alias("target"), F.lit("exact").alias("how"))
    known = overriding.join(units, overriding["by"] == units["unit_class"], "left_semi")
    virtual = calls.where("not exact").join(known, ["class", "method"], "left").select("call", F.when(F.col("by").isNotNull(), F.concat_ws("#", "by", "method")).alias("target"))
    return exact.unionByName(virtual.withColumn("how", F.when(F.col("target").isNull(), "failure").otherwise("virtual"))).distinct()


def approximations(originals: DataFrame, models: DataFrame) -> DataFrame:
    """(class, model): models(target, model, since, until) whose inclusive version interval holds originals(class, version)."""
    def key(v: str) -> Column:
        return F.transform(F.split(F.col(v), r"\."), lambda x: x.cast("int"))

    met = originals.join(models, originals["class"] == models["target"])
    return met.where(F.col("version").isNotNull() & (key("version") >= key("since")) & (key("version") <= key("until"))).select("class", "model")


def substituted(bodies: DataFrame, models: DataFrame) -> DataFrame:
    """bodies(method, body) with those that models(method, body) replaces."""
    return bodies.join(models.select("method").distinct(), "method", "left_anti").unionByName(models.select("method", "body"))


def least_upper_bounds(pairs: DataFrame, above: DataFrame) -> DataFrame:
    """(a, b, lub): the nearest common super of pairs(a, b) over above(node, super, depth); ties go to the smaller name."""
    own = above.select("node", "super", "depth").unionByName(above.select("node").distinct().select("node", F.col("node").alias("super"), F.lit(0).alias("depth")))
    left = own.select(F.col("node").alias("a"), F.col("super").alias("lub"), F.col("depth").alias("da"))
    right = own.select(F.col("node").alias("b"), F.col("super").alias("lub"), F.col("depth").alias("db"))
    met = pairs.join(left, "a").join(right, ["b", "lub"])
    return met.groupBy("a", "b").agg(F.min_by("lub", F.struct(F.col("da") + F.col("db"), "lub")).alias("lub"))
