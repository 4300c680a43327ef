"""Binding declarative rules to methods, and combining rule sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import concrete

RULES = "rule_id string, kind string, class_pattern string, method_pattern string, overrides boolean"


def rules_frame(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """rules (id, kind, class pattern, method pattern, overrides) with their patterns made concrete: how_class, class, how_method, method."""
    rows = [(i, k, *concrete(c), *concrete(m), o) for i, k, c, m, o in rules]
    return spark.createDataFrame(rows, "rule_id string, kind string, how_class string, class string, how_method string, method string, overrides boolean")


def _test(how: str, text: str, name: str):
    h, t, n = F.col(how), F.col(text), F.col(name)
    return (
        F.when(h == "any", n.isNotNull()).when(h == "eq", n == t).when(h == "prefix", n.startswith(t)).when(h == "suffix", n.endswith(t))
        .otherwise(F.rlike(n, F.concat(F.lit("^(?:"), t, F.lit(")$"))))
    )


def bind(methods: DataFrame, rules: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(class, method, rule_id, kind): rules on methods(class, method).

    Rules with a literal class meet methods by equality; only the others are tested as patterns, and against distinct class
    names, not against methods. With above(node, super), rules that say so also bind to a class through its supers.
    """
    names = methods.select("class").distinct()
    r = rules.withColumnsRenamed({"class": "r_class", "method": "r_method"})
    literal = names.join(r.where("how_class = 'eq'"), F.col("class") == F.col("r_class"))
    pattern = names.join(F.broadcast(r.where("how_class <> 'eq'")), _test("how_class", "r_class", "class"))  # rules are few: they are written by hand
    at = literal.unionByName(pattern).select("class", "rule_id", "kind", "how_method", "r_method", "overrides")
    if above is not None:
        low = at.where("overrides").join(above.select(F.col("super").alias("class"), F.col("node").alias("__low")).distinct(), "class")
        at = at.unionByName(low.drop("class").withColumnRenamed("__low", "class")).distinct()
    return methods.join(at, "class").where(_test("how_method", "r_method", "method")).select("class", "method", "rule_id", "kind").distinct()


def signature_matches(params: str, returns: str, want_params: list[str] | None, want_returns: str | None, partial: dict[int, str] | None = None):
    """Exact signature (count, types, result), or the given indexes only."""
    ok = F.lit(True)
    if want_params is not None:
        ok = ok & (F.col(params) == F.array(*[F.lit(p) for p in want_params]) if want_params else F.size(params) == 0)
    for i, t in (partial or {}).items():
        ok = ok & F.coalesce(F.get(F.col(params), i) == t, F.lit(False))
    return ok & (F.col(returns) == want_returns) if want_returns else ok


def any_argument(rules: DataFrame, methods: DataFrame) -> DataFrame:
    """Rules bound to arg(*) as one row per argument of each method: (rule_id, method, arg)."""
    return rules.join(methods, "method").where("n_params > 0").select("rule_id", "method", F.explode(F.sequence(F.lit(0), F.col("n_params") - 1)).alias("arg"))


def position_pairs(rules: DataFrame) -> DataFrame:
    """(rule_id, from, to): all pairs of a pass rule's from and to positions."""
    return rules.select("rule_id", F.explode("froms").alias("from"), "tos").select("rule_id", "from", F.explode("tos").alias("to"))


#: How custom rules meet the base ones, by kind.
COMBINE = {"entry-point": "OVERRIDE", "source": "OVERRIDE", "sink": "OVERRIDE", "pass-through": "EXTEND", "cleaner": "EXTEND"}


def combine(base: DataFrame, custom: DataFrame, modes: dict[str, str] = COMBINE) -> DataFrame:
    """Rules(rule_id, kind) by mode of their kind: EXTEND both, OVERRIDE custom only, IGNORE base only."""
    mode = F.create_map(*[F.lit(x) for kv in modes.items() for x in kv])[F.col("kind")]
    mode = F.coalesce(mode, F.lit("EXTEND"))
    return base.where(mode != "OVERRIDE").unionByName(custom.where(mode != "IGNORE")).distinct()


def meta_annotated(annotations: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(name, via): annotation names with all they are annotated with in turn; annotations(name, on) says `name` carries `on`."""
    from .hierarchy import closure

    return closure(annotations.select(F.col("name").alias("src"), F.col("on").alias("dst")), max_depth).select(F.col("a").alias("name"), F.col("b").alias("via"))


def admitted(rules: DataFrame, severities: list[str] | None = None, cwes: list[int] | None = None) -> DataFrame:
    """rules(severity, cwe array, disabled) that may run: not disabled, severity allowed, CWE null or among the given."""
    ok = ~F.coalesce(F.col("disabled"), F.lit(False))
    if severities is not None:
        ok = ok & F.col("severity").isin(severities)
    if cwes is not None:
        ok = ok & (F.col("cwe").isNull() | F.arrays_overlap("cwe", F.array(*[F.lit(c) for c in cwes])))
    return rules.where(ok)


def default_getters(methods: DataFrame, project: DataFrame) -> DataFrame:
    """Pass rules (callee, src, dst) for getters of classes outside the project: all marks of this go to the result, and to its elements where it may be an array."""
    own = project.select("class").distinct()
    g = methods.where("not is_static and name like 'get%'").join(own, "class", "left_anti").select(F.concat_ws("#", "class", "name").alias("callee"), F.lit("this").alias("src"), "returns")
    plain = g.select("callee", "src", F.lit("result").alias("dst"))
    may = F.col("returns").endswith("[]") | (F.col("returns") == "java.lang.Object")
    return plain.unionByName(g.where(may).select("callee", "src", F.lit("result[*]").alias("dst"))).distinct()


def concat_passes(calls: DataFrame, names: tuple[str, ...] = ("concat", "append", "makeConcatWithConstants")) -> DataFrame:
    """Pass rules (callee, src, dst) of string concatenations: every argument goes to the result; calls(callee, name, n_args)."""
    c = calls.where(F.col("name").isin(*names) & (F.col("n_args") > 0)).select("callee", "n_args").distinct()
    return c.select("callee", F.explode(F.sequence(F.lit(0), F.col("n_args") - 1)).alias("i")).select("callee", F.concat(F.lit("arg"), "i").alias("src"), F.lit("result").alias("dst")).distinct()
