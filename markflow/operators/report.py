"""Findings reports: counts, pivots, coverage, code flows, SARIF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fingerprint
from .windows import islands

LEVELS = ("error", "warning", "note")


def level_of(col: str = "level"):
    """Null and empty levels are notes."""
    c = F.col(col)
    return F.when(c.isNull() | (c == ""), "note").otherwise(c)


def by_level(findings: DataFrame) -> DataFrame:
    return findings.groupBy(level_of().alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rule_id").alias("rules"))


def by_rule(findings: DataFrame) -> DataFrame:
    """(rule_id, error, warning, note, total, files): one pass, no pivot of unknown width."""
    n = [F.sum(F.when(level_of() == x, 1).otherwise(0)).alias(x) for x in LEVELS]
    return findings.groupBy("rule_id").agg(*n, F.count(F.lit(1)).alias("total"), F.count_distinct("file").alias("files"))


def deduplicated(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first finding of each (rule, statement)."""
    rest = [c for c in findings.columns if c not in ("rule_id", "statement")]
    first = findings.groupBy("rule_id", "statement").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select("rule_id", "statement", "r.*").select(findings.columns)


def coverage(instructions: DataFrame, covered: DataFrame) -> DataFrame:
    """(method, n, covered, percent, missed) over instructions(method, n) and covered(method, n)."""
    hit = covered.select("method", "n").distinct().withColumn("__hit", F.lit(1))
    out = instructions.join(hit, ["method", "n"], "left").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("__hit").alias("covered"))
    return out.withColumn("percent", F.floor(100 * F.col("covered") / F.col("n"))).withColumn("missed", F.col("covered") == 0)


def facts_per_statement(facts: DataFrame) -> DataFrame:
    return facts.groupBy("method", "n").agg(F.array_sort(F.collect_set("fact")).alias("facts"))


def code_flows(steps: DataFrame, limit: int | None = None) -> DataFrame:
    """steps(finding, flow, n, method, line) without repeated neighbours, numbered, at most `limit` flows to a finding."""
    w = Window.partitionBy("finding", "flow").orderBy("n")
    same = (F.col("method") == F.lag("method").over(w)) & (F.col("line") == F.lag("line").over(w))
    kept = islands(steps.withColumn("__same", same), ["finding", "flow"], ["n"], F.col("__same"), "step").where("not coalesce(__same, false)").drop("__same")
    if limit is not None:
        kept = kept.withColumn("__f", F.dense_rank().over(Window.partitionBy("finding").orderBy("flow"))).where(F.col("__f") <= limit).drop("__f")
    return kept


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON text per finding(rule_id, level, message, file, line): a result with location and fingerprint."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level_of().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(fingerprint(F.col("rule_id"), F.col("file"), F.col("line").cast("string")).alias("v1")).alias("partialFingerprints"),
    )
    return findings.select("rule_id", "file", "line", F.to_json(result).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "markflow") -> None:
    """A folder with results.jsonl parts and one run header; results never pass the driver."""
    sarif_results(findings).select(F.col("result").alias("value")).write.mode("overwrite").text(f"{path}/results")
    head = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool")))
    findings.sparkSession.range(1).select(head.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/run")


def tally(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(status, n) of rule samples: expected(sample, rule_id, positive) against found(sample, rule_id)."""
    hit = found.select("sample", "rule_id").distinct().withColumn("__hit", F.lit(True))
    met = expected.join(hit, ["sample", "rule_id"], "left")
    status = F.when(F.col("positive") & F.col("__hit").isNull(), "false negative").when(~F.col("positive") & F.col("__hit").isNotNull(), "false positive").otherwise("success")
    return met.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
