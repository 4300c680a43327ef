import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from markflow.operators import patterns as P
from markflow.operators.report import write_sarif
from markflow.sources import classfiles, rule_files
from markflow.streaming import automaton, refresh

CONFIG = """
source:
  - id: s1
    function: pkg.A#read
    taint: [{kind: tainted, pos: result}]
  - function: {package: {pattern: "pkg\\\\..*"}, class: B, name: get}
    taint: [{kind: tainted, pos: arg(0)}]
passThrough:
  - function: pkg.C#copy
    copy: [{from: arg(0), to: "result.pkg.D#f#int"}]
  - copy: []
sink:
  - function: pkg.E#run
    cwe: [79]
    taint: [{kind: tainted, pos: nowhere}]
"""
RULES = """
rules:
  - {id: r1, severity: ERROR, message: m, patterns: [{pattern: "$X = src();"}, {pattern-not: "clean($X);"}], metadata: {cwe: ["CWE-79: x"]}}
  - {id: r2, severity: WARNING, mode: taint, message: m, pattern-sources: [{pattern: a}], pattern-sinks: [{pattern: b, requires: "A and not B"}]}
  - {id: r3, severity: ERROR, mode: join, message: m, join: {on: ["a.$X -> b.$Y"]}}
  - {id: r4, severity: ERROR, mode: odd, message: m}
  - {id: r5, severity: ERROR, message: m, pattern: p, options: {disabled: x}}
  - {id: r6, severity: INFO, message: m, pattern: p}
  - {id: r7, severity: ERROR, message: m, pattern: p, options: {overrides: r1b}}
  - {id: r1b, severity: ERROR, message: m, pattern: p}
"""


def test_taint_config(spark):
    pytest.importorskip("yaml")
    rules, issues = rule_files.load_taint_config(spark, CONFIG)
    got = {r.rule_id: r for r in rules.collect()}
    assert set(got) == {"s1", "source-1", "passThrough-0"} and got["s1"].how_class == "eq" and got["s1"].tos == ["result"]
    assert {r.rule_id for r in issues.collect()} == {"passThrough-1", "sink-0"}
    assert rule_files.load_taint_config(spark, "a: [")[1].count() == 1


def test_pattern_rules(spark):
    pytest.importorskip("yaml")
    rules, issues, formulas = rule_files.load_pattern_rules(spark, RULES, severities=("ERROR", "WARNING"))
    assert {r.rule_id for r in rules.collect()} == {"r1", "r2", "r3", "r7"} and {r.rule_id for r in issues.collect()} == {"r4"}
    assert formulas["r1"] == ("and", ("pattern", "$X = src();"), ("not", ("pattern", "clean($X);"))) and formulas["r3"] == ("join", [("a.$X", "b.$Y")])


def test_project():
    pytest.importorskip("yaml")
    p = rule_files.load_project("sourceRoot: src\nmodules: [{path: a, packages: [p]}]\nsubProjects: [{sourceRoot: b}]")
    assert p["source_root"] == "src" and p["modules"][0]["packages"] == ["p"] and p["sub_projects"][0]["source_root"] == "b"


def test_class_files(spark, tmp_path):
    if not shutil.which("javac"):
        pytest.skip("no javac")
    (tmp_path / "Impl.java").write_text("package p; interface Iface { int f(long a); } public class Impl implements Iface { static String s; public int f(long a) { return 1; } }")
    subprocess.run(["javac", "-d", str(tmp_path / "out"), str(tmp_path / "Impl.java")], check=True)
    subprocess.run(["jar", "cf", str(tmp_path / "x.jar"), "-C", str(tmp_path / "out"), "."], check=True)
    for place in (tmp_path / "out", tmp_path / "x.jar"):
        rows = classfiles.classes(spark, str(place))
        got = {r["name"]: r for r in rows.collect()}
        assert set(got) == {"p.Impl", "p.Iface"} and got["p.Impl"].interfaces == ["p.Iface"] and got["p.Impl"].super == "java.lang.Object"
        assert ("f", "(J)I") in {(m["name"], m["desc"]) for m in got["p.Impl"].methods} and got["p.Impl"].fields[0]["name"] == "s"
        assert {(r.child, r.parent, r.is_class) for r in classfiles.hierarchy_edges(rows).collect()} >= {("p.Impl", "p.Iface", False), ("p.Impl", "java.lang.Object", True)}


def test_manifest(spark):
    df = spark.createDataFrame([("a.jar", "Manifest-Version: 1.0\nClass-Path: b.jar c\n .jar\nX: y\n"), ("d.jar", "X: y\n")], "location string, text string")
    assert [(r.location, r.entry) for r in classfiles.manifest_class_path(df).collect()] == [("a.jar", "b.jar"), ("a.jar", "c.jar")]


def test_refresh_stream(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")]):
        spark.createDataFrame(rows, "k string, h string").coalesce(1).write.mode("append").parquet(src)
        refresh.refresh(spark, src, "k string, h string", target, str(tmp_path / "ck"), ["k"], "h").awaitTermination()
    import os

    last = max(int(x.split("=")[1]) for x in os.listdir(target))
    got = {(r.k, r.h, r.is_deleted) for r in spark.read.parquet(f"{target}/version={last}").collect()}
    assert got == {("a", "1", False), ("b", "1", True), ("b", "2", False), ("c", "1", False)}


def test_stream_automaton_equals_batch(spark, tmp_path):
    syms = ["signup", "error", "purchase"]
    dfa = P.compile_formula(("and", ("pattern", ["signup", "...", "purchase"]), ("not", ("pattern", ["error"]))), syms)
    rows = [(k, n, syms[(k * 7 + n * n) % 4] if (k * 7 + n * n) % 4 < 3 else "view") for n in range(6) for k in range(20)]
    for half in (rows[:60], rows[60:]):
        spark.createDataFrame(half, "k int, n int, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, n int, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = automaton.run(stream, "k", "n", "s", dfa, syms).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    last = {r.k: r.m for r in out.groupBy("k").agg(F.max_by("matched", "at").alias("m")).collect()}
    batch = P.run(spark.createDataFrame(rows, "k int, n int, s string"), ["k"], ["n"], F.col("s"), dfa, syms)
    assert last == {r.k: r.matched for r in batch.collect()}


def test_sarif_sink(spark, tmp_path):
    f = spark.createDataFrame([("r", "", "m", "a.java", 3)], "rule_id string, level string, message string, file string, line int")
    write_sarif(f, str(tmp_path / "sarif"))
    r = spark.read.json(str(tmp_path / "sarif/results")).first()
    assert r.ruleId == "r" and r.level == "note" and r.locations[0].physicalLocation.region.startLine == 3
