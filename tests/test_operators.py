import random
import re

import pytest
from pyspark.sql import functions as F

from markflow.operators import graph as G
from markflow.operators import hierarchy as H
from markflow.operators import patterns as P
from markflow.operators import store as S
from markflow.operators import taint as T
from markflow.operators import windows as W


def _set(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_finds(spark):
    e = spark.range(100).select("id", F.col("id").cast("int").alias("port"))
    assert _set(S.find(e, "port", 50, "lt"), "id") == set(range(50)) and S.find(e, "port", -1, "le").count() == 0
    assert [r.port for r in S.find_ordered(e, "port", 10, "le").collect()] == list(range(10, -1, -1))
    assert [r.port for r in S.find_ordered(e, "port", 95, "gt").collect()] == [96, 97, 98, 99]
    assert S.find(e, "no_such", 1).count() == 0


def test_set_algebra(spark):
    u = spark.createDataFrame([(1, "user1"), (2, "user2")], "id long, login string")
    a, b = S.find(u, "login", "user1"), S.find(u, "login", "user2")
    both = S.union(a, b, "id")
    assert _set(both, "id") == {1, 2} and S.intersect(a, b, "id").count() == 0 and _set(S.subtract(both, b, "id"), "id") == {1}


def test_hierarchy_filters(spark):
    e = spark.createDataFrame([("Impl1", "Main", 1), ("Impl2", "Impl1", 1), ("Impl2", "Iface", 1)], "child string, parent string, location long")
    root = spark.createDataFrame([("Main",)], "root string")
    assert _set(H.descend(e, root), "node", "depth") == {("Impl1", 1), ("Impl2", 2)} and _set(H.children(e, root), "node") == {"Impl1"}
    hidden = e.withColumn("location", F.when(F.col("child") == "Impl1", 2).otherwise(1).cast("long"))
    seen = spark.createDataFrame([(1,)], "location long")
    assert _set(H.descend(hidden, root, seen), "node") == {"Impl2"} and H.descend(hidden, root, seen, inside=True).count() == 0


def test_small_flow_graph(spark):
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1), (0, 2, 3)], "g long, src long, dst long")
    doms = G.dominators(e, spark.createDataFrame([(0, 0)], "g long, node long"))
    assert {r.dom for r in doms.where("node = 3").collect()} == {0, 1, 2, 3}
    assert _set(G.immediate_dominators(doms).where("node = 3"), "idom") == {2}
    body = G.loops(e, doms)
    assert _set(body, "head", "node") == {(1, 1), (1, 2)} and _set(G.loop_exits(e, body), "node") == {2}
    assert _set(G.components(e), "node", "scc") == {(0, 0), (1, 1), (2, 1), (3, 3)}


def test_closure_on_random_graphs(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(8), rng.randrange(8)) for g in range(6) for _ in range(10)]
    got = _set(G.reach_pairs(spark.createDataFrame(rows, "g long, src long, dst long").distinct()), "g", "a", "b")
    want = {(g, a, b) for g, a, b in rows}
    while True:
        more = {(g, a, d) for g, a, b in want for h, c, d in rows if g == h and b == c} - want
        if not more:
            break
        want |= more
    assert got == want


INST = "m string, n int, op string, lhs string, lhs_path string, rhs string, rhs_path string, callee string"


def _findings(spark, inst, args=(), passes=(), cleaners=(), known=(), sinks=(("s", "sink", "arg0", "tainted", 1),), sources=(("source", "result", "tainted"),)):
    i = spark.createDataFrame(inst, INST)
    flow = spark.createDataFrame([(m, n, n + 1) for m, n, *_ in inst], "m string, src int, dst int")
    ends = spark.createDataFrame([(m, max(x[1] for x in inst if x[0] == m) + 1, "nop", *[None] * 5) for m in {x[0] for x in inst}], INST)
    a = spark.createDataFrame(list(args), "m string, n int, pos string, base string")
    rules = T.Rules(
        spark.createDataFrame(list(sources), "callee string, pos string, mark string"), None,
        spark.createDataFrame(list(cleaners), "callee string, pos string, mark string"), spark.createDataFrame(list(passes), "callee string, src string, dst string"),
    )
    facts = T.propagate(i.unionByName(ends), flow, a, rules, spark.createDataFrame([(k,) for k in known], "callee string"), i.select("m").distinct())
    s = spark.createDataFrame(list(sinks), "sink_id string, callee string, pos string, mark string, need int")
    return _set(T.findings(facts, i, a, s), "m", "n")


def _call(m, n, callee, lhs=None):
    return (m, n, "call", lhs, None, None, None, callee)


def _assign(m, n, lhs, rhs, lp=None, rp=None):
    return (m, n, "assign", lhs, lp, rhs, rp, None)


def test_strong_updates_end_marks(spark):
    inst = [_call("m", 0, "source", "a"), _assign("m", 1, "b", "a"), _assign("m", 2, "a", "const"), _call("m", 3, "sink"), _call("m", 4, "sink")]
    assert _findings(spark, inst, [("m", 3, "arg0", "b"), ("m", 4, "arg0", "a")]) == {("m", 3)}


def test_fields_are_strong_and_elements_weak(spark):
    def program(acc):
        return [_call("m", 0, "source", "t"), _assign("m", 1, "x", "t", acc), _assign("m", 2, "y", "x", None, acc), _assign("m", 3, "x", "const", acc),
                _assign("m", 4, "z", "x", None, acc), _call("m", 5, "sink"), _call("m", 6, "sink")]

    args = [("m", 5, "arg0", "y"), ("m", 6, "arg0", "z")]
    assert _findings(spark, program(".f"), args) == {("m", 5)}
    assert _findings(spark, program("[*]"), args) == {("m", 5), ("m", 6)}


def test_cleaners_and_passes(spark):
    inst = [_call("m", 0, "source", "a"), _call("m", 1, "wrap", "b"), _call("m", 2, "clean"), _call("m", 3, "sink"), _call("m", 4, "sink")]
    args = [("m", 1, "arg0", "a"), ("m", 2, "arg0", "a"), ("m", 3, "arg0", "a"), ("m", 4, "arg0", "b")]
    assert _findings(spark, inst, args, [("wrap", "arg0", "result")], [("clean", "arg0", "*")]) == {("m", 4)}


def test_summaries_keep_callers_apart(spark):
    inst = [_call("m", 0, "source", "a"), _call("m", 1, "id", "b"), _call("m", 2, "sink"), _call("k", 0, "other", "c"), _call("k", 1, "id", "d"), _call("k", 2, "sink"),
            _assign("id", 0, "r", "arg0"), ("id", 1, "return", None, None, "r", None, None)]
    args = [("m", 1, "arg0", "a"), ("m", 2, "arg0", "b"), ("k", 1, "arg0", "c"), ("k", 2, "arg0", "d")]
    assert _findings(spark, inst, args, known=["id"]) == {("m", 2)}


def test_sinks_that_need_two_marks(spark):
    sinks = [("s", "sink", "arg0", "a", 2), ("s", "sink", "arg1", "b", 2)]
    sources = [("sa", "result", "a"), ("sb", "result", "b")]
    inst = [_call("m", 0, "sa", "x"), _call("m", 1, "sink"), _call("m", 2, "sb", "y"), _call("m", 3, "sink")]
    args = [("m", 1, "arg0", "x"), ("m", 1, "arg1", "y"), ("m", 3, "arg0", "x"), ("m", 3, "arg1", "y")]
    assert _findings(spark, inst, args, sinks=sinks, sources=sources) == {("m", 3)}


def test_automata_against_plain_matching():
    rng = random.Random(9)
    syms = ["a", "b", "c"]
    f = ("and", ("either", ("pattern", ["a", "...", "b"]), ("pattern", ["c", "c"])), ("not", ("pattern", ["b", "a"])))
    dfa = P.compile_formula(f, syms)
    assert len(P.minimal(dfa).delta) == len(dfa.delta) and P.complement(P.complement(dfa)) == dfa
    for _ in range(2000):
        w = [rng.randrange(4) for _ in range(rng.randrange(9))]
        s = "".join("abcx"[c] for c in w)
        want = (("a" in s and "b" in s[s.index("a") + 1 :]) or "cc" in s) and "ba" not in s
        assert dfa.accepts(w) == want, s


def test_pattern_runs(spark):
    rows = [(1, i, s) for i, s in enumerate(["signup", "view", "purchase"])] + [(2, i, s) for i, s in enumerate(["signup", "error", "purchase"])] + [(3, i, s) for i, s in enumerate(["purchase", "signup"])]
    syms = ["signup", "error", "purchase"]
    dfa = P.compile_formula(("and", ("pattern", ["signup", "...", "purchase"]), ("not", ("pattern", ["error"]))), syms)
    got = P.run(spark.createDataFrame(rows, "k int, n int, s string"), ["k"], ["n"], F.col("s"), dfa, syms)
    assert _set(got, "k", "matched") == {(1, True), (2, False), (3, False)}


def test_windows_of_a_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 40) as k", "id as n", "if(id % 11 = 0, id, null) as v")
    got = {r.n: r.last for r in W.last_before(df, ["k"], ["n"], F.col("v"), "last").collect()}
    last = {}
    for r in sorted(df.collect(), key=lambda r: r.n):
        assert got[r.n] == last.get(r.k)
        if r.v is not None:
            last[r.k] = r.v


def test_inside_keeps_every_step_of_its_context():
    syms, rng = ["a", "b", "c", "v", "w"], random.Random(9)
    want = {
        ("a", "...", "c"): "a.*vw.*c",
        ("a", "...", "b", "...", "c"): "a.*vw.*b.*c|a.*b.*vw.*c",
        ("a", "b"): "a.*vw.*b",
    }
    for outer, pattern in want.items():
        dfa = P.compile_formula(("inside", list(outer), ["v", "w"]), syms)
        for _ in range(2000):
            word = [rng.randrange(6) for _ in range(rng.randrange(12))]
            assert dfa.accepts(word) == bool(re.search(pattern, "".join("abcvwx"[i] for i in word)))
    with pytest.raises(ValueError):
        P.compile_formula(("inside", ["a"], ["v"]), syms)


def test_small_graphs_equal_the_fixpoints(spark, monkeypatch):
    """Graph by graph without rounds, by fixpoints, and some of each: equal rows; a null node and an entry without edges too."""
    rng = random.Random(7)
    rows = [(g, rng.randrange(9), rng.randrange(9)) for g in range(12) for _ in range(4 + 2 * g)] + [(20, None, 1), (20, 1, 2), (20, 2, 1)]
    e = spark.createDataFrame(rows, "g long, src int, dst int").distinct()
    entries = spark.createDataFrame([(g, min(s for h, s, _ in rows if h == g)) for g in range(12)] + [(4, 5), (20, 1), (30, 3)], "g long, node int")

    def all_of():
        doms = G.dominators(e, entries)
        got = [_set(doms, "g", "node", "dom"), _set(G.immediate_dominators(doms), "g", "node", "idom"), _set(G.loops(e, doms), "g", "head", "node"), _set(G.components(e), "g", "node", "scc")]
        assert len(got[0]) == doms.count() and len(got[2]) == G.loops(e, doms).count() and len(got[3]) == G.components(e).count()
        return got

    def none(*_):
        raise AssertionError("rounds for small graphs")

    some = all_of()
    for bound in (0, 14):
        monkeypatch.setattr(G, "SMALL", bound)
        assert all_of() == some
    monkeypatch.undo()
    monkeypatch.setattr(G, "closed", none)
    e = e.where("g < 20")
    doms = G.dominators(e, entries.where("g < 20"))
    assert _set(doms, "g", "node", "dom") == {x for x in some[0] if x[0] < 20} and _set(G.components(e), "g", "node", "scc") == {x for x in some[3] if x[0] < 20}
    assert _set(G.loops(e, doms), "g", "head", "node") == {x for x in some[2] if x[0] < 20}
