import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from markflow.functions import conditions as C
from markflow.functions import names as N


def _eval(c, env):
    if c.op in ("true", "false"):
        return c.op == "true"
    if c.op == "not":
        return not _eval(c.args[0], env)
    if c.op in ("and", "or"):
        return (all if c.op == "and" else any)(_eval(a, env) for a in c.args)
    return env[c.args[0]]


def _random(rng, depth=4):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([C.atom("x", v) for v in "pqrs"] + [C.TRUE, C.FALSE])
    k = rng.randrange(3)
    if k == 0:
        return C.negated(_random(rng, depth - 1))
    return (C.all_of if k == 1 else C.any_of)(*[_random(rng, depth - 1) for _ in range(rng.randrange(1, 4))])


def test_normal_forms_keep_the_meaning():
    rng = random.Random(17)
    for _ in range(300):
        c = _random(rng)
        n, cubes = C.nnf(c), C.dnf(c)
        for values in itertools.product([False, True], repeat=4):
            env = dict(zip("pqrs", values))
            want = _eval(c, env)
            assert _eval(n, env) == want
            assert any(all(_eval(a, env) for a in q) for q in cubes) == want


def test_requires():
    e = C.requires("A and not (B or C)")
    assert [_eval(C.Cond(e.op, e.args), {}) if False else e.op] == ["and"]
    for bad in ("", "A and", "(A", "A B", "or A"):
        with pytest.raises(ValueError):
            C.requires(bad)


def test_string_order_is_an_error(spark):
    with pytest.raises(ValueError):
        C.compile(C.atom("const_lt", "c", "x"), {"c": F.lit(1)})


def test_concrete_patterns_equal_their_regex(spark):
    words = ["pkg.A", "pkg.B", "pkg.Bx", "q.D", "pkg", "a.b.C", "Bpkg.", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for p in (r"pkg\.A", r"pkg\.B.*", r".*\.(C|D)", ".*", r".*\.D", "pkg.A", r"(pkg|q)\..*", ".*kg.*"):
        got = {r.w for r in df.where(N.matches(F.col("w"), p)).collect()}
        assert got == {w for w in words if re.fullmatch(p, w)}, p
    assert N.concrete(r"pkg\.A") == ("eq", "pkg.A") and N.concrete(r"pkg\.B.*") == ("prefix", "pkg.B") and N.concrete(r".*\.(C|D)")[0] == "regex"


def test_positions():
    assert N.split_position("arg(1).a.B#f#int[*]") == ("arg", 1, [".f", "[*]"])
    assert N.split_position("arg(*)") == ("arg", None, []) and N.split_position("this.*") == ("this", None, [".*"]) and N.split_position("result")[0] == "result"
    for bad in ("args", "this.f", "arg(x)"):
        with pytest.raises(ValueError):
            N.split_position(bad)


def test_inner_classes_match_with_dots(spark):
    df = spark.createDataFrame([("a.B$C",), ("a.B",)], "w string")
    assert [r.w for r in df.where(N.matches_name(F.col("w"), simple="a.B.C")).collect()] == ["a.B$C"]
    assert df.where(N.matches_name(F.col("w"), simple="*")).count() == 2
