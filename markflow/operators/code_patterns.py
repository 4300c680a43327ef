"""Code patterns in text: '$X = src($A, ...); ... sink($X, "s");' parsed to steps and matched on call rows.

Calls are rows (m, n, callee, result, args): n numbers the statements of m, args are texts, string literals in quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(\.\.\.|\$\w+|"(?:[^"\\]|\\.)*"|-?\d+|[\w.]+|[=(),;])')


@dataclass(frozen=True)
class Step:
    """A call; result and args are metavariables ($X), literals, or '...' for any number of arguments."""

    callee: str
    result: str | None
    args: tuple[str, ...]
    near: bool  # right after the step before, without an ellipsis between


def parse(text: str) -> list[Step]:
    """Steps of a pattern; ValueError for text outside the subset."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    steps, i, near = [], 0, False

    def take(what: str | None = None) -> str:
        nonlocal i
        if i >= len(tokens) or what is not None and tokens[i] != what:
            raise ValueError(f"expected {what or 'more'} in {text!r}")
        i += 1
        return tokens[i - 1]

    while i < len(tokens):
        if tokens[i] == "...":
            i, near = i + 1, False
            continue
        result = None
        if i + 1 < len(tokens) and tokens[i + 1] == "=":
            result = take()
            take("=")
        callee = take()
        if not re.match(r"[\w$]", callee):
            raise ValueError(f"no call: {callee!r}")
        take("(")
        args = []
        while i < len(tokens) and tokens[i] != ")":
            args.append(take())
            if i < len(tokens) and tokens[i] == ",":
                i += 1
        take(")")
        if i < len(tokens):
            take(";")
        if result is not None and not result.startswith("$"):
            raise ValueError(f"only metavariables are assigned: {result!r}")
        steps.append(Step(callee, result, tuple(args), near))
        near = True
    if not steps:
        raise ValueError("no step")
    return steps


def _hits(calls: DataFrame, s: Step) -> tuple[DataFrame, list[str]]:
    """Rows of one step with its metavariables as columns."""
    ok, bound = F.lit(True), {}
    if not s.callee.startswith("$"):
        ok = ok & ((F.col("callee") == s.callee) | F.col("callee").endswith(f".{s.callee}"))
    else:
        bound[s.callee] = F.col("callee")
    same = F.lit(True)
    if s.result:
        ok = ok & F.col("result").isNotNull()
        bound[s.result] = F.col("result")
    dots = s.args.index("...") if "..." in s.args else None
    n = len(s.args)
    ok = ok & (F.size("args") == n if dots is None else F.size("args") >= n - 1)
    for k, a in enumerate(s.args):
        if a == "...":
            continue
        place = F.lit(k) if dots is None or k < dots else F.size("args") - (n - k)
        value = F.get("args", place)
        if not a.startswith("$"):
            ok = ok & (value == a)
        elif a in bound:
            same = same & (bound[a] == value)
        else:
            bound[a] = value
    rows = calls.where(ok).where(same)
    return rows.select("m", "n", *[v.alias(k) for k, v in bound.items()]), list(bound)


def match(calls: DataFrame, steps: list[Step]) -> DataFrame:
    """(m, first, last, one column per metavariable): ordered matches of all steps with equal metavariables."""
    out, names = _hits(calls, steps[0])
    out = out.select("m", F.col("n").alias("first"), F.col("n").alias("last"), *[F.col(f"`{x}`") for x in names])
    for s in steps[1:]:
        hits, more = _hits(calls, s)
        h = hits.select(F.col("m").alias("h_m"), F.col("n").alias("h_n"), *[F.col(f"`{x}`").alias(f"h_{x}") for x in more])
        on = [F.col("m") == F.col("h_m"), (F.col("h_n") == F.col("last") + 1) if s.near else (F.col("h_n") > F.col("last"))]
        on += [F.col(f"`{x}`") == F.col(f"`h_{x}`") for x in more if x in names]
        new = [x for x in more if x not in names]
        out = out.join(h, on).select("m", "first", F.col("h_n").alias("last"), *[F.col(f"`{x}`") for x in names], *[F.col(f"`h_{x}`").alias(x) for x in new])
        names += new
    return out.distinct()


_COMPARE = re.compile(r"^\s*(\$\w+)\s*(==|!=|<=|>=|<|>)\s*(-?\d+)\s*$")


def constrained(matches: DataFrame, metavariable: str | None = None, regex: str | None = None, comparison: str | None = None) -> DataFrame:
    """matches whose metavariable's text matches a regular expression (from its start), or for which '$X > 5' holds."""
    if regex is not None:
        return matches.where(F.col(f"`{metavariable}`").rlike(f"^(?:{regex})"))
    m = _COMPARE.match(comparison or "")
    if not m:
        raise ValueError(f"no comparison: {comparison!r}")
    x, bound = F.col(f"`{m[1]}`").try_cast("bigint"), int(m[3])
    return matches.where({"==": x == bound, "!=": x != bound, "<": x < bound, "<=": x <= bound, ">": x > bound, ">=": x >= bound}[m[2]])


def focused(matches: DataFrame, metavariable: str) -> DataFrame:
    """(m, last, value): matches narrowed to one metavariable."""
    return matches.select("m", "last", F.col(f"`{metavariable}`").alias("value")).distinct()


def taint_mode(calls: DataFrame, sources: list[str], sinks: list[str], sanitizers: list[str] = (), focus: str = "$X") -> DataFrame:
    """(m, n, value): sinks reached by a value that a source pattern bound to `focus` and no sanitizer pattern has had since.

    The value is followed by its text within one method; a later write of it by any call that is no source ends it.
    """
    from .windows import last_before

    def at(patterns: list[str], what: int) -> DataFrame:
        out = None
        for p in patterns:
            x = focused(match(calls, parse(p)), focus).select("m", F.col("last").alias("n"), "value", F.lit(what).alias("what"))
            out = x if out is None else out.unionByName(x)
        return out.distinct()

    marks = at(sources, 2)
    writes = calls.where("result is not null").select("m", "n", F.col("result").alias("value"), F.lit(0).alias("what")).join(marks.select("m", "n", "value"), ["m", "n", "value"], "left_anti")
    rows = marks.unionByName(at(sinks, 1)).unionByName(writes)
    if sanitizers:
        rows = rows.unionByName(at(list(sanitizers), 0))
    # A call's arguments are read before its result is written.
    rows = rows.withColumn("turn", F.when(F.col("what") == 1, 0).otherwise(1))
    state = last_before(rows, ["m", "value"], ["n", "turn", "what"], F.when(F.col("what") == 2, 1).when(F.col("what") == 0, 0), "marked")
    return state.where("what = 1 and marked = 1").select("m", "n", "value").distinct()
