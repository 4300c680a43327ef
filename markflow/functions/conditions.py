"""Condition trees: built simplified, normalised, and compiled to one Column."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import matches


@dataclass(frozen=True)
class Cond:
    """op: true, false, not, and, or, or an atom's name; args: operands, or the atom's parameters."""

    op: str
    args: tuple = ()

    def __and__(self, other: Cond) -> Cond:
        return all_of(self, other)

    def __or__(self, other: Cond) -> Cond:
        return any_of(self, other)

    def __invert__(self) -> Cond:
        return negated(self)


TRUE, FALSE = Cond("true"), Cond("false")


def _flat(op: str, neutral: Cond, zero: Cond, args: tuple[Cond, ...]) -> Cond:
    out: list[Cond] = []
    for a in args:
        for x in a.args if a.op == op else (a,):
            if x == zero:
                return zero
            if x != neutral and x not in out:
                out.append(x)
    return neutral if not out else out[0] if len(out) == 1 else Cond(op, tuple(out))


def all_of(*args: Cond) -> Cond:
    return _flat("and", TRUE, FALSE, args)


def any_of(*args: Cond) -> Cond:
    return _flat("or", FALSE, TRUE, args)


def negated(c: Cond) -> Cond:
    return {"true": FALSE, "false": TRUE}.get(c.op) or (c.args[0] if c.op == "not" else Cond("not", (c,)))


def atom(name: str, *args) -> Cond:
    return Cond(name, args)


def nnf(c: Cond, positive: bool = True) -> Cond:
    """Negations only before atoms."""
    if c.op == "not":
        return nnf(c.args[0], not positive)
    if c.op in ("and", "or"):
        both = tuple(nnf(a, positive) for a in c.args)
        return all_of(*both) if (c.op == "and") == positive else any_of(*both)
    return c if positive else negated(c)


def dnf(c: Cond) -> list[frozenset[Cond]]:
    """Cubes of literals whose union is c; contradictions and cubes that another one covers are left out."""
    c = nnf(c)

    def cubes(x: Cond) -> list[frozenset[Cond]]:
        if x == FALSE:
            return []
        if x == TRUE:
            return [frozenset()]
        if x.op == "or":
            return [q for a in x.args for q in cubes(a)]
        if x.op == "and":
            return [frozenset().union(*p) for p in itertools.product(*map(cubes, x.args))]
        return [frozenset([x])]

    found = {q for q in cubes(c) if not any(negated(a) in q for a in q)}
    return sorted((q for q in found if not any(o < q for o in found)), key=repr)


def assumed_true(c: Cond, atoms: set[str]) -> Cond:
    """c with each negated atom of the given names taken as true (facts that may be absent)."""
    c = nnf(c)

    def go(x: Cond) -> Cond:
        if x.op == "not" and x.args[0].op in atoms:
            return TRUE
        if x.op in ("and", "or"):
            return (all_of if x.op == "and" else any_of)(*map(go, x.args))
        return x

    return go(c)


#: Constants are structs (kind, i, b, s): kind is int, bool, string, null or none.
def _const_eq(c: Column, value) -> Column:
    if isinstance(value, bool):
        return F.when(c["kind"] == "bool", c["b"] == value).when(c["kind"] == "int", (c["i"] != 0) == value).otherwise(False)
    if isinstance(value, int):
        return (c["kind"] == "int") & (c["i"] == value)
    return (c["kind"] == "string") & (c["s"] == value)


def _const_order(c: Column, value, less: bool) -> Column:
    if isinstance(value, str):
        raise ValueError("strings have no order here")
    bound = int(value)
    return (c["kind"] == "int") & ((c["i"] < bound) if less else (c["i"] > bound))


ATOMS: dict[str, Callable[..., Column]] = {
    "is_constant": lambda c: c["kind"] != "none",
    "is_null": lambda c: c["kind"] == "null",
    "const_eq": _const_eq,
    "const_lt": lambda c, v: _const_order(c, v, True),
    "const_gt": lambda c, v: _const_order(c, v, False),
    "const_matches": lambda c, p: (c["kind"] == "string") & matches(c["s"], p),
    "type_is": lambda c, t: c == t,
    "type_matches": lambda c, p: matches(c, p),
    "n_args": lambda c, n: F.size(c) == n,
    "has_mark": lambda c, m: F.array_contains(c, m),
    "annotated": lambda c, a: F.exists(c, lambda x: x == a),
}


def compile(c: Cond, operands: dict[str, Column]) -> Column:  # noqa: A001
    """One boolean Column; atoms are (name, operand, parameters...). Null operands make an atom false."""
    if c.op in ("true", "false"):
        return F.lit(c.op == "true")
    if c.op == "not":
        return ~compile(c.args[0], operands)
    if c.op in ("and", "or"):
        out = compile(c.args[0], operands)
        for a in c.args[1:]:
            out = out & compile(a, operands) if c.op == "and" else out | compile(a, operands)
        return out
    operand, *more = c.args
    return F.coalesce(ATOMS[c.op](operands[operand], *more), F.lit(False))


def requires(text: str) -> Cond:
    """'A and not (B or C)' over labels, as a condition on has_mark('labels', label)."""
    tokens = re.findall(r"\(|\)|[\w-]+", text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either() -> Cond:
        out = both()
        while peek() == "or":
            take()
            out = any_of(out, both())
        return out

    def both() -> Cond:
        out = one()
        while peek() == "and":
            take()
            out = all_of(out, one())
        return out

    def one() -> Cond:
        if peek() is None:
            raise ValueError(f"ends early: {text!r}")
        t = take()
        if t == "not":
            return negated(one())
        if t == "(":
            out = either()
            if peek() != ")":
                raise ValueError(f"no closing bracket: {text!r}")
            take()
            return out
        if t in ("and", "or", ")"):
            raise ValueError(f"unexpected {t!r} in {text!r}")
        return atom("has_mark", "labels", t)

    out = either()
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {text!r}")
    return out
