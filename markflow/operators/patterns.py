"""Pattern queries over ordered sequences: formulas over ellipsis patterns, compiled to one automaton, run as an aggregate.

A pattern is a list of symbols and '...' (anything, also nothing). Patterns match anywhere in a sequence. Automata are
small driver data (their size is the rule's); sequences stay in the JVM: each row's symbol is looked up as an ordinal and
`aggregate` folds a key's ordered symbols through the transition table.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dfa:
    """Total automaton over symbols 0..k-1: delta[state][symbol], start 0."""

    k: int
    delta: tuple[tuple[int, ...], ...]
    accept: frozenset[int]

    def accepts(self, word: list[int]) -> bool:
        s = 0
        for c in word:
            s = self.delta[s][c]
        return s in self.accept


def sequence(pattern: list[int | None], k: int, anywhere: bool = True) -> Dfa:
    """Automaton of a pattern of symbols; None is an ellipsis. Built by subsets of pattern positions."""
    parts: list[int | None] = [None, *pattern, None] if anywhere else list(pattern)

    def closed(states: frozenset[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            s = todo.pop()
            if s < len(parts) and parts[s] is None and s + 1 not in out:
                out.add(s + 1)
                todo.append(s + 1)
        return frozenset(out)

    start = closed(frozenset([0]))
    number, todo, delta = {start: 0}, [start], []
    while todo:
        s = todo.pop(0)
        row = []
        for c in range(k):
            t = closed(frozenset([p for p in s if p < len(parts) and parts[p] is None] + [p + 1 for p in s if p < len(parts) and parts[p] == c]))
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            row.append(number[t])
        delta.append(tuple(row))
    return minimal(Dfa(k, tuple(delta), frozenset(n for s, n in number.items() if len(parts) in s)))


def complement(a: Dfa) -> Dfa:
    return Dfa(a.k, a.delta, frozenset(range(len(a.delta))) - a.accept)


def product(a: Dfa, b: Dfa, both: Callable[[bool, bool], bool] = lambda x, y: x and y) -> Dfa:
    number, todo, delta = {(0, 0): 0}, [(0, 0)], []
    while todo:
        s, t = todo.pop(0)
        row = []
        for c in range(a.k):
            u = (a.delta[s][c], b.delta[t][c])
            if u not in number:
                number[u] = len(number)
                todo.append(u)
            row.append(number[u])
        delta.append(tuple(row))
    return minimal(Dfa(a.k, tuple(delta), frozenset(n for (s, t), n in number.items() if both(s in a.accept, t in b.accept))))


def minimal(a: Dfa) -> Dfa:
    """The smallest equal automaton: reachable states only, merged by partition refinement."""
    live, todo = {0}, [0]
    while todo:
        for t in a.delta[todo.pop()]:
            if t not in live:
                live.add(t)
                todo.append(t)
    group = {s: int(s in a.accept) for s in live}
    while True:
        key = {s: (group[s], *[group[t] for t in a.delta[s]]) for s in live}
        names = {v: i for i, v in enumerate(sorted(set(key.values())))}
        new = {s: names[key[s]] for s in live}
        if len(set(new.values())) == len(set(group.values())):
            break
        group = new
    order, todo = {group[0]: 0}, [0]
    delta: list[tuple[int, ...]] = []
    while todo:
        s = todo.pop(0)
        row = []
        for t in a.delta[s]:
            if group[t] not in order:
                order[group[t]] = len(order)
                todo.append(t)
            row.append(order[group[t]])
        delta.append(tuple(row))
    return Dfa(a.k, tuple(delta), frozenset(order[group[s]] for s in live if s in a.accept and group[s] in order))


#: Formulas: ('pattern', [...]), ('and', ...), ('either', ...), ('not', f), ('inside', outer, inner).
def compile_formula(f: tuple, symbols: list[str]) -> Dfa:
    """Automaton of a formula over symbol names; other symbols of a sequence are one more, unnamed, symbol."""
    k = len(symbols) + 1
    ids = {s: i for i, s in enumerate(symbols)}
    op, *args = f
    if op == "pattern":
        return sequence([None if s == "..." else ids[s] for s in args[0]], k)
    if op == "not":
        return minimal(complement(compile_formula(args[0], symbols)))
    if op == "inside":  # the inner pattern at an ellipsis of the outer one; where that has none, between two of its steps
        outer, inner = list(args[0]), list(args[1])
        rooms = [(i, i + 1) for i, s in enumerate(outer) if s == "..."] or [(i, i) for i in range(1, len(outer))]
        if not rooms:
            raise ValueError("a context of one step has no room for a pattern")
        return compile_formula(("either", *[("pattern", [*outer[:i], "...", *inner, "...", *outer[j:]]) for i, j in rooms]), symbols)
    made = [compile_formula(a, symbols) for a in args]
    out = made[0]
    for m in made[1:]:
        out = product(out, m, (lambda x, y: x and y) if op == "and" else (lambda x, y: x or y))
    return out


def run(rows: DataFrame, key: list[str], order: list[str], symbol: Column, dfa: Dfa, symbols: list[str], name: str = "matched") -> DataFrame:
    """(key, matched): whether each key's ordered symbols are accepted.

    A key's symbols are gathered as a string of one character each, so a long sequence costs a byte an element.
    """
    number = F.lit(len(symbols))
    for i, s in enumerate(symbols):
        number = F.when(symbol == s, i).otherwise(number)
    seqs = rows.select(*key, F.struct(*order, number.alias("__c")).alias("e")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["__c"]).alias("w"))
    flat = F.array(*[F.lit(t) for t in itertools.chain(*dfa.delta)])
    end = F.aggregate("w", F.lit(0), lambda s, c: F.element_at(flat, s * dfa.k + c + 1))
    return seqs.select(*key, end.isin(*sorted(dfa.accept)).alias(name) if dfa.accept else F.lit(False).alias(name))


def ordered_pairs(first: DataFrame, then: DataFrame, key: list[str], order: str, shared: list[str]) -> DataFrame:
    """first before then in one sequence, with equal values of the shared metavariables; null ones fit anything."""
    a = first.select(*[F.col(c).alias(f"a_{c}") for c in first.columns])
    b = then.select(*[F.col(c).alias(f"b_{c}") for c in then.columns])
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in key] + [F.col(f"a_{order}") < F.col(f"b_{order}")]
    on += [F.col(f"a_{s}").isNull() | F.col(f"b_{s}").isNull() | (F.col(f"a_{s}") == F.col(f"b_{s}")) for s in shared]
    return a.join(b, on)


def inside(matches: DataFrame, ranges: DataFrame, key: list[str], at: str = "n", negative: bool = False) -> DataFrame:
    """matches whose place lies (does not lie) in some range(key, lo, hi) of its key."""
    r = ranges.select(*[F.col(k).alias(f"r_{k}") for k in key], "lo", "hi")
    on = [F.col(k) == F.col(f"r_{k}") for k in key] + [F.col(at).between(F.col("lo"), F.col("hi"))]
    return matches.join(r, on, "left_anti" if negative else "left_semi")
