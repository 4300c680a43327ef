"""Access paths as arrays of accessors, and exclusion sets as structs (universe, items)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with(path: Column, prefix: Column) -> Column:
    return (F.size(path) >= F.size(prefix)) & (F.slice(path, F.lit(1), F.size(prefix)) == prefix)


def tail(path: Column, n: Column) -> Column:
    return F.slice(path, n + 1, F.greatest(F.size(path) - n, F.lit(0)))


def excluded(items: list[str] | None = None) -> Column:
    """None is the universe."""
    return F.struct(F.lit(items is None).alias("universe"), F.array(*[F.lit(i) for i in items or []]).cast("array<string>").alias("items"))


def contains(excl: Column, accessor: Column) -> Column:
    return excl["universe"] | F.array_contains(excl["items"], accessor)


def united(a: Column, b: Column) -> Column:
    either = a["universe"] | b["universe"]
    return F.struct(either.alias("universe"), F.when(either, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_union(a["items"], b["items"]))).alias("items"))


def subtracted(a: Column, b: Column) -> Column:
    """a without b's accessors; the universe has no such form."""
    items = F.when(a["universe"] | b["universe"], F.raise_error(F.lit("the universe cannot be subtracted"))).otherwise(F.array_sort(F.array_except(a["items"], b["items"])))
    return F.struct(F.lit(False).alias("universe"), items.alias("items"))


def delta(path: Column, initial: Column, excl: Column) -> Column:
    """What of a caller's path is left past a summary's initial path; null where the summary does not apply.

    It applies if the initial path is a prefix and the next accessor, if there is one, is not excluded.
    """
    rest = tail(path, F.size(initial))
    return F.when(starts_with(path, initial) & ((F.size(rest) == 0) | ~contains(excl, F.coalesce(F.get(rest, F.lit(0)), F.lit("")))), rest)


def extended(path: Column, rest: Column, limit: int = 5) -> Column:
    return F.slice(F.concat(path, rest), 1, limit)


def applied(path: Column, excl: Column, initial: Column, final: Column, summary_excl: Column, limit: int = 5) -> Column:
    """Result of a summary initial -> final on a caller's fact: struct(path, universe, items), null where it does not apply."""
    rest = delta(path, initial, summary_excl)
    both = united(excl, summary_excl)
    some = F.size(rest) > 0
    return F.when(rest.isNotNull(), F.struct(extended(final, rest, limit).alias("path"), F.when(some, excl["universe"]).otherwise(both["universe"]).alias("universe"), F.when(some, excl["items"]).otherwise(both["items"]).alias("items")))
