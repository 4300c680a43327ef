"""Names, signatures, positions and matchers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = re.compile(r"[\[\](){}|+?^$*]|\\[^.]|(?<!\\)\.")


def package_of(name: Column) -> Column:
    """'a.b.C' -> 'a.b'; '' without a dot."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise("")


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def join_name(package: Column, name: Column) -> Column:
    return F.when(package == "", name).otherwise(F.concat_ws(".", package, name))


def split_function(name: Column) -> Column:
    """'pkg.Cls#m' -> struct(class, method)."""
    return F.struct(F.substring_index(name, "#", 1).alias("class"), F.regexp_extract(name, r"#(.*)$", 1).alias("method"))


def split_signature(sig: Column) -> Column:
    """'(a, b) r' -> struct(params, returns)."""
    inner = F.trim(F.regexp_extract(sig, r"^\(([^)]*)\)", 1))
    params = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), F.trim))
    return F.struct(params.alias("params"), F.trim(F.regexp_extract(sig, r"\)\s*(.*)$", 1)).alias("returns"))


def split_position(text: str) -> tuple[str, int | None, list[str]]:
    """'arg(1).C#f#T[*]' -> ('arg', 1, ['.f', '[*]']); bases: arg(N), arg(*), any(c), this, result."""
    m = re.match(r"(this|result|arg\((\d+|\*)\)|any\((\w+)\))", text)
    if not m:
        raise ValueError(f"no position: {text!r}")
    base = "arg" if m[1].startswith("arg") else "any" if m[1].startswith("any") else m[1]
    index = int(m[2]) if m[2] and m[2] != "*" else None
    path, rest = [], text[m.end() :]
    while rest:
        if rest.startswith("[*]"):
            path, rest = [*path, "[*]"], rest[3:]
        elif rest.startswith(".*"):
            path, rest = [*path, ".*"], rest[2:]
        elif f := re.match(r"\.([\w.$]+)#(\w+)#([\w.$\[\]]+?)(?=\.|\[\*\]|$)", rest):
            path, rest = [*path, f".{f[2]}"], rest[f.end() :]
        else:
            raise ValueError(f"no position modifier: {rest!r}")
    return base, index, path


def concrete(pattern: str) -> tuple[str, str]:
    """A regular expression as ('eq' | 'prefix' | 'suffix' | 'any' | 'regex', text), the cheapest test that equals it."""
    if pattern in (".*", ".*?"):
        return "any", ""
    body, how = pattern, "eq"
    if body.endswith(".*"):
        body, how = body[:-2], "prefix"
    if body.startswith(".*"):
        body, how = body[2:], "suffix" if how == "eq" else "regex"
    if how == "regex" or _META.search(body):
        return "regex", pattern
    return how, re.sub(r"\\(.)", r"\1", body)


def matches(name: Column, pattern: str) -> Column:
    """Full match of a regular expression, in a form that reaches the scan where there is one."""
    how, text = concrete(pattern)
    if how == "any":
        return name.isNotNull()
    if how == "eq":
        return name == text
    if how == "prefix":
        return name.startswith(text)
    if how == "suffix":
        return name.endswith(text)
    return name.rlike(f"^(?:{text})$")


def matches_name(name: Column, simple: str | None = None, pattern: str | None = None) -> Column:
    """Simple matcher ('*' is any) or pattern; the inner-class sign is also tried as a dot."""
    if simple is not None:
        return name.isNotNull() if simple == "*" else (name == simple) | (F.regexp_replace(name, r"\$", ".") == simple)
    return matches(name, pattern) | matches(F.regexp_replace(name, r"\$", "."), pattern)


def cwe(text: Column) -> Column:
    """Number of 'CWE-79: ...', null without one."""
    return F.when(text.rlike(r"(?i)^CWE-\d+"), F.regexp_extract(text, r"(?i)^CWE-(\d+)", 1).cast("int"))


def route(*parts: Column) -> Column:
    """Path segments joined by one slash each, slashes around them trimmed."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(*[F.regexp_replace(p, "^/+|/+$", "") for p in parts]), lambda x: x != ""), "/"))


def repository_kind(method: Column) -> Column:
    return F.when(method.startswith("save"), "SAVE").when(method.rlike("^(find|read|get)"), "FIND").otherwise("OTHER")


def fingerprint(*parts: Column) -> Column:
    """Base64 of SHA-256 over the parts, one per line."""
    return F.base64(F.unhex(F.sha2(F.concat_ws("\n", *parts), 256)))


def has_flag(access: Column, flag: int) -> Column:
    return access.bitwiseAND(F.lit(flag)) != 0
