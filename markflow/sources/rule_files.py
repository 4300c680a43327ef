"""Rule and project files (YAML) as rows; what cannot be read becomes an issue, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.conditions import requires
from ..functions.names import concrete, split_position

KINDS = ("entryPoint", "source", "sink", "passThrough", "cleaner", "methodExitSink")
_RULES = "rule_id string, kind string, class string, method string, how_class string, how_method string, mark string, froms array<string>, tos array<string>, cwe array<int>, overrides boolean"
_ISSUES = "file string, rule_id string, problem string"


def load_taint_config(spark: SparkSession, text: str, file: str = "") -> tuple[DataFrame, DataFrame]:
    """(rules, issues) of a taint configuration: lists of rules by kind, functions as 'pkg.Cls#m' or {package, class, name}."""
    import yaml

    rules, issues = [], []
    try:
        doc = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        doc, issues = {}, [(file, None, f"no YAML: {e.__class__.__name__}")]
    for kind in KINDS:
        for n, r in enumerate(doc.get(kind) or []):
            name = str(r.get("id", f"{kind}-{n}")) if isinstance(r, dict) else f"{kind}-{n}"
            try:
                f = r["function"]
                if isinstance(f, str):
                    cls, _, method = f.partition("#")
                    hc, c, hm, m = "eq", cls, *(("any", "") if method in ("", "*") else ("eq", method))
                else:
                    pick = lambda x, sep="": concrete(x["pattern"]) if isinstance(x, dict) else ("any", "") if x in (None, "*") else ("eq", x)
                    (hp, p), (hk, k), (hm, m) = pick(f.get("package")), pick(f.get("class")), pick(f.get("name"))
                    hc, c = ("eq", f"{p}.{k}") if (hp, hk) == ("eq", "eq") else ("regex", ".*" if hp == hk == "any" else rf"{p if hp != 'any' else '.*'}\.{k if hk != 'any' else '.*'}")
                acts = r.get("copy") or r.get("taint") or r.get("cleans") or []
                froms, tos = [str(a["from"]) for a in acts if "from" in a], [str(a["to"]) for a in acts if "to" in a] + [str(a["pos"]) for a in acts if "pos" in a]
                for p in (*froms, *tos):
                    split_position(p)
                marks = {str(a["kind"]) for a in acts if "kind" in a}
                rules.append((name, kind, c, m, hc, hm, ",".join(sorted(marks)) or None, froms, tos, [int(x) for x in r["cwe"]] if r.get("cwe") else None, bool(r.get("overrides", True))))
            except (KeyError, TypeError, ValueError, AttributeError) as e:
                issues.append((file, name, f"{e.__class__.__name__}: {e}"))
    return spark.createDataFrame(rules, _RULES), spark.createDataFrame(issues, _ISSUES)


def load_pattern_rules(spark: SparkSession, text: str, file: str = "", severities: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, dict[str, tuple]]:
    """(rules, issues, formulas by id) of a pattern rule set: pattern, patterns, pattern-either, -not, -inside, -not-inside,
    modes search, taint and join, options disabled, lib and overrides, severities.
    """
    import yaml

    rows, issues, formulas = [], [], {}
    try:
        doc = (yaml.safe_load(text) or {}).get("rules") or []
    except yaml.YAMLError as e:
        doc, issues = [], [(file, None, f"no YAML: {e.__class__.__name__}")]
    replaced = {(r.get("options") or {}).get("overrides") for r in doc} - {None}
    for r in doc:
        name, options = str(r.get("id")), r.get("options") or {}
        if "disabled" in options or name in replaced or severities is not None and r.get("severity") not in severities:
            continue
        try:
            mode = r.get("mode", "search")
            if mode == "search":
                formulas[name] = formula(r)
            elif mode == "taint":
                for s in (*r["pattern-sources"], *r["pattern-sinks"], *r.get("pattern-sanitizers", []), *r.get("pattern-propagators", [])):
                    if isinstance(s.get("requires"), str):
                        requires(s["requires"])
                formulas[name] = ("taint", [formula(s) for s in r["pattern-sources"]], [formula(s) for s in r["pattern-sinks"]], [formula(s) for s in r.get("pattern-sanitizers", [])])
            elif mode == "join":
                join = r["join"]
                ons = [x.split() for x in (join["on"] if "on" in join else join[True])]  # YAML 1.1 reads a bare `on` as true
                if any(len(x) != 3 or x[1] != "->" for x in ons) or len({x[2].split(".")[0] for x in ons}) != 1:
                    raise ValueError("only a -> b with one right side")
                formulas[name] = ("join", [(x[0], x[2]) for x in ons])
            else:
                raise ValueError(f"mode {mode!r}")
            rows.append((name, mode, r.get("severity"), r.get("message"), bool(options.get("lib")), [str(x) for x in (r.get("metadata") or {}).get("cwe", [])]))
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            issues.append((file, name, f"{e.__class__.__name__}: {e}"))
    return spark.createDataFrame(rows, "rule_id string, mode string, severity string, message string, lib boolean, cwe array<string>"), spark.createDataFrame(issues, _ISSUES), formulas


def formula(r: dict) -> tuple:
    """A rule's pattern part as nested tuples."""
    if "pattern" in r:
        return ("pattern", r["pattern"])
    if "patterns" in r:
        return ("and", *[formula(x) for x in r["patterns"]])
    if "pattern-either" in r:
        return ("either", *[formula(x) for x in r["pattern-either"]])
    if "pattern-not" in r:
        return ("not", ("pattern", r["pattern-not"]))
    if "pattern-inside" in r:
        x = r["pattern-inside"]
        return ("inside", formula(x) if isinstance(x, dict) else ("pattern", x))
    if "pattern-not-inside" in r:
        return ("not", ("inside", ("pattern", r["pattern-not-inside"])))
    if "pattern-regex" in r:
        return ("regex", r["pattern-regex"])
    if "pattern-not-regex" in r:
        return ("not", ("regex", r["pattern-not-regex"]))
    if "metavariable-regex" in r:
        return ("where", r["metavariable-regex"]["metavariable"], ("regex", r["metavariable-regex"]["regex"]))
    if "metavariable-pattern" in r:
        x = r["metavariable-pattern"]
        return ("where", x["metavariable"], formula({k: v for k, v in x.items() if k != "metavariable"}))
    if "focus-metavariable" in r:
        return ("focus", r["focus-metavariable"])
    raise ValueError(f"no pattern in {sorted(r)}")


def load_project(text: str) -> dict:
    """A project model: source root, modules with packages and classes, dependencies, sub-projects (read the same way)."""
    import yaml

    doc = yaml.safe_load(text) or {}
    modules = [{"path": m.get("path"), "packages": list(m.get("packages") or []), "classes": list(m.get("classes") or [])} for m in doc.get("modules") or []]
    subs = [load_project(yaml.safe_dump(s)) for s in doc.get("subProjects") or []]
    return {"source_root": doc.get("sourceRoot"), "modules": modules, "dependencies": list(doc.get("dependencies") or []), "sub_projects": subs}
