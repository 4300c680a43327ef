"""Mark propagation: along straight lines by windows, through programs by a fixpoint of joins.

Programs are relations:
  inst(m, n, op, lhs, lhs_path, rhs, rhs_path, callee)   op: assign, call, return, nop; n numbers the method's statements
  flow(m, src, dst)                                      control flow inside a method
  args(m, n, pos, base)                                  actuals of calls: arg0.., this
Facts are (m, init, n, base, path, mark): before statement n of m, base with access path `path` ('.f', '[*]' joined)
carries mark, given that the entry fact `init` holds ('' if it needs none). Facts of a callee are kept by their entry
fact, so one summary serves all callers that bring it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import closed, saved
from .windows import last_before

#: Accessors of a path; longer ones are cut, with what they held kept at the cut.
LIMIT = 3
FACT = ["m", "init", "n", "base", "path", "mark"]


def straight_line(rows: DataFrame, key: list[str], order: list[str], gen: Column, kill: Column, name: str = "marked") -> DataFrame:
    """rows with `name`: whether the key carries the mark before the row; gen sets it, kill clears it, gen first."""
    state = F.when(gen, F.lit(True)).when(kill, F.lit(False))
    return last_before(rows, key, order, state, name).withColumn(name, F.coalesce(name, F.lit(False)))


def accessors(path: Column) -> Column:
    return F.size(F.regexp_extract_all(path, F.lit(r"(\.[^.\[]+|\[\*\])"), F.lit(1)))


def limited(path: Column, k: int = LIMIT) -> Column:
    """The first k accessors of a path, at most two elements in a row."""
    path = F.regexp_replace(path, r"(\[\*\]){3,}", "[*][*]")
    return F.regexp_extract(path, r"^((?:\.[^.\[]+|\[\*\]){0," + str(k) + "})", 1)


def _cut(path: Column, prefix: Column) -> Column:
    """What is left of path after prefix, null if it does not start with it at an accessor's end."""
    rest = F.substr(path, F.length(prefix) + 1)
    return F.when(F.startswith(path, prefix) & ((rest == "") | rest.rlike(r"^[.\[]")), rest)


class Rules:
    """Rule relations by callee: sources and sinks (callee, pos, mark), cleaners (callee, pos, mark or '*'), passes (callee, src, dst).

    pos: result, this or argN. sinks with a group of several marks need them all: (callee, pos, mark, sink_id, need).
    """

    def __init__(self, sources: DataFrame, sinks: DataFrame, cleaners: DataFrame, passes: DataFrame):
        self.sources, self.sinks, self.cleaners, self.passes = sources, sinks, cleaners, passes


def _actuals(inst: DataFrame, args: DataFrame) -> DataFrame:
    """(m, n, callee, pos, base, at_path): actuals of each call, its result variable included."""
    calls = inst.where("op = 'call'")
    named = args.join(calls.select("m", "n", "callee"), ["m", "n"]).select("m", "n", "callee", "pos", "base", F.lit("").alias("at_path"))
    return named.unionByName(calls.where("lhs is not null").select("m", "n", "callee", F.lit("result").alias("pos"), F.col("lhs").alias("base"), F.coalesce("lhs_path", F.lit("")).alias("at_path")))


def propagate(inst: DataFrame, flow: DataFrame, args: DataFrame, rules: Rules, known_methods: DataFrame, entries: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All facts(FACT). known_methods(callee) have bodies; entries(m) are where analysis starts; statement 0 is a method's entry.

    Calls: cleaners act first, then passes copy, the facts on actuals enter known callees, facts that reach a return come
    back to the callers that brought their entry fact; the result variable's old facts end. Facts on nothing that the call
    touches go on. Calls of unknown methods keep their facts.
    """
    i = {c: f"i_{c}" for c in inst.columns}
    stmt = inst.select(*[F.col(c).alias(v) for c, v in i.items()])
    nxt = flow.select(F.col("m").alias("f_m"), F.col("src").alias("f_src"), F.col("dst").alias("f_dst"))
    actual = saved(_actuals(inst, args), "actuals").select(*[F.col(c).alias(f"a_{c}") for c in ("m", "n", "callee", "pos", "base", "at_path")])
    bodies = known_methods.select(F.col("callee").alias("k_callee")).distinct()
    lp, rp = F.coalesce("i_lhs_path", F.lit("")), F.coalesce("i_rhs_path", F.lit(""))
    clean = rules.cleaners.select(F.col("callee").alias("c_callee"), F.col("pos").alias("c_pos"), F.col("mark").alias("c_mark"))
    copy = rules.passes.select(F.col("callee").alias("p_callee"), F.col("src").alias("p_src"), F.col("dst").alias("p_dst"))
    formal = F.when(F.col("a_pos") == "result", F.lit(None)).otherwise(F.col("a_pos"))
    # Parts of the step whose relation is empty are left out of its plan.
    deep, cleans, copies = (bool(x.limit(1).count()) for x in (bodies, clean, copy))

    def on(facts: DataFrame) -> DataFrame:
        return facts.join(stmt, (F.col("m") == F.col("i_m")) & (F.col("n") == F.col("i_n")))

    def forward(facts: DataFrame) -> DataFrame:
        return facts.join(nxt, (F.col("m") == F.col("f_m")) & (F.col("n") == F.col("f_src"))).select("m", "init", F.col("f_dst").alias("n"), "base", limited(F.col("path")).alias("path"), "mark")

    def at_actuals(facts: DataFrame) -> DataFrame:
        return facts.join(actual, (F.col("m") == F.col("a_m")) & (F.col("n") == F.col("a_n")) & (F.col("base") == F.col("a_base")))

    def step(new: DataFrame, known: DataFrame, n: int) -> DataFrame:
        here = on(new)
        # A copy of a fact on the right side to the left one; what the left side held before ends, elements excepted.
        moved = here.where("i_op = 'assign'").withColumn("rest", _cut(F.col("path"), rp)).where((F.col("base") == F.col("i_rhs")) & F.col("rest").isNotNull())
        moved = moved.select("m", "init", "n", F.col("i_lhs").alias("base"), F.concat(lp, "rest").alias("path"), "mark")
        over = F.col("i_lhs").isNotNull() & (F.col("base") == F.col("i_lhs")) & F.coalesce(_cut(F.col("path"), lp).isNotNull(), F.lit(False)) & ~lp.contains("[*]")
        itself = (F.col("i_op") == "assign") & (F.col("i_rhs") == F.col("i_lhs")) & (rp == lp)
        stays = here.where(~F.coalesce(over & ~itself, F.lit(False))).where("i_op <> 'return'").select(*FACT, F.col("i_op").alias("op"))
        moved = moved.unionByName(stays.select(FACT)) if not (deep or cleans or copies) else moved
        if not (deep or cleans or copies):
            return forward(moved)
        # Cleaners and passes of calls.
        at_call = at_actuals(here.where("i_op = 'call'").select(FACT))
        wiped = at_call.join(clean, (F.col("a_callee") == F.col("c_callee")) & (F.col("a_pos") == F.col("c_pos")) & ((F.col("c_mark") == "*") | (F.col("mark") == F.col("c_mark")))).select(FACT).distinct()
        clean_call = at_call.join(wiped.select(*[F.col(c).alias(f"w_{c}") for c in FACT]), [F.col(c) == F.col(f"w_{c}") for c in FACT], "left_anti")
        kept = stays.join(wiped.select(*[F.col(c).alias(f"w_{c}") for c in FACT]), [F.col(c) == F.col(f"w_{c}") for c in FACT], "left_anti").select(FACT)
        to = actual.select(F.col("a_m").alias("t_m"), F.col("a_n").alias("t_n"), F.col("a_pos").alias("t_pos"), F.col("a_base").alias("t_base"), F.col("a_at_path").alias("t_path"))
        passed = clean_call.join(copy, (F.col("a_callee") == F.col("p_callee")) & (F.col("a_pos") == F.col("p_src")))
        passed = passed.join(to, (F.col("m") == F.col("t_m")) & (F.col("n") == F.col("t_n")) & (F.col("p_dst") == F.col("t_pos")))
        passed = passed.select("m", "init", "n", F.col("t_base").alias("base"), F.concat("t_path", "path").alias("path"), "mark")
        flat = moved.unionByName(kept).unionByName(passed) if copies else moved.unionByName(kept)
        if not deep:
            return forward(flat)
        # Facts on actuals enter known callees under their own name as entry fact.
        enter = clean_call.where(formal.isNotNull()).join(bodies, F.col("a_callee") == F.col("k_callee"))
        name = F.concat_ws("|", "a_pos", "path", "mark")
        entered = enter.select(F.col("a_callee").alias("m"), name.alias("init"), F.lit(0).alias("n"), F.col("a_pos").alias("base"), "path", "mark")
        # Facts at returns (new ones with all calls known, all with new calls) come back to callers.
        def exits(f: DataFrame) -> DataFrame:
            r = on(f).where("i_op = 'return'")
            value = r.where((F.col("base") == F.col("i_rhs")) & (F.col("init") != "")).select(F.col("m").alias("x_m"), F.col("init").alias("x_init"), F.lit("result").alias("x_pos"), F.col("path").alias("x_path"), F.col("mark").alias("x_mark"))
            heap = r.where(F.col("base").rlike("^(this|arg[0-9]+)$") & (F.col("path") != "") & (F.col("init") != "")).select(F.col("m").alias("x_m"), F.col("init").alias("x_init"), F.col("base").alias("x_pos"), F.col("path").alias("x_path"), F.col("mark").alias("x_mark"))
            return value.unionByName(heap)

        def sourced(f: DataFrame) -> DataFrame:
            """Marks made inside a callee without any entry fact come back to every caller."""
            r = on(f).where("i_op = 'return'").where((F.col("base") == F.col("i_rhs")) & (F.col("init") == ""))
            back = r.select(F.col("m").alias("x_m"), F.col("path").alias("x_path"), F.col("mark").alias("x_mark"))
            met = back.join(actual.where("a_pos = 'result'"), F.col("x_m") == F.col("a_callee"))
            return met.select(F.col("a_m").alias("m"), F.lit("").alias("init"), F.col("a_n").alias("n"), F.col("a_base").alias("base"), F.concat("a_at_path", "x_path").alias("path"), F.col("x_mark").alias("mark"))

        def returned(callers: DataFrame, ends: DataFrame) -> DataFrame:
            met = callers.join(ends, (F.col("a_callee") == F.col("x_m")) & (name == F.col("x_init")))
            met = met.join(to, (F.col("m") == F.col("t_m")) & (F.col("n") == F.col("t_n")) & (F.col("x_pos") == F.col("t_pos")))
            return met.select("m", "init", "n", F.col("t_base").alias("base"), F.concat("t_path", "x_path").alias("path"), F.col("x_mark").alias("mark"))

        before = at_actuals(on(known).where("i_op = 'call'").select(FACT)).where(formal.isNotNull())
        before = before.join(clean, (F.col("a_callee") == F.col("c_callee")) & (F.col("a_pos") == F.col("c_pos")) & ((F.col("c_mark") == "*") | (F.col("mark") == F.col("c_mark"))), "left_anti")
        back = returned(enter.drop("k_callee"), exits(known)).unionByName(returned(before, exits(new))).unionByName(sourced(new))
        return forward(flat.unionByName(back)).unionByName(entered)

    made = rules.sources.select(F.col("callee").alias("s_callee"), F.col("pos").alias("s_pos"), F.col("mark").alias("s_mark"))
    seed = actual.join(made, (F.col("a_callee") == F.col("s_callee")) & (F.col("a_pos") == F.col("s_pos")))
    seed = forward(seed.select(F.col("a_m").alias("m"), F.lit("").alias("init"), F.col("a_n").alias("n"), F.col("a_base").alias("base"), F.col("a_at_path").alias("path"), F.col("s_mark").alias("mark")))
    rows = closed(seed, step, None, max_rounds)
    return rows


def findings(facts: DataFrame, inst: DataFrame, args: DataFrame, sinks: DataFrame) -> DataFrame:
    """(sink_id, m, n): calls at which all marks that a sink needs are there; once per sink and statement.

    sinks(sink_id, callee, pos, mark, need): need counts the (pos, mark) pairs of the sink.
    """
    actual = _actuals(inst, args).select(*[F.col(c).alias(f"a_{c}") for c in ("m", "n", "callee", "pos", "base")])
    at = facts.join(actual, (F.col("m") == F.col("a_m")) & (F.col("n") == F.col("a_n")) & (F.col("base") == F.col("a_base")))
    s = sinks.select("sink_id", F.col("callee").alias("s_callee"), F.col("pos").alias("s_pos"), F.col("mark").alias("s_mark"), "need")
    met = at.join(s, (F.col("a_callee") == F.col("s_callee")) & (F.col("a_pos") == F.col("s_pos")) & (F.col("mark") == F.col("s_mark")))
    got = met.groupBy("sink_id", "m", "n", "need").agg(F.count_distinct("s_pos", "s_mark").alias("got"))
    return got.where("got = need").select("sink_id", "m", "n")


def shortest_trace(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(sink, node, level): nodes on shortest paths from sources(node) to sinks(node) over edges(src, dst), by level.

    Forward levels from all sources by a fixpoint, then backward from each sink over edges that go one level down.
    """
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    seed = sources.select("node", F.lit(0).alias("level"))
    levels = closed(seed, lambda new, n: new.join(e, F.col("node") == F.col("__s")).select(F.col("__d").alias("node"), (F.col("level") + 1).alias("level")), ["node"], max_depth)
    at = levels.select(F.col("node").alias("__n"), F.col("level").alias("__l"))
    ends = sinks.join(levels, "node").select(F.col("node").alias("sink"), "node", "level")
    back = closed(
        ends,
        lambda new, n: new.join(e, F.col("node") == F.col("__d")).join(at, (F.col("__s") == F.col("__n")) & (F.col("__l") == F.col("level") - 1)).select("sink", F.col("__s").alias("node"), F.col("__l").alias("level")),
        None, max_depth,
    )
    return back


def confirmed(provisional: DataFrame, edges: DataFrame, ends: DataFrame, cleaned: DataFrame) -> DataFrame:
    """provisional(finding, node) with `state`: CONFIRMED if some path over edges(src, dst) reaches ends(node) without cleaned(node)."""
    e = edges.join(cleaned.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    rows = closed(provisional.select("finding", "node"), lambda new, n: new.join(e, F.col("node") == F.col("__s")).select("finding", F.col("__d").alias("node")))
    ok = rows.join(ends.select("node").distinct(), "node", "left_semi").select("finding").distinct().withColumn("__ok", F.lit(True))
    return provisional.select("finding").distinct().join(ok, "finding", "left").select("finding", F.when(F.col("__ok"), "CONFIRMED").otherwise("UNCONFIRMED").alias("state"))
