"""Flow graphs: dominators, loops, blocks, components, orders, and data-flow problems as fixpoints over edges(g, src, dst).

g names the graph (a method); all graphs are worked on at once. Dominators, loops and strongly connected components of graphs of
at most SMALL edges are found graph by graph in Python workers, in one pass over edges sorted by graph: no rounds, and nothing that
grows with the number of graphs on the driver. Larger graphs, and those with nulls, go through fixpoints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..runtime import closed, saved

#: Edges (and other rows) of a graph up to which one task works on it as a whole.
SMALL = 2048
#: Result rows that a worker sends on together.
SENT = 50_000


def _marked(*kinds: DataFrame) -> DataFrame:
    """Rows (g, src, dst) with kind: which of the relations they are from."""
    out = kinds[0].select("g", "src", "dst", F.lit(0).alias("kind"))
    for k, rows in enumerate(kinds[1:], 1):
        out = out.unionAll(rows.select("g", "src", "dst", F.lit(k)))
    return out


def _wide(rows: DataFrame) -> DataFrame | None:
    """(g): graphs that are no work for one task; None if there are none."""
    odd = F.col("g").isNull() | F.col("src").isNull() | ((F.col("kind") == 0) & F.col("dst").isNull())
    wide = saved(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(odd).alias("odd")).where(F.col("odd") | (F.col("n") > SMALL)).select(F.col("g").alias("__w")), "wide")
    return wide if wide.limit(1).count() else None


def _of(rows: DataFrame, wide: DataFrame, how: str) -> DataFrame:
    return rows.join(wide, F.col("g").eqNullSafe(F.col("__w")), how)


def _each(rows: DataFrame, work: Callable[[list[tuple]], Iterable[tuple]], names: list[str]) -> DataFrame:
    """(g, *names): work([(src, dst, kind)]) of each graph."""
    import pyarrow as pa

    size = SENT
    kinds = [rows.schema["g"].dataType] + [rows.schema["src"].dataType] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(got: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), types)], names=["g", *names])

        def graphs() -> Iterator[tuple]:
            now, mine = None, []
            for b in batches:
                types[:] = [b.schema.field(0).type] + [b.schema.field(1).type] * len(names)
                for g, *row in zip(*(c.to_pylist() for c in b.columns)):
                    if g != now and mine:
                        yield now, mine
                        mine = []
                    now = g
                    mine.append(row)
            if mine:
                yield now, mine

        types: list[pa.DataType] = []
        got: list[tuple] = []
        for g, mine in graphs():
            for row in work(mine):
                got.append((g, *row))
                if len(got) >= size:
                    yield sent(got)
                    got = []
        if got:
            yield sent(got)

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, StructType([StructField(n, k) for n, k in zip(["g", *names], kinds)]))


def _dominated(rows: list[tuple]) -> Iterator[tuple]:
    """(node, dom) of a graph; rows of kind 1 are entries. Sets of dominators are bits, met over predecessors until they stand."""
    after: dict = {}
    for s, d, kind in rows:
        if not kind:
            after.setdefault(s, []).append(d)
    entries = list(dict.fromkeys(s for s, _, kind in rows if kind))
    seen, post = set(), []
    for e in entries:
        if e in seen:
            continue
        seen.add(e)
        stack = [(e, iter(after.get(e, ())))]
        while stack:
            node, rest = stack[-1]
            for d in rest:
                if d not in seen:
                    seen.add(d)
                    stack.append((d, iter(after.get(d, ()))))
                    break
            else:
                post.append(node)
                stack.pop()
    nodes = post[::-1]
    at = {n: i for i, n in enumerate(nodes)}
    before: list[list[int]] = [[] for _ in nodes]
    for n, i in at.items():
        for d in after.get(n, ()):
            before[at[d]].append(i)
    every = (1 << len(nodes)) - 1
    doms = [every] * len(nodes)
    for e in entries:
        doms[at[e]] = 1 << at[e]
        before[at[e]] = []
    moving = True
    while moving:
        moving = False
        for i, come in enumerate(before):
            if come:
                m = every
                for p in come:
                    m &= doms[p]
                m |= 1 << i
                moving |= m != doms[i]
                doms[i] = m
    for n, m in zip(nodes, doms):
        while m:
            low = m & -m
            yield n, nodes[low.bit_length() - 1]
            m ^= low


def _bodies(rows: list[tuple]) -> Iterator[tuple]:
    """(head, node) of a graph; rows of kind 1 are its back edges."""
    before: dict = {}
    for s, d, kind in rows:
        if not kind:
            before.setdefault(d, []).append(s)
    heads: dict = {}
    for s, d, kind in rows:
        if kind:
            heads.setdefault(d, []).append(s)
    for head, stack in heads.items():
        body = {head, *stack}
        while stack:
            node = stack.pop()
            if node != head:
                more = [s for s in before.get(node, ()) if s not in body]
                body.update(more)
                stack.extend(more)
        for node in body:
            yield head, node


def _strong(rows: list[tuple]) -> Iterator[tuple]:
    """(node, scc) of a graph, by Tarjan's algorithm without recursion."""
    after: dict = {}
    for s, d, _ in rows:
        after.setdefault(s, []).append(d)
        after.setdefault(d, [])
    number: dict = {}
    low: dict = {}
    open_, path = set(), []
    for root in after:
        if root in number:
            continue
        stack = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        open_.add(root)
        path.append(root)
        while stack:
            node, rest = stack[-1]
            for d in rest:
                if d not in number:
                    number[d] = low[d] = len(number)
                    open_.add(d)
                    path.append(d)
                    stack.append((d, iter(after[d])))
                    break
                if d in open_:
                    low[node] = min(low[node], number[d])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    own = path[path.index(node) :] if path[-1] != node else [node]
                    del path[-len(own) :]
                    open_.difference_update(own)
                    least = min(own)
                    for n in own:
                        yield n, least


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(g, node): nodes reachable from seeds(g, node), those included."""
    e = edges.select(F.col("g").alias("__g"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
    rows = closed(seeds.select("g", "node"), lambda new, n: new.join(e, (F.col("g") == F.col("__g")) & (F.col("node") == F.col("__s"))).select("g", F.col("__d").alias("node")), None, max_depth)
    return rows


def reach_pairs(edges: DataFrame) -> DataFrame:
    """(g, a, b): b can be reached from a by one edge or more."""
    e = edges.select(F.col("g").alias("__g"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
    seed = edges.select("g", F.col("src").alias("a"), F.col("dst").alias("b"))
    rows = closed(seed, lambda new, n: new.join(e, (F.col("g") == F.col("__g")) & (F.col("b") == F.col("__s"))).select("g", "a", F.col("__d").alias("b")))
    return rows


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"))


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(g, node, dom): dom is on every path from the graph's entry to node.

    Nodes that no path reaches have no rows.
    """
    edges, entries = saved(edges.select("g", "src", "dst"), "edges"), saved(entries.select("g", "node"), "entries")
    rows = _marked(edges, entries.select("g", F.col("node").alias("src"), F.col("node").alias("dst")))
    wide = _wide(rows)
    if wide is None:
        return saved(_each(rows, _dominated, ["node", "dom"]), "doms")
    small = _each(_of(rows, wide, "left_anti"), _dominated, ["node", "dom"])
    return saved(small.unionByName(_dominators_wide(_of(edges, wide, "left_semi"), _of(entries, wide, "left_semi"))), "doms")


def _dominators_wide(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """dominators() by fixpoints: d fails to dominate n if n is reached without passing d; for each d, nodes reached that way, then
    an anti join."""
    live = reach(edges, entries)
    e = edges.select(F.col("g").alias("__g"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
    starts = live.select("g", F.col("node").alias("cut")).join(entries.select("g", "node"), "g").where("node <> cut")
    avoiding = closed(
        starts.select("g", "cut", "node"),
        lambda new, n: new.join(e, (F.col("g") == F.col("__g")) & (F.col("node") == F.col("__s")) & (F.col("__d") != F.col("cut"))).select("g", "cut", F.col("__d").alias("node")),
    )
    pairs = live.join(live.select("g", F.col("node").alias("dom")), "g")
    return pairs.join(avoiding.withColumnRenamed("cut", "dom"), ["g", "dom", "node"], "left_anti").select("g", "node", "dom")


def immediate_dominators(doms: DataFrame) -> DataFrame:
    """(g, node, idom): the strict dominator with most dominators of its own."""
    depth = doms.groupBy("g", "node").agg(F.count(F.lit(1)).alias("depth"))
    strict = doms.where("node <> dom").join(depth.select("g", F.col("node").alias("dom"), "depth").hint("merge"), ["g", "dom"])
    return strict.groupBy("g", "node").agg(F.max_by("dom", "depth").alias("idom"))


def loops(edges: DataFrame, doms: DataFrame) -> DataFrame:
    """(g, head, node): bodies of natural loops; back edges to one head make one loop."""
    edges = saved(edges.select("g", "src", "dst"), "edges")
    back = saved(edges.join(doms.select("g", F.col("node").alias("src"), F.col("dom").alias("dst")).hint("merge"), ["g", "src", "dst"], "left_semi"), "back")
    rows = _marked(edges, back)
    wide = _wide(rows)
    if wide is None:
        return _each(rows, _bodies, ["head", "node"])
    small = _each(_of(rows, wide, "left_anti"), _bodies, ["head", "node"])
    return small.unionByName(_loops_wide(_of(edges, wide, "left_semi"), _of(back, wide, "left_semi")))


def _loops_wide(edges: DataFrame, back: DataFrame) -> DataFrame:
    """loops() of back edges by a fixpoint."""
    e = edges.select(F.col("g").alias("__g"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
    seed = back.select("g", F.col("dst").alias("head"), F.col("src").alias("node")).unionByName(back.select("g", F.col("dst").alias("head"), F.col("dst").alias("node")))
    body = closed(seed, lambda new, n: new.where("node <> head").join(e, (F.col("g") == F.col("__g")) & (F.col("node") == F.col("__d"))).select("g", "head", F.col("__s").alias("node")))
    return body


def loop_exits(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """(g, head, node): nodes of a loop with an edge out of it."""
    out = bodies.join(edges, (bodies["g"] == edges["g"]) & (bodies["node"] == edges["src"])).select(bodies["g"], "head", "node", "dst")
    inside = bodies.select("g", "head", F.col("node").alias("dst"))
    return out.join(inside, ["g", "head", "dst"], "left_anti").select("g", "head", "node").distinct()


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, node, block): basic blocks of nodes(g, node) numbered in order; block is its first node.

    Leaders: the first node, targets of jumps, nodes after a jump or a fork, nodes with several predecessors.
    """
    out_n = edges.groupBy("g", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.max("dst").alias("to"))
    in_n = edges.groupBy("g", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("frm"))
    w = Window.partitionBy("g").orderBy("node")
    rows = nodes.join(out_n, ["g", "node"], "left").join(in_n, ["g", "node"], "left").withColumns({"before": F.lag("node").over(w), "b_outs": F.lag("outs").over(w), "b_to": F.lag("to").over(w)})
    leader = F.col("before").isNull() | ~F.coalesce((F.col("ins") == 1) & (F.col("frm") == F.col("before")) & (F.col("b_outs") == 1) & (F.col("b_to") == F.col("node")), F.lit(False))
    return rows.select("g", "node", F.last(F.when(leader, F.col("node")), True).over(w).alias("block"))


def components(edges: DataFrame) -> DataFrame:
    """(g, node, scc): strongly connected components named by their smallest node; single nodes without a cycle are their own."""
    edges = saved(edges.select("g", "src", "dst"), "edges")
    rows = _marked(edges)
    wide = _wide(rows)
    if wide is None:
        return _each(rows, _strong, ["node", "scc"])
    return _each(_of(rows, wide, "left_anti"), _strong, ["node", "scc"]).unionByName(_components_wide(_of(edges, wide, "left_semi")))


def _components_wide(edges: DataFrame) -> DataFrame:
    """components() from all pairs that reach each other."""
    pairs = reach_pairs(edges)
    both = pairs.join(pairs.select("g", F.col("a").alias("b"), F.col("b").alias("a")), ["g", "a", "b"], "left_semi")
    nodes = edges.select("g", F.col("src").alias("node")).unionByName(edges.select("g", F.col("dst").alias("node"))).distinct()
    least = both.groupBy("g", F.col("a").alias("node")).agg(F.min("b").alias("low"))
    return nodes.join(least, ["g", "node"], "left").select("g", "node", F.least(F.coalesce("low", "node"), F.col("node")).alias("scc"))


def levels(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(g, node, level): longest path to a node over edges that go forward (src < dst); a topological order."""
    fwd = edges.where("src < dst").select(F.col("g").alias("__g"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
    nodes = edges.select("g", F.col("src").alias("node")).unionByName(edges.select("g", F.col("dst").alias("node"))).distinct()
    heads = nodes.join(fwd.select(F.col("__g").alias("g"), F.col("__d").alias("node")).distinct(), ["g", "node"], "left_anti")
    seed = heads.select("g", "node", F.lit(0).alias("level"))
    # The set of (node, length of some path) is finite on forward edges; the level is the longest.
    rows = closed(seed, lambda new, n: new.join(fwd, (F.col("g") == F.col("__g")) & (F.col("node") == F.col("__s"))).select("g", F.col("__d").alias("node"), (F.col("level") + 1).alias("level")), None, max_depth)
    return rows.groupBy("g", "node").agg(F.max("level").alias("level"))


def flow(edges: DataFrame, gen: DataFrame, kill: DataFrame, forward: bool = True) -> DataFrame:
    """(g, node, fact): facts that hold before a node (after it, if backward); may analysis with union at joins.

    gen(g, node, fact) start at a node; kill(g, node, fact) end there. Both are given relations, so the step is monotone.
    """
    e = edges if forward else reversed_edges(edges)
    e = e.select(F.col("g").alias("__g"), F.col("src").alias("__s"), F.col("dst").alias("__d"))

    def over(rows: DataFrame) -> DataFrame:
        return rows.join(e, (F.col("g") == F.col("__g")) & (F.col("node") == F.col("__s"))).select("g", F.col("__d").alias("node"), "fact")

    dead = kill.select("g", "node", "fact").distinct()
    rows = closed(over(gen.select("g", "node", "fact")), lambda new, n: over(new.join(dead, ["g", "node", "fact"], "left_anti")))
    return rows


def reaching_definitions(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """(g, node, var, at): definitions defs(g, node, var) made at `at` that may hold before node."""
    e = edges.select(F.col("g").alias("__g"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
    d = defs.select(F.col("g").alias("__kg"), F.col("node").alias("__kn"), F.col("var").alias("__kv")).distinct()

    def over(rows: DataFrame) -> DataFrame:
        return rows.join(e, (F.col("g") == F.col("__g")) & (F.col("node") == F.col("__s"))).select("g", F.col("__d").alias("node"), "var", "at")

    def step(new: DataFrame, n: int) -> DataFrame:
        return over(new.join(d, (F.col("g") == F.col("__kg")) & (F.col("node") == F.col("__kn")) & (F.col("var") == F.col("__kv")), "left_anti"))

    rows = closed(over(defs.select("g", "node", "var", F.col("node").alias("at"))), step)
    return rows


def live_variables(edges: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(g, node, var): variables read later before they are written again, as seen before a node."""
    after = flow(edges, uses.select("g", "node", F.col("var").alias("fact")), defs.select("g", "node", F.col("var").alias("fact")), forward=False)
    kept = after.join(defs.select("g", "node", F.col("var").alias("fact")), ["g", "node", "fact"], "left_anti")
    return kept.unionByName(uses.select("g", "node", F.col("var").alias("fact"))).distinct().withColumnRenamed("fact", "var")


def null_states(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(g, node, var, state): backward assumption NULL or NON_NULL from known(g, node, var, state), UNKNOWN where paths differ."""
    facts = flow(edges, known.select("g", "node", F.struct("var", "state").alias("fact")), known.select("g", "node", F.struct("var", "state").alias("fact")).limit(0), forward=False)
    return facts.select("g", "node", "fact.*").groupBy("g", "node", "var").agg(F.when(F.count_distinct("state") == 1, F.first("state")).otherwise("UNKNOWN").alias("state"))


def connected(edges: DataFrame) -> DataFrame:
    """(g, node, root): undirected components by smallest label, as aliases that are merged; edges(g, src, dst)."""
    both = saved(edges.unionByName(reversed_edges(edges)).where("src <> dst").distinct(), "both")
    nodes = edges.select("g", F.col("src").alias("node")).unionByName(edges.select("g", F.col("dst").alias("node"))).distinct()
    label = saved(nodes.withColumn("root", F.col("node")), "labels")
    while True:
        near = both.join(label.select("g", F.col("node").alias("src"), F.col("root").alias("r")), ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(F.min("r").alias("r"))
        step = label.join(near, ["g", "node"], "left").select("g", "node", F.least("root", F.coalesce("r", "root")).alias("root"))
        step = saved(step, "labels")
        hop = step.select("g", F.col("node").alias("root"), F.col("root").alias("r2"))
        new = saved(step.join(hop, ["g", "root"], "left").select("g", "node", F.least("root", F.coalesce("r2", "root")).alias("root")), "labels")
        changed = new.join(label.withColumnRenamed("root", "old"), ["g", "node"]).where("root <> old").limit(1).count()
        label = new
        if not changed:
            return label
