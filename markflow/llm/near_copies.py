"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash's files (simhash.links) find the closest pairs, in crowds too, but no distance of 64 bits holds a similarity of 0.8:
pairs at 0.8 differ in about 10 bits, some in 20. So candidates also come from a prefix filter, which loses none: with
all sets sorted by one order, two sets of similarity s share a shingle among the first n - ceil(s n) + 1 of each. The order
puts shingles that are common in a sample of the texts last; the sample bears on cost alone, not on results. A candidate
must pass a bound on the sets' difference: each set has a row of bits, as many as shingles or up to twice that, and each
shingle turns one of them over; what two sets share cancels out, so they differ in at least as many shingles as their rows
of bits differ in places. Every candidate left is confirmed by the exact Jaccard similarity of the two sets of 64-bit
shingle hashes. Texts move for those alone.

A file (the texts with one shingle in their prefix) of up to CROWD members gives all its pairs. The members of a larger one
meet LEADERS of them first; after that, and SimHash's links, only members that are not yet connected, and pass the bound,
are paired. Copies share many files: each member has its FIRST smallest open files with it, and a file leaves a pair to a
smaller one that both have there. So no pair is lost, as the smallest file that two share never leaves them out.

Defined cases: null texts and texts without words are copies of each other; a text of under five words is one shingle.
Nodes are hashes of texts, so rows that repeat a text are one node. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, saved, sized
from .simhash import components, fingerprints, links, standing, standing_only

WORDS = 5
SIMILARITY = 0.8
CROWD = 16
#: Sets of shingles that a task remembers.
KEPT = 64
LEADERS = 4
FIRST = 32
#: One of so many texts is looked at for common shingles; from so many of them on a shingle is common; so many are told apart.
SAMPLE, COMMON, TOLD = 16, 4, 200_000


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes; never empty."""
    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not flat:
        return np.zeros(1, np.uint64)
    buf = np.frombuffer(flat, np.uint8)
    gaps = np.flatnonzero(buf == 32)
    at, end = np.append(0, gaps + 1), np.append(gaps, len(buf))
    if len(at) < WORDS:
        at, end = at[:1], end[-1:]
    else:
        at, end = at[: len(at) - WORDS + 1], end[WORDS - 1 :]
    h = Rolling(buf).of(at, end)
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def prefix(sh: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set, one of which any set of at least that similarity has among its own first."""
    n = len(sh)
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, sh), len(common) - 1)
        count = np.where(common[at] == sh, counts[at], 0)
    return sh[np.lexsort((sh, count))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def parity(sh: np.ndarray) -> np.ndarray:
    """The row of bits that a set of shingles turns over, packed; 64 at least, a power of two."""
    m = max(64, 1 << (len(sh) - 1).bit_length())
    return np.packbits(np.bincount((sh >> np.uint64(7)).astype(np.int64) & (m - 1), minlength=m).astype(np.uint8) & 1, bitorder="little")


def differ(x: np.ndarray, y: np.ndarray) -> int:
    """The least number of shingles that two sets with these rows of bits differ in."""
    while len(x) != len(y):  # a longer row folds to half its length
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], names=["key"])

    some = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).select("text").mapInArrow(every, "key long")
    top = some.groupBy("key").count().where(f"count >= {COMMON}").orderBy(F.desc("count"), "key").limit(TOLD).toArrow()
    keys, counts = (top.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows with an equal first column; a run may span batches."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        if not len(cols[0]):
            continue
        cut = np.nonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[0]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if e - s > 1:
                yield [c[s:e] for c in cols]
        rest = [c[cut[-1] :] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def _pairs(node: np.ndarray, size: np.ndarray, others: Callable[[int], np.ndarray], similarity: float, of: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) with a < b: pairs of the members `of` with others(i) whose sizes admit the similarity."""
    for i in of:
        at = others(i)
        at = at[np.minimum(size[at], size[i]) >= similarity * np.maximum(size[at], size[i]) - 1e-9]
        yield np.minimum(node[at], node[i]), np.maximum(node[at], node[i])


def _batches(rows: Iterator[tuple[np.ndarray, ...]], names: list[str], least: int = 50_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[0])
        if n >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def confirmed(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs(a, b) whose texts(node, text) have at least that similarity; sketches(node, size, bits) of all."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [[np.frombuffer(x, np.uint8) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            least = np.fromiter((differ(x, y) for x, y in zip(*bits)), np.int64, batch.num_rows)
            most = (1 - similarity) / (1 + similarity) * (batch.column(4).to_numpy() + batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(least <= most + 1e-9))

    side = lambda c: sketches.select(F.col("node").alias(c), F.col("size").cast("long").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))
    pairs = pairs.where("a <> b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "bits_a", "bits_b", "size_a", "size_b")
    pairs = saved(pairs.mapInArrow(bound, "a long, b long"), "candidates")
    need = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "need")
    known = saved(texts.join(sized(need), "node", "left_semi").dropDuplicates(["node"]), "texts")
    both = pairs.join(known.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(known.withColumnsRenamed({"node": "b", "text": "tb"}), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}  # of texts met lately

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            got = sets.pop(node, None)
            sets[node] = got = shingles(text.as_py()) if got is None else got
            if len(sets) > KEPT:
                del sets[next(iter(sets))]
            return got

        for batch in batches:
            good = []
            for a, x, y, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                sx, sy = of(a, x), of(b, y)
                both = np.concatenate([sx, sy])
                both.sort(kind="stable")  # two sorted runs are merged
                c = int((both[1:] == both[:-1]).sum())
                good.append(c >= similarity / (1 + similarity) * (len(sx) + len(sy)) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return saved(both.select("a", "ta", "tb", "b").mapInArrow(test, "a long, b long"), "links")


def near_links(docs: DataFrame, prints: DataFrame, text: str = "text", similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(a, b): hashes of texts; what these links connect is what all pairs of at least that similarity connect."""
    body = F.col(text).cast("string")
    texts = docs.select(F.xxhash64(body).alias("node"), body.alias("text"))
    common, counts = _common(texts)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                size, bits, first = [], [], []
                for t in part.column(1):
                    sh = shingles(t.as_py())
                    size.append(len(sh))
                    bits.append(parity(sh).tobytes())
                    first.append(prefix(sh, common, counts, similarity).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))], names=["node", "size", "bits", "first"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple[np.ndarray, ...]]:
            for key, node, size in _files(batches):
                node, first = np.unique(node, return_index=True)
                size, n = size[first], len(node)
                after = (lambda i: np.arange(i + 1, n)) if n else None  # noqa: B023
                for a, b in _pairs(node, size, after, similarity, range(n if n <= crowd else LEADERS)):
                    yield np.zeros(len(a), np.int32), a, b, np.zeros(len(a), np.int32)
                if n > crowd:
                    yield np.ones(n, np.int32), np.full(n, key[0], np.int64), node, size

        yield from _batches(every(), ["kind", "a", "b", "size"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple[np.ndarray, ...]]:
            for key, node, size, root, bits, first in _files(batches):
                if (root == root[0]).all():
                    continue
                rows = [np.frombuffer(x, np.uint8) for x in bits]
                before = [f[f < key[0]].tolist() for f in first]
                inside: dict[int, list[int]] = {}  # members of each smaller file
                for i, f in enumerate(before):
                    for k in f:
                        inside.setdefault(k, []).append(i)

                def apart(i: int) -> np.ndarray:
                    other = root != root[i]  # noqa: B023
                    other[: i + 1] = False
                    for k in before[i]:  # noqa: B023
                        other[inside[k]] = False  # noqa: B023
                    at = np.flatnonzero(other)
                    at = at[np.minimum(size[at], size[i]) >= similarity * np.maximum(size[at], size[i]) - 1e-9]  # noqa: B023
                    most = (1 - similarity) / (1 + similarity) * (size[at] + size[i]) + 1e-9  # noqa: B023
                    return at[np.fromiter((differ(rows[i], rows[j]) for j in at.tolist()), np.int64, len(at)) <= most]  # noqa: B023

                yield from _pairs(node, size, apart, similarity, range(len(node)))

        yield from _batches(every(), ["a", "b"])

    sketches = saved(texts.mapInArrow(sketch, "node long, size int, bits binary, first array<long>"), "sketches")
    files = sketches.select(F.explode("first").alias("key"), "node", "size").repartition("key").sortWithinPartitions("key")
    sketches = sketches.select("node", "size", "bits").dropDuplicates(["node"])
    met = saved(files.mapInArrow(meet, "kind int, a long, b long, size int"), "met")
    same = prints.groupBy("fp").agg(F.min("tie").alias("lead"))
    same = saved(same, "leads")
    close = links(same)
    lead = lambda c: same.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}"))
    close = close.join(lead("a"), "a").join(lead("b"), "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    equal = prints.join(same, "fp").where("tie <> lead").select(F.col("lead").alias("a"), F.col("tie").alias("b"))
    good = confirmed(met.where("kind = 0").select("a", "b").unionAll(close).unionAll(equal), texts, sketches, similarity)
    crowds = met.where("kind = 1")
    if not crowds.limit(1).count():
        return good
    known = crowds.select(F.col("a").alias("key"), F.col("b").alias("node"), "size").join(sized(components(good)), "node", "left")
    known = known.select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    # Files of one component have nothing left to link.
    open_files = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    known = saved(known.join(open_files, "key", "left_semi"), "open")
    first = known.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST).alias("first"))
    known = known.join(sketches.select("node", "bits"), "node").join(first, "node")
    known = known.select("key", "node", "size", "root", "bits", "first").repartition("key").sortWithinPartitions("key", "node")
    return good.unionAll(confirmed(known.mapInArrow(rest, "a long, b long"), texts, sketches, similarity))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of near copies: the one with the smallest id (of rows that repeat an id, by a hash of the text)."""
    prints = saved(fingerprints(docs, text, doc_id, WORDS), "prints")
    nodes = prints.select("doc_id", "tie", F.col("tie").alias("fp"))
    return standing_only(docs, standing(nodes, lambda _: near_links(docs, prints, text, similarity)), text, doc_id)
