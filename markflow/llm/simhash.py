"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint per text: bit b is 1 if more than half of the hashes of its word shingles have it. Two fingerprints
link at DISTANCE or fewer differing bits. With m equal segments and distance t, the pigeonring principle says: on the
ring of segments some segment i starts a chain whose every prefix of l segments differs in at most floor(l * t / m)
bits. With m = 8, t = 4 the chain of three begins with an equal segment and differs in at most one bit over the next
two; so each fingerprint is filed under (i, segments i..i+2), once as it is and once with each single 1 of the last two
segments cleared: two fingerprints that differ there in one bit meet, as one of them has the 1. Candidates of a file
must then pass the whole chain of budgets up to m segments before their full Hamming distance is taken.

Only distinct fingerprints are compared, so exact copies cost nothing. Links inside a file are reduced to a spanning
forest in vectorised blocks, so a crowded file gives fewer rows than it has members; a file of more than BLOCK members is
cut into blocks whose pairs go to different tasks. Components come from alternating large-star and small-star steps.

Defined cases: null and empty texts have fingerprint zero, linked like any other. Rows with a null id take no part in
choosing the component id unless all have one. Repeated rows get equal results. Whole texts are read, however long. An
empty table gives an empty result. Other columns are not read; `near_dedup` passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved, shuffle_partitions, sized, unused

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 8
CHAIN = 3
#: Members of a file that one task compares at a time.
BLOCK = 4096
#: Members of a file up to which its pairs are compared together with those of other files, not member by member.
PAIRED = 256
#: Distinct fingerprints that one task files.
SPREAD = 250_000


def digests(text: str | None, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in parts: A-Z lower-cased, words between ASCII white space, repeats included."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    flat = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        yield np.array([digest(flat[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())], np.uint64)


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text over shingles of `words`, repeats included."""
    counts, n = np.zeros(2048, np.int64), 0  # of each byte value at each place
    place = np.arange(0, 2048, 256, dtype=np.int16)
    for h in digests(text, words, seed):
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048)
        n += len(h)
    bit = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    total = (counts.reshape(8, 256) @ bit).ravel()
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, tie, fp): fp is the fingerprint as a signed long, tie a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "tie", "fp"])

    body = F.col(text).cast("string")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("text"))
    return slim.mapInArrow(run, "doc_id long, tie long, fp long")


def filed(fps: np.ndarray, segments: int = SEGMENTS, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Files of fingerprints (uint64): (file numbers, positions in fps)."""
    width = 64 // segments
    tail = width * (chain - 1)
    keys, who = [], []
    every = np.arange(len(fps))
    for i in range(segments):
        turned = (fps << np.uint64(i * width)) | (fps >> np.uint64(64 - i * width)) if i else fps
        key = turned >> np.uint64(64 - width * chain)
        salt = np.uint64(i) << np.uint64(width * chain)
        keys.append(key | salt)
        who.append(every)
        for b in range(tail):
            one = np.nonzero((key >> np.uint64(b)) & np.uint64(1))[0]
            keys.append((key[one] ^ np.uint64(1 << b)) | salt)
            who.append(one)
    return np.concatenate(keys).view(np.int64), np.concatenate(who)


def budgets(diff: np.ndarray, segments: int = SEGMENTS, distance: int = DISTANCE) -> np.ndarray:
    """Which differences (xor of two fingerprints) have a segment from which all chains stay within their budgets."""
    width = 64 // segments
    per = np.stack([np.bitwise_count((diff >> np.uint64(64 - (i + 1) * width)) & np.uint64((1 << width) - 1)) for i in range(segments)]).astype(np.int16)
    ok = np.zeros(diff.shape, bool)
    for i in range(segments):
        good, run = np.ones(diff.shape, bool), np.zeros(diff.shape, np.int16)
        for length in range(1, segments + 1):
            run = run + per[(i + length - 1) % segments]
            good &= run <= length * distance // segments
        ok |= good
    return ok


def forest(left: np.ndarray, right: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among `left`, or between `left` and `right`: pairs of fingerprints.

    Each round takes one unreached member after the other and reaches all that link to it in one vector step.
    """
    nodes = left if right is None else np.concatenate([left, right])
    reached = np.zeros(len(nodes), bool)
    a, b = [], []
    side = None if right is None else np.arange(len(nodes)) < len(left)
    for at in range(len(nodes)):
        if reached[at]:
            continue
        reached[at] = True
        stack = [at]
        while stack and not reached.all():
            x = stack.pop()
            rest = np.nonzero(~reached if side is None else ~reached & (side != side[x]))[0]
            diff = nodes[rest] ^ nodes[x]
            ok = np.nonzero(budgets(diff, distance=distance))[0]
            near = rest[ok[np.bitwise_count(diff[ok]) <= distance]]
            reached[near] = True
            a.append(np.full(len(near), nodes[x], np.uint64))
            b.append(nodes[near])
            stack.extend(near.tolist())
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def paired(fp: np.ndarray, cut: np.ndarray, size: np.ndarray, distance: int = DISTANCE, most: int = 1 << 18) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Links in files that stand one after another in fp, at cut and of size members: (a, b), and which files link so much
    that a spanning forest says it in fewer pairs; those files' links are not in (a, b)."""
    file = np.repeat(np.arange(len(cut)), size)
    at = np.repeat(cut, size) + np.arange(len(file)) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(cut + size, size) - at
    left, right, of = [], [], []
    step = 1
    while True:
        has = after > step  # members that have one so many places on
        at, after, file = at[has], after[has], file[has]
        if not len(at):
            break
        for k in range(0, len(at), most):
            x = at[k : k + most]
            diff = fp[x] ^ fp[x + step]
            ok = np.nonzero(budgets(diff, distance=distance))[0]
            ok = ok[np.bitwise_count(diff[ok]) <= distance]
            left.append(x[ok])
            right.append(x[ok] + step)
            of.append(file[k : k + most][ok])
        step += 1
    if not left:
        return [], [], np.zeros(len(cut), bool)
    left, right, of = np.concatenate(left), np.concatenate(right), np.concatenate(of)
    thick = np.bincount(of, minlength=len(cut)) >= size
    thin = ~thick[of]
    return [fp[left[thin]]], [fp[right[thin]]], thick


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): for each file a spanning forest of the links in it; their union connects what all links connect."""
    if distance > DISTANCE:
        raise ValueError(f"the files find links up to {DISTANCE} bits")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                key, who = filed(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[who].view(np.int64))], names=["key", "fp"])

    # A fingerprint makes about 70 rows: a task gets so few of them that its part of the shuffle stays small.
    parts = max(shuffle_partitions(fps.sparkSession), fps.count() // SPREAD)
    files = fps.select("fp").repartition(parts, "fp").mapInArrow(file, "key long, fp long")
    crowds = saved(files.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {block}"), "crowds")
    files = files.join(sized(crowds), "key", "left") if crowds.limit(1).count() else files.withColumn("n", F.lit(None).cast("long"))
    # A crowd of c blocks: each member goes to the c tasks that pair its block with another (or itself).
    c = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.coalesce(c, F.lit(1))).cast("int")
    others = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), c - 1))
    files = files.withColumn("mine", own).withColumn("other", F.explode(others))
    pair = F.least("mine", "other") * 65536 + F.greatest("mine", "other")
    files = files.select("key", pair.alias("pair"), "mine", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, two, mine, fp = cols
            cut = np.nonzero(np.r_[True, (key[1:] != key[:-1]) | (two[1:] != two[:-1])])[0] if len(key) else np.empty(0, int)
            size = np.diff(np.r_[cut, len(key)])
            fp = fp.view(np.uint64)
            some = (size > 1) & (size <= PAIRED)
            a, b, thick = paired(fp, cut[some], size[some], distance)
            single = size > PAIRED
            single[np.nonzero(some)[0][thick]] = True
            a, b = [np.empty(0, np.uint64), *a], [np.empty(0, np.uint64), *b]
            for s, n in zip(cut[single].tolist(), size[single].tolist()):
                x, m = fp[s : s + n], mine[s : s + n]
                got = forest(x, None, distance) if (m == m[0]).all() else forest(x[m == m[0]], x[m != m[0]], distance)
                a.append(got[0])
                b.append(got[1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns)]
            key, two = cols[0], cols[1]
            last = np.nonzero((key != key[-1]) | (two != two[-1]))[0] if len(key) else np.empty(0, int)
            n = last[-1] + 1 if len(last) else 0  # the last file may go on in the next batch
            rest = [c[n:] for c in cols]
            if n:
                yield done([c[:n] for c in cols])
        if len(rest[0]):
            yield done(rest)

    dealt = files.repartition("key", "pair").sortWithinPartitions("key", "pair", "mine", "fp")
    return dealt.mapInArrow(link, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes on edges(a, b).

    Alternating large-star and small-star steps; each step groups by node with sums in every task before the shuffle, and
    writes its edges in the shared folder.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("m", "u").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "large")
        small = large.join(least(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = saved(small.where("u <> v").distinct(), "small")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(row)


def standing(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """prints(doc_id, tie, fp) with first: the struct (no_id, doc_id, tie) of the row that stands for the component of links(distinct fp)."""
    unique = saved(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("first")), "unique")
    roots = components(links(unique))
    release(prints.sparkSession)
    known = saved(unique.join(sized(roots), unique["fp"] == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    firsts = known.groupBy("root").agg(F.min("first").alias("first"))
    return prints.join(known.drop("first").join(firsts, "root").select("fp", "first"), "fp")


def _labelled(docs: DataFrame, text: str, doc_id: str, distance: int) -> DataFrame:
    return standing(saved(fingerprints(docs, text, doc_id), "prints"), lambda unique: links(unique, distance))


def near_dedup_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id in its component)."""
    rows = _labelled(docs, text, doc_id, distance)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (of rows that repeat an id, by a hash of the text)."""
    return standing_only(docs, _labelled(docs, text, doc_id, distance), text, doc_id)


def standing_only(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of docs that stand for their component, given rows(doc_id, tie, first).

    Texts move only where rows repeat id and text, or where more rows go than a broadcast may hold.
    """
    rows = saved(rows, "labels")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    own, i, tie = unused(docs, "__own", "__id", "__tie")
    key = [F.col("doc_id").alias(i), F.col("tie").alias(tie)]
    gone = saved(rows.where(~stays).select(key).distinct(), "gone")
    again = rows.where(stays).groupBy("doc_id", "tie").count().where("count > 1").select(key)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(tie))
    kept = docs.withColumn(own, F.xxhash64(F.col(text).cast("string"))).join(sized(gone), same, "left_anti")
    if again.limit(1).count():
        again = sized(saved(again, "again"))
        twice = kept.join(again, same, "left_semi").dropDuplicates([doc_id, own])
        kept = kept.join(again, same, "left_anti").unionByName(twice)
    return kept.select(docs.columns)
