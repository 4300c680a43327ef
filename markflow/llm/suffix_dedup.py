"""Suffix-array dedup: removes each byte covered by a LENGTH-byte string that also starts earlier in the corpus.

Order of starts: document id, then offset. Sorting the suffixes of everything is not needed to find strings of LENGTH
bytes, so the arrays are built over what can repeat, in shards that are exact on their own:
 1. equal texts are one document (the smallest id); the other copies lose everything if they have LENGTH bytes;
 2. winnowing: of the SEED-byte strings inside each LENGTH-byte window the one with the smallest hash is its anchor, so
    equal windows have equal anchors at equal offsets. Each anchor is dealt by its hash, with the hash of its context: all
    bytes of the windows that can hold it. Equal contexts are equal windows: all but the first go without any sorting
    (first inside each block of texts, so a very common passage sends one row a block, then inside the bucket);
 3. what is left are first contexts whose anchor occurs in other contexts. A window is LENGTH - SEED bytes longer than its
    anchor, so half of that on one side or the other: contexts are dealt by (anchor, that side's bytes), once for each
    side and cut to what such windows reach. In a shard, of equal ones again only the first stays; those that share
    a key are laid end to end, and the suffix array by prefix doubling and permuted common prefixes give the runs of equal
    LENGTH-byte strings, all of which but the first go;
 4. spans are gathered per document, merged, and cut out of the whole text.

Defined cases: a null text is empty; texts under LENGTH bytes stay whole. A null id comes first. Rows that repeat id and
text count as one document and get equal results; rows that repeat an id with another text are ordered by a hash of the
text. An empty table gives an empty result. Other columns are not read. Contexts are told apart by two 64-bit hashes (of the
anchor and of the context), not by their bytes: among n contexts two unlike ones are taken for equal with a probability of
about n^2 / 2^129.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, light, mixed, packed, release, saved, sized, starts, text_of, trim, unpacked
from .exact_dedup import marked
from .suffix_array import common_prefixes, suffix_array

LENGTH = 100
SEED = 32
SIDE = LENGTH - SEED
HALF = (SIDE + 1) // 2
BLOCK_BYTES = 4 << 20
#: Anchors to a bucket, and bytes of contexts to a shard.
BUCKET = 600_000
SHARD_BYTES = 1 << 20
_LEAST = -(2**63)
TEXTS, SPANS, FIRSTS = range(3)
_PACK = "kind byte, k long, p0 binary, p1 binary, p2 binary, p3 binary"


def anchors(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, roll: Rolling) -> np.ndarray:
    """Sorted positions of the anchors of all windows inside the documents [begins, ends)."""
    n = len(buf)
    bits = max(24, n.bit_length())
    if n < LENGTH:
        return np.empty(0, np.int64)
    m = n - SEED + 1
    value = roll.every(SEED)
    value >>= np.uint64(bits)
    value <<= np.uint64(bits)
    value |= np.arange(m, dtype=np.uint64)
    w = SIDE + 1
    rows = -(-m // w)
    grid = np.full(rows * w, np.uint64(2**64 - 1))
    grid[:m] = value
    del value
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)
    del grid
    behind = behind[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows], out=behind[:windows])
    del ahead
    inside = np.zeros(n + 1, np.int32)
    long = ends - begins >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    chosen = np.zeros(m, bool)
    chosen[(least[np.cumsum(inside, dtype=np.int32)[:windows] > 0] & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.nonzero(chosen)[0]


def _pack(rows: list[tuple], first: str = "kind", kind: pa.DataType = pa.int8()) -> pa.Table:
    cols = list(zip(*[(a, k, *[packed(x) for x in more], *[None] * (4 - len(more))) for a, k, *more in rows])) or [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, [kind, pa.int64(), *[pa.binary()] * 4])], names=[first, "k", "p0", "p1", "p2", "p3"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(ids, ties, buffer, begins, ends, values of a fourth column) of texts of at least LENGTH bytes."""

    def block(ids: list[int], ties: list[int], texts: list[bytes], more: list):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        return np.array(ids, np.int64), np.array(ties, np.int64), np.frombuffer(b"".join(texts), np.uint8), ends - size, ends, more

    ids, ties, texts, more, total = [], [], [], [], 0
    for b in batches:
        fourth = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
        for i, tie, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), fourth):
            text = t.as_py().encode("utf-8", "surrogatepass")
            if len(text) < LENGTH:
                continue
            ids.append(_LEAST if i is None else i)
            ties.append(tie)
            texts.append(text)
            more.append(x)
            total += len(text)
            if total >= BLOCK_BYTES:
                yield block(ids, ties, texts, more)
                ids, ties, texts, more, total = [], [], [], [], 0
    if texts:
        yield block(ids, ties, texts, more)


def _dealt(texts: DataFrame, buckets: int) -> DataFrame:
    """Anchors of each block of texts, packed by bucket; bucket -1 has the block's texts and what its own repeats remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (ids, ties, buf, begins, ends, _) in enumerate(_blocks(batches)):
            base = (part << 40) | (k << 24)
            roll = Rolling(buf)
            at = anchors(buf, begins, ends, roll)
            doc = np.searchsorted(ends, at, "right")
            left, right = np.maximum(begins[doc], at - SIDE), np.minimum(ends[doc], at + LENGTH)
            seed = roll.of(at, at + SEED)
            shape = ((at - left) << 8 | (right - at)).astype(np.uint64)
            context = mixed(roll.of(left, right) ^ (shape * np.uint64(0x9E3779B97F4A7C15)))
            del roll
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((ties, ids))] = np.arange(len(ids))
            order = np.lexsort((at - begins[doc], rank[doc], context, seed))
            first = np.zeros(len(at), bool)
            cut = starts(seed[order], context[order])
            first[cut] = True
            # Rows that repeat id and text stand for one document: its first occurrence is nobody's repeat.
            lead = np.repeat(order[cut], np.diff(np.r_[cut, len(order)]))
            same = (ids[doc[order]] == ids[doc[lead]]) & (ties[doc[order]] == ties[doc[lead]]) & (at[order] - begins[doc[order]] == at[lead] - begins[doc[lead]])
            gone = order[~first & ~same]
            where = (at - begins[doc]).astype(np.uint32)
            out = [(-1, base, np.stack([ids, ties]), np.stack([doc[gone].astype(np.uint32), where[gone]]))]
            keep = order[first]
            bucket = ((seed[keep] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            turn = np.argsort(bucket, kind="stable")
            keep, bucket = keep[turn], bucket[turn]
            cut = starts(bucket)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(keep)]):
                x = keep[s:e]
                used, row = np.unique(doc[x], return_inverse=True)
                out.append((int(bucket[s]), base, np.stack([seed[x], context[x]]), np.stack([doc[x].astype(np.uint32), where[x]]), row.astype(np.uint32), np.stack([ids[used], ties[used]])))
            yield from _pack(out, "bucket", pa.int32()).to_batches()
            trim()

    return texts.mapInArrow(run, "bucket int, k long, p0 binary, p1 binary, p2 binary, p3 binary")


def _bucket(t: pa.Table) -> pa.Table:
    """All anchors of a bucket: repeated contexts but the first are spans; first contexts of anchors with several go on."""
    p = [t.column(f"p{i}").to_pylist() for i in range(4)]
    bases = t.column("k").to_pylist()
    if t.column("bucket")[0].as_py() < 0:
        out = []
        for i, b in enumerate(bases):
            out.append((TEXTS, b, unpacked(p[0][i], np.int64)))
            out.append((SPANS, b, unpacked(p[1][i], np.uint32)))
        return _pack(out)
    two = [unpacked(x, np.uint64).reshape(2, -1) for x in p[0]]
    at = [unpacked(x, np.uint32).reshape(2, -1) for x in p[1]]
    names = [unpacked(x, np.int64).reshape(2, -1) for x in p[3]]
    seed, context = np.concatenate([x[0] for x in two]), np.concatenate([x[1] for x in two])
    doc, where = np.concatenate([x[0] for x in at]), np.concatenate([x[1] for x in at])
    pack = np.repeat(np.arange(len(at)), [x.shape[1] for x in at])
    offset = np.cumsum([0, *[x.shape[1] for x in names]])
    names = np.concatenate(names, axis=1)
    order = np.lexsort((names[1], names[0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[False, (names[0][order][1:] != names[0][order][:-1]) | (names[1][order][1:] != names[1][order][:-1])])
    start = (rank[np.concatenate([unpacked(x, np.uint32) for x in p[2]]).astype(np.int64) + offset[pack]] << 32) | where
    order = np.lexsort((start, context, seed))
    cut = starts(seed[order], context[order])
    lead = np.zeros(len(order), bool)
    lead[cut] = True
    same = start[order] == np.repeat(start[order[cut]], np.diff(np.r_[cut, len(order)]))
    gone = order[~lead & ~same]
    group = starts(seed[order[cut]])  # an anchor's first contexts
    many = np.repeat(np.diff(np.r_[group, len(cut)]) > 1, np.diff(np.r_[group, len(cut)]))
    firsts = order[cut[many]]
    out = []
    for kind, x in ((SPANS, gone), (FIRSTS, firsts)):
        x = x[np.argsort(pack[x], kind="stable")]
        cut = starts(pack[x]) if len(x) else np.empty(0, int)
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(x)]):
            out.append((kind, bases[pack[x[s]]], np.stack([doc[x[s:e]], where[x[s:e]]])))
    return _pack(out)


def _merged(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs covered by the spans: [begins, ends]."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, begins[1:] > reach[:-1]] if len(begins) else np.zeros(0, bool)
    at = np.nonzero(new)[0]
    return np.stack([begins[at], reach[np.r_[at[1:] - 1, len(begins) - 1]]]) if len(at) else np.empty((2, 0), np.int64)


def _by_document(t: pa.Table) -> pa.Table:
    """A block's documents with spans or first contexts: (doc_id, tie, spans, firsts, n_firsts); spans from anchors to be clipped."""
    kinds, p = t.column("kind").to_pylist(), t.column("p0").to_pylist()
    ids, ties = unpacked(p[kinds.index(TEXTS)], np.int64).reshape(2, -1)
    got = {}
    for kind in (SPANS, FIRSTS):
        x = np.concatenate([unpacked(y, np.uint32).reshape(2, -1) for k, y in zip(kinds, p) if k == kind] or [np.empty((2, 0), np.uint32)], axis=1).astype(np.int64)
        x = x[:, np.lexsort((x[1], x[0]))]
        cut = starts(x[0]) if x.shape[1] else np.empty(0, int)
        got[kind] = {int(x[0, s]): x[1, s:e] for s, e in zip(cut.tolist(), [*cut[1:].tolist(), x.shape[1]])}
    rows = []
    for d in sorted({*got[SPANS], *got[FIRSTS]}):
        at, firsts = got[SPANS].get(d, np.empty(0, np.int64)), got[FIRSTS].get(d, np.empty(0, np.int64))
        rows.append((int(ids[d]), int(ties[d]), packed(_merged(np.maximum(at - SIDE, 0), at + LENGTH)), packed(firsts), len(firsts)))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    cols = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "tie", "spans", "firsts", "n_firsts"])


def _contexts(met: DataFrame, shards: int) -> DataFrame:
    """First contexts of documents, dealt by anchor and half a side: (shard, key, doc_id, tie, at, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ties, buf, begins, ends, firsts in _blocks(batches):
            roll, raw = Rolling(buf), buf.tobytes()
            firsts = [unpacked(x, np.int64) for x in firsts]
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in firsts])
            at = np.concatenate(firsts) + begins[doc]
            # A window holds HALF bytes before its anchor, or HALF bytes after it; what such windows reach is the context.
            for side, ok, s, e in ((0, at - HALF >= begins[doc], at - HALF, at + SEED), (1, at + SEED + HALF <= ends[doc], at, at + SEED + HALF)):
                d, s, e = doc[ok], s[ok], e[ok]
                key = roll.of(s, e) * np.uint64(2) + np.uint64(side)
                left, right = np.maximum(e - LENGTH, begins[d]), np.minimum(s + LENGTH, ends[d])
                shard = (mixed(key) % np.uint64(shards)).astype(np.int32)
                for x in range(0, len(d), 10_000):
                    y = slice(x, x + 10_000)
                    bodies = [raw[a:z] for a, z in zip(left[y].tolist(), right[y].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard[y]), pa.array(key[y].view(np.int64)), pa.array(ids[d[y]]), pa.array(ties[d[y]]), pa.array(left[y] - begins[d[y]]), pa.array(bodies, pa.binary())],
                        names=["shard", "key", "doc_id", "tie", "at", "body"],
                    )
            del roll
            trim()

    return met.mapInArrow(run, "shard int, key long, doc_id long, tie long, at long, body binary")


def _shard(t: pa.Table) -> pa.Table:
    """Contexts of a shard: spans of LENGTH-byte strings that start earlier in another context, per document."""
    trim()
    key = t.column("key").to_numpy()
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    ids, ties, at = (t.column(c).to_numpy() for c in ("doc_id", "tie", "at"))
    several = np.nonzero(n[back] > 1)[0]
    several = several[np.lexsort((at[several], ties[several], ids[several]))]
    bodies = t.column("body").take(pa.array(several)).to_pylist()
    place = np.stack([ids[several], ties[several], at[several]])
    # Equal contexts: the first stands for all, the others are spans as they are.
    first: dict[bytes, int] = {}
    of = np.fromiter((first.setdefault(x, i) for i, x in enumerate(bodies)), np.int64, len(bodies))
    later = np.nonzero((of != np.arange(len(of))) & (place != place[:, of]).any(0))[0]
    later = later[[len(bodies[i]) >= LENGTH for i in later]] if len(later) else later
    keep = [i for x, i in first.items() if len(x) >= LENGTH]
    done = [(place[:2, i], place[2, i], place[2, i] + len(bodies[i])) for i in later]
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "tie": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    if not keep:
        return empty
    size = np.fromiter(map(len, (bodies[i] for i in keep)), np.int64, len(keep))
    begins = np.cumsum(size + 1) - size - 1
    # UTF-8 has no FE and no FF: moved up by two, 1 ends a context and 0 ends the whole.
    raw = np.frombuffer(b"\xff".join(bodies[i] for i in keep) + b"\xff\xfe", np.uint8) + np.uint8(2)
    sa = suffix_array(raw, 256)
    shared = common_prefixes(raw, sa, begins, LENGTH, begins + size - LENGTH + 1)
    text = np.repeat(np.arange(len(size)), size + 1)
    place, offset = place[:, np.array(keep)], np.arange(len(text)) - begins[text]
    sa = sa[1:]  # but the last symbol
    sa = sa[(offset <= size[text] - LENGTH)[sa]]  # a string of LENGTH bytes ends in its context, and so does any that equals it
    run = np.cumsum(shared[sa] < LENGTH)
    several = np.bincount(run)[run] > 1
    sa, run = sa[several], run[several]
    text, offset = text[sa], offset[sa]
    # Contexts stand in the order of documents, so a document's number and an offset order the starts.
    number = np.cumsum(np.r_[0, (np.diff(place[:2]) != 0).any(0)])
    start = (number[text] << 32) + place[2][text] + offset
    order = np.lexsort((start, run))
    lead = starts(run[order])
    gone = order[start[order] != np.repeat(start[order[lead]], np.diff(lead, append=len(order)))]
    d, tie, start = place[0][text[gone]], place[1][text[gone]], start[gone] & ((1 << 32) - 1)
    own = np.array([x for x, _, _ in done], np.int64).reshape(-1, 2)
    d, tie = np.r_[d, own[:, 0]], np.r_[tie, own[:, 1]]
    s = np.r_[start, np.array([x for _, x, _ in done], np.int64)]
    e = np.r_[start + LENGTH, np.array([x for _, _, x in done], np.int64)]
    if not len(d):
        return empty
    order = np.lexsort((s, tie, d))
    d, tie, s, e = d[order], tie[order], s[order], e[order]
    cut = starts(d, tie)
    # Runs of all documents at once: each document's offsets stand apart from the others'.
    apart = np.repeat(np.arange(len(cut)), np.diff(cut, append=len(d))) * (1 << 40)
    runs = _merged(s + apart, e + apart)
    of, runs = runs[0] >> 40, runs & ((1 << 40) - 1)
    ends = np.searchsorted(of, np.arange(len(cut)), "right").tolist()
    rows = [packed(runs[:, a:z]) for a, z in zip([0, *ends], ends)]
    return pa.table([pa.array(d[cut]), pa.array(tie[cut]), pa.array(rows, pa.binary())], names=["doc_id", "tie", "spans"])


def cut(text: str, spans: list[bytes]) -> tuple[bytes, int]:
    """What is left of a text's bytes, and how many maximal runs went."""
    raw = text.encode("utf-8", "surrogatepass")
    got = [unpacked(s, np.int64).reshape(2, -1) for s in spans or []]
    if not got:
        return raw, 0
    got = np.concatenate(got, axis=1)
    runs = _merged(got[0], np.minimum(got[1], len(raw)))
    left, at = [], 0
    for s, e in runs.T.tolist():
        left.append(raw[at:s])
        at = e
    return b"".join([*left, raw[at:]]), runs.shape[1]


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, copies, gone): one row per document that is no exact copy; rows that are copies; (doc_id, tie, spans) of texts."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("doc_id"), text_of(text).alias("text"))
    rows = marked(slim, "text")
    maybe = rows.where("__maybe")
    lowest = saved(maybe.groupBy("__sha").agg(F.min("doc_id").alias("__first")), "lowest")
    maybe = maybe.join(sized(lowest), "__sha")
    tie = F.xxhash64("text").alias("tie")
    texts = rows.where("not __maybe").select("doc_id", tie, "text").unionAll(maybe.where("doc_id = __first").select("doc_id", tie, "text"))
    copies = maybe.where("doc_id <> __first").select("doc_id", "text")
    texts = saved(texts, "texts")  # read three times: the filter is joined once
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, math.ceil(total * 2 / (SIDE + 2) / BUCKET))
    group = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("k"), F.lit(max(64, buckets)))).otherwise(F.col("bucket")).cast("int")
    dealt = _dealt(texts, buckets).withColumn("bucket", group)
    found = saved(dealt.groupBy("bucket").applyInArrow(_bucket, _PACK), "anchors")
    release(spark)
    per_doc = "doc_id long, tie long, spans binary, firsts binary, n_firsts long"
    marks = saved(found.groupBy("k").applyInArrow(_by_document, per_doc), "marks")
    asked = marks.where("n_firsts > 0")
    n = asked.agg(F.sum("n_firsts")).first()[0] or 0
    shards = max(12, math.ceil(2 * n * (2 * LENGTH - SEED - HALF) / SHARD_BYTES))
    met = texts.join(light(asked.select("doc_id", "tie", "firsts"), F.octet_length("firsts")), ["doc_id", "tie"]).select("doc_id", "tie", "text", "firsts")
    more = saved(_contexts(met, shards).groupBy("shard").applyInArrow(_shard, "doc_id long, tie long, spans binary"), "sorted")
    release(spark)
    both = marks.select("doc_id", "tie", "spans").unionAll(more)
    gone = saved(both.groupBy("doc_id", "tie").agg(F.collect_list("spans").alias("spans")), "spans")
    return texts, copies, gone


def dedup_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left)."""
    texts, copies, gone = spans(docs, text, doc_id)
    met = texts.join(light(gone, F.expr("aggregate(spans, 0L, (n, x) -> n + octet_length(x))")), ["doc_id", "tie"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                ids, text, some = (c.slice(at, 200) for c in b.columns)
                got = [cut(t, s) for t, s in zip(text.to_pylist(), some.to_pylist())]
                size = [len(t.encode("utf-8", "surrogatepass")) for t in text.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(size, pa.int64()), pa.array([n - len(k) for n, (k, _) in zip(size, got)], pa.int64()), pa.array([c for _, c in got], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in got]), pa.array([k for k, _ in got], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    rows = met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    size = F.octet_length("text").cast("long")
    all_of = size >= LENGTH
    left = F.when(all_of, F.lit("")).otherwise(F.col("text"))
    copies = copies.select(
        "doc_id", size.alias("n_bytes"), F.when(all_of, size).otherwise(0).cast("long").alias("n_removed"), all_of.cast("long").alias("n_spans"),
        F.sha2(left, 256).alias("kept_sha256"), F.encode(left, "UTF-8").alias("kept"),
    )
    return rows.unionAll(copies).withColumn("doc_id", F.nullif("doc_id", F.lit(_LEAST)))
