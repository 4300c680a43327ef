"""Katz back-off bigram model with Good-Turing discounts, learnt from and applied to a whole table.

Tokens: words of the A-Z lower-cased text, then one end. With c the training counts,
    P(w | v) = d(c(v,w)) c(v,w) / c(v)       if c(v,w) > 0,
             = A(v) P(w)                     otherwise, A(v) = (1 - seen mass of v) / (1 - P mass of v's seen followers),
    P(w)     = d1(c(w)) c(w) / N             if c(w) > 0, else all that is left (one unknown word),
    P(w | v) = P(w)                          if v was never seen.
d of a count is the Good-Turing ratio sum (r+1) n(r+1) / sum r n(r) over its class of counts (1, 2, 3, 4, 5, 6-15, 16 and
more), always inside (0, 1), so every back-off weight is positive and every distribution sums to one exactly.

Nothing of the size of the vocabulary is collected or broadcast:
 1. unigram counts, summed per block of texts before their shuffle, are written as a table; the driver takes totals,
    counts of counts, and the words that make up 1/1024 of all tokens or more (1024 at most);
 2. each block of texts is turned into packed, sorted (word, previous word, documents) runs, dealt by word; frequent words
    are dealt by (word, previous word). One bucket holds about BUCKET tokens. Inside a bucket all bigram counts are exact;
    it gives partial sums per row, sums per previous word, and the unseen bigrams of each row, packed in the table `bigrams`;
 3. sums per previous word give the back-off weights in buckets of previous words, where unseen bigrams take them up
    (those after a frequent word are counted per row instead and take the 1024 weights at most in step 4);
 4. partial sums are added up block by block. log P(w | v) is split into a part that depends on (v, w) or w and one that
    depends on v alone, so that each part is known where it is added.

Defined cases: a null text is empty and has the one end token; a null id is trained on as the text ''. Repeated rows are
rows of their own. Without training rows every token is unknown. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed as _z
from .common import release, saved
from .common import starts as _starts
from .common import trim
from .common import unpacked as _u

#: Lower bounds of the classes of counts.
CLASSES = np.array([1, 2, 3, 4, 5, 6, 16])
FREQUENT = 1024
BLOCK_BYTES = 8 << 20
BUCKET = 2_400_000
FOLDS, HELD_OUT = 7, 2
START, END = b" ", b""
_PACK = "kind byte, k long, p0 binary, p1 binary, p2 binary, p3 binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def ratios(counts: dict[int, int]) -> np.ndarray:
    """Good-Turing ratio of each class, from counts of counts up to 16 and, under 0, the sum of r n(r) over r >= 16."""
    out = []
    for lo, hi in zip(CLASSES.tolist(), [*(CLASSES[1:] - 1).tolist(), None]):
        den = sum(r * counts.get(r, 0) for r in range(lo, hi + 1)) if hi else counts.get(0, 0)
        num = sum((r + 1) * counts.get(r + 1, 0) for r in range(lo, hi + 1)) if hi else den - lo * counts.get(lo, 0)
        out.append(num / den if 0 < num < den else 0.5 if num <= 0 < den else den / (den + 1) if den else 0.5)
    return np.array(out)


class Block:
    """Tokens of some texts: hashes of the distinct words, word numbers with start and end, rows."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        import xxhash

        ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        start, end = ids[START], ids[END]
        seqs = []
        for _, text in rows:
            words = text.lower().split()
            seqs.append(np.fromiter(itertools.chain((start,), map(ids.__getitem__, words), (end,)), np.int64, len(words) + 2))
        self.doc_ids = [d for d, _ in rows]
        self.held = np.array([held_out(d) for d in self.doc_ids], bool)
        self.lengths = np.array([len(s) - 1 for s in seqs], np.int64)
        flat = np.concatenate(seqs)
        last = np.cumsum(self.lengths + 1) - 1
        self.w = np.delete(flat, np.r_[0, last[:-1] + 1])
        self.v = np.delete(flat, last)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), self.lengths)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in ids), np.uint64, len(ids))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    rows, size = [], 0
    for b in batches:
        for d, t in zip(b.column(0), b.column(1)):
            text = (t.as_py() or "").encode("utf-8", "surrogatepass")
            rows.append((d.as_py(), text))
            size += len(text) + 200
            if size >= BLOCK_BYTES:
                yield Block(rows)
                rows, size = [], 0
    if rows:
        yield Block(rows)


def unigrams(slim: DataFrame) -> DataFrame:
    """(h, n): training count of each word's hash, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            n = np.bincount(b.w[~b.held[b.row]], minlength=len(b.hashes))
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes[at].view(np.int64)), pa.array(n[at].astype(np.int64))], names=["h", "n"])

    return slim.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _counts_of_counts(table: DataFrame, n: str) -> dict[int, int]:
    """n(r) for r up to 16 and, under 0, the sum of r n(r) over r >= 16."""
    rows = table.groupBy(F.least(F.col(n), F.lit(17)).alias("r")).agg(F.count(F.lit(1)), F.sum(n)).collect()
    out = {r: c for r, c, _ in rows if r <= 16}
    out[0] = sum(s for r, _, s in rows if r >= 16)
    return out


def _runs(slim: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """(bucket, base, w, pairs, v, at, n, rows): packed runs of each block's tokens, by bucket; bucket -1 names the rows of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(blocks(batches)):
            base = (part << 40) | (k << 24)
            yield _batch([(-1, base, _z(np.array([d or 0 for d in b.doc_ids], np.int64)), _z(np.array([d is None for d in b.doc_ids], bool)), b"", b"", _z(b.lengths), _z(b.held))])
            mixed = b.hashes[b.w]
            hot = np.isin(b.hashes, frequent)[b.w]
            mixed[hot] ^= b.hashes[b.v[hot]] * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            width = int(len(b.hashes)).bit_length()
            order = np.argsort((bucket << (2 * width)) | (b.w << width) | b.v, kind="stable")
            bucket, w, v, rows = bucket[order], b.w[order], b.v[order], (b.row[order] * 2 + b.held[b.row[order]]).astype(np.uint32)
            del order, mixed, hot
            cut = _starts(bucket)
            out = []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(w)]):
                pair = _starts(w[s:e], v[s:e]) + s
                first = _starts(w[pair])
                uv, at = np.unique(b.hashes[v[pair]], return_inverse=True)
                out.append((
                    int(bucket[s]), base, _z(b.hashes[w[pair[first]]]), _z(np.diff(np.r_[first, len(pair)]).astype(np.uint32)),
                    _z(uv), _z(at.astype(np.uint32)), _z(np.diff(np.r_[pair, e]).astype(np.uint32)), _z(rows[s:e]),
                ))
                if len(out) >= 64:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
            del b, bucket, w, v, rows, out
            trim()

    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    names = ["bucket", "base", "w", "pairs", "v", "at", "n", "rows"]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return slim.mapInArrow(run, "bucket int, base long, w binary, pairs binary, v binary, at binary, n binary, rows binary")


def _class_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, np.maximum(n, 1), "right") - 1


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, lo in enumerate(CLASSES.tolist()):
        out = F.when(n >= lo, i).otherwise(out)
    return out


def _pack(rows: list[tuple]) -> pa.Table:
    """Rows (kind, k, up to four arrays)."""
    cols = list(zip(*[(kind, k, *[_z(x) for x in more], *[None] * (4 - len(more))) for kind, k, *more in rows])) or [[]] * 6
    kinds = [pa.int8(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "k", "p0", "p1", "p2", "p3"])


def _index(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of keys is in sorted_keys, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys).clip(0, len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


#: Kinds of packed rows. ROWS: ids, nulls, lengths, held of a block's rows. SUMS: row numbers, [base, logs], [known, seen by
#: class], [row, frequent previous word] of unseen bigrams. BEFORE: previous words, mass, counts by class. UNSEEN: previous
#: words, rows. COUNTS: counts of counts. BACK: rows and sums of back-off weights. TOP: frequent previous words and weights.
ROWS, SUMS, BEFORE, UNSEEN, COUNTS, BACK, TOP = range(7)


def _bucket(t: pa.Table, total: int, types: int, d1: np.ndarray, seen_mass: float, hot: np.ndarray, hot_n: np.ndarray, buckets: int) -> pa.Table:
    """All tokens of a bucket of words: exact bigram counts, and what follows from them."""
    if t.column("bucket")[0].as_py() < 0:
        names = [t.column(c) for c in ("base", "w", "pairs", "n", "rows")]
        kinds = (np.int64, bool, np.int64, bool)
        return _pack([(ROWS, base.as_py(), *[_u(x.as_py(), k) for x, k in zip(more, kinds)]) for base, *more in zip(*names)])
    trim()
    cols = {c: [_u(x.as_py(), k) for x in t.column(c)] for c, k in (("w", np.uint64), ("pairs", np.uint32), ("v", np.uint64), ("at", np.uint32), ("n", np.uint32), ("rows", np.uint32))}
    bases = t.column("base").to_pylist()
    w, wi = np.unique(np.concatenate(cols["w"]), return_inverse=True)
    v, vi = np.unique(np.concatenate(cols["v"]), return_inverse=True)
    wi, vi = wi.astype(np.int32), vi.astype(np.int32)
    o2, o1 = np.cumsum([0, *map(len, cols["w"])]), np.cumsum([0, *map(len, cols["v"])])
    pw = np.concatenate([np.repeat(wi[o2[i] : o2[i + 1]], m) for i, m in enumerate(cols["pairs"])])
    pv = np.concatenate([vi[o1[i] : o1[i + 1]][at] for i, at in enumerate(cols["at"])])
    train = np.concatenate([np.add.reduceat(1 - (r & 1).astype(np.int64), np.r_[0, np.cumsum(m[:-1], dtype=np.int64)]) for r, m in zip(cols["rows"], cols["n"])])
    key = pw.astype(np.int64) * len(v) + pv
    order = np.argsort(key)
    cut = _starts(key[order])
    big = np.empty(len(key), np.int32)  # of each pair of a block: its bigram
    big[order] = np.repeat(np.arange(len(cut), dtype=np.int32), np.diff(np.r_[cut, len(key)]))
    count = np.add.reduceat(train[order], cut)
    big_w, big_v = pw[order[cut]], pv[order[cut]]
    c2 = np.bincount(pw, weights=train, minlength=len(w)).astype(np.int64)
    del key, order, pv, train, wi, vi
    cols["w"].clear(), cols["v"].clear(), cols["at"].clear()
    at, is_hot = _index(hot, w)
    c2[is_hot] = hot_n[at[is_hot]]
    v_hot, v_is_hot = _index(hot, v)
    p1 = np.where(c2 > 0, d1[_class_of(c2)] * c2 / max(total, 1), 1 - seen_mass)
    # The step after a word divides by the word's count; the end stands in for the start, which is as frequent.
    off = np.log10(np.maximum(c2, 1))
    base = np.log10((c2 + 1) / (total + types + 1))
    cls = np.where(count > 0, _class_of(count), -1)
    logs = np.where(count > 0, np.log10(np.maximum(count, 1)), np.log10(p1)[big_w])
    out, unseen_v, unseen_row, begin, n = [], [], [], 0, len(CLASSES) + 1
    for b, m, r in zip(bases, cols["n"], cols["rows"]):
        g = np.repeat(big[begin : begin + len(m)], m)
        begin += len(m)
        row, word = (r >> 1).astype(np.int64), big_w[g]
        size = int(row.max()) + 1
        there = np.nonzero(np.bincount(row, minlength=size))[0]
        sums = np.stack([np.bincount(row, weights=x, minlength=size)[there] for x in (base[word], logs[g] - off[word])])
        hist = np.bincount(row * n + cls[g] + 1, minlength=size * n).reshape(size, n)[there]
        hist[:, 0] = np.bincount(row, weights=c2[word] > 0, minlength=size)[there]
        lost = np.nonzero(cls[g] < 0)[0]
        lv = big_v[g[lost]]
        often = v_is_hot[lv]
        out.append((SUMS, b, there.astype(np.uint32), sums, hist.astype(np.uint32), np.stack([row[lost[often]], v_hot[lv[often]]]).astype(np.uint32)))
        unseen_v.append(lv[~often])
        unseen_row.append(b + row[lost[~often]])
    seen = np.nonzero(count > 0)[0]
    mass = np.bincount(big_v[seen], weights=p1[big_w[seen]], minlength=len(v))
    by_class = np.bincount(big_v[seen] * (n - 1) + cls[seen], weights=count[seen], minlength=len(v) * (n - 1)).reshape(len(v), n - 1).astype(np.int64)
    dealt = ((v >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    known, lv, lrow = np.nonzero(mass)[0], np.concatenate(unseen_v), np.concatenate(unseen_row)
    for (kind, at) in ((BEFORE, known), (UNSEEN, np.arange(len(lv)))):
        to = dealt[at] if kind == BEFORE else dealt[lv]
        order = np.argsort(to, kind="stable")
        cut = _starts(to[order])
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            x = at[order[s:e]]
            out.append((BEFORE, int(to[order[s]]), v[x], mass[x], by_class[x]) if kind == BEFORE else (UNSEEN, int(to[order[s]]), v[lv[x]], lrow[x]))
    r = np.minimum(count[seen], 17)
    trim()
    out.append((COUNTS, 0, np.bincount(r, minlength=18), np.bincount(r, weights=count[seen], minlength=18).astype(np.int64)))
    return _pack(out)


def _weights(t: pa.Table, d2: np.ndarray, hot: np.ndarray) -> pa.Table:
    """All previous words of a bucket: back-off weights times the word's count, taken up by the unseen bigrams."""
    n = len(CLASSES)
    kinds, p = t.column("kind").to_pylist(), [t.column(f"p{i}").to_pylist() for i in range(3)]
    own = [i for i, k in enumerate(kinds) if k == BEFORE]
    lost = [i for i, k in enumerate(kinds) if k == UNSEEN]
    if not own:
        return _pack([])
    v, at = np.unique(np.concatenate([_u(p[0][i], np.uint64) for i in own]), return_inverse=True)
    mass = np.bincount(at, weights=np.concatenate([_u(p[1][i], np.float64) for i in own]))
    counts = np.concatenate([_u(p[2][i], np.int64).reshape(-1, n) for i in own])
    left = np.bincount(at, weights=counts @ (1 - d2))  # what discounts leave of the word's count
    weight = np.log10(left / (1 - mass))
    out = []
    where, is_hot = _index(hot, v)
    if is_hot.any():
        out.append((TOP, 0, where[is_hot], weight[is_hot]))
    if lost:
        at, there = _index(v, np.concatenate([_u(p[0][i], np.uint64) for i in lost]))
        rows, to = np.unique(np.concatenate([_u(p[1][i], np.int64) for i in lost])[there], return_inverse=True)
        sums = np.bincount(to, weights=weight[at[there]], minlength=len(rows))
        cut = _starts(rows >> 24) if len(rows) else np.empty(0, int)
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)]):
            out.append((BACK, int(rows[s] >> 24 << 24), (rows[s:e] & 0xFFFFFF).astype(np.uint32), sums[s:e]))
    return _pack(out)


def _sums(t: pa.Table, d2: np.ndarray, top: np.ndarray) -> pa.Table:
    """All parts of a block's rows, added up in a fixed order."""
    p = [t.column(f"p{i}").to_pylist() for i in range(4)]
    kinds = t.column("kind").to_pylist()
    at = kinds.index(ROWS)
    ids, null, lengths, held = (_u(x[at], k) for x, k in zip(p, (np.int64, bool, np.int64, bool)))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    known, base = np.zeros(len(ids), np.int64), []
    discounts = np.log10(d2)
    for i in sorted(range(len(kinds)), key=lambda i: (kinds[i], p[0][i], p[1][i])):
        if kinds[i] == SUMS:
            row = _u(p[0][i], np.uint32)
            two, hist = _u(p[1][i], np.float64).reshape(2, -1), _u(p[2][i], np.uint32).reshape(len(row), -1)
            known[row] += hist[:, 0]
            base.append((row, two[0]))
            parts.append((row, two[1] + hist[:, 1:] @ discounts))
            lost = _u(p[3][i], np.uint32).reshape(2, -1)
            parts.append((lost[0], top[lost[1]]))
        elif kinds[i] == BACK:
            parts.append((_u(p[0][i], np.uint32), _u(p[1][i], np.float64)))

    def added(some: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        rows = np.concatenate([x for x, _ in some]).astype(np.int64)
        return np.bincount(rows, weights=np.concatenate([x for _, x in some]), minlength=len(ids))

    return pa.table({
        "doc_id": pa.array(ids, mask=null), "held_out": held, "n_tokens": lengths, "n_known": known, "base_score": added(base), "score": added(parts),
    })


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = saved(unigrams(slim), "unigrams")
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    d1, seen_mass, top = ratios(_counts_of_counts(words, "n")), 0.0, []
    if total:
        top = sorted((np.uint64(r["h"] & (2**64 - 1)), r["n"]) for r in words.where(F.col("n") * FREQUENT >= total).collect())
        per = words.groupBy(_class(F.col("n")).alias("c")).agg(F.sum("n").alias("s")).collect()
        seen_mass = math.fsum(float(d1[r["c"]]) * r["s"] for r in per) / total
    release(spark)
    hot, hot_n = np.array([h for h, _ in top], np.uint64), np.array([n for _, n in top], np.int64)
    buckets = max(12, math.ceil(total * FOLDS / (FOLDS - 1) / BUCKET))
    packed = _runs(slim, buckets, hot)
    # The rows of blocks (bucket -1) are dealt by block.
    group = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("base"), F.lit(max(64, buckets)))).otherwise(F.col("bucket")).cast("int")
    bigrams = saved(packed.withColumn("bucket", group).groupBy("bucket").applyInArrow(lambda t: _bucket(t, total, types, d1, seen_mass, hot, hot_n, buckets), _PACK), "bigrams")
    release(spark)
    seen = np.zeros((2, 18), np.int64)
    counts = bigrams.where(f"kind = {COUNTS}").select("p0", "p1").toLocalIterator()  # 18 numbers from each bucket
    for r in counts:
        seen += np.stack([_u(bytes(r["p0"]), np.int64), _u(bytes(r["p1"]), np.int64)])
    d2 = ratios({r: int(seen[0, r]) for r in range(1, 17)} | {0: int(seen[1, 16:].sum())})
    weights = saved(bigrams.where(f"kind in ({BEFORE}, {UNSEEN})").groupBy("k").applyInArrow(lambda t: _weights(t, d2, hot), _PACK), "weights")
    often = np.zeros(len(hot))
    for r in weights.where(f"kind = {TOP}").collect():  # 1024 words at most
        often[_u(bytes(r["p0"]), np.int64)] = _u(bytes(r["p1"]), np.float64)
    parts = bigrams.where(f"kind in ({ROWS}, {SUMS})").unionAll(weights.where(f"kind = {BACK}"))
    rows = parts.groupBy("k").applyInArrow(lambda t: _sums(t, d2, often), _RESULT)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
