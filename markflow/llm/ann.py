"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Learning (driver, on a bounded sample): centre, principal axes, and an iterative-quantisation rotation whose signs are the
code. The search radius is learnt too: the smallest Hamming radius that holds RECALL of the true neighbours inside the
sample. With more rows than the sample, neighbours are nearer, so the radius then finds more of them.

Search: all rows are indexed. The index is sharded by a hash of the id; each shard keeps one table per substring of
the codes. A query goes to every shard. Within radius r some substring of m differs in at most floor(r / m) bits
(pigeonhole), so probing each table with all keys that near retrieves every code within r; the candidates' full Hamming
distance is checked and what is left is reranked by exact distances of the original vectors in double precision. A query
that finds fewer than k in a shard asks that shard again with a wider radius. Each shard gives its k best, which are
merged by a sum-like aggregate.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, as query or as candidate. Ties go to the smaller id. Rows that repeat an id count once each as candidates; none of
them is a candidate of a query with that id; a repeated query id is answered once. Fewer than k candidates: all of them.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

K = 10
SAMPLE = 10_000
RECALL = 0.97
BITS = 64
SUBSTRINGS = 8
SHARD = 8192
#: Queries that meet a shard at a time.
QUERIES = 2048


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector can take part, as doubles."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    good = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return rows.where(good)


class Codes:
    """Centre, projection and radius."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 30, k: int = K, recall: float = RECALL):
        n, d = sample.shape
        self.bits = bits
        self.centre = sample.mean(0)
        z = sample - self.centre
        _, axes = np.linalg.eigh(z.T @ z / n)
        rng = np.random.default_rng(4)
        used = min(d, bits)
        axes = axes[:, ::-1][:, :used]
        z = z @ axes
        parts = []
        for at in range(0, bits, used):  # more bits than dimensions: several rotations
            r, _ = np.linalg.qr(rng.standard_normal((used, used)))
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
                r = (u @ w).T
            parts.append(axes @ r)
        self.project = np.concatenate(parts, axis=1)[:, :bits]
        self.radius = self._radius(sample, k, recall)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes, one substring of 8 bits each."""
        return np.packbits((x - self.centre) @ self.project > 0, axis=1)

    def _radius(self, x: np.ndarray, k: int, recall: float) -> int:
        asked = x[:: max(1, len(x) // 200)]
        code, all_codes = self.of(asked), self.of(x)
        got = []
        for q, c in zip(asked, code):
            d = ((x - q) ** 2).sum(1)
            near = np.argsort(d, kind="stable")[1 : k + 1]
            got.append(np.bitwise_count(all_codes[near] ^ c).sum(1))
        got = np.concatenate(got) if got else np.zeros(1)
        return int(np.quantile(got, recall, method="higher")) if len(got) else 0


class Shard:
    """One table per substring: row numbers sorted by the substring's value, and where each value starts."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x, self.code = ids, x, codes.of(x)
        self.tables = []
        for s in range(self.code.shape[1]):
            order = np.argsort(self.code[:, s], kind="stable")
            self.tables.append((order, np.searchsorted(self.code[order, s], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from code in at most radius bits."""
        hit = np.zeros(len(self.ids), bool)
        probes = PROBES[min(radius // len(self.tables), 8)]
        for s, (order, start) in enumerate(self.tables):
            for key in (probes ^ code[s]).tolist():
                hit[order[start[key] : start[key + 1]]] = True
        rows = np.nonzero(hit)[0]
        return rows[np.bitwise_count(self.code[rows] ^ code).sum(1) <= radius]

    def nearest(self, qid: int, q: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        most = 8 * self.code.shape[1]
        others = int((self.ids != qid).sum()) if qid in self.own else len(self.ids)
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != qid]
            if len(rows) >= min(k, others) or radius >= most:
                break
            radius = min(most, radius + 4)
        d = np.sqrt(((self.x[rows] - q) ** 2).sum(1))
        best = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows][best], d[best]

    @property
    def own(self) -> set[int]:
        if not hasattr(self, "_own"):
            self._own = set(self.ids.tolist())
        return self._own


#: Differences of a substring with at most r bits, by r.
PROBES = [np.array([x for x in range(256) if x.bit_count() <= r], np.uint8) for r in range(9)]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest among vectors, its own id left out."""
    out = "query_id long, rank int, vec_id long, score double"
    rows = saved(valid(vectors, vec_id, vector), "vectors")
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()[0]
    rows = rows.where(F.size("v") == width)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = np.array(some.column("v").to_pylist(), float).reshape(-1, width)
    codes = Codes(x, bits=bits, k=k)
    shards = -(-n // SHARD)
    asked = valid(queries, vec_id, vector).where(F.size("v") == width).dropDuplicates(["id"])
    asked = saved(asked, "queries")
    blocks = -(-max(asked.count(), 1) // QUERIES)
    # Each block of queries meets each shard once.
    q = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v", F.lit(True).alias("asks"))
    own = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    r = rows.select(own.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v", F.lit(False).alias("asks"))

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        ids = t.column("id").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        got: list[tuple] = []
        if asks.any() and not asks.all():
            shard = Shard(ids[~asks], v[~asks], codes)
            for i, x, c in zip(ids[asks].tolist(), v[asks], codes.of(v[asks])):
                got += [(i, j, d) for j, d in zip(*(a.tolist() for a in shard.nearest(i, x, c, codes.radius, k)))]
        cols = list(zip(*got)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    best = q.unionAll(r).groupBy("shard", "block").applyInArrow(run, "query_id long, vec_id long, score double")
    top = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))  # k rows of each shard
    return top.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def recall(found: pd.DataFrame, vectors: np.ndarray, ids: np.ndarray, k: int = K) -> float:
    """Share of the true k nearest of each query in found; ids and vectors are all rows that take part."""
    hits, total = 0, 0
    place = dict(zip(ids.tolist(), itertools.count()))
    for q, rows in found.groupby("query_id"):
        d = ((vectors - vectors[place[q]]) ** 2).sum(1)
        d[ids == q] = np.inf
        true = set(ids[np.lexsort((ids, d))[:k]].tolist())
        hits, total = hits + len(true & set(rows.vec_id)), total + len(true)
    return hits / max(total, 1)

