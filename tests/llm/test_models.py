import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from markflow.llm import ann, katz, quality


def test_katz_against_plain_model(small_docs, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 40_000)
    docs = small_docs.limit(80)
    got = {r.doc_id: r for r in katz.score(docs).collect()}
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    assert set(got) == {i for i, _ in rows}
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, w in rows:
        if not katz.held_out(i):
            seq = [b" ", *w, b""]
            uni.update(seq[1:])
            bi.update(zip(seq, seq[1:]))
            ctx.update(seq[:-1])
    n, v = sum(uni.values()), len(uni)

    def ratios(c):
        of = Counter(c.values())
        return katz.ratios({r: of[r] for r in range(1, 17)} | {0: sum(r * k for r, k in of.items() if r >= 16)})

    cls = lambda k: int(np.searchsorted(katz.CLASSES, k, "right") - 1)
    d1, d2 = ratios(uni), ratios(bi)
    p = {w: d1[cls(c)] * c / n for w, c in uni.items()}
    unknown = 1 - math.fsum(p.values())
    left, mass = defaultdict(float), defaultdict(float)
    for (a, b), c in bi.items():
        left[a] += c * (1 - d2[cls(c)])
        mass[a] += p[b]
    for a in list(ctx)[:50]:  # every distribution sums to one
        seen = {b: d2[cls(c)] * c / ctx[a] for (x, b), c in bi.items() if x == a}
        back = left[a] / ctx[a] / (1 - mass[a])
        assert math.isclose(sum(seen.values()) + back * (sum(q for w, q in p.items() if w not in seen) + unknown), 1, rel_tol=1e-9)
    for i, w in rows:
        s = base = 0.0
        seq = [b" ", *w, b""]
        for a, b in zip(seq, seq[1:]):
            if (a, b) in bi:
                s += math.log10(d2[cls(bi[a, b])] * bi[a, b] / ctx[a])
            else:
                s += math.log10(p.get(b, unknown)) + (math.log10(left[a] / ctx[a] / (1 - mass[a])) if a in ctx else 0)
            base += math.log10((uni[b] + 1) / (n + v + 1))
        r = got[i]
        assert math.isclose(r.score, s, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (katz.held_out(i), len(w) + 1, sum(b in uni for b in seq[1:]), n)


def test_katz_edges(edge_docs, no_docs):
    got = katz.score(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 7)} == {1}
    same = [r.score for r in got if r.doc_id == 2]
    assert len(same) == 2 and math.isclose(*same, rel_tol=1e-12)
    assert katz.score(no_docs).count() == 0
    alone = edge_docs.where("doc_id = 8 or doc_id = 5")
    only_held = alone.where("false").unionByName(*[edge_docs.where(f"doc_id = {i}") for i in range(1, 9) if katz.held_out(i)][:1])
    for r in katz.score(only_held).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.score == 0


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64))
    x[:300] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [None] * 64), (5004, [1.0, 2.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    found = ann.search(df, df.where("vec_id % 100 = 0")).toPandas()
    assert set(found.query_id) == set(range(0, 3000, 100)) and (found.groupby("query_id").size() == 10).all()
    assert ann.recall(found, x, np.arange(3000)) >= 0.9
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        d = np.sqrt(((x[g.vec_id] - x[q]) ** 2).sum(1))
        assert np.allclose(d, g.score) and (np.diff(g.score) >= 0).all() and q not in set(g.vec_id)
    assert found[found.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(10))  # ties to the smaller id
    few = spark.createDataFrame(rows[400:405], "vec_id long, embedding array<double>")
    assert ann.search(few, few.limit(1)).count() == 4
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_probing_finds_all_codes_in_the_radius():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 64))
    codes = ann.Codes(x)
    shard = ann.Shard(np.arange(500), x, codes)
    for r in (0, 5, 17, 30, 64):
        want = np.nonzero(np.bitwise_count(shard.code ^ shard.code[3]).sum(1) <= r)[0]
        assert (shard.within(shard.code[3], r) == want).all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.classify(docs, labels, weights=weights).join(labels.where("doc_id % 3 = 0").drop("toxic"), "doc_id").toPandas()
    assert len(rows) > 100
    assert rows[rows.quality == 1].keep.mean() >= 0.98 and rows[rows.quality == 0].keep.mean() <= 0.15


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (3, 0, 0), (4, 0, 1), (None, 0, 0), (8, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.accepted(edge_docs, labels)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 5, 6}
    assert quality.accepted(edge_docs, labels.limit(0)).count() == edge_docs.count()
    assert quality.accepted(no_docs, labels).count() == 0


def test_empirical_bayes_shrinks_sparse_sites(spark):
    rows = [("big", "p", 0.2)] * 400 + [("small", "p", 0.0)] + [("mid", "p", 0.9)] * 50 + [(None, None, 0.9)] * 40
    sites, mean = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r.host: r.path_posterior for r in sites.collect()}
    assert got["big"] == pytest.approx(0.2, abs=0.1) and abs(got["small"] - mean) < abs(0.0 - mean) and got["mid"] > mean and got[None] > mean
