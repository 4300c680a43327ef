import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from markflow.llm import near_copies, simhash


def _sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def _kept(rows):
    """Smallest id of each component of all pairs at 0.8."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [_sets(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if 9 * c >= 4 * (len(a) + len(sets[j])):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted(min(v) for v in least.values())


@pytest.fixture(scope="module")
def rows():
    """Copies with a few words replaced, at similarities around 0.8, beside strays that share a long passage; short and empty texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((30, 100, 300)))]
        for _ in range(8):
            x = list(base)
            for at in rng.sample(range(len(x)), rng.randrange(0, 1 + len(x) // 30)):
                x[at] = word()
            out.append(" ".join(x))
    line = " ".join(word() for _ in range(40))
    out += [line + " " + " ".join(word() for _ in range(30)) for _ in range(30)] + ["", "  \n", "one two", "ONE  two", "one two three", None]
    return list(enumerate(out))


def test_stage_removes_all_copies_at_the_similarity(spark, rows):
    """The pipeline's stage against all pairs; most of these differ in more than four bits of their fingerprints."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect())
    assert got == _kept(rows)
    assert len(got) < simhash.near_dedup(docs).count()
    assert near_copies.near_dedup(docs.limit(0)).count() == 0


def test_crowds_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.fingerprints(docs, words=near_copies.WORDS)
    nodes = prints.selectExpr("doc_id", "tie", "tie as fp")
    labelled = simhash.standing(nodes, lambda _: near_copies.near_links(docs, prints, crowd=3))
    assert sorted({r.first.doc_id for r in labelled.collect()}) == _kept(rows)


def test_prefixes_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 60, int(rng.integers(1, 80))).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 60, int(rng.integers(0, 8))).astype(np.uint64)])
        common = np.sort(rng.permutation(a)[: len(a) // 2])
        counts = rng.integers(4, 9, len(common))
        c = len(np.intersect1d(a, b))
        if len(b) and 9 * c >= 4 * (len(a) + len(b)):
            assert len(np.intersect1d(near_copies.prefix(a, common, counts), near_copies.prefix(b, common, counts)))


def test_bits_bound_the_difference():
    rng = np.random.default_rng(9)
    for n in (1, 5, 70, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            b = np.unique(np.r_[a[rng.random(len(a)) > rng.random()], rng.integers(0, 1 << 60, int(rng.integers(0, n + 1))).astype(np.uint64)])
            if len(b):
                assert near_copies.differ(near_copies.parity(a), near_copies.parity(b)) <= len(np.setxor1d(a, b))
    a, b = (rng.integers(0, 1 << 60, 500).astype(np.uint64) for _ in range(2))
    assert near_copies.differ(near_copies.parity(a), near_copies.parity(b)) > 1000 / 9
