import hashlib
import random
from collections import defaultdict

import numpy as np

from markflow.llm import exact_dedup, simhash, suffix_array, suffix_dedup


def test_exact_dedup_edges(edge_docs, no_docs):
    got = exact_dedup.dedup_table(edge_docs).collect()
    assert len(got) == edge_docs.count()
    groups = defaultdict(list)
    for r in edge_docs.collect():
        groups[r.text or ""].append(r.doc_id)
    for r in got:
        g = groups[r.text or ""]
        top = max(-1 if x is None else x for x in g)
        assert r.group_size == len(g) and r.keep_id == (None if top < 0 else top) and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    kept = exact_dedup.exact_dedup(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(groups)
    assert {r.kept for r in kept.collect()} <= {"x", "y", "z", None}
    assert exact_dedup.dedup_table(no_docs).count() == 0 and exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_without_broadcast(small_docs, monkeypatch):
    want = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup_table(small_docs).collect()}
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 0)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup_table(small_docs).collect()} == want


def _plain_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_the_plain_one(edge_docs):
    for r in edge_docs.limit(5).collect():
        assert simhash.simhash(r.text) == _plain_simhash(r.text)


def _components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_links_of_crowds_and_strays(spark):
    """Chains, dense clusters (cut into blocks) and far fingerprints: components equal to those of all pairs."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x)
    chain = rng.getrandbits(64)
    for _ in range(40):
        fps.add(chain)
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
    want = _components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for block in (simhash.BLOCK, 20):
        got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(df, block=block)).collect()}
        groups, true = defaultdict(set), defaultdict(set)
        for f in fps:
            groups[got.get(f, f)].add(f)
            true[want[f]].add(f)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in true.values()}


def test_chain_budgets_keep_every_near_pair():
    rng = np.random.default_rng(3)
    diff = np.zeros(20_000, np.uint64)
    for i in range(len(diff)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            diff[i] |= np.uint64(1) << np.uint64(b)
    assert simhash.budgets(diff).all()


def test_near_dedup_edges(edge_docs, no_docs):
    got = simhash.near_dedup_table(edge_docs).collect()
    assert len(got) == edge_docs.count()
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {3, 4, 7} and {r.component_id for r in got if r.doc_id in zero} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = simhash.near_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and 8 in ids
    assert simhash.near_dedup_table(no_docs).count() == 0 and simhash.near_dedup(no_docs).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = np.r_[rng.integers(1, int(rng.integers(2, 6)), rng.integers(1, 80)), 0]
        sa, b = suffix_array.suffix_array(t, 8), t.tolist()
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffix_array.common_prefixes(t, sa, np.unique(np.r_[0, rng.integers(0, len(t), 3)]), 5)
        for x, y in zip(sa[1:], sa[:-1]):
            n = 0
            while n < 5 and x + n < len(b) and y + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert shared[x] == n


def test_suffix_dedup_against_brute_force(spark, small_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    rng = random.Random(2)
    rows = [(r.doc_id, r.text or "") for r in small_docs.limit(60).collect()]
    base = rows[0][1] + rows[1][1] + rows[2][1]
    for k in range(40):
        a = rng.randrange(0, 200)
        rows.append((10_000 + k * 3, "".join(rng.choice("abc ") for _ in range(rng.randrange(50))) + base[a : a + rng.randrange(60, 400)] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(50)))))
    rows += [(20_000 + k, "a" * rng.randrange(50, 400)) for k in range(6)] + [(30_001, None), (30_002, "ab" * 90), (30_003, ""), (None, base[:150])]
    got = {r.doc_id: r for r in suffix_dedup.dedup_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    seen = set()
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(raw[p : p + 100])
        left = bytes(c for c, m in zip(raw, gone) if not m)
        runs = sum(1 for k, m in enumerate(gone) if m and (k == 0 or not gone[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), runs, hashlib.sha256(left).hexdigest())


def test_suffix_dedup_edges(edge_docs, no_docs):
    got = suffix_dedup.dedup_table(edge_docs).collect()
    assert len(got) == edge_docs.count() and suffix_dedup.dedup_table(no_docs).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].n_removed < by[5].n_bytes and by[6].n_removed >= by[6].n_bytes - 4 - 99 and by[3].n_bytes == 0


def test_suffix_dedup_joins_its_filter_once(small_docs):
    """What follows reads texts as they were written: no further lookup of each row in the filter of repeats."""
    texts, _, gone = suffix_dedup.spans(small_docs.select("doc_id", "text"))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and texts.select("doc_id").distinct().count() <= small_docs.count() and gone.columns == ["doc_id", "tie", "spans"]


def test_anchors_of_a_block_take_little_memory():
    import tracemalloc

    buf = np.random.default_rng(0).integers(97, 110, 1 << 20).astype(np.uint8)
    begins = np.arange(0, 1 << 20, 4096)
    roll = suffix_dedup.Rolling(buf)
    at = np.arange(0, 1 << 20, 997)[:-1]
    assert (roll.every(32)[at] == roll.of(at, at + 32)).all()
    tracemalloc.start()
    suffix_dedup.anchors(buf, begins, begins + 4096, roll)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * len(buf)  # it was 69


def test_small_files_are_compared_together(monkeypatch):
    """Files of a few members take no Python step each; a file full of links goes to the forest."""
    rng = np.random.default_rng(6)
    size = rng.integers(2, 9, 400)
    fp, cut = rng.integers(0, 2**64, size.sum(), np.uint64), np.cumsum(size) - size
    fp[cut[::2] + 1] = fp[cut[::2]] ^ np.uint64(1 << 40 | 3)
    full = slice(cut[7], cut[7] + size[7])
    fp[full] = fp[cut[7]] ^ (np.uint64(1) << np.arange(size[7], dtype=np.uint64))
    calls, real = [], simhash.budgets
    monkeypatch.setattr(simhash, "budgets", lambda *a, **k: calls.append(1) or real(*a, **k))
    a, b, thick = simhash.paired(fp, cut, size)
    assert len(calls) == size.max() - 1
    got = {(int(x), int(y)) for x, y in zip(np.concatenate(a), np.concatenate(b))}
    want, dense = set(), set()
    for k, (s, n) in enumerate(zip(cut, size)):
        own = {(int(fp[i]), int(fp[j])) for i in range(s, s + n) for j in range(i + 1, s + n) if int(fp[i] ^ fp[j]).bit_count() <= 4}
        if len(own) < n:
            want |= own
        else:
            dense.add(k)
    assert got == want and set(np.nonzero(thick)[0].tolist()) == dense and (7 in dense or size[7] < 3)


def test_suffix_array_takes_few_steps():
    """Each round doubles what is compared: no step for each wave of places, even where all symbols are equal."""
    import sys

    rng = np.random.default_rng(8)
    for t in (np.r_[rng.integers(1, 30, 20_000), 0], np.r_[np.full(5_000, 7), 0], np.r_[np.tile(rng.integers(1, 30, 700), 6), 0]):
        calls = []
        sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "c_call" else None)
        try:
            sa = suffix_array.suffix_array(t, 256)
        finally:
            sys.setprofile(None)
        assert len(calls) < 600  # waves took thousands
        raw = t.astype(np.uint8).tobytes()
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        assert (suffix_array.suffix_array(t, 1 << 60) == sa).all()  # symbols too wide to be sorted with their places


def test_contexts_of_a_block_travel_together():
    """A block's contexts come in a batch of up to 10,000, not one for each document; each is its text's bytes, keyed by its half."""
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(90))
    texts = ["".join(rng.choice("ijk lmn") for _ in range(150)) + passage + "x" * (i % 7) + "".join(rng.choice("opq rst") for _ in range(i)) for i in range(60)]
    firsts = [np.array([0, 33, 34, 150, 160, len(t.encode()) - 32]) for t in texts]
    rows = pa.table([pa.array(range(60), pa.int64()), pa.array([7] * 60, pa.int64()), pa.array(texts), pa.array([suffix_dedup.packed(x) for x in firsts])], names=["doc_id", "tie", "text", "firsts"])
    got = list(suffix_dedup._contexts(Rows(), 4)(iter(rows.to_batches(max_chunksize=25))))
    assert len(got) == 2  # one for each side; it was 60
    want = set()
    for i, t in enumerate(texts):
        raw = t.encode()
        for a in firsts[i].tolist():
            for s, e in [(a - 34, a + 32)] * (a >= 34) + [(a, a + 66)] * (a + 66 <= len(raw)):
                want.add((raw[s:e], i, 7, max(e - 100, 0), raw[max(e - 100, 0) : s + 100], s != a))
    keys = defaultdict(set)
    for r in pa.Table.from_batches(got).to_pylist():
        half = next(w for w in want if w[1:5] == (r["doc_id"], r["tie"], r["at"], r["body"]) and w[5] == (r["key"] % 2 == 0))
        want.discard(half)
        keys[r["key"]].add((half[0], half[5]))
    assert not want and all(len(v) == 1 for v in keys.values()) and len(keys) == len({x for v in keys.values() for x in v})
