import math
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from markflow.llm import licenses, mixing, sentencepiece, url_filter
from tests.conftest import SF, duck_rows, rows_of
from tests.llm.conftest import CLASH
from tests.llm.test_near_copies import _kept

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_mixing_against_plain_targets(small_docs, edge_docs, no_docs):
    for docs in (small_docs, edge_docs):
        got = mixing.mix_table(docs).collect()
        assert len(got) == docs.count()
        size = Counter()
        for r in docs.collect():
            size[r.source] += len([w for w in (r.text or "").encode().split()])
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        total, full = sum(size.values()), set()
        while True:
            level = (1.5 * total - sum(2 * size[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
            more = {s for s in order if s not in full and weight[s] * level >= 2 * size[s]}
            if not more:
                break
            full |= more
        target = {s: 2 * size[s] if s in full else weight[s] * level for s in order}
        taken = Counter()
        for r in got:
            assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
        assert rows_of(mixing.mix_table(docs)) == rows_of(mixing.mix_table(docs))
    assert mixing.mix_table(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_mix_takes_the_words_of_its_table(small_docs, edge_docs):
    for docs in (small_docs, edge_docs):
        want, got = defaultdict(int), defaultdict(int)
        for r in mixing.mix_table(docs).collect():
            want[r.doc_id] += r.taken
        rows = mixing.mix(docs)
        assert rows.columns == docs.columns
        for r in rows.collect():
            got[r.doc_id] += len((r.text or "").encode().split())
        assert all(abs(want[i] - got[i]) <= 3 for i in want)


def test_prefix_sums_of_a_hot_key(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) as key", "id", "id % 7 as v")
    got = mixing.offsets(df, ["key", "id"], "v", ["key"]).collect()
    run = Counter()
    for r in sorted(got, key=lambda r: r.id):
        assert r["__before"] == run[r.key]
        run[r.key] += r.v


def _best(p, t):
    """Best total score over t by trying all pieces, each character without one at the price of an unknown one."""
    longest = max(map(len, p.ordinary))
    top = [0.0] + [-math.inf] * len(t)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - longest), e):
            piece = t[s:e]
            if piece in p.ordinary:
                top[e] = max(top[e], top[s] + p.ordinary[piece][1])
            elif e - s == 1:
                top[e] = max(top[e], top[s] + p.worst)
    return top[-1]


def _score(p, ids, t):
    score, byte = {i: s for i, s in p.ordinary.values()}, set(p.bytes.values())
    return sum(score[i] for i in ids if i not in byte) + sum(1 for c in t if c not in p.ordinary) * p.worst


def test_viterbi_is_best_and_round_trips(spark):
    """On real lines the path's score is the best there is, so at least the library's, and texts come back."""
    with open(MODEL, "rb") as f:
        model = f.read()
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    a = sentencepiece.Automaton(sentencepiece.Pieces(model))
    p = a.pieces
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1  # the library's Viterbi over the same pieces; on some lines it takes a worse path
    lib = SentencePieceProcessor(model_proto=proto.SerializeToString())
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(160).collect()
    lines = [r.text.split("\n")[0][:300] for r in rows]
    assert sum(map(bool, lines)) >= 150
    for line in filter(None, lines):
        got, want, t = a.encode(line), lib.encode(line), sentencepiece.SPACE * p.prefix + line.replace(" ", sentencepiece.SPACE)
        assert _score(p, got, t) == pytest.approx(_best(p, t))
        if not any(proto.pieces[i].type == 6 for i in want):
            assert _score(p, got, t) >= sum(proto.pieces[i].score for i in want) - 1e-6
    for t in (*[r.text for r in rows[:40]], "", " ", "  two  spaces ", "\n\n\ttabs", "日本語 🙂 \x00\x01", "a" * 500, "É" * 70):
        assert a.decode(a.encode(t)) == t


def test_viterbi_against_brute_force():
    with open(MODEL, "rb") as f:
        a = sentencepiece.Automaton(sentencepiece.Pieces(f.read()))
    for t in ("hello▁world", "▁▁▁x", "éàü▁zß", "▁internationalization", "qqqqq\n▁y"):
        assert _score(a.pieces, a.viterbi(t), t) == pytest.approx(_best(a.pieces, t))


def test_encode_edges(edge_docs, no_docs):
    rows = sentencepiece.encode(edge_docs, MODEL)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[3].ids is None and got[4].ids == [] and all(r.round_trip for i, r in got.items() if i not in (3, 8))
    back = {r.doc_id: r.decoded for r in sentencepiece.decode(rows, MODEL).collect()}
    assert back[5] == got[5].text and back[3] is None
    assert sentencepiece.encode(no_docs, MODEL).count() == 0


def test_licenses(spark, edge_docs, no_docs):
    rows = [(1, "some prose\nReleased under the MIT License.\nmore"), (2, licenses.TEMPLATES[1][1]), (3, None), (4, "nothing here"), (5, "THIS WORK IS LICENSED under the\nGNU general public license version 3"), (6, "under the license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1].license, got[1].dice, got[1].line, got[1].n_lines) == ("MIT", 1.0, 1, 1)
    assert got[2].license == "Apache-2.0 header" and (got[5].license, got[5].line) == ("GPL-3.0", -1)
    assert licenses.scan(edge_docs).count() == 0 and licenses.scan(no_docs).count() == 0


def test_license_hints_lose_no_match():
    """Whatever a unit drops from a template, if its Dice reaches the threshold it still holds a hint."""
    import random
    import re

    rng = random.Random(1)
    long, short = licenses.hints()
    for _, t in licenses.TEMPLATES:
        w = licenses._words(t)
        for _ in range(300):
            x = [a for a in w if rng.random() > 0.12]
            x[rng.randrange(len(x) + 1) : 0] = ["zz"] * rng.randrange(3)
            p, q = Counter(zip(w, w[1:])), Counter(zip(x, x[1:]))
            if 2 * sum((p & q).values()) / (len(w) + len(x) - 2) >= licenses.THRESHOLD:
                unit = " ".join(x)
                assert any(h in unit for h in long) or any(re.search(h, unit) for h in short)


def test_url_filter_intervals(spark):
    events = spark.createDataFrame([("Bad.org", 10, True), ("bad.org", 20, False), ("bad.org", 30, True), ("x.bad.org", 5, True), (None, 1, True), ("e.org", 1, True), ("e.org", 1, False)], "entry string, at int, active boolean")
    rows = [(1, "http://bad.org/", 9), (2, "http://bad.org/", 10), (3, "https://u@WWW.Bad.org:80/p?q", 19), (4, "http://bad.org", 20), (5, "http://a.bad.org#f", 99), (6, "http://x.bad.org/", 50), (7, "http://notbad.org/", 50), (8, None, 50), (9, "no url", 50), (10, "http://bad.org/", None), (11, "http://e.org", 1), (2, "http://bad.org/", 10)]
    caps = spark.createDataFrame([(*r, "mine", "H", "T", "name") for r in rows], "page_id long, url string, fetched_at int, entry string, h string, t string, name string")
    assert {(r.h, r.t, r["name"]) for r in url_filter.as_of(caps, events).collect()} == {("H", "T", "name")}
    got = defaultdict(list)
    for r in url_filter.as_of(caps, events).collect():
        got[r.page_id].append((r.blocked, r.entry))
    assert {i for i, g in got.items() if g[0][0]} == {2, 3, 5, 6, 11} and got[2] == [(True, "bad.org")] * 2 and got[6] == [(True, "x.bad.org")]
    assert url_filter.as_of(caps.limit(0), events).count() == 0 and not any(r.blocked for r in url_filter.as_of(caps, events.limit(0)).collect())


@pytest.mark.parametrize("name", ["op3_license_scan", "op5_url_filter", "op7_exact_dedup"])
def test_against_sql(spark, name):
    from markflow.llm import queries

    df = queries.queries()[name](spark, SF)
    names, want = duck_rows(queries.oracle_sql()[name])
    assert sorted(df.columns) == names and rows_of(df) == want


def test_pipeline_against_its_parts(spark):
    """The five stages against plain Python over the same rows; quality decisions are the classifier's own."""
    from markflow.llm import quality

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    rows = [r for r in quality.classify(docs, labels).collect() if r.keep]
    by_text = {}
    for r in rows:
        if r.text not in by_text or by_text[r.text].doc_id < r.doc_id:
            by_text[r.text] = r
    stands = set(_kept([(r.doc_id, r.text) for r in by_text.values()]))  # components of all pairs of five-word Jaccard 0.8 or more
    stay = [r for r in by_text.values() if r.doc_id in stands]
    assert len(stay) < len(by_text)
    size, words = Counter(), Counter()
    for r in stay:
        size[r.source] += len(r.text.encode().split())
    text = {r.doc_id: r.text for r in stay}
    with open(MODEL, "rb") as f:
        a = sentencepiece.Automaton(sentencepiece.Pieces(f.read()))
    for r in got:
        t = a.decode(r.ids)
        assert r.round_trip and (t == text[r.doc_id] or t.split() == text[r.doc_id].split()[: len(t.split())])
        words[r.source] += len(t.encode().split())
    total = sum(size.values())
    assert abs(sum(words.values()) - 1.5 * total) <= len(size) and all(words[s] <= 2 * size[s] + 1 for s in size)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "sentencepiece"]


def test_columns_of_any_name_pass_through(edge_docs):
    """Operators that give rows of docs back leave all columns that are not theirs as they are."""
    from markflow.llm import exact_dedup, near_copies, quality, simhash

    labels = edge_docs.sparkSession.createDataFrame([(1, 1), (5, 1), (3, 0)], "doc_id long, quality int")
    whole = [exact_dedup.exact_dedup(edge_docs), simhash.near_dedup(edge_docs), near_copies.near_dedup(edge_docs), quality.accepted(edge_docs, labels), mixing.mix(edge_docs)]
    more = [exact_dedup.dedup_table(edge_docs), quality.classify(edge_docs, labels), sentencepiece.encode(edge_docs, MODEL)]
    for df in whole:
        assert df.columns == edge_docs.columns
    for df in [*whole, *more]:
        names = [c for c in CLASH if df.schema[c].dataType.simpleString() == "string"]
        assert len(names) >= len(CLASH) - 2
        for r in df.collect():
            assert all(r[c].split(" ")[0] == c for c in names)


def test_remembered_paths_are_the_best_paths(monkeypatch):
    with open(MODEL, "rb") as f:
        a = sentencepiece.Automaton(sentencepiece.Pieces(f.read()))
    monkeypatch.setattr(sentencepiece, "CACHE", 6)
    words = ["the", "of", "überall", "a" * 80, "\U0001f642x", "один", "two", "three", "four"]
    for k in range(200):
        text = " ".join(words[(k * 7 + j * j) % len(words)] for j in range(12))
        parts = sentencepiece.re.findall("▁*[^▁]+|▁+", "▁" * a.pieces.prefix + text.replace(" ", "▁"))
        assert a.encode(text) == [i for p in parts for i in a.viterbi(p)] and a.decode(a.encode(text)) == text
        assert len(a.paths) <= 3 and len(a.paths.older) <= 3
    assert a.encode("") == [] and a.decode([]) == ""
