"""Quality classifier with hierarchical empirical Bayes.

Evidence of the text alone is the log-odds of a logistic regression over shape features (how many tokens end in marks,
are upper case or bare separators, how often words and lines repeat, lengths), fitted on the driver on a sample of
labelled rows of at most SAMPLE (the ones whose ids hash lowest). The evidence of a site is the mean of its texts'
probabilities, from grouped sums over all rows: sites (hosts) are shrunk towards the global mean, paths towards their
host, each by the prior strength that the method of moments finds in the spread of the groups. A text's final log-odds
are its own plus the shift of its path's posterior from the global mean.

Defined cases: a null or empty text has probability EMPTY; null hosts and paths are groups of their own. Labels that are
null or belong to no text are left out; labels that repeat an id count once each. Without labels of both kinds the text
evidence is 0 (probability one half) and nothing is rejected. Repeated rows get equal results. An empty table gives an
empty result. Other columns pass through, whatever their names; in `classify` its five result columns replace columns of
the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, set_aside, sized

#: Labelled rows that the regression is fitted on, at most.
SAMPLE = 20_000
#: A text is rejected below this posterior probability of good quality.
THRESHOLD = 0.5
EMPTY = 0.01
#: Bounds of the prior strength, in texts.
STRENGTH = (5.0, 500.0)
#: The shift that a site can give a text's log-odds, at most.
SHIFT = 1.0
N_FEATURES = 12
OWN = ["p_text", "host_posterior", "path_posterior", "score", "keep"]
_MARKS = b"#&*$%!@^~=+<>|\\/_{}[]"


def features(text: str) -> list[float]:
    """Shape of a whole text, each feature about between 0 and 3."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    marked = sum(w[-1] in _MARKS for w in words) / n
    bare = sum(len(w) == 1 and w in (b"|", b"-", b"*", b"#", b"=", b"/") for w in words) / n
    letters = raw.translate(None, bytes(set(range(128)) - set(range(65, 91)) - set(range(97, 123))))
    upper = len(raw.translate(None, bytes(set(range(256)) - set(range(65, 91))))) / max(len(letters), 1)
    marks = (len(raw) - len(raw.translate(None, _MARKS))) / len(raw)
    digits = (len(raw) - len(raw.translate(None, b"0123456789"))) / len(raw)
    twice = sum(map(bytes.__eq__, words, words[1:])) / n
    kinds = len(set(words)) / n
    lines = raw.split(b"\n")
    repeated = 1 - len(set(lines)) / len(lines)
    stops = sum(raw.count(c) for c in (b". ", b".\n", b", ", b"? ")) / n
    length = len(raw) / n
    trios = list(zip(words, words[1:], words[2:]))
    again = 1 - len(set(trios)) / len(trios) if trios else 0.0
    return [marked, bare * 3, upper, marks * 5, digits * 3, twice * 3, 1 - kinds, repeated, min(stops * 5, 3), min(length / 8, 3), again, min(math.log1p(n) / 5, 3)]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression (the last one is the constant), by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights fitted on at most `sample` labelled rows; None without rows of both kinds."""
    own = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("__id"), (F.col(label) > 0).cast("int").alias("__good"))
    picked = own.orderBy(F.xxhash64("__id"), "__id", "__good").limit(sample)
    # Of rows that repeat an id, the text with the least hash: as many rows as labels, which `sample` bounds.
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("__doc"), body.alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    met = rows.groupBy("__id", "__good").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("__least")).select("__least.__text", "__good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = met.mapInArrow(run, "x array<double>, y int").toArrow()
    x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, N_FEATURES), np.array(got.column("y").to_pylist(), float)
    order = np.lexsort(np.c_[x, y].T)  # the same sums whatever order rows came in
    return fit(x[order], y[order]) if 0 < y.sum() < len(y) else None


def scored(docs: DataFrame, weights: np.ndarray | None, text: str = "text", p: str = "__p", without: str | None = None) -> DataFrame:
    """docs with p: the probability that the text alone gives; less the column `without`."""
    names = docs.columns
    at = names.index(text)
    kept = [i for i, c in enumerate(names) if c != without]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.full(b.num_rows, 0.5)
            if weights is not None:
                for i, t in enumerate(b.column(at)):
                    t = t.as_py() or ""
                    got[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(weights[:-1], features(t)) + weights[-1]))))) if t.split() else EMPTY
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(got)], names=[*[names[i] for i in kept], p])

    kinds = ", ".join(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in kept)
    return docs.mapInArrow(run, f"{kinds}, `{p}` double")


def _strength(groups: DataFrame, of: float) -> float:
    """Prior strength in texts by the method of moments: mean variance inside groups over the variance between their means."""
    big = groups.where("n >= 2")
    r = big.agg(F.count(F.lit(1)), F.avg("inner"), F.var_pop("mean"), F.avg(F.col("inner") / F.col("n"))).first()
    if not r[0] or r[0] < 2:
        return STRENGTH[1]
    between = max(r[2] - r[3], 1e-9)
    return min(max(r[1] / between, STRENGTH[0]), STRENGTH[1])


def posteriors(slim: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) from slim(host, path, p), and the global mean."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = saved(slim.groupBy("host", "path").agg(*sums), "paths")
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = s / n if n else 0.5
    of = F.col("s") / F.col("n")
    spread = {"mean": of, "inner": F.greatest(F.col("q") / F.col("n") - of * of, F.lit(1e-6))}
    hosts = saved(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumns(spread), "hosts")
    kh = _strength(hosts, mean)
    hosts = hosts.select(F.col("host").alias("__host"), ((F.col("s") + kh * mean) / (F.col("n") + kh)).alias("host_posterior"))
    kp = _strength(paths.withColumns(spread), mean)
    met = paths.join(sized(saved(hosts, "host-posteriors")), F.col("host").eqNullSafe(F.col("__host")))
    return met.select("host", "path", "host_posterior", ((F.col("s") + kp * F.col("host_posterior")) / (F.col("n") + kp)).alias("path_posterior")), mean


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", path: str = "lang", threshold: float = THRESHOLD, weights: np.ndarray | None = None, with_text: bool = True) -> DataFrame:
    """docs (less its text, unless with_text) with p_text, host_posterior, path_posterior, score (posterior probability of good quality) and keep.

    Every text is read once for its score; the scored rows are written, and sums over them and the result read that table.
    """
    if weights is None:
        weights = train(docs, labels, text, doc_id)
    docs, back = set_aside(docs.drop(*OWN), ["__p", "__host", "__path"])
    rows = saved(scored(docs, weights, text, without=None if with_text else text), "scored")
    sites, mean = posteriors(rows.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("__p").alias("p")))
    sites = sized(saved(sites.withColumnsRenamed({"host": "__host", "path": "__path"}), "posteriors"))
    met = rows.join(sites, F.col(host).cast("string").eqNullSafe(F.col("__host")) & F.col(path).cast("string").eqNullSafe(F.col("__path")), "left")
    shift = F.least(F.greatest(_logit(F.col("path_posterior")) - _logit(F.lit(float(mean))), F.lit(-SHIFT)), F.lit(SHIFT))
    score = 1 / (1 + F.exp(-(_logit(F.col("__p")) + shift)))
    keep = F.col("score") >= threshold if weights is not None else F.lit(True)
    if not with_text:
        back = [c for c, name in zip(back, docs.columns) if name != text]
    return met.withColumn("score", score).withColumn("keep", keep).withColumnRenamed("__p", "p_text").select(*back, *OWN)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    docs, back = set_aside(docs, OWN)
    return classify(docs, labels, **options).where("keep").select(back)
