"""Mixing sources to target weights.

Every row gets a random key from a hash; rows are range-sorted by (source, key), so a large source spreads over many
partitions; sums per partition give each one its offset, and a running sum inside the partition completes the prefix
sum. The budget of a source is its target rounded to whole words: whole epochs first, then the rows in key order up to
the exact word.

Defined cases: a null text has no words. A null source is a source of its own, ordered last. Targets are
min(2 * size, weight * level) with one level for all sources; sources without words get 0. Repeated rows are rows like
any other. An empty table gives an empty result. Keys depend on id and text only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, saved, sized, text_of, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def offsets(rows: DataFrame, order: list[str], value: str, key: list[str] | None = None) -> DataFrame:
    """rows with __before: the sum of `value` over the rows of the same `key` that come earlier in `order` (which starts with key).

    No group meets in one task: range partitions bound what a window sees, and the sums of partitions are one row each.
    """
    key = key or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__part", *key).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    inner = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("__run", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    sums = sized(saved(sums, "sums").toDF(*[f"s_{c}" for c in sums.columns]))
    out = run.join(sums, [F.col("__part") == F.col("s___part"), *[F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key]])
    return out.withColumn("__before", F.col("__run") + F.col("s___base")).select(*rows.columns, "__before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """sizes(source, source_size) with target: `share` of all sizes dealt by weight, none above `epochs` times its size."""
    ranked = offsets(
        sizes.withColumns({"__null": F.col("source").isNull(), "__one": F.lit(1).cast("long")}), ["__null", "source"], "__one"
    )
    arms = F.array(*[F.lit(w) for w in weights])
    ranked = saved(ranked.withColumn("weight", F.element_at(arms, (F.pmod("__before", F.lit(len(weights))) + 1).cast("int"))), "sources")
    cap = F.col("source_size") * epochs
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while total:  # each round caps at least one more source, or ends
        row = ranked.where(~full).agg(F.sum("weight")).first()[0]
        spent = ranked.where(full).agg(F.sum(cap)).first()[0] or 0
        if not row:
            break
        level = (share * total - spent) / row
        more = F.col("weight") * F.lit(level) >= cap
        if not ranked.where(~full & more).limit(1).count():
            break
        full = more
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def _placed(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """doc_id, source, size, key, __before (words of the source before the row), source_size, target, __whole (epochs) and __rest (words of the last one)."""
    body = text_of(text)
    slim = saved(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
            F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(doc_id), body).alias("key"),
        ), "sizes",
    )
    aim = saved(targets(saved(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")), "targets")
    placed = offsets(slim.withColumn("__null", F.col("source").isNull()), ["__null", "source", "key", "doc_id", "size"], "size", ["__null", "source"])
    met = placed.join(sized(aim.withColumnRenamed("source", "s_source")), F.col("source").eqNullSafe(F.col("s_source")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    return met.withColumn("__whole", whole).withColumn("__rest", budget - F.col("__whole") * F.col("source_size"))


def mix_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, and key (the random order)."""
    taken = F.col("__whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before")))
    return _placed(docs, text, doc_id, source).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix itself: rows of docs repeated by epoch; the row on which a source's budget ends keeps only its words inside the budget.

    Rows that nothing is taken of go. No text moves: of each source, whole epochs and the row on which its budget ends
    (key, id, words left) say what becomes of a row. Where that row repeats, its c copies share the words left evenly,
    which leaves c - 1 words out at most. Other columns pass through, whatever their names.
    """
    placed = saved(_placed(docs, text, doc_id, source), "placed")
    last = placed.where("size > 0 and __before < __rest and __before + size >= __rest").select("source", "key", "doc_id")
    row = ["source", "key", "doc_id"]
    equal = last.select(*[F.col(c).alias(f"l_{c}") for c in row])
    equal = placed.where("size > 0").join(sized(saved(equal, "last")), [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in row], "left_semi")
    left = F.floor(F.least(F.max("__rest") - F.min("__before"), F.sum("size")) / F.count(F.lit(1)))
    cuts = equal.groupBy("source").agg(F.first("key").alias("k"), F.first("doc_id").alias("i"), left.alias("left"), F.first("size").alias("size"))
    whole = placed.groupBy("source").agg(F.max("__whole").alias("whole")).alias("w")
    plan = saved(whole.join(cuts.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left").select("w.source", "whole", "k", "i", "left", "size"), "plan")
    names = unused(docs, "__plan", "__key", "__copy", "__n", "__text")
    p, key, copy, n, new = names
    plan = sized(plan).select(F.struct("source", "whole", "k", "i", "left", "size").alias(p))
    rows = docs.withColumn(key, F.xxhash64(F.col(doc_id), text_of(text))).where(F.rlike(text_of(text), F.lit(r"[^\x20\x09-\x0D]")))
    met = rows.join(plan, F.col(source).cast("string").eqNullSafe(F.col(f"{p}.source")))
    # Before the last row in (key, id), nulls first, or on it, or after it.
    ends = (F.col(key) == F.col(f"{p}.k")) & F.col(doc_id).eqNullSafe(F.col(f"{p}.i"))
    before = (F.col(key) < F.col(f"{p}.k")) | (F.col(key) == F.col(f"{p}.k")) & (F.col(doc_id).isNull() & F.col(f"{p}.i").isNotNull() | (F.col(doc_id) < F.col(f"{p}.i")))
    more = F.when(F.coalesce(before, F.lit(False)) | F.coalesce(ends, F.lit(False)) & (F.col(f"{p}.left") > 0), 1).otherwise(0)
    met = met.withColumn(n, (F.col(f"{p}.whole") + more).cast("int")).where(F.col(n) > 0)
    met = met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    short = F.coalesce(ends, F.lit(False)) & (F.col(copy) > F.col(f"{p}.whole")) & (F.col(f"{p}.left") < F.col(f"{p}.size"))
    words = F.filter(F.split(text_of(text), GAP), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col(f"{p}.left").cast("int")), " ")
    out = met.withColumn(new, F.when(short, cut).otherwise(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(short, F.length(new).cast("long")).otherwise(F.col(n_chars)))
    return out.withColumn(text, F.col(new)).select(docs.columns)
