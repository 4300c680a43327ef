"""Exact dedup: a Bloom filter of positions hit twice picks the rows that may repeat; only those shuffle.

Pass 1 hashes each text to one of m >= 32 n bit positions and counts hits per position (combined in each task before
the shuffle, eight bytes a row and no text). Positions hit at least twice form the filter, kept as 64-bit words of a
sparse bitmap. Pass 2 looks every row up in it: at most one unique row in 32 is let through by chance. Rows that miss
pass straight through without a shuffle; the others are grouped by their SHA-256.

Defined cases: a null text equals an empty one. Of equal texts the largest id stays (a null id is smaller than any).
Rows that repeat both id and text all carry kept = true in `dedup_table`; `exact_dedup` returns one of them. An empty
table gives an empty result. Other columns pass through untouched, whatever their names; only in `dedup_table` do its four
result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pow2_bits, saved, set_aside, sized, text_of

#: Bit positions per row. One hash function: at n rows a unique row is let through with probability of 1/32 at most.
BITS_PER_ROW = 32
#: Words of the filter up to which it is broadcast (about 64 bytes each in the hash table); beyond it the lookup shuffles.
FILTER_WORDS = 500_000
_OWN = ["__sha", "__word", "__bit", "__mask", "__maybe"]
_RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def repeat_filter(texts: DataFrame, text: Column) -> tuple[DataFrame, int]:
    """(__word, __mask): the sparse bitmap of positions that at least two rows hit; and the number of position bits."""
    bits = pow2_bits(BITS_PER_ROW * texts.count(), 20)
    pos = F.xxhash64(text).bitwiseAND(F.lit((1 << bits) - 1))
    twice = texts.select(pos.alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = twice.groupBy(F.shiftright("pos", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pos & 63L as int))")).alias("__mask")
    )
    return words, bits


def marked(docs: DataFrame, text: str) -> DataFrame:
    """docs, which has no column of _OWN, with __sha and __maybe (its position was hit twice)."""
    body = text_of(text)
    words, bits = repeat_filter(docs, body)
    words = sized(saved(words, "repeats"), FILTER_WORDS)
    pos = F.xxhash64(body).bitwiseAND(F.lit((1 << bits) - 1))
    return (
        docs.withColumns({"__sha": F.sha2(body, 256), "__word": F.shiftright(pos, 6), "__bit": pos.bitwiseAND(F.lit(63)).cast("int")})
        .join(words, "__word", "left")
        .withColumn("__maybe", F.expr("coalesce(shiftright(__mask, __bit) & 1L, 0L) = 1L"))
        .drop("__word", "__bit", "__mask")
    )


def _table(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs, which has no column of _OWN or _RESULT, with those of _RESULT."""
    rows = marked(docs, text)
    alone = rows.where("not __maybe").withColumns({"keep_id": F.col(doc_id), "group_size": F.lit(1).cast("long")})
    maybe = rows.where("__maybe")
    groups = saved(maybe.groupBy("__sha").agg(F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = maybe.join(sized(groups), "__sha", "left")
    out = alone.unionByName(met.select(alone.columns))
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id"))).withColumnRenamed("__sha", "text_sha256").drop("__maybe")


def dedup_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of docs plus keep_id, group_size, kept, text_sha256; one row per row of docs."""
    docs, back = set_aside(docs.drop(*_RESULT), _OWN)
    return _table(docs, text, doc_id).select(*back, *_RESULT)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs less all but one row of each group of equal texts."""
    docs, back = set_aside(docs, [*_OWN, *_RESULT])
    rows = _table(docs, text, doc_id).where("kept")
    # Only where an id itself repeats are there two kept rows of one text.
    single = rows.where("group_size = 1")
    again = rows.where("group_size > 1").dropDuplicates([doc_id, "text_sha256"])
    return single.unionByName(again).select(back)
