"""Ordered computations per key that survive keys of any size.

A plain window puts a whole key in one task. Here rows are range-sorted by (key, order), so a large key spreads over
partitions; what a partition must know of earlier ones (the last value, a running sum) is one row per partition and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved, sized


def _ranged(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(n, *key, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def _joined(rows: DataFrame, carry: DataFrame, key: list[str]) -> DataFrame:
    small = sized(saved(carry.toDF(*[f"c_{c}" for c in carry.columns]), "carry"))
    return rows.join(small, [F.col("__part") == F.col("c___part"), *[F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in key]], "left").drop("c___part", *[f"c_{k}" for k in key])


def last_before(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the last value that is not null among strictly earlier rows of the key (null if none)."""
    dealt = _ranged(rows.withColumn("__v", value), key, order)
    ends = dealt.where("__v is not null").groupBy("__part", *key).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    every = dealt.select("__part", *key).distinct().join(ends, ["__part", *key], "left")
    w = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.withColumn("carry", F.last("__last", True).over(w)).drop("__last")
    inner = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.last("__v", True).over(inner))
    return _joined(own, carry, key).withColumn(name, F.coalesce("__own", "c_carry")).select(*rows.columns, name)


def running_sum(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the rows of the key up to and with this one."""
    dealt = _ranged(rows.withColumn("__v", value), key, order)
    sums = dealt.groupBy("__part", *key).agg(F.sum("__v").alias("__s"))
    w = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("carry", F.sum("__s").over(w)).drop("__s")
    inner = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("__own", F.sum("__v").over(inner))
    return _joined(own, carry, key).withColumn(name, F.col("__own") + F.coalesce("c_carry", F.lit(0))).select(*rows.columns, name)


def islands(rows: DataFrame, key: list[str], order: list[str], same: Column, name: str = "island") -> DataFrame:
    """rows numbered by island: a row for which `same` (over its row and lagged ones) is false or null starts a new one."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
