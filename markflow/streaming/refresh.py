"""Incremental refresh: a file stream of entity snapshots is merged into the stored version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert


def refresh(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], digest: str) -> StreamingQuery:
    """Merges every new Parquet file under `source` into `target`; each batch writes the next version folder.

    A batch that is run again after a failure finds its version folder and writes it anew from the one before, so each
    file counts once.
    """

    def merge(batch: DataFrame, n: int) -> None:
        path = f"{target}/version={n}"
        incoming = batch.groupBy(*keys).agg(F.max(digest).alias(digest))
        if n == 0:
            incoming.withColumn("is_deleted", F.lit(False)).write.mode("overwrite").parquet(path)
            return
        before = spark.read.parquet(f"{target}/version={n - 1}")
        upsert(before, incoming, keys, digest).drop("action").write.mode("overwrite").parquet(path)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
