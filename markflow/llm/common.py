"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of a small side up to which it is broadcast (a row is at most some 100 bytes here); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of a small side with binary columns up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a session without one (a test) gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Files of a saved table for each core: more would not run at the same time, and each costs its own calls to the store.
FILES = 6


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/markflow/{name}-{uuid.uuid4().hex}"
    df.coalesce(FILES * spark.sparkContext.defaultParallelism).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: its cleaner follows the driver's garbage collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a materialised table of at most `rows` rows; a larger one is left to a shuffled join, which AQE splits where it is skewed."""
    return F.broadcast(df) if df.count() <= rows else df


def light(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a materialised table of at most `most` bytes (size: those of a row, to which 64 are added); else as sized()."""
    total = df.agg(F.sum(size.cast("long") + 64)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def pow2_bits(n: int, least: int) -> int:
    return max(least, math.ceil(math.log2(max(n, 1))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(x) -> bytes:
    """The bytes of an array, compressed: many values travel as one field of a row. Equal places of all values stand together, where bytes of large numbers repeat."""
    import numpy as np
    import zstandard

    x = np.ascontiguousarray(x)
    planes = x.reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(x: bytes, kind: type):
    """The array that packed() took, flat."""
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def starts(*cols):
    """Where runs of rows that are equal in all columns start."""
    import numpy as np

    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


_TABLE_SEED = 20
_BASE = 0x9E3779B97F4A7C15


def mixed(h):
    """Spreads 64-bit hashes over all bits."""
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xCA4BCAA75EC3F625)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """64-bit hashes of any substrings of a buffer of bytes, each in constant time."""

    def __init__(self, buf):
        import numpy as np

        n, base = len(buf), np.uint64(_BASE)
        table = np.random.default_rng(_TABLE_SEED).integers(0, 2**64, 256, np.uint64)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        power[:n] *= table[buf]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(power[:n], out=self.sums[1:], dtype=np.uint64)
        del power
        self.undo = np.full(n + 1, np.uint64(pow(_BASE, -1, 2**64)), np.uint64)
        self.undo[0] = 1
        np.cumprod(self.undo, out=self.undo)

    def of(self, at, end):
        return mixed((self.sums[end] - self.sums[at]) * self.undo[at])

    def every(self, length: int):
        """of(at, at + length) for all places: by slices, without arrays of places."""
        h = self.sums[length:] - self.sums[:-length]
        h *= self.undo[: len(h)]
        return mixed(h)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def set_aside(docs: DataFrame, own: list[str]) -> tuple[DataFrame, list[Column]]:
    """docs with columns named like an operator's own renamed, and the selection that gives them their names back."""
    low = {c.lower() for c in own}
    clash = [c for c in docs.columns if c.lower() in low]
    away = dict(zip(clash, unused(docs, *[f"__was_{c}" for c in clash])))
    return docs.withColumnsRenamed(away), [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]


def trim() -> None:
    """Gives memory that freed arrays left in this worker's heap back to the system, where the C library can."""
    import ctypes

    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)
