"""Session, tables, materialisation and the semi-naive fixpoint loop."""

from __future__ import annotations

import inspect
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a materialised small side up to which it is broadcast; beyond it joins shuffle and AQE handles skew.
BROADCAST_ROWS = 200_000
#: Files of a saved table for each core: more would not run at the same time, and each costs its own calls to the store.
FILES = 6


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; cluster settings given at submit time win."""
    b = SparkSession.builder.appName("markflow").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/markflow/{name}-{uuid.uuid4().hex}"
    df.coalesce(FILES * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a materialised table of at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fixpoint(
    seed: DataFrame,
    step: Callable[..., DataFrame],
    keys: list[str] | None = None,
    max_rounds: int | None = None,
    deadline_s: float | None = None,
) -> tuple[DataFrame, bool]:
    """Least set that holds `seed` and is closed under `step`: (rows, whether the fixpoint was reached).

    step(new, known, round) may also take what was known before the round's new rows, where a rule joins the relation with
    itself.

    Semi-naive: step sees only rows that are new since the last round; its result is made distinct and reduced by an anti
    join on `keys` (all columns by default) with everything known. Each round writes its new rows once; known rows are the
    union of those files, so no round recomputes another. Columns that are no keys are kept from the first round that found
    the key (of one round, the smallest). Without a limit it runs until nothing is new. A round or time limit returns what was
    found until then, and False.
    """
    cols = seed.columns
    keys = keys or cols
    rest = [c for c in cols if c not in keys]

    def one(df: DataFrame) -> DataFrame:
        df = df.select(cols)
        return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*").select(cols) if rest else df.distinct()

    whole = len(inspect.signature(step).parameters) == 3
    began = time.monotonic()
    new = known = saved(one(seed), "seed")
    n = 0
    while max_rounds is None or n < max_rounds:
        n += 1
        if not new.limit(1).count():
            return known, True
        if deadline_s is not None and time.monotonic() - began > deadline_s:
            return known, False
        found = one(step(new, known, n) if whole else step(new, n)).alias("f")
        old = known.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
        same = [F.col(f"f.{k}").eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        new = saved(found.join(old, same, "left_anti"), "delta")
        known = known.unionAll(new)
    return known, not new.limit(1).count()


class LimitReached(RuntimeError):
    """A fixpoint met its limit while rows were still new."""


def closed(seed: DataFrame, step: Callable[..., DataFrame], keys: list[str] | None = None, max_rounds: int | None = None) -> DataFrame:
    """The rows of fixpoint(), which must be reached: at a round limit it raises rather than give a part of them."""
    rows, reached = fixpoint(seed, step, keys, max_rounds)
    if not reached:
        raise LimitReached(f"no fixpoint after {max_rounds} rounds")
    return rows
