"""URL filter: dated list entries become validity intervals, and an as-of join tests every capture at its fetch time.

A list is a log of events (entry, at, active): from `at` on the entry, a domain with all its subdomains, is on the list
or off it, until its next event. Events of one entry at one time count as on if any says so. A capture's result depends on
its host and fetch time alone, so distinct (host, time) pairs are taken first: a very common host is looked up once per
time, not once per capture. Each pair meets the events of its host and parent domains by equality and its time by the
interval. Verdicts go back to captures by (host, time): broadcast if few, else in a shuffled join that AQE splits where it
is skewed.

Defined cases: a null URL, or one without a host, is never blocked; so is a null fetch time. Events with a null entry or
time are left out. Of several active entries the longest domain is named. Repeated captures get equal results. Without
events nothing is blocked. An empty table gives an empty result. Other columns pass through; the operator's own replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, set_aside, sized

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, '' if it has none."""
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), HOST, 1), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, since, until): when each entry is on the list; until is null while it still is."""
    once = events.where("entry is not null and at is not null").groupBy(F.lower("entry").alias("entry"), "at").agg(F.max(F.coalesce("active", F.lit(False))).alias("active"))
    w = Window.partitionBy("entry").orderBy("at")
    return once.withColumn("until", F.lead("at").over(w)).where("active").select("entry", F.col("at").alias("since"), "until")


def as_of(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with host, blocked, entry (the one that blocks it) and since (when it was listed)."""
    captures, back = set_aside(captures.drop("host", "blocked", "entry", "since"), ["__h", "__t"])
    captures = captures.withColumn("host", host_of(F.col(url)))
    asked = captures.where((F.col("host") != "") & F.col(at).isNotNull()).select(F.col("host").alias("__h"), F.col(at).alias("__t")).distinct()
    labels = F.split("__h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = asked.select("__h", "__t", F.explode(parents).alias("name"))
    valid = sized(saved(intervals(events), "intervals"))
    active = names.join(valid, (F.col("name") == F.col("entry")) & (F.col("__t") >= F.col("since")) & (F.col("until").isNull() | (F.col("__t") < F.col("until"))))
    verdicts = active.groupBy("__h", "__t").agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "since")).alias("v")).select("__h", "__t", F.col("v.entry").alias("entry"), F.col("v.since").alias("since"))
    met = captures.join(sized(saved(verdicts, "verdicts")), (F.col("host") == F.col("__h")) & (F.col(at) == F.col("__t")), "left")
    return met.select(*back, "host", F.col("entry").isNotNull().alias("blocked"), "entry", "since")
