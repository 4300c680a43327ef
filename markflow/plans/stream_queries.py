"""Streams over the driver's files, run until what is there is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import patterns as P
from ..runtime import shared_dir
from ..streaming import automaton, refresh
from . import views
from .registry import query

_SYM = ["signup", "view", "click", "purchase", "error"]


@query(f"""WITH {views.EVENTS}, w AS (SELECT user_id, string_agg(CASE event_type WHEN 'signup' THEN 's' WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE 'e' END, '' ORDER BY event_id) AS w FROM ev GROUP BY 1)
SELECT user_id, regexp_matches(w, 'ss.*pp') AND NOT regexp_matches(w, 'eee') AS matched FROM w""")
def t31_r30_stream_automaton(spark, d):
    dfa = P.compile_formula(("and", ("pattern", ["signup", "signup", "...", "purchase", "purchase"]), ("not", ("pattern", ["error", "error", "error"]))), _SYM)
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{d}/events.parquet*")
    out = f"{shared_dir(spark)}/markflow/stream-{uuid.uuid4().hex}"
    rows = automaton.run(stream, "user_id", "event_id", "event_type", dfa, _SYM)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("user_id long, at long, matched boolean").parquet(f"{out}/rows")
    return done.groupBy("user_id").agg(F.max_by("matched", "at").alias("matched"))


@query("SELECT c_custkey, c_mktsegment, false AS is_deleted FROM customer")
def t31_s15_refresh_stream(spark, d):
    out = f"{shared_dir(spark)}/markflow/refresh-{uuid.uuid4().hex}"
    schema = "c_custkey long, c_mktsegment string"
    refresh.refresh(spark, f"{d}/customer.parquet*", schema, f"{out}/store", f"{out}/state", ["c_custkey"], "c_mktsegment").awaitTermination()
    return spark.read.parquet(f"{out}/store/version=0").select("c_custkey", "c_mktsegment", "is_deleted")
