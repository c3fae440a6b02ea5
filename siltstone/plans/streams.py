"""Queries of the streaming operators, run on batches; the tests run them on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators.relational import file_changes
from siltstone.schema import Catalog
from siltstone.sources.tables import table
from siltstone.streaming import streams

catalog = Catalog()


@catalog.add(
    "str01_watch_debounce",
    """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM o)
    SELECT user_id AS key, count(*) AS changes, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM g GROUP BY user_id, burst""",
)
def str01(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "ts").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return streams.debounced(e, "6 hours").select("key", "changes", at("first_ts"), at("last_ts"))


@catalog.add("str02_poll_diff", "WITH b AS (SELECT o_custkey AS k, max(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), a AS (SELECT o_custkey AS k, max(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS path, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.t <> b.t")
def str02(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    of = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderdate").alias("mtime"))
    return file_changes(of("F"), of("O"))


@catalog.add("str03_document_state", "SELECT conv_id AS uri, max(turn) AS version, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def str03(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return streams.latest(c.select(F.col("conv_id").alias("uri"), F.col("turn").alias("version"), "text"))
