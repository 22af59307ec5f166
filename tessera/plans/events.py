"""Debounced events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.times import micros
from tessera.sources.tables import table
from tessera.streaming.debounce import debounce_batch

HOUR = 3_600_000_000


def debounced_events(spark, f):
    e = table(spark, f, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("kind"), micros(F.col("ts")).alias("us"), F.col("event_id").alias("id"))
    return debounce_batch(e, 24 * HOUR)


def event_props(spark, f):
    """The JSON of the events as typed columns; broken JSON gives null."""
    p = F.from_json("props", "k bigint")
    return table(spark, f, "events").groupBy("event_type").agg(F.sum(p["k"]).alias("k"), F.count_if(F.col("props").isNotNull()).alias("n"))


QUERIES = {f.__name__: f for f in (debounced_events, event_props)}
SQL = {
    "debounced_events": f"""WITH e AS (SELECT user_id AS path, event_type AS kind, epoch_us(ts) AS us, event_id AS id FROM events),
      n AS (SELECT *, lead(us) OVER (PARTITION BY path, kind ORDER BY us, id) AS nxt FROM e) SELECT path, kind, us, id FROM n WHERE nxt IS NULL OR nxt - us >= {24 * HOUR}""",
    "event_props": "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS k, count(props) AS n FROM events GROUP BY event_type",
}
