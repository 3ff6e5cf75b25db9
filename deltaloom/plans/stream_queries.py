"""Stage graphs and streams over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stage_graph as g
from ..operators import staging
from ..streaming import streams as s
from .registry import query, table

STAGES = [
    ("s1", "names", "HIGH", 600, ["reconnaissance", "passive"], []),
    ("s2", "probe", "NORMAL", 300, ["reconnaissance", "active"], ["s1"]),
    ("s3", "discovery", "NORMAL", 1200, ["discovery", "active"], ["s2"]),
    ("s4", "scripts", "LOW", 900, ["analysis", "passive"], ["s2"]),
    ("s5", "interfaces", "CRITICAL", 1800, ["testing", "active"], ["s3", "s4"]),
    ("s6", "ranking", "HIGH", 300, ["aggregation", "final"], ["s1", "s2", "s3", "s4", "s5"]),
    ("s7", "changes", "LOW", 600, ["monitoring", "passive"], []),
]
_EDGES = "e(stage, needs) AS (VALUES ('s2', 's1'), ('s3', 's2'), ('s4', 's2'), ('s5', 's3'), ('s5', 's4'), ('s6', 's1'), ('s6', 's2'), ('s6', 's3'), ('s6', 's4'), ('s6', 's5'))"
_NODES = "n(id, priority, timeout) AS (VALUES ('s1', 2, 600), ('s2', 1, 300), ('s3', 1, 1200), ('s4', 0, 900), ('s5', 3, 1800), ('s6', 2, 300), ('s7', 0, 600))"
_LEVELS = "w(id, level) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT stage FROM e) UNION ALL SELECT e.stage, w.level + 1 FROM w JOIN e ON e.needs = w.id)"


def stages(spark: SparkSession) -> DataFrame:
    return g.stages_of(spark, STAGES)


@query(f"WITH RECURSIVE {_EDGES}, c(stage, needs) AS (SELECT * FROM e UNION SELECT c.stage, e.needs FROM c JOIN e ON c.needs = e.stage) SELECT * FROM c")
def stage_closure(spark, sf):
    return g.closure(stages(spark))


@query(f"WITH RECURSIVE {_EDGES}, {_NODES}, {_LEVELS} SELECT id, max(level) AS level FROM w GROUP BY id")
def stage_levels(spark, sf):
    return g.levels(stages(spark))


@query(f"WITH RECURSIVE {_EDGES}, {_NODES}, {_LEVELS} SELECT id, max(level) AS level, row_number() OVER (ORDER BY max(level), priority DESC, timeout, id) AS place FROM w JOIN n USING (id) GROUP BY id, priority, timeout")
def stage_order(spark, sf):
    from pyspark.sql import Window

    ordered = g.execution_order(stages(spark))
    place = F.row_number().over(Window.orderBy("level", g.rank(F.col("priority")).desc(), "timeout", "id"))  # a graph of stages
    return ordered.select("id", "level", place.cast("long").alias("place"))


@query(f"WITH RECURSIVE {_EDGES}, {_NODES}, {_LEVELS} SELECT 7::BIGINT AS stages, max(level) + 1 AS levels, 7 / (max(level) + 1) AS parallelism FROM w")
def stage_parallelism(spark, sf):
    return g.parallelism(stages(spark))


@query("SELECT * FROM (VALUES ('s2'), ('s3')) t(id)")
def stage_selection(spark, sf):
    """Active stages up to HIGH, without testing."""
    chosen = g.select(stages(spark), [g.Filter("tag", "active"), g.Filter("tag", "testing", mode="exclude"), g.Filter("priority", ("LOW", "HIGH"), mode="require")])
    return chosen.select("id")


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf):
    out = s.windows(table(spark, sf, "events"), "ts", "1 hour", keys=["event_type"], aggregates=[F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w")
def window_sliding(spark, sf):
    out = s.windows(table(spark, sf, "events"), "ts", "2 hours", "1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
(SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events)) GROUP BY user_id, k""")
def window_sessions(spark, sf):
    out = s.sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def stream_windows(spark, sf):
    """The same kind of windows on a stream, run until the table is read."""
    out = s.windows(s.parquet_stream(spark, f"{sf}/events.parquet"), "ts", "1 day")
    return s.drained(out, "stream-windows", "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 5")
def stream_files(spark, sf):
    """A stateless stream into files, once."""
    rows = s.parquet_stream(spark, f"{sf}/events.parquet").where("value > 5").select("event_id", "user_id", "event_type")
    return s.drained(rows, "stream-files")


@query()
def token_bucket(spark, sf):
    """Admission by user: state that SQL can't carry; tested against a plain loop."""
    return s.admit_batch(table(spark, sf, "events"), "user_id", "ts", s.Bucket(rate=1 / 3600, burst=3), "event_id")


#: Events arrive in five parts of six days; one in ten comes two parts later than its time says.
_PART = "least(4, (day(ts) - 1) // 6 + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END)"
_LATE = f"""WITH e AS (SELECT *, {_PART} AS part, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM events),
p AS (SELECT part, max(ts) AS last FROM e GROUP BY part),
m AS (SELECT q.part, (SELECT max(last) FROM p WHERE p.part < q.part) - INTERVAL 1 DAY AS mark FROM p q),
f AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)"""


def _arriving(spark: SparkSession, sf: str):
    """The events in the order they arrive: one table of rows for each of five runs."""
    late = F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    events = table(spark, sf, "events").withColumn("part", F.least(F.lit(4), F.floor((F.dayofmonth("ts") - 1) / 6).cast("int") + late))
    return [events.where(F.col("part") == k).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type") for k in range(5)]


def _restarted(spark: SparkSession, sf: str, name: str, make) -> str:
    """Runs of one stream over a growing folder: each is started from the checkpoint of the one before, and the last finds nothing new. Returns the folder of all."""
    base = f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for rows in [*_arriving(spark, sf), None]:
        if rows is not None:
            rows.write.mode("append").parquet(f"{base}/in")
            schema = rows.schema
        make(spark.readStream.schema(schema).parquet(f"{base}/in"), base)
    return base


@query(f"""{_LATE} SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) FILTER (m.mark IS NULL OR w + INTERVAL 6 HOUR > m.mark) AS n,
count(*) FILTER (w + INTERVAL 6 HOUR <= m.mark) AS late FROM e JOIN m USING (part), f WHERE w + INTERVAL 6 HOUR <= f.mark GROUP BY w
HAVING count(*) FILTER (m.mark IS NULL OR w + INTERVAL 6 HOUR > m.mark) > 0""")
def stream_restarts(spark, sf):
    """Windows of six hours with a watermark of a day, in append mode, over a stream that is stopped after each part and started again; late rows are counted."""

    def run(rows, base):
        s.write_stream(s.windows(rows, "ts", "6 hours", late="1 day"), f"{base}/out", f"{base}/state").awaitTermination()

    base = _restarted(spark, sf, "stream-restarts", run)
    out = spark.read.schema("window_start timestamp, window_end timestamp, n long").parquet(f"{base}/out")
    # Whatever came for a window that was written is counted or late.
    came = s.windows(spark.read.parquet(f"{base}/in"), "ts", "6 hours").withColumnRenamed("n", "came")
    both = out.join(came, ["window_start", "window_end"]).withColumn("late", F.col("came") - F.col("n")).drop("came")
    found = staging.staged(both.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}), "restarts")
    staging.drop(spark, base)
    return found


@query("SELECT 5::BIGINT AS batches, count(*) AS input_rows, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_id) AS written FROM events")
def stream_counters(spark, sf):
    """What a stream says of itself over all its runs, and what it wrote."""
    with s.counted(spark) as counters:

        def run(rows, base):
            watched = rows.observe("run", F.count_if(F.col("event_type") == "error").alias("errors"))
            counters.wait_for(s.write_stream(watched.select("event_id"), f"{base}/out", f"{base}/state"))

        base = _restarted(spark, sf, "stream-counters", run)
    written = spark.read.schema("event_id long").parquet(f"{base}/out").agg(F.count("*").alias("written"))
    told = [F.lit(counters.total[k]).cast("long").alias(k) for k in ("batches", "input_rows", "errors")]
    found = staging.staged(written.select(*told, "written"), "counters")
    staging.drop(spark, base)
    return found
