"""Jobs on workers: their states from logs, what workers spend their time on, who waits for whom, who gets which job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.registry import query, table
from weft.runtime import running_sum

LEVELS = ("ready", "running", "copying", "blocked_1", "blocked_2", "blocked_3")


def state_levels(log: DataFrame, system: int, chunk: int) -> DataFrame:
    """(worker, ts, LEVELS...): how many jobs are in each state after each stamp of log (worker, ts, event, job).

    A job is received, dispatched, run and finished; jobs below `system` are copies, of which only runs
    count. Received, it is blocked: by its level 1, or 2 or 3 once unblock_comp or unblock_io was seen, the
    highest. A worker's log is read up to its first event that doesn't fit the job's state. Of equal
    stamps the last record holds; the last stamp has none, and a record of zeros comes one unit before the
    first. Sums go by chunks of `chunk` units of time.
    """
    own = W.partitionBy("worker", "job").orderBy("ts", "event").rowsBetween(W.unboundedPreceding, -1)
    upto = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    log = log.withColumn("event", F.col("event").cast("string"))
    first = log.groupBy("worker").agg((F.min("ts") - 1).alias("ts"))
    copy = F.col("job") < system
    moves = F.when(F.col("event").isin("recv", "dispatch", "run", "fin"), F.col("event"))
    unblocked = F.when(F.col("event") == "unblock_comp", 2).when(F.col("event") == "unblock_io", 3).otherwise(1)
    seen = log.where(~(copy & F.col("event").isin("recv", "dispatch"))).withColumns({"was": F.last(moves, ignorenulls=True).over(own), "level": F.max(unblocked).over(upto), "level_was": F.coalesce(F.max(unblocked).over(own), F.lit(1))})
    needs = F.when(F.col("event") == "dispatch", "recv").when(F.col("event") == "run", "dispatch").when(F.col("event") == "fin", "run")
    seen = seen.withColumn("wrong", ~copy & needs.isNotNull() & ~needs.eqNullSafe(F.col("was")))
    stop = seen.where("wrong").groupBy("worker").agg(F.min(F.struct("ts", "event", "job")).alias("stop"))
    seen = seen.join(stop, "worker", "left").where(F.col("stop").isNull() | (F.struct("ts", "event", "job") < F.col("stop")))

    def change(**by: int) -> Column:
        out = F.lit(0)
        for event, n in by.items():
            out = F.when(F.col("event") == event, n).otherwise(out)
        return out

    step = {"ready": F.when(~copy, change(dispatch=1, run=-1)).otherwise(0), "running": F.when(~copy, change(run=1, fin=-1)).otherwise(0), "copying": F.when(copy, change(run=1, fin=-1)).otherwise(0)}
    for k in (1, 2, 3):
        now, was = (F.col("level") == k).cast("int"), (F.col("level_was") == k).cast("int")
        blocked = F.when(F.col("event") == "recv", now).when(F.col("event") == "dispatch", -now).when(F.col("event").startswith("unblock") & (F.col("was") == "recv"), now - was)
        step[f"blocked_{k}"] = F.when(copy, 0).otherwise(F.coalesce(blocked, F.lit(0)))
    seen = seen.select("worker", "ts", "event", "job", F.floor(F.col("ts") / chunk).alias("chunk"), *(c.cast("long").alias(f"d_{k}") for k, c in step.items()))
    seen = running_sum(seen, "chunk", ["ts", "event", "job"], {k: f"d_{k}" for k in LEVELS}, ["worker"])
    final = seen.groupBy("worker").agg(F.max("ts").alias("final"))
    last = seen.groupBy("worker", "ts").agg(F.max_by(F.struct(*LEVELS), F.struct("event", "job")).alias("at")).join(final, "worker").where("ts < final")
    zeros = first.select("worker", "ts", *(F.lit(0).cast("long").alias(k) for k in LEVELS))
    return last.select("worker", "ts", "at.*").unionByName(zeros)


#: The order in which cores go to states.
CASCADE = ("running", "copying", "ready", "blocked_3", "blocked_2", "blocked_1")


def core_states(levels: DataFrame, cores: int) -> DataFrame:
    """levels with on_<state>: cores given greedily to the states in the order of CASCADE, the rest to on_empty."""
    rest = F.lit(cores).cast("long")
    for state in CASCADE:
        levels = levels.withColumn(f"on_{state}", F.least(rest, F.col(state)))
        rest = rest - F.col(f"on_{state}")
    return levels.withColumn("on_empty", rest)


def core_time(levels: DataFrame, cores: int) -> DataFrame:
    """(worker, state..., empty): what cores spend in each state, each record's for the time up to the next."""
    ahead = F.lead("ts").over(W.partitionBy("worker").orderBy("ts")) - F.col("ts")
    timed = core_states(levels, cores).withColumn("dt", ahead)
    return timed.groupBy("worker").agg(*(F.coalesce(F.sum(F.col(f"on_{s}") * F.col("dt")), F.lit(0)).cast("long").alias(s) for s in (*CASCADE, "empty")))


def waiting_workers(needs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(needs, workers): on how many workers of jobs (job, worker) jobs wait for each one, by the edges (job, needs)."""
    return needs.join(jobs, "job").groupBy("needs").agg(F.countDistinct("worker").alias("workers"))


def assigned(jobs: DataFrame, workers: int, seed: int) -> DataFrame:
    """jobs (job, sterile) with a worker: a number from the job and the seed alone; jobs that aren't sterile go to worker 0."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("job").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") % workers
    return jobs.withColumn("worker", F.when(F.col("sterile"), drawn).otherwise(F.lit(0).cast("long")))


def id_ranges(asks: DataFrame, width: int) -> DataFrame:
    """(worker, first, last) of asks (worker, n): ids of worker w are w * width + 1 ...; asking for more than width is an error."""
    first = F.col("worker") * width + 1
    return asks.select("worker", first.alias("first"), F.when(F.col("n") <= width, first + F.col("n") - 1).otherwise(F.raise_error(F.lit("more ids than a worker has"))).cast("long").alias("last"))


_SYSTEM, _CHUNK, _CORES = 1000, 4096, 8


def _log(spark, d):
    """A job for each order, on seven workers; those of one in five are copies, and some lines of worker 3 are lost."""
    k = F.col("o_orderkey")
    t = k * 3
    job = F.when(k % 5 == 0, k % _SYSTEM).otherwise(k + _SYSTEM)
    at = {"recv": t, "unblock_comp": t + k % 7 - 2, "unblock_io": t + k % 11, "dispatch": t + 9 + k % 4, "run": t + 14 + k % 6, "fin": t + 21 + k % 13}
    rows = F.array(*(F.struct(F.lit(e).alias("event"), x.alias("ts")) for e, x in at.items()))
    log = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("worker"), job.alias("job"), k.alias("k"), F.inline(rows))
    lost = ((F.col("event") == "unblock_comp") & (F.col("k") % 3 == 0)) | ((F.col("event") == "unblock_io") & (F.col("k") % 4 == 0)) | ((F.col("event") == "dispatch") & (F.col("k") % 97 == 3) & (F.col("worker") == 3))
    return log.where(~lost).select("worker", "ts", "event", "job")


_LOG = f"""l AS MATERIALIZED (SELECT o_custkey % 7 AS worker, CASE WHEN k % 5 = 0 THEN k % {_SYSTEM} ELSE k + {_SYSTEM} END AS job, k, e.event, k * 3 + e.dt AS ts FROM (SELECT *, o_orderkey AS k FROM orders),
  LATERAL (SELECT unnest(['recv', 'unblock_comp', 'unblock_io', 'dispatch', 'run', 'fin']) AS event, unnest([0, k % 7 - 2, k % 11, 9 + k % 4, 14 + k % 6, 21 + k % 13]) AS dt) e
  WHERE NOT (event = 'unblock_comp' AND k % 3 = 0) AND NOT (event = 'unblock_io' AND k % 4 = 0) AND NOT (event = 'dispatch' AND k % 97 = 3 AND o_custkey % 7 = 3))"""
_STATES = f"""{_LOG},
a AS (SELECT *, job < {_SYSTEM} AS copy, CASE event WHEN 'unblock_comp' THEN 2 WHEN 'unblock_io' THEN 3 ELSE 1 END AS u FROM l WHERE NOT (job < {_SYSTEM} AND event IN ('recv', 'dispatch'))),
b AS (SELECT *, last_value(CASE WHEN event IN ('recv', 'dispatch', 'run', 'fin') THEN event END IGNORE NULLS) OVER p AS was, max(u) OVER q AS level, coalesce(max(u) OVER p, 1) AS level_was FROM a
  WINDOW p AS (PARTITION BY worker, job ORDER BY ts, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY worker, job ORDER BY ts, event ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts, event, job) AS i, NOT copy AND (event = 'dispatch' AND was IS DISTINCT FROM 'recv' OR event = 'run' AND was IS DISTINCT FROM 'dispatch' OR event = 'fin' AND was IS DISTINCT FROM 'run') AS wrong FROM b),
e AS (SELECT * FROM c QUALIFY i < coalesce(min(CASE WHEN wrong THEN i END) OVER (PARTITION BY worker), 1000000000000000)),
s AS (SELECT worker, ts, i, sum(CASE WHEN NOT copy THEN (event = 'dispatch')::INT - (event = 'run')::INT ELSE 0 END) OVER o AS ready,
  sum(CASE WHEN NOT copy THEN (event = 'run')::INT - (event = 'fin')::INT ELSE 0 END) OVER o AS running,
  sum(CASE WHEN copy THEN (event = 'run')::INT - (event = 'fin')::INT ELSE 0 END) OVER o AS copying,
  {', '.join(f"sum(CASE WHEN copy THEN 0 WHEN event = 'recv' THEN (level = {k})::INT WHEN event = 'dispatch' THEN -(level = {k})::INT WHEN event LIKE 'unblock%' AND was = 'recv' THEN (level = {k})::INT - (level_was = {k})::INT ELSE 0 END) OVER o AS blocked_{k}" for k in (1, 2, 3))}
  FROM e WINDOW o AS (PARTITION BY worker ORDER BY i ROWS UNBOUNDED PRECEDING)),
r AS MATERIALIZED (SELECT worker, ts, {', '.join(f'{k}::BIGINT AS {k}' for k in LEVELS)} FROM s QUALIFY row_number() OVER (PARTITION BY worker, ts ORDER BY i DESC) = 1 AND ts < max(ts) OVER (PARTITION BY worker)
  UNION ALL SELECT worker, min(ts) - 1, 0, 0, 0, 0, 0, 0 FROM l GROUP BY 1)"""


def _levels(spark, d):
    return state_levels(_log(spark, d), _SYSTEM, _CHUNK)


@query("w3_state_levels", f"WITH {_STATES} SELECT * FROM r")
def _state_levels(spark, d):
    return _levels(spark, d)


def _cascade_sql() -> str:
    out, rest = [], str(_CORES)
    for s in CASCADE:
        out.append(f"least({rest}, {s}) AS on_{s}")
        rest = f"({rest} - least({rest}, {s}))"
    return ", ".join(out) + f", {rest} AS on_empty"


_CORE_TIME = f"{_STATES}, t AS (SELECT *, lead(ts) OVER (PARTITION BY worker ORDER BY ts) - ts AS dt FROM r), v AS (SELECT worker, dt, {_cascade_sql()} FROM t), z AS (SELECT worker, {', '.join(f'coalesce(sum(on_{s} * dt), 0)::BIGINT AS {s}' for s in (*CASCADE, 'empty'))} FROM v GROUP BY 1)"


@query("w6_six_states", f"WITH {_CORE_TIME} SELECT * FROM z")
def _six_states(spark, d):
    """Core time of each worker in all six states."""
    return core_time(_levels(spark, d), _CORES)


@query("a29_blocked_counts", f"WITH {_STATES} SELECT worker, count(*) FILTER (blocked_1 > 0) AS n1, count(*) FILTER (blocked_2 > 0) AS n2, count(*) FILTER (blocked_3 > 0) AS n3 FROM r GROUP BY 1")
def _blocked_counts(spark, d):
    return _levels(spark, d).groupBy("worker").agg(*(F.count_if(F.col(f"blocked_{k}") > 0).alias(f"n{k}") for k in (1, 2, 3)))


@query("a32_run_block_idle", f"WITH {_CORE_TIME} SELECT worker, running + copying AS run, ready + blocked_1 + blocked_2 + blocked_3 AS block, empty AS idle FROM z")
def _run_block_idle(spark, d):
    t = core_time(_levels(spark, d), _CORES)
    return t.select("worker", F.expr("running + copying").alias("run"), F.expr("ready + blocked_1 + blocked_2 + blocked_3").alias("block"), F.col("empty").alias("idle"))


@query("x33_worker_time", f"WITH {_STATES}, t AS (SELECT *, lead(ts) OVER (PARTITION BY worker ORDER BY ts) - ts AS dt FROM r) SELECT worker, coalesce(sum(dt) FILTER (running + copying > 0), 0)::BIGINT AS active, coalesce(sum(dt) FILTER (running + copying = 0 AND ready + blocked_1 + blocked_2 + blocked_3 > 0), 0)::BIGINT AS blocked, coalesce(sum(dt) FILTER (running + copying + ready + blocked_1 + blocked_2 + blocked_3 = 0), 0)::BIGINT AS idle FROM t GROUP BY 1")
def _worker_time(spark, d):
    """A worker is active while it runs a job, blocked while it only has waiting ones, else idle."""
    t = _levels(spark, d).withColumn("dt", F.lead("ts").over(W.partitionBy("worker").orderBy("ts")) - F.col("ts"))
    runs, waits = F.expr("running + copying > 0"), F.expr("ready + blocked_1 + blocked_2 + blocked_3 > 0")
    spent = lambda c: F.coalesce(F.sum(F.when(c, F.col("dt"))), F.lit(0)).cast("long")
    return t.groupBy("worker").agg(spent(runs).alias("active"), spent(~runs & waits).alias("blocked"), spent(~runs & ~waits).alias("idle"))


@query("g12_waiting_workers", "SELECT needs, count(DISTINCT user_id) AS workers FROM (SELECT user_id, unnest([event_id - 1, event_id - 2]) AS needs FROM events) GROUP BY 1")
def _waiting(spark, d):
    """Each event waits for the two ids before it."""
    e = table(spark, d, "events")
    needs = e.select(F.col("event_id").alias("job"), F.explode(F.array(F.col("event_id") - 1, F.col("event_id") - 2)).alias("needs"))
    return waiting_workers(needs, e.select(F.col("event_id").alias("job"), F.col("user_id").alias("worker")))


@query("x24_seeded_assignment", "SELECT o_orderkey AS job, o_orderstatus = 'F' AS sterile, CASE WHEN o_orderstatus = 'F' THEN ('0x' || md5(o_orderkey::VARCHAR || ':123')[1:8])::BIGINT % 9 ELSE 0 END AS worker FROM orders")
def _seeded(spark, d):
    return assigned(table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_orderstatus") == "F").alias("sterile")), 9, 123)


@query("x29_id_ranges", "SELECT user_id AS worker, user_id * 1000000 + 1 AS first, user_id * 1000000 + count(*) AS last FROM events GROUP BY 1")
def _ranges(spark, d):
    return id_ranges(table(spark, d, "events").groupBy(F.col("user_id").alias("worker")).agg(F.count(F.lit(1)).alias("n")), 1_000_000)


@query("x22_static_split", "SELECT p_partkey, (p_partkey * 37 % 200) * 4 // 200 AS wx, (p_partkey * 91 % 170) * 3 // 170 AS wy FROM part")
def _static(spark, d):
    """A domain of 200 by 170 cells split over four by three workers."""
    split = lambda at, size, n: F.floor(at * n / size)
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", split(k * 37 % 200, 200, 4).alias("wx"), split(k * 91 % 170, 170, 3).alias("wy"))
