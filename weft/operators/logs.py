"""Analytics of timestamped events: gaps, states, islands, shares, stragglers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.registry import query, table
from weft.runtime import numbered, running_sum


def _user():
    """Each user's events in order."""
    return W.partitionBy("user_id").orderBy("ts", "event_id")


_USER = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("w1_gap_to_previous", f"SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events QUALIFY gap IS NOT NULL {_USER}".replace("QUALIFY gap IS NOT NULL " + _USER, _USER + " QUALIFY gap IS NOT NULL"))
def gaps(spark, d):
    return _events(spark, d).select("event_id", (F.col("us") - F.lag("us").over(_user())).alias("gap")).where("gap is not null")


@query("w2_rebased_time", f"SELECT event_id, epoch_us(ts) - first_value(epoch_us(ts)) OVER w AS since FROM events {_USER}")
def rebased(spark, d):
    return _events(spark, d).select("event_id", (F.col("us") - F.first("us").over(_user())).alias("since"))


@query("w3_running_counts", "SELECT event_id, " + ", ".join(f"(count(*) FILTER (event_type = '{t}') OVER (ORDER BY ts, event_id))::BIGINT AS n_{t}" for t in ("click", "view", "purchase")) + " FROM events")
def running_counts(spark, d):
    """Over all users: days are summed first, so that no task has all events."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    kinds = ("click", "view", "purchase")
    e = e.withColumns({f"is_{t}": F.when(F.col("event_type") == t, 1).otherwise(0).cast("long") for t in kinds})
    return running_sum(e, "day", ["ts", "event_id"], {f"n_{t}": f"is_{t}" for t in kinds}).select("event_id", *(f"n_{t}" for t in kinds))


@query("w4_last_per_hour", "SELECT user_id, date_trunc('hour', ts) AS hour, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id FROM events GROUP BY 1, 2".replace("date_trunc('hour', ts)", "epoch_us(date_trunc('hour', ts))"))
def last_per_hour(spark, d):
    e = _events(spark, d).withColumn("hour", F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")))
    return e.groupBy("user_id", "hour").agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))


@query("w5_time_weighted", f"SELECT user_id, round(sum(value * dt / 1e6), 4) AS integral FROM (SELECT user_id, value, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS dt FROM events {_USER}) GROUP BY 1")
def time_weighted(spark, d):
    e = _events(spark, d).withColumn("dt", F.lead("us").over(_user()) - F.col("us"))
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("dt") / 1e6), 4).alias("integral"))


@query("w6_core_attribution", "SELECT user_id, least(8, c) AS compute, least(8 - least(8, c), v) AS copy, 8 - least(8, c) - least(8 - least(8, c), v) AS empty FROM (SELECT user_id, count(*) FILTER (event_type = 'click') % 10 AS c, count(*) FILTER (event_type = 'view') % 10 AS v FROM events GROUP BY 1)")
def core_attribution(spark, d):
    """Eight cores given greedily: first to one state, then to the next, the rest empty."""
    n = _events(spark, d).groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") % 10).alias("c"), (F.count_if(F.col("event_type") == "view") % 10).alias("v"))
    compute = F.least(F.lit(8), "c")
    copy = F.least(8 - compute, "v")
    return n.select("user_id", compute.alias("compute"), copy.alias("copy"), (8 - compute - copy).alias("empty"))


@query("w7_islands", f"WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS new FROM events {_USER}), i AS (SELECT *, sum(new) OVER w AS island FROM c {_USER}) SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island")
def islands(spark, d):
    e = _events(spark, d).withColumn("new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(_user()))).cast("long"))
    return e.withColumn("island", F.sum("new").over(_user())).groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("w8_phase_time", f"WITH p AS (SELECT user_id, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS dt, last_value(CASE WHEN event_type IN ('login', 'purchase', 'click') THEN event_type END IGNORE NULLS) OVER w AS phase FROM events {_USER}) SELECT user_id, phase, sum(dt)::BIGINT AS us FROM p GROUP BY 1, 2")
def phase_time(spark, d):
    marker = F.when(F.col("event_type").isin("login", "purchase", "click"), F.col("event_type"))
    e = _events(spark, d).withColumn("dt", F.lead("us").over(_user()) - F.col("us")).withColumn("phase", F.last(marker, ignorenulls=True).over(_user()))
    return e.groupBy("user_id", "phase").agg(F.sum("dt").alias("us"))


_MARKED = "m AS (SELECT user_id % 10 AS machine, user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events), o AS (SELECT machine, sum(us) AS total, count(*) AS n FROM m WHERE line = 3 GROUP BY 1)"


@query("w9_clock_aligned", f"WITH {_MARKED} SELECT event_id, (us::HUGEINT * n - total)::DOUBLE / n + 100 AS aligned FROM m JOIN o USING (machine)")
def clock_aligned(spark, d):
    """Clocks of ten machines shifted by the mean stamp of their users' marker rows, here the third of each. Sums are joined back, not a window over all of a machine's rows, and taken off as whole numbers, of which no digit is lost."""
    e = _events(spark, d).withColumns({"machine": F.col("user_id") % 10, "line": F.row_number().over(_user())})
    middle = e.where("line = 3").groupBy("machine").agg(F.sum(F.col("us").cast("decimal(18,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    off = (F.col("us").cast("decimal(18,0)") * F.col("n").cast("decimal(10,0)") - F.col("total")).cast("double")
    return e.join(middle, "machine").select("event_id", (off / F.col("n") + 100).alias("aligned"))


@query("w12_straggler_rank", "SELECT user_id, round(percent_rank() OVER (ORDER BY n, user_id), 6) AS rank, ntile(4) OVER (ORDER BY n, user_id)::INT AS quarter FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def stragglers(spark, d):
    """Places in the order of all workers, by ranges."""
    n = _events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(n, ["n", "user_id"], "place")
    all_ = placed.count()
    wide, size = all_ % 4, all_ // 4
    quarter = F.when(F.col("place") < wide * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(wide + F.floor((F.col("place") - wide * (size + 1)) / max(size, 1))) + 1
    return placed.select("user_id", F.round(F.col("place") / max(all_ - 1, 1), 6).alias("rank"), quarter.cast("int").alias("quarter"))


@query("w14_latest_version", "SELECT user_id, event_type, max(event_id) AS version FROM events GROUP BY 1, 2")
def latest(spark, d):
    return _events(spark, d).groupBy("user_id", "event_type").agg(F.max("event_id").alias("version"))


@query("p13_without_first", f"SELECT event_id FROM events QUALIFY row_number() OVER w > 3 {_USER}".replace(f"QUALIFY row_number() OVER w > 3 {_USER}", f"{_USER} QUALIFY row_number() OVER w > 3"))
def without_first(spark, d):
    return _events(spark, d).withColumn("i", F.row_number().over(_user())).where("i > 3").select("event_id")


@query("p15_after_marker", f"SELECT event_id FROM events {_USER} QUALIFY max((event_type = 'purchase')::INT) OVER w = 1")
def after_marker(spark, d):
    return _events(spark, d).withColumn("seen", F.max((F.col("event_type") == "purchase").cast("int")).over(_user())).where("seen = 1").select("event_id")


@query("p16_until_markers", f"SELECT event_id FROM events {_USER} QUALIFY sum((event_type = 'purchase')::INT) OVER w <= 2")
def until_markers(spark, d):
    return _events(spark, d).withColumn("seen", F.sum((F.col("event_type") == "purchase").cast("int")).over(_user())).where("seen <= 2").select("event_id")


@query("a20_group_time", "SELECT event_type, round(sum(value), 4) AS total, count(*) AS n, round(sum(value) / count(DISTINCT user_id), 6) AS per_user FROM events GROUP BY 1")
def group_time(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value") / F.countDistinct("user_id"), 6).alias("per_user"))


@query("a21_worker_by_key", "SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view FROM events GROUP BY 1")
def worker_by_key(spark, d):
    return _events(spark, d).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.round(F.sum("value"), 4))


@query("a24_category_sums", "SELECT user_id, round(coalesce(sum(value) FILTER (contains(event_type, 'c')), 0), 4) AS with_c, round(coalesce(sum(value) FILTER (NOT contains(event_type, 'c')), 0), 4) AS without_c FROM events GROUP BY 1")
def category_sums(spark, d):
    has = F.col("event_type").contains("c")
    return _events(spark, d).groupBy("user_id").agg(*(F.round(F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0)), 4).alias(n) for n, c in (("with_c", has), ("without_c", ~has))))


@query("a25_nested_average", "SELECT event_type, round(avg(m), 6) AS mean FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def nested_average(spark, d):
    return _events(spark, d).groupBy("event_type", "user_id").agg(F.avg("value").alias("m")).groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"))


@query("a26_mean_and_spread", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem GROUP BY 1")
def mean_and_spread(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("spread"))


@query("a28_last_before", "SELECT b.event_id, coalesce(max(epoch_us(a.ts)), 0)::BIGINT AS all_us, coalesce(max(epoch_us(a.ts)) FILTER (a.event_type = 'click'), 0)::BIGINT AS click_us FROM events b LEFT JOIN events a ON a.event_id IN (b.event_id - 1, b.event_id - 2) GROUP BY 1")
def last_before(spark, d):
    """The latest finish of the events that each waits for, here the two ids before."""
    e = _events(spark, d)
    wait = e.select("event_id", F.explode(F.array(F.col("event_id") - 1, F.col("event_id") - 2)).alias("before"))
    done = e.select(F.col("event_id").alias("before"), "us", "event_type")
    got = wait.join(done, "before", "left").groupBy("event_id")
    return got.agg(F.coalesce(F.max("us"), F.lit(0)).alias("all_us"), F.coalesce(F.max(F.when(F.col("event_type") == "click", F.col("us"))), F.lit(0)).alias("click_us"))


@query("j3_complete_before", "SELECT b.event_id, max(epoch_us(a.ts)) AS us FROM events b JOIN events a ON a.event_id IN (b.event_id - 1, b.event_id - 2) GROUP BY 1 HAVING count(*) = 2")
def complete_before(spark, d):
    """As last_before, without events that wait for an unknown one."""
    e = _events(spark, d)
    wait = e.select("event_id", F.explode(F.array(F.col("event_id") - 1, F.col("event_id") - 2)).alias("before"))
    got = wait.join(e.select(F.col("event_id").alias("before"), "us"), "before", "left").groupBy("event_id")
    return got.agg(F.max("us").alias("us"), F.count_if(F.col("us").isNull()).alias("missing")).where("missing = 0").drop("missing")


@query("a30_share_of_total", "SELECT event_type, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY 1")
def share(spark, d):
    s = _events(spark, d).groupBy("event_type").agg(F.sum("value").alias("s"))
    return s.select("event_type", F.round(100 * F.col("s") / F.sum("s").over(W.partitionBy()), 6).alias("share"))


@query("j4_outer_merge", "SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS clicks, b.n AS purchases FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id")
def outer_merge(spark, d):
    e = _events(spark, d)
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks"))
    b = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("purchases"))
    return a.join(b, "user_id", "full")


@query("j5_semi_join", "SELECT event_id, upper(left(event_type, 1)) AS code FROM events WHERE event_type NOT LIKE 'p%' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def semi_join(spark, d):
    e = _events(spark, d)
    return e.where(~F.col("event_type").startswith("p")).join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi").select("event_id", F.upper(F.left("event_type", F.lit(1))).alias("code"))


_BLAME = "b AS (SELECT user_id AS suffered, prev AS blamed, count(*) AS n FROM (SELECT event_id, user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY 1, 2)"


@query("o9_most_imbalanced", f"WITH {_BLAME} SELECT a.suffered AS fast, a.blamed AS slow, a.n - coalesce(r.n, 0) AS more FROM b a LEFT JOIN b r ON r.suffered = a.blamed AND r.blamed = a.suffered WHERE a.suffered <> a.blamed ORDER BY more DESC, fast, slow LIMIT 1")
def imbalanced(spark, d):
    """The pair of workers of which one blames the other most, less what it is blamed in turn."""
    n = blame(spark, d)
    back = n.select(F.col("suffered").alias("blamed"), F.col("blamed").alias("suffered"), F.col("n").alias("back"))
    more = n.join(back, ["suffered", "blamed"], "left").where("suffered != blamed").select(F.col("suffered").alias("fast"), F.col("blamed").alias("slow"), (F.col("n") - F.coalesce("back", F.lit(0))).alias("more"))
    return more.orderBy(F.desc("more"), "fast", "slow").limit(1)


@query("j18_blame_counts", f"WITH {_BLAME} SELECT * FROM b")
def blame(spark, d):
    """Who of an event's type came right before. A type's events go by days; only the last one of each day meets those of other days."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    kind = ["event_type"]
    last = e.groupBy(*kind, "day").agg(F.max_by("user_id", F.struct("us", "event_id")).alias("carried"))
    last = last.withColumn("carried", F.lag("carried").over(W.partitionBy(*kind).orderBy("day")))
    within = F.lag("user_id").over(W.partitionBy(*kind, "day").orderBy("ts", "event_id"))
    both = e.withColumn("within", within).join(last, [*kind, "day"]).select(F.col("user_id").alias("suffered"), F.coalesce("within", "carried").alias("blamed"))
    return both.where("blamed is not null").groupBy("suffered", "blamed").agg(F.count(F.lit(1)).alias("n"))


@query("w10_truncated_mean", f"SELECT user_id, round(avg(value), 9) AS mean FROM (SELECT user_id, value FROM events {_USER} QUALIFY row_number() OVER w > 2) GROUP BY 1")
def truncated_mean(spark, d):
    """The mean of each worker's rows after its first two."""
    e = _events(spark, d).withColumn("i", F.row_number().over(_user())).where("i > 2")
    return e.groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("mean"))


_NET = "k AS (SELECT a.r_regionkey AS source, b.r_regionkey AS target, 1000 // (1 + abs(a.r_regionkey - b.r_regionkey)) AS mbps, 50 + 200 * abs(a.r_regionkey - b.r_regionkey) AS us FROM region a, region b)"


def link_of(pairs, links):
    """pairs (source, target, ...) with what is known of each link (source, target, mbps, us): looked up by both ends, for pairs that occur; null for an unknown one."""
    return pairs.join(links, ["source", "target"], "left")


@query("j19_link_lookup", f"WITH {_NET}, p AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT l_suppkey, o_custkey, mbps, us FROM p JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN customer ON c_custkey = o_custkey JOIN nation b ON b.n_nationkey = c_nationkey JOIN k ON k.source = a.n_regionkey AND k.target = b.n_regionkey")
def link_lookup(spark, d):
    """Rate and delay between each supplier and customer that trade, by their regions."""
    c, n, s, r, o, li = (table(spark, d, t) for t in ("customer", "nation", "supplier", "region", "orders", "lineitem"))
    apart = F.abs(F.col("source") - F.col("target"))
    ends = r.select(F.col("r_regionkey").alias("source")).crossJoin(r.select(F.col("r_regionkey").alias("target")))  # of five regions
    links = ends.select("source", "target", F.floor(F.lit(1000) / (1 + apart)).cast("int").alias("mbps"), (50 + 200 * apart).alias("us"))
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    pairs = pairs.join(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("source")), "l_suppkey")
    pairs = pairs.join(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("target")), "o_custkey")
    return link_of(pairs, links).select("l_suppkey", "o_custkey", "mbps", "us")


@query("p8_event_filter", "SELECT event_id FROM events WHERE event_type NOT IN ('login', 'view')")
def event_filter(spark, d):
    return _events(spark, d).where(~F.col("event_type").isin("login", "view")).select("event_id")


@query("p14_without_last", f"SELECT event_id FROM events {_USER} QUALIFY lead(event_id) OVER w IS NOT NULL")
def without_last(spark, d):
    return _events(spark, d).withColumn("next", F.lead("event_id").over(_user())).where("next is not null").select("event_id")


@query("w4_last_per_stamp", "WITH e AS (SELECT user_id, event_id, epoch_us(date_trunc('day', ts)) AS day, epoch_us(ts) AS us FROM events) SELECT user_id, day, arg_max(event_id, (us, event_id)) AS event_id FROM e GROUP BY 1, 2 QUALIFY day < max(day) OVER (PARTITION BY user_id)")
def last_per_stamp(spark, d):
    """The last record of each equal stamp, here a day's, of a user; the final stamp's is never written."""
    e = _events(spark, d).withColumn("day", F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")))
    last = e.groupBy("user_id", "day").agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))
    return last.withColumn("final", F.max("day").over(W.partitionBy("user_id"))).where("day < final").select("user_id", "day", "event_id")


@query("a22_worker_averages", "WITH w AS (SELECT user_id, count(*) AS n, sum(value) FILTER (event_type = 'click') / count(*) AS parent, sum(value) FILTER (event_type = 'view') / count(*) AS run FROM events GROUP BY 1) SELECT round(sum(parent), 6) AS parent, round(avg(coalesce(run, 0)), 6) AS run, count(*) AS workers FROM w")
def worker_averages(spark, d):
    """Means of workers over their steps, averaged over workers; the parent column alone is summed over them, as in the report this follows."""
    n = F.count(F.lit(1))
    per = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value"))) / n
    w = _events(spark, d).groupBy("user_id").agg(per("click").alias("parent"), per("view").alias("run"))
    return w.agg(F.round(F.sum("parent"), 6).alias("parent"), F.round(F.avg(F.coalesce("run", F.lit(0.0))), 6).alias("run"), F.count(F.lit(1)).alias("workers"))


def _controller_sql(truncated: int) -> str:
    return f"SELECT round(avg(length) FILTER (i >= {truncated}), 4) AS duration, round(avg(value) FILTER (i >= {truncated}), 6) AS overhead, round(sum(value), 4) AS total FROM s"


@query("a23_controller_statistics", f"WITH s AS (SELECT value, row_number() OVER w - 1 AS i, coalesce(epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER w / 1e6, -1) AS length FROM events WHERE event_type = 'purchase' WINDOW w AS (ORDER BY ts, event_id)) SELECT 0 AS truncated, * FROM ({_controller_sql(0)}) UNION ALL SELECT 3, * FROM ({_controller_sql(3)})")
def controller_statistics(spark, d):
    """Mean length of iterations, mean and total overhead, without the first 0 or 3. The first iteration has the length -1, which enters the mean if nothing is cut, as in the report this follows."""
    s = numbered(_events(spark, d).where("event_type = 'purchase'").select("us", "event_id", "value"), ["us", "event_id"], "i")
    before = s.select((F.col("i") + 1).alias("i"), F.col("us").alias("was"))
    s = s.join(before, "i", "left").withColumn("length", F.coalesce(F.col("us") / 1e6 - F.col("was") / 1e6, F.lit(-1.0)))
    part = lambda k: s.agg(F.lit(k).alias("truncated"), F.round(F.avg(F.when(F.col("i") >= k, F.col("length"))), 4).alias("duration"), F.round(F.avg(F.when(F.col("i") >= k, F.col("value"))), 6).alias("overhead"), F.round(F.sum("value"), 4).alias("total"))
    return part(0).unionByName(part(3))


@query("a2_two_level_sums", "SELECT l_returnflag, sum(l_quantity)::BIGINT AS total, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def two_level(spark, d):
    """Sums of buckets first, then of these: what one key holds is spread over 64 of them."""
    one = table(spark, d, "lineitem").groupBy("l_returnflag", F.pmod(F.xxhash64("l_orderkey"), F.lit(64)).alias("bucket")).agg(F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("most"))
    return one.groupBy("l_returnflag").agg(F.sum("total").cast("long").alias("total"), F.max("most").alias("most"))


@query("a13_extremes_by_size", "SELECT l_orderkey, max(x) AS most, min(x) AS least, max(abs(x)) AS maxabs, arg_max(x, (abs(x), x)) AS maxmag, arg_min(x, (abs(x), x)) AS minmag FROM (SELECT l_orderkey, l_quantity - 25 AS x FROM lineitem) GROUP BY 1")
def extremes(spark, d):
    """Of equal sizes maxmag is the positive one, minmag the negative."""
    x = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") - 25).alias("x"))
    by = F.struct(F.abs("x"), F.col("x"))
    return x.groupBy("l_orderkey").agg(F.max("x").alias("most"), F.min("x").alias("least"), F.max(F.abs("x")).alias("maxabs"), F.max_by("x", by).alias("maxmag"), F.min_by("x", by).alias("minmag"))


@query("a14_componentwise_maxabs", "SELECT max(abs(l_quantity - 25)) AS quantity, max(abs(l_discount - 0.05)) AS discount, max(abs(l_tax - 0.03)) AS tax FROM lineitem")
def componentwise(spark, d):
    columns = {"quantity": F.col("l_quantity") - 25, "discount": F.col("l_discount") - 0.05, "tax": F.col("l_tax") - 0.03}
    return table(spark, d, "lineitem").agg(*(F.max(F.abs(c)).alias(n) for n, c in columns.items()))


@query("a10_signed_residual", "SELECT l_returnflag, max(l_quantity - 60) AS residual FROM lineitem GROUP BY 1")
def residual(spark, d):
    """The largest element with its sign, as the solver's local residual is written."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max(F.col("l_quantity") - 60).alias("residual"))


@query("a31_checksum", "SELECT l_suppkey, round(sum(l_quantity + l_tax), 6) AS checksum FROM lineitem GROUP BY 1")
def checksum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity") + F.col("l_tax")), 6).alias("checksum"))


@query("a7_concatenated", "SELECT event_id, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view')")
def concatenated(spark, d):
    """Scratch rows added to a particle's own, repeats kept."""
    e = _events(spark, d).select("event_id", "user_id", "event_type")
    return e.where("event_type = 'click'").unionAll(e.where("event_type in ('click', 'view')")).drop("event_type")
