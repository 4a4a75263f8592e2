"""Versions of objects: lineages, catalogs of objects, regions' dependencies, committed appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.operators.sets import dependencies
from weft.registry import query, table


def lineage_as_of(lineage: DataFrame, before: DataFrame) -> DataFrame:
    """(reader, version): of each reader's object the version of the deepest write that is in its before set, or null.

    lineage: object, job, version, depth; before: reader, object, job, with a row of a null job for readers
    without one.
    """
    seen = before.join(lineage, ["object", "job"], "left")
    return seen.groupBy("reader").agg(F.max_by("version", F.struct("depth", "version")).alias("version"))


def lineage_insert(lineage: DataFrame, entry: DataFrame) -> DataFrame:
    """lineage with entries (object, job, version, depth) put in at their depth: what is at that depth or deeper moves one down for each entry at or before it."""
    marked = lineage.select("*", F.lit(1).alias("_old")).unionByName(entry.select("*", F.lit(0).alias("_old")))
    upto = W.partitionBy("object").orderBy("depth", "_old").rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = F.when(F.col("_old") == 1, F.sum(1 - F.col("_old")).over(upto)).otherwise(F.sum(1 - F.col("_old")).over(upto) - 1)
    return marked.withColumn("depth", F.col("depth") + moved).drop("_old")


def lineage_clean(lineage: DataFrame, upto: DataFrame) -> DataFrame:
    """lineage without what a snapshot at version `upto` (object, version) makes needless: all before the last entry not after it."""
    at = lineage.join(upto.select("object", F.col("version").alias("_upto")), "object", "left")
    last = F.max(F.when(F.col("version") <= F.col("_upto"), F.col("depth"))).over(W.partitionBy("object"))
    return at.withColumn("_last", last).where("_last is null or depth >= _last").drop("_last", "_upto")


def region_dependencies(accesses: DataFrame) -> DataFrame:
    """(job, needs) of accesses (job, object, x, y, dx, dy, reads, writes), jobs in the order of their ids.

    Going back from a job, an earlier write to part of what it reads or writes is needed and hides that
    part from all before it; an earlier read of what it writes is needed too, and hides nothing. By unit
    cells this is the last writer of each cell and the readers since.
    """
    cell = F.struct("object", "i", "j")
    cells = accesses.withColumn("i", F.explode(F.expr("sequence(x, x + dx - 1)"))).withColumn("j", F.explode(F.expr("sequence(y, y + dy - 1)")))
    return dependencies(cells.select("job", cell.alias("cell"), "reads", "writes"))


def with_objects(catalog: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """A catalog of objects (object, ...) after additions, which replace objects of the same id, and removals of ids."""
    gone = added.select("object").union(removed.select("object")).distinct()
    return catalog.join(gone, "object", "left_anti").unionByName(added.join(removed.select("object"), "object", "left_anti"))


def committed(appends: DataFrame) -> DataFrame:
    """(key, data) of buffers (key, seq, kind, data): what was appended, in order, since the last clear and up to the last commit.

    kind: append, clear or commit. Without a commit a key has no data; of one key all appends are one row.
    """
    by = W.partitionBy("key")
    last = appends.withColumn("_commit", F.max(F.when(F.col("kind") == "commit", F.col("seq"))).over(by))
    last = last.withColumn("_clear", F.max(F.when((F.col("kind") == "clear") & (F.col("seq") < F.col("_commit")), F.col("seq"))).over(by))
    kept = last.where("kind = 'append' and seq < _commit and (_clear is null or seq > _clear)")
    return kept.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]), "").alias("data"))


#: A write of the object of its user for each purchase, deeper from one to the next.
_LINEAGE = "l AS (SELECT user_id AS object, event_id AS job, event_id * 10 AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM events WHERE event_type = 'purchase')"


def _lineage(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    depth = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(F.col("user_id").alias("object"), F.col("event_id").alias("job"), (F.col("event_id") * 10).alias("version"), depth.alias("depth"))


@query("j12_lineage_as_of", f"WITH {_LINEAGE}, b AS (SELECT r.event_id AS reader, w.event_id AS job FROM events r LEFT JOIN events w ON w.user_id = r.user_id AND w.event_id < r.event_id AND w.event_id % 3 <> r.event_id % 3 AND w.event_type = 'purchase' WHERE r.event_type = 'view') SELECT reader, max_by(version, depth) AS version FROM b LEFT JOIN l USING (job) GROUP BY 1")
def _as_of(spark, d):
    """Views read what purchases wrote; those that fall in the same class by 3 aren't in their before set."""
    e = table(spark, d, "events")
    r = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("reader"))
    w = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("job"))
    b = r.join(w, (r.user_id == w.user_id) & (F.col("job") < F.col("reader")) & (F.col("job") % 3 != F.col("reader") % 3), "left").select("reader", r.user_id.alias("object"), "job")
    return lineage_as_of(_lineage(spark, d), b)


@query("x18_lineage_insert", f"WITH {_LINEAGE} SELECT object, job, version, depth + (depth >= 2)::INT AS depth FROM l UNION ALL SELECT DISTINCT object, -object, 7, 2 FROM l")
def _insert(spark, d):
    line = _lineage(spark, d)
    entry = line.select("object").distinct().select("object", (-F.col("object")).alias("job"), F.lit(7).cast("long").alias("version"), F.lit(2).cast("long").alias("depth"))
    return lineage_insert(line, entry)


@query("x18_lineage_clean", f"WITH {_LINEAGE} SELECT l.* FROM l WHERE depth >= coalesce((SELECT max(depth) FROM l x WHERE x.object = l.object AND x.version <= 5000), 0)")
def _clean(spark, d):
    line = _lineage(spark, d)
    return lineage_clean(line, line.select("object").distinct().withColumn("version", F.lit(5000)))


@query("p12_known_versions", f"WITH {_LINEAGE} SELECT o_orderkey AS object, o_orderkey IN (SELECT object FROM l) AS known FROM orders")
def _known(spark, d):
    known = _lineage(spark, d).select("object").distinct().withColumn("known", F.lit(True))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("object"))
    return asked.join(known, "object", "left").select("object", F.col("known").isNotNull().alias("known"))


_R = "r AS (SELECT p_partkey AS job, p_partkey // 40 AS object, p_partkey * 7 % 11 AS x, p_partkey * 5 % 9 AS y, 1 + p_size % 4 AS dx, 1 + p_size % 3 AS dy, p_size % 3 <> 0 AS reads, p_size % 3 <> 1 AS writes FROM part), c AS (SELECT job, object, i, unnest(range(y, y + dy)) AS j, reads, writes FROM (SELECT *, unnest(range(x, x + dx)) AS i FROM r))"


@query("j9_region_dependencies", f"WITH {_R} SELECT DISTINCT a.job, b.job AS needs FROM c a JOIN c b ON a.object = b.object AND a.i = b.i AND a.j = b.j AND b.job < a.job AND (a.writes OR b.writes) AND NOT EXISTS (SELECT 1 FROM c m WHERE m.object = a.object AND m.i = a.i AND m.j = a.j AND m.writes AND m.job > b.job AND m.job < a.job)")
def _regions(spark, d):
    """Parts as jobs on boxes of objects; each reads, writes or does both."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return region_dependencies(table(spark, d, "part").select(k.alias("job"), F.expr("p_partkey div 40").alias("object"), (k * 7 % 11).alias("x"), (k * 5 % 9).alias("y"), (1 + s % 4).cast("long").alias("dx"), (1 + s % 3).cast("long").alias("dy"), (s % 3 != 0).alias("reads"), (s % 3 != 1).alias("writes")))


@query("x21_object_catalog", "SELECT p_partkey AS object, p_name AS name FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0")
def _catalog(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("object"), F.col("p_name").alias("name"))
    return with_objects(p, p.where("object % 3 = 0").withColumn("name", F.lit("new")), p.where("object % 5 = 0"))


@query("x30_committed_appends", "WITH a AS (SELECT user_id, event_id, event_type, max(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS done FROM events), c AS (SELECT *, max(event_id) FILTER (event_type = 'login' AND event_id < done) OVER (PARTITION BY user_id) AS cleared FROM a) SELECT user_id AS key, string_agg(event_id || ';', '' ORDER BY event_id) AS data FROM c WHERE event_type NOT IN ('purchase', 'login') AND event_id < done AND event_id > coalesce(cleared, -1) GROUP BY 1")
def _committed(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "login", "clear").otherwise("append")
    return committed(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("data")))
