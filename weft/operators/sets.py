"""Id sets, ordered key-value merges and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.registry import query, table
from weft.runtime import numbered


def merge_latest(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Key-value rows (key, value) after an atomic batch (key, seq, value; a null value deletes): of a key the highest seq holds."""
    # a struct, so that a deletion is kept as a value of its own
    last = batch.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("last")).select("key", F.col("last.value").alias("value"))
    return base.join(last, "key", "left_anti").select("key", "value").union(last.where("value is not null"))


def version_as_of(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """reads (id, at) with the version of the latest write (id, at, version) not after it, or null: one sort by id of both, no join."""
    both = writes.select("id", "at", F.lit(0).alias("kind"), "version", F.lit(None).cast("long").alias("read")).unionByName(reads.select("id", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("version"), F.monotonically_increasing_id().alias("read")))
    w = W.partitionBy("id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("version", F.last("version", ignorenulls=True).over(w)).where("kind = 1").select("id", "at", "version")


def _keys(spark, d):
    """All orders, and the orders of returned lines."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    i = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return o, i


_A, _B = "SELECT o_orderkey AS id FROM orders", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'"


@query("u1_union", f"{_A} UNION {_B}")
def _union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@query("u2_difference", f"SELECT DISTINCT id FROM ({_A}) WHERE id NOT IN ({_B})")
def _difference(spark, d):
    a, b = _keys(spark, d)
    return a.join(b, "id", "left_anti").distinct()


@query("u3_membership", f"SELECT id, id IN ({_B}) AS inside FROM ({_A})")
def _membership(spark, d):
    a, b = _keys(spark, d)
    return a.join(b.distinct().withColumn("inside", F.lit(True)), "id", "left").select("id", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("u8_multiset_union", f"SELECT id, count(*) AS n FROM ({_A} UNION ALL {_B}) GROUP BY 1")
def _multiset(spark, d):
    a, b = _keys(spark, d)
    return a.unionAll(b).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("a36_semi_join", f"SELECT id FROM ({_A}) WHERE id IN ({_B})")
def _semi(spark, d):
    a, b = _keys(spark, d)
    return a.join(b, "id", "left_semi")


_SEQ = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


@query("s20_batch_apply", f"WITH b AS (SELECT l_orderkey AS key, l_quantity AS value, l_returnflag AS flag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in _SEQ)}) = 1) SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey NOT IN (SELECT key FROM b) UNION ALL SELECT key, value FROM b WHERE flag <> 'A'")
def _batch(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    batch = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct(*_SEQ).alias("seq"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("value"))
    return merge_latest(base, batch)


@query("s19_range_scan", "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000")
def _scan(spark, d):
    return table(spark, d, "orders").where("o_orderkey >= 100 and o_orderkey < 2000").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")).orderBy("key")


@query("j12_version_as_of", "SELECT event_id, (SELECT max(w.event_id) FROM events w WHERE w.event_type = 'purchase' AND w.user_id = r.user_id AND w.event_id <= r.event_id) AS version FROM events r WHERE event_type = 'view'")
def _as_of(spark, d):
    e = table(spark, d, "events")
    writes = e.where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.col("event_id").alias("version"))
    reads = e.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"))
    return version_as_of(writes, reads).select(F.col("at").alias("event_id"), "version")


def dependencies(accesses: DataFrame) -> DataFrame:
    """(job, needs): which earlier jobs each job waits for, from accesses (job, cell, reads, writes); jobs run in the order of their ids.

    A job that reads or writes a cell needs the last writer before it, and one that writes it also the
    readers since that writer. Each read has one next writer at most, so two windows by cell find all,
    with no more rows than accesses, twice. One row per job and cell is made first.
    """
    one = accesses.groupBy("job", "cell").agg(F.max("reads").alias("reads"), F.max("writes").alias("writes"))
    by = W.partitionBy("cell").orderBy("job")
    writer = F.when(F.col("writes"), F.col("job"))
    seen = one.withColumns({"last": F.max(writer).over(by.rowsBetween(W.unboundedPreceding, -1)), "next": F.first(writer, ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing))})
    after = seen.where("last is not null").select("job", F.col("last").alias("needs"))
    before = seen.where("reads and next is not null").select(F.col("next").alias("job"), F.col("job").alias("needs"))
    return after.unionByName(before).distinct()


@query("j9_dependencies", "WITH e AS (SELECT event_id, user_id, event_type = 'purchase' AS w, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) - (event_type = 'purchase')::INT AS epoch FROM events) SELECT a.event_id AS job, b.event_id AS needs FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_id < a.event_id AND (a.w OR b.w) AND a.epoch - b.epoch = b.w::INT")
def _dependencies(spark, d):
    """Events as jobs on the cell of their user; purchases write, all others read."""
    w = F.col("event_type") == "purchase"
    return dependencies(table(spark, d, "events").select(F.col("event_id").alias("job"), F.col("user_id").alias("cell"), (~w).alias("reads"), w.alias("writes")))


@query("o1_sorted", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def _sorted(spark, d):
    """The whole table in order, by an expression that compares."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return numbered(o, [F.desc("o_totalprice"), "o_orderkey"], "place").select("place", "o_orderkey")


@query("o2_sorted_by_field", "SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def _by_field(spark, d):
    """Stable: of equal fields the order is that of the keys."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return numbered(o, ["o_orderpriority", "o_orderdate", "o_orderkey"], "place").select("place", "o_orderkey")


@query("o3_permutation", "WITH a AS (SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS was FROM orders) SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, was FROM a")
def _permutation(spark, d):
    """Which row, by its place in the order of keys, is at each place in the order of prices."""
    at = numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "was")
    return numbered(at, ["o_totalprice", "o_orderkey"], "place").select("place", "was")


def merged(*sources: DataFrame) -> DataFrame:
    """(place, source, ...) of sorted sources (key, ...) as one in the order of keys, repeats kept; of equal keys the earlier source's come first."""
    both = None
    for k, s in enumerate(sources):
        s = s.withColumn("source", F.lit(k))
        both = s if both is None else both.unionByName(s)
    return numbered(both.withColumn("at", F.monotonically_increasing_id()), ["key", "source", "at"], "place").drop("at")


@query("j20_merged", f"SELECT row_number() OVER (ORDER BY id, source) - 1 AS place, source, id AS key FROM (SELECT id, 0 AS source FROM ({_A}) UNION ALL SELECT id, 1 FROM ({_B}))")
def _merged(spark, d):
    a, b = _keys(spark, d)
    return merged(a.withColumnRenamed("id", "key"), b.withColumnRenamed("id", "key")).select("place", "source", "key")


def seek(rows: DataFrame, at: list) -> DataFrame:
    """For each of a few places `at` a row (asked, found, before): the first key of rows (key) not below it, and the last one below; null where there is none. One aggregate over all rows."""
    got = rows.agg(F.array(*(F.struct(F.lit(x).alias("asked"), F.min(F.when(F.col("key") >= x, F.col("key"))).alias("found"), F.max(F.when(F.col("key") < x, F.col("key"))).alias("before")) for x in at)).alias("got"))
    return got.select(F.inline("got"))


_SEEK = (-5, 100, 777, 10**9)


@query("s19_seek", f"SELECT asked, min(o_orderkey) FILTER (o_orderkey >= asked) AS found, max(o_orderkey) FILTER (o_orderkey < asked) AS before FROM orders, (SELECT unnest([{', '.join(map(str, _SEEK))}]::BIGINT[]) AS asked) GROUP BY 1")
def _seek(spark, d):
    return seek(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), [F.lit(x).cast("long") for x in _SEEK])


@query("s19_first_last", "SELECT min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def _ends(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("j10_point_lookup", "SELECT o_orderkey, o_totalprice, true AS has FROM orders WHERE o_orderkey = 97 UNION ALL SELECT -1, NULL, false")
def _lookup(spark, d):
    """What objects of two ids are, and whether there is one."""
    found = table(spark, d, "orders").where("o_orderkey in (97, -1)").select("o_orderkey", "o_totalprice", F.lit(True).alias("has"))
    asked = spark.createDataFrame([(97,), (-1,)], "o_orderkey long")
    return asked.join(found, "o_orderkey", "left").fillna(False, ["has"])


class Bloom:
    """A set of texts that may say yes to others, never no to its own: `bits_per_key` bits for each of n keys, as words of 63 bits in a DataFrame."""

    def __init__(self, n: int, bits_per_key: int = 10) -> None:
        self.bits = max(64, n * bits_per_key)
        #: 0.69 of the bits for a key, from 1 to 30.
        self.probes = min(30, max(1, int(bits_per_key * 0.69)))

    def places(self, key: Column) -> Column:
        """The bits of a key, by two halves of one digest."""
        half = lambda at: F.conv(F.substring(F.md5(key.cast("binary")), at, 8), 16, 10).cast("long")
        return F.array(*((half(1) + F.lit(k) * half(9)) % self.bits for k in range(self.probes)))

    def build(self, keys: DataFrame) -> DataFrame:
        """(word, bits) of keys (key); words without a bit have no row."""
        at = keys.select(F.explode(self.places(F.col("key"))).alias("at"))
        return at.groupBy(F.expr("at div 63").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 63 as int))")).alias("bits"))

    def probe(self, asked: DataFrame, words: DataFrame) -> DataFrame:
        """asked (key) with `may`: whether all of its bits are set."""
        at = asked.select("key").distinct().select("key", F.explode(self.places(F.col("key"))).alias("at"))
        at = at.withColumn("word", F.expr("at div 63")).join(words, "word", "left")
        hit = at.groupBy("key").agg(F.min(F.coalesce(F.expr("getbit(bits, cast(at % 63 as int))"), F.lit(0)) == 1).alias("may"))
        return asked.join(hit, "key")


_BLOOM = Bloom(500, 10)


@query("a36_bloom", f"WITH p AS (SELECT id, unnest(list_transform(range({_BLOOM.probes}), lambda k: (('0x' || md5(id::VARCHAR)[1:8])::BIGINT + k * ('0x' || md5(id::VARCHAR)[9:16])::BIGINT) % {_BLOOM.bits})) AS b FROM (SELECT DISTINCT id FROM ({_A}))), s AS (SELECT DISTINCT b FROM p WHERE id % 7 = 0 AND id <= 3500) SELECT id::VARCHAR AS key, bool_and(b IN (FROM s)) AS may FROM p GROUP BY 1")
def _bloom(spark, d):
    """Which orders a filter of some of them lets through."""
    keys = _keys(spark, d)[0].distinct()
    words = _BLOOM.build(keys.where("id % 7 = 0 and id <= 3500").select(F.col("id").cast("string").alias("key")))
    return _BLOOM.probe(keys.select(F.col("id").cast("string").alias("key")), words)


@query("o5_heap_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _heap(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
