"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in an order shuffled by a digest of their id, form one stream of words, cut into
blocks of `block` words that repeat cyclically. Slot j of the schedule is given to the source in whose
interval of the cumulated targets the j-th van der Corput point (base 2) lies, so that every stretch of
the schedule has the sources near their shares. The r-th slot of a source takes its r-th block; the last
is cut at the target. Blocks and documents meet in an equi-join by source and rank.

Positions in a stream are sums over chunks first, even ranges of the order of all rows, so that no
source, however large, is summed up in one task. Ranks of slots are counted in closed form: of a run of
2^k slots that starts at a multiple of 2^k, the points are 2^k apart evenly. What is known of sources is
broadcast while they are few; beyond that only that of the largest ones, of which there are few always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.llm.common import settle, table, words

BLOCK = 2048
#: Rows of a chunk, near enough, and chunks at most: beyond that they get larger. The driver gets a sample of each chunk's rows.
CHUNK, CHUNKS = 1 << 12, 1 << 12
#: Cells of the unit interval by which points and sources are joined.
CELLS = 1024
#: Sources up to which all of them are broadcast; share of all rows from which a source counts as large.
FEW, LARGE = 10_000, 1e-4
_BITS = 48


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source (sk, source_size, target): `share` of all words, dealt by weight, no source above `cap` times its own.

    sizes: sk, size. The excess of capped sources is reshared by weight until none is above, which is to
    cap the sources in the order of cap / weight up to the first that needs none. One row per source.
    """
    total = sizes.groupBy("sk").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("sk") == "n", "sk")  # null last, else by code point
    total = total.withColumn("i", F.row_number().over(order) - 1)
    total = total.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
    total = total.withColumns({"cap": F.col("source_size") * cap, "ratio": F.col("source_size") * cap / F.col("w")})
    ahead = W.orderBy("ratio", "i").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("ratio", "i").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    # the level of a weight of 1 if all ahead are capped and this and all after it are not
    total = total.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("w").over(rest))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(everything)
    total = total.withColumn("level", found["level"])
    return total.select("sk", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _upto(j: str, x: str) -> str:
    """SQL for how many of the points 0 ... j - 1 lie below x, both as whole numbers, points and x of _BITS bits.

    j's binary digits cut 0 ... j - 1 into runs of 2^k; those of a run that starts at s lie at
    point(s) + m * 2^(_BITS - k) for m from 0 to below 2^k.
    """
    start = f"shiftleft(shiftright({j}, k + 1), k + 1)"
    least = f"cast(conv(rpad(reverse(bin({start})), {_BITS}, '0'), 2, 10) as bigint)"
    inside = f"least(shiftleft(1L, k), greatest(0L, shiftright({x} - {least} + shiftleft(1L, {_BITS} - k) - 1, {_BITS} - k)))"
    return f"aggregate(filter(sequence(0, {_BITS - 2}), k -> getbit({j}, k) = 1), 0L, (n, k) -> n + {inside})"


def intervals(targets: DataFrame) -> DataFrame:
    """Per source with a target its interval (lo, hi) of the cumulated targets, as whole numbers of _BITS bits. One row per source, in one task."""
    shares = targets.where("target > 0")
    upto = F.sum("target").over(W.orderBy("sk").rowsBetween(W.unboundedPreceding, W.currentRow))
    shares = shares.withColumn("hi", upto).withColumn("all", F.max("hi").over(W.partitionBy()))
    shares = shares.withColumn("hi", F.when(F.col("hi") == F.col("all"), F.lit(1 << _BITS)).otherwise(F.floor(F.col("hi") / F.col("all") * float(1 << _BITS))).cast("long"))
    return shares.select("sk", "target", F.lag("hi", 1, 0).over(W.orderBy("sk")).cast("long").alias("lo"), "hi")


def schedule(targets: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """The slots (slot, sk, rank): which source's rank-th block each slot takes.

    targets: sk, target; total: the sum of targets. A source that the points leave short of its
    ceil(target / block) slots, by no more than about log2 of the slots, gets the missing ones at the end.
    """
    spark = targets.sparkSession
    n = max(1, -(-total // block))
    parts = max(1, n // (1 << 17))
    point = F.conv(F.rpad(F.reverse(F.bin("slot")), _BITS, "0"), 2, 10).cast("long")
    width = (1 << _BITS) // CELLS
    slots = spark.range(0, n, 1, parts).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.expr(f"u div {width}"))
    shares = settle(intervals(targets).withColumn("need", F.ceil(F.floor("target") / block)))
    cells = shares.select("sk", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, least((hi - 1) div {width}, {CELLS - 1}))")).alias("cell")).where("lo < hi")
    cells = F.broadcast(cells) if shares.count() <= FEW else cells
    dealt = slots.join(cells, "cell").where("lo <= u and u < hi")
    ranked = dealt.select("slot", "sk", F.expr(f"{_upto('slot', 'hi')} - {_upto('slot', 'lo')}").alias("rank"))
    had = F.expr(f"{_upto(f'{n}L', 'hi')} - {_upto(f'{n}L', 'lo')}")
    more = shares.withColumn("had", had).where("had < need").select("sk", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    more = more.select((F.lit(n - 1) + F.row_number().over(W.orderBy("rank", "sk"))).cast("long").alias("slot"), "sk", "rank")
    return ranked.unionByName(more)


def _with_targets(rows: DataFrame, targets: DataFrame, n_rows: int) -> DataFrame:
    """rows joined with targets by source. No large source's rows meet in one task."""
    if targets.count() <= FEW:
        return rows.join(F.broadcast(targets), "sk")
    # at most 1 / LARGE sources are large
    large = F.col("rows") >= LARGE * n_rows
    names = F.broadcast(targets.where(large).select("sk"))
    return rows.join(F.broadcast(targets.where(large)), "sk").unionByName(rows.join(names, "sk", "left_anti").join(targets.where(~large), "sk"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix's pieces and its verdict on each row.

    Pieces (slot, rank, id, first, n_words): each slot's words in its order, `n_words` of the document from
    its word `first`. Verdict, one row per row of docs: the id, size, source_size, target, taken.

    The schedule, its targets and the shuffle are functions of ids, sizes and sources alone, so reruns
    agree. A null or empty text has no words and is taken 0 times. Null sources are one source, the last.
    Null ids are ordered first in their source; rows that repeat an id follow each other and count each.
    An empty table gives empty results. Other columns are ignored.
    """
    source = F.col(source_col).cast("string")
    # a source's key tells null from any string
    sizes = docs.select(F.col(id_col).alias("id"), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source)).alias("sk"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    # at: a number of its own for each row, so that null and repeated ids can be told apart and spread
    sizes = settle(sizes.withColumns({"digest": F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit("")), "at": F.monotonically_increasing_id()}))
    per = sizes.groupBy("sk").agg(F.count(F.lit(1)).alias("rows"))
    targets = settle(source_targets(sizes, weights, share, cap).join(per, "sk"))
    n_rows, total = (int(x or 0) for x in targets.agg(F.sum("rows"), F.sum("target")).first())
    order = ["digest", "id", "size", "at"]
    chunks = max(1, min(n_rows // CHUNK, CHUNKS))
    dealt = settle(sizes.where("size > 0").repartitionByRange(chunks, "sk", *order).withColumn("chunk", F.spark_partition_id()))
    before = dealt.groupBy("sk", "chunk").agg(F.sum("size").alias("words"))
    before = before.select("sk", "chunk", F.coalesce(F.sum("words").over(W.partitionBy("sk").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("size").over(W.partitionBy("sk", "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = dealt.withColumn("within", F.coalesce(within, F.lit(0))).join(before, ["sk", "chunk"])
    placed = settle(_with_targets(placed.select("sk", "id", "size", "at", (F.col("before") + F.col("within")).alias("start")), targets, n_rows))
    # where the document lies in its source's first, second, ... turn
    turns = placed.withColumn("last", F.floor("target")).withColumn("turn", F.explode(F.expr(f"sequence(0, {max(0, int(-(-cap // 1)) - 1)})")))
    turns = turns.withColumn("lo", F.col("turn") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "last")).where("lo < hi")
    spans = turns.withColumn("rank", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    joined = spans.join(schedule(targets, total, block), ["sk", "rank"])
    a, b = F.greatest("lo", F.col("rank") * block), F.least("hi", (F.col("rank") + 1) * block)
    pieces = joined.select("slot", "rank", "id", "at", (a - F.col("lo")).alias("first"), (b - a).alias("n_words"))
    taken = pieces.groupBy("at").agg(F.sum("n_words").alias("taken"))
    columns = ["id", "size", "source_size", "target", "taken"]
    counted = placed.join(taken, "at", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).select(*columns)
    none = _with_targets(sizes.where("size = 0").select("sk", "id", "size"), targets, n_rows).withColumn("taken", F.lit(0).cast("long"))
    verdict = counted.unionByName(none.select(*columns)).withColumnRenamed("id", id_col)
    return pieces.select("slot", "rank", F.col("id").alias(id_col), "first", "n_words"), verdict


def cut(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by spaces."""
    return F.array_join(F.slice(words(text), 1, n.cast("int")), " ")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))[1]


#: What the slots of a source take in all is its stream up to the target, so SQL needs no schedule.
SQL = {
    "op4_mix_sources": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY 1),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level AS found FROM l WHERE level <= ratio ORDER BY ratio, i LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT found FROM f) * w), cap) AS target FROM l),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, floor(target)) - start) + greatest(0, least(start + size, floor(target) - source_size) - start))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
}
