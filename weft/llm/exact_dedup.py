"""Exact dedup by a tree-merge of sorted digest runs.

Every row's text becomes a 32-byte SHA-256 digest, which the text's length and a second 64-bit digest
verify. Each partition of the input is a run, sorted by digest. In every round a run exchanges with its
partners, those whose numbers differ from its own in one digit: it hands each the entries whose digest
has the partner's digit, and merges the sorted runs it gets into one. Of each digest the merge retains
the best identifier that is verified and the number of rows. After as many rounds as numbers have digits,
run p holds all entries whose digest has the digits of p, once each. The verdicts then go back by the
same rounds to the rows.

An entry has at most a run's rows at the leaves and `2 ** fan_in_bits` children above, so that no group of
copies, however large, meets in one task. Only digests are shuffled, never texts. The sorts and merges are
sort aggregates: a run arrives as sorted pieces, which the sort merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import settle, table

_KEY = ["d", "size", "v"]


def _exchanged(run: Column, place: Column, k: int, bits: int) -> Column:
    """run with its k-th digit that of place: where an entry goes in round k."""
    mask = ((1 << bits) - 1) << (k * bits)
    return run.bitwiseAND(F.lit(~mask)).bitwiseOR(place.bitwiseAND(F.lit(mask)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", n_runs: int | None = None, fan_in_bits: int = 4) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", which id of equal texts stays. n_runs: rows are dealt to so many runs first, by
    default as they are read. A null text equals an empty one. A null id stays only where all ids of its
    group are null. Rows that repeat an id are one document: each counts in group_size and all get the
    same verdict; neither these nor null ids meet in one run. An empty table gives no rows. Other columns
    of docs are ignored, whatever their names.
    """
    best = {"max": F.max, "min": F.min}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("d"), F.length(text).alias("size"), F.xxhash64(text).alias("v"))
    if n_runs:
        rows = rows.repartition(n_runs)
    rows = settle(rows.withColumn("run", F.spark_partition_id().cast("long")))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    # the digest's place is that of its run in the end; identifiers are structs, whose aggregates sort
    place = F.xxhash64("d")
    # null ids are last in both orders, so that they stay only where a group has no others
    one = F.struct(F.col("id").isNotNull().alias("known") if keep == "max" else F.col("id").isNull().alias("unknown"), F.col("id").alias("id"))
    level = rows.groupBy("run", *_KEY).agg(best(one).alias("best"), F.count(F.lit(1)).alias("n"))
    levels, k = [level], 0
    while k * fan_in_bits < (runs - 1).bit_length():
        level = level.withColumn("run", _exchanged(F.col("run"), place, k, fan_in_bits)).groupBy("run", *_KEY).agg(best("best").alias("best"), F.sum("n").alias("n"))
        levels.append(level)
        k += 1
    found = levels.pop()
    for k in range(len(levels) - 1, -1, -1):
        # an entry's verdict is that of the entry it was merged into
        children = levels[k].select(F.col("run").alias("from"), _exchanged(F.col("run"), place, k, fan_in_bits).alias("run"), *_KEY)
        found = children.join(found, ["run", *_KEY]).select(F.col("from").alias("run"), *_KEY, "best", "n")
    verdict = rows.join(found, ["run", *_KEY]).withColumn("best", F.col("best.id"))
    return verdict.select(F.col("id").alias(id_col), F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("best")).alias("kept"), F.lower(F.hex("d")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
}
