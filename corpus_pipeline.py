"""A corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents, whatever others docs has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.byte_bpe import round_trip
from weft.llm.common import table
from weft.llm.exact_dedup import exact_dedup
from weft.llm.mix_sources import cut, mix_sources
from weft.llm.quality_rules import quality_rules
from weft.llm.simhash_dedup import simhash_dedup
from weft.runtime import forget

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and __key, never null, which only rows equal in all of them share."""
    others = [c for c in COLUMNS if c != "text"]
    return docs.select(*COLUMNS, F.sha2(F.to_json(F.struct(*others, F.sha2("text", 256).alias("text"))), 256).alias("__key"))


def _only(keyed: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of keyed whose __key is in verdict."""
    return keyed.join(verdict.select("__key"), "__key", "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own text; rows without an id too."""
    keyed = _keyed(docs)
    return _only(keyed, quality_rules(keyed, table(spark, sf_dir, "labels"), row_col="__key").where("kept")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest id, and of rows that repeat it the least by the other columns."""
    key = lambda sha: F.to_json(F.struct("doc_id", sha.alias("text")))
    keyed = docs.select(*COLUMNS, key(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("__key"))
    verdict = exact_dedup(docs).where("kept").select(key(F.col("text_sha256")).alias("__key"))
    least = F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("row")
    return _only(keyed, verdict).groupBy("__key").agg(least).select("row.*").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id; of rows that repeat it with other texts one, by a digest."""
    keyed = _keyed(docs)
    # rows without an id come last, so that one of them stays only where all of a component have none
    named = keyed.withColumn("__row", F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("__key").alias("key")))
    return _only(keyed, simhash_dedup(named, id_col="__row").where("__row = component_id").select("__row.key").withColumnRenamed("key", "__key")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is taken. Its shuffle is by a digest of the whole row.

    A row that the mix takes in part comes with as many of its first words, joined by spaces, in its
    last row. Rows taken 0 times go. n_chars is that of the text in the row.
    """
    keyed = _keyed(docs)
    # equal rows are one here, taken as often as all of them
    taken = mix_sources(keyed, id_col="__key")[1].where("taken > 0").groupBy("__key").agg(F.first("size").alias("__size"), F.sum("taken").alias("__taken"))
    rows = keyed.join(taken, "__key").dropDuplicates(["__key"])
    rows = rows.withColumn("__left", F.explode(F.expr("transform(sequence(0, (__taken - 1) div __size), i -> least(__size, __taken - i * __size))")))
    part = F.col("__left") < F.col("__size")
    text = F.when(part, cut(F.col("text"), F.col("__left"))).otherwise(F.col("text"))
    n_chars = F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("text", text).withColumn("n_chars", n_chars).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("byte-level BPE", encode)]

#: SimHash components aren't expressible in SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written and read again where the cluster shares a folder."""
    docs = table(spark, sf_dir, "documents")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    place = f"{shared}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            forget(spark, f"{place}/{k - 1}")  # only what the result reads stays
    return docs
