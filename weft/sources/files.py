"""Readers and writers of text formats: graphs, logs, field configurations; and a keyed store of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, table


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(part, position, id) of lines `part : n : id id ...`; a line whose count is wrong is an error."""
    parts = spark.read.text(path).where("trim(value) != ''").select(F.split("value", r"\s*:\s*").alias("f"))
    rows = parts.select(F.trim(F.col("f")[0]).cast("long").alias("part"), F.trim(F.col("f")[1]).cast("int").alias("n"), F.split(F.trim(F.col("f")[2]), r"\s+").alias("ids"))
    checked = rows.withColumn("ids", F.when((F.size("ids") == F.col("n")) | (F.col("n") == 0), F.col("ids")).otherwise(F.raise_error(F.lit("a line's count differs from its ids"))))
    return checked.where("n > 0").select("part", F.posexplode("ids").alias("position", "id")).withColumn("id", F.col("id").cast("long"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines `src dst`."""
    return spark.read.schema("src long, dst long").option("sep", " ").csv(path)


def read_number(spark: SparkSession, path: str) -> int:
    return int(spark.read.text(path).first()[0].strip())


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Header `n m 000`, then a line of sorted neighbours for each node, ids dense from 1. The header is a file of its own, first by name."""
    lines, header = adjacency(edges)
    header.coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    lines.orderBy("id").select("line").write.mode("overwrite").text(f"{path}/part=1")


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, line) of each node and the header."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct()
    lines = both.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), " ").alias("line"), F.count(F.lit(1)).alias("n"))
    header = lines.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), (F.sum("n") / 2).cast("long").cast("string"), F.lit("000")).alias("value"))
    return lines.select("id", "line"), header


def read_log(spark: SparkSession, path: str, fields: dict[str, tuple[int, str]]) -> DataFrame:
    """Positional fields (name: place and type) of lines split at blanks, with the file that each came from; a missing field is null."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"[ \t]+").alias("f"), F.col("_metadata.file_name").alias("file"))
    return lines.select("file", *(F.try_element_at("f", F.lit(i + 1)).try_cast(kind).alias(name) for name, (i, kind) in fields.items()))


def read_tagged(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(value) of lines `tag: number`, exact."""
    return spark.read.text(path).select(F.regexp_extract("value", rf"^{tag}:\s*(-?[0-9.]+)", 1).alias("v")).where("v != ''").select(F.col("v").cast("decimal(38,18)").alias("value"))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """(class, name, domain, parts, ghost, flags) of lines `class : name : (x,y,z), (x,y,z), (x,y,z) : flags`."""
    rows = spark.read.text(path).where("trim(value) != '' and value not like '#%'").select(F.split("value", r"\s*:\s*").alias("f"))
    numbers = F.transform(F.regexp_extract_all(F.col("f")[2], F.lit(r"-?[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return rows.select(F.trim(F.col("f")[0]).alias("class"), F.trim(F.col("f")[1]).alias("name"), F.slice(numbers, 1, 3).alias("domain"), F.slice(numbers, 4, 3).alias("parts"), F.slice(numbers, 7, 3).alias("ghost"), F.split(F.trim(F.col("f")[3]), r"\s*,\s*").alias("flags"))


def matching_lines(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").contains(part))


def write_frame(df: DataFrame, path: str, frame: int) -> None:
    """One frame's rows in a directory of its own; writing it again replaces that frame only."""
    df.write.mode("overwrite").parquet(f"{path}/frame={frame}")


class Store:
    """Keyed values of checkpoints, as Parquet sorted by key; a checkpoint is written once and read by its id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, checkpoint: int) -> str:
        """rows: key, value. Gives the handle."""
        handle = f"{self.path}/checkpoint={checkpoint}"
        rows.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(handle)
        return handle

    def load(self, handle: str) -> DataFrame:
        return self.spark.read.parquet(handle)

    def get(self, checkpoint: int, lo: str, hi: str | None = None) -> DataFrame:
        """The rows of a key, or of keys from lo up to hi: the filter reaches the files' statistics."""
        found = self.spark.read.parquet(f"{self.path}/checkpoint={checkpoint}")
        return found.where(F.col("key") == lo) if hi is None else found.where((F.col("key") >= lo) & (F.col("key") < hi))


@query("s6_adjacency", "WITH e AS (SELECT DISTINCT l_suppkey + 0 AS src, 1000000 + l_partkey AS dst FROM lineitem), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS line FROM b GROUP BY 1")
def _adjacency(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    return adjacency(e)[0]


@query("s13_positional_fields", "SELECT page_id, string_split_regex(trim(url), '[/?]')[3] AS host, regexp_extract(url, 'page=([0-9]+)', 1) AS page FROM pages")
def _fields(spark, d):
    return table(spark, d, "pages").select("page_id", F.get(F.split(F.trim("url"), "[/?]"), F.lit(2)).alias("host"), F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"))


@query("j1_dense_ids", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS segment_id, (dense_rank() OVER (ORDER BY n_name) - 1)::INT AS nation_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _dense(spark, d):
    """Names become ids by a join with the distinct names, which are few; a null name has none."""
    from pyspark.sql.window import Window as W

    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    for name, out in (("c_mktsegment", "segment_id"), ("n_name", "nation_id")):
        ids = c.select(name).distinct().withColumn(out, F.row_number().over(W.orderBy(name)) - 1)
        c = c.join(ids, name)
    return c.select("c_custkey", "segment_id", "nation_id")
