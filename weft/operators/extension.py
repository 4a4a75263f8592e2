"""Where users bring their own: jobs by name, reductions, translators of data, comparators, filters, prototypes; access sets and fields by declaration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, table
from weft.runtime import numbered


class Job:
    """An operator of the user's: what it reads is given to execute, and what that returns is what it writes."""

    def execute(self, *reads: DataFrame) -> DataFrame:
        raise NotImplementedError

    def clone(self) -> Job:
        return type(self)()


class Application:
    """Jobs by name, run one after the other on named data; a job's result takes the name it is given."""

    def __init__(self) -> None:
        self.jobs: dict[str, Job] = {}

    def register(self, name: str, job: Job) -> None:
        if name in self.jobs:
            raise ValueError(f"there is a job {name}")
        self.jobs[name] = job

    def run(self, steps: list[tuple[str, list[str], str]], **data: DataFrame) -> dict[str, DataFrame]:
        """Data by name after steps (job, reads, writes). Every step has a job object of its own."""
        for job, reads, writes in steps:
            data[writes] = self.jobs[job].clone().execute(*(data[r] for r in reads))
        return data


def reduced(rows: DataFrame, key: str, value: str, combine: Callable[[float, float], float], start: float) -> DataFrame:
    """(key, value): a user's associative and commutative reduction of two numbers. Each partition's rows go key by key through it first, in batches, so that what a key's task gets is one row from each batch."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict = {}
            for k, v in zip(batch[key], batch[value]):
                out[k] = combine(out.get(k, start), v)
            yield pd.DataFrame({key: list(out), value: np.array(list(out.values()), dtype=float)})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        total = start
        for v in rows[value]:
            total = combine(total, v)
        return pd.DataFrame({key: rows[key].iloc[:1], value: [total]})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {value} double"
    return rows.select(key, F.col(value).cast("double")).mapInPandas(part, schema).groupBy(key).applyInPandas(whole, schema)


class Translator:
    """Between rows of cells (i, j, value) and an application's blocks (bi, bj, cells), arrays in row order with 0 for cells without a row."""

    def __init__(self, width: int) -> None:
        self.width = width

    def read(self, cells: DataFrame) -> DataFrame:
        n = self.width
        at = (F.col("i") % n) * n + F.col("j") % n
        blocks = cells.groupBy(F.floor(F.col("i") / n).alias("bi"), F.floor(F.col("j") / n).alias("bj")).agg(F.map_from_entries(F.collect_list(F.struct(at, "value"))).alias("m"))
        return blocks.select("bi", "bj", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("cells"))

    def write(self, blocks: DataFrame) -> DataFrame:
        n = self.width
        rows = blocks.select("bi", "bj", F.posexplode("cells").alias("at", "value")).where("value != 0")
        return rows.select((F.col("bi") * n + F.floor(F.col("at") / n)).alias("i"), (F.col("bj") * n + F.col("at") % n).alias("j"), "value")


class Prototypes:
    """Named configurations, each made once for a region however often it is asked for."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable[[tuple], dict]] = {}
        self.pool: dict[tuple[str, tuple], dict] = {}

    def register(self, name: str, make: Callable[[tuple], dict]) -> None:
        self.makers[name] = make

    def get(self, name: str, region: tuple) -> dict:
        if (name, region) not in self.pool:
            self.pool[name, region] = self.makers[name](region)
        return self.pool[name, region]


def accessed(objects: DataFrame, job: Column, kind: str) -> DataFrame:
    """The objects (reads, writes: arrays of jobs) that a job reads or writes."""
    return objects.where(F.array_contains(kind, job))


#: Which columns an operator declares to use, by flag.
FIELDS = {"price": ["p_retailprice"], "kind": ["p_brand", "p_type"], "size": ["p_size"]}


def fields(df: DataFrame, key: str, *flags: str) -> DataFrame:
    """The key and the columns that flags declare, so that a scan reads no others."""
    return df.select(key, *(c for f in flags for c in FIELDS[f]))


class _Double(Job):
    def execute(self, *reads: DataFrame) -> DataFrame:
        return reads[0].withColumn("v", F.col("v") * 2)


class _Join(Job):
    def execute(self, *reads: DataFrame) -> DataFrame:
        return reads[0].join(reads[1].withColumnRenamed("v", "w"), "k").select("k", (F.col("v") + F.col("w")).alias("v"))


@query("e1_named_jobs", "SELECT p_partkey AS k, p_size * 4 + p_size AS v FROM part")
def _named(spark, d):
    app = Application()
    app.register("double", _Double())
    app.register("join", _Join())
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return app.run([("double", ["a"], "b"), ("double", ["b"], "b"), ("join", ["b", "a"], "c")], a=rows)["c"]


@query("e4_user_reduction", "SELECT l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def _reduction(spark, d):
    return reduced(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", max, 0.0)


@query("e5_translated_blocks", "SELECT p_partkey // 64 AS i, p_partkey % 64 AS j, p_size * 2.0::DOUBLE AS value FROM part")
def _translated(spark, d):
    """Cells to blocks of 8 by 8, doubled there, and back."""
    t = Translator(8)
    cells = table(spark, d, "part").select(F.expr("p_partkey div 64").alias("i"), F.expr("p_partkey % 64").alias("j"), F.col("p_size").cast("double").alias("value"))
    return t.write(t.read(cells).withColumn("cells", F.transform("cells", lambda x: x * 2)))


@query("e6_user_order", "SELECT row_number() OVER (ORDER BY length(p_name), reverse(p_name), p_partkey) - 1 AS place, p_partkey FROM part")
def _order(spark, d):
    """A comparator of the user's is an expression: here shorter names first, then from their ends."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return numbered(p, [F.length("p_name"), F.reverse("p_name"), "p_partkey"], "place").select("place", "p_partkey")


@query("e7_prototypes", "SELECT p_partkey, (p_partkey % 4 + 1) * 10 AS width FROM part")
def _prototypes(spark, d):
    """A configuration of each of four regions, made once and joined by region."""
    p = Prototypes()
    p.register("grid", lambda region: {"width": (region[0] + 1) * 10})
    known = [(k, p.get("grid", (k,))["width"]) for k in (0, 1, 2, 3, 0, 1)]
    made = spark.createDataFrame(sorted(set(known)), "region long, width long")
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("region")).join(F.broadcast(made), "region").select("p_partkey", "width")


@query("p1_access_sets", "SELECT p_partkey AS object, 'read' AS kind FROM part WHERE 5 IN (p_partkey % 7, p_partkey % 11) UNION ALL SELECT p_partkey, 'write' FROM part WHERE p_partkey % 13 = 5")
def _access(spark, d):
    k = F.col("p_partkey")
    objects = table(spark, d, "part").select(k.alias("object"), F.array(k % 7, k % 11).alias("reads"), F.array(k % 13).alias("writes"))
    job = F.lit(5).cast("long")
    return accessed(objects, job, "reads").select("object", F.lit("read").alias("kind")).unionAll(accessed(objects, job, "writes").select("object", F.lit("write").alias("kind")))


@query("p2_declared_fields", "SELECT p_partkey, p_retailprice, p_size FROM part")
def _fields(spark, d):
    return fields(table(spark, d, "part"), "p_partkey", "price", "size")


def entry(spark: SparkSession, argv: list[str]) -> DataFrame:
    """An application's entry: the registered query of a name on a folder, `name folder`."""
    from weft.registry import QUERIES

    name, folder = argv
    return QUERIES[name](spark, folder)
