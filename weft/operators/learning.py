"""Iterative learning and linear algebra: logistic regression, k-means, sparse products, conjugate gradient, stencils."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.registry import query, table
from weft.runtime import iterate, kept, numbered, settle


def logistic_regression(samples: DataFrame, features: list[str], iterations: int = 10, rate: float = 0.1) -> list[float]:
    """Weights from zero by full gradient steps on samples (features..., label -1 or 1).

    Each step is one aggregate with partial sums on the executors; what comes back is a row of
    len(features) sums, and goes out again as one row that is joined, so that all steps are one plan.
    """
    spark, w = samples.sparkSession, [0.0] * len(features)
    margin = sum((F.col(f) * F.get("w", F.lit(k)) for k, f in enumerate(features)), F.lit(0.0))
    pull = F.col("label") * (1 / (1 + F.exp(-F.col("label") * margin)) - 1)
    sums = [F.sum(pull * F.col(f)) for f in features]
    for _ in range(iterations):
        now = F.broadcast(spark.createDataFrame([(w,)], "w array<double>"))
        got = samples.join(now).agg(F.count(F.lit(1)), *sums).first()
        w = [v - rate * (g or 0.0) / max(got[0], 1) for v, g in zip(w, got[1:])]
    return w


def kmeans(samples: DataFrame, features: list[str], start: list[list[float]], iterations: int = 10) -> list[list[float]]:
    """Means from given ones; each sample goes to the nearest, of several the first. Means are one row that is joined, so that all rounds are one plan."""
    means = start
    for _ in range(iterations):
        got = assign(samples, features, means).groupBy("cluster").agg(F.count(F.lit(1)), *(F.sum(f) for f in features)).collect()
        moved = {r[0]: [x / r[1] for x in r[2:]] for r in got}
        means = [moved.get(k, m) for k, m in enumerate(means)]
    return means


def assign(samples: DataFrame, features: list[str], means: list[list[float]]) -> DataFrame:
    now = F.broadcast(samples.sparkSession.createDataFrame([([[float(v) for v in m] for m in means],)], "_means array<array<double>>"))
    square = lambda m: sum(((F.col(f) - F.get(m, F.lit(k))) * (F.col(f) - F.get(m, F.lit(k))) for k, f in enumerate(features)), F.lit(0.0))
    nearest = F.array_min(F.transform("_means", lambda m, k: F.struct(square(m).alias("d"), k.alias("k"))))["k"]
    return samples.join(now).withColumn("cluster", nearest).drop("_means")


_X = ["x0", "x1", "x2", "x3"]


def _samples(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x0"), (F.col("l_extendedprice") / 100000).alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("label"))


_SAMPLES = "s AS MATERIALIZED (SELECT l_quantity / 50 AS x0, l_extendedprice / 100000 AS x1, l_discount AS x2, l_tax AS x3, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END::DOUBLE AS label FROM lineitem)"
_LR = "".join(f", w{i} AS MATERIALIZED (SELECT " + ", ".join(f"any_value(w{i - 1}.a{k}) - 0.1::DOUBLE * sum(label * (1 / (1 + exp(-label * (x0 * a0 + x1 * a1 + x2 * a2 + x3 * a3))) - 1) * x{k}) / count(*) AS a{k}" for k in range(4)) + f" FROM s, w{i - 1})" for i in range(1, 11))


@query("m1_logistic_regression", f"WITH {_SAMPLES}, w0 AS (SELECT 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS a3){_LR} SELECT round(a0, 8) AS w0, round(a1, 8) AS w1, round(a2, 8) AS w2, round(a3, 8) AS w3 FROM w10")
def _regression(spark, d):
    s = settle(_samples(spark, d))
    return spark.createDataFrame([[round(x, 8) for x in logistic_regression(s, _X)]], "w0 double, w1 double, w2 double, w3 double")


_START = [[0.2, 0.2], [0.8, 0.6]]
_KM = "".join(f", m{i} AS MATERIALIZED (SELECT avg(x0) FILTER (NOT far) AS a, avg(x1) FILTER (NOT far) AS b, avg(x0) FILTER (far) AS c, avg(x1) FILTER (far) AS d FROM (SELECT x0, x1, (x0 - c) * (x0 - c) + (x1 - d) * (x1 - d) < (x0 - a) * (x0 - a) + (x1 - b) * (x1 - b) AS far FROM s, m{i - 1}))" for i in range(1, 11))


@query("m2_kmeans", f"WITH {_SAMPLES}, m0 AS (SELECT 0.2::DOUBLE AS a, 0.2::DOUBLE AS b, 0.8::DOUBLE AS c, 0.6::DOUBLE AS d){_KM} SELECT 0 AS cluster, round(a, 6) AS x0, round(b, 6) AS x1 FROM m10 UNION ALL SELECT 1, round(c, 6), round(d, 6) FROM m10")
def _kmeans(spark, d):
    s = settle(_samples(spark, d))
    return spark.createDataFrame([[k, *(round(x, 6) for x in m)] for k, m in enumerate(kmeans(s, _X[:2], _START))], "cluster int, x0 double, x1 double")


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(idx, value) of matrix (row, col, value) times vector (idx, value)."""
    return matrix.join(vector.select(F.col("idx").alias("col"), F.col("value").alias("v")), "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("v")).alias("value"))


@query("j13_sparse_product", "SELECT l_suppkey AS idx, round(sum(l_quantity * p_retailprice), 4) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _spmv(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    return spmv(a, x).withColumn("value", F.round("value", 4))


def unsolved(limit: int) -> ArithmeticError:
    return ArithmeticError(f"no solution within the tolerance after {limit} rounds")


def inner(a: str, b: str) -> Column:
    """The inner product of two columns of a vector."""
    return F.sum(F.col(a) * F.col(b))


def convergence_norm(residual: str) -> Column:
    """The largest size of a residual's elements: what a solver compares with its tolerance."""
    return F.max(F.abs(residual))


def conjugate_gradient(matrix: DataFrame, b: DataFrame, tolerance: float = 1e-10, limit: int = 10_000) -> DataFrame:
    """(idx, value) with matrix * value = b, for a symmetric positive matrix, preconditioned by its diagonal.

    The matrix stays where it is, dealt by column; vectors move. Each round brings two sums and a maximum
    to the driver. Without a solution within the tolerance after `limit` rounds it is an error.
    """
    matrix = kept(settle(matrix.select("row", "col", "value")), "col")
    diagonal = matrix.where("row = col").select(F.col("row").alias("idx"), F.col("value").alias("c"))
    state = settle(b.join(diagonal, "idx").select("idx", "c", F.lit(0.0).alias("x"), F.col("value").alias("r"), (F.col("value") / F.col("c")).alias("p")))
    rho = state.agg(F.sum(F.col("r") * F.col("r") / F.col("c"))).first()[0]
    for _ in range(limit):
        if rho is None or rho == 0.0:
            break
        t = spmv(matrix, state.select("idx", F.col("p").alias("value"))).withColumnRenamed("value", "t")
        both = settle(state.join(t, "idx", "left").withColumn("t", F.coalesce("t", F.lit(0.0))))
        alpha = rho / both.agg(inner("p", "t")).first()[0]
        state = both.select("idx", "c", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("t")).alias("r"), "p")
        worst, again = state.agg(convergence_norm("r"), F.sum(F.col("r") * F.col("r") / F.col("c"))).first()
        if worst <= tolerance:
            break
        state = settle(state.withColumn("p", F.col("r") / F.col("c") + (again / rho) * F.col("p")))
        rho = again
    else:
        raise unsolved(limit)
    return state.select("idx", F.col("x").alias("value"))


def chain(spark, d):
    """A symmetric matrix with a row for each customer, 4 for itself and -1 for those beside it, a solution and what the matrix makes of it."""
    k = F.col("c_custkey")
    n = table(spark, d, "customer").select(k.cast("long").alias("row"))
    top = n.agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    near = n.crossJoin(top).select("row", F.explode(F.expr("filter(array(row - 1, row, row + 1), x -> x between lo and hi)")).alias("col"))  # of one row
    a = near.withColumn("value", F.when(F.col("row") == F.col("col"), 4.0).otherwise(-1.0))
    x = n.select(F.col("row").alias("idx"), (F.col("row") % 7 - F.lit(2.5)).alias("value"))
    return a, x, spmv(a, x)


_SOLUTION = "SELECT c_custkey AS idx, round(c_custkey % 7 - 2.5, 6)::DOUBLE AS value FROM customer"


@query("m4_conjugate_gradient", _SOLUTION)
def _cg(spark, d):
    a, _, b = chain(spark, d)
    return conjugate_gradient(a, b).withColumn("value", F.round("value", 6))


@query("m6_system_norms", "WITH x AS (SELECT c_custkey AS i, c_custkey % 7 - 2.5::DOUBLE AS v FROM customer), b AS (SELECT i, 4 * v - coalesce(lag(v) OVER w, 0) - coalesce(lead(v) OVER w, 0) AS b, v FROM x WINDOW w AS (ORDER BY i)) SELECT round(max(abs(b)), 6) AS norm, round(sum(b * v), 4) AS inner_product FROM b")
def _norms(spark, d):
    """A product with a matrix, its convergence norm, and its inner product with a vector."""
    _, x, b = chain(spark, d)
    both = b.withColumnRenamed("value", "b").join(x, "idx")
    return both.agg(F.round(convergence_norm("b"), 6).alias("norm"), F.round(inner("b", "value"), 4).alias("inner_product"))


def compressed(matrix: DataFrame, n: int) -> DataFrame:
    """One row (n, offsets, columns, elements, diagonal_at) of a small matrix (row, col, value): per row where its elements start, and where its diagonal one is, -1 without one. For a part of a partitioned matrix, as it is one row."""
    rows = matrix.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("e"))
    every = matrix.sparkSession.range(n).select(F.col("id").alias("row")).join(rows, "row", "left").select("row", F.coalesce("e", F.array().cast("array<struct<col:bigint,value:double>>")).alias("e"))
    one = every.agg(F.array_sort(F.collect_list(F.struct("row", "e"))).alias("r")).select(F.transform("r", lambda x: x["e"]).alias("r"))
    sizes = F.transform("r", lambda x: F.size(x))
    offsets = F.transform(F.sequence(F.lit(0), F.size("r")), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    flat = F.flatten("r")
    diagonal = F.transform("r", lambda x, i: F.array_position(F.transform(x, lambda y: y["col"]), i.cast("long")) - 1)
    return one.select(F.lit(n).alias("n"), offsets.alias("offsets"), F.transform(flat, lambda x: x["col"]).alias("columns"), F.transform(flat, lambda x: x["value"]).alias("elements"), diagonal.cast("array<int>").alias("diagonal_at"))


def expanded(matrix: DataFrame) -> DataFrame:
    """(row, col, value) of a compressed matrix."""
    row = matrix.select(F.posexplode(F.slice("offsets", F.lit(2), F.size("offsets") - 1)).alias("row", "end"), "offsets", "columns", "elements")
    row = row.withColumn("start", F.get("offsets", F.col("row"))).where("start < end")
    at = row.select("row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"), "columns", "elements")
    return at.select(F.col("row").cast("long").alias("row"), F.get("columns", F.col("at")).alias("col"), F.get("elements", F.col("at")).alias("value"))


@query("m7_compressed_matrix", "SELECT DISTINCT n_regionkey::BIGINT AS row, (n_nationkey % 5)::BIGINT AS col, (n_regionkey * 5 + n_nationkey % 5)::DOUBLE AS value FROM nation")
def _compressed(spark, d):
    """To the format with a header and back."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_regionkey").cast("long").alias("row"), (F.col("n_nationkey") % 5).cast("long").alias("col")).distinct().withColumn("value", (F.col("row") * 5 + F.col("col")).cast("double"))
    return expanded(compressed(a, 5))


def conjugate_residual(matrix: DataFrame, b: DataFrame, tolerance: float = 1e-10, limit: int = 10_000) -> DataFrame:
    """(idx, value) with matrix * value = b, for a symmetric matrix that need not be positive.

    Vectors stay distributed; each round is one sparse product and brings two sums and a maximum to the
    driver. Without a solution within the tolerance after `limit` rounds it is an error.
    """
    matrix = kept(settle(matrix.select("row", "col", "value")), "col")

    def product(state: DataFrame) -> DataFrame:
        t = spmv(matrix, state.select("idx", F.col("r").alias("value"))).withColumnRenamed("value", "ar")
        return state.join(t, "idx", "left").withColumn("ar", F.coalesce("ar", F.lit(0.0)))

    start = b.select("idx", F.lit(0.0).alias("x"), F.col("value").alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("ap"))
    state, before = settle(product(start)), None
    for _ in range(limit):
        worst, now = state.agg(F.max(F.abs("r")), F.sum(F.col("r") * F.col("ar"))).first()
        if worst is None or worst <= tolerance:
            break
        if now == 0.0:
            raise ArithmeticError("the residual stays: the matrix takes it to one at right angles")
        beta = now / before if before else 0.0
        state = settle(state.withColumns({"p": F.col("r") + beta * F.col("p"), "ap": F.col("ar") + beta * F.col("ap")}))
        alpha = now / state.agg(F.sum(F.col("ap") * F.col("ap"))).first()[0]
        state = settle(product(state.select("idx", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p", "ap")))
        before = now
    else:
        raise unsolved(limit)
    return state.select("idx", F.col("x").alias("value"))


@query("m5_conjugate_residual", _SOLUTION)
def _cr(spark, d):
    a, _, b = chain(spark, d)
    return conjugate_residual(a, b).withColumn("value", F.round("value", 6))


def heat(grid: DataFrame, n: int, steps: int, factor: float) -> DataFrame:
    """(i, j, k, value) after steps of the 7-point stencil inside a grid of n^3 cells; the border stays.

    The sum of the six neighbours less 6 * value / (factor * factor): only the centre is divided, as in the
    operator this follows. A cell gives its value to its neighbours, which sum what they get.
    """
    moves = F.array(*(F.struct(*(F.lit(x).cast("long").alias(a) for x, a in zip(m, ("di", "dj", "dk")))) for m in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))))

    def step(now: DataFrame) -> DataFrame:
        given = now.select("*", F.explode(moves).alias("m")).select((F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), (F.col("k") + F.col("m.dk")).alias("k"), F.when(F.expr("m.di = 0 and m.dj = 0 and m.dk = 0"), F.col("value")).alias("own"), F.when(F.expr("m.di != 0 or m.dj != 0 or m.dk != 0"), F.col("value")).alias("near"))
        got = given.where(f"i between 0 and {n - 1} and j between 0 and {n - 1} and k between 0 and {n - 1}").groupBy("i", "j", "k").agg(F.max("own").alias("own"), F.sum("near").alias("near"))
        edge = f"i in (0, {n - 1}) or j in (0, {n - 1}) or k in (0, {n - 1})"
        return got.select("i", "j", "k", F.when(F.expr(edge), F.col("own")).otherwise(F.col("near") - 6.0 * F.col("own") / (factor * factor)).alias("value"))

    return iterate(grid, step, steps, every=3)


_HEAT = "".join(f", h{t} AS MATERIALIZED (SELECT a.i, a.j, a.k, CASE WHEN a.i IN (0, 7) OR a.j IN (0, 7) OR a.k IN (0, 7) THEN any_value(a.value) ELSE sum(b.value) - 6.0 * any_value(a.value) / 4 END AS value FROM h{t - 1} a JOIN h{t - 1} b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY a.i, a.j, a.k)" for t in (1, 2, 3))


@query("h1_heat", f"WITH h0 AS MATERIALIZED (SELECT x.range AS i, y.range AS j, z.range AS k, ((x.range + 8 * (y.range + 8 * z.range)) % 5 + 1)::DOUBLE AS value FROM range(8) x, range(8) y, range(8) z){_HEAT} SELECT i, j, k, round(value, 6) AS value FROM h3")
def _heat(spark, d):
    grid = spark.range(512).select((F.col("id") % 8).alias("i"), (F.floor(F.col("id") / 8) % 8).alias("j"), F.floor(F.col("id") / 64).alias("k"), (F.col("id") % 5 + 1).cast("double").alias("value"))
    return heat(grid, 8, 3, 2.0).withColumn("value", F.round("value", 6))


def heat_blocks(grid: DataFrame, size: tuple[int, int, int], parts: tuple[int, int, int], width: int, steps: int, factor: float) -> DataFrame:
    """As heat() on a grid of any size cut into blocks, of which each has ghosts of `width` cells around it.

    A block makes `width` steps by itself before ghosts are exchanged, so that there is one shuffle for so
    many steps. A block with its ghosts is one task's; size must be a multiple of parts.
    """
    if any(n % p for n, p in zip(size, parts)):
        raise ValueError("blocks aren't equal")
    block = [n // p for n, p in zip(size, parts)]
    axes = ("i", "j", "k")

    def advance(n: int):
        def run(cells: pd.DataFrame) -> pd.DataFrame:
            low = [int(cells[f"b{a}"].iloc[0]) * b - width for a, b in zip(axes, block)]
            at = tuple(cells[a].to_numpy() - lo for a, lo in zip(axes, low))
            now = np.zeros([b + 2 * width for b in block])
            now[at] = cells["value"].to_numpy()
            places = np.meshgrid(*(np.arange(len_) + lo for len_, lo in zip(now.shape, low)), indexing="ij")
            inside = np.logical_and.reduce([(x > 0) & (x < top - 1) for x, top in zip(places, size)])
            for _ in range(n):
                near = sum(np.roll(now, s, axis) for axis in range(3) for s in (1, -1))
                now = np.where(inside, near - 6.0 * now / (factor * factor), now)
            core = tuple(slice(width, width + b) for b in block)
            return pd.DataFrame({a: places[x][core].ravel() for x, a in enumerate(axes)} | {"value": now[core].ravel()})

        return run

    done = 0
    while done < steps:
        n = min(width, steps - done)
        near = grid
        for a, b in zip(axes, block):
            near = near.withColumn(f"b{a}", F.explode(F.expr(f"sequence(floor(({a} - {width}) / {b}), floor(({a} + {width}) / {b}))")))
        for a, p in zip(axes, parts):
            near = near.where(F.col(f"b{a}").between(0, p - 1))
        grid = settle(near.groupBy("bi", "bj", "bk").applyInPandas(advance(n), "i long, j long, k long, value double"))
        done += n
    return grid


_AROUND = " UNION ALL ".join(f"SELECT i + {a} AS i, j + {b} AS j, k + {c} AS k, value FROM {{t}}" for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
_BLOCKS = "".join(f", n{t} AS MATERIALIZED (SELECT i, j, k, sum(value) AS near FROM ({_AROUND.format(t=f'h{t - 1}')}) GROUP BY 1, 2, 3), h{t} AS MATERIALIZED (SELECT h.i, h.j, h.k, CASE WHEN h.i IN (0, 7) OR h.j IN (0, 7) OR h.k IN (0, top - 1) THEN value ELSE near - 6.0 * value / 4 END AS value FROM h{t - 1} h JOIN n{t} n ON n.i = h.i AND n.j = h.j AND n.k = h.k, z)" for t in range(1, 6))


@query("h3_heat_blocks", f"WITH z AS (SELECT (count(*) // 64 - count(*) // 64 % 2)::INT AS top FROM part), h0 AS MATERIALIZED (SELECT (r - 1) % 8 AS i, (r - 1) // 8 % 8 AS j, (r - 1) // 64 AS k, p_size::DOUBLE AS value FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) AS r FROM part), z WHERE (r - 1) // 64 < top){_BLOCKS} SELECT i, j, k, round(value, 4) AS value FROM h5")
def _blocks(spark, d):
    """A column of 8 by 8 cells, as high as there are parts, in 2 by 2 by 2 blocks: five steps, two between exchanges."""
    rows = numbered(table(spark, d, "part").select("p_partkey", "p_size"), ["p_partkey"], "r")
    top = rows.count() // 64
    top -= top % 2
    cell = [(F.col("r") % 8).alias("i"), F.expr("r div 8 % 8").alias("j"), F.expr("r div 64").alias("k"), F.col("p_size").cast("double").alias("value")]
    return heat_blocks(rows.select(*cell).where(F.col("k") < top), (8, 8, top), (2, 2, 2), 2, 5, 2.0).withColumn("value", F.round("value", 4))


@query("w13_stencil_1d", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS value FROM lineitem")
def _stencil(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(-1, 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 4).alias("value"))
