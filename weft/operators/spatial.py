"""Points in space: partition by bins, neighbours within a radius, spheres, planes; local and global grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weft.registry import query, table
from weft.runtime import numbered, settle


def _bins(points: DataFrame, size: float, reach: int) -> DataFrame:
    for a in ("x", "y"):
        at = F.floor(F.col(a) / size)
        points = points.withColumn(f"c{a}", F.explode(F.sequence(at - reach, at + reach)) if reach else at)
    return points


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b, square) of points (id, x, y) within radius: left is given to its bin and those around, right to its own, so each pair meets once.

    Bins are merged, not broadcast: the size of points is estimated too low for a copy of them to go through the driver.
    """
    a = _bins(left, radius, 1).select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    b = _bins(right, radius, 0).select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    square = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return a.join(b.hint("merge"), ["cx", "cy"]).select("a", "b", square.alias("square")).where(F.col("square") <= radius * radius)


def plane_side(low: list[str], high: list[str], normal: list[float], offset: float) -> Column:
    """Of a box from low to high: 0 if the plane normal * x = offset meets it, else the side on which it lies."""
    least = sum((F.col(lo if n >= 0 else hi) * n for lo, hi, n in zip(low, high, normal)), F.lit(0.0))
    most = sum((F.col(hi if n >= 0 else lo) * n for lo, hi, n in zip(low, high, normal)), F.lit(0.0))
    return F.when(least > offset, 1).when(most < offset, -1).otherwise(0)


def _running_max(df: DataFrame, chunk: str, order: list[str], value: str, out: str, end: int) -> DataFrame:
    """df with the maximum of value over all rows up to `end` rows on from this one; chunks are summed up first, so that only their maxima meet in one task."""
    most = df.groupBy(chunk).agg(F.max(value).alias("_most"))
    most = most.select(chunk, F.max("_most").over(W.orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    within = F.max(value).over(W.partitionBy(chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, end))
    return df.withColumn(out, within).join(most, chunk).withColumn(out, F.greatest(out, "_before")).drop("_before")


def axis_clusters(spans: DataFrame, width: int) -> DataFrame:
    """(id, cluster) of spans (id, low, high) along an axis: spans that overlap, through others too, have one cluster, the lowest place of any. Places are ordered in chunks of `width`."""
    rows = spans.select("id", "low", "high", F.floor(F.col("low") / width).alias("chunk"))
    rows = _running_max(rows, "chunk", ["low", "id"], "high", "_high", -1)
    rows = rows.withColumn("_start", F.when(F.col("_high").isNull() | (F.col("low") >= F.col("_high")), F.col("low")))
    return _running_max(rows, "chunk", ["low", "id"], "_start", "cluster", 0).select("id", "cluster")


def matrix_partition(matrix: DataFrame, width: int) -> DataFrame:
    """(part, kind, idx, local) for a sparse matrix (row, col) cut into parts of `width` consecutive indices.

    kind 0: rows whose columns all lie in the part; 1: rows with a column elsewhere; 2: columns elsewhere
    that the part's rows use. local numbers a part's indices, by kind and index.
    """
    part = lambda c: F.floor(F.col(c) / width)
    rows = matrix.groupBy(part("row").alias("part"), F.col("row").alias("idx")).agg(F.max(part("col") != part("row")).cast("int").alias("kind"))
    ghosts = matrix.where(part("col") != part("row")).select(part("row").alias("part"), F.col("col").alias("idx"), F.lit(2).alias("kind")).distinct()
    local = F.row_number().over(W.partitionBy("part").orderBy("kind", "idx")) - 1
    return rows.unionByName(ghosts).select("part", "kind", "idx", local.alias("local"))


def local_grid(grid: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """The cells (i, j, value) of grid from low to below high, numbered from low."""
    inside = F.col("i").between(low[0], high[0] - 1) & F.col("j").between(low[1], high[1] - 1)
    return grid.where(inside).select((F.col("i") - low[0]).alias("i"), (F.col("j") - low[1]).alias("j"), "value")


def put_local(grid: DataFrame, local: DataFrame, low: tuple[int, int]) -> DataFrame:
    """grid with the cells of a local grid in place of its own."""
    placed = local.select((F.col("i") + low[0]).alias("i"), (F.col("j") + low[1]).alias("j"), "value")
    return grid.join(placed.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", "value").unionByName(placed)


def max_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, error: the largest difference of the cells that both grids have; null if none."""
    both = a.join(b.select("i", "j", F.col("value").alias("other")), ["i", "j"])
    return both.agg(F.max(F.abs(F.col("value") - F.col("other"))).alias("error"))


def _points(spark, d):
    """A point for each part, 1500 to a strip."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey * 37 % 200 + 200 * (p_partkey div 1500)").alias("x"), (F.col("p_partkey") * 91 % 170).alias("y"), "p_size")


_POINTS = "p AS (SELECT p_partkey AS id, p_partkey * 37 % 200 + 200 * (p_partkey // 1500) AS x, p_partkey * 91 % 170 AS y, p_size FROM part)"
_SQUARE = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query("v8_near_points", f"WITH {_POINTS} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {_SQUARE} <= 16")
def _near(spark, d):
    p = _points(spark, d)
    return near_pairs(p, p, 4.0).select("a", "b")


@query("v9_in_spheres", f"WITH {_POINTS}, s AS (SELECT s_suppkey AS id, s_suppkey * 53 % 200 AS x, s_suppkey * 29 % 170 AS y FROM supplier) SELECT a.id AS sphere, b.id AS point, {_SQUARE} = 25 AS boundary FROM s a JOIN p b ON {_SQUARE} <= 25")
def _spheres(spark, d):
    """Points in or on spheres of one radius."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 200).alias("x"), (F.col("s_suppkey") * 29 % 170).alias("y"))
    return near_pairs(s, _points(spark, d), 5.0).select(F.col("a").alias("sphere"), F.col("b").alias("point"), (F.col("square") == 25).alias("boundary"))


@query("v11_box_plane", f"WITH {_POINTS} SELECT id, CASE WHEN x - (y + p_size) > 10 THEN 1 WHEN x + p_size - y < 10 THEN -1 ELSE 0 END AS side FROM p")
def _plane(spark, d):
    p = _points(spark, d).withColumns({"hx": F.col("x") + F.col("p_size"), "hy": F.col("y") + F.col("p_size")})
    return p.select("id", plane_side(["x", "y"], ["hx", "hy"], [1.0, -1.0], 10.0).alias("side"))


def half_space_share(low: list[str], high: list[str], axis: int, offset: float) -> Column:
    """The size of the part of a box that lies below offset along an axis."""
    size = F.lit(1.0)
    for k, (lo, hi) in enumerate(zip(low, high)):
        top = F.greatest(F.least(F.col(hi), F.lit(offset)), F.col(lo)) if k == axis else F.col(hi)
        size = size * (top - F.col(lo))
    return size


def kd_cells(points: DataFrame, depth: int) -> DataFrame:
    """(id, cell, axis, value) of points (id, x, y) in a tree that is cut in two `depth` times, at the lower median, x and y in turn: the leaf, from 0, and the last cut above it. A round numbers all points and joins them with as many cuts as there are cells."""
    now = points.select("id", "x", "y", F.lit(0).cast("long").alias("cell"))
    for k in range(depth):
        axis = "xy"[k % 2]
        placed = numbered(now, ["cell", axis, "id"], "place").drop("value")
        middle = placed.groupBy("cell").agg((F.min("place") + F.floor((F.count(F.lit(1)) - 1) / 2)).alias("place"))
        cuts = placed.join(middle, ["cell", "place"]).select("cell", F.col(axis).alias("value"))
        cuts = F.broadcast(cuts) if 1 << k <= 4096 else cuts
        now = settle(placed.drop("place").join(cuts, "cell").select("id", "x", "y", (F.col("cell") * 2 + (F.col(axis) > F.col("value")).cast("long")).alias("cell"), "value"))
    return now.select("id", "cell", F.lit("xy"[(depth - 1) % 2]).alias("axis"), "value")


@query("v8_near_surface", f"WITH {_POINTS} SELECT id, x, y FROM p WHERE abs(sqrt((x - 100) * (x - 100) + (y - 85) * (y - 85)) - 60) <= 3")
def _near_surface(spark, d):
    """Points within 3 of a circle's line."""
    away = F.abs(F.sqrt((F.col("x") - 100) * (F.col("x") - 100) + (F.col("y") - 85) * (F.col("y") - 85)) - 60)
    return _points(spark, d).where(away <= 3).select("id", "x", "y")


@query("v9_outside_spheres", f"WITH {_POINTS}, s AS (SELECT s_suppkey AS id, s_suppkey * 53 % 200 AS x, s_suppkey * 29 % 170 AS y FROM supplier) SELECT id FROM p a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {_SQUARE} <= 25)")
def _outside(spark, d):
    """Points outside of all spheres."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 200).alias("x"), (F.col("s_suppkey") * 29 % 170).alias("y"))
    p = _points(spark, d)
    return p.select("id").join(near_pairs(s, p, 5.0).select(F.col("b").alias("id")).distinct(), "id", "left_anti")


@query("v11_half_space", f"WITH {_POINTS} SELECT id, ((greatest(least(x + p_size, 100), x) - x) * 2.0::DOUBLE) AS size FROM p")
def _half(spark, d):
    p = _points(spark, d).withColumns({"hx": F.col("x") + F.col("p_size"), "hy": F.col("y") + 2})
    return p.select("id", half_space_share(["x", "y"], ["hx", "hy"], 0, 100.0).alias("size"))


def _kd_sql(depth: int) -> str:
    out = "k0 AS MATERIALIZED (SELECT id, x, y, 0 AS cell, 0 AS value FROM p)"
    for k in range(depth):
        axis = "xy"[k % 2]
        out += f", c{k} AS MATERIALIZED (SELECT cell, quantile_disc({axis}, 0.5) AS value FROM k{k} GROUP BY 1), k{k + 1} AS MATERIALIZED (SELECT id, x, y, cell * 2 + ({axis} > c.value)::INT AS cell, c.value FROM k{k} JOIN c{k} c USING (cell))"
    return out


@query("v14_kd_cells", f"WITH {_POINTS}, {_kd_sql(4)} SELECT id, cell::BIGINT AS cell, 'y' AS axis, value FROM k4")
def _kd(spark, d):
    return kd_cells(_points(spark, d), 4)


def _axis_sql(axis: str) -> str:
    return f"SELECT id, max(CASE WHEN h IS NULL OR low >= h THEN low END) OVER (ORDER BY low, id ROWS UNBOUNDED PRECEDING) AS {axis} FROM (SELECT id, {axis} AS low, max({axis} + p_size % 2 + 1) OVER (ORDER BY {axis}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM q)"


@query("v10_axis_clusters", f"WITH q AS (SELECT p_partkey AS id, p_partkey * 5 + p_partkey * 37 % 11 AS x, p_partkey * 7 + p_partkey * 91 % 13 AS y, p_size FROM part) SELECT id, a.x, b.y FROM ({_axis_sql('x')}) a JOIN ({_axis_sql('y')}) b USING (id)")
def _axes(spark, d):
    """Parts as boxes of one or two cells a side, on axes that grow with them: those that share both clusters may meet."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 5 + F.col("p_partkey") * 37 % 11).alias("x"), (F.col("p_partkey") * 7 + F.col("p_partkey") * 91 % 13).alias("y"), (F.col("p_size") % 2 + 1).alias("side"))
    x, y = (axis_clusters(p.select("id", F.col(a).alias("low"), (F.col(a) + F.col("side")).alias("high")), 1024).withColumnRenamed("cluster", a) for a in ("x", "y"))
    return x.join(y, "id")


_MATRIX = "m AS (SELECT c_custkey AS row, c_custkey AS col FROM customer UNION ALL SELECT c_custkey, c_custkey * c_custkey % 70 + c_custkey // 64 * 64 FROM customer)"


@query("v12_matrix_partition", f"WITH {_MATRIX}, k AS (SELECT row // 64 AS part, row AS idx, max((col // 64 <> row // 64)::INT) AS kind FROM m GROUP BY 1, 2 UNION ALL SELECT DISTINCT row // 64, col, 2 FROM m WHERE col // 64 <> row // 64) SELECT part, kind, idx, row_number() OVER (PARTITION BY part ORDER BY kind, idx) - 1 AS local FROM k")
def _matrix(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.explode(F.array(F.col("c_custkey"), F.expr("c_custkey * c_custkey % 70 + c_custkey div 64 * 64"))).alias("col"))
    return matrix_partition(c, 64)


@query("v13_local_grid", "SELECT max(abs(p_size - p_retailprice))::DOUBLE AS error FROM part WHERE p_partkey // 64 BETWEEN 1 AND 2 AND p_partkey % 64 BETWEEN 8 AND 39")
def _local(spark, d):
    """A block of one grid put into another differs from it there alone."""
    cell = [F.expr("p_partkey div 64").alias("i"), F.expr("p_partkey % 64").alias("j")]
    a, b = (table(spark, d, "part").select(*cell, F.col(c).cast("double").alias("value")) for c in ("p_size", "p_retailprice"))
    low, high = (1, 8), (3, 40)
    return max_error(a, put_local(a, local_grid(b, low, high), low))
