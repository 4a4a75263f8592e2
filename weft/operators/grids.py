"""Sparse grids of cells (i, j, value): weighted neighbour sums, gradient, vorticity, smoothing, advection, sources.

A cell without a row has the value 0, so a grid has rows for its useful cells only. Cells give their values to
the cells that need them, which sum what they get: one shuffle by cell, and no self-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.registry import query, table

Weights = dict[tuple[int, int], float]

GRADIENT_X: Weights = {(1, 0): 0.5, (-1, 0): -0.5}
GRADIENT_Y: Weights = {(0, 1): 0.5, (0, -1): -0.5}
SMOOTH: Weights = {(0, 0): 0.5, (1, 0): 0.125, (-1, 0): 0.125, (0, 1): 0.125, (0, -1): 0.125}


def stencil(grid: DataFrame, results: dict[str, dict[str, Weights]]) -> DataFrame:
    """(i, j, results...) on the cells of grid (i, j, values...): each result sums, over columns and offsets, weight * the value at that offset."""
    offsets = sorted({(0, 0)} | {o for r in results.values() for w in r.values() for o in w})

    def part(columns: dict[str, Weights], offset: tuple[int, int]) -> Column:
        return sum((F.col(c) * w[offset] for c, w in columns.items() if offset in w), F.lit(0.0))

    given = F.array(*(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit((a, b) == (0, 0)).alias("own"), *(part(r, (a, b)).alias(n) for n, r in results.items())) for a, b in offsets))
    got = grid.select(F.inline(given)).groupBy("i", "j").agg(F.max("own").alias("own"), *(F.sum(n).alias(n) for n in results))
    return got.where("own").drop("own")


def advect(grid: DataFrame, dt: float, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """(i, j, columns...) of grid (i, j, u, v, columns...) after a semi-Lagrangian step: each cell takes the bilinear values at the place that flows to it."""
    x, y = F.col("i") - F.col("u") * dt, F.col("j") - F.col("v") * dt
    corners = F.array(*(F.struct((F.floor("x") + a).alias("fi"), (F.floor("y") + b).alias("fj"), ((F.col("x") - F.floor("x") if a else 1 - (F.col("x") - F.floor("x"))) * (F.col("y") - F.floor("y") if b else 1 - (F.col("y") - F.floor("y")))).alias("w")) for a in (0, 1) for b in (0, 1)))
    asked = grid.select("i", "j", x.alias("x"), y.alias("y")).select("i", "j", F.inline(corners))
    source = grid.select(F.col("i").alias("fi"), F.col("j").alias("fj"), *columns)
    return asked.join(source, ["fi", "fj"], "left").groupBy("i", "j").agg(*(F.sum(F.col("w") * F.coalesce(c, F.lit(0.0))).alias(c) for c in columns))


def in_box(low: list[float], high: list[float], at: list[str]) -> Column:
    """Whether a place is in a source that is a box, its border included."""
    inside = F.lit(True)
    for a, lo, hi in zip(at, low, high):
        inside = inside & F.col(a).between(lo, hi)
    return inside


def in_cylinder(foot: tuple[float, float, float], height: float, radius: float, at: tuple[str, str, str] = ("x", "y", "z")) -> Column:
    """Whether a place is in a source that is a cylinder standing along the second axis, its border included."""
    x, y, z = map(F.col, at)
    return y.between(foot[1], foot[1] + height) & ((x - foot[0]) * (x - foot[0]) + (z - foot[2]) * (z - foot[2]) <= radius * radius)


def _grid(spark, d):
    """A cell for each part, in rows of 64."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(F.expr("p_partkey div 64").alias("i"), F.expr("p_partkey % 64").alias("j"), F.col("p_size").cast("double").alias("value"), ((p % 7) / 4 - 0.75).alias("u"), ((p % 5) / 4 - 0.5).alias("v"))


_GRID = "g AS MATERIALIZED (SELECT p_partkey // 64 AS i, p_partkey % 64 AS j, p_size::DOUBLE AS value, (p_partkey % 7) / 4.0::DOUBLE - 0.75 AS u, (p_partkey % 5) / 4.0::DOUBLE - 0.5 AS v FROM part)"


def _at(column: str, a: int, b: int) -> str:
    return f"coalesce((SELECT {column} FROM g h WHERE h.i = g.i + {a} AND h.j = g.j + {b}), 0)"


@query("h22_grid_kernels", f"WITH {_GRID} SELECT i, j, round(({_at('value', 1, 0)} - {_at('value', -1, 0)}) / 2, 6) + 0.0 AS dx, round(({_at('value', 0, 1)} - {_at('value', 0, -1)}) / 2, 6) + 0.0 AS dy, round(({_at('v', 1, 0)} - {_at('v', -1, 0)}) / 2 - ({_at('u', 0, 1)} - {_at('u', 0, -1)}) / 2, 6) + 0.0 AS vorticity, round(value / 2 + ({_at('value', 1, 0)} + {_at('value', -1, 0)} + {_at('value', 0, 1)} + {_at('value', 0, -1)}) / 8, 6) AS smooth FROM g")
def _kernels(spark, d):
    less = {o: -w for o, w in GRADIENT_Y.items()}
    out = stencil(_grid(spark, d), {"dx": {"value": GRADIENT_X}, "dy": {"value": GRADIENT_Y}, "vorticity": {"v": GRADIENT_X, "u": less}, "smooth": {"value": SMOOTH}})
    return out.select("i", "j", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("dx", "dy", "vorticity", "smooth")))


_CORNER = "SELECT i, j, floor(x)::BIGINT + a AS fi, floor(y)::BIGINT + b AS fj, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM (SELECT i, j, i - u / 2 AS x, j - v / 2 AS y FROM g), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)"


@query("h7_advect", f"WITH {_GRID} SELECT c.i, c.j, round(sum(w * coalesce(value, 0)), 6) AS value FROM ({_CORNER}) c LEFT JOIN g ON g.i = fi AND g.j = fj GROUP BY 1, 2")
def _advect(spark, d):
    return advect(_grid(spark, d), 0.5).withColumn("value", F.round("value", 6))


@query("h21_sources", "SELECT p_partkey, p_size BETWEEN 10 AND 30 AND p_partkey % 50 BETWEEN 5 AND 20 AS box, p_size BETWEEN 5 AND 25 AND (p_partkey % 50 - 20) * (p_partkey % 50 - 20) + (p_partkey % 30 - 15) * (p_partkey % 30 - 15) <= 144 AS cylinder FROM part")
def _sources(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("x"), F.col("p_size").alias("y"), (F.col("p_partkey") % 30).alias("z"))
    return p.select("p_partkey", in_box([5, 10], [20, 30], ["x", "y"]).alias("box"), in_cylinder((20, 5, 15), 20, 12).alias("cylinder"))
