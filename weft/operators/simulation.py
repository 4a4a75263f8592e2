"""Steps of flow simulations on sparse grids: time steps, forces, signed distance, extrapolation, particles, projection, stages."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weft.functions.numeric import uniform
from weft.operators.grids import _CORNER, _GRID, _grid, advect, in_box
from weft.operators.learning import conjugate_gradient
from weft.registry import query, table
from weft.runtime import settle

AROUND = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
#: Cells of one row of a grid at most, for numbering its cells.
SPAN = 1 << 31


def _give(grid: DataFrame, **given: Column) -> DataFrame:
    """What each cell gives to itself and its four neighbours: (i, j, own, given...)."""
    parts = (F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit((a, b) == (0, 0)).alias("own"), *(c.alias(n) for n, c in given.items())) for a, b in AROUND)
    return grid.select(F.inline(F.array(*parts)))


def time_step(grid: DataFrame, share: float = 0.5) -> float | None:
    """The longest step in which nothing flows further than `share` of a cell; None where nothing flows."""
    fastest = grid.agg(F.max(F.abs("u") + F.abs("v"))).first()[0]
    return share / fastest if fastest else None


def signed_distance(grid: DataFrame, band: int) -> DataFrame:
    """(i, j, distance) of grid (i, j, value) to where value is zero, negative inside, null beyond band and a half.

    A cell beside one of the other sign is as far away as values along the axes, taken as straight lines,
    say. From there on the distance solves the eikonal equation cell by cell, from the nearer neighbour of
    each axis. A round is one shuffle by cell; 2 * band of them reach all of the band.
    """
    cross = _sided(grid, value=F.col("value")).groupBy("i", "j")
    own = F.max(F.when(F.col("axis") == -1, F.col("value")))
    of = lambda k: F.collect_list(F.when(F.col("axis") == k, F.col("value")))  # noqa: E731  two at most
    first = cross.agg(F.max(F.col("axis") == -1).alias("own"), own.alias("value"), of(0).alias("x"), of(1).alias("y"))
    inside = F.col("value") < 0
    along = lambda c: F.array_min(F.transform(F.filter(c, lambda v: (v < 0) != inside), lambda v: F.col("value") / (F.col("value") - v)))
    state = first.where("own").select("i", "j", inside.alias("inside"), along("x").alias("ax"), along("y").alias("ay"))
    flat = F.when(F.col("ay").isNull(), F.col("ax")).when(F.col("ax").isNull(), F.col("ay")).when((F.col("ax") == 0) | (F.col("ay") == 0), 0.0).otherwise(F.col("ax") * F.col("ay") / F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")))
    state = state.select("i", "j", "inside", flat.alias("near")).withColumn("d", F.col("near"))
    for k in range(2 * band):
        got = _sided(state, inside=F.col("inside"), near=F.col("near"), d=F.col("d")).groupBy("i", "j")
        mine = lambda c: F.max(F.when(F.col("axis") == -1, F.col(c))).alias(c)
        beside = lambda n: F.min(F.when(F.col("axis") == n, F.col("d")))
        got = got.agg(F.max(F.col("axis") == -1).alias("own"), mine("inside"), mine("near"), mine("d"), beside(0).alias("a"), beside(1).alias("b")).where("own")
        a, b_ = F.col("a"), F.col("b")
        both = (a + b_ + F.sqrt(F.greatest(2 - (a - b_) * (a - b_), F.lit(0.0)))) / 2
        reached = F.when(a.isNull() | b_.isNull() | (F.abs(a - b_) >= 1), F.least(a, b_) + 1).otherwise(both)
        state = got.select("i", "j", "inside", "near", F.coalesce("near", F.least("d", reached)).alias("d"))
        state = settle(state) if k % 3 == 2 else state
    d = F.when(F.col("d") <= band + 0.5, F.col("d"))
    return state.select("i", "j", F.when(F.col("inside"), -d).otherwise(d).alias("distance"))


def _sided(grid: DataFrame, **given: Column) -> DataFrame:
    """As _give(), with the axis along which each is given, -1 to itself."""
    parts = (F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(-1 if (a, b) == (0, 0) else int(a == 0)).alias("axis"), *(c.alias(n) for n, c in given.items())) for a, b in AROUND)
    return grid.select(F.inline(F.array(*parts)))


def extrapolate(grid: DataFrame, layers: int) -> DataFrame:
    """grid (i, j, value) whose null values become, layer by layer, the mean of the neighbours that have one."""
    for k in range(layers):
        got = _give(grid, value=F.col("value")).groupBy("i", "j")
        got = got.agg(F.max("own").alias("own"), F.max(F.when(F.col("own"), F.col("value"))).alias("mine"), F.avg(F.when(~F.col("own"), F.col("value"))).alias("near"))
        grid = got.where("own").select("i", "j", F.coalesce("mine", "near").alias("value"))
        grid = settle(grid) if k % 3 == 2 else grid
    return grid


def step_particles(particles: DataFrame, grid: DataFrame, dt: float) -> DataFrame:
    """(id, x, y) after a step with the velocity of the cell that each is in; those outside all cells, before or after, are deleted."""

    def cell(df: DataFrame) -> DataFrame:
        return df.withColumns({"i": F.floor("x"), "j": F.floor("y")})

    moved = cell(particles).join(grid.select("i", "j", "u", "v"), ["i", "j"]).select("id", (F.col("x") + F.col("u") * dt).alias("x"), (F.col("y") + F.col("v") * dt).alias("y"))
    return cell(moved).join(grid.select("i", "j"), ["i", "j"], "left_semi").select("id", "x", "y")


def divergence(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """(i, j, value): what flows out of each cell through its faces.

    Face (axis, i, j, value) lies between cell (i, j) and the one before it along the axis; absent ones
    have the value 0.
    """
    back = F.struct((F.col("i") - F.when(F.col("axis") == 0, 1).otherwise(0)).alias("i"), (F.col("j") - F.when(F.col("axis") == 1, 1).otherwise(0)).alias("j"), F.col("value").alias("value"))
    here = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), (-F.col("value")).alias("value"))
    flow = faces.select(F.col("axis"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value").select(F.inline(F.array(back, here)))
    return cells.select("i", "j").join(flow.groupBy("i", "j").agg(F.sum("value").alias("value")), ["i", "j"], "left").fillna(0.0, ["value"])


def project(faces: DataFrame, cells: DataFrame, tolerance: float = 1e-10, limit: int = 10_000) -> DataFrame:
    """faces (axis, i, j, value) less the gradient of the pressure that makes nothing flow out of any cell (i, j).

    Pressure is 0 outside the cells, so that the matrix is symmetric and positive: 4 for the cell, -1 for
    each neighbour that is a cell.
    """
    cells = settle(cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    idx = lambda a, b: (F.col("i") + a) * SPAN + F.col("j") + b
    beside = cells.select(idx(0, 0).alias("row"), F.explode(F.array(*(idx(a, b) for a, b in AROUND[1:]))).alias("col"))
    beside = beside.join(cells.select(idx(0, 0).alias("col")), "col", "left_semi").select("row", "col", F.lit(-1.0).alias("value"))
    matrix = settle(cells.select(idx(0, 0).alias("row"), idx(0, 0).alias("col"), F.lit(4.0).alias("value")).unionByName(beside))
    b = divergence(faces, cells).select(idx(0, 0).alias("idx"), (-F.col("value")).alias("value"))
    pressure = cells.withColumn("idx", idx(0, 0)).join(conjugate_gradient(matrix, b, tolerance, limit), "idx")
    given = F.array(*(F.struct(F.lit(axis).alias("axis"), (F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), (F.col("value") * sign).alias("value")) for axis, a, b, sign in ((0, 0, 0, -1.0), (0, 1, 0, 1.0), (1, 0, 0, -1.0), (1, 0, 1, 1.0))))
    change = pressure.select(F.inline(given))
    return faces.select("axis", "i", "j", "value").unionByName(change).groupBy("axis", "i", "j").agg(F.sum("value").alias("value"))


def staged(rows: DataFrame, work: Callable[[DataFrame], DataFrame], total: Column, connect: Callable[[DataFrame, Row], DataFrame], stages: int) -> DataFrame:
    """rows after `stages` stages: work on all rows, then a connector that sees one aggregate of them all."""
    for _ in range(stages):
        rows = settle(work(rows))
        rows = connect(rows, rows.agg(total).first())
    return rows


@query("h7_forces", f"WITH {_GRID}, t AS (SELECT 0.5::DOUBLE / max(abs(u) + abs(v)) AS dt FROM g) SELECT i, j, u, round(v - 9.8::DOUBLE * dt, 6) AS v FROM g, t")
def _forces(spark, d):
    """Gravity for one time step."""
    g = _grid(spark, d)
    return g.select("i", "j", "u", F.round(F.col("v") - 9.8 * (time_step(g) or 0.0), 6).alias("v"))


@query("h11_convect", f"WITH {_GRID} SELECT c.i, c.j, round(sum(w * coalesce(value, 0)), 6) AS density, round(sum(w * coalesce(u, 0)), 6) + 0.0 AS u, round(sum(w * coalesce(v, 0)), 6) + 0.0 AS v FROM ({_CORNER}) c LEFT JOIN g ON g.i = fi AND g.j = fj GROUP BY 1, 2")
def _convect(spark, d):
    """Density and both velocities carried along."""
    out = advect(_grid(spark, d), 0.5, ("value", "u", "v"))
    return out.select("i", "j", F.round("value", 6).alias("density"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("u", "v")))


_BAND = 3


def _eikonal_sql(rounds: int) -> str:
    near = lambda t, a, b: f"(SELECT d FROM {t} n WHERE n.i = c.i + {a} AND n.j = c.j + {b})"
    side = lambda a, b: f"(SELECT c.value / (c.value - n.value) FROM g n WHERE n.i = c.i + {a} AND n.j = c.j + {b} AND (n.value < 0) <> (c.value < 0))"
    out = f"f AS MATERIALIZED (SELECT i, j, value < 0 AS inside, least({side(1, 0)}, {side(-1, 0)}) AS ax, least({side(0, 1)}, {side(0, -1)}) AS ay FROM g c)"
    out += ", d0 AS MATERIALIZED (SELECT i, j, inside, CASE WHEN ay IS NULL THEN ax WHEN ax IS NULL THEN ay WHEN ax = 0 OR ay = 0 THEN 0 ELSE ax * ay / sqrt(ax * ax + ay * ay) END AS near, near AS d FROM f)"
    for k in range(1, rounds + 1):
        t = f"d{k - 1}"
        out += f", s{k} AS MATERIALIZED (SELECT i, j, inside, near, d, least({near(t, 1, 0)}, {near(t, -1, 0)}) AS a, least({near(t, 0, 1)}, {near(t, 0, -1)}) AS b FROM {t} c)"
        out += f", d{k} AS MATERIALIZED (SELECT i, j, inside, near, coalesce(near, least(d, CASE WHEN a IS NULL OR b IS NULL OR abs(a - b) >= 1 THEN least(a, b) + 1 ELSE (a + b + sqrt(greatest(2 - (a - b) * (a - b), 0))) / 2 END)) AS d FROM s{k})"
    return out


_LEVEL = "g AS MATERIALIZED (SELECT p_partkey // 64 AS i, p_partkey % 64 AS j, sqrt((p_partkey // 64 % 24 - 12.3) * (p_partkey // 64 % 24 - 12.3) + (p_partkey % 64 - 20.6) * (p_partkey % 64 - 20.6)) * (1 + p_partkey % 3 * 0.1) - 7.0::DOUBLE AS value FROM part)"


def _level(spark, d):
    """A level set of circles, whose slopes vary."""
    i, j = F.expr("p_partkey div 64"), F.expr("p_partkey % 64")
    away = F.sqrt((i % 24 - 12.3) * (i % 24 - 12.3) + (j - 20.6) * (j - 20.6))
    return table(spark, d, "part").select(i.alias("i"), j.alias("j"), (away * (1 + F.col("p_partkey") % 3 * 0.1) - 7.0).alias("value"))


@query("h8_signed_distance", f"WITH {_LEVEL}, {_eikonal_sql(2 * _BAND)} SELECT i, j, round(CASE WHEN d <= {_BAND + 0.5} THEN CASE WHEN inside THEN -d ELSE d END END, 6) AS distance FROM d{2 * _BAND}")
def _distance(spark, d):
    return signed_distance(_level(spark, d), _BAND).withColumn("distance", F.round("distance", 6))


_LAYERS = "".join(f", x{k} AS MATERIALIZED (SELECT a.i, a.j, coalesce(any_value(a.value), avg(b.value)) AS value FROM x{k - 1} a LEFT JOIN (SELECT i + di AS i, j + dj AS j, value FROM x{k - 1}, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(di, dj)) b ON a.i = b.i AND a.j = b.j GROUP BY 1, 2)" for k in (1, 2))


@query("h8_extrapolate", f"WITH {_GRID}, x0 AS MATERIALIZED (SELECT i, j, CASE WHEN value % 7 = 0 THEN value END AS value FROM g){_LAYERS} SELECT i, j, round(value, 6) AS value FROM x2")
def _extrapolate(spark, d):
    known = _grid(spark, d).select("i", "j", F.when(F.col("value") % 7 == 0, F.col("value")).alias("value"))
    return extrapolate(known, 2).withColumn("value", F.round("value", 6))


@query("h9_step_particles", f"WITH {_GRID}, p AS (SELECT p_partkey AS id, p_partkey // 64 + 0.5::DOUBLE AS x, p_partkey % 64 + 0.25::DOUBLE AS y FROM part), m AS (SELECT id, x + u / 2 AS x, y + v / 2 AS y FROM p JOIN g ON i = floor(x) AND j = floor(y)) SELECT id, x, y FROM m WHERE (floor(x)::BIGINT, floor(y)::BIGINT) IN (SELECT (i, j) FROM g)")
def _particles(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 64 + 0.5D").alias("x"), F.expr("p_partkey % 64 + 0.25D").alias("y"))
    return step_particles(p, _grid(spark, d), 0.5)


def _flow(spark, d):
    """A cell for each small part, in rows of 64, and the faces of all parts' cells."""
    p = table(spark, d, "part").select(F.expr("p_partkey div 64").alias("i"), F.expr("p_partkey % 64").alias("j"), "p_size", "p_partkey")
    faces = p.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("axis"), "i", "j", "p_partkey")
    return faces.select("axis", "i", "j", ((F.col("p_partkey") * 7 + F.col("axis") * 3) % 11 - 5).cast("double").alias("value")), p.where("p_size <= 25").select("i", "j")


@query("h12_projection", "SELECT p_partkey // 64 AS i, p_partkey % 64 AS j, 0.0::DOUBLE AS value FROM part WHERE p_size <= 25")
def _projection(spark, d):
    """What still flows out of each cell after the projection."""
    faces, cells = _flow(spark, d)
    return divergence(project(faces, cells), cells).select("i", "j", (F.round("value", 6) + F.lit(0.0)).alias("value"))


_STAGES = "".join(f", s{k} AS MATERIALIZED (SELECT p_partkey, v + (SELECT sum(v * 3 % 1009) FROM s{k - 1}) % 7 AS v FROM (SELECT p_partkey, v * 3 % 1009 AS v FROM s{k - 1}))" for k in (1, 2, 3))


@query("h5_stages", f"WITH s0 AS MATERIALIZED (SELECT p_partkey, p_size::BIGINT AS v FROM part){_STAGES} SELECT p_partkey, v::BIGINT AS v FROM s3")
def _staged(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("v"))
    return staged(rows, lambda r: r.withColumn("v", F.col("v") * 3 % 1009), F.sum("v"), lambda r, t: r.withColumn("v", F.col("v") + (t[0] or 0) % 7), 3)


def reseed_particles(particles: DataFrame, grid: DataFrame, least: int) -> DataFrame:
    """(id, x, y, fresh): particles, and in each cell of grid with fewer than `least` as many new ones as are missing.

    New ones have a null id and stand at places that depend on their cell and number alone, so that a
    task run again seeds the same.
    """
    had = particles.groupBy(F.floor("x").alias("i"), F.floor("y").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    short = grid.select("i", "j").join(had, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)
    new = short.select("i", "j", F.explode(F.sequence(F.col("n"), F.lit(least - 1))).alias("k"))
    key = F.concat_ws(":", "i", "j", "k")
    kind = particles.schema["id"].dataType
    new = new.select(F.lit(None).cast(kind).alias("id"), (F.col("i") + uniform(key, 1)).alias("x"), (F.col("j") + uniform(key, 2)).alias("y"), F.lit(True).alias("fresh"))
    return particles.select("id", "x", "y", F.lit(False).alias("fresh")).unionByName(new)


def remove_particles(particles: DataFrame, grid: DataFrame, depth: float) -> DataFrame:
    """(id, x, y, removed): whether a particle is in a cell of grid (i, j, distance) outside the surface by more than depth, or in none.

    A removed one that comes back is no longer so when asked again: it is reincorporated.
    """
    at = particles.select("id", "x", "y", F.floor("x").alias("i"), F.floor("y").alias("j")).join(grid.select("i", "j", "distance"), ["i", "j"], "left")
    return at.select("id", "x", "y", F.coalesce(F.col("distance") > depth, F.lit(True)).alias("removed"))


def frame(grid: DataFrame, length: float, share: float = 0.5, force: float = 0.0, limit: int = 10_000) -> tuple[DataFrame, int]:
    """grid (i, j, value, u, v) after a frame of `length`, and the number of its substeps.

    Each substep is as long as the velocities allow, carries the values and velocities along, and adds
    force to v. The last one ends with the frame; if `limit` of them don't it is an error.
    """
    left, steps = length, 0
    while left > 1e-12:
        if steps == limit:
            raise ArithmeticError(f"the frame hasn't ended after {limit} substeps")
        dt = min(left, time_step(grid, share) or left)
        grid = settle(advect(grid, dt, ("value", "u", "v")).withColumn("v", F.col("v") + force * dt))
        left, steps = left - dt, steps + 1
    return grid, steps


def adjust_phi(grid: DataFrame, source: Column, depth: float) -> DataFrame:
    """grid (i, j, value, ...) with the value of cells in a source at -depth at most: what a source pours in is inside."""
    return grid.withColumn("value", F.when(source, F.least("value", F.lit(-depth))).otherwise(F.col("value")))


def modify_levelset(grid: DataFrame, particles: DataFrame) -> DataFrame:
    """(i, j, value) of grid after a correction by particles (x, y, radius, sign), which stay on their side of the zero line.

    A particle that lies on the other side by more than its radius has escaped. An escaped one gives its
    cell's centre sign * (radius - distance); the least of these by negative particles, and the greatest by
    positive ones, then stand against the value, and the smaller in size of both results holds.
    """
    at = particles.select(F.floor("x").alias("i"), F.floor("y").alias("j"), "x", "y", "radius", "sign").join(grid.select("i", "j", "value"), ["i", "j"])
    escaped = at.where(F.col("sign") * F.col("value") < -F.col("radius"))
    away = F.sqrt((F.col("x") - F.col("i") - 0.5) * (F.col("x") - F.col("i") - 0.5) + (F.col("y") - F.col("j") - 0.5) * (F.col("y") - F.col("j") - 0.5))
    says = F.col("sign") * (F.col("radius") - away)
    by = escaped.groupBy("i", "j").agg(F.min(F.when(F.col("sign") < 0, says)).alias("low"), F.max(F.when(F.col("sign") > 0, says)).alias("high"))
    low, high = F.least("value", "low"), F.greatest("value", "high")
    return grid.select("i", "j", "value").join(by, ["i", "j"], "left").select("i", "j", F.when(F.abs(low) <= F.abs(high), low).otherwise(high).alias("value"))


def synchronized(particles: DataFrame) -> DataFrame:
    """(id, x, y) of particles (part, id, x, y) of which parts hold copies in their ghost cells: each once, as the part has it in whose cells, columns of parts, it lies, else the lowest part."""
    mine = F.struct((F.floor("x") != F.col("part")).alias("ghost"), "part", "x", "y")
    return particles.groupBy("id").agg(F.min(mine).alias("one")).select("id", "one.x", "one.y")


def smoke_steps(grid: DataFrame, dt: float, source: Column, steps: int) -> DataFrame:
    """grid (i, j, value, u, v) after steps of smoke: density and velocities carried along, then density 1 where the source is."""
    for k in range(steps):
        grid = advect(grid, dt, ("value", "u", "v")).withColumn("value", F.when(source, 1.0).otherwise(F.col("value")))
        grid = settle(grid) if k % 2 else grid
    return grid


def water_substep(grid: DataFrame, particles: DataFrame, dt: float, force: float, band: int, least: int) -> tuple[DataFrame, DataFrame]:
    """One substep of a water frame: grid (i, j, value, u, v), a level set and velocities, and particles (id, x, y).

    Particles move; the level set and velocities are carried along; the force acts; velocities of the air,
    where value is not below 0, come from the water by extrapolation over `band` cells; the level set
    becomes a signed distance again, within `band`; what flows out of water cells is projected away;
    particles outside the grid are deleted, and cells with fewer than `least` get new ones.
    """
    moved = step_particles(particles, grid, dt)
    grid = settle(advect(grid, dt, ("value", "u", "v")).withColumn("v", F.col("v") + force * dt))
    wet = F.col("value") < 0
    for c in ("u", "v"):
        known = extrapolate(grid.select("i", "j", F.when(wet, F.col(c)).alias("value")), band)
        grid = settle(grid.drop(c).join(known.select("i", "j", F.coalesce("value", F.lit(0.0)).alias(c)), ["i", "j"]))
    water = settle(grid.where(wet).select("i", "j"))
    # a face's velocity is the mean of the cells on its sides, and a cell's that of its faces
    ahead = F.array(*(F.struct(F.lit(x).alias("axis"), (F.col("i") + (s if x == 0 else 0)).alias("i"), (F.col("j") + (s if x == 1 else 0)).alias("j"), F.col(c).alias("value")) for x, c in ((0, "u"), (1, "v")) for s in (0, 1)))
    faces = grid.select(F.inline(ahead)).groupBy("axis", "i", "j").agg(F.avg("value").alias("value"))
    flow = settle(project(faces, water)) if not water.isEmpty() else faces
    back = F.array(*(F.struct((F.col("i") - F.when(F.col("axis") == 0, s).otherwise(0)).alias("i"), (F.col("j") - F.when(F.col("axis") == 1, s).otherwise(0)).alias("j"), "axis", "value") for s in (0, 1)))
    cells = flow.select(F.inline(back)).groupBy("i", "j").agg(F.avg(F.when(F.col("axis") == 0, F.col("value"))).alias("u"), F.avg(F.when(F.col("axis") == 1, F.col("value"))).alias("v"))
    far = F.when(wet, -(band + 1.0)).otherwise(band + 1.0)
    level = signed_distance(grid, band)
    out = grid.select("i", "j", "value").join(level, ["i", "j"]).join(cells, ["i", "j"]).select("i", "j", F.coalesce("distance", far).alias("value"), "u", "v")
    seeded = reseed_particles(moved, out.where("value < 0"), least).select("id", "x", "y")
    return settle(out), settle(seeded)


def water_frame(grid: DataFrame, particles: DataFrame, length: float, force: float = -9.8, band: int = 3, least: int = 2, share: float = 0.5, limit: int = 10_000) -> tuple[DataFrame, DataFrame, int]:
    """grid and particles after a frame of `length`, and the number of its substeps, each as long as velocities and force allow; if `limit` of them don't end the frame it is an error."""
    left, steps = length, 0
    while left > 1e-12:
        if steps == limit:
            raise ArithmeticError(f"the frame hasn't ended after {limit} substeps")
        dt = min(left, time_step(grid, share) or left, math.sqrt(share / abs(force)) if force else left)
        grid, particles = water_substep(grid, particles, dt, force, band, least)
        left, steps = left - dt, steps + 1
    return grid, particles, steps


@query("h9_reseed_counts", f"WITH {_GRID} SELECT i, j, greatest(3, (value::BIGINT % 5)) AS n FROM g")
def _reseed(spark, d):
    """Particles of each cell once it has three at least."""
    g = _grid(spark, d)
    some = g.select(F.lit(1).alias("id"), F.col("i"), F.col("j"), F.explode(F.expr("filter(sequence(1, 5), k -> k <= value % 5)")).alias("k"))
    some = some.select("id", (F.col("i") + F.col("k") / 8).alias("x"), (F.col("j") + 0.5).alias("y"))
    return reseed_particles(some, g, 3).groupBy(F.floor("x").alias("i"), F.floor("y").alias("j")).agg(F.count(F.lit(1)).alias("n"))


@query("h9_removed", f"WITH {_GRID}, p AS (SELECT p_partkey AS id, p_partkey // 64 + (p_partkey % 3) AS x, p_partkey % 64 + 0.25::DOUBLE AS y FROM part) SELECT id, coalesce(value - 25 > 10, true) AS removed FROM p LEFT JOIN g ON i = floor(x) AND j = floor(y)")
def _removed(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 64 + p_partkey % 3").alias("x"), F.expr("p_partkey % 64 + 0.25D").alias("y"))
    return remove_particles(p, _grid(spark, d).withColumn("distance", F.col("value") - 25), 10.0).select("id", "removed")


def _substeps(frame_length: float, n: int) -> str:
    """CTEs s0 (the grid and what is left) to s_n."""
    out = f"s0 AS MATERIALIZED (SELECT i, j, value, u, v, {frame_length}::DOUBLE AS rest FROM g)"
    for k in range(1, n + 1):
        out += f", t{k} AS MATERIALIZED (SELECT least(any_value(rest), 0.5::DOUBLE / max(abs(u) + abs(v))) AS dt FROM s{k - 1})"
        out += f", c{k} AS MATERIALIZED (SELECT i, j, rest, dt, floor(x)::BIGINT + a AS fi, floor(y)::BIGINT + b AS fj, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM (SELECT i, j, rest, dt, i - u * dt AS x, j - v * dt AS y FROM s{k - 1}, t{k}), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))"
        out += f", s{k} AS MATERIALIZED (SELECT c.i, c.j, sum(w * coalesce(value, 0)) AS value, sum(w * coalesce(u, 0)) AS u, sum(w * coalesce(v, 0)) - 0.1::DOUBLE * any_value(dt) AS v, any_value(c.rest) - any_value(dt) AS rest FROM c{k} c LEFT JOIN s{k - 1} h ON h.i = fi AND h.j = fj GROUP BY 1, 2)"
    return out


#: Substeps that the SQL has; those after the end of the frame last no time and change nothing.
_MOST = 7


@query("h6_frame", f"WITH {_GRID}, {_substeps(1.0, _MOST)} SELECT i, j, round(value, 6) AS value, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM s{_MOST}")
def _frame(spark, d):
    """A whole frame."""
    out, _ = frame(_grid(spark, d), 1.0, 0.5, -0.1)
    return out.select("i", "j", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("value", "u", "v")))


@query("h7_adjust_phi", f"WITH {_LEVEL} SELECT i, j, round(CASE WHEN i BETWEEN 3 AND 9 AND j BETWEEN 30 AND 40 THEN least(value, -1.5) ELSE value END, 6) AS value FROM g")
def _adjust(spark, d):
    return adjust_phi(_level(spark, d), in_box([3, 30], [9, 40], ["i", "j"]), 1.5).withColumn("value", F.round("value", 6))


_DROPS = "q AS (SELECT p_partkey // 64 + (p_partkey % 10) / 10.0 AS x, p_partkey % 64 + (p_partkey % 7) / 7.0 AS y, 0.2 + p_size / 100.0 AS radius, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END AS sign FROM part)"


@query("h9_modify_levelset", f"WITH {_LEVEL}, {_DROPS}, e AS (SELECT i, j, sign, sign * (radius - sqrt((x - i - 0.5) * (x - i - 0.5) + (y - j - 0.5) * (y - j - 0.5))) AS says FROM q JOIN g ON i = floor(x) AND j = floor(y) WHERE sign * value < -radius), b AS (SELECT i, j, min(says) FILTER (sign < 0) AS low, max(says) FILTER (sign > 0) AS high FROM e GROUP BY 1, 2), c AS (SELECT g.i, g.j, least(value, low) AS low, greatest(value, high) AS high FROM g LEFT JOIN b ON b.i = g.i AND b.j = g.j) SELECT i, j, round(CASE WHEN abs(low) <= abs(high) THEN low ELSE high END, 6) AS value FROM c")
def _modify(spark, d):
    k = F.col("p_partkey")
    drops = table(spark, d, "part").select((F.expr("p_partkey div 64") + k % 10 / 10.0).alias("x"), (k % 64 + k % 7 / 7.0).alias("y"), (0.2 + F.col("p_size") / 100.0).alias("radius"), F.when(k % 2 == 0, -1).otherwise(1).alias("sign"))
    return modify_levelset(_level(spark, d), drops).withColumn("value", F.round("value", 6))


@query("h9_synchronized", "SELECT p_partkey AS id, p_partkey // 64 + (p_partkey % 10) / 10.0 AS x, (p_partkey % 64)::DOUBLE AS y FROM part")
def _synchronized(spark, d):
    """Each particle in the column of its own part and, as a ghost that has moved less, in the next one's."""
    k = F.col("p_partkey")
    own = table(spark, d, "part").select(F.expr("p_partkey div 64").alias("part"), k.alias("id"), (F.expr("p_partkey div 64") + k % 10 / 10.0).alias("x"), (k % 64).cast("double").alias("y"))
    ghost = own.select((F.col("part") + 1).alias("part"), "id", F.col("part").cast("double").alias("x"), "y")
    return synchronized(own.unionByName(ghost))


def _smoke_sql(n: int) -> str:
    out = "s0 AS MATERIALIZED (SELECT i, j, value, u, v FROM g)"
    for k in range(1, n + 1):
        out += f", c{k} AS MATERIALIZED (SELECT i, j, floor(x)::BIGINT + a AS fi, floor(y)::BIGINT + b AS fj, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM (SELECT i, j, i - u * 0.5 AS x, j - v * 0.5 AS y FROM s{k - 1}), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))"
        out += f", s{k} AS MATERIALIZED (SELECT c.i, c.j, CASE WHEN c.i BETWEEN 2 AND 5 AND c.j BETWEEN 10 AND 20 THEN 1 ELSE sum(w * coalesce(value, 0)) END AS value, sum(w * coalesce(u, 0)) AS u, sum(w * coalesce(v, 0)) AS v FROM c{k} c LEFT JOIN s{k - 1} h ON h.i = fi AND h.j = fj GROUP BY 1, 2)"
    return out


@query("h11_smoke_steps", f"WITH {_GRID}, {_smoke_sql(3)} SELECT i, j, round(value, 6) + 0.0 AS value, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM s3")
def _smoke(spark, d):
    out = smoke_steps(_grid(spark, d), 0.5, in_box([2, 10], [5, 20], ["i", "j"]), 3)
    return out.select("i", "j", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("value", "u", "v")))
