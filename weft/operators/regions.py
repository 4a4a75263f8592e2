"""Boxes of integer cells, half-open: intersection, cover, adjacency, union, difference, partitions with ghosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.registry import query, table
from weft.runtime import numbered

AXES = ("x", "y")


def _level(size: int, grow: int) -> Column:
    """The least level whose cells, of size * 2^level, are as large as a box."""
    most = F.greatest(F.col("dx"), F.col("dy")) + 2 * grow
    return F.greatest(F.ceil(F.log2(most / F.lit(float(size)))), F.lit(0)).cast("int")


def _cells(box: DataFrame, size: int, levels: list[int], grow: int = 0) -> DataFrame:
    """box (id, x, y, dx, dy) with its own level and a row for each cell that it touches at that level and all higher ones of levels: two by two a level at most."""
    box = box.withColumn("own", _level(size, grow))
    box = box.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col("own")))).withColumn("wide", F.expr(f"{size} * shiftleft(1L, level)"))
    for a in AXES:
        box = box.withColumn(f"c{a}", F.explode(F.sequence(F.expr(f"floor(({a} - {grow}) / wide)"), F.expr(f"floor(({a} + d{a} - 1 + {grow}) / wide)"))))
    return box


def box_join(left: DataFrame, right: DataFrame, kind: str, size: int = 8) -> DataFrame:
    """Pairs (a, b) of boxes (id, x, y, dx, dy): left intersects, covers or is adjacent to right.

    Boxes meet in cells, by an equi-join, at the level of the larger one, so that none is in many cells,
    however large it is; each pair counts in one cell only, that of the greatest of both corners, so that
    no distinct is needed. Levels are doublings, a few dozen at most.
    """
    grow = 1 if kind == "adjacent" else 0
    found = left.select(_level(size, grow).alias("n")).union(right.select(_level(size, 0))).distinct()
    levels = sorted(r[0] for r in found.where("n is not null").collect()) or [0]
    a = _cells(left, size, levels, grow).select(F.col("id").alias("a"), "level", "wide", "cx", "cy", F.col("own").alias("own_a"), *(F.col(c).alias(f"a_{c}") for c in ("x", "y", "dx", "dy")))
    b = _cells(right, size, levels).select(F.col("id").alias("b"), "level", "cx", "cy", F.col("own").alias("own_b"), *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "dx", "dy")))
    both = a.join(b, ["level", "cx", "cy"]).where(F.col("level") == F.greatest("own_a", "own_b"))
    for x in AXES:
        both = both.where(F.col(f"c{x}") == F.floor(F.greatest(F.col(f"a_{x}") - grow, F.col(f"b_{x}")) / F.col("wide")))
    return both.where(relation(kind)).select("a", "b")


def relation(kind: str) -> Column:
    e = {"intersect": "a_{x} < b_{x} + b_d{x} and b_{x} < a_{x} + a_d{x}", "cover": "a_{x} <= b_{x} and b_{x} + b_d{x} <= a_{x} + a_d{x}", "adjacent": "a_{x} <= b_{x} + b_d{x} and b_{x} <= a_{x} + a_d{x}"}[kind]
    every = " and ".join(e.format(x=x) for x in AXES)
    return F.expr(every if kind != "adjacent" else f"{every} and not ({' and '.join('a_{x} < b_{x} + b_d{x} and b_{x} < a_{x} + a_d{x}'.format(x=x) for x in AXES)})")


def _boxes(spark, d):
    """A box for each part, 1500 of them to a strip of 200 columns, so that boxes stay as dense however many there are."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey * 37 % 200 + 200 * (p_partkey div 1500)").alias("x"), (F.col("p_partkey") * 91 % 170).alias("y"), (1 + F.col("p_size") % 5).cast("long").alias("dx"), (1 + F.col("p_size") % 7).cast("long").alias("dy"))


_BOXES = "p AS (SELECT p_partkey AS id, p_partkey * 37 % 200 + 200 * (p_partkey // 1500) AS x, p_partkey * 91 % 170 AS y, (1 + p_size % 5)::BIGINT AS dx, (1 + p_size % 7)::BIGINT AS dy FROM part)"
_MEET = "a.x < b.x + b.dx AND b.x < a.x + a.dx AND a.y < b.y + b.dy AND b.y < a.y + a.dy"


@query("j6_intersect", f"WITH {_BOXES} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {_MEET}")
def _intersect(spark, d):
    return box_join(_boxes(spark, d), _boxes(spark, d), "intersect")


@query("j7_cover", f"WITH {_BOXES} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x <= b.x AND b.x + b.dx <= a.x + a.dx AND a.y <= b.y AND b.y + b.dy <= a.y + a.dy")
def _cover(spark, d):
    return box_join(_boxes(spark, d), _boxes(spark, d), "cover")


@query("j8_adjacent", f"WITH {_BOXES} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x <= b.x + b.dx AND b.x <= a.x + a.dx AND a.y <= b.y + b.dy AND b.y <= a.y + a.dy AND NOT ({_MEET})")
def _adjacent(spark, d):
    return box_join(_boxes(spark, d), _boxes(spark, d), "adjacent")


def cells(box: DataFrame) -> DataFrame:
    return box.select(F.explode(F.expr("sequence(x, x + dx - 1)")).alias("i"), "y", "dy").select("i", F.explode(F.expr("sequence(y, y + dy - 1)")).alias("j"))


_CELLS = "SELECT DISTINCT i, unnest(range(y, y + dy)) AS j FROM (SELECT unnest(range(x, x + dx)) AS i, y, dy FROM p WHERE {})"


@query("u4_union_cells", f"WITH {_BOXES} {_CELLS.format('true')}")
def _union(spark, d):
    return cells(_boxes(spark, d)).distinct()


def difference_cells(boxes: DataFrame, remove: DataFrame) -> DataFrame:
    """(i, j) of the cells of boxes that no box of remove has, once each: one sum over the cells of both, so that neither side is sent whole through the driver."""
    both = cells(boxes).withColumn("gone", F.lit(False)).unionByName(cells(remove).withColumn("gone", F.lit(True)))
    return both.groupBy("i", "j").agg(F.max("gone").alias("gone")).where("not gone").select("i", "j")


@query("u5_difference_cells", f"WITH {_BOXES} {_CELLS.format('dx > dy')} EXCEPT {_CELLS.format('dx <= dy')}")
def _difference(spark, d):
    b = _boxes(spark, d)
    return difference_cells(b.where("dx > dy"), b.where("dx <= dy"))


def difference(boxes: DataFrame, remove: DataFrame, size: int = 8) -> DataFrame:
    """Disjoint pieces (id, x, y, dx, dy) that cover what is left of each box without all boxes of remove; none if nothing is left.

    What a box loses is clipped to it and distinct first, so a row holds no more than the box has rectangles.
    """
    pairs = box_join(boxes, remove, "intersect", size)
    a = boxes.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x", "y", "dx", "dy")))
    b = remove.select(F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "dx", "dy")))
    lost = pairs.join(a, "a").join(b, "b")
    low = lambda c: F.greatest(f"a_{c}", f"b_{c}")
    high = lambda c: F.least(F.col(f"a_{c}") + F.col(f"a_d{c}"), F.col(f"b_{c}") + F.col(f"b_d{c}"))
    lost = lost.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set(F.struct(low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1")))).alias("lost"))

    def box(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
        return F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))

    def cut(p: Column, r: Column) -> Column:
        x0, x1, y0, y1 = F.greatest(p["x0"], r["x0"]), F.least(p["x1"], r["x1"]), F.greatest(p["y0"], r["y0"]), F.least(p["y1"], r["y1"])
        sides = F.array(box(p["x0"], x0, p["y0"], p["y1"]), box(x1, p["x1"], p["y0"], p["y1"]), box(x0, x1, p["y0"], y0), box(x0, x1, y1, p["y1"]))
        return F.when((x0 >= x1) | (y0 >= y1), F.array(box(p["x0"], p["x1"], p["y0"], p["y1"]))).otherwise(F.filter(sides, lambda s: (s["x0"] < s["x1"]) & (s["y0"] < s["y1"])))

    whole = F.array(box(F.col("x"), F.col("x") + F.col("dx"), F.col("y"), F.col("y") + F.col("dy")))
    left = boxes.join(lost, "id", "left").select("id", F.when(F.col("lost").isNull(), whole).otherwise(F.aggregate("lost", whole, lambda acc, r: F.flatten(F.transform(acc, lambda p: cut(p, r))))).alias("pieces"))
    return left.select("id", F.inline("pieces")).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))


@query("u5_difference_boxes", f"WITH {_BOXES}, c AS (SELECT id, i, unnest(range(y, y + dy)) AS j FROM (SELECT id, unnest(range(x, x + dx)) AS i, y, dy FROM p WHERE dx > dy)) SELECT id, count(*) AS area FROM c WHERE (i, j) NOT IN ({_CELLS.format('dx <= dy')}) GROUP BY 1")
def _difference_boxes(spark, d):
    b = _boxes(spark, d)
    return difference(b.where("dx > dy"), b.where("dx <= dy")).groupBy("id").agg(F.sum(F.col("dx") * F.col("dy")).alias("area"))


@query("f40_region_distance", f"WITH {_BOXES} SELECT id, greatest(0, x - 110, 100 - (x + dx)) + greatest(0, y - 90, 80 - (y + dy)) AS distance FROM p")
def _distance(spark, d):
    return _boxes(spark, d).select("id", F.expr("greatest(0, x - 110, 100 - (x + dx)) + greatest(0, y - 90, 80 - (y + dy))").alias("distance"))


def grown(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """boxes (id, x, y, dx, dy), each the least box that holds it and all of others with its id."""
    both = boxes.unionByName(others)
    low = {c: F.min(c).alias(c) for c in AXES}
    high = {c: F.max(F.col(c) + F.col(f"d{c}")).alias(f"h{c}") for c in AXES}
    out = both.groupBy("id").agg(*low.values(), *high.values())
    return out.select("id", *AXES, *((F.col(f"h{c}") - F.col(c)).alias(f"d{c}") for c in AXES))


def common_surface(a: str = "a_", b: str = "b_") -> Column:
    """The length of the border that two boxes share that touch by a side; 0 for others."""
    over = {c: F.least(F.expr(f"{a}{c} + {a}d{c}"), F.expr(f"{b}{c} + {b}d{c}")) - F.greatest(f"{a}{c}", f"{b}{c}") for c in AXES}
    x, y = over["x"], over["y"]
    return F.when((x == 0) & (y > 0), y).when((y == 0) & (x > 0), x).otherwise(F.lit(0).cast("long"))


_PAIR = "SELECT a.id AS a, b.id AS b, a.x AS a_x, a.y AS a_y, a.dx AS a_dx, a.dy AS a_dy, b.x AS b_x, b.y AS b_y, b.dx AS b_dx, b.dy AS b_dy FROM p a JOIN p b ON a.x <= b.x + b.dx AND b.x <= a.x + a.dx AND a.y <= b.y + b.dy AND b.y <= a.y + a.dy"
_OVER = "least(a_{c} + a_d{c}, b_{c} + b_d{c}) - greatest(a_{c}, b_{c})"


@query("f40_common_surface", f"WITH {_BOXES}, q AS (SELECT a, b, {_OVER.format(c='x')} AS ox, {_OVER.format(c='y')} AS oy FROM ({_PAIR})) SELECT a, b, CASE WHEN ox = 0 THEN oy ELSE ox END AS surface FROM q WHERE (ox = 0 AND oy > 0) OR (oy = 0 AND ox > 0)")
def _surface(spark, d):
    p = _boxes(spark, d)
    a, b = (p.select(F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("x", "y", "dx", "dy"))) for n in "ab")
    return box_join(p, p, "adjacent").join(a, "a").join(b, "b").select("a", "b", common_surface().alias("surface")).where("surface > 0")


@query("x25_grown_regions", f"WITH {_BOXES}, u AS (FROM p UNION ALL SELECT id, x + 7, y - 3, 2, 2 FROM p WHERE id % 2 = 0) SELECT id, min(x) AS x, min(y) AS y, max(x + dx) - min(x) AS dx, max(y + dy) - min(y) AS dy FROM u GROUP BY 1")
def _grown(spark, d):
    p = _boxes(spark, d)
    return grown(p, p.where("id % 2 = 0").select("id", (F.col("x") + 7).alias("x"), (F.col("y") - 3).alias("y"), F.lit(2).cast("long").alias("dx"), F.lit(2).cast("long").alias("dy")))


@query("x25_shrunk_regions", f"WITH {_BOXES}, c AS (SELECT id, i, unnest(range(y, y + dy)) AS j FROM (SELECT id, unnest(range(x, x + dx)) AS i, y, dy FROM p)) SELECT id, count(*) AS area FROM c WHERE NOT (i % 20 BETWEEN 5 AND 9 AND j % 20 BETWEEN 5 AND 9) GROUP BY 1")
def _shrunk(spark, d):
    """Regions without what they give up: a square of each block of 20 by 20."""
    p = _boxes(spark, d)
    blocks = cells(p).select((F.floor(F.col("i") / 20) * 20 + 5).alias("x"), (F.floor(F.col("j") / 20) * 20 + 5).alias("y")).distinct()
    given = blocks.select(F.monotonically_increasing_id().alias("id"), "x", "y", F.lit(5).cast("long").alias("dx"), F.lit(5).cast("long").alias("dy"))
    return difference(p, given).groupBy("id").agg(F.sum(F.col("dx") * F.col("dy")).alias("area"))


@query("j11_ids_by_region", f"WITH {_BOXES}, r AS (SELECT DISTINCT x // 40 AS rx, y // 40 AS ry FROM p) SELECT rx, ry, list(p.id ORDER BY p.id) AS ids FROM r JOIN p ON p.x < rx * 40 + 40 AND rx * 40 < p.x + p.dx AND p.y < ry * 40 + 40 AND ry * 40 < p.y + p.dy GROUP BY 1, 2")
def _by_region(spark, d):
    """The ids that meet each region asked about, found once for every region however often it is asked."""
    p = _boxes(spark, d)
    asked = p.select(F.expr("x div 40").alias("rx"), F.expr("y div 40").alias("ry")).distinct()
    regions = asked.select(F.struct("rx", "ry").alias("id"), (F.col("rx") * 40).alias("x"), (F.col("ry") * 40).alias("y"), F.lit(40).cast("long").alias("dx"), F.lit(40).cast("long").alias("dy"))
    return box_join(regions, p, "intersect", 40).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("ids")).select("a.rx", "a.ry", "ids")


def space_runs(size: int, width: int, parts: int, global_ghost: bool) -> list[tuple[int, int, str]]:
    """(start, length, kind) of the runs along an axis of `size` cells, from 1, in equal parts: ghost runs of `width` on both sides of each border between parts, core runs between them; with global_ghost also a run outside either end."""
    out, block = [], size // parts
    if global_ghost and width:
        out.append((1 - width, width, "ghost"))
    for k in range(parts):
        start, end = 1 + k * block, 1 + (k + 1) * block
        left, right = (width if k or global_ghost else 0), (width if k < parts - 1 or global_ghost else 0)
        if left:
            out.append((start, left, "ghost"))
        if end - right > start + left:
            out.append((start + left, end - right - start - left, "core"))
        if right:
            out.append((end - right, right, "ghost"))
    if global_ghost and width:
        out.append((size + 1, width, "ghost"))
    return out


_RUNS = "SELECT k, x AS start, lead(x) OVER (PARTITION BY k ORDER BY x) - x AS length FROM (SELECT DISTINCT r_regionkey AS k, unnest([1 - w, 1, 1 + w, 1 + 20 - w, 1 + 20, 1 + 20 + w, 1 + 40 - w, 41, 41 + w]) AS x FROM (SELECT r_regionkey, r_regionkey % 3 + 1 AS w FROM region))"


@query("x3_space_runs", f"SELECT * FROM ({_RUNS}) WHERE length IS NOT NULL")
def _runs(spark, d):
    """Runs of an axis of 40 cells in two parts, with ghosts of one to three cells, for each region."""
    made = [(w, s, n) for w in (1, 2, 3) for s, n, _ in space_runs(40, w, 2, True)]
    runs = spark.createDataFrame(made, "w int, start int, length int")
    return table(spark, d, "region").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") % 3 + 1).alias("w")).join(F.broadcast(runs), "w").select("k", "start", "length")


def partition_kinds(cells: DataFrame, block: int, width: int) -> DataFrame:
    """(i, j, pi, pj, inner, central, outer) of cells (i, j) in blocks: central cells are those of the block, inner ones those of them further than width from its border, outer ones the ghosts around it."""
    reach = lambda a: F.sequence(F.floor((F.col(a) - width) / block), F.floor((F.col(a) + width) / block))
    out = cells.withColumn("pi", F.explode(reach("i"))).withColumn("pj", F.explode(reach("j")))
    central = (F.floor(F.col("i") / block) == F.col("pi")) & (F.floor(F.col("j") / block) == F.col("pj"))
    deep = F.lit(True)
    for a in ("i", "j"):
        deep = deep & F.pmod(F.col(a), F.lit(block)).between(width, block - 1 - width)
    return out.select("i", "j", "pi", "pj", (central & deep).alias("inner"), central.alias("central"), (~central).alias("outer"))


@query("x2_partition_kinds", f"WITH {_BOXES}, c AS ({_CELLS.format('true')}), o AS (SELECT i, j, (i + u) // 25 AS pi, (j + v) // 25 AS pj FROM c, (SELECT unnest([-2, 0, 2]) AS u), (SELECT unnest([-2, 0, 2]) AS v)) SELECT DISTINCT i, j, pi, pj, pi = i // 25 AND pj = j // 25 AND i % 25 BETWEEN 2 AND 22 AND j % 25 BETWEEN 2 AND 22 AS inner, pi = i // 25 AND pj = j // 25 AS central, NOT (pi = i // 25 AND pj = j // 25) AS outer FROM o".replace("(i + u) // 25", "floor((i + u) / 25)::BIGINT").replace("(j + v) // 25", "floor((j + v) / 25)::BIGINT").replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'))
def _kinds(spark, d):
    return partition_kinds(cells(_boxes(spark, d)).distinct(), 25, 2)


@query("x7_partitions_and_objects", f"WITH {_BOXES}, q AS (SELECT DISTINCT x // 50 AS px, y // 50 AS py FROM p), v AS (SELECT unnest(['phi', 'velocity']) AS variable) SELECT row_number() OVER (ORDER BY px, py, variable) - 1 AS object, px, py, variable FROM q, v")
def _objects(spark, d):
    """A logical object of each variable for each partition that has cells, numbered."""
    parts = _boxes(spark, d).select(F.expr("x div 50").alias("px"), F.expr("y div 50").alias("py")).distinct()
    named = parts.withColumn("variable", F.explode(F.array(F.lit("phi"), F.lit("velocity"))))
    return numbered(named, ["px", "py", "variable"], "object").select("object", "px", "py", "variable")


@query("j14_cell_indices", "SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS idx FROM (SELECT p_partkey // 64 AS i, p_partkey % 64 AS j FROM part WHERE p_size > 10)")
def _indices(spark, d):
    """Useful cells and their rows in a matrix."""
    p = table(spark, d, "part").where("p_size > 10").select(F.expr("p_partkey div 64").alias("i"), F.expr("p_partkey % 64").alias("j"))
    return numbered(p, ["i", "j"], "idx")


@query("x2_ghost_partitions", f"WITH {_BOXES}, c AS ({_CELLS.format('true')}), g AS (SELECT i, j, (i + u) // 25 AS pi, (j + v) // 25 AS pj FROM c, (SELECT unnest([-1, 0, 1]) AS u), (SELECT unnest([-1, 0, 1]) AS v) WHERE i + u >= 0 AND j + v >= 0) SELECT DISTINCT i, j, pi, pj, i // 25 <> pi OR j // 25 <> pj AS ghost FROM g")
def _ghosts(spark, d):
    """Each cell in its block and, as a ghost, in every block within one cell."""
    c = cells(_boxes(spark, d)).distinct()
    near = lambda a: F.array_distinct(F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda u: F.when(F.col(a) + u >= 0, F.floor((F.col(a) + u) / 25))), lambda x: x.isNotNull()))
    out = c.withColumn("pi", F.explode(near("i"))).withColumn("pj", F.explode(near("j")))
    return out.withColumn("ghost", (F.floor(F.col("i") / 25) != F.col("pi")) | (F.floor(F.col("j") / 25) != F.col("pj")))
