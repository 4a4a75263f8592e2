"""Graphs as edge tables (src, dst): ranks, degrees, components, searches, ancestors, edits; grids as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, table
from weft.runtime import iterate, kept, numbered, settle

DAMPING, ITERATIONS = 0.85, 10


def pagerank(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(id, rank) after a number of iterations; nodes without out-edges share their rank with all.

    Edges stay where they are, dealt by src, and nodes by id: an iteration is a join on the spot and one
    shuffle, of the sums by dst.
    """
    edges = settle(edges.select("src", "dst"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    nodes = kept(settle(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(degree.withColumnRenamed("src", "id"), "id", "left")), "id")
    edges = kept(edges, "src")
    n, loose_ends = nodes.agg(F.count(F.lit(1)), F.count_if(F.isnull("degree"))).first()

    def step(rank: DataFrame) -> DataFrame:
        given = edges.join(rank, edges.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum("gives").alias("got"))
        loose = rank.where("gives is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar() if loose_ends else F.lit(0.0)
        return _ranked(nodes.join(given, "id", "left"), F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + loose / n))

    return iterate(_ranked(nodes, F.lit(1.0 / n)), step, iterations, every=1 if loose_ends else 5).select("id", "rank")  # a step that reads its input twice is cut each time


def _ranked(nodes: DataFrame, rank: Column) -> DataFrame:
    return nodes.select("id", rank.alias("rank"), (rank / F.col("degree")).alias("gives"))


def symmetrized(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once; no loops."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of a node's component, by rounds of minimum labels with pointer jumping. Links stay dealt by their ends; labels move."""
    both = kept(settle(edges.select("src", "dst").union(edges.select("dst", "src")).distinct()), "dst")
    label = settle(both.groupBy(F.col("dst").alias("id")).agg(F.least(F.min("dst"), F.min("src")).alias("component")))
    while True:
        near = both.join(label, both.dst == label.id).groupBy("src").agg(F.min("component").alias("m"))
        low = label.join(near, label.id == near.src).select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        up = low.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        after = settle(low.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("jump", "component")).alias("component")))
        if after.where("component != was").isEmpty():
            both.unpersist()
            return after.select("id", "component")
        label = after.drop("was")


def bfs(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, level) of all nodes reachable from start (id), by directed edges, however deep. A round joins only the last level's nodes."""
    seen = front = settle(start.select("id", F.lit(0).alias("level")).distinct())
    level = 0
    while not front.isEmpty():
        level += 1
        found = front.join(edges, front.id == edges.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = settle(found.withColumn("level", F.lit(level)))
        seen = _grown(seen, front, level)
    return seen


def _grown(seen: DataFrame, front: DataFrame, level: int, every: int = 8) -> DataFrame:
    """seen and the last level's nodes; every few levels they are written as one."""
    return settle(seen.union(front)) if level % every == 0 else seen.union(front)


def preorder(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, path) of the nodes of trees, by depth-first search: children by their ids, a node before its subtree, in the order of path, the ids from the root."""
    seen = front = settle(roots.select("id", F.array("id").alias("path")))
    level = 0
    while not front.isEmpty():
        level += 1
        front = settle(front.join(edges, front.id == edges.src).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        seen = _grown(seen, front, level)
    return seen


def edited(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Distinct edges without removed ones, then with added ones."""
    return edges.select("src", "dst").join(removed, ["src", "dst"], "left_anti").union(added.select("src", "dst")).distinct()


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which neither end is in gone (id)."""
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def ancestors(needs: DataFrame, asked: DataFrame, depth: int | None = None) -> DataFrame:
    """asked (job, other) with is_before: whether other is among the jobs that job needs (job, needs), directly or through at most `depth` edges.

    Searches go back from each job that is asked about, a level a round; a job seen for it before is not
    followed again, so that a cycle ends.
    """
    front = seen = settle(asked.select("job", F.col("job").alias("at")).distinct())
    found = None
    k = 0
    while (depth is None or k < depth) and not front.isEmpty():
        k += 1
        up = front.join(needs.select(F.col("job").alias("at"), F.col("needs").alias("next")), "at").select("job", F.col("next").alias("at")).distinct()
        found = up if found is None else settle(found.union(up).distinct())
        front = settle(up.join(seen, ["job", "at"], "left_anti"))
        seen = _grown(seen, front, k)
    if found is None:
        return asked.withColumn("is_before", F.lit(False))
    hit = found.distinct().select("job", F.col("at").alias("other"), F.lit(True).alias("hit"))
    return asked.join(hit, ["job", "other"], "left").select("job", "other", F.coalesce("hit", F.lit(False)).alias("is_before"))


def flood(cells: DataFrame) -> DataFrame:
    """(i, j, i0, j0) of grid cells (i, j, colour): the least cell of each one's region, cells of one colour that touch by a side. One shuffle gives the links, rounds of components the regions."""
    cell = F.struct(F.col("i").alias("i"), F.col("j").alias("j"))
    sides = F.array(*(F.struct(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")).alias("side"), F.lit(k).alias("axis")) for k, (a, b) in enumerate(((0, 0), (1, 0), (0, 1)))))
    given = cells.select(cell.alias("src"), "colour", F.inline(sides))
    here = given.where("axis = 0").select("side", F.col("colour").alias("own")).hint("merge")  # all cells: by their estimated size they would be sent through the driver
    touching = given.where("axis > 0").join(here, "side").where(F.col("colour").eqNullSafe(F.col("own"))).select("src", F.col("side").alias("dst"))
    alone = cells.select(cell.alias("src"), cell.alias("dst"))
    return components(touching.union(alone)).select("id.i", "id.j", F.col("component.i").alias("i0"), F.col("component.j").alias("j0"))


def _sales(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links of suppliers (negative ids) and parts, both ways."""
    s = table(spark, d, "lineitem").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return s.union(s.select("dst", "src"))


_SALES = "e AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem UNION ALL SELECT DISTINCT l_partkey, -l_suppkey FROM lineitem)"
_CHAIN = "".join(
    f", r{i} AS MATERIALIZED (SELECT v.id, {1 - DAMPING} / (SELECT count(*) FROM v) + {DAMPING} * coalesce(g.got, 0) AS rank FROM v LEFT JOIN (SELECT dst AS id, sum(rank / degree) AS got FROM e JOIN g0 USING (src) JOIN r{i - 1} r ON r.id = e.src GROUP BY 1) g USING (id))"
    for i in range(1, ITERATIONS + 1)
)


@query("g1_pagerank", f"WITH {_SALES}, v AS (SELECT DISTINCT src AS id FROM e), g0 AS (SELECT src, count(*) AS degree FROM e GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v){_CHAIN} SELECT id, round(rank, 8) AS rank FROM r{ITERATIONS}")
def _pagerank(spark, d):
    return pagerank(_sales(spark, d)).select("id", F.round("rank", 8).alias("rank"))


@query("a33_out_degree", f"WITH {_SALES} SELECT src AS id, count(*) AS degree FROM e GROUP BY 1")
def _degree(spark, d):
    return _sales(spark, d).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """From each customer to its nation."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst"))


_MOVES = "e AS (SELECT c_custkey AS src, (-1 - c_nationkey)::BIGINT AS dst FROM customer)"


@query("g3_symmetrized", f"WITH {_MOVES} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def _symmetrized(spark, d):
    return symmetrized(_moves(spark, d))


@query("a27_distinct_neighbours", f"WITH {_SALES} SELECT src AS id, count(DISTINCT dst) AS n FROM e GROUP BY 1")
def _neighbours(spark, d):
    return _sales(spark, d).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))


@query("g5_components", f"WITH {_MOVES} SELECT dst AS id, dst AS component FROM e UNION SELECT src, dst FROM e")
def _components(spark, d):
    return components(_moves(spark, d))


@query("g6_colour_count", f"WITH {_MOVES} SELECT count(DISTINCT dst) AS n FROM e")
def _colours(spark, d):
    return components(_moves(spark, d)).agg(F.countDistinct("component").alias("n"))


#: Nation to customer to order: a tree of three levels below the nations of region 0.
_TREE = "e AS (SELECT -1 - c_nationkey AS src, c_custkey AS dst FROM customer UNION ALL SELECT o_custkey, 10000000000 + o_orderkey FROM orders), s AS (SELECT -1 - n_nationkey AS id FROM nation WHERE n_regionkey = 0)"


@query("g4_bfs_levels", f"WITH {_TREE} SELECT id::BIGINT AS id, 0 AS level FROM s UNION ALL SELECT dst, 1 FROM e JOIN s ON src = id UNION ALL SELECT f.dst, 2 FROM e JOIN s ON e.src = id JOIN e f ON f.src = e.dst")
def _bfs(spark, d):
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    edges = c.select((-1 - F.col("c_nationkey")).cast("long").alias("src"), F.col("c_custkey").alias("dst")).union(o.select("o_custkey", F.col("o_orderkey") + 10000000000))
    return bfs(edges, n.where("n_regionkey = 0").select((-1 - F.col("n_nationkey")).cast("long").alias("id")))


@query("g4_dfs_order", f"WITH {_TREE}, p AS (SELECT id::BIGINT AS id, [id::BIGINT] AS path FROM s UNION ALL SELECT dst, [id, dst] FROM e JOIN s ON src = id UNION ALL SELECT f.dst, [id, e.dst, f.dst] FROM e JOIN s ON e.src = id JOIN e f ON f.src = e.dst) SELECT id, row_number() OVER (ORDER BY path) - 1 AS place FROM p")
def _dfs(spark, d):
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    edges = c.select((-1 - F.col("c_nationkey")).cast("long").alias("src"), F.col("c_custkey").alias("dst")).union(o.select("o_custkey", F.col("o_orderkey") + 10000000000))
    paths = preorder(edges, n.where("n_regionkey = 0").select((-1 - F.col("n_nationkey")).cast("long").alias("id")))
    return numbered(paths, ["path"], "place").select("id", "place")


#: Each order of a customer follows the one before within 90 days.
_FOLLOWS = "f AS (SELECT o_orderkey AS dst, o_custkey, lag(o_orderkey) OVER w AS src, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def _follows(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("dst"), F.lag("o_orderkey").over(w).alias("src"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))
    return o


@query("g5_chains", f"WITH {_FOLLOWS}, i AS (SELECT f.dst, f.o_custkey, sum((src IS NULL OR days > 90)::INT) OVER (PARTITION BY f.o_custkey ORDER BY o_orderdate, o_orderkey) AS chain FROM f JOIN orders ON o_orderkey = dst) SELECT dst AS id, min(dst) OVER (PARTITION BY o_custkey, chain) AS component FROM i QUALIFY count(*) OVER (PARTITION BY o_custkey, chain) > 1")
def _chains(spark, d):
    """Chains of orders, of all lengths."""
    return components(_follows(spark, d).where("src is not null and days <= 90").select("src", "dst"))


@query("g7_flood_fill", "WITH RECURSIVE g AS (SELECT p_partkey // 64 AS i, p_partkey % 64 AS j FROM part WHERE p_size <= 22), r AS (SELECT i, j, i AS i1, j AS j1 FROM g UNION SELECT r.i, r.j, g.i, g.j FROM r JOIN g ON abs(g.i - r.i1) + abs(g.j - r.j1) = 1) SELECT i, j, min((i1, j1))[1] AS i0, min((i1, j1))[2] AS j0 FROM r GROUP BY 1, 2".replace("min((i1, j1))[1]", "min(struct_pack(a := i1, b := j1)).a").replace("min((i1, j1))[2]", "min(struct_pack(a := i1, b := j1)).b"))
def _flood(spark, d):
    """Regions of small parts on a grid."""
    return flood(table(spark, d, "part").where("p_size <= 22").select(F.expr("p_partkey div 64").alias("i"), F.expr("p_partkey % 64").alias("j"), F.lit(1).alias("colour")))


_LINKS = "e AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem), x AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT -s_suppkey AS src, s_suppkey AS dst FROM supplier)"


def _links(spark, d):
    link = [(-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")]
    lines = table(spark, d, "lineitem")
    added = table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("src"), F.col("s_suppkey").alias("dst"))
    return lines.select(*link), lines.where("l_returnflag = 'R'").select(*link), added


@query("g8_edge_edits", f"WITH {_LINKS} (FROM e EXCEPT FROM x) UNION FROM a")
def _edits(spark, d):
    edges, gone, added = _links(spark, d)
    return edited(edges, added, gone)


@query("g8_edge_present", f"WITH {_LINKS} SELECT src, dst, (src, dst) IN (SELECT (src, dst) FROM x) AS present FROM e")
def _present(spark, d):
    edges, asked, _ = _links(spark, d)
    known = asked.distinct().withColumn("present", F.lit(True))
    return edges.distinct().join(known, ["src", "dst"], "left").fillna(False, ["present"])


#: An event needs the one before it of its user, and the last one of its type.
_NEEDS = "n AS (SELECT event_id AS job, unnest([lag(event_id) OVER u, lag(event_id) OVER t]) AS needs FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id), t AS (PARTITION BY user_id, event_type ORDER BY event_id)), q AS (SELECT event_id AS job, unnest([lag(event_id, 5) OVER u, event_id - 1]) AS other FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id))"


@query("g9_ancestors", f"WITH RECURSIVE {_NEEDS}, a(job, seen, k) AS (SELECT DISTINCT job, needs, 1 FROM n WHERE needs IS NOT NULL UNION SELECT a.job, n.needs, k + 1 FROM a JOIN n ON n.job = a.seen WHERE n.needs IS NOT NULL AND k < 4) SELECT job, other, (job, other) IN (SELECT (job, seen) FROM a) AS is_before FROM q WHERE other IS NOT NULL")
def _ancestors(spark, d):
    """Is the fifth event before it, or the one with the id below, among those an event needs over four edges?"""
    from pyspark.sql.window import Window as W

    e = table(spark, d, "events")
    user, kind = W.partitionBy("user_id").orderBy("event_id"), W.partitionBy("user_id", "event_type").orderBy("event_id")
    e = e.select(F.col("event_id").alias("job"), F.array(F.lag("event_id").over(user), F.lag("event_id").over(kind)).alias("n"), F.array(F.lag("event_id", 5).over(user), F.col("event_id") - 1).alias("o"))
    needs = e.select("job", F.explode("n").alias("needs")).where("needs is not null")
    asked = e.select("job", F.explode("o").alias("other")).where("other is not null")
    return ancestors(settle(needs), asked, 4)


@query("g11_without_nodes", f"WITH {_LINKS} SELECT src, count(*) AS degree FROM e WHERE src % 3 <> 0 AND dst % 5 <> 0 GROUP BY 1")
def _without(spark, d):
    edges, _, _ = _links(spark, d)
    gone = edges.where("src % 3 = 0").select(F.col("src").alias("id")).union(edges.where("dst % 5 = 0").select("dst")).distinct()
    return without_nodes(edges.distinct(), gone).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def critical_path(steps: DataFrame, limit: int = 64) -> DataFrame:
    """(id, depth, total) for steps (id, prev, seconds): the walk from each by prev to a step without one, by pointer doubling in log2(longest) joins."""
    now = settle(steps.select("id", F.col("prev").alias("to"), F.lit(1).cast("long").alias("depth"), F.col("seconds").alias("total")))
    for _ in range(limit):
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        now = settle(now.join(ahead, "to", "left").select("id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("t2", F.lit(0))).alias("total")))
        if now.where("to is not null").isEmpty():
            return now.select("id", "depth", "total")
    raise ValueError("a cycle")


_STEPS = "s AS (SELECT event_id, lag(event_id) OVER w AS prev, (value * 100)::BIGINT AS seconds, user_id, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("g10_critical_path", f"WITH {_STEPS} SELECT event_id AS id, row_number() OVER w AS depth, (sum(seconds) OVER w)::BIGINT AS total FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _critical(spark, d):
    from pyspark.sql.window import Window as W

    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return critical_path(e.select(F.col("event_id").alias("id"), F.lag("event_id").over(w).alias("prev"), F.round(F.col("value") * 100).cast("long").alias("seconds")))
