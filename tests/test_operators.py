import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weft import catalog
from weft.functions.scalars import escape, unescape
from weft.functions import arrays, numeric
from weft.operators import extension, graph, grids, jobs, krylov, learning, regions, sets, simulation, spatial, versions
from weft.runtime import numbered, settle
from weft.sources import files, texts
from weft.streaming.states import tracked
from weft.streaming.windows import first_seen, sessions, windowed


def test_entry_has_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pagerank_with_dangling_node_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (5, 4)], "src long, dst long")
    assert abs(sum(r["rank"] for r in graph.pagerank(edges).collect()) - 1) < 1e-9


def test_components_of_a_long_chain_and_a_loop(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_escape_round_trip(spark):
    text = "a%;b c\n\t\r,:\b%0 %%1"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(escape(df.t).alias("e"), unescape(escape(df.t)).alias("u")).first()
    assert row["u"] == text and not set(";, :\n\t\r\b") & set(row["e"])


def test_box_join_against_all_pairs(spark):
    boxes = [(i, i * 7 % 23, i * 5 % 19, 1 + i % 9, 1 + i % 4) for i in range(60)]
    df = spark.createDataFrame(boxes, "id long, x long, y long, dx long, dy long")
    meets = lambda a, b: a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if meets(a, b))
    assert sorted(map(tuple, regions.box_join(df, df, "intersect", 4).collect())) == want


def test_box_join_of_boxes_small_and_very_large(spark):
    boxes = [(i, i * 7 % 97 - 20, i * 5 % 89 - 30, (1, 3, 40, 100_000)[i % 4], (2, 900, 1, 5)[i % 4]) for i in range(48)]
    df = spark.createDataFrame(boxes, "id long, x long, y long, dx long, dy long")
    for kind in ("intersect", "cover", "adjacent"):
        over = lambda a, b, k: (a[k] < b[k] + b[k + 2]) and (b[k] < a[k] + a[k + 2])
        touch = lambda a, b, k: (a[k] <= b[k] + b[k + 2]) and (b[k] <= a[k] + a[k + 2])
        holds = {"intersect": lambda a, b: over(a, b, 1) and over(a, b, 2), "cover": lambda a, b: all(a[k] <= b[k] and b[k] + b[k + 2] <= a[k] + a[k + 2] for k in (1, 2)), "adjacent": lambda a, b: touch(a, b, 1) and touch(a, b, 2) and not (over(a, b, 1) and over(a, b, 2))}[kind]
        assert sorted(map(tuple, regions.box_join(df, df, kind, 4).collect())) == sorted((a[0], b[0]) for a in boxes for b in boxes if holds(a, b))


def test_conjugate_gradient(spark):
    a = spark.createDataFrame([(i, j, 4.0 if i == j else 1.0) for i in range(8) for j in range(8) if abs(i - j) < 2], "row long, col long, value double")
    b = spark.createDataFrame([(i, float(i)) for i in range(8)], "idx long, value double")
    got = {r["idx"]: r["value"] for r in learning.conjugate_gradient(a, b).collect()}
    for i in range(8):
        assert abs(sum((4.0 if i == j else 1.0) * got[j] for j in range(8) if abs(i - j) < 2) - i) < 1e-8


def test_batch_and_versions(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value int")
    batch = spark.createDataFrame([("a", 1, None), ("a", 2, 9), ("b", 1, 5), ("b", 2, None), ("d", 1, 4)], "key string, seq int, value int")
    assert sorted(map(tuple, sets.merge_latest(base, batch).collect())) == [("a", 9), ("c", 3), ("d", 4)]
    writes = spark.createDataFrame([(1, 5, 50), (1, 9, 90)], "id long, at long, version long")
    reads = spark.createDataFrame([(1, 4), (1, 5), (1, 20), (2, 7)], "id long, at long")
    assert sorted((r["id"], r["at"], r["version"]) for r in sets.version_as_of(writes, reads).collect()) == [(1, 4, None), (1, 5, 50), (1, 20, 90), (2, 7, None)]


def test_sources(spark, tmp_path):
    (tmp_path / "nodes").write_text("0 : 3 : 4 7 9\n1 : 1 : 2\n2 : 0 : \n")
    assert sorted((r["part"], r["id"]) for r in files.read_id_lists(spark, str(tmp_path / "nodes")).collect()) == [(0, 4), (0, 7), (0, 9), (1, 2)]
    (tmp_path / "log").write_text("x 1.5 job 3\ny oops\n")
    got = files.read_log(spark, str(tmp_path / "log"), {"event": (0, "string"), "ts": (1, "double"), "id": (3, "int")}).collect()
    assert sorted((r["event"], r["ts"], r["id"]) for r in got) == [("x", 1.5, 3), ("y", None, None)]
    (tmp_path / "fields").write_text("Face : vel : (40,40,40), (2,2,1), (3,3,3) : none\n")
    row = files.read_fields(spark, str(tmp_path / "fields")).first()
    assert (row["class"], row["name"], row["domain"], row["parts"], row["ghost"], row["flags"]) == ("Face", "vel", [40] * 3, [2, 2, 1], [3] * 3, ["none"])
    (tmp_path / "tags").write_text("time: 1.25\nother: 2\ntime: 2.5\n")
    assert sum(float(r["value"]) for r in files.read_tagged(spark, str(tmp_path / "tags"), "time").collect()) == 3.75
    files.write_adjacency(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, dst long"), str(tmp_path / "adj"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "adj") + "/part=0").select("value").collect()] == ["3 2 000"]
    store = files.Store(spark, str(tmp_path / "kv"))
    handle = store.put(spark.createDataFrame([("k1", "v1"), ("k2", "v2"), ("k3", "v3")], "key string, value string"), 3)
    assert store.load(handle).count() == 3 and store.get(3, "k2").first()["value"] == "v2" and store.get(3, "k1", "k3").count() == 2


def test_difference_pieces_are_disjoint_and_whole(spark):
    boxes = [(i, i * 7 % 23, i * 5 % 19, 1 + i % 9, 1 + i % 4) for i in range(40)]
    df = spark.createDataFrame(boxes, "id long, x long, y long, dx long, dy long")
    cells = lambda b: {(i, j) for i in range(b[1], b[1] + b[3]) for j in range(b[2], b[2] + b[4])}
    gone = set().union(*(cells(b) for b in boxes if b[0] % 3 == 0))
    got = [tuple(r) for r in regions.difference(df, df.where("id % 3 = 0"), 4).collect()]
    for b in boxes:
        mine = [c for p in got if p[0] == b[0] for c in cells(p)]
        assert len(mine) == len(set(mine)) and set(mine) == cells(b) - gone
    assert regions.difference(df, df.limit(0)).count() == 40 and regions.difference(df.limit(0), df).count() == 0


def test_dependencies_by_reverse_scan(spark):
    jobs = {1: ({1, 2}, {3}), 2: ({3}, {1}), 3: ({1, 3}, set()), 4: ({2}, {1, 3}), 5: ({1}, {1}), 6: (set(), {1, 2, 3})}
    want = set()
    for j, (reads, writes) in jobs.items():
        reads, writes = set(reads), set(writes)
        for k in sorted((k for k in jobs if k < j), reverse=True):
            hit = reads & jobs[k][1] or writes & jobs[k][1]
            reads, writes = reads - jobs[k][1], writes - jobs[k][1]
            if hit or writes & jobs[k][0]:
                want.add((j, k))
    rows = [(j, c, c in r, c in w) for j, (r, w) in jobs.items() for c in r | w]
    got = sets.dependencies(spark.createDataFrame(rows, "job long, cell long, reads boolean, writes boolean")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_conjugate_residual_of_an_indefinite_system(spark):
    values = [4.0, -3.0, 2.0, -5.0, 1.0]
    a = spark.createDataFrame([(i, j, values[i] if i == j else 0.5) for i in range(5) for j in range(5) if abs(i - j) < 2], "row long, col long, value double")
    b = spark.createDataFrame([(i, float(i + 1)) for i in range(5)], "idx long, value double")
    got = {r["idx"]: r["value"] for r in learning.conjugate_residual(a, b).collect()}
    for i in range(5):
        assert abs(sum((values[i] if i == j else 0.5) * got[j] for j in range(5) if abs(i - j) < 2) - i - 1) < 1e-8


def test_a_stream_of_events_gives_the_windows_of_the_table(spark, tmp_path):
    events = [(f"2024-01-01 0{h}:{m:02}:00", "a" if m % 2 else "b", float(m)) for h in range(5) for m in range(0, 60, 7)]
    df = spark.createDataFrame(events, "ts string, kind string, value double").selectExpr("ts::timestamp AS ts", "kind", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["kind"], "value", "1 hour", "10 minutes")
    run = stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = sorted(map(tuple, spark.table("hours").collect()))
    want = sorted(map(tuple, windowed(df, "ts", ["kind"], "value", "1 hour", "10 minutes").collect()))
    assert got and got == [w for w in want if w[0].hour < 4]  # the last window is still open


def test_numbers_and_points(spark):
    u = [r[0] for r in spark.range(2000).select(numeric.uniform(F.col("id"), 3)).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03
    df = spark.createDataFrame([(1.0, -3.0, 2.0), (0.0, 2.0, -4.0), (1.0, 0.0, 1.0), (1.0, 0.0, 0.0), (1.0, -2.0, 1.0), (0.0, 0.0, 5.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(numeric.quadratic_roots(df.a, df.b, df.c)).collect()] == [[1, 2], [2], [], [0], [1], []]
    waves = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, []), (3, None)], "id long, v array<double>")
    assert [(r.id, r.k, r.re, r.im) for r in numeric.fourier(waves, "id", "v").collect()] == [(1, k, 1.0, 0.0) for k in range(3)]
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, -0.5, 0.5), (3, 9.0, 9.0)], "id long, x double, y double")
    assert sorted((r.a, r.b) for r in spatial.near_pairs(points, points, 1.0).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    grid = spark.createDataFrame([(0, 0, 2.0, 1.0, 0.0), (1, 0, 4.0, 0.5, 0.0)], "i long, j long, value double, u double, v double")
    assert {(r.i, r.value) for r in grids.advect(grid, 1.0).collect()} == {(0, 0.0), (1, 3.0)}


def _system(spark, values, beside):
    n = len(values)
    rows = [(i, j, values[i] if i == j else beside) for i in range(n) for j in range(n) if abs(i - j) < 2]
    dense = np.zeros((n, n))
    for i, j, v in rows:
        dense[i, j] = v
    return spark.createDataFrame(rows, "row long, col long, value double"), dense


def test_qmr_and_lanczos_against_dense_algebra(spark):
    a, dense = _system(spark, [4.0, -3.0, 2.0, -5.0, 1.0], 0.5)
    b = spark.createDataFrame([(i, float(i + 1)) for i in range(5)], "idx long, value double")
    got = {r["idx"]: r["value"] for r in krylov.symmetric_qmr(a, b).collect()}
    assert np.allclose([got[i] for i in range(5)], np.linalg.solve(dense, np.arange(1.0, 6.0)), atol=1e-8)
    t = krylov.lanczos(a, b, 5)
    form = np.diag([x for x, _ in t]) + np.diag([y for _, y in t[:-1]], 1) + np.diag([y for _, y in t[:-1]], -1)
    assert np.allclose(np.linalg.eigvalsh(form), np.linalg.eigvalsh(dense), atol=1e-6)
    zero = b.withColumn("value", F.lit(0.0))
    assert krylov.lanczos(a, zero, 3) == [] and {r["value"] for r in krylov.symmetric_qmr(a, zero).collect()} == {0.0}


def test_projection_leaves_no_flow_and_takes_a_gradient(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (5, 5)], "i long, j long")
    faces = spark.createDataFrame([(0, 0, 0, 2.0), (1, 0, 1, -3.0), (0, 5, 5, 4.0), (0, 9, 9, 7.0)], "axis int, i long, j long, value double")
    out = simulation.project(faces, cells)
    assert all(abs(r["value"]) < 1e-8 for r in simulation.divergence(out, cells).collect())
    got = {(r["axis"], r["i"], r["j"]): r["value"] for r in out.collect()}
    assert got[0, 9, 9] == 7.0  # no cell beside it
    assert abs(got[0, 5, 5] - 3.0) < 1e-8 and all(abs(got[k] + 1.0) < 1e-8 or abs(got[k] - 1.0) < 1e-8 for k in ((0, 6, 5), (1, 5, 5), (1, 5, 6)))


def test_distance_extrapolation_and_particles_on_small_grids(spark):
    line = spark.createDataFrame([(i, 0, 1.0 if i > 3 else -1.0) for i in range(8)], "i long, j long, value double")
    got = {r["i"]: r["distance"] for r in simulation.signed_distance(line, 2).collect()}
    assert got == {0: None, 1: -2.5, 2: -1.5, 3: -0.5, 4: 0.5, 5: 1.5, 6: 2.5, 7: None}
    known = spark.createDataFrame([(0, 0, 2.0), (1, 0, None), (2, 0, None), (3, 0, None)], "i long, j long, value double")
    assert {r["i"]: r["value"] for r in simulation.extrapolate(known, 2).collect()} == {0: 2.0, 1: 2.0, 2: 2.0, 3: None}
    grid = spark.createDataFrame([(0, 0, 1.0, 0.0), (1, 0, 0.0, -2.0)], "i long, j long, u double, v double")
    assert simulation.time_step(grid) == 0.25 and simulation.time_step(grid.limit(0)) is None
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 7.0, 7.0)], "id long, x double, y double")
    still, steps = simulation.frame(grid.selectExpr("i", "j", "1D AS value", "0D AS u", "0D AS v"), 1.0)
    assert steps == 1 and {r["value"] for r in still.collect()} == {1.0}
    seeded = simulation.reseed_particles(points, grid, 2).collect()
    assert sorted((int(r["x"]), int(r["y"]), r["fresh"]) for r in seeded) == [(0, 0, False), (0, 0, True), (1, 0, False), (1, 0, True), (7, 7, False)]
    assert {r["id"]: r["removed"] for r in simulation.remove_particles(points, grid.selectExpr("i", "j", "i AS distance"), 0.5).collect()} == {1: False, 2: True, 3: True}
    assert [tuple(r) for r in simulation.step_particles(points, grid, 1.0).collect()] == [(1, 1.5, 0.5)]


def test_axis_clusters_partitions_and_local_grids(spark):
    spans = [(i, i * 37 % 101, i * 37 % 101 + 1 + i % 3) for i in range(40)]
    want, end = {}, None
    for k, low, high in sorted(spans, key=lambda s: (s[1], s[0])):
        if end is None or low >= end:
            start = low
        want[k], end = start, max(end or high, high)
    for width in (1, 7, 1000):
        got = spatial.axis_clusters(spark.createDataFrame(spans, "id long, low long, high long"), width)
        assert {r["id"]: r["cluster"] for r in got.collect()} == want
    a, _ = _system(spark, [1.0] * 6, 1.0)
    got = spatial.matrix_partition(a, 3).collect()
    assert {(r["part"], r["kind"], r["idx"], r["local"]) for r in got} == {(0, 0, 0, 0), (0, 0, 1, 1), (0, 1, 2, 2), (0, 2, 3, 3), (1, 0, 4, 0), (1, 0, 5, 1), (1, 1, 3, 2), (1, 2, 2, 3)}
    grid = spark.createDataFrame([(i, j, float(i * j)) for i in range(4) for j in range(4)], "i long, j long, value double")
    block = spatial.local_grid(grid, (1, 1), (3, 3))
    assert {(r["i"], r["j"]) for r in block.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    again = spatial.put_local(grid, block.withColumn("value", F.col("value") + 2), (1, 1))
    assert again.count() == 16 and spatial.max_error(grid, again).first()[0] == 2.0
    assert spatial.max_error(grid, grid.limit(0)).first()[0] is None


def test_points_of_low_discrepancy_and_densities(spark):
    rows = spark.range(63).select(*(numeric.sobol(F.col("id"), k).alias(f"x{k}") for k in range(4))).collect()
    # by hand: the numbers of x + 1 are 1, 3, 5, 15, ..., and each point flips that of its predecessor's lowest zero bit
    assert [r["x0"] for r in rows[:4]] == [0.5, 0.25, 0.75, 0.375] and [r["x1"] for r in rows[:4]] == [0.5, 0.75, 0.25, 0.625]
    for k in range(4):
        assert sorted(int(r[k] * 64) for r in rows) == list(range(1, 64))  # one in each cell, the origin left out
    assert len({(int(r[0] * 8), int(r[1] * 8)) for r in rows}) == 63
    u = spark.range(100).select((F.col("id") / 100).alias("u"))
    got = [r[0] for r in u.select(numeric.piecewise_density(F.col("u"), [0.0, 1.0, 2.0, 4.0], [1.0, 0.0, 3.0])).collect()]
    assert sum(v < 1 for v in got) == 25 and not any(1 < v < 2 for v in got) and max(got) < 4
    cube = spark.createDataFrame([(1, [float(k * k % 11) for k in range(24)])], "id long, v array<double>")
    want = np.fft.fftn(np.array([float(k * k % 11) for k in range(24)]).reshape(2, 3, 4)).ravel()
    got = sorted((r.k, r.re, r.im) for r in numeric.fourier(cube, "id", "v", (2, 3, 4)).collect())
    assert np.allclose([complex(x, y) for _, x, y in got], want)


def test_a_stream_gives_each_repeated_event_once(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 00:0{m}:00", m % 3) for m in range(9)], "ts string, kind int").selectExpr("ts::timestamp AS ts", "kind")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["kind"], "1 hour")
    run = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r["kind"] for r in spark.table("firsts").collect()) == [0, 1, 2] == sorted(r["kind"] for r in first_seen(df, "ts", ["kind"], "1 hour").collect())


def test_search_and_chain_without_a_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(80, 3), (200, 201)], "src long, dst long")
    got = {r["id"]: r["level"] for r in graph.bfs(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {i: i for i in range(81)}
    needs = edges.selectExpr("src AS job", "dst AS needs")
    asked = spark.createDataFrame([(0, 6), (0, 7), (0, 200), (9, 2), (80, 80), (5, 5)], "job long, other long")
    near = {(r.job, r.other): r.is_before for r in graph.ancestors(needs, asked, 6).collect()}
    assert near == {(0, 6): True, (0, 7): False, (0, 200): False, (9, 2): False, (80, 80): False, (5, 5): False}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "job long, needs long")
    far = {(r.job, r.other): r.is_before for r in graph.ancestors(loop, spark.createDataFrame([(1, 1), (1, 3), (1, 9)], "job long, other long")).collect()}
    assert far == {(1, 1): True, (1, 3): True, (1, 9): False}


def test_solvers_say_when_they_do_not_end(spark):
    a, dense = _system(spark, [2.0] * 30, -1.0)
    b = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(30)], "idx long, value double")
    for solve in (learning.conjugate_gradient, learning.conjugate_residual, krylov.symmetric_qmr):
        with pytest.raises(ArithmeticError):
            solve(a, b, limit=3)
    got = {r["idx"]: r["value"] for r in learning.conjugate_gradient(a, b).collect()}
    assert np.allclose([got[i] for i in range(30)], np.linalg.solve(dense, [1.0 + i % 3 for i in range(30)]), atol=1e-7)
    grid = spark.createDataFrame([(0, 0, 1.0, 0.5, 0.0)], "i long, j long, value double, u double, v double")
    with pytest.raises(ArithmeticError):
        simulation.frame(grid, 100.0, limit=2)


def test_distance_of_a_circle(spark):
    """On a distance already the result is the distance, in the band and near enough for a grid."""
    cells = [(i, j, ((i - 10.3) ** 2 + (j - 9.6) ** 2) ** 0.5 - 5.2) for i in range(21) for j in range(21)]
    got = simulation.signed_distance(spark.createDataFrame(cells, "i long, j long, value double"), 3).collect()
    want = {(i, j): v for i, j, v in cells}
    known = [r for r in got if r["distance"] is not None]
    assert len(known) > 150 and max(abs(r["distance"] - want[r["i"], r["j"]]) for r in known) < 0.35  # of first order
    assert all(abs(want[r["i"], r["j"]]) > 3 for r in got if r["distance"] is None)


def test_water_frame(spark):
    cells = [(i, j, ((i - 5.5) ** 2 + (j - 5.5) ** 2) ** 0.5 - 3.0, 0.0, 0.0) for i in range(12) for j in range(12)]
    grid = spark.createDataFrame(cells, "i long, j long, value double, u double, v double")
    drops = spark.createDataFrame([(1, 5.5, 5.5), (2, 11.9, 0.1)], "id long, x double, y double")
    out, particles, steps = simulation.water_frame(grid, drops, 0.4, force=-1.0, band=2, least=1)
    rows = out.collect()
    assert steps >= 1 and len(rows) == 144 and all(np.isfinite([r.value, r.u, r.v]).all() for r in rows)
    wet = [r for r in rows if r.value < 0]
    assert 15 < len(wet) < 60 and np.mean([r.v for r in wet]) < 0.05
    in_water = {(int(r.x), int(r.y)) for r in particles.collect()}
    assert {(r.i, r.j) for r in wet} <= in_water | {(r.i, r.j) for r in wet if abs(r.value) < 1e-9}


def test_flood_fill_and_tree_of_points(spark):
    picture = ["aab", "bab", "bba"]
    cells = spark.createDataFrame([(i, j, c) for i, row in enumerate(picture) for j, c in enumerate(row)], "i long, j long, colour string")
    got = {(r.i, r.j): (r.i0, r.j0) for r in graph.flood(cells).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 0), (1, 1): (0, 0), (0, 2): (0, 2), (1, 2): (0, 2), (1, 0): (1, 0), (2, 0): (1, 0), (2, 1): (1, 0), (2, 2): (2, 2)}
    points = spark.createDataFrame([(k, float(k * 37 % 64), float(k * 11 % 64)) for k in range(64)], "id long, x double, y double")
    leaves = spatial.kd_cells(points, 3).groupBy("cell").count().collect()
    assert len(leaves) == 8 and {r["count"] for r in leaves} == {8}


def _estimated(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_estimated_sizes_stay_small_over_rounds(spark):
    """A snake of one region takes many rounds; each would square the estimated size several times, in the driver."""
    snake = [(i, j) for i in range(0, 16, 2) for j in range(8)] + [(i, 7 * (i // 2 % 2 == 0)) for i in range(1, 15, 2)]
    out = graph.flood(spark.createDataFrame([(i, j, 1) for i, j in snake], "i long, j long, colour int"))
    assert {(r.i, r.j, r.i0, r.j0) for r in out.collect()} == {(i, j, 0, 0) for i, j in snake}
    assert _estimated(out) < 2**64
    now = spark.range(20).selectExpr("id", "id AS x")
    for _ in range(6):
        now = settle(now.join(now.select("id", F.col("x").alias("y")), "id").select("id", F.col("y").alias("x")))
    assert _estimated(now) < 2**64 and sorted(map(tuple, now.collect())) == [(k, k) for k in range(20)]
    assert _estimated(settle(spark.range(20))) == 160  # a size that is no more than unknown stays


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_difference_of_cells_sends_no_side_to_the_driver(spark):
    """The size of cells is estimated from that of their boxes, far too low for large ones."""
    schema = "id long, x long, y long, dx long, dy long"
    boxes = spark.createDataFrame([(1, 0, 0, 4, 2), (2, 2, 1, 4, 2), (3, -5, -5, 1, 1)], schema)
    remove = spark.createDataFrame([(4, 1, 0, 2, 3), (5, 2, 0, 1, 3), (6, 50, 50, 1, 1)], schema)
    area = lambda *boxes: {(i, j) for x, y, dx, dy in boxes for i in range(x, x + dx) for j in range(y, y + dy)}
    want = area((0, 0, 4, 2), (2, 1, 4, 2), (-5, -5, 1, 1)) - area((1, 0, 2, 3), (2, 0, 1, 3))
    out = regions.difference_cells(boxes, remove)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Broadcast" not in _plan(catalog.QUERIES["u5_difference_cells"](spark, "/root/testdata/sf0.001"))


def test_near_pairs_send_no_points_to_the_driver(spark):
    points = [(k, k * 37 % 50 - 25, k * 11 % 40 - 20) for k in range(90)] + [(90, -25, -20), (91, 4, 0), (92, 0, 0)]
    df = spark.createDataFrame(points, "id long, x long, y long")
    got = sorted(tuple(r) for r in spatial.near_pairs(df, df, 4.0).select("a", "b", "square").collect())
    want = sorted((a, b, s) for a, ax, ay in points for b, bx, by in points if (s := (ax - bx) ** 2 + (ay - by) ** 2) <= 16)
    assert got == want and (91, 92, 16) in got
    for name in ("v8_near_points", "v9_in_spheres"):
        assert "Broadcast" not in _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_job_states_stop_at_a_wrong_event(spark):
    log = [(1, 0, "recv", 100), (1, 1, "recv", 101), (1, 2, "unblock_io", 100), (1, 3, "dispatch", 100), (1, 3, "run", 7), (1, 5, "run", 100), (1, 6, "fin", 7), (1, 7, "run", 101), (1, 8, "fin", 100), (1, 9, "recv", 102)]
    df = spark.createDataFrame(log, "worker long, ts long, event string, job long")
    got = sorted(tuple(r) for r in jobs.state_levels(df, 10, 4).collect())
    assert got == [(1, -1, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 1, 0, 0), (1, 1, 0, 0, 0, 2, 0, 0), (1, 2, 0, 0, 0, 1, 0, 1), (1, 3, 1, 0, 1, 1, 0, 0), (1, 5, 0, 1, 1, 1, 0, 0)]  # 101 runs without dispatch; stamp 6 is the last


def test_lineages_and_appends(spark):
    line = spark.createDataFrame([(1, 10, 100, 1), (1, 11, 101, 2), (1, 12, 102, 3)], "object long, job long, version long, depth long")
    entry = spark.createDataFrame([(1, 9, 99, 2)], "object long, job long, version long, depth long")
    assert sorted((r.depth, r.job) for r in versions.lineage_insert(line, entry).collect()) == [(1, 10), (2, 9), (3, 11), (4, 12)]
    upto = spark.createDataFrame([(1, 101)], "object long, version long")
    assert sorted(r.job for r in versions.lineage_clean(line, upto).collect()) == [11, 12]
    before = spark.createDataFrame([(50, 1, 10), (50, 1, 11), (51, 1, 12), (52, 1, None)], "reader long, object long, job long")
    assert {r.reader: r.version for r in versions.lineage_as_of(line, before).collect()} == {50: 101, 51: 102, 52: None}
    rows = [("a", 1, "append", "x"), ("a", 2, "clear", ""), ("a", 3, "append", "y"), ("a", 4, "append", "z"), ("a", 5, "commit", ""), ("a", 6, "append", "lost"), ("b", 1, "append", "q")]
    assert [tuple(r) for r in versions.committed(spark.createDataFrame(rows, "key string, seq int, kind string, data string")).collect()] == [("a", "yz")]


def test_a_sketch_never_denies_its_own(spark):
    keys = spark.range(300).selectExpr("cast(id * 7 as string) AS key")
    sketch = sets.Bloom(300)
    got = {r.key: r.may for r in sketch.probe(spark.range(2000).selectExpr("cast(id as string) AS key"), sketch.build(keys)).collect()}
    assert sketch.probes == 6 and all(got[str(k)] for k in range(0, 2000, 7)) and sum(got.values()) < 286 + 100
    assert sets.Bloom(1, 1).probes == 1 and sets.Bloom(1, 99).probes == 30


def test_jobs_by_name_and_prototypes(spark):
    app = extension.Application()
    app.register("twice", extension._Double())
    with pytest.raises(ValueError):
        app.register("twice", extension._Double())
    out = app.run([("twice", ["a"], "a"), ("twice", ["a"], "b")], a=spark.createDataFrame([(1, 3)], "k long, v long"))
    assert out["a"].first()["v"] == 6 and out["b"].first()["v"] == 12
    made = []
    pool = extension.Prototypes()
    pool.register("p", lambda region: made.append(region) or {"at": region})
    assert pool.get("p", (1,)) is pool.get("p", (1,)) and made == [(1,)]
    rows = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, v double")
    assert {r.k: r.v for r in extension.reduced(rows, "k", "v", lambda x, y: x + y, 0.0).collect()} == {"a": 6.0, "b": 2.0}


def test_numbers_of_rows_and_checksums(spark):
    df = spark.range(500).selectExpr("id", "id * 7919 % 503 AS x")
    got = {r.x: r.place for r in numbered(df, ["x"], "place").collect()}
    assert [got[x] for x in sorted(got)] == list(range(500))
    check = spark.createDataFrame([("123456789",), ("",)], "t string").select(arrays.crc32c(F.col("t"))).collect()
    assert [r[0] for r in check] == [0xE3069283, 0]
    row = spark.createDataFrame([(1.0, -6.0, 11.0, -6.0)], "a double, b double, c double, d double")
    assert np.allclose(row.select(numeric.cubic_roots(row.a, row.b, row.c, row.d)).first()[0], [1, 2, 3])
    v = spark.createDataFrame([([3.0, -4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = v.select(arrays.normalized(v.a).alias("a"), arrays.normalized(v.b).alias("b"), arrays.most_at(v.a).alias("m"), arrays.rotated(v.a, 1).alias("r")).first()
    assert (r.a, r.b, r.m, r.r) == ([0.6, -0.8], [1.0, 0.0], 1, [-4.0, 3.0])


def test_region_dependencies_by_reverse_scan(spark):
    """Against one that goes back job by job and takes away what it has found."""
    rows = [(k, k % 2, k * 7 % 5, k * 3 % 4, 1 + k % 3, 1 + k % 2, k % 3 != 0, k % 3 != 1) for k in range(40)]
    df = spark.createDataFrame(rows, "job long, object long, x long, y long, dx long, dy long, reads boolean, writes boolean")
    cells = lambda r: {(i, j) for i in range(r[2], r[2] + r[4]) for j in range(r[3], r[3] + r[5])}
    want = set()
    for r in rows:
        read, write = cells(r) if r[6] else set(), cells(r) if r[7] else set()
        for e in reversed([e for e in rows if e[1] == r[1] and e[0] < r[0]]):
            if e[7] and (read | write) & cells(e):
                want.add((r[0], e[0]))
            if e[6] and write & cells(e):
                want.add((r[0], e[0]))
            if e[7]:
                read, write = read - cells(e), write - cells(e)
    assert {tuple(r) for r in versions.region_dependencies(df).collect()} == want


def test_text_sources(spark, tmp_path):
    (tmp_path / "articles").write_text("# names\nb c\na\n\n")
    (tmp_path / "links").write_text("a\tb c\nb c\ta\na\tnowhere\n")
    assert sorted((r.src, r.dst) for r in texts.read_tsv_graph(spark, str(tmp_path / "articles"), str(tmp_path / "links")).collect()) == [(0, 1), (1, 0)]
    (tmp_path / "regions").write_text("# flags\nRegW3 : (40, 40, 40), (1, 2, 1), (3, 3, 3) : central, outer\n\n")
    r = texts.read_regions(spark, str(tmp_path / "regions")).first()
    assert (r.name, r.domain, r.parts, r.ghost, r.flags) == ("RegW3", [40] * 3, [1, 2, 1], [3] * 3, ["central", "outer"])
    (tmp_path / "logs").mkdir()
    for rank in (1, 12):
        (tmp_path / "logs" / f"{rank}_event_be.txt").write_text(f"line of {rank}\n")
    (tmp_path / "logs" / "notes.txt").write_text("none\n")
    assert sorted(map(tuple, texts.read_by_rank(spark, str(tmp_path / "logs"), "{}_event_be.txt").collect())) == [(1, "line of 1"), (12, "line of 12")]
    (tmp_path / "edges").write_text("1 2\n3 4\n")
    (tmp_path / "number").write_text("17\n")
    assert sorted(map(tuple, files.read_edges(spark, str(tmp_path / "edges")).collect())) == [(1, 2), (3, 4)] and files.read_number(spark, str(tmp_path / "number")) == 17
    files.write_frame(spark.range(3), str(tmp_path / "frames"), 4)
    assert spark.read.parquet(str(tmp_path / "frames")).where("frame = 4").count() == 3


def test_a_stream_of_sessions(spark, tmp_path):
    at = ["00:00", "00:05", "00:30", "02:00", "09:00"]
    df = spark.createDataFrame([(f"2024-01-01 {t}:00", "a") for t in at], "ts string, kind string").selectExpr("ts::timestamp AS ts", "kind")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["kind"], "30 minutes", "10 minutes")
    run = stream.writeStream.format("memory").queryName("spells").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = sorted(r["n"] for r in spark.table("spells").collect())
    assert got == [1, 3]  # the last one is still open
    assert sorted(r["n"] for r in sessions(df, "ts", ["kind"], "30 minutes", "10 minutes").collect()) == [1, 1, 3]


def test_a_stream_keeps_the_state_of_its_keys(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02}:00", m % 3, float(m)) for m in range(12)]
    df = spark.createDataFrame(rows, "ts string, kind long, value double").selectExpr("ts::timestamp AS ts", "kind", "value")
    for part in ("minute(ts) >= 6", "minute(ts) < 6"):  # the later half comes first
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = tracked(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "kind", "ts", "value")
    run = stream.writeStream.format("memory").queryName("keys").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    seen = {}
    for r in spark.table("keys").collect():
        seen[r.kind] = max(seen.get(r.kind, (0,)), (r.n, r.total, r.last))
    want = {r.kind: (r.n, r.total, r.last) for r in tracked(df, "kind", "ts", "value").collect()}
    assert seen == want == {k: (4, sum(v for _, x, v in rows if x == k), float(9 + k)) for k in range(3)}


def test_an_application_starts_by_name(spark):
    got = extension.entry(spark, ["p4_out_of_range", "/root/testdata/sf0.001"])
    assert got.columns == ["p_partkey"] and got.count() > 0
