import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeway.grid import DIRS, GridSpec, tesselate
from galeway.operators import distance, graph, pairwise, particles, paths, rose, walk
from galeway.sources import fixtures as fx
from galeway.sources import series as src
from galeway.streaming import rose as stream

G = GridSpec(4, 5, 0.0, 5.0, 10.0, 14.0)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(c, t, *rng.normal(0, 5, 2)) for c in range(1, 21) for t in range(6)], columns=["cell", "step", "u", "v"])
    return src.WindSeries.from_long(spark.createDataFrame(pdf), G)


@pytest.fixture(scope="module")
def small_rose(small):
    df = small.rose().df.cache()
    return rose.WindRose(df, G)


def test_loadings_share_out_the_weights(small):
    load = rose.loadings(small.df, G).toPandas().set_index("cell")
    want = small.df.groupBy("cell").agg(F.sum(F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)).alias("w")).toPandas().set_index("cell").w
    assert np.allclose(load[list(DIRS)].sum(axis=1).sort_index(), want.sort_index())


def test_wide_orders_agree(spark, small):
    n = 6
    pdf = small.df.toPandas()
    u, v = (pdf.pivot(index="cell", columns="step", values=c).sort_index() for c in "uv")
    a = pd.DataFrame({"cell": u.index} | {f"a{i}": u[i].to_numpy() for i in range(n)} | {f"b{i}": v[i].to_numpy() for i in range(n)})
    b = pd.DataFrame({"cell": u.index} | {f"{k}{i}": z[i].to_numpy() for i in range(n) for k, z in (("a", u), ("b", v))})
    rows = [sorted(map(tuple, src.WindSeries.from_wide(spark.createDataFrame(x), G, o).df.select("cell", "step", "u", "v").collect())) for x, o in ((a, "uuvv"), (b, "uvuv"))]
    assert rows[0] == rows[1] == sorted(map(tuple, small.df.select("cell", "step", "u", "v").collect()))
    with pytest.raises(ValueError):
        src.WindSeries.from_wide(spark.createDataFrame(a), G, "vuvu")


def test_null_wind(spark):
    df = G.with_coords(spark.createDataFrame([(1, 0, 3.0, 4.0), (1, 1, None, 4.0)], "cell long, step int, u double, v double"))
    assert rose.loadings(df, G).first()["NE"] is None
    kept = rose.loadings(df, G, skip_null=True).first()
    assert kept["n_obs"] == 1 and abs(sum(kept[d] for d in DIRS) - 5) < 1e-9


def test_upwind_is_the_transpose(small_rose):
    key = lambda df: {(r.src, r.dst): round(r.conductance, 9) for r in df.collect()}
    assert key(graph.wind_graph(small_rose, "upwind")) == key(graph.transpose(graph.wind_graph(small_rose)))


def test_path_strategies_agree(spark, small_rose):
    e = graph.wind_graph(small_rose)
    starts = spark.createDataFrame([(1, 1), (7, 7), (7, 12)], "source long, cell long")
    a, b = ({(r.source, r.cell): round(r.d, 9) for r in paths.accumulate(e, starts, s).collect()} for s in ("kernel", "relational"))
    assert a == b and a[7, 12] == 0


def test_unreached_cells_are_infinite(spark):
    e = spark.createDataFrame([(1, 2, 5, 1.0, 1.0)], "src long, dst long, k int, conductance double, cost double")
    z = {r.cell: r.z for r in paths.least_cost_surface(e, G, spark.createDataFrame([(1.5, 13.5)], "x double, y double")).collect()}
    assert z == {1: float("inf"), 2: 0.0}


def test_walk_strategies_agree_and_lose_mass_at_edges_only(spark, small_rose):
    init = spark.createDataFrame([(2.5, 12.5), (2.6, 12.4)], "x double, y double")
    for mode in ("pulse", "ratchet"):
        a, b = (walk.random_walk(small_rose, init, 3, [0, 1, 3], mode, strategy=s).df.toPandas().set_index(["iter", "cell"]).mass.sort_index() for s in ("kernel", "relational"))
        assert np.allclose(a, b)
    assert a[0].sum() == 1 and abs(walk.random_walk(small_rose, init, 1).df.agg(F.sum("mass")).first()[0] - 1) < 1e-9
    for bad in (dict(timescale=0), dict(mode="feed"), dict(record=[9])):
        with pytest.raises(ValueError):
            walk.random_walk(small_rose, init, 3, **bad)


def test_downscale_near_keeps_block_means(small_rose):
    fine = small_rose.downscale(2, "near").df.groupBy(F.ceil(F.col("row") / 2).alias("row"), F.ceil(F.col("col") / 2).alias("col")).agg(F.avg("N").alias("n"))
    a, b = (x.toPandas().sort_values(["row", "col"]).iloc[:, -1].to_numpy() for x in (fine, small_rose.df.select("row", "col", "N")))
    assert np.allclose(a / 2, b)
    with pytest.raises(ValueError):
        small_rose.downscale(0)


def test_refine_is_the_join_form(small_rose):
    pdf = small_rose.df.toPandas()
    dense = np.zeros((4, 5, 8))
    dense[pdf.row - 1, pdf.col - 1] = pdf[list(DIRS)]
    fine = small_rose.downscale(3).df.toPandas()
    assert np.allclose(paths.refine(dense, 3, "bilinear")[fine.row - 1, fine.col - 1], fine[list(DIRS)])


def test_weight_and_guard(spark, small_rose):
    w = small_rose.weight(spark.createDataFrame([(1, 0.5)], "cell long, w double")).df
    assert w.where("N is not null").count() == 1
    with pytest.raises(TypeError):
        small_rose.geo_correction()


def test_particles(spark, small):
    field = small.field(0)
    start = particles.geo_grid(spark, G, 12)
    a = particles.particle_flow(field.df, G, start, 5, 0.02).toPandas()
    b = particles.relational_flow(field.df, G, start, 5, 0.02, ["downwind", "upwind"]).toPandas()
    key = lambda d: d.sort_values(["p", "t"])[["p", "t", "x", "y", "v"]].to_numpy(float)
    assert np.allclose(key(a), key(b)) and a.duplicated(["p", "t"]).sum() == 0
    w = particles.particle_flow(field.df, G, start, 30, 0.1, wrap="both").toPandas()
    assert len(w) == 61 * start.count() and w[(w.t.abs() < 30)].x.between(0, 5).all()
    assert particles.trails_to_wkt(particles.particle_flow(field.df, G, start, 2, 0.0)).where("wkt like 'LINESTRING M%'").count() == start.count()


@pytest.mark.parametrize("o", [dict(wrap="both"), dict(wrap="horizontal", ignore_speed=True), dict(wrap="vertical", metric="true"), dict(ignore_speed=True, metric="true")])
def test_flow_forms_agree_for_all_options(spark, small, monkeypatch, o):
    field, start = small.field(0).df, particles.geo_grid(spark, G, 12)
    wraps, scale = "wrap" in o, 0.9 if o.get("ignore_speed") else 0.2
    a = particles.particle_flow(field, G, start, 3, scale, direction="downwind" if wraps else "upwind", **o).toPandas()
    monkeypatch.setattr(particles, "FIELD_CELLS", 1)
    b = particles.particle_flow(field, G, start, 3, scale, direction="downwind" if wraps else "upwind", **o).toPandas()
    key = lambda d: d.sort_values(["p", "t"])[["p", "t", "x", "y", "v", "g"]].to_numpy(float)
    assert key(a).shape == key(b).shape and np.allclose(key(a), key(b))
    assert not wraps or (a.g != a.p).any()


@pytest.mark.parametrize("o", [dict(), dict(equalarea=False), dict(sample="grid"), dict(sample="grid", equalarea=False)])
def test_samplers_stay_inside(spark, o):
    p = particles.generate_particles(spark, fx.GRID, 300, **o).toPandas()
    assert len(p) > 100 and p.x.between(-106, -94).all() and p.y.between(35, 45).all()


def test_mantel_of_a_matrix_with_itself(spark):
    x = fx.formula_pairs(spark)
    one, perm = pairwise.mantel_test(x, x, nperm=19)
    r = one.first()
    assert abs(r["stat"] - 1) < 1e-9 and r["quantile"] == 1 and perm.count() == 19
    assert pairwise.mantel_test(x, x, nperm=9, method="kendall")[0].first()["stat"] == pytest.approx(1)
    assert {(-round(r.value, 9), r.j, r.i) for r in pairwise.pairwise_ratios(x).collect()} == {(round(r.value, 9), r.i, r.j) for r in pairwise.pairwise_ratios(x).collect()}
    with pytest.raises(ValueError):
        pairwise.mantel_test(x, x, method="x")


def test_vrcd_replaces_close_pairs_only(spark, sf):
    r = rose.wind_rose(fx.series(spark, sf), fx.GRID)
    v = paths.vrcd(r, fx.sites(spark, sf), threshold_km=100, max_nodes=900).toPandas()
    close = (v.point_dist <= 100) & (v.i != v.j)
    assert close.any() and (v[~close].wind_dist == v[~close].wind_dist_coarse).all() and (v[close].wind_dist != v[close].wind_dist_coarse).any()


def test_vrcd_is_the_join_form_on_each_window(spark, sf):
    r = rose.wind_rose(fx.series(spark, sf), fx.GRID)
    v = {(x.i, x.j): x for x in paths.vrcd(r, fx.sites(spark, sf), threshold_km=100, max_nodes=900).collect()}
    at = {x.site: (x.x, x.y) for x in fx.sites(spark, sf).collect()}
    close = sorted(k for k, x in v.items() if k[0] > k[1] and x.point_dist <= 100)
    for i, j in close[:2]:
        (x1, y1), (x2, y2) = at[i], at[j]
        span = max(abs(x1 - x2), abs(y1 - y2))
        box = lambda m: (min(x1, x2) - m, max(x1, x2) + m, min(y1, y2) - m, max(y1, y2) + m)
        part = r.crop(*box(max(span, 2 * fx.GRID.yres)))
        fine = part.downscale(max(1, int((900 / part.grid.ncell) ** 0.5)))
        fine = fine.crop(*box(max(span, 2 * fine.grid.yres)))
        pts = spark.createDataFrame([(i, x1, y1), (j, x2, y2)], "site int, x double, y double")
        d = {(x.i, x.j): x.value for x in paths.least_cost_distance(graph.wind_graph(fine), fine.grid, pts, adjust=False, strategy="relational").collect()}
        c = {(x.i, x.j): x.value for x in distance.cell_distance(fine.grid, pts).collect()}
        for k in ((i, j), (j, i)):
            assert v[k].wind_dist == pytest.approx(d[k]) and v[k].cell_dist == pytest.approx(c[k])


def test_close_sites_outside_the_grid_keep_coarse_values(spark, sf):
    r = rose.wind_rose(fx.series(spark, sf), fx.GRID)
    pts = spark.createDataFrame([(1, -105.9, 40.2), (2, -106.2, 40.2)], "site int, x double, y double")
    rows = {(x.i, x.j): x for x in paths.vrcd(r, pts, threshold_km=100, max_nodes=900).collect()}
    assert rows[1, 2].wind_dist == rows[1, 2].wind_dist_coarse and rows[1, 2].cell_dist == rows[1, 2].cell_dist_coarse


def test_least_costs_are_those_of_a_plain_search():
    import heapq

    rng = np.random.default_rng(4)
    n, m = 60, 240
    src_, dst, cost = rng.integers(0, n, m), rng.integers(0, n, m), rng.exponential(1.0, m) ** 3
    for start in range(0, n, 7):
        best, heap = {}, [(0.0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in best:
                best[v] = d
                heap += [(d + c, w) for a, w, c in zip(src_, dst, cost, strict=True) if a == v]
                heapq.heapify(heap)
        got = paths.Graph(n, src_, dst, cost).least([start])
        assert np.allclose(got, [best.get(v, np.inf) for v in range(n)])


def test_equal_area_grid_is_brute_force(spark):
    from galeway.functions import geo

    g, n = fx.GRID, 300
    nx, ny = particles.grid_shape(g, n)
    lon, lat = np.meshgrid(g.xmin + (np.arange(nx) + 0.5) * (g.xmax - g.xmin) / nx, g.ymin + (np.arange(ny) + 0.5) * (g.ymax - g.ymin) / ny)
    pts = np.stack(geo.np_equal_earth(lon.ravel(), lat.ravel()), 1)
    lo, hi = pts.min(0), pts.max(0)
    pad = (hi - lo) / 8
    mx, my = particles.grid_shape(GridSpec(1, 1, lo[0] - pad[0], hi[0] + pad[0], lo[1] - pad[1], hi[1] + pad[1]), n)
    u, v = np.meshgrid(lo[0] - pad[0] + (np.arange(mx) + 0.5) * (hi[0] - lo[0] + 2 * pad[0]) / mx, lo[1] - pad[1] + (np.arange(my) + 0.5) * (hi[1] - lo[1] + 2 * pad[1]) / my)
    turn = np.radians(np.arange(0, 360, 0.05))
    way = np.stack([np.cos(turn), np.sin(turn)])
    reach = (pts @ way).max(0)  # a point is in the hull if it is beyond all points in no direction
    inside = ((np.stack([u.ravel(), v.ravel()], 1) @ way) <= reach + 1.0).all(1)
    x, y = geo.np_equal_earth_inverse(u.ravel()[inside], v.ravel()[inside])
    got = particles.generate_particles(spark, g, n, sample="grid").orderBy("p").toPandas()
    assert np.allclose(got.x, x) and np.allclose(got.y, y) and 100 < len(got) < mx * my


def test_ranks_are_means_of_ties(spark):
    v = [3.0, 1.0, 3.0, -2.0, 8.0, 3.0, 1.0]
    got = pairwise.average_rank(spark.createDataFrame(list(enumerate(v)), "i int, a double").repartition(3), "a").toPandas().sort_values("i").a
    assert list(got) == list(pd.Series(v).rank())


def test_running_loads_add_up(small):
    parts = [rose.loadings(small.df.where(w), G) for w in ("step < 2", "step >= 2")]
    a, b = (x.toPandas().set_index("cell").sort_index()[["n_obs", *DIRS]] for x in (stream.running(*parts), rose.loadings(small.df, G)))
    assert np.allclose(a, b)


def test_tesselate_needs_a_globe(spark):
    with pytest.raises(ValueError):
        tesselate(G.cells(spark), G)


def test_stream_is_batch(spark, sf, tmp_path):
    s = fx.series(spark, sf).where("cell <= 12")
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.windowed(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), fx.GRID).writeStream.format("memory").queryName("roses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.cell, round(r.N, 9)) for r in df.select("start", "cell", "N").collect())
    assert key(spark.table("roses")) == key(stream.windowed(s, fx.GRID))
