"""Queries over the derived fixtures, one or more for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.functions import geo
from galeway.grid import DIRS, STEPS, merge, tesselate
from galeway.operators import distance, graph, pairwise, particles, paths, rose, summary, walk
from galeway.sources import fixtures as fx
from galeway.sources import series as src
from galeway.streaming import rose as stream

G = fx.GRID
ORIGIN_CELL, ORIGIN = 66, (-100.5, 39.5)
ROUNDS, STEPS_N = 40, 12


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in the last digits with the order of rows."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c, t in df.dtypes if t == "double"})


def _rose(spark: SparkSession, d: str, trans=1, **options) -> rose.WindRose:
    return rose.wind_rose(fx.series(spark, d, **options), G, trans)


def _edges(spark: SparkSession, d: str, direction: str = "downwind", wrap: bool = False, **options) -> DataFrame:
    return graph.wind_graph(_rose(spark, d, **options), direction, wrap)


def _origin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([ORIGIN], "x double, y double")


def _threshold(s):
    return F.when(s < 5, 0.0).otherwise(s)


def wind_speed_direction(s, d):
    u, v = F.col("u"), F.col("v")
    df = fx.series(s, d, calm=True)
    return rounded(df.select("cell", "step", geo.speed(u, v).alias("speed"), geo.direction(u, v).alias("direction"), geo.spin90(geo.direction(u, v)).alias("spun"), geo.bearing_to(u, v).alias("bearing")))


def edge_loadings(s, d):
    return rounded(rose.loadings(fx.series(s, d), G, 1).select("cell", "n_obs", *DIRS), 4)


def _rose_query(trans, **options):
    return lambda s, d: rounded(_rose(s, d, trans, **options).df.select("cell", "row", "col", "x", "y", *DIRS))


def wind_field_speed(s, d):
    return rounded(fx.series(s, d).where("step = 0").select("cell", geo.speed(F.col("u"), F.col("v")).alias("speed")))


def aspect_by_latitude(s, d):
    return rounded(s.range(-80, 81).select(F.col("id").alias("lat"), geo.aspect(F.col("id").cast("double")).alias("aspect")))


def weight_conductance(s, d):
    return rounded(_rose(s, d).weight(fx.weights(s, d)).df.select("cell", *DIRS))


def _downscale(method):
    return lambda s, d: rounded(_rose(s, d).downscale(3, method).df.select("cell", "row", "col", *DIRS))


def crop_window(s, d):
    df, new = G.crop(_rose(s, d).df, -104.2, -98.7, 37.1, 42.4)
    return rounded(df.select("cell", "row", "col", "x", "y", "N"))


def tesselate_globe(s, d):
    df, _ = tesselate(fx.globe(s), fx.GLOBE, 20)
    return rounded(df.select("cell", "row", "col", "x", "y", "z"))


def _graph_query(direction, wrap=False, **options):
    return lambda s, d: rounded(_edges(s, d, direction, wrap, **options))


def wind_graph_transposed(s, d):
    return rounded(graph.transpose(_edges(s, d, "downwind")))


def _surface(sites, rate=False, **options):
    return lambda s, d: rounded(paths.least_cost_surface(_edges(s, d, **options), G, sites(s, d), rate).select("cell", "row", "col", "z"))


def _distance(adjust, rate):
    return lambda s, d: rounded(paths.least_cost_distance(_edges(s, d), G, fx.sites(s, d), adjust, rate))


def rw_max_step(s, d):
    return rounded(s.createDataFrame([(walk.rw_max_step(_rose(s, d)),)], "hours double"))


def rw_prob(s, d):
    r = _rose(s, d)
    return rounded(walk.rw_prob(r, walk.rw_max_step(r) / 2).drop("row", "col"))


def _walk(mode, timescale=1.0, init=None, **options):
    def run(s, d):
        start = _origin(s) if init is None else init(s, d)
        return rounded(walk.random_walk(_rose(s, d, **options), start, STEPS_N, [0, 4, STEPS_N], mode, timescale).df.select("iter", "cell", "mass"))

    return run


def cell_lookup(s, d):
    cell, row, col = G.lookup(F.col("x"), F.col("y"))
    return fx.sites(s, d).select("site", cell.alias("cell"), row.alias("row"), col.alias("col"))


def bilinear_sample(s, d):
    return rounded(rose.sample(fx.sites(s, d), fx.series(s, d).where("step = 0"), G, ["site"], ["u", "v"]).select("site", "u", "v"))


def point_distance(s, d):
    return rounded(distance.point_distance(fx.sites(s, d)))


def point_distance_haversine(s, d):
    return rounded(distance.point_distance(fx.sites(s, d), "haversine"))


def cell_distance(s, d):
    return rounded(distance.cell_distance(G, fx.sites(s, d)))


def cell_distance_ratios(s, d):
    return rounded(distance.check_cell_distance(G, fx.sites(s, d))[0])


def cell_distance_report(s, d):
    return rounded(distance.check_cell_distance(G, fx.sites(s, d))[1].where("lo is not null").select((F.col("lo") + 0.0).alias("lo"), F.when(F.col("hi") < 1e300, F.col("hi")).alias("hi"), "n", "percent"))


def pairwise_means(s, d):
    return rounded(pairwise.pairwise_means(fx.formula_pairs(s)))


def pairwise_ratios(s, d):
    return rounded(pairwise.pairwise_ratios(fx.formula_pairs(s)))


def pairwise_ratios_flows(s, d):
    return rounded(pairwise.pairwise_ratios(fx.flows(s, d), log=False))


def pairwise_ratios_vector(s, d):
    return rounded(pairwise.pairwise_ratios(fx.nodes(s, d)))


def _mantel(method="pearson", controls=0, nperm=99, perm=False, alternative="two.sided"):
    def run(s, d):
        z = [fx.formula_pairs(s, 13 + n, 29, 89) for n in range(controls)]
        one, each = pairwise.mantel_test(fx.formula_pairs(s), fx.formula_pairs(s, 11, 23, 83), z, nperm, method, alternative)
        return rounded(each if perm else one)

    return run


def circ_sd(s, d):
    df = fx.series(s, d).select("cell", geo.bearing_to(F.col("u"), F.col("v")).alias("b"), geo.speed(F.col("u"), F.col("v")).alias("w"))
    return rounded(summary.circ_sd(df, "b", "w", ("cell",)))


def _summary(radius=None):
    def run(s, d):
        surface = paths.least_cost_surface(_edges(s, d), G, _origin(s), rate=True)
        return rounded(summary.ws_summarize(surface, G, ORIGIN, radius), 5)

    return run


def geo_grid(s, d):
    return rounded(particles.geo_grid(s, G, 30))


def _flow(**options):
    def run(s, d):
        field = fx.series(s, d).where("step = 0")
        return rounded(particles.particle_flow(field, G, particles.geo_grid(s, G, 30), 20, 0.1, **options))

    return run


def trails(s, d):
    t = _flow(direction="downwind")(s, d).select("p", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "t")
    return particles.trails_to_wkt(t)


def _particles(**options):
    return lambda s, d: rounded(particles.generate_particles(s, G, 200, **options))


def vrcd(s, d):
    return paths.vrcd(_rose(s, d), fx.sites(s, d), threshold_km=120, max_nodes=2500)


def rose_by_day(s, d):
    df = stream.windowed(fx.series(s, d), G)
    return rounded(df.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "cell", *DIRS))


def flow_pairs(s, d):
    return rounded(fx.flows(s, d))


def iter_length(s, d):
    w = walk.random_walk(_rose(s, d), _origin(s), 2, 2, "pulse", 0.5)
    return rounded(s.createDataFrame([(walk.iter_length(w),)], "hours double"))


def wind_graph_edge_fn(s, d):
    return rounded(graph.wind_graph(_rose(s, d), edge_fn=lambda a, b, k: F.least(a, b)))


def _layers(s, d, steps: int) -> DataFrame:
    at = lambda c, k: F.max(F.when(F.col("step") == k, F.col(c))).alias(f"{c}{k}")
    return fx.series(s, d).where(F.col("step") < steps).groupBy("cell").agg(*(at(c, k) for c in "uv" for k in range(steps)))


def series_wide(s, d):
    return rounded(src.WindSeries.from_wide(_layers(s, d, 3), G).df.select("cell", "row", "col", "x", "y", F.col("step").cast("long").alias("step"), "u", "v"))


def series_stack(s, d):
    df = fx.series(s, d).withColumn("step", F.col("step").cast("int"))
    a, b = (src.WindSeries(df.where(F.col("step").isin(*k)).select(*src.SERIES), G) for k in ((0, 1), (3, 4)))
    return rounded(a.stack(b).df.select("cell", "step", "u", "v"))


def merge_grids(s, d):
    field = fx.series(s, d, holes=True).where("step = 0").select("cell", "row", "col", "u", "v")
    west, gw = G.crop(field, -106, -99, 35, 45)
    east, ge = G.crop(fx.series(s, d).where("step = 1"), -101, -94, 37, 45)
    return rounded(merge(west, gw, east, ge, ["u", "v"])[0].select("cell", "row", "col", "x", "y", "u", "v"))


def grid_shift(s, d):
    cell, row, col = G.shift(360).lookup(F.col("x") + 360, F.col("y"))
    return fx.sites(s, d).select("site", cell.alias("cell"), row.alias("row"), col.alias("col"))


QUERIES = {
    "wind_speed_direction": wind_speed_direction, "edge_loadings": edge_loadings,
    "wind_rose_trans1": _rose_query(1), "wind_rose_trans0": _rose_query(0, calm=True), "wind_rose_trans2": _rose_query(2), "wind_rose_trans3": _rose_query(3),
    "wind_rose_threshold": _rose_query(_threshold), "wind_field": wind_field_speed, "aspect_by_latitude": aspect_by_latitude,
    "weight_conductance": weight_conductance, "downscale_near": _downscale("near"), "downscale_bilinear": _downscale("bilinear"), "crop": crop_window,
    "tesselate": tesselate_globe, "wind_graph_down": _graph_query("downwind"), "wind_graph_up": _graph_query("upwind"), "wind_graph_wrap": _graph_query("downwind", True),
    "wind_graph_holes": _graph_query("downwind", holes=True), "wind_graph_transposed": wind_graph_transposed,
    "least_cost_surface": _surface(lambda s, d: _origin(s)), "least_cost_surface_multi": _surface(fx.sites), "least_cost_surface_rate": _surface(lambda s, d: _origin(s), True),
    "least_cost_surface_holes": _surface(lambda s, d: _origin(s), holes=True),
    "least_cost_distance": _distance(False, False), "least_cost_distance_adjust": _distance(True, False), "least_cost_distance_rate": _distance(True, True),
    "rw_max_step": rw_max_step, "rw_prob": rw_prob, "random_walk_pulse": _walk("pulse"), "random_walk_ratchet": _walk("ratchet"), "random_walk_half": _walk("pulse", 0.5, fx.sites),
    "random_walk_holes": _walk("pulse", holes=True),
    "cell_lookup": cell_lookup, "bilinear_sample": bilinear_sample, "point_distance": point_distance, "point_distance_haversine": point_distance_haversine,
    "cell_distance": cell_distance, "cell_distance_ratios": cell_distance_ratios, "cell_distance_report": cell_distance_report,
    "flow_pairs": flow_pairs, "pairwise_means": pairwise_means, "pairwise_ratios": pairwise_ratios, "pairwise_ratios_flows": pairwise_ratios_flows, "pairwise_ratios_vector": pairwise_ratios_vector,
    "mantel_simple": _mantel(), "mantel_less": _mantel(alternative="less"), "mantel_greater": _mantel(alternative="greater"), "mantel_permutations": _mantel(perm=True), "mantel_partial1": _mantel(controls=1), "mantel_partial2": _mantel(controls=2),
    "mantel_spearman": _mantel("spearman"), "mantel_kendall": _mantel("kendall", nperm=9),
    "circ_sd": circ_sd, "ws_summarize": _summary(), "ws_summarize_radius": _summary(400.0),
    "geo_grid": geo_grid, "particle_flow": _flow(), "particle_flow_wrap": _flow(wrap="both", direction="downwind"), "particle_flow_ignore_speed": _flow(ignore_speed=True, direction="upwind"),
    "particle_flow_true": _flow(metric="true", direction="downwind"), "trails": trails,
    "generate_particles_random": _particles(), "generate_particles_plain": _particles(equalarea=False), "generate_particles_grid": _particles(sample="grid"),
    "vrcd": vrcd, "rose_by_day": rose_by_day, "iter_length": iter_length, "wind_graph_edge_fn": wind_graph_edge_fn,
    "series_wide": series_wide, "series_stack": series_stack, "merge_grids": merge_grids, "grid_shift": grid_shift,
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel times from a site: series, rose, graph, surface."""
    return QUERIES["least_cost_surface"](spark, sf_dir)


# --- SQL -------------------------------------------------------------------

def _vincenty(src: str, name: str = "vd") -> str:
    """CTEs: i, j, km, azimuth of the rows i, j, x1, y1, x2, y2 of src."""
    f = repr(geo.FLAT)
    inner = f"""(SELECT *, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS c FROM
 (SELECT *, 1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * s1 * s2 / (1 - sa * sa) END AS c2m FROM
 (SELECT *, atan2(ss, cs) AS sig, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM
 (SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM {name}_it WHERE {{0}}))))"""
    return f"""{name}_0 AS (SELECT i, j, x1, y1, x2, y2, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, radians(x2 - x1) AS l FROM
  (SELECT *, atan((1 - {f}) * tan(radians(y1))) AS u1, atan((1 - {f}) * tan(radians(y2))) AS u2 FROM {src})),
{name}_it(i, j, same, s1, c1, s2, c2, l, lam, n) AS (SELECT i, j, x1 = x2 AND y1 = y2, s1, c1, s2, c2, l, l, 0 FROM {name}_0
  UNION ALL SELECT i, j, same, s1, c1, s2, c2, l, l + (1 - c) * {f} * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))), n + 1 FROM {inner.format("n < 12")}),
{name}_k AS (SELECT *, ca2 * {(geo.A**2 - geo.B**2) / geo.B**2!r} AS q FROM {inner.format("n = 12")}),
{name}_ab AS (SELECT *, 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768)) AS k1, q / 1024 * (256 + q * (q * (74 - 47 * q) - 128)) AS k2 FROM {name}_k),
{name} AS (SELECT i, j, CASE WHEN same THEN 0 ELSE {geo.B!r} * k1 * (sig - k2 * ss * (c2m + k2 / 4 * (cs * (2 * c2m * c2m - 1) - k2 / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) / 1000 END AS km,
  CASE WHEN NOT same THEN degrees(atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam))) END AS azimuth FROM {name}_ab)"""


_GEOMETRY = f"""grows AS (SELECT r AS row, 45 - r + 0.5::DOUBLE AS lat FROM range(1, 11) t(r)),
gsrc AS (SELECT row AS i, k AS j, 0.0::DOUBLE AS x1, lat AS y1, dx::DOUBLE AS x2, lat + dy AS y2 FROM grows, (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1)) n(k, dx, dy)),
{_vincenty("gsrc", "gd")}, grhumb AS (SELECT i, j, (degrees(atan2(radians(x2 - x1), ln(tan(radians(y2) / 2 + pi() / 4)) - ln(tan(radians(y1) / 2 + pi() / 4)))) + 360) % 360 AS b FROM gsrc),
geo AS (SELECT i::INT AS row, max(CASE WHEN j = 1 THEN b END) AS b_ne, max(CASE WHEN j = 3 THEN b END) AS b_se, {", ".join(f"max(CASE WHEN j = {k} THEN km * 1000 END) AS {d}" for k, d in enumerate(("d_n", "d_ne", "d_e", "d_se", "d_s")))} FROM gd JOIN grhumb USING (i, j) GROUP BY i)"""
_METRES = dict(zip(DIRS, ("d_se", "d_e", "d_ne", "d_n", "d_ne", "d_e", "d_se", "d_s"), strict=True))
_R = ", ".join(f'round("{k}", 6) AS "{k}"' for k in DIRS)


def _series(calm: bool = False, holes: bool = False) -> str:
    u, v = "(k - 49.5) / 5", "(value - 50) / 10"
    if calm:
        u, v = (f"CASE WHEN k % 10 = 0 THEN 0.0 ELSE {x} END" for x in (u, v))
    return f"""ev AS (SELECT event_id, ts, value::DOUBLE AS value, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_id < (SELECT count(*) // 120 * 120 FROM events)),
series AS (SELECT (event_id % 120)::BIGINT + 1 AS cell, event_id // 120 AS step, (event_id % 120 // 12)::INT + 1 AS row, (event_id % 12)::INT + 1 AS col,
  -106 + (event_id % 12) + 0.5::DOUBLE AS x, 45 - (event_id % 120 // 12) - 0.5::DOUBLE AS y, ts, ({u})::DOUBLE AS u, ({v})::DOUBLE AS v
  FROM ev{" WHERE (event_id % 120 + 1) % 17 <> 0" if holes else ""})"""


def _loads(w: str, by: str = "cell, row, col, x, y") -> str:
    sums = ", ".join(f'sum(CASE WHEN sec = {k} THEN (1 - f) * wgt WHEN (sec + 1) % 8 = {k} THEN f * wgt ELSE 0 END) AS "{d}"' for d, k in rose.SECTOR.items())
    return f"""o1 AS (SELECT *, {w} AS wgt, CASE WHEN u = 0 AND v = 0 THEN 90 WHEN degrees(atan2(u, v)) <= 0 THEN degrees(atan2(u, v)) + 360 ELSE degrees(atan2(u, v)) END AS th,
  [0, b_ne, 90, b_se, 180, 360 - b_se, 270, 360 - b_ne, 360] AS bs FROM series JOIN geo USING (row)),
o2 AS (SELECT *, len(list_filter(bs, lambda b: th > b)) - 1 AS sec FROM o1),
o3 AS (SELECT *, (th - bs[sec + 1]) / (bs[sec + 2] - bs[sec + 1]) AS f FROM o2),
loads AS (SELECT {by}, count(*) AS n_obs, {sums} FROM o3 GROUP BY {by})"""


_SPEED = "sqrt(u * u + v * v)"
_ROSE = "rose AS (SELECT l.* EXCLUDE (n_obs, " + ", ".join(f'"{d}"' for d in DIRS) + "), " + ", ".join(f'"{d}" * 3600 / {m} / n_obs AS "{d}"' for d, m in _METRES.items()) + " FROM loads l JOIN geo USING (row))"


def _roses(w: str = _SPEED, **options) -> str:
    return f"WITH RECURSIVE {_GEOMETRY}, {_series(**options)}, {_loads(w)}, {_ROSE}"


_LONG = "dirs(k, dr, dc) AS (VALUES " + ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate(STEPS)) + "), long AS (SELECT cell, row, col, i - 1 AS k, cs[i] AS c FROM (SELECT cell, row, col, [" + ", ".join(f'"{d}"' for d in DIRS) + "] AS cs, unnest(range(1, 9)) AS i FROM rose))"


def _graph(direction: str = "downwind", wrap: bool = False, **options) -> str:
    k = "a.k" if direction == "downwind" else "(a.k + 4) % 8"
    col = "b.col = a.col + dc" if not wrap else "b.col = (a.col + dc + 11) % 12 + 1"
    return f"""{_roses(**options)}, {_LONG}, edges AS (
  SELECT a.cell AS src, b.cell AS dst, d.k, (a.c + b.c) / 2 AS conductance, 2 / (a.c + b.c) AS cost
  FROM long a JOIN dirs d ON d.k = {k} JOIN long b ON b.k = a.k AND b.row = a.row + dr AND {col} WHERE a.c + b.c > 0)"""


_OUT_ROSE = f"SELECT cell, row, col, x, y, {_R} FROM rose"
_OUT_EDGES = "SELECT src, dst, k::INT AS k, round(conductance, 6) AS conductance, round(cost, 6) AS cost FROM edges"
_SITES = "sites AS (SELECT n_nationkey::INT AS site, -106.0 + (n_nationkey * 7 % 25 * 12 / 25.0 + 0.25) AS x, 35.0 + (n_nationkey * 11 % 25 * 10 / 25.0 + 0.25) AS y FROM nation), placed AS (SELECT *, floor(x + 106)::INT + 1 AS col, floor(45 - y)::INT + 1 AS row, (floor(45 - y)::INT * 12 + floor(x + 106)::INT + 1)::BIGINT AS cell FROM (SELECT site, x::DOUBLE AS x, y::DOUBLE AS y FROM sites))"
_LOOPS = "loops AS (SELECT src, dst, cost FROM edges UNION ALL SELECT DISTINCT src, src, 0.0 FROM edges)"


def _reach(starts: str) -> str:
    return f"""{_LOOPS}, dist(n, source, cell, d) AS (
  SELECT 0, source, cell, 0.0::DOUBLE FROM ({starts})
  UNION ALL SELECT n + 1, source, dst, min(d + cost) FROM dist JOIN loops ON src = cell WHERE n < {ROUNDS} GROUP BY n, source, dst)"""


def _surface_sql(starts: str, rate: bool = False, more: str = "", **options) -> str:
    z = "CASE WHEN d = 0 THEN 'Infinity'::DOUBLE ELSE 1 / d END" if rate else "d"
    return f"""{_graph(**options)}{more}, {_reach(starts)}
SELECT cell, ((cell - 1) // 12 + 1)::INT AS row, ((cell - 1) % 12 + 1)::INT AS col, round({z}, 6) AS z
FROM (SELECT c.cell, coalesce(d, 'Infinity'::DOUBLE) AS d FROM (SELECT DISTINCT src AS cell FROM edges) c LEFT JOIN dist ON dist.cell = c.cell AND n = {ROUNDS})"""


_PP = "pp AS (SELECT a.site AS i, b.site AS j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM placed a, placed b)"
_CC = "cc AS (SELECT a.site AS i, b.site AS j, -106 + a.col - 0.5::DOUBLE AS x1, 45 - a.row + 0.5::DOUBLE AS y1, -106 + b.col - 0.5::DOUBLE AS x2, 45 - b.row + 0.5::DOUBLE AS y2 FROM placed a, placed b)"
_BOTH = f"{_SITES}, {_PP}, {_CC}, {_vincenty('pp', 'pd')}, {_vincenty('cc', 'cd')}"


def _distance_sql(adjust: bool, rate: bool) -> str:
    v = "CASE WHEN c.km > 0 THEN d * p.km / c.km END" if adjust else "d"
    if rate:
        v = f"CASE WHEN {v} = 0 THEN 'Infinity'::DOUBLE ELSE 1 / ({v}) END"
    return f"""{_graph()}, {_BOTH}, {_reach("SELECT DISTINCT cell AS source, cell FROM placed")}
SELECT a.site AS i, b.site AS j, round({v}, 6) AS value FROM placed a CROSS JOIN placed b
JOIN (SELECT source, cell, d FROM dist WHERE n = {ROUNDS}) d ON d.source = a.cell AND d.cell = b.cell
JOIN pd p ON p.i = a.site AND p.j = b.site JOIN cd c ON c.i = a.site AND c.j = b.site"""


_TOTAL = " + ".join(f'"{d}"' for d in DIRS)


def _walk_sql(ratchet: bool = False, timescale: float = 1.0, starts: str = f"SELECT {ORIGIN_CELL}::BIGINT AS cell", more: str = "", **options) -> str:
    new = "sum(mass * p)" if not ratchet else "greatest(sum(mass * p), coalesce(max(CASE WHEN src = dst THEN mass END), 0))"
    return f"""{_roses(**options)}, {_LONG}{more}, step AS (SELECT {timescale!r} / max({_TOTAL}) AS t FROM rose),
moves AS (SELECT cell AS src, cell AS dst, 1 - t * ({_TOTAL}) AS p FROM rose, step
  UNION ALL SELECT a.cell, b.cell, t * a.c FROM long a JOIN dirs USING (k) JOIN rose b ON b.row = a.row + dr AND b.col = a.col + dc, step),
m(n, cell, mass) AS (SELECT 0, cell, 1.0::DOUBLE FROM ({starts})
  UNION ALL SELECT n + 1, dst, {new} FROM m JOIN moves ON src = cell WHERE n < {STEPS_N} GROUP BY n, dst)
SELECT i.iter, r.cell, round(coalesce(mass, 0), 6) AS mass FROM (VALUES (0), (4), ({STEPS_N})) i(iter) CROSS JOIN rose r LEFT JOIN m ON m.n = i.iter AND m.cell = r.cell"""


def _corners(src: str, x: str = "x", y: str = "y", keep: str = "*") -> str:
    """Bilinear u, v of the rows of src at (x, y) inside the grid."""
    near = lambda r, c: f"f.row = greatest(1, least(10, {r})) AND f.col = greatest(1, least(12, {c}))"
    r0, c0 = f"floor(45 - {y} + 0.5)", f"floor({x} + 106 + 0.5)"
    wy, wx = f"(45 - {y} + 0.5 - {r0})", f"({x} + 106 + 0.5 - {c0})"
    parts = [(f"(1 - {wy}) * (1 - {wx})", r0, c0), (f"(1 - {wy}) * {wx}", r0, f"{c0} + 1"), (f"{wy} * (1 - {wx})", f"{r0} + 1", c0), (f"{wy} * {wx}", f"{r0} + 1", f"{c0} + 1")]
    joins = " ".join("JOIN field AS f{0} ON {1}".format(n, near(r, c).replace("f.", f"f{n}.")) for n, (_, r, c) in enumerate(parts))
    val = lambda z: " + ".join(f"{w} * f{n}.{z}" for n, (w, _, _) in enumerate(parts))
    return f"(SELECT {keep}, {val('u')} AS u, {val('v')} AS v FROM {src} q {joins} WHERE {x} BETWEEN -106 AND -94 AND {y} BETWEEN 35 AND 45)"


def _flow_sql(sign: int, wrap: bool = False, ignore: bool = False, true: bool = False, digits: int = 6) -> str:
    """Rows of one direction; the recursion keeps positions, the field is sampled in each step."""
    keep = "q.p, q.n, q.x, q.y, q.g"
    u, v = f"u * {sign}", f"v * {sign}"
    if ignore:
        u, v = (f"({k} / sqrt(u * u + v * v) * 0.1)" for k in (u, v))
    east = f"{u} * sqrt(cos(radians({v})) * cos(radians({v} + 1e-5)))" if not true else f"{u} / sqrt(cos(radians(y)) * cos(radians(y + 1e-5)))"
    move = f"SELECT p, n + 1 AS n, x + {east} * 0.1 AS x, y + {v} * 0.1 AS y, g FROM {_corners('pos', 'q.x', 'q.y', keep)} WHERE n < 20"
    if wrap:
        move = f"SELECT p, n, CASE WHEN n < 21 AND x < -106 THEN x + 12 WHEN x > -94 THEN x - 12 ELSE x END AS x, CASE WHEN y < 35 THEN y + 10 WHEN y > 45 THEN y - 10 ELSE y END AS y, g + {sign} * ((x < -106 OR x > -94)::INT + (y < 35 OR y > 45)::INT) AS g FROM ({move})"
    return f"""WITH RECURSIVE {_series()}, field AS (SELECT row, col, u, v FROM series WHERE step = 0),
pos(p, n, x, y, g) AS (SELECT i + 1, 0, -106 + (i % 6 + 0.5) * 2.0::DOUBLE, 35 + (i // 6 + 0.5) * 2.0::DOUBLE, 0 FROM range(30) t(i) UNION ALL {move}),
flow AS (SELECT p, round(x, {digits}) AS x, round(y, {digits}) AS y, round(sqrt(u * u + v * v), 6) AS v, round(p + g / 1000.0, 6)::DOUBLE AS g, (n * {sign})::INT AS t FROM {_corners('pos', 'q.x', 'q.y', keep)})"""


def _pairs(name: str, a: int = 31, b: int = 17, m: int = 97) -> str:
    return f"{name} AS (SELECT i::INT AS i, j::INT AS j, 1 + ((i * {a} + j * {b} + i * j * 7) % {m}) / {m}.0::DOUBLE AS value FROM range(25) t(i), range(25) s(j))"


def _mantel_sql(kind: str = "pearson", alternative: str = "two.sided", perm: bool = False, nperm: int = 99) -> str:
    base = f"{_pairs('x')}, {_pairs('y', 11, 23, 83)}, {_pairs('z', 13, 29, 89)}, {_pairs('z2', 14, 29, 89)}, b0 AS (SELECT i, j, x.value AS a, y.value AS b, z.value AS z FROM x JOIN y USING (i, j) JOIN z USING (i, j) WHERE i <> j)"
    how = {
        "pearson": "b1 AS (SELECT i, j, a, b FROM b0)",
        "partial": "fit AS (SELECT regr_slope(a, z) AS sa, regr_intercept(a, z) AS ia, regr_slope(b, z) AS sb, regr_intercept(b, z) AS ib FROM b0), b1 AS (SELECT i, j, a - ia - sa * z AS a, b - ib - sb * z AS b FROM b0, fit)",
        "spearman": "b1 AS (SELECT i, j, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b FROM b0)",
        "kendall": "b1 AS (SELECT i, j, a, b FROM b0)",
        "partial2": f"""b2 AS (SELECT b0.i, b0.j, a, b, z, z2.value AS y2 FROM b0 JOIN z2 ON b0.i = z2.i AND b0.j = z2.j),
cs AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(z) AS mz, avg(y2) AS mw, var_pop(z) AS zz, var_pop(y2) AS ww, covar_pop(z, y2) AS zw, covar_pop(a, z) AS az, covar_pop(a, y2) AS aw, covar_pop(b, z) AS bz, covar_pop(b, y2) AS bw FROM b2),
b1 AS (SELECT i, j, {", ".join(f"{k} - m{k} - ({k}z * ww - {k}w * zw) / (zz * ww - zw * zw) * (z - mz) - ({k}w * zz - {k}z * zw) / (zz * ww - zw * zw) * (y2 - mw) AS {k}" for k in "ab")} FROM b2, cs)""",
    }[kind]
    perms = f"ps AS (SELECT p AS perm, i, row_number() OVER (PARTITION BY p ORDER BY md5(concat(p, ':', i))) - 1 AS pi FROM range(1, {nperm + 1}) t(p), range(25) s(i)), perms AS (SELECT perm, i, pi FROM ps)"
    moved = "moved AS (SELECT p.perm, b1.i, b1.j, r.a, b1.b FROM b1 JOIN perms p ON p.i = b1.i JOIN perms q ON q.perm = p.perm AND q.i = b1.j JOIN b1 r ON r.i = p.pi AND r.j = q.pi)"
    if kind == "kendall":
        tau = "sum(sign(m.a - o.a) * sign(m.b - o.b)) / sqrt(sum((m.a <> o.a)::INT) * sum((m.b <> o.b)::INT))"
        stats = f"stats AS (SELECT m.perm, {tau} AS stat FROM moved m JOIN moved o ON m.perm = o.perm GROUP BY m.perm), one AS (SELECT {tau} AS stat FROM b1 m, b1 o)"
    else:
        stats = "stats AS (SELECT perm, corr(a, b) AS stat FROM moved GROUP BY perm), one AS (SELECT corr(a, b) AS stat FROM b1)"
    value = {"two.sided": "(0.5 - abs(q - 0.5)) * 2", "less": "q", "greater": "1 - q"}[alternative]
    last = "SELECT perm, round(stat, 6) AS stat FROM stats" if perm else f"SELECT round(stat, 6) AS stat, round(q, 6) AS quantile, round({value}, 6) AS p_value FROM (SELECT one.stat, avg((stats.stat < one.stat - {pairwise.EPS!r})::INT) AS q FROM stats, one GROUP BY one.stat)"
    return f"WITH {base}, {how}, {perms}, {moved}, {stats} {last}"


def _summary_sql(radius: float | None = None) -> str:
    half = G.xres / 2
    w = lambda lat: float(geo.np_inverse(-half, lat, half, lat)[0]) / 1000
    widths = ", ".join(f"({r}, {w(G.latitude(r))!r}::DOUBLE)" for r in range(1, 11))
    d0, dy = w(0.0) / 2, w(ORIGIN[1]) / 2
    return f"""{_graph()}, {_reach(f"SELECT 0 AS source, {ORIGIN_CELL}::BIGINT AS cell")}, widths(row, wd) AS (VALUES {widths}),
cells AS (SELECT cell AS i, 0 AS j, {ORIGIN[0]}::DOUBLE AS x1, {ORIGIN[1]}::DOUBLE AS y1, -106 + (cell - 1) % 12 + 0.5::DOUBLE AS x2, 45 - (cell - 1) // 12 - 0.5::DOUBLE AS y2, 1 / d AS z, ((cell - 1) // 12 + 1)::INT AS row FROM dist WHERE n = {ROUNDS} AND d > 0),
{_vincenty("cells", "g")},
p AS (SELECT c.x2 AS x, c.y2 AS y, z, km, round_even(azimuth, 0) AS b, wd * CASE WHEN abs(c.y2 - {ORIGIN[1]}) < 0.5 THEN greatest(0, least(1, (abs(c.x2 - {ORIGIN[0]}) * {dy!r} / 0.5 - {d0 - dy!r}) / {2 * dy!r})) ELSE 1 END AS w
  FROM cells c JOIN g USING (i) JOIN widths USING (row){f" WHERE km < {radius}" if radius else ""}),
one AS (SELECT sum(x * z * w) / sum(z * w) AS cx, sum(y * z * w) / sum(z * w) AS cy, sum(km * z * w) / sum(z * w) AS wdist, sum(z * w * sin(radians(b))) / sum(CASE WHEN b IS NOT NULL THEN z * w END) AS sx,
  sum(z * w * cos(radians(b))) / sum(CASE WHEN b IS NOT NULL THEN z * w END) AS sy, sum(z * w) / sum(w) AS size, sum(CASE WHEN z > 0 THEN w ELSE 0 END) AS area FROM p),
cen AS (SELECT 0 AS i, 0 AS j, {ORIGIN[0]}::DOUBLE AS x1, {ORIGIN[1]}::DOUBLE AS y1, cx AS x2, cy AS y2 FROM one), {_vincenty("cen", "h")}
SELECT round(cx, 5) AS centroid_x, round(cy, 5) AS centroid_y, round(km, 5) AS centroid_distance, round(azimuth, 5) AS centroid_bearing, round(wdist, 5) AS windshed_distance,
  round(degrees(atan2(sx, sy)), 5) AS windshed_bearing, round(sqrt(1 - sqrt(sx * sx + sy * sy)), 5) AS windshed_isotropy, round(size, 5) AS windshed_size, round(area, 5) AS windshed_landarea FROM one, h"""


def _sampler_sql(equalarea: bool) -> str:
    u = lambda k: f"('0x' || substr(md5('1:{k}:' || i), 1, 13))::BIGINT / pow(2, 52)"
    y = f"degrees(asin(sin(radians(35)) + {u('y')} * (sin(radians(45)) - sin(radians(35)))))" if equalarea else f"35 + {u('y')} * 10"
    return f"SELECT i + 1 AS p, round(-106 + {u('x')} * 12, 6) AS x, round({y}, 6) AS y FROM range(200) t(i)"


_FINE = ", ".join(f'round(3 * ({{w}}), 6) AS "{d}"'.replace("{w}", " + ".join(f'{w} * f{n}."{d}"' for n, w in enumerate(("(1 - wy) * (1 - wx)", "(1 - wy) * wx", "wy * (1 - wx)", "wy * wx")))) for d in DIRS)
_HAV = "2 * 6378.137 * asin(least(1, sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))"
_DISC = "SELECT i, j, CASE WHEN c.km = 0 THEN 'Infinity'::DOUBLE ELSE exp(abs(ln(c.km / p.km))) - 1 END AS d FROM pd p JOIN cd c USING (i, j) WHERE i < j"
_FLOWS = "flows AS (SELECT c_nationkey AS i, s_nationkey AS j, (sum(l_extendedprice) / 1e6)::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"

ORACLE_SQL = {
    "wind_speed_direction": f"WITH {_series(calm=True)} SELECT cell, step, round({_SPEED}, 6) AS speed, round(degrees(atan2(u, v)), 6) AS direction, round(CASE WHEN degrees(atan2(u, v)) < -90 THEN degrees(atan2(u, v)) + 270 ELSE degrees(atan2(u, v)) - 90 END, 6) AS spun, round(CASE WHEN u = 0 AND v = 0 THEN 90 WHEN degrees(atan2(u, v)) <= 0 THEN degrees(atan2(u, v)) + 360 ELSE degrees(atan2(u, v)) END, 6) AS bearing FROM series",
    "edge_loadings": f"WITH RECURSIVE {_GEOMETRY}, {_series()}, {_loads(_SPEED)} SELECT cell, n_obs, " + ", ".join(f'round("{d}", 4) AS "{d}"' for d in DIRS) + " FROM loads",
    "wind_rose_trans1": f"{_roses()} {_OUT_ROSE}", "wind_rose_trans0": f"{_roses('1.0', calm=True)} {_OUT_ROSE}", "wind_rose_trans2": f"{_roses('(u * u + v * v)')} {_OUT_ROSE}",
    "wind_rose_trans3": f"{_roses('pow(sqrt(u * u + v * v), 3)')} {_OUT_ROSE}", "wind_rose_threshold": f"{_roses(f'CASE WHEN {_SPEED} < 5 THEN 0 ELSE {_SPEED} END')} {_OUT_ROSE}",
    "wind_field": f"WITH {_series()} SELECT cell, round({_SPEED}, 6) AS speed FROM series WHERE step = 0",
    "aspect_by_latitude": "SELECT lat, round(1 / sqrt(cos(radians(lat)) * cos(radians(lat + 1e-5))), 6) AS aspect FROM range(-80, 81) t(lat)",
    "weight_conductance": f"{_roses()} SELECT cell, " + ", ".join(f'round("{d}" * wt, 6) AS "{d}"' for d in DIRS) + " FROM rose LEFT JOIN (SELECT p_partkey + 1 AS cell, CASE WHEN p_size % 5 = 0 THEN 0.1 ELSE 1.0 END::DOUBLE AS wt FROM part WHERE p_partkey < 120) USING (cell)",
    "downscale_near": f"{_roses()} SELECT ((row - 1) * 3 + i - 1) * 36 + (col - 1) * 3 + j AS cell, ((row - 1) * 3 + i)::INT AS row, ((col - 1) * 3 + j)::INT AS col, " + ", ".join(f'round("{d}" * 3, 6) AS "{d}"' for d in DIRS) + " FROM rose, range(1, 4) a(i), range(1, 4) b(j)",
    "downscale_bilinear": f"{_roses()}, fine AS (SELECT r, c, floor((r - 0.5) / 3 + 0.5) AS r0, floor((c - 0.5) / 3 + 0.5) AS c0, (r - 0.5) / 3 + 0.5 - floor((r - 0.5) / 3 + 0.5) AS wy, (c - 0.5) / 3 + 0.5 - floor((c - 0.5) / 3 + 0.5) AS wx FROM range(1, 31) a(r), range(1, 37) b(c)) SELECT (r - 1) * 36 + c AS cell, r::INT AS row, c::INT AS col, {_FINE} FROM fine "
    + " ".join(f"JOIN rose f{n} ON f{n}.row = greatest(1, least(10, r0 + {n // 2})) AND f{n}.col = greatest(1, least(12, c0 + {n % 2}))" for n in range(4)),
    "crop": f'{_roses()} SELECT ((row - 4) * 5 + col - 2)::BIGINT AS cell, (row - 3)::INT AS row, (col - 2)::INT AS col, x, y, round("N", 6) AS "N" FROM rose WHERE row BETWEEN 4 AND 8 AND col BETWEEN 3 AND 7',
    "tesselate": "WITH g AS (SELECT c // 36 + 1 AS row, c % 36 + 1 AS col, ((c + 1) * 37 % 101) / 10.0 AS z FROM range(648) t(c)), w AS (SELECT row, col + 2 AS col, z FROM g UNION ALL SELECT row, col - 34, z FROM g WHERE col > 34 UNION ALL SELECT row, col + 38, z FROM g WHERE col <= 2) SELECT (row - 1) * 40 + col AS cell, row::INT AS row, col::INT AS col, (-200 + (col - 0.5) * 10)::DOUBLE AS x, (90 - (row - 0.5) * 10)::DOUBLE AS y, z::DOUBLE AS z FROM w",
    "wind_graph_down": f"{_graph()} {_OUT_EDGES}", "wind_graph_up": f"{_graph('upwind')} {_OUT_EDGES}", "wind_graph_wrap": f"{_graph(wrap=True)} {_OUT_EDGES}", "wind_graph_holes": f"{_graph(holes=True)} {_OUT_EDGES}", "wind_graph_transposed": f"{_graph('upwind')} {_OUT_EDGES}",
    "least_cost_surface": _surface_sql(f"SELECT 0 AS source, {ORIGIN_CELL}::BIGINT AS cell"), "least_cost_surface_rate": _surface_sql(f"SELECT 0 AS source, {ORIGIN_CELL}::BIGINT AS cell", True),
    "least_cost_surface_multi": _surface_sql("SELECT DISTINCT 0 AS source, cell FROM placed", more=f", {_SITES}"), "least_cost_surface_holes": _surface_sql(f"SELECT 0 AS source, {ORIGIN_CELL}::BIGINT AS cell", holes=True),
    "least_cost_distance": _distance_sql(False, False), "least_cost_distance_adjust": _distance_sql(True, False), "least_cost_distance_rate": _distance_sql(True, True),
    "rw_max_step": f"{_roses()} SELECT round(1 / max({_TOTAL}), 6) AS hours FROM rose",
    "rw_prob": f"{_roses()}, step AS (SELECT 0.5 / max({_TOTAL}) AS t FROM rose) SELECT cell, round(1 - t * ({_TOTAL}), 6) AS stay, " + ", ".join(f'round("{d}" * t, 6) AS "{d}"' for d in DIRS) + " FROM rose, step",
    "random_walk_pulse": _walk_sql(), "random_walk_ratchet": _walk_sql(True), "random_walk_half": _walk_sql(False, 0.5, "SELECT DISTINCT cell FROM placed", f", {_SITES}"), "random_walk_holes": _walk_sql(holes=True),
    "cell_lookup": f"WITH {_SITES} SELECT site, cell, row, col FROM placed",
    "bilinear_sample": f"WITH {_series()}, field AS (SELECT row, col, u, v FROM series WHERE step = 0), {_SITES} SELECT site, round(u, 6) AS u, round(v, 6) AS v FROM {_corners('placed', 'q.x', 'q.y', 'q.site')}",
    "point_distance": f"WITH RECURSIVE {_BOTH} SELECT i, j, round(km, 6) AS value FROM pd", "cell_distance": f"WITH RECURSIVE {_BOTH} SELECT i, j, round(km, 6) AS value FROM cd",
    "point_distance_haversine": f"WITH {_SITES}, {_PP} SELECT i, j, round({_HAV}, 6) AS value FROM pp",
    "cell_distance_ratios": f"WITH RECURSIVE {_BOTH} SELECT i, j, round(CASE WHEN p.km > 0 THEN c.km / p.km END, 6) AS cell_over_point FROM pd p JOIN cd c USING (i, j)",
    "cell_distance_report": f"WITH RECURSIVE {_BOTH}, disc AS ({_DISC}) SELECT lo::DOUBLE AS lo, CASE WHEN hi < 1e300 THEN hi END AS hi, count(d) AS n, round(100.0 * count(d) / (SELECT count(*) FROM disc), 6)::DOUBLE AS percent FROM (VALUES {', '.join(f'({a}, {b!r}::DOUBLE)' if b < 1e300 else f"({a}, 'Infinity'::DOUBLE)" for a, b in distance.BINS)}) t(lo, hi) LEFT JOIN disc ON d BETWEEN lo / 100 AND hi / 100 GROUP BY lo, hi",
    "flow_pairs": f"WITH {_FLOWS} SELECT i, j, round(value, 6) AS value FROM flows",
    "pairwise_means": f"WITH {_pairs('x')} SELECT a.i, a.j, round((a.value + b.value) / 2, 6) AS value FROM x a JOIN x b ON a.i = b.j AND a.j = b.i",
    "pairwise_ratios": f"WITH {_pairs('x')} SELECT a.i, a.j, round(ln(a.value / b.value), 6) AS value FROM x a JOIN x b ON a.i = b.j AND a.j = b.i",
    "pairwise_ratios_flows": f"WITH {_FLOWS} SELECT a.i, a.j, round(a.value / b.value, 6) AS value FROM flows a JOIN flows b ON a.i = b.j AND a.j = b.i",
    "pairwise_ratios_vector": "WITH n AS (SELECT c_nationkey AS i, avg(c_acctbal::DOUBLE) AS value FROM customer GROUP BY 1) SELECT a.i, b.i AS j, round(ln(a.value / b.value), 6) AS value FROM n a, n b",
    "mantel_simple": _mantel_sql(), "mantel_less": _mantel_sql(alternative="less"), "mantel_greater": _mantel_sql(alternative="greater"), "mantel_permutations": _mantel_sql(perm=True), "mantel_partial1": _mantel_sql("partial"), "mantel_partial2": _mantel_sql("partial2"), "mantel_spearman": _mantel_sql("spearman"), "mantel_kendall": _mantel_sql("kendall", nperm=9),
    "circ_sd": f"WITH {_series()}, o AS (SELECT cell, atan2(u, v) AS b, {_SPEED} AS w FROM series), m AS (SELECT cell, sum(w * sin(b)) / sum(w) AS x, sum(w * cos(b)) / sum(w) AS y FROM o GROUP BY cell) SELECT cell, round(degrees(atan2(x, y)), 6) AS bearing, round(sqrt(1 - sqrt(x * x + y * y)), 6) AS iso FROM m",
    "ws_summarize": _summary_sql(), "ws_summarize_radius": _summary_sql(400.0),
    "iter_length": f"{_roses()} SELECT round(0.5 / max({_TOTAL}), 6) AS hours FROM rose",
    "wind_graph_edge_fn": f"{_graph().replace('(a.c + b.c) / 2 AS', 'least(a.c, b.c) AS').replace('2 / (a.c + b.c) AS', '1 / least(a.c, b.c) AS').replace('WHERE a.c + b.c > 0', 'WHERE least(a.c, b.c) > 0')} {_OUT_EDGES}",
    "series_wide": f"WITH {_series()} SELECT cell, row, col, x, y, step, round(u, 6) AS u, round(v, 6) AS v FROM series WHERE step < 3",
    "series_stack": f"WITH {_series()} SELECT cell, (CASE WHEN step > 2 THEN step - 1 ELSE step END)::INT AS step, round(u, 6) AS u, round(v, 6) AS v FROM series WHERE step IN (0, 1, 3, 4)",
    "merge_grids": f"WITH {_series()} SELECT cell, row, col, x, y, round(CASE WHEN a.u IS NOT NULL THEN a.u ELSE b.u END, 6) AS u, round(CASE WHEN a.v IS NOT NULL THEN a.v ELSE b.v END, 6) AS v FROM (SELECT * FROM series WHERE step = 0) s LEFT JOIN (SELECT cell, u, v FROM series WHERE step = 0 AND col <= 7 AND cell % 17 <> 0) a USING (cell) LEFT JOIN (SELECT cell, u, v FROM series WHERE step = 1 AND col >= 6 AND row <= 8) b USING (cell) WHERE a.cell IS NOT NULL OR b.cell IS NOT NULL",
    "grid_shift": f"WITH {_SITES} SELECT site, cell, row, col FROM placed",
    "geo_grid": "SELECT i + 1 AS p, (-106 + (i % 6 + 0.5) * 2.0)::DOUBLE AS x, (35 + (i // 6 + 0.5) * 2.0)::DOUBLE AS y FROM range(30) t(i)",
    "trails": f"{_flow_sql(1)} SELECT p, CASE WHEN count(*) > 1 THEN 'LINESTRING M (' ELSE 'POINT M (' END || string_agg(concat_ws(' ', x, y, t), ', ' ORDER BY t) || ')' AS wkt FROM flow GROUP BY p",
    "generate_particles_random": _sampler_sql(True), "generate_particles_plain": _sampler_sql(False),
    "particle_flow_wrap": f"{_flow_sql(1, wrap=True)} SELECT * FROM flow", "particle_flow_ignore_speed": f"{_flow_sql(-1, ignore=True)} SELECT * FROM flow", "particle_flow_true": f"{_flow_sql(1, true=True)} SELECT * FROM flow",
    "particle_flow": f"SELECT * FROM ({_flow_sql(1)} SELECT * FROM flow) UNION ALL SELECT * FROM ({_flow_sql(-1)} SELECT * FROM flow) WHERE t <> 0",
}
ORACLE_SQL["rose_by_day"] = f"WITH RECURSIVE {_GEOMETRY}, s0 AS (SELECT 1), {_series().replace('series AS', 'base AS')}, series AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM base), {_loads(_SPEED, 'day, cell, row')}, {_ROSE} SELECT day, cell, {_R} FROM rose"
