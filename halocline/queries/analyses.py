"""Queries of forecasts at observations, local analyses, updates, diagnostics and point logs.

With one observation to a node the analysis has a closed form, which the SQL uses; with more, tests use numpy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as M
from ..operators import diag, hx, kernel, prep, spatial
from ..operators import update as up
from ..operators.grid import Layers
from .core import _ENS, _GOOD, _INN, _OBS, CENTRES, EDGES, MEMBERS, NI, NJ, NK, RADIUS, _decided, _ensemble, _good, _r, _taper_sql, _with_inn, _xyz_sql, grid, nodes, query

# fields: element (k, j, i) has the members of row ((k * 17 + j) * 36 + i) % N


def _fields(spark: SparkSession, d: str, shift: int = 0, var: str = "temp", layers: int = NK, times: tuple[int, ...] | None = None) -> DataFrame:
    ens = _ensemble(spark, d)
    size = ens.count()
    at = spark.range(layers * NJ * NI)
    n = F.col("id")
    cells = at.select((n % NI).cast("int").alias("i"), (F.floor(n / NI) % NJ).cast("int").alias("j"), F.floor(n / (NI * NJ)).cast("int").alias("k"), n.alias("element"))
    if times is not None:
        cells = cells.withColumn("t", F.explode(F.array(*[F.lit(t) for t in times])))
    moved = F.col("element") + shift + (F.col("t") * 7 if times is not None else 0)
    return cells.withColumn("n", F.pmod(moved, F.lit(size))).join(ens, "n").select(F.lit(var).alias("var"), "k", "j", "i", *(["t"] if times is not None else []), "e")


def _source(spark: SparkSession, d: str, fields: DataFrame, **more) -> hx.Source:
    return hx.Source(grid(spark), fields, MEMBERS, **more)


def _ends(out: DataFrame) -> DataFrame:
    """id, mean, first and last member of he."""
    return out.select("id", M.mean_of(F.col("he")).alias("mean"), F.col("he")[0].alias("first"), F.element_at("he", -1).alias("last"))


_FIELD = "ens AS (SELECT vec_id AS n, list_transform(embedding, lambda x: 48 + 200 * CAST(x AS DOUBLE)) AS e FROM embeddings), size AS (SELECT COUNT(*) AS total FROM embeddings)"
_MEMBERS = "mean, e[1] AS first, e[64] AS last"


def _at_corners(shift: str = "0", value: str = "{x}", join: str = "", member: str = "ens.e[{n}]", mean: str = "list_sum(ens.e) / 64") -> str:
    """id with mean, first and last member of the surface layer at good observations, from wet corners."""
    f = lambda x: value.format(x=x)
    return f"""{_GOOD}, {_FIELD}, met AS (SELECT c1.id, c1.wt, {mean} AS mean, {member.format(n=1)} AS first, {member.format(n=64)} AS last, c1.i, c1.j FROM c1 JOIN good USING (id) JOIN gn USING (i, j) JOIN size ON TRUE
 JOIN ens ON ens.n = (c1.j * 36 + c1.i + {shift}) % total {join} WHERE nl > 0 AND wt > 0)
 SELECT id, ROUND(SUM(wt * ({f('mean')})) / SUM(wt), 5) AS mean, ROUND(SUM(wt * ({f('first')})) / SUM(wt), 5) AS first, ROUND(SUM(wt * ({f('last')})) / SUM(wt), 5) AS last FROM met GROUP BY id"""


@query(_at_corners(value="{x} - (i + 2 * j) % 5"), digits=5)
def h_surface(spark, d):
    offset = nodes(spark).select("j", "i", ((F.col("i") + 2 * F.col("j")) % 5).cast("double").alias("offset"))
    s = _source(spark, d, _fields(spark, d), offset=offset)
    return _ends(hx.surface_standard(_good(spark, d), s, ["temp"]))


@query(_at_corners(join="JOIN ens b ON b.n = (c1.j * 36 + c1.i + 100) % total", member="ens.e[{n}] - b.e[{n}]", mean="(list_sum(ens.e) - list_sum(b.e)) / 64"), digits=5)
def h_surface_biased(spark, d):
    """Less each member's own bias field."""
    fields = _fields(spark, d).unionByName(_fields(spark, d, 100, "bias", 1))
    return _ends(hx.surface_biased(_good(spark, d), _source(spark, d, fields), ["temp", "bias"]))


@query(_at_corners(shift="7 * CAST(floor(time + 0.5) AS INT) + total * 100"), digits=5)
def h_asynchronous(spark, d):
    """Each observation meets the field of its own time slot."""
    obs = _good(spark, d).withColumn("t", M.slot(F.col("time"), 1.0))
    return _ends(hx.surface_standard(obs, _source(spark, d, _fields(spark, d, times=tuple(range(-5, 6)))), ["temp"]))


_DEEP = f"""{_GOOD}, {_FIELD}, z AS (SELECT id, GREATEST(0, LEAST(3, fk)) AS f FROM good), met AS (SELECT c1.id, c1.wt * CASE WHEN dk = 1 THEN f - floor(f) ELSE 1 - (f - floor(f)) END AS wt, e FROM c1 JOIN z USING (id) JOIN gn USING (i, j), (VALUES (0), (1)) k(dk), size, ens
 WHERE ens.n = ((CAST(floor(f) + dk AS INT) * 17 + c1.j) * 36 + c1.i) % total AND nl > floor(f) + dk)
 SELECT id, ROUND(SUM(wt * list_sum(e) / 64) / SUM(wt), 5) AS mean, ROUND(SUM(wt * e[1]) / SUM(wt), 5) AS first, ROUND(SUM(wt * e[64]) / SUM(wt), 5) AS last FROM met WHERE wt > 0 GROUP BY id"""


@query(_DEEP, digits=5)
def h_depth(spark, d):
    """Eight corners, of which those count that have water at their layer."""
    return _ends(hx.depth_standard(_good(spark, d), _source(spark, d, _fields(spark, d)), ["temp"]))


def _columns_sql(value: str) -> str:
    """A field of one layer made of column sums, at good observations."""
    return f"""{_GOOD}, {_FIELD}, col AS (SELECT j, i, {value} FROM (SELECT j, i, k, e FROM gn, range(4) t(k), size, ens WHERE n = ((k * 17 + j) * 36 + i) % total) GROUP BY j, i)
 SELECT c1.id, ROUND(SUM(wt * mean) / SUM(wt), 4) AS mean, ROUND(SUM(wt * first) / SUM(wt), 4) AS first, ROUND(SUM(wt * last) / SUM(wt), 4) AS last FROM c1 JOIN good USING (id) JOIN gn USING (i, j) JOIN col USING (i, j) WHERE nl > 0 AND wt > 0 GROUP BY c1.id"""


@query(_columns_sql("SUM(list_sum(e) / 64) AS mean, SUM(e[1]) AS first, SUM(e[64]) AS last"), digits=4)
def h_vertical_sum(spark, d):
    return _ends(hx.vertical_sum(_good(spark, d), _source(spark, d, _fields(spark, d)), ["temp"]))


_W = "(1 + k * 2.0::DOUBLE)"


@query(_columns_sql(f"SUM(list_sum(list_transform(e, lambda x: GREATEST(x, 0))) / 64 * {_W}) / 16 AS mean, SUM(GREATEST(e[1], 0) * {_W}) / 16 AS first, SUM(GREATEST(e[64], 0) * {_W}) / 16 AS last"), digits=4)
def h_vertical_mean(spark, d):
    """Weighted by a second variable; terms that are not positive don't count."""
    weights = _fields(spark, d).select(F.lit("w").alias("var"), "k", "j", "i", F.transform("e", lambda x: 1 + F.col("k") * 2.0).alias("e"))
    return _ends(hx.vertical_mean(_good(spark, d), _source(spark, d, _fields(spark, d).unionByName(weights)), ["temp", "w"]))


_MLD = f"""WITH {_OBS}, {_FIELD}, prof AS (SELECT gn.j, gn.i, nl, k, e[1] AS v, lag(e[1]) OVER w AS pv, first_value(e[1]) OVER w AS sv FROM gn, range(4) t(k), size, ens WHERE n = ((k * 17 + j) * 36 + i) % total AND k < nl WINDOW w AS (PARTITION BY gn.j, gn.i ORDER BY k)),
 crossed AS (SELECT j, i, any_value(nl) AS nl, MIN(CASE WHEN abs(v - sv) >= 25 THEN k END) AS k FROM prof GROUP BY j, i), f AS (SELECT c.j, c.i, CASE WHEN c.k IS NULL THEN c.nl - 1 ELSE c.k - 1 + (25 - abs(pv - sv)) / abs(v - pv) END AS fk FROM crossed c LEFT JOIN prof p ON p.j = c.j AND p.i = c.i AND p.k = c.k)"""
_FK2Z = "CASE WHEN g < 0.5 THEN [0.0, 50.0, 150.0, 450.0, 950.0][l + 1] + g * 2 * ([25.0, 100.0, 300.0, 700.0][l + 1] - [0.0, 50.0, 150.0, 450.0, 950.0][l + 1]) ELSE [25.0, 100.0, 300.0, 700.0][l + 1] + (g - 0.5) * 2 * ([50.0, 150.0, 450.0, 950.0][l + 1] - [25.0, 100.0, 300.0, 700.0][l + 1]) END"


@query(_MLD + f" SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, ROUND({_FK2Z}, 4) AS mld FROM (SELECT j, i, CAST(floor(fk + 0.5) AS INT) AS l, fk + 0.5 - floor(fk + 0.5) AS g FROM f)", digits=4)
def mixed_layer_depth(spark, d):
    """The depth at which the first member first differs from the surface; the deepest layer's where it never does."""
    return hx.mixed_layer(_source(spark, d, _fields(spark, d)), "temp", 25.0).select("j", "i", F.col("e")[0].alias("mld"))


@query(f"{_GOOD}, {_FIELD}, m AS (SELECT c1.id, SUM(wt * (20 + 3 * ((c1.i + c1.j) % 9))) / SUM(wt) AS mld, SUM(wt * b.e[1]) / SUM(wt) AS bias FROM c1 JOIN good USING (id) JOIN gn USING (i, j) JOIN size ON TRUE JOIN ens b ON b.n = (c1.j * 36 + c1.i + 100) % total WHERE nl > 0 AND wt > 0 GROUP BY c1.id) SELECT id, ROUND(CASE WHEN u < -1 THEN 1 WHEN u > 1 THEN 0 ELSE (cos((u + 1) * pi() / 2) + 1) / 2 END * bias, 4) AS taken FROM (SELECT id, bias, (depth / mld - 1) / 0.1 AS u FROM m JOIN good USING (id))", digits=4)
def h_depth_with_surface_bias(spark, d):
    """What the surface bias, as far as the mixed layer reaches, takes from the plain function."""
    mld = _fields(spark, d, 0, "mld", 1).withColumn("e", F.transform("e", lambda x: (20 + 3 * ((F.col("i") + F.col("j")) % 9)).cast("double")))
    s = _source(spark, d, _fields(spark, d).unionByName(_fields(spark, d, 100, "bias", 1)).unionByName(mld))
    obs = _good(spark, d)
    plain = hx.depth_standard(obs, s, ["temp"]).select("id", F.col("he")[0].alias("plain"))
    return hx.depth_with_surface_bias(obs, s, ["temp", "bias", "mld"]).join(plain, "id").select("id", (F.col("plain") - F.col("he")[0]).alias("taken"))


@query(f"""{_GOOD}, {_FIELD}, nd AS (SELECT j, i, {_xyz_sql('(5 + 10 * i)::DOUBLE', '(10 * j - 80)::DOUBLE', 'n')} FROM gn WHERE nl > 0), o AS (SELECT id, {_xyz_sql('lon', 'lat', '')} FROM good)
 SELECT o.id, COUNT(j) AS n, ROUND(AVG(list_sum(e) / 64), 5) AS mean, ROUND(AVG(e[1]), 5) AS first FROM o JOIN size ON TRUE LEFT JOIN nd ON (nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z) <= 810000 LEFT JOIN ens ON ens.n = (j * 36 + i) % total GROUP BY o.id""", digits=5)
def h_footprint(spark, d):
    """Plain means over the wet nodes within 900 km; null where there is none."""
    s = _source(spark, d, _fields(spark, d))
    obs = _good(spark, d).withColumn("footprint", F.lit(900.0))
    he = s.at_surface(obs, s.variable("temp").where("k = 0"))
    at = s.grid.located(s.grid.nodes.where("numlevels > 0").select((F.col("j") * NI + F.col("i")).alias("node"), F.col("i").cast("double").alias("fi"), F.col("j").cast("double").alias("fj")))
    near = spatial.within(spatial.with_xyz(at), spatial.with_xyz(obs).select("id", "x", "y", "z"), 900.0).groupBy("id").agg(F.count("*").alias("n"))
    return he.join(near, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), M.mean_of(F.col("he")).alias("mean"), F.col("he")[0].alias("first"))


@query(f"{_GOOD}, {_FIELD}, h AS (SELECT c1.id, SUM(wt * e[1]) / SUM(wt) AS first FROM c1 JOIN good USING (id) JOIN gn USING (i, j) JOIN size ON TRUE JOIN ens ON ens.n = (c1.j * 36 + c1.i) % total WHERE nl > 0 AND wt > 0 GROUP BY c1.id) SELECT good.id, CASE WHEN first IS NULL OR good.type = 'error' THEN 'BADFC' ELSE 'OK' END AS status FROM good LEFT JOIN h USING (id)")
def forecast_driver(spark, d):
    """Types by their functions; an unsound forecast, as one type's here, is marked."""
    fields = _fields(spark, d)
    wild = fields.select(F.lit("wild").alias("var"), "k", "j", "i", F.transform("e", lambda x: x * 1e7).alias("e"))
    types = [{"name": n, "surface": True, "function": "standard", "variables": ["wild" if n == "error" else "temp"], "grid": "grid"} for n in ("view", "click", "error", "purchase", "signup")]
    obs = hx.ensemble_observations(_good(spark, d), types, {"grid": _source(spark, d, fields.unionByName(wild))}, skip_bad=True)
    return obs.select("id", "status")


_HYB = "sqrt(63 / 47.0::DOUBLE) AS kd, sqrt(0.5 * 63 / 15.0::DOUBLE) AS ks"


@query(f"{_ENS} SELECT n, ROUND((e[1] - md) * kd + md, 5) AS first, ROUND((e[64] - ms) * ks + md, 5) AS last, ROUND(list_sum(e[1:48]) / 48, 5) AS hx FROM (SELECT n, e, list_sum(e[1:48]) / 48 AS md, list_sum(e[49:64]) / 16 AS ms, {_HYB} FROM ens)", digits=5)
def hybrid_observations(spark, d):
    """In observation space, static members are centred first; the forecast is the dynamic members' mean."""
    e = _ensemble(spark, d).select("n", hx.hybrid(F.col("e"), 48, MEMBERS, 0.5, centre=True).alias("he"), F.lit(0.0).alias("value"))
    return hx.forecast(e, 48).select("n", F.col("he")[0].alias("first"), F.element_at("he", -1).alias("last"), F.col("hx_f").alias("hx"))


@query(f"{_ENS} SELECT n, ROUND(e[1] - list_sum(e) / 64 + 50 + n % 9, 5) AS first, 50.0::DOUBLE + n % 9 AS mean FROM ens", digits=5)
def enoi_recentred(spark, d):
    e = _ensemble(spark, d).select("n", hx.recentred(F.col("e"), 50.0 + F.col("n") % 9).alias("he"))
    return e.select("n", F.col("he")[0].alias("first"), M.mean_of(F.col("he")).alias("mean"))


# local analyses: at every wet node (of a stride) the nearest observation of one type, so that p is 1 -----------------------


def _located(spark: SparkSession, stride: int = 1, land: bool = False) -> DataFrame:
    g = grid(spark)
    at = (g.nodes if land else g.nodes.where("numlevels > 0")).where((F.col("i") % stride == 0) & (F.col("j") % stride == 0))
    at = at.select("j", "i", (F.col("j") * NI + F.col("i")).cast("int").alias("node"), F.col("i").cast("double").alias("fi"), F.col("j").cast("double").alias("fj"), "numlevels")
    return spatial.with_xyz(g.located(at))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """Good observations (id, type, lon, lat, s, d), with the members of row id % N."""
    ens = _ensemble(spark, d).withColumn("mean", M.mean_of(F.col("e")))
    size = ens.count()
    scale = 20.0 * 63**0.5
    s = F.transform("e", lambda x: (x - F.col("mean")) / scale)
    return _with_inn(spark, d).withColumn("n", F.col("id") % size).join(ens, "n").select("id", "type", "lon", "lat", "fi", "fj", s.alias("s"), (F.col("inn") / scale).alias("d"), "e")


def _analyses(spark: SparkSession, d: str, stride: int = 1, most: int | None = 1, types: tuple[str, ...] | None = ("view",), scheme: str = "DENKF", alpha: float = 1.0, dynamic: int | None = None, by_type: bool = False, land: bool = False) -> DataFrame:
    at, obs = _located(spark, stride, land), _observed(spark, d)
    obs = obs if types is None else obs.where(F.col("type").isin(*types))
    near = spatial.within(at, spatial.with_xyz(obs.select("id", "type", "lon", "lat")), RADIUS).withColumn("coeff", M.multi_taper(F.col("d"), (RADIUS, RADIUS / 2), (0.7, 0.3)))
    near = near if most is None else spatial.nearest(near, most)
    pairs = kernel.with_blocks(near.select("node", "id", "coeff"), at, RADIUS)
    return kernel.block_analyses(pairs, obs.select("id", "type", "s", "d"), scheme, alpha, dynamic, by_type)


def _full(spark: SparkSession, d: str, stride: int = 1, **how) -> DataFrame:
    at = _located(spark, stride)
    solved = kernel.with_defaults(at, _analyses(spark, d, stride, **how).drop("types"), MEMBERS, how.get("dynamic"))
    return solved.join(at.select("node", "j", "i"), "node")


def _one_sql(stride: int = 1, land: bool = False) -> str:
    """one: node, j, i with the closed form's parts (s, q = s's, the standardised innovation, tapered) of its nearest view."""
    coeff = f"0.7::DOUBLE * {_taper_sql(RADIUS)} + 0.3::DOUBLE * (CASE WHEN d <= {RADIUS / 2} THEN {_taper_sql(RADIUS / 2)} ELSE 0 END)"
    return f"""{_INN}, {_FIELD}, wet AS (SELECT j * 36 + i AS node, j, i, nl, {_xyz_sql('(5 + 10 * i)::DOUBLE', '(10 * j - 80)::DOUBLE', 'n')} FROM gn WHERE {'TRUE' if land else 'nl > 0'} AND j % {stride} = 0 AND i % {stride} = 0),
 o AS (SELECT id, inn, {_xyz_sql('lon', 'lat', '')} FROM inn WHERE type = 'view'), pr AS (SELECT node, id, inn, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y) + (nz-z)*(nz-z)) AS d FROM wet, o),
 nr AS (SELECT node, id, inn, d FROM pr WHERE d <= {RADIUS} QUALIFY row_number() OVER (PARTITION BY node ORDER BY d, id) = 1), tp AS (SELECT *, {coeff} AS c FROM nr),
 sc AS (SELECT tp.node, c * inn / (20 * sqrt(63.0::DOUBLE)) AS dn, list_transform(e, lambda x: c * (x - list_sum(e) / 64) / (20 * sqrt(63.0::DOUBLE))) AS s FROM tp, size, ens WHERE ens.n = tp.id % total),
 one AS (SELECT wet.node, wet.j, wet.i, nl, sc.node IS NOT NULL AS has, COALESCE(dn, 0) AS dn, COALESCE(s, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS s, COALESCE(list_dot_product(s, s), 0) AS q FROM wet LEFT JOIN sc USING (node))"""


@query(_one_sql() + " SELECT CAST(node AS INT) AS node, CAST(has AS INT) AS nlobs, ROUND(q / (1 + q), 6) AS dfs, ROUND(CASE WHEN has THEN sqrt(1 + q) - 1 ELSE 0 END, 6) AS srf, ROUND(s[1] * dn / (1 + q), 6) AS w1, ROUND(1 - s[1] * s[1] / (2 * (1 + q)), 6) AS t11, ROUND(-s[2] * s[64] / (2 * (1 + q)), 6) AS t2_64 FROM one")
def local_transforms(spark, d):
    """The analysis of every cell that is not land by its nearest observation; those without one keep their ensemble."""
    return _shown(_full(spark, d))


def _shown(full: DataFrame) -> DataFrame:
    return full.select("node", "nlobs", "dfs", "srf", F.col("w")[0].alias("w1"), F.col("t")[0].alias("t11"), F.element_at("t", MEMBERS + MEMBERS).alias("t2_64"))


@query(_one_sql(3) + " SELECT CAST(node AS INT) AS node, CAST(has AS INT) AS nlobs, ROUND(q / (1 + q), 6) AS dfs, ROUND(CASE WHEN has THEN sqrt(1 + q) - 1 ELSE 0 END, 6) AS srf, ROUND(s[1] * dn / (1 + q), 6) AS w1, ROUND(1 - 0.8 * s[1] * s[1] / (1 + q + sqrt(1 + q)), 6) AS t11, ROUND(-0.8 * s[2] * s[64] / (1 + q + sqrt(1 + q)), 6) AS t2_64 FROM one")
def local_transforms_etkf(spark, d):
    """The square root filter at every third node, relaxed to the forecast by a fifth."""
    return _shown(_full(spark, d, 3, scheme="ETKF", alpha=0.8))


@query(_one_sql() + " SELECT CAST(node AS INT) AS node, ROUND(s[1] * dn / (1 + q), 6) AS w1, 64 * 48 AS size, ROUND(-s[64] * s[48] / (2 * (1 + q)), 6) AS last FROM one WHERE has")
def reduced_transforms(spark, d):
    """The transform of a hybrid ensemble gives its dynamic members only."""
    return _analyses(spark, d, dynamic=48).select("node", F.col("w")[0].alias("w1"), F.size("t").alias("size"), F.element_at("t", -1).alias("last"))


@query(_one_sql() + " SELECT COUNT(*) AS nodes, ROUND(AVG(CAST(has AS INT)), 6) AS mean_nlobs, COUNT(*) FILTER (has) AS in_obs_space, 0::BIGINT AS in_ens_space, COUNT(*) FILTER (NOT has) AS without FROM one")
def local_analysis_stats(spark, d):
    return kernel.local_stats(_full(spark, d), MEMBERS)


@query(_one_sql() + " SELECT CAST(node AS INT) AS node, 'view' AS type, 1 AS nlobs, ROUND(q / (1 + q), 6) AS dfs, ROUND(sqrt(1 + q) - 1, 6) AS srf FROM one WHERE has")
def signal_by_type(spark, d):
    """Degrees of freedom and spread reduction by type of observation, each with its own gain."""
    out = _analyses(spark, d, by_type=True).select("node", F.explode("types").alias("x"))
    return out.select("node", "x.type", "x.nlobs", "x.dfs", "x.srf")


@query(f"{_INN} SELECT 0 AS node, id, 1.0::DOUBLE AS coeff FROM inn")
def global_analysis_pairs(spark, d):
    """A global analysis has one node and sees every observation."""
    one = spark.createDataFrame([(0,)], "node int")
    return spatial.everywhere(one, _with_inn(spark, d).select("id")).select("node", "id", "coeff")


@query(f"""{_INN}, nd AS (SELECT j * 36 + i AS node, {_xyz_sql('(5 + 10 * i)::DOUBLE', '(10 * j - 80)::DOUBLE', 'n')} FROM gn WHERE nl > 0), o AS (SELECT id, {_xyz_sql('lon', 'lat', '')} FROM inn)
 SELECT id, CAST(arg_min(node, (d, node)) AS INT) AS node, ROUND(MIN(d), 5) AS d FROM (SELECT id, node, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y) + (nz-z)*(nz-z)) AS d FROM o, nd) WHERE d <= 1500 GROUP BY id""", digits=5)
def nearest_nodes(spark, d):
    return spatial.nearest_node(spatial.with_xyz(_with_inn(spark, d)), _located(spark), 1500.0)


# updates ----------------------------------------------------------------------------------------------------------------------


def _state(spark: SparkSession, d: str) -> DataFrame:
    """The fields, and whether each element lies above the ground."""
    return _fields(spark, d).join(nodes(spark).select("j", "i", "numlevels"), ["j", "i"]).select("var", "k", "j", "i", "e", (F.col("numlevels") > F.col("k")).alias("wet"))


def _every_node(spark: SparkSession, d: str, stride: int) -> DataFrame:
    """Transforms of all strided nodes, on land too, as elements between them and wet ones are interpolated from both."""
    every = _located(spark, stride, land=True)
    full = kernel.with_defaults(every, _analyses(spark, d, stride, land=True), MEMBERS)
    return up.spread_to_cells(full.join(every.select("node", "j", "i"), "node").select("j", "i", "w", "t"), stride, NJ, NI, True)


def _interpolated_sql(stride: int) -> str:
    """mix: each element (k, j, i) with the strided nodes around it and their weights; those without observations have no weights and the identity."""
    mj, mi = -(-NJ // stride), -(-NI // stride)
    return f"""{_one_sql(stride, land=True)}, el AS (SELECT k, gn.j, gn.i, nl, e, list_sum(e) / 64 AS mean FROM gn, range(4) t(k), size, ens WHERE ens.n = ((k * 17 + gn.j) * 36 + gn.i) % total AND k < nl),
 mix AS (SELECT k, el.j, el.i, e, mean, list_transform(e, lambda x: x - mean) AS a, CASE WHEN dj = 1 THEN (el.j % {stride}) / {stride}.0::DOUBLE ELSE 1 - (el.j % {stride}) / {stride}.0::DOUBLE END * CASE WHEN di = 1 THEN (el.i % {stride}) / {stride}.0::DOUBLE ELSE 1 - (el.i % {stride}) / {stride}.0::DOUBLE END AS wt, one.s, one.q, one.dn
  FROM el, (VALUES (0), (1)) x(di), (VALUES (0), (1)) y(dj) LEFT JOIN one ON one.j = LEAST(el.j // {stride} + dj, {mj - 1}) * {stride} AND one.i = ((el.i // {stride} + di) % {mi}) * {stride})"""


_MOVED = "SUM(CASE WHEN s IS NOT NULL THEN wt * list_dot_product(a, s) * dn / (1 + q) ELSE 0 END)"
_SHRUNK = "SUM(CASE WHEN s IS NOT NULL THEN wt * list_dot_product(a, s) * s[{n}] / (2 * (1 + q)) ELSE 0 END)"


@query(_interpolated_sql(3) + f" SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, CAST(i AS INT) AS i, ROUND(any_value(mean) + {_MOVED}, 4) AS mean_a, ROUND(any_value(a)[1] - {_SHRUNK.format(n=1)} + any_value(mean) + {_MOVED}, 4) AS first, ROUND(any_value(a)[64] - {_SHRUNK.format(n=64)} + any_value(mean) + {_MOVED}, 4) AS last FROM mix GROUP BY k, j, i", digits=4)
def state_update(spark, d):
    """Every element above the ground, by transforms that are interpolated between every third node, around the globe."""
    out = up.analysed(_state(spark, d).where("wet"), _every_node(spark, d, 3), 3, NJ, NI, up.UpdateParameters(MEMBERS))
    return out.select("k", "j", "i", M.mean_of(F.col("a")).alias("mean_a"), F.col("a")[0].alias("first"), F.element_at("a", -1).alias("last"))


@query(_interpolated_sql(1) + """, up AS (SELECT k, j, i, mean, a, list_dot_product(a, s) AS sa, s, q, dn FROM mix WHERE wt > 0), v AS (SELECT *, list_sum(list_transform(a, lambda x: x * x)) AS vf, list_sum(list_transform(range(1, 65), lambda m: (a[m] - sa * s[m] / (2 * (1 + q))) * (a[m] - sa * s[m] / (2 * (1 + q))))) AS va FROM up)
 SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, CAST(i AS INT) AS i, ROUND(infl, 4) AS inflation, ROUND((a[1] - sa * s[1] / (2 * (1 + q))) * infl + sa * dn / (1 + q) - a[1], 4) AS increment FROM (SELECT *, CASE WHEN 0.5 * sqrt(vf / va) + 0.5 > 1 + 1e-6 THEN LEAST(1.05, 0.5 * sqrt(vf / va) + 0.5) ELSE 1 END AS infl FROM v)""", digits=4)
def state_increments(spark, d):
    """Increments, with the inflation that the spread's reduction allows."""
    p = up.UpdateParameters(MEMBERS, inflation=1.05, ratio=0.5, increment=True)
    out = up.analysed(_state(spark, d).where("wet"), _every_node(spark, d, 1), 1, NJ, NI, p)
    return out.select("k", "j", "i", "inflation", F.col("a")[0].alias("increment"))


@query(f"WITH {_OBS}, {_FIELD} SELECT k::INT AS k, gn.j, gn.i, ROUND(CASE WHEN k < nl THEN list_sum(e) / 64 ELSE 0 END, 5) AS mean FROM gn, range(4) t(k), size, ens WHERE ens.n = ((k * 17 + gn.j) * 36 + gn.i) % total", digits=5)
def land_mask(spark, d):
    """Without observations an update changes nothing, but elements below the ground become 0."""
    none = nodes(spark).select((F.col("j") * NI + F.col("i")).cast("int").alias("node"), "j", "i")
    full = kernel.with_defaults(none, spark.createDataFrame([], kernel.RESULT), MEMBERS).join(none, "node").select("j", "i", "w", "t")
    out = up.analysed(_state(spark, d), up.spread_to_cells(full, 1, NJ, NI, True), 1, NJ, NI, up.UpdateParameters(MEMBERS))
    return out.select("k", "j", "i", M.mean_of(F.col("a")).alias("mean"))


@query(_interpolated_sql(3) + f" SELECT CAST(k AS INT) AS k, CAST(j AS INT) AS j, CAST(i AS INT) AS i, ROUND(48 + 5 * ((i + j + k) % 7) + {_MOVED}, 4) AS analysis FROM mix GROUP BY k, j, i", digits=4)
def enoi_state_update(spark, d):
    """A background, moved by the interpolated weights' sum of anomalies."""
    state = _state(spark, d).where("wet").withColumn("bg", 48.0 + 5 * ((F.col("i") + F.col("j") + F.col("k")) % 7))
    return up.analysed_background(state, _every_node(spark, d, 3), 3, NJ, NI).select("k", "j", "i", F.col("a").alias("analysis"))


_NEAREST = f"""{_one_sql(land=True)}, ob AS (SELECT inn.id, e, list_sum(e) / 64 AS mean, LEAST(16, CAST(floor(fj + 0.5) AS INT)) AS j, LEAST(35, CAST(floor(fi + 0.5) AS INT)) AS i FROM inn, size, ens WHERE ens.n = inn.id % total),
 mt AS (SELECT ob.id, e, mean, list_transform(e, lambda x: x - mean) AS a, s, q, dn, list_dot_product(list_transform(e, lambda x: x - mean), s) AS sa FROM ob LEFT JOIN one USING (j, i))"""


@query(_NEAREST + " SELECT id, ROUND(mean + COALESCE(sa * dn / (1 + q), 0), 5) AS hx_a, ROUND(a[1] - COALESCE(sa * s[1] / (2 * (1 + q)), 0) + mean + COALESCE(sa * dn / (1 + q), 0), 5) AS first FROM mt", digits=5)
def analysed_observations(spark, d):
    """Members at observations, moved by the transform of the nearest node."""
    obs = _observed(spark, d).withColumnRenamed("e", "he").select("id", "fi", "fj", "he")
    out = up.analysed_observations(obs, _every_node(spark, d, 1), 1, NJ, NI, up.UpdateParameters(MEMBERS))
    return out.select("id", M.mean_of(F.col("ha")).alias("hx_a"), F.col("ha")[0].alias("first"))


@query(_NEAREST + f""", r AS (SELECT mt.id, mean - sv AS f, mean + COALESCE(sa * dn / (1 + q), 0) - sv AS g, type FROM mt JOIN (SELECT id, value AS sv, type FROM inn) USING (id))
 SELECT type, COUNT(*) AS n, ROUND(AVG(abs(f)) + 1e-9, 5) AS dev_f, ROUND(-AVG(f) + 1e-9, 5) AS inn_f, ROUND(AVG(abs(g)) + 1e-9, 5) AS dev_a, ROUND(-AVG(g) + 1e-9, 5) AS inn_a FROM r GROUP BY type""", digits=5)
def analysis_stats(spark, d):
    """Innovations before and after, by type."""
    obs = _observed(spark, d).withColumnRenamed("e", "he").select("id", "fi", "fj", "he")
    after = up.analysed_observations(obs, _every_node(spark, d, 1), 1, NJ, NI, up.UpdateParameters(MEMBERS)).select("id", "he", "ha")
    met = _with_inn(spark, d).join(after, "id")
    met = hx.forecast(met)
    met = hx.forecast(met.withColumnRenamed("he", "before").withColumnRenamed("ha", "he"), suffix="a")
    world = spark.createDataFrame([("all", 0.0, 360.0, -90.0, 90.0)], "region string, west double, east double, south double, north double")
    return _decided(diag.observation_stats(met, world).where("kind = 'all'").select("type", "n", "dev_f", "inn_f", "dev_a", "inn_a"))


@query(f"{_ENS} SELECT n, ROUND(log10(e[1]), 6) AS first, ROUND(e[64], 5) AS back FROM ens WHERE list_min(e) > 0")
def log_space(spark, d):
    """Members as logarithms and back; static ones, from the 49th on, are so already."""
    e = _ensemble(spark, d).where(F.array_min("e") > 0)
    return e.select("n", up.logged(F.col("e"), 48)[0].alias("first"), F.round(F.element_at(up.unlogged(up.logged(F.col("e"))), -1), 5).alias("back"))


def _noise() -> list[float]:
    return up.noise(MEMBERS, 5)


@query(f"{_ENS} SELECT n, ROUND(list_sum(e) / 64 * 0.9, 5) AS mean, ROUND(e[1] * 0.9 + {_noise()[0]!r}::DOUBLE * sqrt(1 - 0.81::DOUBLE) * 2, 5) AS first FROM ens", digits=5)
def randomised_state(spark, d):
    e = _ensemble(spark, d).select("n", up.randomised(F.col("e"), _noise(), 0.9, 2.0).alias("a"))
    return e.select("n", M.mean_of(F.col("a")).alias("mean"), F.col("a")[0].alias("first"))


# diagnostics and point logs ---------------------------------------------------------------------------------------------------

_EL = f"WITH {_OBS}, {_FIELD}, el AS (SELECT k, gn.j, gn.i, nl, e, list_sum(e) / 64 AS mean, list_transform(e, lambda x: x - list_sum(e) / 64) AS p FROM gn, range(4) t(k), size, ens WHERE ens.n = ((k * 17 + gn.j) * 36 + gn.i) % total)"


@query(_EL + " SELECT k::INT AS k, j, i, ROUND(sqrt(GREATEST(list_sum(list_transform(e, lambda x: x * x)) / 64 - mean * mean, 0)), 4) AS spread FROM el", digits=4)
def layer_spread(spark, d):
    return _fields(spark, d).select("k", "j", "i", diag.field_spread(F.col("e")).alias("spread"))


@query(_EL + " SELECT a.k::INT AS k, a.j, a.i, ROUND(list_dot_product(a.p, b.p) / sqrt(list_dot_product(a.p, a.p) * list_dot_product(b.p, b.p)), 6) AS corr FROM el a JOIN el b ON b.k = 0 AND a.j = b.j AND a.i = b.i")
def vertical_correlation(spark, d):
    return diag.vertical_correlation(_fields(spark, d)).select("k", "j", "i", "corr")


@query(_EL + " SELECT a.k::INT AS k, a.j, a.i, ROUND(list_dot_product(a.p, b.p) / sqrt(list_dot_product(a.p, a.p) * list_dot_product(b.p, b.p)), 6) AS corr, ROUND(list_dot_product(a.p, b.p) / 63, 4) AS cov, ROUND(list_dot_product(a.p, b.p) / list_dot_product(b.p, b.p), 6) AS sens FROM el a JOIN el b ON b.k = 2 AND a.j = b.j AND a.i = b.i")
def correlation_with_field(spark, d):
    given = _fields(spark, d).where("k = 2").select("j", "i", "e")
    out = diag.with_given(_fields(spark, d), given, ["j", "i"])
    return out.select("k", "j", "i", "corr", F.round("cov", 4).alias("cov"), "sens")


_PLACE = "(VALUES (0, 32.0::DOUBLE, 13.0::DOUBLE), (1, 359.0::DOUBLE, -41.0::DOUBLE)) pl(node, plon, plat)"


@query(f"""{_INN}, o AS (SELECT id, type, {_xyz_sql('lon', 'lat', '')} FROM inn), q AS (SELECT node, {_xyz_sql('plon', 'plat', 'n')} FROM {_PLACE}), pr AS (SELECT CAST(node AS INT) AS node, id, type, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y) + (nz-z)*(nz-z)) AS d FROM q, o)
 SELECT node, id, type, ROUND(d, 5) AS d, ROUND({_taper_sql(2000.0)}, 6) AS coeff FROM pr WHERE d <= 2000""")
def point_log_observations(spark, d):
    """Every observation around logged places, with its coefficient."""
    obs = spatial.with_xyz(_with_inn(spark, d).select("id", "type", "lon", "lat")).drop("lon", "lat")
    out = diag.point_log(obs, _places(spark), 2000.0, M.taper(F.col("d"), 2000.0))
    return out.select("node", "id", "type", F.round("d", 5).alias("d"), "coeff")


def _places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 32.0, 13.0), (1, 359.0, -41.0)], "node int, lon double, lat double")


@query(f"""WITH {_OBS}, {_FIELD}, q AS (SELECT node, (CASE WHEN plon < 5 THEN plon + 360 ELSE plon END - 5) / 10 AS fi, (plat + 80) / 10 AS fj FROM {_PLACE}),
 cr AS (SELECT node, (CAST(floor(fi) AS INT) + di) % 36 AS i, CAST(floor(fj) AS INT) + dj AS j, CASE WHEN di = 1 THEN fi - floor(fi) ELSE 1 - (fi - floor(fi)) END * CASE WHEN dj = 1 THEN fj - floor(fj) ELSE 1 - (fj - floor(fj)) END AS wt FROM q, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj))
 SELECT CAST(node AS INT) AS node, 'temp' AS var, k::INT AS k, ROUND(SUM(wt * list_sum(e) / 64) / SUM(wt), 5) AS mean, ROUND(SUM(wt * e[1]) / SUM(wt), 5) AS first FROM cr JOIN gn USING (i, j), range(4) t(k), size, ens WHERE ens.n = ((k * 17 + j) * 36 + i) % total AND nl > k AND wt > 0 GROUP BY node, k""", digits=5)
def point_log_state(spark, d):
    """The state of every layer at logged places."""
    out = diag.state_at(grid(spark).indexed(_places(spark)), _fields(spark, d), nodes(spark), NI, NJ)
    return out.select("node", "var", "k", M.mean_of(F.col("e")).alias("mean"), F.col("e")[0].alias("first"))


@query(f"""{_INN}, {_FIELD}, o AS (SELECT id, inn, {_xyz_sql('lon', 'lat', '')} FROM inn), q AS (SELECT node, {_xyz_sql('plon', 'plat', 'n')} FROM {_PLACE}), pr AS (SELECT CAST(node AS INT) AS node, id, inn, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y) + (nz-z)*(nz-z)) AS d FROM q, o),
 nr AS (SELECT * FROM pr WHERE d <= 2000 QUALIFY row_number() OVER (PARTITION BY node ORDER BY d, id) = 1), sc AS (SELECT node, c * inn / (20 * sqrt(63.0::DOUBLE)) AS dn, list_transform(e, lambda x: c * (x - list_sum(e) / 64) / (20 * sqrt(63.0::DOUBLE))) AS s FROM (SELECT *, {_taper_sql(2000.0)} AS c FROM nr), size, ens WHERE ens.n = id % total)
 SELECT node, ROUND(s[1] * dn / (1 + list_dot_product(s, s)), 6) AS w1, ROUND(1 - s[1] * s[1] / (2 * (1 + list_dot_product(s, s))), 6) AS t11 FROM sc""")
def point_log_transforms(spark, d):
    """The analysis at logged places themselves, from the nearest observation."""
    obs = _observed(spark, d)
    at = spatial.with_xyz(_places(spark))
    near = spatial.nearest(spatial.within(at, spatial.with_xyz(obs.select("id", "lon", "lat")), 2000.0), 1, ("node",)).withColumn("coeff", M.taper(F.col("d"), 2000.0))
    out = kernel.block_analyses(kernel.with_blocks(near.select("node", "id", "coeff"), at, 2000.0), obs.select("id", "type", "s", "d"))
    return out.select("node", F.col("w")[0].alias("w1"), F.col("t")[0].alias("t11"))


# grids that are not rectangular ------------------------------------------------------------------------------------------------


def _rotated(j: Column, i: Column) -> tuple[Column, Column]:
    """A sheared grid: lon and lat of its nodes."""
    return 10.0 + 8.0 * i + 2.0 * j, -50.0 + 6.0 * j + 1.0 * i


def _quads(spark: SparkSession) -> DataFrame:
    n = spark.range(12 * 20).select(F.floor(F.col("id") / 20).cast("int").alias("j"), (F.col("id") % 20).cast("int").alias("i"))
    lon, lat = _rotated(F.col("j"), F.col("i"))
    return spatial.quads(n.select("j", "i", lon.alias("lon"), lat.alias("lat")))


# lon = 10 + 8 i + 2 j, lat = -50 + i + 6 j
_SHEARED = "SELECT id, (6 * (lon - 10) - 2 * (lat + 50)) / 46 AS fi, (8 * (lat + 50) - (lon - 10)) / 46 AS fj FROM obs"


@query(f"WITH {_OBS} SELECT id, ROUND(fi, 5) AS fi, ROUND(fj, 5) AS fj FROM ({_SHEARED}) WHERE fi >= 0 AND fi <= 19 AND fj >= 0 AND fj <= 11", digits=5)
def curvilinear_mapping(spark, d):
    from ..sources.observations import events

    return spatial.in_quads(events(spark, d), _quads(spark), 1000.0)


@query(f"WITH {_OBS} SELECT id, ROUND(lon, 4) AS lon, ROUND(lat, 4) AS lat FROM obs JOIN ({_SHEARED}) USING (id) WHERE fi > 0 AND fi < 18.99 AND fj > 0 AND fj < 10.99", digits=4)
def curvilinear_coordinates(spark, d):
    """There and back: the place of an observation's indices in the grid."""
    from ..sources.observations import events

    at = spatial.in_quads(events(spark, d), _quads(spark), 1000.0).where("fi > 0 and fi < 18.99 and fj > 0 and fj < 10.99")
    return spatial.quad_places(at, _quads(spark))


def _triangles(spark: SparkSession) -> DataFrame:
    """Squares of 20 by 10 degrees, each cut along its diagonal; vertex 19 j + i at lon 20 i, lat 10 j - 90."""
    n = spark.range(18 * 18 * 2).select((F.col("id") % 18).cast("int").alias("i"), (F.floor(F.col("id") / 18) % 18).cast("int").alias("j"), F.floor(F.col("id") / 324).cast("int").alias("half"))
    lower = F.col("half") == 0
    at = [(0, 0), (1, 0), (1, 1)], [(0, 0), (1, 1), (0, 1)]
    out = n.select((F.col("j") * 36 + F.col("i") * 2 + F.col("half")).alias("triangle"), *[c for v in range(3) for c in ((F.when(lower, (F.col("j") + at[0][v][1]) * 19 + F.col("i") + at[0][v][0]).otherwise((F.col("j") + at[1][v][1]) * 19 + F.col("i") + at[1][v][0])).alias(f"v{v}"), F.when(lower, 20.0 * (F.col("i") + at[0][v][0])).otherwise(20.0 * (F.col("i") + at[1][v][0])).alias(f"x{v}"), F.when(lower, 10.0 * (F.col("j") + at[0][v][1]) - 90).otherwise(10.0 * (F.col("j") + at[1][v][1]) - 90).alias(f"y{v}"))])
    return out


def _in_triangles(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.observations import events

    return spatial.in_triangles(events(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), _triangles(spark), 30.0)


_TRI = f"WITH {_OBS}, sq AS (SELECT id, CAST(floor(lon / 20) AS INT) AS i, CAST(floor((lat + 90) / 10) AS INT) AS j, lon / 20 - floor(lon / 20) AS u, (lat + 90) / 10 - floor((lat + 90) / 10) AS v FROM obs), tr AS (SELECT id, j * 36 + i * 2 + CASE WHEN v > u + 1e-12 THEN 1 ELSE 0 END AS triangle, j * 19 + i AS v0, CASE WHEN v > u + 1e-12 THEN 1 - v ELSE 1 - u END AS w0, CASE WHEN v > u + 1e-12 THEN u ELSE u - v END AS w1, CASE WHEN v > u + 1e-12 THEN (j + 1) * 19 + i + 1 ELSE j * 19 + i + 1 END AS v1, CASE WHEN v > u + 1e-12 THEN (j + 1) * 19 + i ELSE (j + 1) * 19 + i + 1 END AS v2 FROM sq)"


@query(_TRI + " SELECT id, ROUND(w0, 6) + 0 AS w0, CAST(v0 AS INT) AS v0 FROM tr WHERE w0 > 1e-6 AND w1 > 1e-6 AND w0 + w1 < 0.999999")
def triangle_mapping(spark, d):
    """Barycentric weights in the triangle around an observation (its edges, where several share a point, apart)."""
    return _in_triangles(spark, d).where("w0 > 1e-6 and w1 > 1e-6 and w0 + w1 < 0.999999").select("id", "w0", F.col("v0").cast("int").alias("v0"))


@query(_TRI + f", {_FIELD}, p AS (SELECT id, v0 AS node, w0 AS w FROM tr UNION ALL SELECT id, v1, w1 FROM tr UNION ALL SELECT id, v2, 1 - w0 - w1 FROM tr) SELECT id, ROUND(SUM(w * e[1]) / SUM(w), 4) AS first FROM p, size, ens WHERE ens.n = node % total AND node % 5 > 0 AND w > 1e-9 GROUP BY id HAVING SUM(w) > 1e-6", digits=4)
def triangle_interpolation(spark, d):
    """From the wet ones of a triangle's vertices."""
    ens = _ensemble(spark, d)
    size = ens.count()
    at = spark.range(19 * 19).select(F.col("id").cast("int").alias("node"), (F.col("id") % 5).cast("int").alias("numlevels"), (F.col("id") % size).alias("n"))
    placed = _in_triangles(spark, d).withColumns({f"w{n}": F.when(F.col(f"w{n}") > 1e-9, F.col(f"w{n}")).otherwise(0.0) for n in range(3)})
    out = spatial.members_of_triangles(placed, at.join(ens, "n").select("node", "e"), at.select("node", "numlevels"), least=1e-6)
    return out.select("id", F.col("he")[0].alias("first"))


@query(f"{_GOOD}, c AS (SELECT *, CAST(floor(time / 2) AS INT) AS cycle FROM good) SELECT type, COUNT(*) AS nobs, COUNT(DISTINCT cycle) AS cycles, ROUND(SUM(value / (estd * estd)) / SUM(1 / (estd * estd)), 6) AS value FROM c GROUP BY type")
def cycle_windows(spark, d):
    """Super-observations of event-time windows, joined again by type; a stream gives the same once windows close."""
    from ..streaming import assimilation_windows

    obs = _good(spark, d).withColumn("ts", F.timestamp_seconds((F.col("time") + 19738) * 86400))
    out = assimilation_windows(obs, ["type"], "2 days", "1 day")
    w = 1 / (F.col("estd") * F.col("estd"))
    return out.groupBy("type").agg(F.sum("nobs").alias("nobs"), F.countDistinct("start").alias("cycles"), (F.sum(F.col("value") * w) / F.sum(w)).alias("value"))
