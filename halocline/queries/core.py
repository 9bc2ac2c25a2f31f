"""The test system's tables, the registry, and queries on observations, grids, ensembles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths as M
from ..operators import diag, kernel, prep, spatial
from ..operators.grid import Axis, Grid, Layers
from ..sources import observations as sources

MEMBERS = 64
BOXES = ((0.0, 40.0, -60.0, 60.0), (100.0, 120.0, -30.0, 30.0))
REGIONS = [("global", 0.0, 360.0, -90.0, 90.0), ("north", 0.0, 360.0, 20.0, 90.0), ("tropics", 0.0, 360.0, -20.0, 20.0), ("south", 0.0, 360.0, -90.0, -20.0), ("box", 150.0, 250.0, -60.0, 60.0), ("across", 300.0, 40.0, -60.0, 60.0)]
LAYERS = [("0-50", 0.0, 50.0), ("50-500", 50.0, 500.0), ("500-9999", 500.0, 9999.0)]
NI, NJ, NK = 36, 17, 4
CENTRES, EDGES = (25.0, 100.0, 300.0, 700.0), (0.0, 50.0, 150.0, 450.0, 950.0)


def nodes(spark: SparkSession) -> DataFrame:
    """The test grid's nodes: 36 x 17 cells of 10 degrees, 4 layers, and land where (7 i + 3 j) % 5 is 0."""
    i, j = (F.col("id") % NI).cast("int"), F.floor(F.col("id") / NI).cast("int")
    out = spark.range(NI * NJ).select(j.alias("j"), i.alias("i"), ((7 * i + 3 * j) % 5).cast("int").alias("numlevels"))
    return out.withColumn("depth", M.numbers(EDGES)[F.col("numlevels")])


def grid(spark: SparkSession, stride: int = 1, name: str = "grid") -> Grid:
    return Grid(name, Axis(tuple(5.0 + 10 * i for i in range(NI)), cyclic=True), Axis(tuple(-80.0 + 10 * j for j in range(NJ))), Layers("z", CENTRES, EDGES), nodes(spark), stride)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums depend on the order of rows in their last digits. (Where means of few decimals end in ties, 1e-9 is added.)"""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark).mapped(sources.events(spark, d))


def _good(spark: SparkSession, d: str) -> DataFrame:
    return prep.with_status(_obs(spark, d), window=(-5.0, 5.0)).where(F.col("status") == "OK")


def _with_inn(spark: SparkSession, d: str) -> DataFrame:
    """Innovations against a background that is a function of the nearest cell."""
    hx = 48.0 + 5.0 * ((F.floor(F.col("fi") + 0.5) % 36 + F.floor(F.col("fj") + 0.5)) % 7)
    return _good(spark, d).withColumn("hx", hx).withColumn("inn", F.col("value") - F.col("hx"))


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("n"), F.transform("embedding", lambda x: 48 + 200 * x.cast("double")).alias("e"))


def _small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few rows that are written here: of a proven size."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _decided(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name) + 1e-9).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


# SQL -------------------------------------------------------------------------------------------------------------

_OBS = """obs0 AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props,'$.k') AS INT) AS k, epoch_us(ts) AS us FROM events),
obs AS (SELECT event_id AS id, event_type AS type, 'EVENTS' AS product, concat('I', user_id % 7) AS instrument, CAST(floor(us / 86400e6) AS BIGINT) AS file, user_id % 11 AS batch, value,
 0.5::DOUBLE + (k % 10) * 0.1::DOUBLE AS estd, (user_id * 37 + k * 3) % 360 + 0.5::DOUBLE AS lon, k * 1.6::DOUBLE - 79.2::DOUBLE AS lat,
 CASE WHEN event_type IN ('view','click','error') THEN 0::DOUBLE ELSE (event_id % 40) * 25.0::DOUBLE END AS depth, us / 86400e6::DOUBLE - 19738::DOUBLE AS time FROM obs0),
g0 AS (SELECT *, (CASE WHEN lon < 5 THEN lon + 360 ELSE lon END - 5) / 10 AS fi, CASE WHEN lat >= -80 AND lat < 80 THEN (lat + 80) / 10 END AS fj,
 CASE WHEN depth <= 0 THEN -0.5::DOUBLE WHEN depth < 25 THEN 0 - 0.5 * (25 - depth) / 25::DOUBLE WHEN depth <= 50 THEN 0 + 0.5 * (depth - 25) / 25::DOUBLE WHEN depth < 100 THEN 1 - 0.5 * (100 - depth) / 50::DOUBLE WHEN depth <= 150 THEN 1 + 0.5 * (depth - 100) / 50::DOUBLE
  WHEN depth < 300 THEN 2 - 0.5 * (300 - depth) / 150::DOUBLE WHEN depth <= 450 THEN 2 + 0.5 * (depth - 300) / 150::DOUBLE WHEN depth < 700 THEN 3 - 0.5 * (700 - depth) / 250::DOUBLE WHEN depth <= 950 THEN 3 + 0.5 * (depth - 700) / 250::DOUBLE END AS fk FROM obs),
gn AS (SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, CAST((7 * i + 3 * j) % 5 AS INT) AS nl, [0.0, 50.0, 150.0, 450.0, 950.0][(7 * i + 3 * j) % 5 + 1]::DOUBLE AS dep FROM range(17) a(j), range(36) b(i)),
c1 AS (SELECT id, CAST((CAST(floor(fi) AS INT) + di) % 36 AS INT) AS i, CAST(LEAST(16, CAST(floor(fj) AS INT) + dj) AS INT) AS j, CASE WHEN di = 1 THEN fi - floor(fi) ELSE 1 - (fi - floor(fi)) END * CASE WHEN dj = 1 THEN fj - floor(fj) ELSE 1 - (fj - floor(fj)) END AS wt FROM g0, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj) WHERE fi IS NOT NULL AND fj IS NOT NULL),
c2 AS (SELECT id, SUM(CASE WHEN nl > 0 THEN wt * dep END) / SUM(CASE WHEN nl > 0 AND wt > 0 THEN wt END) AS model_depth, MAX(CASE WHEN wt > 0 THEN nl END) AS most, MIN(CASE WHEN wt > 0 THEN nl END) AS least FROM c1 JOIN gn USING (i, j) GROUP BY id),
grid AS (SELECT g0.*, model_depth, CASE WHEN fi IS NULL OR fj IS NULL THEN 'GRID' WHEN most = 0 THEN 'LAND' WHEN fk IS NULL THEN 'GRID' WHEN most <= floor(fk) THEN 'LAND' WHEN least <= floor(fk) AND depth > model_depth THEN 'LAND' ELSE 'OK' END AS map_status FROM g0 LEFT JOIN c2 USING (id))"""


def _status_sql(window=(-15, 15), low=None, high=None, min_depth=None, boxes=(), stride=1, domain=None, max_depth=None) -> str:
    c = ["WHEN map_status <> 'OK' THEN map_status", f"WHEN NOT (time >= {window[0]} AND time < {window[1]}) THEN 'WINDOW'", "WHEN value IS NULL OR isnan(value) THEN 'RANGE'"]
    c += [f"WHEN value < {low} THEN 'RANGE'"] if low is not None else []
    c += [f"WHEN value > {high} THEN 'RANGE'"] if high is not None else []
    c += [f"WHEN lon <= {domain[0]} OR lon >= {domain[1]} OR lat <= {domain[2]} OR lat >= {domain[3]} OR depth < {domain[4]} OR depth > {domain[5]} THEN 'DOMAIN'"] if domain else []
    c += ["WHEN model_depth IS NULL OR model_depth = 0 OR depth > model_depth THEN 'LAND'"]
    c += [f"WHEN id % {stride} <> 0 THEN 'THINNED'"] if stride > 1 else []
    c += [f"WHEN model_depth < {min_depth} THEN 'SHALLOW'"] if min_depth is not None else []
    c += [f"WHEN model_depth > {max_depth} THEN 'SHALLOW'"] if max_depth is not None else []
    c += [f"WHEN lon BETWEEN {b[0]} AND {b[1]} AND lat BETWEEN {b[2]} AND {b[3]} THEN 'EXCLUDED'" for b in boxes]
    return f"st AS (SELECT *, CASE {' '.join(c)} ELSE 'OK' END AS status FROM grid)"


_GOOD = f"WITH {_OBS}, {_status_sql((-5, 5))}, good AS (SELECT * FROM st WHERE status = 'OK')"
_INN = _GOOD + ", inn AS (SELECT *, value - hx AS inn FROM (SELECT *, 48.0::DOUBLE + 5.0::DOUBLE * ((CAST(floor(fi + 0.5) AS BIGINT) % 36 + CAST(floor(fj + 0.5) AS BIGINT)) % 7) AS hx FROM good))"
_ENS = "WITH ens AS (SELECT vec_id AS n, list_transform(embedding, lambda x: 48 + 200 * CAST(x AS DOUBLE)) AS e FROM embeddings)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"ROUND({n}, {digits}) AS {n}" for n in names)


# sources ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_OBS} SELECT id, type, product, instrument, file, batch, {_r('value', 'estd', 'lon', 'lat', 'depth', 'time')} FROM obs")
def scan_observations(spark, d):
    return sources.events(spark, d)


@query("SELECT l_orderkey, l_linenumber, ROUND(l_quantity * 2 - 1, 6) AS obs_value, ROUND(GREATEST(1 + l_discount * 10, l_tax * 20), 6) AS obs_estd FROM lineitem WHERE l_quantity IS NOT NULL AND l_linenumber IN (1, 3, 5)")
def read_scattered(spark, d):
    raw = spark.read.parquet(f"{d}/lineitem.parquet").select("*", (1 + F.col("l_discount") * 10).alias("std"), (F.col("l_tax") * 20).alias("error_std"))
    out = sources.scattered(raw, "l_quantity", lon="l_suppkey", lat="l_linenumber", time="l_shipdate", std="std", error_std="error_std", flags={"l_linenumber": [1, 3, 5]}, scale=2.0, shift=-1.0)
    return out.select("l_orderkey", "l_linenumber", "obs_value", "obs_estd")


@query("SELECT batch, CAST(level AS INT) AS level, ROUND(value, 6) AS value, depth FROM (SELECT vec_id AS batch, generate_subscripts(embedding, 1) - 1 AS level, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), LATERAL (SELECT level * 25.0::DOUBLE AS depth) WHERE (batch + level) % 4 <> 0")
def read_profiles(spark, d):
    raw = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("batch"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    raw = raw.select("*", F.transform("v", lambda x, i: i * F.lit(25.0)).alias("z"), F.transform("v", lambda x, i: F.when((F.col("batch") + i) % 4 != 0, 1).otherwise(0)).alias("q"))
    return sources.profiles(raw, "v", "z", "q").select("batch", "level", "value", "depth")


@query("SELECT vec_id AS record, CAST((p - 1) // 8 AS INT) AS j, CAST((p - 1) % 8 AS INT) AS i, ROUND(CAST(embedding[p] AS DOUBLE), 6) AS value FROM embeddings, range(1, 65) t(p)")
def read_gridded(spark, d):
    raw = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("record"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.transform(F.slice("embedding", j * 8 + 1, 8), lambda x: x.cast("double"))).alias("v"))
    return sources.gridded(raw, "v").select("record", "j", "i", "value")


@query(f"WITH {_OBS} SELECT id, CAST(floor(time / 0.5 + 0.5) AS INT) AS slot, ROUND(CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END, 6) AS lon FROM obs")
def time_slots_and_longitudes(spark, d):
    return sources.events(spark, d).select("id", M.slot(F.col("time"), 0.5).alias("slot"), M.normal_lon(F.col("lon"), -180.0).alias("lon"))


# quality, errors, super-observations -------------------------------------------------------------------------------


@query(f"WITH {_OBS}, {_status_sql((-10, 10), 5, 95, 60, BOXES, 3, (20.0, 340.0, -70.0, 75.0, 0.0, 900.0), 700)} SELECT id, type, status, {_r('fi', 'fj', 'fk')} FROM st")
def first_failing_check(spark, d):
    return prep.with_status(_obs(spark, d), (-10.0, 10.0), 5.0, 95.0, 60.0, 700.0, BOXES, 3, (20.0, 340.0, -70.0, 75.0, 0.0, 900.0)).select("id", "type", "status", "fi", "fj", "fk")


@query(f"WITH {_OBS}, {_status_sql((-10, 10), 5, 95, 60, BOXES, 3, (20.0, 340.0, -70.0, 75.0, 0.0, 900.0), 700)} SELECT COALESCE(type, 'all') AS type, COALESCE(status, 'all') AS status, COUNT(*) AS n, ROUND(MIN(time), 6) AS first, ROUND(MAX(time), 6) AS last FROM st GROUP BY CUBE (type, status)")
def status_counts(spark, d):
    out = prep.with_status(_obs(spark, d), (-10.0, 10.0), 5.0, 95.0, 60.0, 700.0, BOXES, 3, (20.0, 340.0, -70.0, 75.0, 0.0, 900.0)).cube("type", "status").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    return out.select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("status", F.lit("all")).alias("status"), "n", "first", "last")


@query("SELECT l_orderkey, l_linenumber, ROUND(LEAST(GREATEST(sqrt(s * s + 4) * 0.5, 0.9), 3), 6) AS estd, ROUND(s * pow(2.0, (l_linenumber % 5) / 3.0), 6) AS grown FROM (SELECT *, 1 + l_discount * 10 AS s FROM lineitem)")
def error_chain(spark, d):
    s, t = 1 + F.col("l_discount") * 10, (F.col("l_linenumber") % 5).cast("double")
    estd = M.error_chain(F.lit(0.0), [("EQ", s), ("PLUS", 2.0), ("MULT", 0.5), ("MIN", 0.9), ("MAX", 3.0)])
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", estd.alias("estd"), M.error_growth(s, t, 3.0).alias("grown"))


_CELLS = _GOOD + ", cells AS (SELECT *, CAST(floor(floor(fi + 0.5) / 3) AS INT) AS ci, CAST(floor(floor(fj + 0.5) / 3) AS INT) AS cj, CAST(floor(fk + 0.5) AS INT) AS ck, 1 / (estd * estd) AS w FROM good)"
_SUPER = """SELECT type, instrument, ci, cj, ck, MIN(id) AS id, ROUND(SUM(value * w) / SUM(w), 6) AS value, ROUND(GREATEST(sqrt(1 / SUM(w)), 0.2), 6) AS estd,
 ROUND(SUM(lat * w) / SUM(w), 6) AS lat, ROUND(SUM(depth * w) / SUM(w), 6) AS depth, ROUND(SUM(time * w) / SUM(w), 6) AS time,
 ROUND(SUM(model_depth * w) / SUM(w), 6) AS model_depth, ROUND(((CASE WHEN MAX(lon) - MIN(lon) > 180 THEN SUM((CASE WHEN lon > 185 THEN lon - 360 ELSE lon END) * w) / SUM(w) ELSE SUM(lon * w) / SUM(w) END) - 5 + 720) % 360 + 5, 6) AS lon, CASE WHEN MIN(batch) = MAX(batch) THEN MIN(batch) END AS batch, COUNT(*) AS nobs FROM cells GROUP BY type, instrument, ci, cj, ck"""


@query(f"{_CELLS} {_SUPER}")
def superobservations(spark, d):
    rows = prep.with_cells(_good(spark, d), 3)
    out = prep.superobs(rows, prep.superob_keys(rows), 0.2, base=5.0)
    return out.select("type", "instrument", "ci", "cj", "ck", "id", "value", "estd", "lat", "depth", "time", "model_depth", "lon", "batch", "nobs")


@query(f"{_CELLS.replace('1 / (estd * estd) AS w', 'var_samp(value) OVER (PARTITION BY type, floor(floor(fi + 0.5) / 3), floor(floor(fj + 0.5) / 3), floor(fk + 0.5)) AS sv')}, weighed AS (SELECT *, 1 / GREATEST(estd * estd, COALESCE(sv, 0)) AS w FROM cells) SELECT type, ci, cj, ck, ROUND(SUM(value * w) / SUM(w), 5) AS value, ROUND(sqrt(1 / SUM(w)), 5) AS estd FROM weighed GROUP BY type, ci, cj, ck")
def superobs_subgrid_variance(spark, d):
    return rounded(prep.superobs(prep.with_cells(_good(spark, d), 3), ["type", "ci", "cj", "ck"], subgrid=True).select("type", "ci", "cj", "ck", "value", "estd"), 5)


def _thin_sql(kind: str, by: str, means: str) -> str:
    return f"SELECT '{kind}' AS kind, MIN(id) AS id, ROUND(AVG(value), 6) AS value, ROUND(AVG(time), 6) AS time, {means}, ROUND(arg_min(estd, id), 6) AS estd, COUNT(*) AS nthin FROM cells GROUP BY type, ci, cj, ck{by}"


@query(_CELLS + " " + " UNION ALL ".join([_thin_sql("XYZ", ", instrument, lon, lat, depth", "ROUND(arg_min(depth, id), 6) AS depth, ROUND(arg_min(lat, id), 6) AS lat"), _thin_sql("XY", ", instrument, lon, lat", "ROUND(AVG(depth), 6) AS depth, ROUND(arg_min(lat, id), 6) AS lat"), _thin_sql("CELL", "", "ROUND(AVG(depth), 6) AS depth, ROUND(AVG(lat), 6) AS lat")]))
def location_thinning(spark, d):
    rows = prep.with_cells(_good(spark, d), 3)
    parts = [prep.thinned(rows, ["type", "ci", "cj", "ck"], kind).select(F.lit(kind).alias("kind"), "id", "value", "time", "depth", "lat", "estd", "nthin") for kind in ("XYZ", "XY", "CELL")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_OBS} SELECT id, type FROM (SELECT id, type, row_number() OVER (ORDER BY id) - 1 AS rn FROM obs) WHERE rn % 4 = 0")
def every_nth_row(spark, d):
    return prep.every_nth(sources.events(spark, d), 4).select("id", "type")


@query(f"{_CELLS}, sob AS (SELECT type, instrument, ci, cj, ck, MIN(id) AS sob_id FROM cells GROUP BY ALL) SELECT cells.id, sob.sob_id FROM cells JOIN sob USING (type, instrument, ci, cj, ck)")
def primary_to_superob(spark, d):
    """Which super-observation each good row went into."""
    rows = prep.with_cells(_good(spark, d), 3)
    keys = prep.superob_keys(rows)
    return prep.with_sob_id(rows, prep.superobs(rows, keys), keys).select("id", "sob_id")


@query(f"{_GOOD} SELECT type, COUNT(DISTINCT (lon, lat)) AS places FROM good GROUP BY type")
def profile_places(spark, d):
    return prep.profile_places(_good(spark, d))


@query(f"WITH {_OBS}, {_status_sql((-10, 10))} SELECT id, CASE WHEN status = 'OK' AND NOT v > 0 THEN 'RANGE' ELSE status END AS status, ROUND(CASE WHEN status = 'OK' AND v > 0 THEN log10(v) END, 6) AS log FROM (SELECT *, value - 20 AS v FROM st)")
def log_transform(spark, d):
    obs = prep.with_status(_obs(spark, d).withColumn("value", F.col("value") - 20), (-10.0, 10.0), log=True)
    return obs.select("id", "status", F.when(F.col("status") == "OK", F.col("value")).alias("log"))


@query(f"WITH {_OBS}, {_status_sql((-10, 10))} SELECT id, CASE WHEN status = 'OK' AND (3 * CAST(floor(fi) AS INT) + CAST(floor(fj) AS INT)) % 7 = 0 THEN 'EXCLUDED' ELSE status END AS status FROM st")
def exclude_mask(spark, d):
    mask = nodes(spark).where((3 * F.col("i") + F.col("j")) % 7 == 0).select("j", "i")
    return prep.with_status(_obs(spark, d), (-10.0, 10.0), mask=mask).select("id", "status")


@query(f"{_GOOD} SELECT id FROM good WHERE type IN ('view', 'purchase')")
def domain_visibility(spark, d):
    """Types seen from domain A: those of all domains or of A that aren't for statistics only."""
    rows = [("view", None, False), ("click", ["B"], False), ("error", None, True), ("purchase", ["A", "B"], False), ("signup", ["A"], True)]
    types = spark.createDataFrame(rows, "type string, domains array<string>, stats_only boolean")
    return prep.visible(_good(spark, d), types, "A").select("id")


# grids ---------------------------------------------------------------------------------------------------------------

_NODES = [-80.0, -60.0, -45.0, -30.0, -20.0, -10.0, 0.0, 10.0, 20.0, 30.0, 45.0, 60.0, 80.0]
_STRETCHED = [-75.0, -65.0, -50.0, -30.0, -5.0, 20.0, 40.0, 55.0, 65.0, 73.0]


def _irregular_sql(n: list[float], x: str) -> str:
    """A cell's number and the part of its width that lies between its node and x; edges leave each node in the middle, or half way."""
    edges = [1.5 * n[0] - 0.5 * n[1]]
    for v in n:
        edges.append(2 * v - edges[-1])
    if any(b <= a for a, b in zip(edges, edges[1:])):  # noqa: B905
        edges = [1.5 * n[0] - 0.5 * n[1], *[(a + b) / 2 for a, b in zip(n, n[1:])], 1.5 * n[-1] - 0.5 * n[-2]]  # noqa: B905
    cells = ", ".join(f"({i}, {n[i]}::DOUBLE, {edges[i]}::DOUBLE, {edges[i + 1]}::DOUBLE)" for i in range(len(n)))
    return f"(SELECT min(c + ({x} - v) / (high - low)) FROM (VALUES {cells}) t(c, v, low, high) WHERE ({x} >= low AND {x} < high) OR ({x} = high AND c = {len(n) - 1}))"


@query(f"WITH {_OBS} SELECT id, ROUND({_irregular_sql(_NODES, 'lat * 1.2')}, 6) AS fj, ROUND({_irregular_sql(_STRETCHED, 'lat')}, 6) AS fs FROM obs")
def irregular_axis(spark, d):
    return sources.events(spark, d).select("id", Axis(tuple(_NODES)).index(F.col("lat") * 1.2).alias("fj"), Axis(tuple(_STRETCHED)).index(F.col("lat")).alias("fs"))


@query(f"WITH {_OBS} SELECT id, ROUND(CASE WHEN lat >= -60 AND lat < 60 THEN (lat + 60) / 10 END, 6) AS open, ROUND((CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END + 180) / 20, 6) AS closed, ROUND(CASE WHEN lon >= 30 AND lon < 200 THEN (200 - lon) / 10 WHEN lon = 200 THEN 0 END, 6) AS falling FROM obs")
def regular_axes(spark, d):
    """An open axis, null beyond its ends; one whose last node is its first; and a falling one."""
    lat, lon = F.col("lat"), F.col("lon")
    axes = Axis(tuple(-60.0 + 10 * i for i in range(13))), Axis(tuple(-180.0 + 20 * i for i in range(19)), cyclic=True), Axis(tuple(200.0 - 10 * i for i in range(18)))
    return sources.events(spark, d).select("id", axes[0].index(lat).alias("open"), axes[1].index(lon).alias("closed"), axes[2].index(lon).alias("falling"))


@query(f"WITH {_OBS} SELECT id, ROUND(5 + 10 * fi, 6) AS lon, ROUND(lat, 6) AS lat FROM g0 WHERE fj IS NOT NULL")
def grid_coordinates(spark, d):
    g = grid(spark)
    return g.located(g.indexed(sources.events(spark, d)).where("fj is not null").drop("lon", "lat")).select("id", "lon", "lat")


@query("SELECT id, ROUND(CASE WHEN z <= 0 THEN -0.5 WHEN z < 25 THEN -0.5 + z / 50 ELSE NULL END, 6) AS top, ROUND((z - 25) / 75, 6) AS zt, ROUND(CASE WHEN z > 950 THEN NULL WHEN z <= 0 THEN 3.5 WHEN z < 25 THEN 3.5 - z / 50 END, 6) AS rising FROM (SELECT event_id AS id, (event_id % 21) * 5.0::DOUBLE - 3 AS z FROM events) WHERE z < 25")
def layer_indices(spark, d):
    """Layers from the surface, between centres, and from the bottom up."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), ((F.col("event_id") % 21) * F.lit(5.0) - 3).alias("z")).where("z < 25")
    z = F.col("z")
    down, up = Layers("z", CENTRES, EDGES), Layers("z", CENTRES[::-1], EDGES[::-1], to_surface=True)
    return rows.select("id", down.index(z).alias("top"), Layers("zt", CENTRES).index(z).alias("zt"), up.index(z).alias("rising"))


@query(f"WITH {_OBS} SELECT id, ROUND(depth, 4) AS z, ROUND(depth, 4) AS z_up, ROUND(depth, 4) AS z_centres FROM obs WHERE depth > 0 AND depth <= 950")
def layer_depths(spark, d):
    """There and back: the depth of a depth's fractional layer."""
    rows, z = sources.events(spark, d).where("depth > 0 and depth <= 950"), F.col("depth")
    down, up, centres = Layers("z", CENTRES, EDGES), Layers("z", CENTRES[::-1], EDGES[::-1], to_surface=True), Layers("zt", CENTRES)
    return rows.select("id", *[F.round(x.depth(x.index(z)), 4).alias(n) for n, x in (("z", down), ("z_up", up), ("z_centres", centres))])


@query("WITH d AS (SELECT event_id AS id, (event_id % 100) * 10.0::DOUBLE - 20 AS depth FROM events) SELECT id, CAST(CASE WHEN depth <= 0 THEN 0 WHEN depth <= 50 THEN 1 WHEN depth <= 150 THEN 2 WHEN depth <= 450 THEN 3 WHEN depth <= 950 THEN 4 END AS INT) AS levels, CAST(CASE WHEN depth <= 0 THEN 0 ELSE 4 END AS INT) AS terrain FROM d WHERE depth <= 950")
def levels_from_depth(spark, d):
    from ..operators.grid import derived_levels

    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), ((F.col("event_id") % 100) * F.lit(10.0) - 20).alias("depth")).where("depth <= 950")
    one = derived_levels(rows, Layers("z", CENTRES, EDGES)).withColumnRenamed("numlevels", "levels")
    return derived_levels(one, Layers("sigma", ((0.0, 0.0),) * 4, ((0.0, 0.0),) * 5)).select("id", "levels", F.col("numlevels").cast("int").alias("terrain"))


@query(f"WITH {_OBS} SELECT id, most = 0 OR (CASE WHEN ceil(fk) = floor(fk) THEN ceil(fk) + 1 ELSE ceil(fk) END > 0 AND most < CASE WHEN ceil(fk) = floor(fk) THEN ceil(fk) + 1 ELSE ceil(fk) END) AS island FROM g0 JOIN c2 USING (id) WHERE fk IS NOT NULL")
def islands(spark, d):
    from ..operators.grid import corner_weights, island

    rows = _obs(spark, d).where("corner_levels is not null and fk is not null")
    return rows.select("id", island(F.col("corner_levels"), corner_weights(F.col("fi"), F.col("fj")), F.col("fk")).alias("island"))


@query(f"WITH {_OBS} SELECT id, {_r('fi', 'fj', 'fk', 'model_depth')}, map_status FROM grid")
def grid_mapping(spark, d):
    return _obs(spark, d).select("id", "fi", "fj", "fk", "model_depth", "map_status")


@query(f"WITH {_OBS} SELECT id, ROUND(h * (20 * -0.5 + h * -0.3) / (20 + h), 6) AS z0, ROUND(h * (20 * -0.1 + h * -0.05) / (20 + h), 6) AS z1, ROUND(10 + 0.25 * (h - 10), 6) AS p0, ROUND(5 + 0.75 * (h - 10), 6) AS p1, ROUND(h * -0.3, 6) AS plain, ROUND(5 + 0.75 * (h - 10), 6) AS between FROM (SELECT id, model_depth + 1 AS h FROM grid WHERE model_depth IS NOT NULL)")
def terrain_layers(spark, d):
    h = F.col("model_depth") + 1
    z, p = M.sigma_layers(h, [-0.5, -0.1], [-0.3, -0.05], 20.0), M.hybrid_layers(F.lit(10.0), h, [10.0, 5.0], [0.25, 0.75])
    return _obs(spark, d).where("model_depth is not null").select("id", z[0].alias("z0"), z[1].alias("z1"), p[0].alias("p0"), p[1].alias("p1"), M.sigma_layers(h, [-0.5], [-0.3], 0.0)[0].alias("plain"), Layers("hybrid", ((5.0, 0.75),), ((5.0, 0.75),)).arrays(p1=h, p2=F.lit(10.0))[0][0].alias("between"))


def _field(spark) -> DataFrame:
    cells = spark.range(36 * 17).select((F.col("id") % 36).cast("int").alias("i"), F.floor(F.col("id") / 36).cast("int").alias("j"))
    return cells.select("i", "j", (48.0 + 5.0 * ((F.col("i") + F.col("j")) % 7)).alias("v"), ((7 * F.col("i") + 3 * F.col("j")) % 5 > 0).alias("wet"))


@query(_GOOD + """, c AS (SELECT id, CAST(floor(fi) AS INT) AS i0, CAST(floor(fj) AS INT) AS j0, fi - floor(fi) AS u, fj - floor(fj) AS v FROM good),
 k AS (SELECT id, CAST(((i0 + di) % 36 + 36) % 36 AS INT) AS i, GREATEST(0, LEAST(16, j0 + dj)) AS j, (CASE WHEN di = 1 THEN u ELSE 1 - u END) * (CASE WHEN dj = 1 THEN v ELSE 1 - v END) AS wt FROM c, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj))
 SELECT id, ROUND(SUM(wt * (48 + 5.0::DOUBLE * ((i + j) % 7))) / SUM(wt), 6) AS hx FROM k WHERE (7 * i + 3 * j) % 5 > 0 AND wt > 0 GROUP BY id""")
def corner_interpolation(spark, d):
    return spatial.interpolated(_good(spark, d), _field(spark), 36, 17)


# ensembles -----------------------------------------------------------------------------------------------------------

_MEAN = "list_sum(e) / 64"


@query(f"{_ENS}, s AS (SELECT n, e, {_MEAN} AS mean FROM ens) SELECT n, ROUND(mean, 6) AS mean, ROUND(sqrt(list_sum(list_transform(e, lambda x: (x - mean) * (x - mean))) / 63), 6) AS obs_spread, ROUND(sqrt(GREATEST(list_sum(list_transform(e, lambda x: x * x)) / 64 - mean * mean, 0)), 4) AS field_spread FROM s", digits=6)
def ensemble_spread(spark, d):
    e = _ensemble(spark, d).withColumn("mean", M.mean_of(F.col("e")))
    return e.select("n", "mean", F.sqrt(M.square_sum(M.anomalies(F.col("e"), F.col("mean"))) / 63).alias("obs_spread"), F.round(F.sqrt(F.greatest(M.square_sum(F.col("e")) / 64 - F.col("mean") * F.col("mean"), F.lit(0.0))), 4).alias("field_spread"))


@query(f"{_ENS}, s AS (SELECT a.n, list_transform(a.e, lambda x: x - list_sum(a.e) / 64) AS p, list_transform(b.e, lambda x: x - list_sum(b.e) / 64) AS q FROM ens a JOIN ens b ON b.n = a.n % 17), z AS (SELECT n, list_dot_product(p, q) AS pq, list_dot_product(p, p) AS pp, list_dot_product(q, q) AS qq FROM s) SELECT n, ROUND(pq / sqrt(pp * qq), 6) AS corr, ROUND(pq / 63, 5) AS cov, ROUND(pq / qq, 6) AS sens FROM z")
def vertical_statistics(spark, d):
    e = _ensemble(spark, d)
    centred = e.select("n", M.anomalies(F.col("e"), M.mean_of(F.col("e"))).alias("p"))
    top = F.broadcast(centred.where("n < 17").select(F.col("n").alias("m"), F.col("p").alias("q")))  # 17 rows
    both = centred.join(top, F.col("n") % 17 == F.col("m")).select("n", M.dot(F.col("p"), F.col("q")).alias("pq"), M.square_sum(F.col("p")).alias("pp"), M.square_sum(F.col("q")).alias("qq"))
    return both.select("n", (F.col("pq") / F.sqrt(F.col("pp") * F.col("qq"))).alias("corr"), F.round(F.col("pq") / 63, 5).alias("cov"), (F.col("pq") / F.col("qq")).alias("sens"))


@query(f"{_ENS} SELECT n, ROUND(list_sum(list_transform(e[1:48], lambda x: (x - md) * kd + md)) + list_sum(list_transform(e[49:64], lambda x: (x - 48) * ks + md)), 4) AS total FROM (SELECT n, e, list_sum(e[1:48]) / 48 AS md, sqrt(63 / 47.0::DOUBLE) AS kd, sqrt(0.5 * 63 / 15.0::DOUBLE) AS ks FROM ens)")
def hybrid_merge(spark, d):
    kd, ks = (63 / 47) ** 0.5, (0.5 * 63 / 15) ** 0.5
    e = _ensemble(spark, d).select("n", F.slice("e", 1, 48).alias("dyn"), F.slice("e", 49, 16).alias("stat")).withColumn("md", M.mean_of(F.col("dyn")))
    merged = F.concat(F.transform("dyn", lambda x: (x - F.col("md")) * kd + F.col("md")), F.transform("stat", lambda x: (x - 48) * ks + F.col("md")))
    return e.select("n", F.round(F.aggregate(merged, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"{_ENS} SELECT n, ROUND(48 + 5.0::DOUBLE * (n % 7) + list_sum(list_transform(range(1, 65), lambda i: (e[i] - m) * (i - 32) / 1000.0::DOUBLE)), 5) AS analysis FROM (SELECT n, e, list_sum(e) / 64 AS m FROM ens)")
def enoi_update(spark, d):
    e = _ensemble(spark, d).withColumn("m", M.mean_of(F.col("e")))
    w = F.transform(F.sequence(F.lit(1), F.lit(MEMBERS)), lambda i: (i - 32) / F.lit(1000.0))
    return e.select("n", F.round(48 + 5.0 * (F.col("n") % 7) + M.dot(M.anomalies(F.col("e"), F.col("m")), w), 5).alias("analysis"))


@query(f"{_ENS}, s AS (SELECT n, list_sum(list_transform(e, lambda x: (x - list_sum(e) / 64) * (x - list_sum(e) / 64))) AS f, CASE n % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 4.0 ELSE 0.5 + (n % 5) / 10.0 END AS share FROM ens) SELECT n, ROUND(CASE WHEN share = 0 THEN 1.1 WHEN 0.5 * sqrt(1 / share) + 0.5 <= 1 THEN 1 ELSE LEAST(1.1, 0.5 * sqrt(1 / share) + 0.5) END, 6) AS inflation FROM s")
def capped_inflation(spark, d):
    """Also where the analysis leaves no spread, and where it has more than the forecast."""
    e = _ensemble(spark, d).select("n", M.square_sum(M.anomalies(F.col("e"), M.mean_of(F.col("e")))).alias("v"))
    share = F.when(F.col("n") % 4 == 0, 0.0).when(F.col("n") % 4 == 1, 4.0).otherwise(0.5 + (F.col("n") % 5) / 10)
    return e.select("n", M.capped_inflation(1.1, 0.5, F.col("v"), F.col("v") * share).alias("inflation"))


# innovations and reports ------------------------------------------------------------------------------------------------


@query(f"{_INN} SELECT id, ROUND(inn, 6) AS inn, ROUND(sqrt(sqrt((9 + estd * estd) * (9 + estd * estd) + 9 * inn * inn / 4) - 9), 6) AS estd_new, ROUND(inn / (estd * sqrt(2.0) * sqrt(63.0)), 6) AS s FROM inn")
def moderated_errors(spark, d):
    e = M.moderated(F.col("estd"), F.lit(3.0), F.col("inn"), 2.0)
    return _with_inn(spark, d).select("id", "inn", e.alias("estd_new"), (F.col("inn") / (F.col("estd") * F.sqrt(F.lit(2.0)) * F.sqrt(F.lit(63.0)))).alias("s"))


@query(f"{_INN} SELECT type, file, batch, COUNT(*) AS n, ROUND(AVG(abs(inn)) + 1e-9, 6) AS mad, ROUND(AVG(inn) + 1e-9, 6) AS bias FROM inn GROUP BY ALL")
def batch_statistics(spark, d):
    return _decided(prep.batch_stats(_with_inn(spark, d)))


@query(f"{_INN}, b AS (SELECT type, file, batch FROM inn GROUP BY ALL HAVING COUNT(*) >= 3 AND (abs(AVG(inn)) >= 20 OR AVG(abs(inn)) >= 30)) SELECT inn.id, CASE WHEN b.type IS NULL THEN 'OK' ELSE 'BADBATCH' END AS status FROM inn LEFT JOIN b USING (type, file, batch)")
def bad_batches(spark, d):
    obs = _with_inn(spark, d)
    return prep.marked_bad(obs, prep.bad_batches(prep.batch_stats(obs), 20.0, 30.0, 3)).select("id", "status")


@query(f"{_INN} SELECT type, COUNT(DISTINCT (file, batch)) AS batches FROM inn GROUP BY type")
def distinct_batches(spark, d):
    return _with_inn(spark, d).groupBy("type").agg(F.countDistinct("file", "batch").alias("batches"))


_REGION_SQL = "(VALUES " + ", ".join(f"('{r[0]}', {r[1]}::DOUBLE, {r[2]}::DOUBLE, {r[3]}::DOUBLE, {r[4]}::DOUBLE)" for r in REGIONS) + ") r(region, west, east, south, north)"
_LAYERS_SQL = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in LAYERS) + ") z(layer, z1, z2)"


def regions(spark: SparkSession) -> DataFrame:
    return _small(spark, REGIONS, "region string, west double, east double, south double, north double")


def _stats_sql(size: str) -> str:
    report = f"COUNT(*) AS n, ROUND({size} + 1e-9, 6) AS dev_f, ROUND(AVG(inn) + 1e-9, 6) AS inn_f, ROUND(AVG(estd) + 1e-9, 6) AS std_f"
    return f"""{_INN}, m AS (SELECT region, inn.*, CAST(floor(time + 0.5) AS INT) AS slot FROM inn JOIN {_REGION_SQL} ON lat BETWEEN south AND north AND (CASE WHEN west <= east THEN lon >= west AND lon <= east ELSE lon >= west OR lon <= east END))
 SELECT region, type, 'all' AS kind, NULL AS part, {report} FROM m GROUP BY region, type UNION ALL SELECT region, type, 'slot', CAST(slot AS VARCHAR), {report} FROM m GROUP BY region, type, slot
 UNION ALL SELECT region, type, 'instrument', instrument, {report} FROM m GROUP BY region, type, instrument UNION ALL SELECT region, type, 'depth', layer, {report} FROM m JOIN {_LAYERS_SQL} ON depth >= z1 AND depth < z2 GROUP BY region, type, layer"""


def _report(spark: SparkSession, d: str, rmsd: bool) -> DataFrame:
    obs = _with_inn(spark, d).withColumnRenamed("inn", "inn_f").withColumn("std_f", F.col("estd"))
    layers = spark.createDataFrame(LAYERS, "layer string, z1 double, z2 double")
    return _decided(diag.observation_stats(obs, regions(spark), layers, 1.0, rmsd))


@query(_stats_sql("AVG(abs(inn))"))
def forecast_stats(spark, d):
    """The report by region and type, each also by time slot, by instrument and by depth, in one pass."""
    return _report(spark, d, False)


@query(_stats_sql("sqrt(AVG(inn * inn))"))
def forecast_stats_rmsd(spark, d):
    return _report(spark, d, True)


_LAYER_SQL = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in LAYERS) + ") z(layer, z1, z2)"


@query(f"{_INN} SELECT type, layer, COUNT(*) AS n, ROUND(AVG(abs(inn)) + 1e-9, 6) AS mad, ROUND(AVG(inn) + 1e-9, 6) AS bias FROM inn JOIN {_LAYER_SQL} ON depth >= z1 AND depth < z2 GROUP BY type, layer")
def stats_by_depth(spark, d):
    layers = _small(spark, LAYERS, "layer string, z1 double, z2 double")
    return _decided(_with_inn(spark, d).join(layers, (F.col("depth") >= F.col("z1")) & (F.col("depth") < F.col("z2"))).groupBy("type", "layer").agg(F.count("*").alias("n"), F.avg(F.abs("inn")).alias("mad"), F.avg("inn").alias("bias")))


# local analyses -----------------------------------------------------------------------------------------------------------

RADIUS = 1200.0


def _nodes(spark: SparkSession) -> DataFrame:
    return spatial.with_xyz(spark.range(12 * 6).select(F.col("id").cast("int").alias("node"), (5.0 + 30 * (F.col("id") % 12)).alias("lon"), (-75.0 + 30 * F.floor(F.col("id") / 12)).alias("lat")))


def _cells(spark: SparkSession) -> DataFrame:
    """The cells of the grid that are not land: their nodes and layers."""
    i, j = F.col("id") % 36, F.floor(F.col("id") / 36)
    cells = spark.range(36 * 17).select(F.col("id").cast("int").alias("node"), (5.0 + 10 * i).alias("lon"), (-80.0 + 10 * j).alias("lat"), ((7 * i + 3 * j) % 5).cast("int").alias("numlevels"))
    return spatial.with_xyz(cells.where("numlevels > 0"))


def _pairs(spark: SparkSession, d: str, nodes: DataFrame | None = None) -> DataFrame:
    """The SQL's nodes, 30 degrees apart, if no others are given."""
    obs = spatial.with_xyz(_with_inn(spark, d).select("id", "type", "lon", "lat", "inn", "estd")).drop("lon", "lat")
    return spatial.within(_nodes(spark) if nodes is None else nodes, obs, RADIUS).withColumn("coeff", M.multi_taper(F.col("d"), (RADIUS, RADIUS / 2), (0.7, 0.3)))


def _xyz_sql(lon: str, lat: str, p: str) -> str:
    return f"6371.0::DOUBLE * cos(radians({lon})) * cos(radians({lat})) AS {p}x, 6371.0::DOUBLE * sin(radians({lon})) * cos(radians({lat})) AS {p}y, 6371.0::DOUBLE * sin(radians({lat})) AS {p}z"


def _taper_sql(radius: float) -> str:
    x = f"(d * 2 / {radius}::DOUBLE)"
    return f"(CASE WHEN {x} < 1 THEN 1 + {x}*{x}*(-5/3.0::DOUBLE + {x}*(0.625::DOUBLE + {x}*(0.5::DOUBLE - {x}*0.25::DOUBLE))) WHEN {x} < 2 THEN 4 - 5*{x} + {x}*{x}*(5/3.0::DOUBLE + {x}*(0.625::DOUBLE + {x}*(-0.5::DOUBLE + {x}/12))) - 2/(3*{x}) ELSE 0 END)"


_PAIRS = f"""{_INN}, nodes AS (SELECT node, {_xyz_sql('nlon', 'nlat', 'n')} FROM (SELECT CAST(i AS INT) AS node, 5.0::DOUBLE + 30 * (i % 12) AS nlon, -75.0::DOUBLE + 30 * (i // 12) AS nlat FROM range(72) t(i))),
 o AS (SELECT id, type, inn, estd, {_xyz_sql('lon', 'lat', '')} FROM inn), p0 AS (SELECT node, id, type, inn, estd, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y) + (nz-z)*(nz-z)) AS d FROM nodes, o),
 pairs AS (SELECT *, 0.7::DOUBLE * {_taper_sql(RADIUS)} + 0.3::DOUBLE * (CASE WHEN d <= {RADIUS / 2} THEN {_taper_sql(RADIUS / 2)} ELSE 0 END) AS coeff FROM p0 WHERE d <= {RADIUS})"""


@query(f"{_PAIRS} SELECT node, id, ROUND(d, 5) AS d, ROUND(coeff, 6) AS coeff FROM pairs")
def range_join(spark, d):
    return _pairs(spark, d).select("node", "id", F.round("d", 5).alias("d"), "coeff")


@query(f"{_PAIRS} SELECT node, type, id, CAST(rn AS INT) AS place FROM (SELECT node, type, id, row_number() OVER (PARTITION BY node, type ORDER BY d, id) AS rn FROM pairs) WHERE rn <= 5")
def nearest_per_type(spark, d):
    return spatial.nearest(_pairs(spark, d), 5).select("node", "type", "id", "place")


@query(f"{_PAIRS}, c AS (SELECT node, COUNT(*) AS n, SUM(coeff) AS s FROM pairs GROUP BY node) SELECT nodes.node, COALESCE(n, 0) AS nlobs, ROUND(COALESCE(s, 0), 5) AS weight FROM nodes LEFT JOIN c USING (node)")
def local_counts(spark, d):
    counted = _pairs(spark, d).groupBy("node").agg(F.count("*").alias("n"), F.sum("coeff").alias("s"))
    return _nodes(spark).select("node").join(counted, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("nlobs"), F.round(F.coalesce("s", F.lit(0.0)), 5).alias("weight"))


_ONE = f"{_ENS}, s AS (SELECT n, list_transform(e, lambda x: (x - list_sum(e) / 64) / (20 * sqrt(63.0::DOUBLE))) AS s, (n % 13 - 6) / 10.0::DOUBLE AS inn FROM ens), q AS (SELECT *, list_dot_product(s, s) AS q FROM s)"


@query(f"{_ONE} SELECT CAST(n AS INT) AS node, ROUND(q / (1 + q), 6) AS dfs, ROUND(sqrt(1 + q) - 1, 6) AS srf, ROUND(s[1] / (1 + q) * inn, 6) AS w1, ROUND(1 - s[1] * s[1] / (2 * (1 + q)), 6) AS t11, ROUND(-s[1] * s[2] / (2 * (1 + q)), 6) AS t12 FROM q")
def single_observation_denkf(spark, d):
    return _single(spark, d, "DENKF")


@query(f"{_ONE} SELECT CAST(n AS INT) AS node, ROUND(q / (1 + q), 6) AS dfs, ROUND(sqrt(1 + q) - 1, 6) AS srf, ROUND(s[1] / (1 + q) * inn, 6) AS w1, ROUND(1 - s[1] * s[1] / (1 + q + sqrt(1 + q)), 6) AS t11, ROUND(-s[1] * s[2] / (1 + q + sqrt(1 + q)), 6) AS t12 FROM q")
def single_observation_etkf(spark, d):
    return _single(spark, d, "ETKF")


def _standardised(e: Column, estd: float) -> Column:
    return F.transform(M.anomalies(e, M.mean_of(e)), lambda x: x / (estd * 63**0.5))


def _single(spark: SparkSession, d: str, scheme: str) -> DataFrame:
    rows = _ensemble(spark, d).select(F.col("n").cast("int").alias("node"), F.lit(1).alias("id"), F.lit(1.0).alias("coeff"), _standardised(F.col("e"), 20.0).alias("s"), ((F.col("n") % 13 - 6) / 10).alias("inn"))
    return kernel.local_analyses(rows, scheme).select("node", "dfs", "srf", F.col("w")[0].alias("w1"), F.col("t")[0].alias("t11"), F.col("t")[1].alias("t12"))


@query("SELECT CAST(k AS INT) AS k, ROUND(CASE WHEN u < -1 THEN 1 WHEN u > 1 THEN 0 ELSE (cos((u + 1) * pi() / 2) + 1) / 2 END, 6) AS weight FROM (SELECT k, (k * 5.0::DOUBLE / 100 - 1) / 0.1::DOUBLE AS u FROM range(40) t(k))")
def mixed_layer_taper(spark, d):
    return spark.range(40).select(F.col("id").cast("int").alias("k"), M.surface_weight(F.lit(100.0), F.col("id") * 5.0).alias("weight"))


@query(f"{_ENS} SELECT CAST(n // 10 AS BIGINT) AS column_id, ROUND(SUM(list_sum(e)), 3) AS vertsum, ROUND(SUM(list_sum(e) * (1 + n % 10)) / SUM(1 + n % 10), 4) AS vertwavg FROM ens GROUP BY 1")
def vertical_sums(spark, d):
    s = _ensemble(spark, d).select(F.floor(F.col("n") / 10).alias("column_id"), (1 + F.col("n") % 10).alias("w"), F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("v"))
    return s.groupBy("column_id").agg(F.round(F.sum("v"), 3).alias("vertsum"), F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 4).alias("vertwavg"))
