"""Queries of the product readers: raw tables in the shapes of the products' files, made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Layers
from ..sources import products as P
from ..sources import store
from .core import _r, query

_L = "WITH l AS (SELECT vec_id AS v, CAST(p - 1 AS INT) AS n, CAST(embedding[p] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(p))"


def _levels(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("v"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _each(f) -> Column:
    """An array of f(x, n) over the values x and their places n."""
    return F.transform("x", f)


def _nested(flat: Column, *shape: int) -> Column:
    """A flat array as nested ones."""
    if len(shape) == 1:
        return flat
    size = 1
    for n in shape[1:]:
        size *= n
    return F.transform(F.sequence(F.lit(0), F.lit(shape[0] - 1)), lambda j: _nested(F.slice(flat, j * size + 1, size), *shape[1:]))


@query("SELECT event_id AS id, ROUND(value * 1.5 - 3 + user_id % 5 - event_id % 3, 6) AS value, ROUND(GREATEST(0.1 * (user_id % 4), 0.25::DOUBLE), 6) AS estd, concat('PRE', COALESCE(CASE WHEN user_id % 3 <> 0 THEN concat('S', user_id % 3) END, 'PROD')) AS instrument, ROUND(15000 + (event_id % 48) / 24.0::DOUBLE, 6) AS time, 7.5::DOUBLE AS depth FROM events WHERE event_id % 4 IN (1, 2) AND value IS NOT NULL".replace("value * 1.5 - 3 + user_id % 5 - event_id % 3", "(value + user_id % 5 - event_id % 3) * 1.5 - 3"))
def reader_scattered(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "value", (F.col("user_id") % 5).alias("plus"), (F.col("event_id") % 3).alias("minus"), (0.1 * (F.col("user_id") % 4)).alias("std"), F.lit(0.25).alias("error_std"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("S"), F.col("user_id") % 3)).alias("sensor"), (F.col("event_id") % 48).alias("time"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), (F.col("event_id") % 4).alias("qc"), F.col("event_id").alias("batch"))
    s = P.Section("PROD", "scattered", "X", flags={"qc": (1, 2)}, scale=1.5, shift=-3.0, zvalue=7.5, add="plus", subtract="minus", units="hours since 2011-01-26", prefix="PRE")
    return P.read(raw, s).select(F.col("batch").alias("id"), "value", "estd", "instrument", (F.col("time")).alias("time"), "depth")


@query(_L + f" SELECT v AS batch, ROUND(x, 6) AS value, CAST(n % 8 AS DOUBLE) * 2 AS lon, CAST(n // 8 AS DOUBLE) AS lat, ROUND(100 + (n // 8) / 24.0::DOUBLE, 6) AS time FROM l WHERE (v + n) % 5 <> 0")
def reader_gridded_xy(spark, d):
    """Records whose rows have their own times; cells without points are none."""
    e = _levels(spark, d)
    axis = lambda f: F.transform(F.sequence(F.lit(0), F.lit(7)), f)
    raw = e.select(F.col("v").alias("batch"), _nested(F.col("x"), 8, 8).alias("sst"), _nested(_each(lambda x, n: ((F.col("v") + n) % 5).cast("int")), 8, 8).alias("npoints"), axis(lambda i: i * 2.0).alias("lon"), axis(lambda j: j * 1.0).alias("lat"), axis(lambda j: 2400 + j).alias("time"))
    return P.read(raw, P.Section("P", "gridded_xy", "SST", "sst", units="hours since 1970-01-01")).select("batch", "value", "lon", "lat", "time")


@query(_L + " SELECT ROUND(x, 6) AS value, CAST(n % 4 AS DOUBLE) AS lon, CAST((n // 4) % 4 AS DOUBLE) AS lat, CAST(n // 16 AS DOUBLE) * 10 AS depth, CAST(v AS DOUBLE) AS time FROM l WHERE n % 3 <> 0")
def reader_gridded_xyz(spark, d):
    axis = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), f)
    raw = _levels(spark, d).select(_nested(F.col("x"), 4, 4, 4).alias("temp"), _nested(_each(lambda x, n: (n % 3).cast("int")), 4, 4, 4).alias("npoints"), axis(lambda i: i * 1.0).alias("lon"), axis(lambda i: i * 1.0).alias("lat"), axis(lambda k: k * 10.0).alias("z"), F.col("v").alias("time"))
    return P.read(raw, P.Section("P", "gridded_xyz", "TEM", "temp")).select("value", "lon", "lat", "depth", "time")


@query(_L + " SELECT ROUND(x, 6) AS value, ROUND((5 + 10 * (n // 16)) + (0.1::DOUBLE + 0.2::DOUBLE * (n // 16)) * (100 + n % 4 - 20), 6) AS depth, CAST(v AS DOUBLE) AS time FROM l")
def reader_gridded_xyh(spark, d):
    """Layers of a hybrid source grid, whose depths depend on two pressures at each place."""
    centres = tuple((5.0 + 10 * k, 0.1 + 0.2 * k) for k in range(4))
    edges = ((0.0, 0.0), *((10.0 * k, 0.2 * k) for k in range(1, 5)))
    axis = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), f)
    plane = lambda f: axis(lambda j: axis(lambda i: f(j, i)))
    raw = _levels(spark, d).select(_nested(F.col("x"), 4, 4, 4).alias("temp"), axis(lambda i: i * 1.0).alias("lon"), axis(lambda i: i * 1.0).alias("lat"), plane(lambda j, i: 100.0 + i).alias("p1"), plane(lambda j, i: F.lit(20.0)).alias("p2"), F.col("v").alias("time"))
    return P.gridded_xyh(raw, P.Section("P", "gridded_xyh", "TEM", "temp"), Layers("hybrid", centres, edges)).select("value", "depth", "time")


@query(_L + " SELECT v AS batch, ROUND(x, 6) AS value, n * 25.0::DOUBLE AS depth, ROUND(v + n / 1440.0::DOUBLE, 6) AS time, concat('T', v % 3) AS instrument FROM l WHERE (v + n) % 4 <> 0 AND v % 3 <> 1")
def reader_profile(spark, d):
    """Profiles with times by level, flags, and an instrument that is left out."""
    raw = _levels(spark, d).select(F.col("v").alias("profile"), F.col("x").alias("t"), _each(lambda x, n: n * 25.0).alias("z"), _each(lambda x, n: F.when((F.col("v") + n) % 4 != 0, 1).otherwise(0)).alias("q"), _each(lambda x, n: F.col("v") * 1440 + n).alias("time"), F.concat(F.lit("T"), F.col("v") % 3).alias("instrument"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return P.read(raw, P.Section("P", "profile", "TEM", "t", flags={"q": (1,)}, units="minutes since 1970-01-01", exclude_instruments=("T1",))).select("batch", "value", "depth", "time", "instrument")


@query(_L + """, c AS (SELECT v, n, CASE WHEN v % 3 = 0 THEN CASE WHEN (v + n) % 5 <> 0 THEN 11 + 40 * x END ELSE CASE WHEN (v + n) % 4 <> 0 THEN 10 + 40 * x END END AS value, CASE WHEN n % 6 <> 5 THEN n * 25.0::DOUBLE ELSE n * 25.0::DOUBLE + 1 END AS depth FROM l)
 SELECT v AS batch, ROUND(value, 5) AS value, depth, concat('WMO', CASE WHEN v % 7 = 0 THEN '999' ELSE lpad(CAST(v % 900 AS VARCHAR), 3, '0') END) AS instrument FROM c WHERE value >= -2 AND value <= 40""", digits=5)
def reader_cmems(spark, d):
    """Adjusted values where a profile has any, the first good depth, and only values of the valid range."""
    v = F.col("v")
    some = lambda c, other: F.when(c, F.lit("1")).otherwise(F.lit(other))
    raw = _levels(spark, d).select(
        v.alias("profile"), _each(lambda x, n: 10 + 40 * x).alias("TEMP"), _each(lambda x, n: some((v + n) % 4 != 0, "4")).alias("TEMP_QC"),
        _each(lambda x, n: F.when(v % 3 == 0, 11 + 40 * x)).alias("TEMP_ADJUSTED"), _each(lambda x, n: some((v + n) % 5 != 0, "3")).alias("TEMP_ADJUSTED_QC"),
        _each(lambda x, n: n * 25.0).alias("DEPH"), _each(lambda x, n: some(n % 6 != 5, "9")).alias("DEPH_QC"), _each(lambda x, n: n * 25.0 + 1).alias("PRES"), _each(lambda x, n: some(F.col("v") >= 0, "9")).alias("PRES_QC"),
        F.lit(10.0).alias("LONGITUDE"), F.lit(-10.0).alias("LATITUDE"), F.lit(7000.0).alias("JULD"), F.when(v % 7 == 0, "none").otherwise((v % 900).cast("string")).alias("WMO_INST_TYPE"),
    )
    return P.read(raw, P.Section("CORA", "cmems", "TEM", "TEMP", units="days since 1950-01-01")).select("batch", "value", "depth", "instrument")


@query(_L + " SELECT CAST((v + n) % 5 AS INT) AS flag, COUNT(*) AS n FROM l GROUP BY 1")
def qc_flag_histogram(spark, d):
    raw = _levels(spark, d).select(_each(lambda x, n: ((F.col("v") + n) % 5).cast("string")).alias("TEMP_QC"))
    return P.flag_counts(raw, "TEMP")


@query(_L + " SELECT v AS batch, ROUND(x, 6) AS value, n * 2.0::DOUBLE AS depth, ROUND(v - 7305.0::DOUBLE, 6) AS time FROM l WHERE v % 4 <> 0 AND (v * n) % 3 = 0")
def reader_mmt(spark, d):
    """Profiles that are 0 throughout have no data."""
    raw = _levels(spark, d).select(F.col("v").alias("profile"), _each(lambda x, n: F.when(F.col("v") % 4 != 0, x).otherwise(0.0)).alias("TEMP_BLUELINK"), _each(lambda x, n: ((F.col("v") * n) % 3).cast("int")).alias("TEMP_BLUELINK_QC"), _each(lambda x, n: n * 2.0).alias("PRES_BLUELINK"), F.lit(1.0).alias("LONGITUDE"), F.lit(1.0).alias("LATITUDE"), F.col("v").alias("JULD"))
    return P.read(raw, P.Section("MMT", "mmt", "TEM", units="days since 1950-01-01")).select("batch", "value", "depth", "time")


@query(_L + " SELECT v AS batch, ROUND(x, 6) AS value, n * 3.0::DOUBLE AS depth FROM l WHERE (v + n) % 2 = 1 AND n % 7 <> 6")
def reader_en4(spark, d):
    raw = _levels(spark, d).select(F.col("v").alias("profile"), F.col("x").alias("PSAL_CORRECTED"), _each(lambda x, n: ((F.col("v") + n) % 2).cast("string")).alias("PSAL_CORRECTED_QC"), _each(lambda x, n: F.when(n % 7 != 6, n * 3.0)).alias("DEPH_CORRECTED"), F.lit(1.0).alias("LONGITUDE"), F.lit(1.0).alias("LATITUDE"), F.lit(0.0).alias("JULD"))
    return P.read(raw, P.Section("EN4", "en4", "SAL")).select("batch", "value", "depth")


def _daily(spark, d, name: str) -> DataFrame:
    file = F.concat(F.lit(f"/data/{name}_202401"), F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0"), F.lit(".nc"))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("double").alias("lon"), (F.col("event_id") % 90).cast("double").alias("lat"), F.col("value").alias("sst"), (F.col("event_id") % 3 * 0.5).alias("SST_bias"), (F.col("event_id") % 5 * 0.25).alias("sses_bias"), F.lit(0.3).alias("error"), (F.col("event_id") % 24).alias("GMT_time"), F.when(F.col("event_id") % 28 < 7, 0.0).otherwise(F.col("event_id") % 10 / F.lit(10.0)).alias("age"), file.alias("file"))


_DAY = "19723 + event_id % 28"


@query(f"SELECT CAST(event_id AS DOUBLE) AS lon, ROUND(value + (event_id % 3) * 0.5, 6) AS value, ROUND({_DAY} + (event_id % 24) / 24.0::DOUBLE, 6) AS time, 'AVHRR' AS instrument FROM events WHERE value IS NOT NULL")
def reader_navo(spark, d):
    return P.read(_daily(spark, d, "navo"), P.Section("NAVO", "navo", "SST", units="hours", add_bias=True)).select("lon", "value", "time", "instrument")


@query(f"SELECT CAST(event_id AS DOUBLE) AS lon, ROUND(value, 6) AS value, ROUND({_DAY} + CASE WHEN event_id % 28 < 7 THEN 0.5 ELSE (event_id % 10) / 10.0::DOUBLE END, 6) AS time FROM events WHERE value IS NOT NULL")
def reader_windsat(spark, d):
    """Files whose ages are all 0 have none."""
    return P.read(_daily(spark, d, "windsat"), P.Section("WindSat", "windsat", "SST", units="days")).select("lon", "value", "time")


@query(f"SELECT CAST(event_id AS DOUBLE) AS lon, ROUND(value + (event_id % 5) * 0.25, 6) AS value, ROUND({_DAY} + CASE WHEN event_id % 28 < 7 THEN 0 ELSE (event_id % 10) / 10.0::DOUBLE END, 6) AS time, 0.3::DOUBLE AS estd FROM events WHERE value IS NOT NULL")
def reader_amsr2(spark, d):
    return P.read(_daily(spark, d, "amsr2"), P.Section("AMSR2", "amsr2", "SST", units="days", add_bias=True)).select("lon", "value", "time", "estd")


@query(_L + ", o AS (SELECT 0 AS batch, v, n, x AS value, (v + n) % 12 AS wind FROM l UNION ALL SELECT 1, v, n, 2 * x, (v + 2 * n) % 12 FROM l) SELECT batch::BIGINT AS batch, ROUND(value, 6) AS value, CAST(n % 8 AS DOUBLE) AS lon, CAST(n // 8 AS DOUBLE) AS lat, ROUND(19723 + v % 28 + (n % 24) / 24.0::DOUBLE, 6) AS time, 0.25::DOUBLE AS estd FROM o WHERE wind >= 5")
def reader_amsre(spark, d):
    """Both orbits, where the wind is enough."""
    v = F.col("v")
    axis = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 1.0)
    grid8 = lambda f: _nested(_each(f), 8, 8)
    raw = _levels(spark, d).select(grid8(lambda x, n: x).alias("a_sst"), grid8(lambda x, n: 2 * x).alias("d_sst"), grid8(lambda x, n: (v + n) % 12).alias("a_wind"), grid8(lambda x, n: (v + 2 * n) % 12).alias("d_wind"), grid8(lambda x, n: n % 24).alias("a_time"), grid8(lambda x, n: n % 24).alias("d_time"), axis.alias("lon"), axis.alias("lat"), F.concat(F.lit("amsre_202401"), F.lpad((v % 28 + 1).cast("string"), 2, "0")).alias("file"))
    return P.read(raw, P.Section("AMSRE", "amsre", "SST", units="hours")).select("batch", "value", "lon", "lat", "time", "estd")


@query(f"SELECT * FROM (SELECT 'A' AS product, COUNT(*) AS n, ROUND(SUM(value), 3) AS total FROM events WHERE value IS NOT NULL UNION ALL SELECT 'B', COUNT(*), ROUND(SUM(value + (event_id % 5) * 0.25), 3) FROM events WHERE value IS NOT NULL)", digits=3)
def sections_appended(spark, d):
    raw = _daily(spark, d, "x")
    rows = P.read_all([(raw, P.Section("A", "windsat", "SST", units="days")), (raw, P.Section("B", "amsr2", "SST", units="days", add_bias=True))])
    return rows.groupBy("product").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("WITH f AS (SELECT event_id AS record, concat('f', event_id % 9) AS file, 100 + (event_id % 40) * 0.25::DOUBLE + CASE WHEN event_id % 5 = 0 THEN 0.1 ELSE 0 END AS time FROM events) SELECT CAST(round((time - 105) / 0.5) AS INT) AS slot, file, record FROM f WHERE abs((time - 105) / 0.5 - round((time - 105) / 0.5)) * 0.5 < 0.001")
def records_by_slot(spark, d):
    """Files' records that lie at whole steps from analysis time."""
    e = F.col("event_id")
    files = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("f"), e % 9).alias("file"), e.alias("record"), (F.lit(100.0) + (e % 40) * 0.25 + F.when(e % 5 == 0, 0.1).otherwise(0.0)).alias("time"))
    return store.matching(files, 105.0, 0.5).select("slot", "file", "record")
