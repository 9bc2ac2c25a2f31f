"""Observation products: the variables of their files, as columns of a raw table, turned into observations.

A raw table has a row for each point, profile or record, with arrays where the product's variables have more dimensions;
whatever lists files gives ``file``. Every reader gives id-less observations with the same columns (``COLUMNS``), so
sections of several products are appended by name. Rows without a value, place or good flag are not observations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = {"product": "string", "instrument": "string", "file": "string", "batch": "long", "type": "string", "value": "double", "estd": "double", "lon": "double", "lat": "double", "depth": "double", "time": "double"}
#: fixed values: names that stand for coordinates and instruments, and valid ranges of profile variables
NAMES = {"lon": ("lon", "longitude"), "lat": ("lat", "latitude"), "depth": ("depth", "z"), "time": ("time", "Time", "TIME")}
INSTRUMENTS = ("instrument", "INSTRUMENT", "platform", "PLATFORM", "sensor", "SENSOR")
RANGES = {"TEM": (-2.0, 40.0), "SAL": (0.0, 50.0)}
#: days in a unit of time
UNITS = {"microsec": 1 / 86400e6, "millisec": 1 / 86400e3, "sec": 1 / 86400, "hour": 1 / 24, "day": 1.0, "min": 1 / 1440}


@dataclass(frozen=True)
class Section:
    """One product's section: what to read and how. Parameters that a reader doesn't know are an error."""

    product: str
    reader: str
    type: str
    variable: str = "value"
    flags: dict[str, tuple[int, ...]] = field(default_factory=dict)
    shift: float = 0.0
    scale: float = 1.0
    estd: float | None = None
    zvalue: float | None = None
    zname: str | None = None
    add: str | None = None
    subtract: str | None = None
    batch: str | None = None
    footprint: float = 0.0
    stride: int = 1
    min_depth: float | None = None
    max_depth: float | None = None
    y: tuple[float | None, float | None] = (None, None)
    z: tuple[float | None, float | None] = (None, None)
    thinning: str = "XYZ"
    mandatory: bool = False
    units: str = "days since 1970-01-01"
    exclude_instruments: tuple[str, ...] = ()
    prefix: str = ""
    add_bias: bool = False
    min_wind: float | None = None
    orbits: str = "ALL"  # or ASCENDING, DESCENDING


def decoded(time: Column, units: str) -> Column:
    """Days since 1970-01-01 of a time in "units since date"."""
    unit, _, origin = units.strip().partition(" since ")
    scale = next((v for k, v in UNITS.items() if unit.strip().lower().startswith(k)), None)
    if scale is None or not origin:
        raise ValueError(f"time in {units!r}")
    base = F.unix_micros(F.lit(origin.strip()).cast("timestamp")) / F.lit(86400e6)
    return time.cast("double") * scale + base


def date_of(path: Column) -> Column:
    """Days since 1970 of the last eight digits in a file's name."""
    return F.datediff(F.to_date(F.regexp_extract(path, r"(\d{8})(?!.*\d{8})", 1), "yyyyMMdd"), F.lit("1970-01-01").cast("date")).cast("double")


def _column(raw: DataFrame, *names: str | None) -> Column | None:
    """The first of the columns that there is."""
    return next((F.col(n) for n in names if n and n in raw.columns), None)


def _or_null(c: Column | None, kind: str = "double") -> Column:
    return F.lit(None).cast(kind) if c is None else c.cast(kind)


def instrument_of(raw: DataFrame, s: Section) -> Column:
    """The variable's or file's instrument, or else the product."""
    known = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in INSTRUMENTS if n in raw.columns]
    tag = F.coalesce(*known, F.lit(s.product))
    return F.concat(F.lit(s.prefix), tag) if s.prefix else tag


def flagged(raw: DataFrame, flags: dict[str, tuple[int, ...]]) -> Column:
    """Whether every flag has one of its allowed values; characters count as their digit."""
    ok = F.lit(True)
    for name, allowed in flags.items():
        ok = ok & F.coalesce(F.col(name).cast("int").isin(*allowed), F.lit(False))
    return ok


def error_of(raw: DataFrame, s: Section) -> Column:
    """The larger of the row's errors, or else the section's."""
    errors = [F.col(c).cast("double") for c in ("std", "error_std") if c in raw.columns]
    given = F.greatest(*errors) if len(errors) == 2 else errors[0] if errors else F.lit(None).cast("double")
    return F.coalesce(given, F.lit(s.estd).cast("double"))


def _observations(rows: DataFrame, s: Section, **columns: Column) -> DataFrame:
    value = columns["value"] * s.scale + s.shift if (s.scale, s.shift) != (1.0, 0.0) else columns["value"]
    columns = {"product": F.lit(s.product), "type": F.lit(s.type), "file": _or_null(_column(rows, "file"), "string"), **columns, "value": value}
    out = rows.select(*[_or_null(columns.get(c), kind).alias(c) for c, kind in COLUMNS.items()])
    known = F.col("value").isNotNull() & ~F.isnan("value") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    out = out.where(known)
    if s.exclude_instruments:
        out = out.where(~F.coalesce(F.col("instrument").isin(*s.exclude_instruments), F.lit(False)))
    return out.withColumn("footprint", F.lit(float(s.footprint)))


def _place(raw: DataFrame, s: Section) -> dict[str, Column]:
    return {"lon": _column(raw, *NAMES["lon"]), "lat": _column(raw, *NAMES["lat"]), "time": decoded(_column(raw, *NAMES["time"]), s.units), "instrument": instrument_of(raw, s)}


def scattered(raw: DataFrame, s: Section) -> DataFrame:
    """Points; a depth variable or one depth for all; another variable may be added or taken off."""
    if s.zname and s.zvalue is not None:
        raise ValueError("either ZNAME or ZVALUE")
    rows = raw.where(flagged(raw, s.flags))
    value = F.col(s.variable).cast("double")
    value = value + F.col(s.add) if s.add else value
    value = value - F.col(s.subtract) if s.subtract else value
    depth = F.lit(s.zvalue) if s.zvalue is not None else _column(raw, s.zname, *NAMES["depth"])
    return _observations(rows, s, **_place(raw, s), value=value, estd=error_of(raw, s), depth=depth, batch=_column(raw, s.batch, "batch"))


def _exploded(raw: DataFrame, arrays: list[str], *indices: str) -> DataFrame:
    """raw with nested arrays of equal shapes cut into rows, along as many dimensions as there are indices."""
    for index in indices:
        zipped = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
        others = [c for c in raw.columns if c not in arrays]
        raw = raw.select(*others, F.posexplode(zipped).alias(index, "__x")).select(*others, index, *[F.col(f"__x.{a}").alias(a) for a in arrays])
    return raw


def _at(raw: DataFrame, name: str, *indices: str) -> Column:
    """A coordinate of an exploded row: a number, or an array along the last index that it depends on, or along all."""
    c, kind = F.col(name), raw.schema[name].dataType.simpleString()
    depth = kind.count("array<")
    for index in indices[len(indices) - depth :] if depth else ():
        c = F.get(c, F.col(index))
    return c


def gridded_xy(raw: DataFrame, s: Section) -> DataFrame:
    """Records of value[j][i] with coordinates along each axis or of each cell; cells without points (npoints 0) are none.

    Time is the record's, each row's, or each cell's. Depth is 0 unless ZVALUE is given.
    """
    arrays = [s.variable, *[c for c in ("std", "error_std", "npoints", *s.flags) if c in raw.columns]]
    rows = _exploded(raw, arrays, "j", "i")
    rows = rows.where(F.col("npoints") > 0) if "npoints" in raw.columns else rows
    lat_name, lon_name, time_name = (next(n for n in NAMES[k] if n in raw.columns) for k in ("lat", "lon", "time"))
    two = lambda n: _at(raw, n, "j", "i")
    along_j = lambda n: F.get(F.col(n), F.col("j")) if raw.schema[n].dataType.simpleString().count("array<") == 1 else two(n)
    return _observations(rows.where(flagged(rows, s.flags)), s, lon=two(lon_name), lat=along_j(lat_name), time=decoded(along_j(time_name), s.units), instrument=instrument_of(raw, s), value=F.col(s.variable).cast("double"), estd=error_of(rows, s), depth=F.lit(s.zvalue or 0.0), batch=_column(raw, s.batch, "batch"))


def gridded_xyz(raw: DataFrame, s: Section) -> DataFrame:
    """Records of value[k][j][i]; depths along k, or of each cell."""
    arrays = [s.variable, *[c for c in ("std", "error_std", "npoints", *s.flags) if c in raw.columns]]
    rows = _exploded(raw, arrays, "k", "j", "i")
    rows = rows.where(F.col("npoints") > 0) if "npoints" in raw.columns else rows
    lat_name, lon_name, z_name = (next(n for n in NAMES[k] if n in raw.columns) for k in ("lat", "lon", "depth"))
    deep = lambda n: raw.schema[n].dataType.simpleString().count("array<")
    lat = F.get(F.col(lat_name), F.col("j")) if deep(lat_name) == 1 else _at(raw, lat_name, "j", "i")
    z = F.get(F.col(z_name), F.col("k")) if deep(z_name) == 1 else _at(raw, z_name, "k", "j", "i")
    return _observations(rows.where(flagged(rows, s.flags)), s, lon=_at(raw, lon_name, "j", "i"), lat=lat, time=decoded(_column(raw, *NAMES["time"]), s.units), instrument=instrument_of(raw, s), value=F.col(s.variable).cast("double"), estd=error_of(rows, s), depth=z)


def gridded_xyh(raw: DataFrame, s: Section, layers, p1: str = "p1", p2: str = "p2") -> DataFrame:
    """Records on the hybrid layers of a declared source grid: a layer becomes the depth that the source grid has there."""
    z = layers.depth(F.col("k").cast("double"), p1=F.col("__p1"), p2=F.col("__p2"))
    rows = _exploded(raw, [s.variable, *[c for c in s.flags if c in raw.columns]], "k", "j", "i")
    rows = rows.withColumns({"__p1": _at(raw, p1, "j", "i").cast("double"), "__p2": _at(raw, p2, "j", "i").cast("double")})
    lat_name, lon_name = (next(n for n in NAMES[k] if n in raw.columns) for k in ("lat", "lon"))
    lat = F.get(F.col(lat_name), F.col("j")) if raw.schema[lat_name].dataType.simpleString().count("array<") == 1 else _at(raw, lat_name, "j", "i")
    return _observations(rows.where(flagged(rows, s.flags)), s, lon=_at(raw, lon_name, "j", "i"), lat=lat, time=decoded(_column(raw, *NAMES["time"]), s.units), instrument=instrument_of(raw, s), value=F.col(s.variable).cast("double"), estd=error_of(raw, s), depth=z)


def profiles(raw: DataFrame, s: Section) -> DataFrame:
    """Profiles of arrays of values and depths; the profile's number is its batch unless one is given.

    Time is of the profile, or of each level.
    """
    arrays = [s.variable, s.zname or "z", *[c for c in ("std", "error_std", *s.flags) if c in raw.columns]]
    time_name = next(n for n in NAMES["time"] if n in raw.columns)
    rows = _exploded(raw, arrays, "level")
    rows = rows.where(flagged(rows, s.flags) & F.col(s.zname or "z").isNotNull())
    lon, lat = _column(raw, *NAMES["lon"]), _column(raw, *NAMES["lat"])
    return _observations(rows, s, lon=lon, lat=lat, time=decoded(_at(raw, time_name, "level"), s.units), instrument=instrument_of(raw, s), value=F.col(s.variable).cast("double"), estd=error_of(rows, s), depth=F.col(s.zname or "z"), batch=_column(raw, s.batch, "batch", "profile"))


def _wmo(raw: DataFrame) -> Column:
    """The WMO type in three digits; 999 where it is no number."""
    if "WMO_INST_TYPE" not in raw.columns:
        return F.lit(None).cast("string")
    return F.concat(F.lit("WMO"), F.lpad(F.coalesce(F.try_to_number(F.trim(F.col("WMO_INST_TYPE").cast("string")), F.lit("999999")).cast("int"), F.lit(999)).cast("string"), 3, "0"))


def cmems(raw: DataFrame, s: Section) -> DataFrame:
    """Profiles with adjusted and raw variables, each with flags: a level's depth is the first defined one of flag 1, of
    adjusted depth and pressure and then the raw ones; values are a profile's adjusted ones if it has any, else its raw ones,
    where their flag is allowed (1 unless given as that of QC). Only values within the type's valid range count. The
    instrument is the WMO type.
    """
    name, allowed = s.variable, s.flags.get("QC", (1,))
    both = [f"{name}_ADJUSTED", name]
    depths = [n for n in ("DEPH_ADJUSTED", "PRES_ADJUSTED", "DEPH", "PRES") if n in raw.columns]
    defined = lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
    pick = lambda n, flags: F.when(F.col(f"{n}_QC").cast("int").isin(*flags) & defined(F.col(n)), F.col(n).cast("double")) if n in raw.columns else F.lit(None).cast("double")
    raw = raw.withColumn("__adjusted", F.exists(both[0], defined) if both[0] in raw.columns else F.lit(False))
    rows = _exploded(raw, [c for n in (*both, *depths) for c in (n, f"{n}_QC") if c in raw.columns], "level")
    low, high = RANGES.get(s.type, (float("-inf"), float("inf")))
    value = F.when(F.col("__adjusted"), pick(both[0], allowed)).otherwise(pick(both[1], allowed))
    rows = rows.withColumns({"__v": value, "__z": F.coalesce(*[pick(n, (1,)) for n in depths])}).where((F.col("__v") >= low) & (F.col("__v") <= high) & F.col("__z").isNotNull())
    return _observations(rows, s, lon=F.col("LONGITUDE"), lat=F.col("LATITUDE"), time=decoded(F.col("JULD"), s.units), instrument=F.coalesce(_wmo(raw), F.lit(s.product)), value=F.col("__v"), estd=F.lit(s.estd), depth=F.col("__z"), batch=_column(raw, "profile"))


def flag_counts(raw: DataFrame, name: str) -> DataFrame:
    """Number of levels by flag of a profile variable."""
    return raw.select(F.explode(f"{name}_QC").alias("q")).select(F.col("q").cast("int").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


#: fixed values: a type's variable in the files of products that name it themselves
BLUELINK = {"TEM": "TEMP_BLUELINK", "SAL": "PSAL_BLUELINK"}
CORRECTED = {"TEM": "POTM_CORRECTED", "SAL": "PSAL_CORRECTED"}


def _profiles_of(raw: DataFrame, s: Section, name: str, depth: str, good) -> DataFrame:
    """Profiles of a variable, with the WMO type as instrument and the profile's number as batch."""
    qc = f"{name}_QC"
    rows = _exploded(raw, [c for c in (name, depth, qc) if c in raw.columns], "level").where(F.col(depth).isNotNull())
    rows = rows.where(F.coalesce(good(F.col(qc)), F.lit(False))) if qc in raw.columns else rows
    return _observations(rows, s, lon=F.col("LONGITUDE"), lat=F.col("LATITUDE"), time=decoded(F.col("JULD"), s.units), instrument=F.coalesce(_wmo(raw), F.lit(s.product)), value=F.col(name).cast("double"), estd=F.lit(s.estd), depth=F.col(depth), batch=_column(raw, "profile"))


def mmt(raw: DataFrame, s: Section) -> DataFrame:
    """Profiles of flag 0; a profile that is 0 throughout has no data."""
    name = BLUELINK[s.type]
    return _profiles_of(raw.where(F.exists(name, lambda x: F.coalesce(x != 0, F.lit(False)))), s, name, "PRES_BLUELINK", lambda q: q.cast("int") == 0)


def en4(raw: DataFrame, s: Section) -> DataFrame:
    """Profiles of corrected variables with characters for flags, of which 1 is good."""
    return _profiles_of(raw, s, CORRECTED[s.type], "DEPH_CORRECTED", lambda q: q == "1")


def _of_day(raw: DataFrame, s: Section, instrument: str, value: Column, time: Column, estd: Column, rows: DataFrame | None = None, **columns: Column) -> DataFrame:
    """Surface points of a day's file, whose name has the date; time counts from it, in the section's unit."""
    unit = next((v for k, v in UNITS.items() if s.units.strip().lower().startswith(k)), 1.0)
    given = {"lon": F.col("lon"), "lat": F.col("lat"), "instrument": F.lit(instrument), "depth": F.lit(0.0), "batch": F.lit(0)}
    return _observations(raw if rows is None else rows, s, **(given | columns), value=value.cast("double"), estd=estd, time=date_of(F.col("file")) + time.cast("double") * unit)


def navo(raw: DataFrame, s: Section) -> DataFrame:
    """With add_bias, SST_bias is added."""
    value = F.col("sst") + F.col("SST_bias") if s.add_bias else F.col("sst")
    return _of_day(raw, s, "AVHRR", value, F.col("GMT_time"), F.col("error"))


def windsat(raw: DataFrame, s: Section) -> DataFrame:
    """A file whose ages are all 0 has none: half a unit."""
    none = F.max(F.abs("age")).over(Window.partitionBy("file")) == 0
    rows = raw.withColumn("__age", F.when(none, 0.5).otherwise(F.col("age")))
    return _of_day(raw, s, "WindSat", F.col("sst"), F.col("__age"), F.col("error"), rows)


def amsr2(raw: DataFrame, s: Section) -> DataFrame:
    """With add_bias, sses_bias is added if there is one."""
    value = F.col("sst") + F.col("sses_bias") if s.add_bias and "sses_bias" in raw.columns else F.col("sst")
    return _of_day(raw, s, "AMSR-2", value, F.col("age"), F.col("error"))


def amsre(raw: DataFrame, s: Section) -> DataFrame:
    """Both orbits of a day's file, or one: grids a_ (ascending, batch 0) and d_ (descending, 1), where the wind is enough."""
    out = None
    for batch, (orbit, p) in enumerate((("ASCENDING", "a"), ("DESCENDING", "d"))):
        if s.orbits not in ("ALL", orbit):
            continue
        rows = _exploded(raw, [f"{p}_sst", f"{p}_wind", f"{p}_time"], "j", "i")
        rows = rows.where((F.col(f"{p}_wind") >= (5.0 if s.min_wind is None else s.min_wind)) & (F.col(f"{p}_wind") <= 999999))
        mine = _of_day(raw, s, "AMSRE", F.col(f"{p}_sst"), F.col(f"{p}_time"), F.lit(0.25 if s.estd is None else s.estd), rows, lon=F.get("lon", F.col("i")), lat=F.get("lat", F.col("j")), batch=F.lit(batch))
        out = mine if out is None else out.unionByName(mine)
    return out


READERS: dict[str, Callable[[DataFrame, Section], DataFrame]] = {
    "scattered": scattered, "gridded_xy": gridded_xy, "gridded_xyz": gridded_xyz, "profile": profiles, "z": profiles, "cmems": cmems,
    "mmt": mmt, "en4": en4, "navo": navo, "windsat": windsat, "amsr2": amsr2, "amsre": amsre,
}


def read(raw: DataFrame, s: Section) -> DataFrame:
    """Observations of a section, with its number of rows thinned only later (status), never here."""
    if s.reader not in READERS:
        raise ValueError(f"no reader {s.reader}; there are {', '.join(sorted(READERS))}")
    return READERS[s.reader](raw, s)


def read_all(sections: list[tuple[DataFrame, Section]]) -> DataFrame:
    """The observations of several sections, appended by name."""
    out = None
    for raw, s in sections:
        rows = read(raw, s)
        out = rows if out is None else out.unionByName(rows)
    return out
