"""From observations to super-observations: quality status, errors, thinning, weighted merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M

STATUS = ("OK", "GRID", "LAND", "WINDOW", "RANGE", "DOMAIN", "SHALLOW", "THINNED", "EXCLUDED", "BADBATCH", "BADFC")
OPEN = (None,) * 6


def in_box(box: tuple[float, float, float, float]) -> Column:
    return F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3])


def numbered(obs: DataFrame, by: str = "id", name: str = "number", bucket_rows: int = 500_000) -> DataFrame:
    """obs with running numbers from 0 in order of a whole-numbered id, without sorting all of it in one task.

    Ids are cut into ranges of equal width, as many as it takes for so many rows in each; a range's first number is the
    number of rows in those before it, of which there is one row a range.
    """
    n, low, high = obs.agg(F.count("*"), F.min(by), F.max(by)).first()
    width = max(1, -(-((high - low + 1) if n else 1) // max(1, -(-n // bucket_rows))))
    rows = obs.withColumn("__range", F.floor((F.col(by) - F.lit(low if n else 0)) / width))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__count"))
    before = counts.select("__range", (F.sum("__count").over(Window.orderBy("__range")) - F.col("__count")).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    return rows.withColumn("__n", inside).join(before, "__range").withColumn(name, F.col("__first") + F.col("__n")).drop("__range", "__n", "__first")


def with_status(
    obs: DataFrame,
    window: tuple[float, float] = (-15.0, 15.0),
    low: float | None = None,
    high: float | None = None,
    min_depth: float | None = None,
    max_depth: float | None = None,
    boxes=(),
    stride: int = 1,
    domain: tuple[float | None, ...] = OPEN,
    section: tuple[float | None, float | None, float | None, float | None] = (None,) * 4,
    mask: DataFrame | None = None,
    log: bool = False,
    number: str = "id",
) -> DataFrame:
    """obs (with map_status) with the first check that fails; a check without a bound, or of a missing value, never does.

    domain: xmin, xmax, ymin, ymax (of which the bounds are outside), zmin, zmax (within); section: ymin, ymax, zmin, zmax
    (outside). mask: j, i of cells that are left out. log: values become their decimal logarithms. number: the running
    number that stride thins by. Where a place is too shallow or deep and thinned too, thinning tells the status.
    """
    fails = lambda c: F.coalesce(c, F.lit(False))
    time, value, depth = F.col("time"), F.col("value"), F.col("depth")
    checks = [(F.col("map_status") == "GRID", "GRID"), (F.col("map_status") == "LAND", "LAND")]
    checks += [(~((time >= window[0]) & (time < window[1])), "WINDOW"), (value.isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "RANGE")]
    checks += [(c, "RANGE") for c in ([value < low] if low is not None else []) + ([value > high] if high is not None else [])]
    lon, lat = F.col("lon"), F.col("lat")
    sides = [(lon, "<=", domain[0]), (lon, ">=", domain[1]), (lat, "<=", domain[2]), (lat, ">=", domain[3]), (depth, "<", domain[4]), (depth, ">", domain[5])]
    sides += [(lat, "<=", section[0]), (lat, ">=", section[1]), (depth, "<=", section[2]), (depth, ">=", section[3])]
    compare = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    checks += [(compare[op](c, b), "DOMAIN") for c, op, b in sides if b is not None]
    checks += [(F.col("model_depth").isNull() | (F.col("model_depth") == 0) | (depth > F.col("model_depth")), "LAND")]
    if stride > 1:
        checks.append((F.col(number) % stride != 0, "THINNED"))
    if min_depth is not None:
        checks.append((F.col("model_depth") < min_depth, "SHALLOW"))
    if max_depth is not None:
        checks.append((F.col("model_depth") > max_depth, "SHALLOW"))
    checks += [(in_box(b), "EXCLUDED") for b in boxes]
    if mask is not None:
        cells = mask.select(F.col("j").alias("__j"), F.col("i").alias("__i"), F.lit(True).alias("__masked"))
        obs = obs.join(cells, (F.floor("fj").cast("int") == F.col("__j")) & (F.floor("fi").cast("int") == F.col("__i")), "left").drop("__j", "__i")
        checks.append((F.col("__masked"), "EXCLUDED"))
    out = obs.withColumn("status", F.coalesce(*[F.when(fails(c), F.lit(s)) for c, s in checks], F.lit("OK"))).drop("__masked")
    return transformed(out) if log else out


def transformed(obs: DataFrame) -> DataFrame:
    """Values as their decimal logarithms; those that have none get status RANGE, if nothing else failed before."""
    log = F.when(F.col("value") > 0, F.log10("value"))
    bad = (F.col("status") == "OK") & (F.col("value").isNull() | (F.col("value") <= 0))
    return obs.withColumn("status", F.when(bad, "RANGE").otherwise(F.col("status"))).withColumn("value", F.when(F.col("status") == "OK", log).otherwise(F.col("value")))


def checked(obs: DataFrame, mandatory: tuple[str, ...] = (), section: str = "product") -> DataFrame:
    """obs, whose good rows are all sound; raises otherwise, and where a mandatory section has none."""
    bad = F.col("value").isNull() | F.isnan("value") | F.col("estd").isNull() | (F.col("estd") <= 0) | F.col("fi").isNull() | F.col("fj").isNull() | (F.abs("value") > M.MAX_VALUE)
    good = obs.where(F.col("status") == "OK")
    wrong, *counts = good.agg(F.count_if(bad), *[F.count_if(F.col(section) == m) for m in mandatory]).first()
    if wrong:
        raise ValueError(f"{wrong} good observations without a sound value, error or place")
    missing = [m for m, n in zip(mandatory, counts, strict=True) if not n]
    if missing:
        raise ValueError(f"no observations from {', '.join(missing)}")
    return obs


def visible(obs: DataFrame, types: DataFrame, domain: str) -> DataFrame:
    """Observations of types that a grid's domain sees: types has type, domains (null: all) and stats_only."""
    seen = types.where(~F.col("stats_only") & (F.col("domains").isNull() | F.array_contains("domains", domain))).select("type")
    return obs.join(F.broadcast(seen), "type", "left_semi")  # a row for each type


def cell(f: Column, stride: int) -> Column:
    return F.floor(F.floor(f + (stride % 2) / 2.0) / stride).cast("int")


def with_cells(obs: DataFrame, stride: int) -> DataFrame:
    """Cells of super-observations: of a structured grid, of triangles (vertices f0, f1, f2), or rows of their own."""
    if not stride:
        return obs.withColumns({"ci": F.col("id"), "cj": F.lit(0), "ck": F.lit(0)})
    ck = F.floor(F.col("fk") + 0.5).cast("int")
    if "f2" in obs.columns:
        return obs.withColumns({"ci": F.floor("f0").cast("int"), "cj": F.floor("f1").cast("int"), "c2": F.floor("f2").cast("int"), "ck": ck})
    return obs.withColumns({"ci": cell(F.col("fi"), stride), "cj": cell(F.col("fj"), stride), "ck": ck})


def superob_keys(obs: DataFrame, across_instruments: bool = False, across_batches: bool = True) -> list[str]:
    """What super-observations don't mix, of the columns there are."""
    given = ["type", *([] if across_instruments else ["instrument"]), *([] if across_batches else ["batch"]), "slot", "footprint", "ci", "cj", "c2", "ck"]
    return [c for c in given if c in obs.columns]


def thinned(obs: DataFrame, keys: list[str], kind: str = "XYZ") -> DataFrame:
    """Rows of one key at one place (kind XYZ or XY), or all of a key's (CELL): the one of the smallest id, with plain means.

    What is averaged is what the kind lets differ: value and time, depth and layer too, and the place too.
    """
    place = {"XYZ": ["lon", "lat", "depth", "instrument"], "XY": ["lon", "lat", "instrument"], "CELL": []}[kind]
    by = [*keys, *[c for c in place if c in obs.columns and c not in keys]]
    means = ["value", "time", *([] if kind == "XYZ" else ["depth", "fk"]), *(["lon", "lat", "fi", "fj"] if kind == "CELL" else [])]
    means = [c for c in means if c in obs.columns]
    kept = [c for c in obs.columns if c not in by and c not in means and c != "id"]
    first = F.min_by(F.struct(*kept), "id").alias("kept")
    out = obs.groupBy(*by).agg(F.min("id").alias("id"), *[F.avg(c).alias(c) for c in means], first, F.count("*").alias("nthin"))
    return out.select("id", *by, *means, "kept.*", "nthin")


def superobs(obs: DataFrame, keys: list[str], estd_min: float | Column = 0.0, subgrid: bool = False, base: float = 0.0) -> DataFrame:
    """Inverse-variance means of each key's rows, in one aggregation.

    Attributes that a group doesn't agree on become null. Of a group whose longitudes straddle the base, those in the
    western half count 360 degrees less. estd_min: the least error, a number or a column of the keys. With subgrid, a
    group's own sample variance bounds each of its rows' variances from below.
    """
    rows = obs
    if subgrid:
        spread = obs.groupBy(*keys).agg(F.var_samp("value").alias("subvar"))
        rows = obs.join(spread, keys)
        v = F.greatest(F.col("estd") * F.col("estd"), F.coalesce("subvar", F.lit(0.0)))
    else:
        v = F.col("estd") * F.col("estd")
    w = 1 / v
    mean = lambda c: F.sum((F.col(c) if isinstance(c, str) else c) * w) / F.sum(w)
    agree = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    far = F.when(F.col("lon") - base > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    lon = F.when(F.max("lon") - F.min("lon") > 180, mean(far)).otherwise(mean("lon"))
    given = [c for c in ("product", "instrument", "file", "batch") if c in obs.columns and c not in keys]
    means = [c for c in ("value", "lat", "depth", "model_depth", "fi", "fj", "fk", "time") if c in obs.columns]
    floor = F.max(estd_min) if isinstance(estd_min, Column) else F.lit(float(estd_min))
    out = rows.groupBy(*keys).agg(F.min("id").alias("id"), *[mean(c).alias(c) for c in means], F.greatest(F.sqrt(1 / F.sum(w)), floor).alias("estd"), lon.alias("lon"), *[agree(c) for c in given], F.count("*").alias("nobs"))
    return out.withColumn("lon", M.normal_lon(F.col("lon"), base))


def members(obs: DataFrame, supers: DataFrame, keys: list[str], sob_id: int) -> DataFrame:
    """The rows that one super-observation was made of."""
    return obs.join(F.broadcast(supers.where(F.col("id") == sob_id).select(*keys)), keys, "left_semi")  # one row


def with_sob_id(obs: DataFrame, supers: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the id of its super-observation (null: in none)."""
    right = supers.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("id").alias("sob_id"))
    same = [F.equal_null(F.col(k), F.col(f"__{k}")) for k in keys]
    return obs.join(right, reduce(lambda a, b: a & b, same), "left").drop(*[f"__{k}" for k in keys])


def profile_places(obs: DataFrame) -> DataFrame:
    """Number of distinct places with a good row, by type."""
    return obs.where(F.col("status") == "OK").groupBy("type").agg(F.countDistinct("lon", "lat").alias("places"))


def batch_stats(obs: DataFrame) -> DataFrame:
    """Size, mean absolute and mean innovation by batch; rows of mixed batches are in none."""
    return obs.where("batch is not null and file is not null").groupBy("type", "file", "batch").agg(F.count("*").alias("n"), F.avg(F.abs("inn")).alias("mad"), F.avg("inn").alias("bias"))


def bad_batches(stats: DataFrame, max_bias: float | Column, max_mad: float | Column, min_n: int | Column) -> DataFrame:
    """Batches beyond given limits, which may be columns of stats (joined by type)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    bias = lit(max_bias)
    return stats.where((F.col("n") >= lit(min_n)) & ((F.abs("bias") >= bias) | (F.col("mad") >= F.greatest(lit(max_mad), F.abs(bias)))))


def marked_bad(obs: DataFrame, bad: DataFrame) -> DataFrame:
    flags = bad.select("type", "file", "batch", F.lit(True).alias("in_bad"))
    return obs.join(flags, ["type", "file", "batch"], "left").withColumn("status", F.when(F.col("in_bad"), "BADBATCH").otherwise("OK")).drop("in_bad")


def every_nth(obs: DataFrame, n: int, by: str = "id") -> DataFrame:
    """Each n-th row in order of an id."""
    return numbered(obs, by, "__number").where(F.col("__number") % n == 0).drop("__number")
