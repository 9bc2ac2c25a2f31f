"""One cycle: observations to super-observations, to local transforms, to the analysed state, and diagnostics.

Each program is a plan over tables; what later steps read several times is written in between, so a cycle's plans stay
short and nothing is computed twice. Nothing here collects rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CalcFlags, Config, ObsType, PrepFlags, UpdateFlags, Variable
from ..functions import maths as M
from ..operators import diag, hx, kernel, prep, spatial
from ..operators import update as up
from ..operators.grid import Grid, strided
from ..sources.products import Section
from ..sources.tables import written


@dataclass(frozen=True)
class System:
    """Settings, observation types, grids by name, and variables."""

    config: Config
    types: tuple[ObsType, ...]
    grids: dict[str, Grid]
    variables: tuple[Variable, ...] = ()
    analysis_time: float = 0.0  # days since 1970
    members: int = 0
    dynamic: int | None = None
    offsets: dict[str, DataFrame] = field(default_factory=dict)

    def grid_of(self, t: ObsType) -> Grid:
        named = {v.name: v.grid for v in self.variables}
        return self.grids[named.get(t.variables[0]) or next(iter(self.grids))]


def _by_type(types: tuple[ObsType, ...], value) -> Column:
    """A number by type of observation, null without one."""
    known = [(t.name, value(t)) for t in types if value(t) is not None]
    if not known:
        return F.lit(None).cast("double")
    return F.create_map(*[F.lit(x) for k, v in known for x in (k, float(v))])[F.col("type")]


def prepare(system: System, sections: list[tuple[DataFrame, Section, tuple]], flags: PrepFlags | None = None, masks: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations with their status, and super-observations of the good ones.

    sections: observations of a reader (see sources.products) with the section, and its chain of errors.
    """
    flags = flags or PrepFlags()
    types = {t.name: t for t in system.types}
    done = []
    for number, (raw, s, errors) in enumerate(sections):
        t = types[s.type]
        grid = system.grid_of(t)
        obs = raw if "id" in raw.columns else prep.numbered(raw.withColumn("id", F.monotonically_increasing_id()), "id", "id_in_section").drop("id").withColumnRenamed("id_in_section", "id")
        obs = obs.withColumn("time", F.coalesce(F.col("time") - system.analysis_time, F.lit(0.0)))
        boxes = [b for b in t.exclude if len(b) == 4]
        boxes = [(b[0], b[1], b[2], b[3]) for b in boxes]
        mask = next(((masks or {})[b[0]] for b in t.exclude if len(b) == 2), None)
        log = any(v.log for v in system.variables if v.name == t.variables[0])
        obs = prep.with_status(grid.mapped(obs), t.window, t.minimum, t.maximum, s.min_depth, s.max_depth, boxes, s.stride, t.domain, (*s.y, *s.z), mask, log)
        estd = M.error_chain(F.col("estd"), list(errors))
        if t.doubling_time:
            estd = M.error_growth(estd, F.col("time"), t.doubling_time)
        obs = obs.withColumns({"estd": estd, "section": F.lit(number)})
        if t.asynchronous:
            obs = obs.withColumn("slot", M.slot(F.col("time"), t.asynchronous[0], t.asynchronous[1]))
        done.append(obs.drop("weights", "corner_levels", "corner_depths"))
    obs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)
    obs = prep.checked(written(obs, "observations"), tuple(s.product for _, s, _ in sections if s.mandatory))
    good = obs.where(F.col("status") == "OK")
    supers = []
    for t in system.types:
        grid = system.grid_of(t)
        mine = prep.with_cells(good.where(F.col("type") == t.name), 0 if flags.no_superobing else t.sobstride if t.sobstride is not None else grid.sobstride)
        keys = prep.superob_keys(mine, flags.superob_across_instruments, not flags.no_superobing_across_batches)
        kind = next((s.thinning for _, s, _ in sections if s.type == t.name), "XYZ")
        if t.can_thin and not flags.no_thinning and kind != "NONE":
            mine = prep.thinned(mine, keys, kind).drop("nthin")
        supers.append(prep.superobs(mine, keys, t.estd_min, flags.subgrid_variance, grid.x.base or 0.0))
    return obs, written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), supers), "super-observations")


def _located(grid: Grid) -> DataFrame:
    """Nodes of a grid with a number, place and xyz."""
    nodes = grid.nodes.withColumns({"fi": F.col("i").cast("double"), "fj": F.col("j").cast("double")})
    return spatial.with_xyz(grid.located(nodes)).withColumn("node", (F.col("j") * grid.shape[1] + F.col("i")).cast("int"))


@dataclass(frozen=True)
class Calculated:
    observations: DataFrame  # with he, hx_f, std_f, inn_f, estd and, analysed, ha, hx_a, std_a, inn_a
    transforms: dict[str, DataFrame]  # by grid: node, j, i, nlobs, dfs, srf, w, t
    stats: DataFrame
    batches: DataFrame


def calculate(system: System, supers: DataFrame, fields: DataFrame, regions: DataFrame, flags: CalcFlags | None = None, background: DataFrame | None = None, layers: DataFrame | None = None) -> Calculated:
    """Forecasts at observations, quality by batch, moderated errors, local analyses, analysed observations, the report.

    background: fields of one member, for an ensemble of anomalies (ENOI).
    """
    flags = (flags or CalcFlags()).validate()
    c, m, dyn = system.config, system.members, system.dynamic
    specs = [{"name": t.name, "surface": bool(t.surface), "function": t.function, "variables": list(t.variables), "grid": system.grid_of(t).name} for t in system.types]
    source = lambda table, n: {name: hx.Source(g, table, n, dynamic=dyn if n > 1 else None, mld_threshold=next((t.mld_threshold for t in system.types if t.mld_threshold), None)) for name, g in system.grids.items()}
    obs = hx.ensemble_observations(supers.withColumn("status", F.lit("OK")), specs, source(fields, m), flags.skip_bad_forecast_obs)
    if c.mode == "ENOI" and background is not None:
        bg = hx.ensemble_observations(supers.withColumn("status", F.lit("OK")), specs, source(background, 1), flags.skip_bad_forecast_obs).select("id", F.col("he")[0].alias("bg"))
        obs = obs.join(bg, "id").withColumn("he", hx.recentred(F.col("he"), F.col("bg"))).drop("bg")
    if c.mode == "HYBRID" and dyn:
        obs = obs.withColumn("he", hx.hybrid(F.col("he"), dyn, m, c.gamma or 1.0, centre=True))
    obs = written(hx.forecast(obs, dyn), "forecasts")
    known = obs.withColumn("inn", F.col("inn_f"))
    batches = prep.batch_stats(known)
    limits = c.badbatches
    if limits:
        named = lambda f: F.create_map(*[F.lit(x) for b in limits for x in (b.type, float(f(b)))])[F.col("type")]
        bad = prep.bad_batches(batches, named(lambda b: b.max_bias), named(lambda b: b.max_mad), named(lambda b: b.min_obs))
        marked = prep.marked_bad(obs.drop("status"), bad).select("id", "status")
        obs = obs.withColumnRenamed("status", "__before").join(marked, "id").withColumn("status", F.when(F.col("__before") == "OK", F.col("status")).otherwise(F.col("__before"))).drop("__before")
    if c.kfactor is not None:
        obs = obs.withColumns({"estd_orig": F.col("estd"), "estd": M.moderated(F.col("estd"), F.col("std_f"), F.col("inn_f"), c.kfactor)})
    transforms: dict[str, DataFrame] = {}
    if not flags.forecast_stats_only:
        rfactor = F.coalesce(_by_type(system.types, lambda t: t.rfactor), F.lit(1.0))
        good = written(hx.standardised(obs.where("status = 'OK'"), rfactor), "standardised")
        for name, grid in system.grids.items():
            if grid.alias:
                continue
            transforms[name] = written(analyses(system, grid, good), "transforms")
        first = next(g for g in system.grids.values() if not g.alias)
        nj, ni = first.shape
        cells = up.spread_to_cells(transforms[first.name].select("j", "i", "w", "t"), first.stride, nj, ni, bool(first.x.periodicity))
        inflation = up.UpdateParameters(m, dyn, *c.inflation)
        after = up.analysed_observations(good.select("id", "fi", "fj", "he"), cells, first.stride, nj, ni, inflation)
        after = after.withColumn("hx_a", M.mean_of(F.col("ha") if dyn is None else F.slice("ha", 1, dyn)))
        after = after.withColumn("std_a", F.sqrt(M.square_sum(M.anomalies(F.col("ha"), F.col("hx_a"))) / (F.size("ha") - 1)))
        obs = obs.join(after.select("id", "ha", "hx_a", "std_a"), "id", "left").withColumn("inn_a", F.col("value") - F.col("hx_a"))
        obs = written(obs, "analysed")
    stats = diag.observation_stats(obs.where("status = 'OK'"), regions, layers, rmsd=flags.use_rmsd_for_obsstats)
    return Calculated(obs, transforms, stats, batches)


def analyses(system: System, grid: Grid, good: DataFrame) -> DataFrame:
    """node, j, i, nlobs, dfs, srf, w, t of a grid's strided nodes, from standardised observations that its domain sees.

    Nodes on land are analysed like others: elements between them and wet ones are interpolated from both.
    """
    c = system.config
    types = good.sparkSession.createDataFrame([(t.name, list(t.domains) if t.domains else None, t.stats_only) for t in system.types], "type string, domains array<string>, stats_only boolean")
    seen = prep.visible(good, types, grid.domain)
    nodes = strided(_located(grid), grid.stride)
    reach = {t.name: max(t.locrad or c.locrad) for t in system.types}
    near = spatial.within(nodes, spatial.with_xyz(seen.select("id", "type", "lon", "lat")), reach)
    by_type = [(t, t.locrad or c.locrad, t.weights if t.locrad else ObsType("", locrad=c.locrad, locweight=c.locweight).weights) for t in system.types]
    coeff = reduce(lambda a, x: F.when(F.col("type") == x[0].name, M.multi_taper(F.col("d"), x[1], x[2])).otherwise(a), by_type, F.lit(0.0))
    if c.nlobsmax:
        near = spatial.nearest(near, c.nlobsmax)
    pairs = kernel.with_blocks(near.select("node", "id", coeff.alias("coeff")), nodes, max(reach.values()))
    solved = kernel.block_analyses(pairs, seen.select("id", "type", "s", "d"), c.scheme, c.alpha, system.dynamic)
    full = kernel.with_defaults(nodes, solved, system.members, system.dynamic)
    return full.join(nodes.select("node", "j", "i"), "node")


def update(system: System, grid: Grid, fields: DataFrame, transforms: DataFrame, flags: UpdateFlags | None = None, background: DataFrame | None = None) -> DataFrame:
    """fields (var, k, j, i, e) with a and inflation: the analysed members, or increments; one background in ENOI mode."""
    flags = flags or UpdateFlags()
    nj, ni = grid.shape
    m, dyn = system.members, system.dynamic
    cells = up.spread_to_cells(transforms.select("j", "i", "w", "t"), grid.stride, nj, ni, bool(grid.x.periodicity))
    state = fields.join(grid.nodes.select("j", "i", "numlevels"), ["j", "i"]).withColumn("wet", F.col("numlevels") > grid.layers.from_surface(F.col("k"))).drop("numlevels")
    logs = [v.name for v in system.variables if v.log]
    if logs:
        state = state.withColumn("e", F.when(F.col("var").isin(*logs), up.logged(F.col("e"), dyn)).otherwise(F.col("e")))
    if system.config.mode == "ENOI" and background is not None:
        both = state.join(background.select("var", "k", "j", "i", F.col("e")[0].alias("bg")), ["var", "k", "j", "i"])
        return up.analysed_background(both, cells, grid.stride, nj, ni, flags.output_increment)
    if system.config.mode == "HYBRID" and dyn:
        state = state.withColumn("e", hx.hybrid(F.col("e"), dyn, m, system.config.gamma or 1.0, centre=False))
    known = {v.name: v for v in system.variables}
    names = list(known) or [r[0] for r in fields.select("var").distinct().collect()]  # the few variables of a model
    by = {}
    for n in names:
        v = known.get(n, Variable(n))
        most, ratio = v.inflation or system.config.inflation
        by[n] = up.UpdateParameters(m, dyn, most, ratio, flags.output_increment, v.log)
    out = up.analysed(state, cells, grid.stride, nj, ni, by)
    for number, n in enumerate(names):
        v = known.get(n, Variable(n))
        if v.randomise and not flags.output_increment:
            moved = up.randomised(F.col("a"), up.noise(dyn or m, number + 1), *v.randomise)
            out = out.withColumn("a", F.when((F.col("var") == n) & F.col("wet"), moved).otherwise(F.col("a")))
    if flags.calculate_spread:
        out = out.withColumns({"spread_f": diag.field_spread(F.col("e")), "spread_a": diag.field_spread(F.col("a"))})
    return out


def diagnose(fields: DataFrame, given: DataFrame | None = None, surface: int = 0) -> DataFrame:
    """fields (var, k, j, i, e) with spread and vertical correlation, or with statistics with a given field's members."""
    if given is not None:
        return diag.with_given(fields, given, ["j", "i"])
    spread = fields.withColumn("spread", diag.field_spread(F.col("e"))).select("var", "k", "j", "i", "spread")
    corr = reduce(lambda a, b: a.unionByName(b), [diag.vertical_correlation(fields.where(F.col("var") == v), surface).select("var", "k", "j", "i", "corr") for v in [r[0] for r in fields.select("var").distinct().collect()]])
    return spread.join(corr, ["var", "k", "j", "i"], "left")


def single(spark: SparkSession, system: System, lon: float, lat: float, depth: float, kind: str, innovation: float, estd: float) -> DataFrame:
    """The analysis input of a single-observation run, mapped to the grid of its type."""
    t = next(t for t in system.types if t.name == kind)
    return system.grid_of(t).mapped(diag.single_observation(spark, lon, lat, depth, kind, innovation, estd))
