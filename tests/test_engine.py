import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from pyspark.sql import functions as F

from halocline import config, queries
from halocline.functions import maths as M
from halocline.operators import diag, grid, hx, kernel, prep, spatial, update
from halocline.plans import System, calculate, diagnose, prepare
from halocline.plans import update as update_fields
from halocline.queries import analyses, core
from halocline.sources import products, store
from halocline.streaming import assimilation_windows, to_cycles

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    a, b = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLE[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_gain_is_the_same_in_both_spaces():
    s = np.random.default_rng(1).normal(size=(7, 4))
    small = np.linalg.solve(np.eye(7) + s @ s.T, s).T
    assert np.allclose(kernel.gain(s), small)


@pytest.mark.parametrize("p", [1, 3, 9])
def test_transforms(p):
    rng = np.random.default_rng(p)
    s, d = rng.normal(size=(p, 5)), rng.normal(size=p)
    w, t, dfs, _ = kernel.analysis(s, d, "ETKF")
    assert np.allclose(t @ t, np.linalg.inv(np.eye(5) + s.T @ s))
    assert 0 <= dfs <= min(p, 5)
    assert np.allclose(kernel.analysis(s, d, alpha=0.0)[1], np.eye(5))
    assert np.allclose(w, kernel.analysis(s, d, "DENKF")[0])


def test_nodes_without_observations_keep_their_ensemble(spark):
    solved = spark.createDataFrame([], kernel.RESULT)
    row = kernel.with_defaults(spark.createDataFrame([(3,)], "node int"), solved, 3).first()
    assert row.w == [0.0] * 3 and row.t == np.eye(3).ravel().tolist() and row.nlobs == 0


MAIN = """
TIME = 6565.5 days since 1990-01-01
MODE = hybrid
GAMMA 0.5  # a note
SCHEME = ETKF
MODEL = model.prm
GRID = grid.prm
OBSTYPES = obstypes.prm
OBS = obs.prm
ENSDIR = ensemble
LOCRAD = 400 200
LOCWEIGHT = 3 1
INFLATION = 1.06 PLAIN
STRIDE 3
NLOBSMAX = 50
REGION = Tropics 0 360 -20 20
BADBATCHES = SLA 0.06 0.02 500
POINTLOG 156 -32
WINDOWMIN = -3
"""


def test_main_file():
    c = config.read_config(MAIN)
    assert (c.mode, c.scheme, c.inflation, c.locweight, c.stride, c.nlobsmax, c.window[0]) == ("HYBRID", "ETKF", (1.06, None), (0.75, 0.25), 3, 50, -3.0)
    assert [r.name for r in c.regions] == ["Global", "Tropics"] and c.badbatches[0].max_mad == 0.06 and c.geophysical
    for wrong in ("MODE = ENKF\nMODE = ENOI", "NONSENSE = 1", "MODE = ENOI\nTIME = 1"):
        with pytest.raises(ValueError):
            config.read_config(wrong)
    for dropped in ("GAMMA 0.5  # a note", "ENSDIR = ensemble", "OBS = obs.prm", "LOCWEIGHT = 3 1"):
        with pytest.raises(ValueError):
            config.read_config(MAIN.replace(dropped, ""))


def test_model_grid_and_type_files():
    m = config.read_model("NAME = ocean\nVAR = eta\nINFLATION = 1.05 0.5\nVAR = chl\nAPPLYLOG = yes\nRANDOMISE 0.9 0.1\nGRID = t\n")
    assert [v.name for v in m.variables] == ["eta", "chl"] and m.variables[0].inflation == (1.05, 0.5) and m.variables[1].log and m.variables[1].randomise == (0.9, 0.1)
    g = config.read_grids("NAME = t\nHTYPE = rect\nVTYPE = z\nDATA = g.nc\nXVARNAME = lon\nYVARNAME = lat\nZVARNAME = zt\nSOBSTRIDE = 2\nZSTATINTS = [0 10] [10 50]\nNAME = c\nHGRIDFROM = t\nVTYPE = none\nVDIR = tosurf\n")
    assert g[0].names["Z"] == "zt" and g[0].sobstride == 2 and g[0].zints == ((0.0, 10.0), (10.0, 50.0)) and g[1].alias == "t" and g[1].to_surface
    types = config.read_obstypes("EXCLUDE = 0 10 -5 5\nNAME = SLA\nISSURFACE = yes\nVAR = eta\nMINVALUE = -2\nASYNC = 1 centre time\nEXCLUDE = mask.nc mask\nNAME = TEM\nISSURFACE = no\nVAR = temp salt\nRFACTOR = 4\nSTATSONLY = yes\nDOMAINS = A B\n", config.read_config(MAIN))
    assert types[0].exclude == ((0.0, 10.0, -5.0, 5.0), ("mask.nc", "mask")) and types[0].asynchronous == (1.0, True, "time") and types[0].locrad == (400.0, 200.0) and types[0].weights == (0.75, 0.25)
    assert types[1].rfactor == 4 and types[1].stats_only and types[1].domains == ("A", "B") and types[1].nlobsmax == 50 and types[1].window[0] == -3
    data = config.read_obs_data("PRODUCT = RADS\nTYPE = SLA\nREADER = scattered\nFILE = obs/??.nc\nFILE = more/*.nc\nERROR_STD = 0.05\nERROR_STD = err.nc rep PL\nMANDATORY = yes\nPARAMETER VARNAME = sla\nPARAMETER MINDEPTH = 100\nPARAMETER QCFLAGNAME = qc\nPARAMETER QCFLAGVALS = 0 1\n")
    assert data[0].files == ("obs/??.nc", "more/*.nc") and data[0].errors == (("EQ", 0.05), ("PLUS", ("err.nc", "rep")))
    s = data[0].section
    assert (s.variable, s.min_depth, s.flags, s.mandatory) == ("sla", 100.0, {"qc": (0, 1)}, True)
    for read, wrong in ((config.read_model, "NAME = a\nVAR = x\nWHAT = 1"), (config.read_grids, "NAME = a\nVTYPE = z\nXVARNAME = x"), (config.read_obstypes, "NAME = a\nVAR = x"), (config.read_obs_data, "PRODUCT = a\nTYPE = b")):
        with pytest.raises(ValueError):
            read(wrong)
    with pytest.raises(ValueError):
        config.CalcFlags(forecast_stats_only=True, point_logs_only=True).validate()


def test_axes():
    assert [grid.Axis(tuple(float(x) for x in n), True).periodicity for n in (range(0, 370, 10), range(0, 360, 10), range(0, 300, 10))] == [1, 2, 0]
    assert grid.Axis((0.0, 1.0, 2.0)).regular and not grid.Axis((0.0, 1.0, 3.0)).regular
    assert grid.default_edges((5.0, 15.0, 30.0)) == ((5.0, 15.0, 30.0), (0.0, 10.0, 20.0, 40.0))
    assert grid.default_edges((-30.0, -15.0, -5.0), True) == ((30.0, 15.0, 5.0), (40.0, 20.0, 10.0, 0.0))
    with pytest.raises(ValueError):
        grid.Axis((0.0, 2.0, 1.0))


def test_super_observations_across_a_base_of_minus_180(spark):
    rows = [(1, "a", 179.0, 1.0), (2, "a", -179.0, 1.0), (3, "b", 10.0, 2.0)]
    obs = spark.createDataFrame(rows, "id long, type string, lon double, estd double").withColumn("value", F.col("id").cast("double"))
    found = {r.type: r for r in prep.superobs(obs, ["type"], base=-180.0).collect()}
    assert abs(found["a"].lon) == 180 and found["b"].lon == 10 and found["a"].value == 1.5 and found["a"].estd == pytest.approx(0.5**0.5)


def test_checks_of_sound_rows(spark):
    good = spark.createDataFrame([("OK", 1.0, 0.5, 1.0, 1.0, "A"), ("LAND", None, None, None, None, "B")], "status string, value double, estd double, fi double, fj double, product string")
    assert prep.checked(good, ("A",)).count() == 2
    with pytest.raises(ValueError):
        prep.checked(good, ("B",))
    with pytest.raises(ValueError):
        prep.checked(good.withColumn("estd", F.lit(0.0)))


def test_numbering_of_many_ranges(spark):
    rows = spark.range(0, 5000, 7).withColumn("type", F.lit("x"))
    found = sorted((r.id, r.number) for r in prep.numbered(rows, bucket_rows=50).collect())
    assert [n for _, n in found] == list(range(len(found))) and [i for i, _ in found] == list(range(0, 5000, 7))
    assert prep.numbered(rows.limit(0)).count() == 0


def test_block_analyses_equal_those_of_each_node(spark):
    rng = np.random.default_rng(2)
    members = [(i, "ab"[i % 2], rng.normal(size=6).tolist(), float(rng.normal())) for i in range(30)]
    pairs = [(n, i, float(rng.random())) for n in range(8) for i in range(30) if (n * i) % 3 == 1]
    held = spark.createDataFrame(members, "id long, type string, s array<double>, d double")
    near = spark.createDataFrame([(n // 3, n, i, c) for n, i, c in pairs], "block long, node int, id long, coeff double")
    found = {r.node: r for r in kernel.block_analyses(near, held, "ETKF", 0.7, 4, by_type=True).collect()}
    for n in {n for n, _, _ in pairs}:
        own = [(i, c) for m, i, c in pairs if m == n]
        s, d = np.array([members[i][2] for i, _ in own]) * np.array([[c] for _, c in own]), np.array([members[i][3] * c for i, c in own])
        w, t, dfs, srf = kernel.analysis(s, d, "ETKF", 0.7, 4)
        assert np.allclose(found[n].w, w) and np.allclose(found[n].t, t.ravel()) and found[n].dfs == pytest.approx(dfs) and found[n].nlobs == len(own)
        for x in found[n].types:
            part = s[[members[i][1] == x.type for i, _ in own]]
            assert (x.dfs, x.srf) == pytest.approx(kernel.signal(part))


@pytest.mark.parametrize("stride", [1, 3, 4])
@pytest.mark.parametrize("periodic", [True, False])
def test_interpolated_transforms(spark, stride, periodic):
    """Against weights interpolated node by node, on a grid whose size no stride divides."""
    nj, ni, m = 8, 10, 3
    rng = np.random.default_rng(stride)
    nodes = [(j, i) for j in range(0, nj, stride) for i in range(0, ni, stride)]
    w, t = {n: rng.normal(size=m) for n in nodes}, {n: np.eye(m) + 0.1 * rng.normal(size=(m, m)) for n in nodes}
    table = spark.createDataFrame([(j, i, w[j, i].tolist(), t[j, i].ravel().tolist()) for j, i in nodes], "j int, i int, w array<double>, t array<double>")
    e = {(j, i): rng.normal(size=m) for j in range(nj) for i in range(ni)}
    state = spark.createDataFrame([(j, i, v.tolist(), (j + i) % 5 > 0) for (j, i), v in e.items()], "j int, i int, e array<double>, wet boolean")
    p = update.UpdateParameters(m, inflation=1.1, ratio=0.5)
    found = {(r.j, r.i): r for r in update.analysed(state, update.spread_to_cells(table, stride, nj, ni, periodic), stride, nj, ni, p).collect()}
    mj, mi = -(-nj // stride), -(-ni // stride)

    def mixed(x, j, i):
        jj, ii, v, u = j // stride, i // stride, (j % stride) / stride, (i % stride) / stride
        j2, i2 = min(jj + 1, mj - 1), (ii + 1) % mi if periodic else min(ii + 1, mi - 1)
        row = lambda k: (1 - u) * x[k * stride, ii * stride] + u * x[k * stride, i2 * stride]
        return (1 - v) * row(jj) + v * row(j2)

    for (j, i), v in e.items():
        if (j + i) % 5 == 0:
            assert found[j, i].a == [0.0] * m
            continue
        a = v - v.mean()
        new = a @ mixed(t, j, i)
        inflation = min(1.1, 0.5 * np.sqrt((a @ a) / (new @ new)) + 0.5)
        inflation = inflation if inflation > 1 + 1e-6 else 1.0
        assert np.allclose(found[j, i].a, new * inflation + v.mean() + a @ mixed(w, j, i)) and found[j, i].inflation == pytest.approx(inflation)


def test_hybrid_update_scales_back():
    """Without observations, dynamic members stay as they are, whatever the static ones."""
    rng = np.random.default_rng(3)
    dyn, m = 5, 9
    raw = rng.normal(size=(4, dyn))
    kd = ((m - 1) / (dyn - 1)) ** 0.5
    mean = raw.mean(1, keepdims=True)
    e = np.hstack([(raw - mean) * kd + mean, rng.normal(size=(4, m - dyn)) + mean])
    t = np.broadcast_to(np.eye(m)[:, :dyn], (4, m, dyn))
    p = update.UpdateParameters(m, dyn)
    assert np.allclose(update.analysed_members(e, np.zeros((4, m)), t, p)[0], raw)
    log = update.UpdateParameters(m, dyn, increment=True, log=True)
    assert np.allclose(update.analysed_members(e, np.zeros((4, m)), t, log)[0], 0)


def test_stereographic_cells(spark):
    """Around the pole, where longitudes are singular: indices of points that the bilinear map of the plane gives."""
    x = lambda j, i: (0.3 * i - 0.9 + 0.02 * j, 0.3 * j - 0.9)
    place = lambda p: (float(np.degrees(np.arctan2(p[1], p[0])) % 360), float(90 - 2 * np.degrees(np.arctan(np.hypot(*p)))))
    nodes = spark.createDataFrame([(j, i, *place(x(j, i))) for j in range(7) for i in range(7)], "j int, i int, lon double, lat double")
    rng = np.random.default_rng(6)
    points = [(n, *map(float, rng.random(2) * 5.8 + 0.1)) for n in range(60)]
    rows = [(n, *place((0.3 * fi - 0.9 + 0.02 * fj, 0.3 * fj - 0.9))) for n, fi, fj in points]
    found = {r.id: r for r in spatial.in_quads(spark.createDataFrame(rows, "id long, lon double, lat double"), spatial.quads(nodes), 4000.0, stereographic=True).collect()}
    for n, fi, fj in points:
        if rows[n][2] > 0:
            assert (found[n].fi, found[n].fj) == pytest.approx((fi, fj), abs=1e-6)


def test_triangles_in_layers(spark):
    placed = spark.createDataFrame([(1, 0.5, 0, 1, 2, 0.5, 0.3, 0.2), (2, 5.0, 0, 1, 2, 0.5, 0.5, 0.0)], "id long, fk double, v0 int, v1 int, v2 int, w0 double, w1 double, w2 double")
    field = spark.createDataFrame([(n, k, [float(10 * n + k)]) for n in range(3) for k in range(2)], "node int, k int, e array<double>")
    nodes = spark.createDataFrame([(0, 2), (1, 2), (2, 1)], "node int, numlevels int")
    found = {r.id: r.he[0] for r in spatial.members_of_triangles(placed, field, nodes, grid.Layers("z", (5.0, 15.0), (0.0, 10.0, 20.0))).collect()}
    wet = 0.5 * (0.5 * 0 + 0.5 * 1) + 0.3 * (0.5 * 10 + 0.5 * 11) + 0.2 * 0.5 * 20
    assert found[1] == pytest.approx(wet / (0.5 + 0.3 + 0.1)) and found[2] == pytest.approx(0.5 * 1 + 0.5 * 11)


def test_describe_and_write(spark, tmp_path):
    rows = prep.with_cells(core._good(spark, SMALL), 3)
    keys = prep.superob_keys(rows)
    supers = prep.superobs(rows, keys)
    largest = supers.orderBy(F.desc("nobs"), "id").first()
    assert prep.members(rows, supers, keys, largest.id).count() == largest.nobs
    store.write_observations(supers, f"{tmp_path}/obs")
    assert store.read_observations(spark, f"{tmp_path}/obs", ["view"]).count() == supers.where("type = 'view'").count()
    fields = analyses._fields(spark, SMALL).withColumn("t", F.lit(0))
    store.write_fields(fields, f"{tmp_path}/fields")
    layer = store.read_field(spark, f"{tmp_path}/fields", "temp", 2, rows=(3, 5))
    assert layer.count() == 3 * 36 and "PartitionFilters" in layer._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="no record for slot 9"):
        store.slots_complete(spark.createDataFrame([(9,)], "slot int"), spark.createDataFrame([(1, "f", 0)], "slot int, file string, record int")).collect()
    store.write_report(prep.batch_stats(core._with_inn(spark, SMALL)), f"{tmp_path}/batches")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/batches").count() > 0


def test_time_units():
    with pytest.raises(ValueError):
        products.decoded(F.lit(1.0), "fortnights since 2000-01-01")
    with pytest.raises(ValueError):
        products.read(None, products.Section("P", "nothing", "X"))


def test_streamed_windows_equal_those_of_a_table(spark, tmp_path):
    obs = core._good(spark, SMALL).select("id", "type", "value", "estd", "lon", "lat", "depth", "status", F.timestamp_seconds((F.col("time") + 19738) * 86400).alias("ts"))
    obs.repartition(3).write.parquet(f"{tmp_path}/in")
    # a late row of its own closes every window before it
    last = obs.limit(1).withColumns({"ts": F.lit("2030-01-01").cast("timestamp"), "type": F.lit("end")})
    expected = {(r.start, r.type): (r.nobs, round(r.value, 6)) for r in assimilation_windows(obs, ["type"], "2 days", "30 days").collect()}
    stream = spark.readStream.schema(obs.schema).parquet(f"{tmp_path}/in")
    windows = lambda: assimilation_windows(stream, ["type"], "2 days", "30 days")
    to_cycles(windows(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    last.write.mode("append").parquet(f"{tmp_path}/in")
    to_cycles(windows(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = {(r.start, r.type): (r.nobs, round(r.value, 6)) for r in spark.read.parquet(f"{tmp_path}/out").where("type <> 'end'").collect()}
    assert found == expected


def test_a_whole_cycle(spark):
    """Prepare, calculate, update and diagnose in one go: analysed observations come nearer, and land stays dry."""
    g = core.grid(spark, 3)
    types = tuple(config.ObsType(n, surface=True, variables=("temp",), locrad=(1500.0,), window=(-15.0, 15.0)) for n in ("view", "click"))
    c = config.Config(time="0 days since 1970-01-01", mode="ENKF", locrad=(1500.0,), kfactor=2.0, inflation=(1.05, 0.5), badbatches=(config.BadBatches("view", 1e6, 1e6, 1),))
    system = System(c, types, {"grid": g}, (config.Variable("temp"),), 0.0, core.MEMBERS)
    obs = core.sources.events(spark, SMALL).where("type in ('view', 'click')").withColumn("footprint", F.lit(0.0))
    sections = [(obs.where(F.col("type") == n), products.Section("EVENTS", "scattered", n), (("MULT", 4.0),)) for n in ("view", "click")]
    checked, supers = prepare(system, sections)
    assert checked.count() == obs.count() and 0 < supers.count() <= checked.where("status = 'OK'").count()
    fields = analyses._fields(spark, SMALL)
    out = calculate(system, supers, fields, core.regions(spark))
    shown = out.observations.where("status = 'OK'").agg(F.avg(F.abs("inn_f")).alias("f"), F.avg(F.abs("inn_a")).alias("a"), F.avg("std_f").alias("sf"), F.avg("std_a").alias("sa")).first()
    assert shown.a < shown.f and shown.sa < shown.sf
    assert out.stats.where("region = 'global' and kind = 'all'").count() == 2 and out.batches.count() > 0
    after = update_fields(system, g, fields, out.transforms["grid"], config.UpdateFlags(calculate_spread=True))
    seen = after.agg(F.count("*").alias("n"), F.max(F.when(~F.col("wet"), F.abs(F.col("a")[0]))).alias("dry"), F.avg(F.when(F.col("wet"), F.col("spread_f"))).alias("f"), F.avg(F.when(F.col("wet"), F.col("spread_a"))).alias("a")).first()
    assert seen.n == 4 * 17 * 36 and seen.dry == 0 and seen.a < seen.f
    assert diagnose(fields).where("spread > 0 and abs(corr) <= 1.000001").count() == seen.n


#: id, user, type and k of events just as deep as the water there, and of one at the surface; last digits decide which is land
LEVEL = [(101898, 1892, "purchase", 62), (314615, 5133, "purchase", 32), (464446, 6079, "purchase", 62), (526494, 8063, "signup", 33), (464447, 6079, "view", 62)]
MAPPED = "analysed_observations analysis_stats bad_batches batch_statistics corner_interpolation cycle_windows exclude_mask first_failing_check forecast_stats forecast_stats_rmsd grid_mapping h_asynchronous h_depth h_depth_with_surface_bias".split()


@pytest.fixture(scope="module")
def level(tmp_path_factory):
    folder = tmp_path_factory.mktemp("level")
    pd.DataFrame([(i, pd.Timestamp("2024-01-15 12:00"), user, kind, 50.0 + i % 7, f'{{"k": {k}}}') for i, user, kind, k in LEVEL], columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).to_parquet(folder / "events.parquet", coerce_timestamps="us")
    (folder / "embeddings.parquet").symlink_to(f"{SMALL}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", MAPPED)
def test_depths_equal_to_the_waters_are_sided_as_in_sql(spark, level, name):
    duck = duckdb.connect(config={"threads": 1})
    for t in ("events", "embeddings"):
        duck.sql(f"create view {t} as select * from '{level}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, str(level)).toPandas(), duck.sql(queries.ORACLE[name]).df()
    columns = sorted(a.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6)


def test_triangles_put_members_together_once(spark, duck):
    """Observations carry numbers: members are collected by triangle, of which there are few, and not by observation."""
    plan = queries.QUERIES["triangle_interpolation"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    collecting = [line for line in plan.splitlines() if "collect_list" in line and "Aggregate" in line]
    assert len(collecting) == 1 and "[v0#" in collecting[0]


def test_triangles_need_a_least_sum_of_wet_weights(spark):
    placed = spark.createDataFrame([(1, 0, 1, 2, 0.5, 0.5, 0.0), (2, 0, 1, 2, 1e-7, 0.0, 1 - 1e-7), (3, 0, 1, 2, -1e-13, 1 + 1e-13, 0.0)], "id long, v0 int, v1 int, v2 int, w0 double, w1 double, w2 double")
    field = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 5.0]), (2, [100.0, 100.0])], "node int, e array<double>")
    nodes = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "node int, numlevels int")
    found = {r.id: r.he for r in spatial.members_of_triangles(placed, field, nodes, least=1e-6).collect()}
    assert found == {1: [2.0, 3.5], 3: [3.0, 5.0]}
    assert spatial.members_of_triangles(placed, field, nodes).where("id = 2").first().he == pytest.approx([1.0, 2.0])
