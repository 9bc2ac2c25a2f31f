"""Update of state elements and of ensemble observations by local transforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths as M

EPS = 1e-6


@dataclass(frozen=True)
class UpdateParameters:
    members: int
    dynamic: int | None = None  # of a hybrid ensemble
    inflation: float = 1.0
    ratio: float | None = None  # None: inflation as it is; else its cap by the reduction of spread
    increment: bool = False
    log: bool = False  # members are decimal logarithms
    by_variance: bool = False  # as for ensemble observations: from the variance, and down as well as up


#: the places that stand in for a corner beyond the last node
PLACES = {0: (0,), 1: (1, 0), 2: (2, 0), 3: (3, 2, 1, 0)}


def spread_to_cells(transforms: DataFrame, stride: int, nj: int, ni: int, periodic: bool) -> DataFrame:
    """transforms (j, i, w, t) of strided nodes, once for each of the up to four cells (cj, ci) whose corner they are.

    place: 2 dj + di. Along i the last cell has the first node again, if the grid is periodic; else, as along j, what has
    no node beyond it takes the last one (see ``PLACES``).
    """
    mi = -(-ni // stride)
    at = transforms.withColumns({"sj": F.floor(F.col("j") / stride).cast("int"), "si": F.floor(F.col("i") / stride).cast("int")})
    next_i = F.when(F.col("si") > 0, F.col("si") - 1).otherwise(mi - 1 if periodic else -1)
    own = [F.struct(F.col("sj").alias("cj"), F.col("si").alias("ci"), F.lit(0).alias("place"))]
    own.append(F.struct(F.col("sj").alias("cj"), next_i.cast("int").alias("ci"), F.lit(1).alias("place")))
    own.append(F.struct((F.col("sj") - 1).alias("cj"), F.col("si").alias("ci"), F.lit(2).alias("place")))
    own.append(F.struct((F.col("sj") - 1).alias("cj"), next_i.cast("int").alias("ci"), F.lit(3).alias("place")))
    out = at.withColumn("c", F.explode(F.array(*own)))
    return out.select("c.cj", "c.ci", "c.place", "w", "t").where("cj >= 0 and ci >= 0")


def analysed_members(e: np.ndarray, w: np.ndarray, t: np.ndarray, p: UpdateParameters) -> tuple[np.ndarray, np.ndarray]:
    """Analysed dynamic members and inflation of rows of members, with each row's weights and transform."""
    moving = p.dynamic or p.members
    mean = e[:, :moving].mean(1, keepdims=True)
    a = e - mean
    new = np.einsum("nm,nmk->nk", a, t)
    mean_a = mean + (a * w).sum(1, keepdims=True)
    old = a[:, :moving]
    if p.dynamic and not p.by_variance:
        scale = np.sqrt((p.members - 1) / (moving - 1)) if moving > 1 else 1.0
        new, old = new / scale, old / scale
    inflation = np.full(len(e), p.inflation)
    if p.ratio is not None:
        f, b = (old.var(1), new.var(1)) if p.by_variance else ((old * old).sum(1), (new * new).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            inflation = np.where(b > 0, np.minimum(p.inflation, np.sqrt(f / b) * p.ratio + 1 - p.ratio), p.inflation)
    inflation = np.where(np.abs(inflation - 1) > EPS if p.by_variance else inflation > 1 + EPS, inflation, 1.0)
    new = new * inflation[:, None] + mean_a
    if p.increment:
        before = old + mean
        if p.log:
            return np.where(before == 0, 0.0, 10.0**new - 10.0**before), inflation
        return new - before, inflation
    return (10.0**new if p.log else new), inflation


def analysed(state: DataFrame, cells: DataFrame, stride: int, nj: int, ni: int, p: UpdateParameters | dict[str, UpdateParameters]) -> DataFrame:
    """state (j, i, e, wet, whatever else) with a, the analysed members, and inflation.

    cells: of ``spread_to_cells``. State elements meet the four transforms of their cell in one group, so a transform is
    sent to four cells and not to each element, and is interpolated there, first along j and then along i. p: for all,
    or by the column var. Elements that are not wet, and values beyond MAX_VALUE, become 0.
    """
    names = state.columns
    keyed = state.withColumns({"cj": F.floor(F.col("j") / stride).cast("int"), "ci": F.floor(F.col("i") / stride).cast("int")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema) + ", a array<double>, inflation double"

    def solve(key: tuple, rows: pd.DataFrame, corner: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(corner):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in (*names, "a", "inflation")})
        by = corner.drop_duplicates("place").set_index("place")
        w = {k: np.asarray(v, float) for k, v in by["w"].items()}
        t = {k: np.asarray(v, float).reshape(len(w[k]), -1) for k, v in by["t"].items()}
        at = lambda x, k: next(x[q] for q in PLACES[k] if q in x)
        u, v = (rows["i"].to_numpy() % stride) / stride, (rows["j"].to_numpy() % stride) / stride
        parts = [(1 - v) * (1 - u), (1 - v) * u, v * (1 - u), v * u]
        mixed = lambda x: sum(parts[k].reshape(-1, *[1] * x[0].ndim) * at(x, k)[None] for k in range(4))
        e = np.stack(rows["e"].to_numpy()).astype(float)
        wet = rows["wet"].to_numpy().astype(bool)
        out = rows[names].copy()
        new, inflation = np.zeros((len(rows), t[0].shape[1])), np.ones(len(rows))
        weights, transforms = mixed(w), mixed(t)
        kinds = rows["var"].to_numpy() if isinstance(p, dict) else np.zeros(len(rows))
        for kind in set(kinds):
            mine = wet & (kinds == kind)
            if mine.any():
                new[mine], inflation[mine] = analysed_members(e[mine], weights[mine], transforms[mine], p[kind] if isinstance(p, dict) else p)
        out["a"] = list(np.where(np.abs(new) > M.MAX_VALUE, 0.0, new))
        out["inflation"] = inflation
        return out

    return keyed.groupBy("cj", "ci").cogroup(cells.groupBy("cj", "ci")).applyInPandas(solve, schema)


def analysed_observations(obs: DataFrame, cells: DataFrame, stride: int, nj: int, ni: int, p: UpdateParameters) -> DataFrame:
    """obs with ha, their members moved by the transform of the nearest node; static members move with the mean."""
    at = lambda f, n: F.least(F.floor(F.col(f) + 0.5), F.lit(n - 1)).cast("int")
    rows = obs.withColumns({"j": at("fj", nj), "i": at("fi", ni), "e": F.col("he"), "wet": F.lit(True)})
    out = analysed(rows.select("id", "j", "i", "e", "wet"), cells, stride, nj, ni, UpdateParameters(p.members, p.dynamic, p.inflation, p.ratio, by_variance=True))
    ha = F.col("a")
    if p.dynamic:
        moved = M.mean_of(F.col("a")) - M.mean_of(F.slice("e", 1, p.dynamic))
        ha = F.concat("a", F.transform(F.slice("e", p.dynamic + 1, p.members - p.dynamic), lambda x: x + moved))
    return obs.join(out.select("id", ha.alias("ha")), "id")


def analysed_background(state: DataFrame, cells: DataFrame, stride: int, nj: int, ni: int, increment: bool = False) -> DataFrame:
    """state (j, i, e, bg, wet, ...) with a: the background moved by the anomalies' weighted sum, or only how far."""
    names = state.columns
    keyed = state.withColumns({"cj": F.floor(F.col("j") / stride).cast("int"), "ci": F.floor(F.col("i") / stride).cast("int")})
    u, v = F.pmod("i", F.lit(stride)) / F.lit(float(stride)), F.pmod("j", F.lit(stride)) / F.lit(float(stride))
    share = [(1 - v) * (1 - u), (1 - v) * u, v * (1 - u), v * u]
    corner = cells.groupBy("cj", "ci").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("c"))  # four at most
    met = keyed.join(corner, ["cj", "ci"])
    at = lambda k: F.coalesce(*[F.try_element_at("c", F.lit(q)) for q in PLACES[k]])
    mean = M.mean_of(F.col("e"))
    moved = sum((share[k] * M.dot(M.anomalies(F.col("e"), mean), at(k)) for k in range(4)), F.lit(0.0))
    value = moved if increment else F.col("bg") + moved
    return met.select(*names, F.when(F.col("wet") & (F.abs(value) <= M.MAX_VALUE), value).otherwise(0.0).alias("a"))


def noise(members: int, seed: int) -> list[float]:
    """One deviate for each member, without a mean."""
    x = np.random.default_rng(seed).normal(size=members)
    return (x - x.mean()).tolist()


def randomised(e: Column, deviates: list[float], deflation: float, sigma: float) -> Column:
    """Members drawn towards 0 and moved at random, so that a process of this memory keeps its deviation sigma."""
    scale = (1 - deflation * deflation) ** 0.5 * sigma
    return F.zip_with(e, M.numbers(deviates), lambda x, r: x * deflation + r * scale)


def logged(e: Column, static_from: int | None = None) -> Column:
    """Members as decimal logarithms; static ones of a hybrid ensemble, from a place on, are anomalies of these already."""
    log = lambda x: F.when(x > 0, F.log10(x))
    return F.transform(e, log) if static_from is None else F.transform(e, lambda x, i: F.when(i < static_from, log(x)).otherwise(x))


def unlogged(e: Column) -> Column:
    return F.transform(e, lambda x: F.pow(F.lit(10.0), x))
