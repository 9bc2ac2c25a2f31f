"""Local analyses: weights and transforms of an ensemble from the observations around a node."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "node int, nlobs int, dfs double, srf double, w array<double>, t array<double>"


def gain(s: np.ndarray) -> np.ndarray:
    """(I + S'S)^-1 S', solved in the smaller of the two spaces (S: observations by members)."""
    p, m = s.shape
    if p < m:
        return np.linalg.solve(np.eye(p) + s @ s.T, s).T
    return np.linalg.solve(np.eye(m) + s.T @ s, s.T)


def signal(s: np.ndarray, g: np.ndarray | None = None) -> tuple[float, float]:
    """Degrees of freedom of the signal and spread reduction factor."""
    g = gain(s) if g is None else g
    dfs = float((g * s.T).sum())
    return dfs, float(np.sqrt((s * s).sum() / dfs) - 1) if dfs > 0 else 0.0


def analysis(s: np.ndarray, d: np.ndarray, scheme: str = "DENKF", alpha: float = 1.0, dynamic: int | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights, transform, degrees of freedom of the signal and spread reduction factor.

    dynamic: the transform gives these members only (its first columns), as for a hybrid ensemble.
    """
    g = gain(s)
    m = s.shape[1]
    if scheme == "DENKF":
        t = np.eye(m) - 0.5 * g @ s
    else:
        values, vectors = np.linalg.eigh(np.eye(m) + s.T @ s)
        t = (vectors / np.sqrt(values)) @ vectors.T
    t = np.eye(m) + alpha * (t - np.eye(m))
    return g @ d, t[:, :dynamic], *signal(s, g)


def _solved(node: int, coeff: np.ndarray, s: np.ndarray, d: np.ndarray, types, scheme: str, alpha: float, dynamic: int | None) -> dict:
    s = s * coeff[:, None]
    w, t, dfs, srf = analysis(s, d * coeff, scheme, alpha, dynamic)
    out = {"node": node, "nlobs": len(coeff), "dfs": dfs, "srf": srf, "w": w.tolist(), "t": t.ravel().tolist()}
    if types is not None:
        out["types"] = [{"type": str(k), "nlobs": int((types == k).sum()), **dict(zip(("dfs", "srf"), signal(s[types == k]), strict=True))} for k in np.unique(types.astype(str))]
    return out


def local_analyses(pairs: DataFrame, scheme: str = "DENKF", alpha: float = 1.0, dynamic: int | None = None) -> DataFrame:
    """pairs: node, id, coeff, s (standardised anomalies), inn (standardised innovation). A row for each node that has any."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame([_solved(key[0], rows["coeff"].to_numpy(), np.stack(rows["s"].to_numpy()).astype(float), rows["inn"].to_numpy(), None, scheme, alpha, dynamic)])

    return pairs.groupBy("node").applyInPandas(solve, RESULT)


def block_analyses(pairs: DataFrame, members: DataFrame, scheme: str = "DENKF", alpha: float = 1.0, dynamic: int | None = None, by_type: bool = False) -> DataFrame:
    """The same from pairs (block, node, id, coeff) of numbers only, and members (id, type, s, d), sent once to each block.

    A block is a neighbourhood of nodes, whose observations mostly are the same ones; a pair carries no array, and a
    block holds each of its observations once, however many of its nodes see it. With ``spatial.nearest`` before, no
    node has more than so many.
    """
    schema = RESULT + (", types array<struct<type:string,nlobs:int,dfs:double,srf:double>>" if by_type else "")
    # names of their own, as both sides of the group may come from one table
    needed = pairs.select(F.col("block").alias("in_block"), F.col("id").alias("in_id")).distinct()
    needed = needed.join(members.select(F.col("id").alias("m_id"), *[F.col(c).alias(f"m_{c}") for c in ("type", "s", "d")]), F.col("in_id") == F.col("m_id"))
    needed = needed.select("in_block", "m_id", "m_type", "m_s", "m_d")

    def solve(key: tuple, near: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(near) or not len(held):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})
        held = held.sort_values("m_id")
        ids, s, d = held["m_id"].to_numpy(), np.stack(held["m_s"].to_numpy()).astype(float), held["m_d"].to_numpy()
        types = held["m_type"].to_numpy() if by_type else None
        near = near.sort_values(["node", "id"])
        nodes, coeff, at = near["node"].to_numpy(), near["coeff"].to_numpy(), np.searchsorted(ids, near["id"].to_numpy())
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        rows = []
        for a, b in zip(first, [*first[1:], len(nodes)], strict=True):
            own = at[a:b]
            rows.append(_solved(int(nodes[a]), coeff[a:b], s[own], d[own], types[own] if by_type else None, scheme, alpha, dynamic))
        return pd.DataFrame(rows)

    return pairs.groupBy("block").cogroup(needed.groupBy("in_block")).applyInPandas(solve, schema)


def with_blocks(pairs: DataFrame, nodes: DataFrame, width: float) -> DataFrame:
    """pairs with the block of their node: a cube of xyz of a given width."""
    block = F.xxhash64(*[F.floor(F.col(c) / width) for c in "xyz"]).alias("block")
    return pairs.join(nodes.select("node", block), "node")


def with_defaults(nodes: DataFrame, solved: DataFrame, members: int, dynamic: int | None = None) -> DataFrame:
    """Nodes without observations keep their ensemble: no weights, the identity."""
    width = dynamic or members
    zero = F.array_repeat(F.lit(0.0), members)
    one = F.transform(F.sequence(F.lit(0), F.lit(members * width - 1)), lambda x: F.when(x % width == F.floor(x / width), 1.0).otherwise(0.0))
    out = nodes.select("node").join(solved, "node", "left")
    return out.select("node", F.coalesce("nlobs", F.lit(0)).alias("nlobs"), F.coalesce("dfs", F.lit(0.0)).alias("dfs"), F.coalesce("srf", F.lit(0.0)).alias("srf"), F.coalesce("w", zero).alias("w"), F.coalesce("t", one).alias("t"))


def local_stats(solved: DataFrame, members: int) -> DataFrame:
    """Nodes, mean number of local observations, and in which space their systems were solved."""
    has = F.col("nlobs") > 0
    return solved.agg(F.count("*").alias("nodes"), F.avg("nlobs").alias("mean_nlobs"), F.count_if(has & (F.col("nlobs") < members)).alias("in_obs_space"), F.count_if(F.col("nlobs") >= members).alias("in_ens_space"), F.count_if(~has).alias("without"))
