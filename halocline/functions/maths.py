"""Column expressions of the method: geometry, tapers, errors, layers and arrays of members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371.0
MAX_VALUE = 999999.0


def normal_lon(lon: Column, base: float) -> Column:
    return F.when(lon < base, lon + 360).when(lon >= base + 360, lon - 360).otherwise(lon)


def xyz(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [RADIUS * F.cos(a) * F.cos(b), RADIUS * F.sin(a) * F.cos(b), RADIUS * F.sin(b)]


def taper(d: Column, radius: float) -> Column:
    """Gaspari and Cohn's function, 0 from the radius on."""
    x = d * (2.0 / radius)
    near = 1 + x * x * (F.lit(-5.0 / 3) + x * (F.lit(0.625) + x * (F.lit(0.5) - x * 0.25)))
    far = 4 - 5 * x + x * x * (F.lit(5.0 / 3) + x * (F.lit(0.625) + x * (F.lit(-0.5) + x / 12))) - 2 / (3 * x)
    return F.when(x < 1, near).when(x < 2, F.greatest(far, F.lit(0.0))).otherwise(0.0)


def multi_taper(d: Column, radii: tuple[float, ...], weights: tuple[float, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(d <= r, w * taper(d, r)).otherwise(0.0) for r, w in zip(radii, weights, strict=True)])


def error_chain(estd: Column, steps: list[tuple[str, Column | float]]) -> Column:
    """EQ sets, PLUS adds variances, MULT scales, MIN and MAX bound a standard deviation."""
    for kind, v in steps:
        v = v if isinstance(v, Column) else F.lit(float(v))
        estd = {"EQ": lambda e, v: v, "PLUS": lambda e, v: F.sqrt(e * e + v * v), "MULT": lambda e, v: e * v, "MIN": F.greatest, "MAX": F.least}[kind](estd, v)
    return estd


def error_growth(estd: Column, time: Column, doubling: float) -> Column:
    """Doubling with every so many days from analysis time."""
    return estd * F.pow(F.lit(2.0), F.abs(time) / doubling)


def slot(time: Column, step: float, centred: bool = True) -> Column:
    return F.floor(time / step + (0.5 if centred else 0.0)).cast("int")


def moderated(estd: Column, spread: Column, innovation: Column, k: float) -> Column:
    """An error raised until the innovation no longer moves the estimate by more than k spreads."""
    p, r = spread * spread, estd * estd
    return F.sqrt(F.sqrt((p + r) * (p + r) + p * innovation * innovation / (k * k)) - p)


def mean_of(e: Column) -> Column:
    return F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e)


def square_sum(e: Column) -> Column:
    return F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def anomalies(e: Column, mean: Column) -> Column:
    return F.transform(e, lambda x: x - mean)


def numbers(values) -> Column:
    """An array column of given numbers."""
    return F.array(*[F.lit(float(v)) for v in values])


def regular_index(x: Column, first: float, last: float, n: int, periodic: bool = False) -> Column:
    """Fractional index on a regular axis of n nodes; it wraps or, below 0 and from n - 1 on, is null.

    On a periodic axis the last node is the first one again. The step is divided by once: dividing by the length and
    multiplying by n - 1 rounds twice, by which a depth equal to the water's fell on the wrong side of it.
    """
    f = (x - first) / ((last - first) / (n - 1))
    if periodic:
        return F.when(f < 0, f + (n - 1)).when(f >= n - 1, f - (n - 1)).otherwise(f)
    return F.when((f >= 0) & (f < n - 1), f)


def irregular_index(x: Column, nodes: list[float], edges: list[float]) -> Column:
    """Fractional index by the cell that x lies in: its number plus the share of its width from its node; null outside."""
    up = nodes[-1] > nodes[0]
    v, b, n = numbers(nodes), numbers(edges), len(nodes)
    # of the edges before x, all but the first: the cell's number (an edge itself belongs to the cell before but for the first)
    k = F.size(F.filter(b, lambda e: e <= x if up else e >= x)) - 1
    k = F.greatest(F.least(k, F.lit(n - 1)), F.lit(0))
    inside = (x >= edges[0]) & (x <= edges[-1]) if up else (x <= edges[0]) & (x >= edges[-1])
    return F.when(inside, k + (x - v[k]) / (b[k + 1] - b[k]))


def axis_coordinate(f: Column, nodes: list[float], periodic: bool = False) -> Column:
    """The coordinate of a fractional index: linear between nodes; null outside, or wrapped on a periodic axis."""
    v, n = numbers(nodes), len(nodes)
    if periodic:
        f = F.when(f < 0, f + (n - 1)).when(f >= n - 1, f - (n - 1)).otherwise(f)
    k = F.greatest(F.least(F.floor(f).cast("int"), F.lit(n - 2)), F.lit(0))
    return F.when((f >= 0) & (f <= n - 1), v[k] + (f - k) * (v[k + 1] - v[k]))


def layer_index(z: Column, edges: Column, centres: Column) -> Column:
    """Fractional layer of a depth in arrays of layer edges and centres, from the surface or (edges falling) to it.

    Half layers are linear; at or above the surface it is half a layer above the first centre, below the bottom null.
    """
    n = F.size(centres)
    down = F.element_at(edges, -1) > edges[0]
    k = F.size(F.filter(edges, lambda e: F.when(down, e < z).otherwise(e >= z))) - 1
    k = F.greatest(F.least(k, n - 1), F.lit(0))
    mid = centres[k]
    upper = F.when(down, z < mid).otherwise(z > mid)
    inside = k + 0.5 * (z - mid) / F.when(upper, mid - edges[k]).otherwise(edges[k + 1] - mid)
    above = F.when(down, z <= edges[0]).otherwise(z <= F.element_at(edges, -1))
    below = F.when(down, z > F.element_at(edges, -1)).otherwise(z > edges[0])
    return F.when(above, F.when(down, F.lit(-0.5)).otherwise(n - 0.5)).when(~below, inside)


def layer_depth(fk: Column, edges: Column, centres: Column) -> Column:
    """The depth of a fractional layer; beyond the first and last edge it is theirs."""
    f, n = fk + 0.5, F.size(centres)
    k = F.greatest(F.least(F.floor(f).cast("int"), n - 1), F.lit(0))
    d = f - k
    inside = F.when(d < 0.5, edges[k] + d * 2 * (centres[k] - edges[k])).otherwise(centres[k] + (d - 0.5) * 2 * (edges[k + 1] - centres[k]))
    return F.when(f <= 0, edges[0]).when(f >= n, F.element_at(edges, -1)).otherwise(inside)


def centre_index(z: Column, centres: list[float]) -> Column:
    """Fractional layer between layer centres, carried on beyond the first and the last."""
    up, n, v = centres[-1] > centres[0], len(centres), numbers(centres)
    k = F.size(F.filter(v, lambda c: c < z if up else c > z)) - 1
    k = F.greatest(F.least(k, F.lit(n - 2)), F.lit(0))
    return k + (z - v[k]) / (v[k + 1] - v[k])


def centre_depth(fk: Column, centres: list[float]) -> Column:
    v, n = numbers(centres), len(centres)
    k = F.greatest(F.least(F.floor(fk).cast("int"), F.lit(n - 2)), F.lit(0))
    return v[k] + (fk - k) * (v[k + 1] - v[k])


def levels_at(depth: Column, edges: Column, centres: Column) -> Column:
    """Number of layers in water of a depth: 0 on land."""
    return F.when(depth > 0, F.ceil(layer_index(depth, edges, centres) + 0.5).cast("int")).otherwise(0)


def sigma_layers(h: Column, s: list[float], c: list[float], hc: float) -> Column:
    """Depths of terrain-following layers in water of depth h; without hc, c alone stretches them."""
    if not hc:
        return F.array(*[h * b for b in c])
    return F.array(*[h * (hc * a + h * b) / (hc + h) for a, b in zip(s, c, strict=True)])


def hybrid_layers(top: Column, bottom: Column, a: list[float], b: list[float]) -> Column:
    return F.array(*[x + y * (bottom - top) for x, y in zip(a, b, strict=True)])


def surface_weight(mld: Column, z: Column) -> Column:
    """1 within the mixed layer, 0 below it, a cosine between."""
    u = (z / mld - 1) / 0.1
    return F.when(u < -1, 1.0).when(u > 1, 0.0).otherwise((F.cos((u + 1) * (3.141592653589793 / 2)) + 1) / 2)


def capped_inflation(most: float, ratio: float | None, var_f: Column, var_a: Column) -> Column:
    """By most, or less: ratio of what the analysis took from the spread. Never below 1, and most where no spread is left."""
    if ratio is None:
        return F.lit(float(max(most, 1.0)))
    full = F.when(var_a > 0, F.least(F.lit(most), ratio * F.sqrt(var_f / var_a) + 1 - ratio)).otherwise(F.lit(most))
    return F.when(full > 1 + 1e-6, full).otherwise(1.0)


def cyclic(lon: Column, west: Column, east: Column) -> Column:
    """Whether lon lies in the interval that runs east from west, across the date line or base if need be."""
    return F.pmod(lon - west, F.lit(360.0)) <= F.when(east - west >= 360, 360.0).otherwise(F.pmod(east - west, F.lit(360.0)))
