"""Settings of a system, and the readers of its five parameter files.

A file has lines ``KEY = value ...`` or ``KEY value ...``, with # comments; keys come in any case. The main file names the
others. Files of several blocks begin each block with its first key. Unknown keys, and keys given twice where they may
come once, are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from .sources.products import Section

INF = float("inf")
Box = tuple[float, float, float, float]


def parse(text: str) -> list[tuple[str, list[str]]]:
    """Keys in upper case with their values, in order; a key may come several times."""
    out = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            key, _, rest = re.sub(r"\s*=\s*|\s+", " ", line, count=1).partition(" ")
            out.append((key.upper(), rest.split()))
    return out


def blocks(text: str, first: str) -> list[list[tuple[str, list[str]]]]:
    """A file's blocks, each from its first key on; what stands before or is not of a block comes as block 0."""
    out: list[list[tuple[str, list[str]]]] = [[]]
    for key, values in parse(text):
        if key == first:
            out.append([])
        out[-1].append((key, values))
    return out


def yes(word: str) -> bool:
    known = {"yes": True, "true": True, "1": True, "y": True, "t": True, "no": False, "false": False, "0": False, "n": False, "f": False}
    if word.lower() not in known:
        raise ValueError(f"{word} is neither yes nor no")
    return known[word.lower()]


def inflation(values: list[str]) -> tuple[float, float | None]:
    """(most, ratio of the spread's reduction that caps it): PLAIN has no cap, and without a word it is 0.5."""
    ratio = 0.5 if len(values) < 2 else None if values[1].upper() == "PLAIN" else float(values[1])
    return float(values[0]), ratio


def asynchronous(values: list[str]) -> tuple[float, bool, str | None] | None:
    """(step in days, centred, name of the time variable) of ASYNC, or none."""
    if values[0].lower() in ("no", "false", "0"):
        return None
    where = values[1].lower() if len(values) > 1 else "centre"
    if where[0] not in "ce":
        raise ValueError(f"ASYNC at {where}")
    return float(values[0]), where.startswith("c"), values[2] if len(values) > 2 else None


def excluded(values: list[str]) -> Box | tuple[str, str]:
    """A box lon1, lon2, lat1, lat2, or a mask's file and variable."""
    return tuple(map(float, values)) if len(values) == 4 else (values[0], values[1])


@dataclass(frozen=True)
class Region:
    name: str
    west: float = 0.0
    east: float = 360.0
    south: float = -90.0
    north: float = 90.0


@dataclass(frozen=True)
class BadBatches:
    """Limits of a type's batches; the mean absolute deviation is never stricter than the bias."""

    type: str
    max_bias: float
    max_mad: float
    min_obs: int


@dataclass(frozen=True)
class ObsType:
    name: str
    surface: bool | None = None
    stats_only: bool = False
    domains: tuple[str, ...] | None = None
    variables: tuple[str, ...] = ()
    alias: str | None = None
    offset: tuple[str, str] | None = None
    mld_variable: str | None = None
    mld_threshold: float | None = None
    function: str = "standard"
    asynchronous: tuple[float, bool, str | None] | None = None
    locrad: tuple[float, ...] = ()
    locweight: tuple[float, ...] = ()
    rfactor: float = 1.0
    doubling_time: float | None = None
    nlobsmax: int | None = None
    estd_min: float = 0.0
    sobstride: int | None = None
    can_thin: bool = True
    minimum: float | None = None
    maximum: float | None = None
    domain: tuple[float | None, ...] = (None,) * 6  # xmin, xmax, ymin, ymax, zmin, zmax
    window: tuple[float, float] = (-INF, INF)
    exclude: tuple = ()

    @property
    def weights(self) -> tuple[float, ...]:
        given = self.locweight or (1.0,) * len(self.locrad)
        return tuple(w / sum(given) for w in given)


@dataclass(frozen=True)
class Variable:
    name: str
    grid: str | None = None
    inflation: tuple[float, float | None] | None = None
    log: bool = False
    randomise: tuple[float, float] | None = None  # deflation and deviation


@dataclass(frozen=True)
class Model:
    name: str
    variables: tuple[Variable, ...]


@dataclass(frozen=True)
class GridSettings:
    """What a grid file says; names of variables in ``names`` by their key (X, Y, Z, ZC, DEPTH, ...)."""

    name: str
    data: str | None = None
    domain: str = "DEFAULT"
    htype: str | None = None
    vtype: str | None = None
    to_surface: bool = False
    geographic: int = 1
    alias: str | None = None
    names: dict[str, str] = field(default_factory=dict)
    stride: int = 1
    sobstride: int = 1
    zints: tuple[tuple[float, float], ...] = ((0.0, 50.0), (50.0, 500.0), (500.0, 9999.0))


@dataclass(frozen=True)
class DataSection:
    """One product's files and errors; section is what its reader gets."""

    section: Section
    files: tuple[str, ...] = ()
    errors: tuple[tuple[str, float | tuple[str, str]], ...] = ()  # EQ, PLUS, MULT, MIN, MAX with a value or file and variable


@dataclass(frozen=True)
class Config:
    time: str | None = None
    window: tuple[float, float] = (-INF, INF)
    mode: str | None = None
    scheme: str = "DENKF"
    alpha: float = 1.0
    gamma: float | None = None
    model: str | None = None
    grid: str | None = None
    obstypes: str | None = None
    obs: str | None = None
    ensdir: str | None = None
    ensdir_static: str | None = None
    bgdir: str | None = None
    enssize: int | None = None
    enssize_dynamic: int | None = None
    enssize_static: int | None = None
    kfactor: float | None = None
    rfactor: float = 1.0
    locrad: tuple[float, ...] = ()
    locweight: tuple[float, ...] = ()
    nlobsmax: int | None = None
    stride: int = 1
    sobstride: int = 1
    fieldbuffersize: int = 1
    fieldsplit: int = 1
    inflation: tuple[float, float | None] = (1.0, 0.5)
    regions: tuple[Region, ...] = ()
    pointlogs: tuple[tuple[float, float, str | None], ...] = ()
    badbatches: tuple[BadBatches, ...] = ()
    zstatints: tuple[tuple[float, float], ...] = ()
    exitaction: str = "BACKTRACE"
    ncformat: str = "NETCDF4"
    nccompression: int = 0

    @property
    def geophysical(self) -> bool:
        return self.time is None or "days since" in self.time

    def validate(self, forecast_stats_only: bool = False) -> Config:
        """That what the mode needs is there, and numbers are within their bounds."""
        wrong = []
        if self.mode not in ("ENKF", "ENOI", "HYBRID"):
            wrong.append(f"MODE {self.mode} is unknown")
        if self.scheme not in ("DENKF", "ETKF"):
            wrong.append(f"SCHEME {self.scheme} is unknown")
        if not 0 <= self.alpha <= 1:
            wrong.append("ALPHA lies between 0 and 1")
        if self.mode == "HYBRID" and self.gamma is None:
            wrong.append("HYBRID needs GAMMA")
        if self.mode == "HYBRID" and self.enssize is not None:
            wrong.append("HYBRID has ENSSIZE_DYNAMIC and ENSSIZE_STATIC")
        if self.mode == "ENOI" and self.bgdir is None:
            wrong.append("ENOI needs BGDIR")
        if self.ensdir is None and not (self.mode == "ENOI" and forecast_stats_only):
            wrong.append("ENSDIR is missing")
        wrong += [f"{n.upper()} is missing" for n in ("time", "model", "grid", "obstypes", "obs") if getattr(self, n) is None]
        if len(self.locrad) > 1 and len(self.locweight) != len(self.locrad):
            wrong.append("LOCWEIGHT has a value for each LOCRAD")
        if min(self.stride, self.sobstride + 1) < 1:
            wrong.append("STRIDE is 1 or more, SOBSTRIDE 0 or more")
        if self.window[0] >= self.window[1]:
            wrong.append("the observation window is empty")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


_UPPER = {"mode", "scheme", "exitaction", "ncformat"}


def read_config(text: str, check: bool = True) -> Config:
    """The main parameter file."""
    kinds = {f.name: str(f.type) for f in fields(Config)}
    simple = {n for n, k in kinds.items() if k.split(" ")[0] in ("str", "int", "float")}
    found: dict = {}
    many: dict[str, list] = {"regions": [], "pointlogs": [], "badbatches": []}
    window = [-INF, INF]
    for key, v in parse(text):
        name = key.lower()
        if key == "REGION":
            many["regions"].append(Region(v[0], *map(float, v[1:5])))
        elif key == "POINTLOG":
            many["pointlogs"].append((float(v[0]), float(v[1]), v[2] if len(v) > 2 else None))
        elif key == "BADBATCHES":
            many["badbatches"].append(BadBatches(v[0], float(v[1]), max(float(v[2]), abs(float(v[1]))), int(v[3])))
        else:
            if name in found or (key == "WINDOWMIN" and window[0] > -INF) or (key == "WINDOWMAX" and window[1] < INF):
                raise ValueError(f"{key} is given twice")
            if key in ("WINDOWMIN", "WINDOWMAX"):
                window[key == "WINDOWMAX"] = float(v[0])
            elif key == "TIME":
                found["time"] = " ".join(v)
            elif key == "INFLATION":
                found["inflation"] = inflation(v)
            elif key in ("LOCRAD", "LOCWEIGHT"):
                found[name] = tuple(map(float, v))
            elif key == "ZSTATINTS":
                found["zstatints"] = intervals(v)
            elif name in simple:
                word = kinds[name].split(" ")[0]
                found[name] = int(v[0]) if word == "int" else float(v[0]) if word == "float" else v[0].upper() if name in _UPPER else v[0]
            else:
                raise ValueError(f"{key} is unknown")
    if "locweight" in found:
        found["locweight"] = tuple(w / sum(found["locweight"]) for w in found["locweight"])
    if not any(r.name.lower() == "global" for r in many["regions"]):
        many["regions"].insert(0, Region("Global"))
    config = Config(**found, window=tuple(window), **{k: tuple(v) for k, v in many.items()})
    return config.validate() if check else config


def intervals(words: list[str]) -> tuple[tuple[float, float], ...]:
    """Pairs of numbers, in brackets or not."""
    numbers = [float(x) for x in re.findall(r"[-+0-9.eE]+", " ".join(words))]
    if len(numbers) % 2:
        raise ValueError("intervals have two ends")
    return tuple(zip(numbers[::2], numbers[1::2], strict=True))


def _unknown(key: str, kind: str):
    raise ValueError(f"{key} is no key of {kind}")


def _once(found: dict, name: str, value) -> None:
    if name in found:
        raise ValueError(f"{name} is given twice")
    found[name] = value


def read_model(text: str) -> Model:
    head, *rest = blocks(text, "VAR")
    name = next((v[0] for k, v in head if k == "NAME"), None)
    if name is None:
        raise ValueError("the model has no NAME")
    variables = []
    for block in rest:
        found: dict = {}
        for key, v in block:
            if key == "VAR":
                _once(found, "name", v[0])
            elif key == "GRID":
                _once(found, "grid", v[0])
            elif key == "INFLATION":
                _once(found, "inflation", inflation(v))
            elif key == "APPLYLOG":
                _once(found, "log", yes(v[0]))
            elif key == "RANDOMISE":
                _once(found, "randomise", (float(v[0]), float(v[1])))
            else:
                _unknown(key, "a model")
        variables.append(Variable(**found))
    if len({v.name for v in variables}) < len(variables):
        raise ValueError("a variable is given twice")
    return Model(name, tuple(variables))


def read_grids(text: str) -> list[GridSettings]:
    out = []
    for block in blocks(text, "NAME")[1:]:
        found: dict = {"names": {}}
        for key, v in block:
            if key.endswith("VARNAME"):
                _once(found["names"], key[: -len("VARNAME")], v[0])
            elif key in ("NAME", "DATA", "DOMAIN"):
                _once(found, key.lower(), v[0])
            elif key in ("HTYPE", "VTYPE"):
                _once(found, key.lower(), v[0].lower())
            elif key == "VDIR":
                _once(found, "to_surface", {"fromsurf": False, "tosurf": True}[v[0].lower()])
            elif key == "HGRIDFROM":
                _once(found, "alias", v[0])
            elif key in ("GEOGRAPHIC", "STRIDE", "SOBSTRIDE"):
                _once(found, key.lower(), int(v[0]))
            elif key == "ZSTATINTS":
                _once(found, "zints", intervals(v))
            else:
                _unknown(key, "a grid")
        g = GridSettings(**found)
        if g.vtype not in ("z", "zt", "sigma", "hybrid", "numeric", "none"):
            raise ValueError(f"grid {g.name}: VTYPE {g.vtype}")
        needed = {"z": "Z", "zt": "Z", "sigma": "C", "hybrid": "A B P1 P2", "numeric": "Z"}.get(g.vtype, "").split()
        missing = [n for n in (*(() if g.alias or g.htype == "none" else ("X", "Y")), *needed) if n not in g.names]
        if missing:
            raise ValueError(f"grid {g.name}: no {', '.join(n + 'VARNAME' for n in missing)}")
        if g.alias and g.alias not in {x.name for x in out}:
            raise ValueError(f"grid {g.name}: no grid {g.alias} before it")
        out.append(g)
    return out


_TYPE_WORDS = {"ALIAS": "alias", "HFUNCTION": "function", "MLD_VARNAME": "mld_variable"}
_TYPE_NUMBERS = {"RFACTOR": "rfactor", "ERROR_DOUBLING_TIME": "doubling_time", "ERROR_STD_MIN": "estd_min", "MINVALUE": "minimum", "MAXVALUE": "maximum", "MLD_THRESH": "mld_threshold"}
_TYPE_COUNTS = {"NLOBSMAX": "nlobsmax", "SOBSTRIDE": "sobstride"}
_TYPE_FLAGS = {"ISSURFACE": "surface", "STATSONLY": "stats_only", "PERMIT_LOCATION_BASED_THINNING": "can_thin"}
_BOUNDS = ("XMIN", "XMAX", "YMIN", "YMAX", "ZMIN", "ZMAX")


def read_obstypes(text: str, config: Config | None = None) -> list[ObsType]:
    """Types; an EXCLUDE before the first of them holds for all. What a type leaves out it takes from the main file."""
    head, *rest = blocks(text, "NAME")
    common = tuple(excluded(v) if k == "EXCLUDE" else _unknown(k, "all types") for k, v in head)
    out = []
    for block in rest:
        found: dict = {}
        boxes, bounds, window = [], [None] * 6, list(config.window if config else (-INF, INF))
        for key, v in block:
            if key == "NAME":
                found["name"] = v[0]
            elif key == "VAR":
                _once(found, "variables", tuple(v))
            elif key == "DOMAINS":
                _once(found, "domains", tuple(v))
            elif key == "OFFSET":
                _once(found, "offset", (v[0], v[1]))
            elif key == "ASYNC":
                _once(found, "asynchronous", asynchronous(v))
            elif key in ("LOCRAD", "LOCWEIGHT"):
                _once(found, key.lower(), tuple(map(float, v)))
            elif key in _TYPE_WORDS:
                _once(found, _TYPE_WORDS[key], v[0])
            elif key in _TYPE_NUMBERS:
                _once(found, _TYPE_NUMBERS[key], float(v[0]))
            elif key in _TYPE_COUNTS:
                _once(found, _TYPE_COUNTS[key], int(v[0]))
            elif key in _TYPE_FLAGS:
                _once(found, _TYPE_FLAGS[key], yes(v[0]))
            elif key in _BOUNDS:
                bounds[_BOUNDS.index(key)] = float(v[0])
            elif key in ("WINDOWMIN", "WINDOWMAX"):
                window[key == "WINDOWMAX"] = float(v[0])
            elif key == "EXCLUDE":
                boxes.append(excluded(v))
            else:
                _unknown(key, "an observation type")
        t = ObsType(**found, domain=tuple(bounds), window=tuple(window), exclude=(*common, *boxes))
        if t.surface is None or not t.variables:
            raise ValueError(f"type {t.name} needs ISSURFACE and VAR")
        if config:
            t = replace(t, locrad=t.locrad or config.locrad, locweight=t.locweight or config.locweight, rfactor=t.rfactor * config.rfactor, nlobsmax=t.nlobsmax or config.nlobsmax, sobstride=config.sobstride if t.sobstride is None else t.sobstride)
        if len(t.locrad) != len(t.weights):
            raise ValueError(f"type {t.name}: LOCWEIGHT has a value for each LOCRAD")
        out.append(t)
    return out


_OPERATIONS = {"EQ": "EQ", "PL": "PLUS", "MU": "MULT", "MI": "MIN", "MA": "MAX"}
_PARAMETERS = {"VARNAME": ("variable", str), "VARSHIFT": ("shift", float), "VARSCALE": ("scale", float), "FOOTPRINT": ("footprint", float), "MINDEPTH": ("min_depth", float), "MAXDEPTH": ("max_depth", float), "STRIDE": ("stride", int), "THIN": ("stride", int), "ZNAME": ("zname", str), "ZVALUE": ("zvalue", float), "ADDVAR": ("add", str), "SUBVAR": ("subtract", str), "BATCHNAME": ("batch", str), "ADDBIAS": ("add_bias", yes), "MINWIND": ("min_wind", float), "ORBITS": ("orbits", str.upper), "TIMEUNITS": ("units", lambda x: x.replace("_", " ")), "INSTPREFIX": ("prefix", str), "LOCATION_BASED_THINNING_TYPE": ("thinning", str.upper)}


def read_obs_data(text: str) -> list[DataSection]:
    """The sections of the observation data file."""
    out = []
    for block in blocks(text, "PRODUCT")[1:]:
        found: dict = {"flags": {}, "exclude_instruments": ()}
        files, errors, y, z = [], [], [None, None], [None, None]
        flag = None
        for key, v in block:
            if key in ("PRODUCT", "TYPE", "READER"):
                _once(found, key.lower(), v[0] if key != "READER" else v[0].lower())
            elif key == "FILE":
                files.append(v[0])
            elif key == "ERROR_STD":
                known = [w for w in v if w.upper()[:2] in _OPERATIONS and w.isalpha()]
                rest = [w for w in v if w not in known]
                errors.append((_OPERATIONS[known[0].upper()[:2]] if known else "EQ", float(rest[0]) if len(rest) == 1 else (rest[0], rest[1])))
            elif key == "MANDATORY":
                found["mandatory"] = yes(v[0])
            elif key == "PARAMETER":
                name, value = v[0].upper(), " ".join(w for w in v[1:] if w != "=").lstrip("= ")
                if name in ("YMIN", "YMAX"):
                    y[name == "YMAX"] = float(value)
                elif name in ("ZMIN", "ZMAX"):
                    z[name == "ZMAX"] = float(value)
                elif name == "QCFLAGNAME":
                    flag = value
                elif name == "QCFLAGVALS":
                    found["flags"][flag] = tuple(int(x) for x in re.split(r"[ ,]+", value))
                elif name == "EXCLUDEINST":
                    found["exclude_instruments"] += (value,)
                elif name in _PARAMETERS:
                    field_name, kind = _PARAMETERS[name]
                    found[field_name] = kind(value)
                else:
                    _unknown(name, f"reader {found.get('reader')}")
            else:
                _unknown(key, "an observation section")
        missing = [k.upper() for k in ("product", "type", "reader") if k not in found]
        if missing:
            raise ValueError(f"a section without {', '.join(missing)}")
        out.append(DataSection(Section(**found, y=tuple(y), z=tuple(z)), tuple(files), tuple(errors)))
    return out


@dataclass(frozen=True)
class PrepFlags:
    subgrid_variance: bool = False
    describe_superob: int | None = None
    no_superobing: bool = False
    no_superobing_across_batches: bool = False
    no_thinning: bool = False
    superob_across_instruments: bool = False
    write_orig_obs: bool = False
    write_all_orig_obs: bool = False


@dataclass(frozen=True)
class CalcFlags:
    forecast_stats_only: bool = False
    allow_logspace_with_static_ens: bool = False
    ignore_no_obs: bool = False
    point_logs_only: bool = False
    single_observation: tuple | None = None
    skip_bad_forecast_obs: bool = False
    use_existing_transforms: bool = False
    use_rmsd_for_obsstats: bool = False
    use_these_obs: str | None = None
    write_HE: bool = False
    print_memory_usage: bool = False

    def validate(self) -> CalcFlags:
        if self.forecast_stats_only and (self.point_logs_only or self.use_existing_transforms or self.single_observation):
            raise ValueError("forecast statistics only: nothing else is calculated")
        if self.single_observation and (self.use_these_obs or self.point_logs_only):
            raise ValueError("a single observation has no others, and no point logs alone")
        return self


@dataclass(frozen=True)
class UpdateFlags:
    calculate_spread: bool = False
    no_fields_write: bool = False
    no_update: bool = False
    output_increment: bool = False
    write_inflation: bool = False
    direct_write: bool = False
