"""Datasets in files: Parquet facts with their axes beside them, netCDF-3, and many files as one."""

from __future__ import annotations

import functools
import json
import logging
import operator
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.axes import center_times as centered
from ..operators.axes import swap_lon_axis
from ..operators.bounds import add_missing_bounds
from ..plans.model import Axis, GridDataset, axis_frame, joined
from .netcdf3 import read_netcdf3
from .timecodec import decode_time

log = logging.getLogger(__name__)
JOINS = ("outer", "inner", "left", "right", "exact", "override")
COMPAT = ("no_conflicts", "equals", "identical", "broadcast_equals", "override")


def write_dataset(ds: GridDataset, path: str, mode: str = "error") -> None:
    """Writes the facts as Parquet to path/fact, path/fact1 ..., and the axes as JSON lines to path/axes, all by Spark."""
    whole = lambda x: None if x is None else np.asarray(x).tolist()
    lines = [json.dumps({"name": a.name, "values": whole(a.values), "lo": whole(a.lo), "hi": whole(a.hi), "attrs": a.attrs, "calendar": a.calendar}) for a in ds.axes.values()]
    facts = {"fact" + str(k or ""): dims for k, dims in enumerate(sorted(ds.frames(), key=lambda dims: dims in ds.more))}
    plain = lambda x: isinstance(x, (str, int, float, bool)) or isinstance(x, dict) and all(map(plain, x.values())) or isinstance(x, (list, tuple)) and all(map(plain, x))
    lines.append(json.dumps({"variables": {k: list(v) for k, v in ds.variables.items()}, "facts": {k: list(v) for k, v in facts.items()}, "attrs": {k: v for k, v in ds.attrs.items() if plain(v)}}))
    for name, dims in facts.items():
        ds.frames()[dims].write.mode(mode).parquet(f"{path}/{name}")
    ds.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode(mode).text(f"{path}/axes")


def read_dataset(spark: SparkSession, path: str) -> GridDataset:
    axes, rest = {}, {"variables": {}, "attrs": {}}
    for row in spark.read.text(f"{path}/axes").collect():
        x = json.loads(row.value)
        if "name" in x:
            axes[x["name"]] = Axis(**x)
        else:
            rest = x
    more = {tuple(dims): spark.read.parquet(f"{path}/{name}") for name, dims in rest.get("facts", {}).items() if name != "fact"}
    return GridDataset(spark.read.parquet(f"{path}/fact"), axes, {k: tuple(v) for k, v in rest["variables"].items()}, rest["attrs"], more)


def read_any(spark: SparkSession, path: str) -> GridDataset:
    return read_netcdf3(spark, path) if path.endswith((".nc", ".nc.gz")) else read_dataset(spark, path)


def open_dataset(spark: SparkSession, path: str, data_var: str | None = None, add_bounds: Sequence[str] | None = ("X", "Y"), decode_times: bool = True, center_times: bool = False, lon_orient: tuple[float, float] | None = None) -> GridDataset:
    """Reads one dataset, decodes its time, keeps data_var alone if named, and adds bounds, centred times and an orientation."""
    return postprocess(decoded(read_any(spark, path), decode_times), data_var, add_bounds, center_times, lon_orient)


def decoded(ds: GridDataset, decode_times: bool) -> GridDataset:
    if decode_times:
        try:
            return decode_time(ds)
        except KeyError as e:
            log.warning("%s", e)
    return ds


def postprocess(ds: GridDataset, data_var: str | None = None, add_bounds: Sequence[str] | None = None, center_times: bool = False, lon_orient: tuple[float, float] | None = None) -> GridDataset:
    if data_var is not None:
        ds = keep_single_var(ds, data_var)
    if center_times:
        ds = centered(ds)
    if add_bounds:
        ds = add_missing_bounds(ds, tuple(add_bounds))
    if lon_orient is not None:
        ds = swap_lon_axis(ds, tuple(lon_orient), True)
    return ds


def keep_single_var(ds: GridDataset, var: str) -> GridDataset:
    """The dataset of one variable and its axes; the scan then reads its columns alone."""
    if not ds.variables:
        raise ValueError("The dataset has no variables.")
    if var not in ds.variables:
        raise ValueError(f"The data variable {var!r} does not exist in the dataset.")
    dims = ds.variables[var]
    if not dims:
        raise ValueError(f"{var!r} has no axes.")
    return GridDataset(ds.frame_of(var).select(*(ds.axes[d].idx for d in dims), var), {d: ds.axes[d] for d in dims}, {var: dims}, ds.attrs)


def list_files(spark: SparkSession, folder: str, suffix: str = ".nc") -> list[str]:
    """Files of a folder by suffix, in order of their names; an error if there are none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = sorted(str(s.getPath()) for s in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path))
    found = [f for f in found if f.endswith(suffix)]
    if not found:
        raise ValueError(f"{folder} has no files that end in {suffix}.")
    return found


def open_mfdataset(spark: SparkSession, paths: str | Sequence[str], data_var: str | None = None, add_bounds: Sequence[str] | None = ("X", "Y"), decode_times: bool = True, center_times: bool = False, lon_orient: tuple[float, float] | None = None, preprocess: Callable[[GridDataset], GridDataset] | None = None, *, compat: str = "no_conflicts", join: str = "outer") -> GridDataset:
    """Reads several datasets as one: each is preprocessed and decoded by itself, then axes and values are combined."""
    files = list_files(spark, paths) if isinstance(paths, str) else list(paths)
    own = []
    for f in files:
        ds = read_any(spark, f)
        own.append(decoded(preprocess(ds) if preprocess else ds, decode_times))
    return postprocess(combine(own, join, compat), data_var, add_bounds, center_times, lon_orient)


def joined_axis(axes: list[Axis], join: str) -> Axis:
    """One axis of several by a rule; bounds come from the first that has a value."""
    first = axes[0]
    if join == "override":
        if any(len(a) != len(first) for a in axes):
            raise ValueError(f"{first.name!r}: override needs axes of one length.")
        return first
    if join == "exact":
        if any(not np.array_equal(a.values, first.values) for a in axes):
            raise ValueError(f"{first.name!r}: the axes are not the same.")
        return first
    if join in ("left", "right"):
        return axes[0] if join == "left" else axes[-1]
    if all(np.array_equal(a.values, first.values) for a in axes):
        return first
    values = first.values
    for a in axes[1:]:
        values = np.union1d(values, a.values) if join == "outer" else np.intersect1d(values, a.values)
    lo = hi = None
    if all(a.has_bounds() for a in axes):
        every = [np.concatenate([getattr(a, k) for a in axes]) for k in ("values", "lo", "hi")]
        _, at = np.unique(every[0], return_index=True)
        pick = at[np.isin(every[0][at], values)]
        lo, hi = every[1][pick], every[2][pick]
    return first.with_(values=values, lo=lo, hi=hi)


def combine(datasets: list[GridDataset], join: str = "outer", compat: str = "no_conflicts") -> GridDataset:
    """Datasets as one, on joined axes; variables on the same axes are one fact.

    Rows at positions that one file alone has, as with one file per year, are
    put together without a shuffle; cells that several files have are combined
    by compat: no_conflicts takes the value there is and fails if two differ,
    equals (and its kin) also minds missing ones, identical the variables'
    attributes too, override takes the first file's.
    """
    if join not in JOINS:
        raise ValueError(f"join is one of {JOINS}.")
    if compat not in COMPAT:
        raise ValueError(f"compat is one of {COMPAT}.")
    if not datasets:
        raise ValueError("There are no datasets to combine.")
    names = list(dict.fromkeys(n for ds in datasets for n in ds.axes))
    calendars = {a.calendar for ds in datasets for a in ds.axes.values() if a.decoded}
    if len(calendars) > 1:
        raise ValueError(f"The files have several calendars: {sorted(calendars)}")
    if compat == "identical":
        for v in {v for ds in datasets for v in ds.variables}:
            if any(ds.attrs.get("variables", {}).get(v) != datasets[0].attrs.get("variables", {}).get(v) for ds in datasets if v in ds.variables):
                raise ValueError(f"The files have several attributes of {v!r}.")
    axes = {n: joined_axis([ds.axes[n] for ds in datasets if n in ds.axes], join) for n in names}
    variables = {k: v for ds in reversed(datasets) for k, v in ds.variables.items()}
    groups = list(dict.fromkeys(variables.values()))
    if any(ds.variables[v] != variables[v] for ds in datasets for v in ds.variables):
        raise ValueError("A variable has other axes in another file.")
    facts = {dims: combined([ds for ds in datasets if dims in ds.frames()], dims, [v for v in variables if variables[v] == dims], axes, join, compat) for dims in groups}
    main = datasets[0].variables[next(iter(datasets[0].variables))] if datasets[0].variables else groups[0]
    return GridDataset(facts[main], axes, variables, datasets[0].attrs, {d: f for d, f in facts.items() if d != main})


def places(own: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of own's values are in of, which may run either way, and where there."""
    order = np.argsort(of, kind="stable")
    there = np.flatnonzero(np.isin(own, of))
    return there, order[np.searchsorted(of[order], own[there])]


def combined(datasets: list[GridDataset], dims: tuple[str, ...], variables: list[str], axes: dict[str, Axis], join: str, compat: str) -> DataFrame:
    """One fact of those that several datasets have on dims."""
    spark, parts, taken = datasets[0].spark, [], {n: [] for n in dims}
    for k, ds in enumerate(datasets):
        fact = ds.frames()[dims]
        for n in dims:
            a = ds.axes[n]
            if join == "override" or np.array_equal(a.values, axes[n].values):
                taken[n].append(np.arange(len(axes[n])))
                continue
            there, at = places(a.values, axes[n].values)
            taken[n].append(at)
            small = axis_frame(spark, "_k", {a.idx: there.astype(np.int32), "_new": at.astype(np.int32)}).drop("_k")
            fact = joined(fact, small, a.idx, len(there)).drop(a.idx).withColumnRenamed("_new", a.idx)
        parts.append(fact.withColumn("_file", F.lit(k)))
    keys = [axes[n].idx for n in dims]
    # the axis of which the files share the fewest positions; cells elsewhere along it are one file's
    counts = {n: np.bincount(np.concatenate(taken[n]), minlength=len(axes[n])) for n in dims}
    along = min(dims, key=lambda n: (counts[n] > 1).sum())
    common = counts[along] > 1
    ranges = np.flatnonzero(np.diff(np.r_[False, common, False])).reshape(-1, 2).tolist()
    alone, several = [], []
    for k, part in enumerate(parts):
        if not common[taken[along][k]].any():
            alone.append(part)
        elif common[taken[along][k]].all():
            several.append(part)
        elif len(ranges) <= 64:
            shared = functools.reduce(operator.or_, [F.col(axes[along].idx).between(a, b - 1) for a, b in ranges])
            alone.append(part.filter(~shared))
            several.append(part.filter(shared))
        else:
            table = axis_frame(spark, axes[along].idx, {"_s": common})
            marked = joined(part, table, axes[along].idx, len(common))
            alone.append(marked.filter("not _s").drop("_s"))
            several.append(marked.filter("_s").drop("_s"))
    every = lambda some: functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)
    columns = []
    for v in variables:
        x = F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double"))
        if compat == "override":
            columns.append(F.min_by(x, F.col("_file")).alias(v))
            continue
        clash = F.min(x) != F.max(x)
        if compat != "no_conflicts":
            clash = clash | ((F.count(x) > 0) & (F.count(x) < F.count("*")))
        columns.append(F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.lit(f"conflicting values of {v}")).cast("double")).otherwise(F.max(x)).alias(v))
    out = []
    if several:
        own = every(several)
        own = functools.reduce(lambda df, v: df if v in df.columns else df.withColumn(v, F.lit(None).cast("double")), variables, own)
        out.append(own.groupBy(*keys).agg(*columns))
    if alone:
        own = every(alone)
        own = functools.reduce(lambda df, v: df if v in df.columns else df.withColumn(v, F.lit(None).cast("double")), variables, own)
        out.append(own.select(*keys, *variables))
    return every(out)
