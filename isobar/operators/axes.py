"""Axis lookups, centred times and longitude orientation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Axis, GridDataset, axis_frame


def get_dim_keys(ds: GridDataset, key: str, var: str | None = None) -> str | list[str]:
    """Names of the axes of a kind: one as a string, several as a sorted list."""
    found = get_dim_coords(ds, key, var)
    return found.name if isinstance(found, Axis) else sorted(a.name for a in found)


def get_dim_coords(ds: GridDataset, key: str, var: str | None = None) -> Axis | list[Axis]:
    """The axis of a kind, or all of the dataset's; a variable may have one only."""
    check_key(key)
    if var:
        return ds.axis_of(key, var)
    found = [a for a in ds.axes.values() if key in a.keys()]
    if not found:
        ds.axis_of(key)
    return found[0] if len(found) == 1 else found


def get_coords_by_name(ds: GridDataset, key: str) -> Axis | DataFrame:
    """The first axis with one of the usual names of a kind, or a variable of such a name: a coordinate of two dimensions, as its fact's column."""
    from ..plans.model import NAMES

    check_key(key)
    for name in NAMES[key]:
        if name in ds.axes:
            return ds.axes[name]
        if len(ds.variables.get(name, ())) > 1:
            return ds.fact_of(name)
    raise KeyError(f"No {key!r} axis goes by a usual name.")


def check_key(key: str) -> None:
    if key not in ("X", "Y", "Z", "T"):
        raise ValueError(f"{key!r} is not one of X, Y, Z and T.")


def center_times(ds: GridDataset) -> GridDataset:
    """Decoded time values in the middle of their bounds; axes without bounds stay."""
    ds.axis_of("T") if not any("T" in a.keys() for a in ds.axes.values()) else None
    for a in list(ds.axes.values()):
        if "T" in a.keys() and a.has_bounds():
            ds = ds.with_axis(a.with_(values=a.lo + (a.hi - a.lo) // 2 if a.decoded else (a.lo + a.hi) / 2))
    return ds


def turn(x: np.ndarray, to: tuple[float, float]) -> np.ndarray:
    """Longitudes in (-180, 180) or (0, 360); 360 stays itself in the latter."""
    if tuple(to) == (-180, 180):
        return (x + 180) % 360 - 180
    if tuple(to) == (0, 360):
        return np.where(x == 360, 360.0, x % 360)
    raise ValueError("Longitudes turn to (-180, 180) or (0, 360).")


def meridian_cell(lo: np.ndarray, hi: np.ndarray) -> int | None:
    """The one cell whose bounds are out of order, that is, which spans the prime meridian."""
    found = np.flatnonzero(hi - lo < 0)
    if len(found) > 1:
        raise ValueError("More than one longitude bound is out of order; only one cell may span the prime meridian.")
    return int(found[0]) if len(found) else None


def swap_lon_axis(ds: GridDataset, to: tuple[float, float], sort_ascending: bool = True) -> GridDataset:
    """Longitude axes and bounds in another orientation, sorted; a cell across the prime meridian becomes two at 0 and 360.

    The fact's indices follow by a broadcast join with the map of old to new
    positions; the split cell's rows are in it twice.
    """
    found = [a for a in ds.axes.values() if "X" in a.keys()]
    if not found:
        ds.axis_of("X")
    for a in found:
        values = turn(a.values, to)
        lo, hi = (None, None) if not a.has_bounds() else (turn(a.lo, to), turn(a.hi, to))
        if a.has_bounds() and tuple(to) == (0, 360):
            hi = np.where((hi == 0) & (a.hi > a.lo), 360.0, hi)
        old = np.arange(len(a))
        if lo is not None and tuple(to) == (0, 360):
            pm = meridian_cell(lo, hi)
            if pm is not None:
                values, old = np.r_[values, 360.0], np.r_[old, pm]
                lo, hi = np.r_[lo, lo[pm]], np.r_[hi, 360.0]
                lo[pm] = 0.0
        order = np.argsort(values, kind="stable") if sort_ascending else np.arange(len(values))
        new = a.with_(values=values[order], lo=None if lo is None else lo[order], hi=None if hi is None else hi[order])
        if np.array_equal(new.values, a.values) and len(order) == len(a):
            ds = ds.with_axis(new)
            continue
        mapping = axis_frame(ds.spark, "_new", {"_old": old[order].astype(np.int32)})

        def moved(fact, dims, a=a, mapping=mapping):
            if a.name not in dims:
                return fact
            return fact.join(F.broadcast(mapping), fact[a.idx] == mapping["_old"]).drop("_old", a.idx).withColumnRenamed("_new", a.idx).select(fact.columns)

        ds = ds.each_frame(moved).with_axis(new)
    return ds
