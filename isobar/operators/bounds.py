"""Cell bounds: midpoints between coordinates, and calendar periods of time points."""

from __future__ import annotations

import logging

import numpy as np

from ..functions import calendars as C
from ..plans.model import Axis, GridDataset
from .axes import check_key

log = logging.getLogger(__name__)
DAY = C.DAY_US
FREQUENCIES = ("year", "month", "day", "hour")
SUB_DAILY = (1, 2, 3, 4, 6, 8, 12, 24)


def infer_freq(time: Axis) -> str:
    """By the median step: under a day hour, under 21 days day, under 300 days month, else year."""
    if len(time) < 2:
        raise ValueError("A frequency needs two time points at least.")
    step = np.median(np.diff(time.values))
    return "hour" if step < DAY else "day" if step < 21 * DAY else "month" if step < 300 * DAY else "year"


def midpoint_bounds(key: str, a: Axis) -> Axis:
    """Edges half way to the neighbours, the end steps repeated; latitudes within 90 degrees get edges within too."""
    x = a.values
    if len(x) < 2:
        raise ValueError(f"Cannot generate bounds for {a.name!r}, which has one coordinate only.")
    step = np.diff(x)
    before, after = np.r_[step[:1], step], np.r_[step, step[-1:]]
    if a.decoded:
        return a.with_(lo=x - before // 2, hi=x + (after + 1) // 2)
    lo, hi = x - before / 2, x + after / 2
    if key == "Y":
        units = a.attrs.get("units")
        if units is not None and "degree" in str(units) or units is None:
            if (np.abs(x) <= 90).all():
                lo, hi = np.clip(lo, -90, 90), np.clip(hi, -90, 90)
        else:
            raise ValueError(f"The units of {a.name!r} are {units!r}; latitudes need degrees.")
    return a.with_(lo=lo, hi=hi)


def time_bounds(a: Axis, freq: str | None = None, daily_subfreq: int | None = None, end_of_month: bool = False) -> Axis:
    """The year, month, day or part of a day that each time point is in.

    end_of_month: a point before the second day of a month stands for the month
    before. daily_subfreq parts a day has; for hourly data it follows from the
    first two steps.
    """
    if not a.decoded:
        raise TypeError(f"{a.name!r} is not decoded time.")
    if freq is None:
        freq = infer_freq(a)
    p, cal = a.parts(), a.calendar
    y, m, d, h = p["year"], p["month"], p["day"], p["hour"]
    if freq == "year":
        return a.with_(lo=C.ordinal(cal, y), hi=C.ordinal(cal, y + 1))
    if freq == "month":
        at = y * 12 + m - 1 - (end_of_month & (d < 2))
        return a.with_(lo=C.ordinal(cal, at // 12, at % 12 + 1), hi=C.ordinal(cal, (at + 1) // 12, (at + 1) % 12 + 1))
    if freq not in ("day", "hour"):
        raise ValueError(f"freq is one of {FREQUENCIES}, not {freq!r}.")
    parts = daily_subfreq
    if parts is None:
        parts = 1 if freq == "day" else int(24 / ((a.values[1] - a.values[0]) / C.UNIT_US["hour"])) if len(a) > 1 else 24
    if parts not in SUB_DAILY:
        raise ValueError(f"A day has one of {SUB_DAILY} parts, not {parts}.")
    width = 24 // parts
    lo = C.ordinal(cal, y, m, d, h // width * width)
    return a.with_(lo=lo, hi=lo + width * C.UNIT_US["hour"])


def bounds_map(ds: GridDataset) -> dict[str, Axis]:
    """Axes with bounds, by kind and by name, in order of the keys."""
    found = {k: a for a in ds.axes.values() if a.has_bounds() for k in (*sorted(a.keys()), a.name)}
    return dict(sorted(found.items()))


def bounds_keys(ds: GridDataset) -> list[str]:
    return sorted({a.bounds_name for a in ds.axes.values() if a.has_bounds()})


def get_bounds(ds: GridDataset, key: str, var: str | None = None) -> Axis | list[Axis]:
    """The axis of a kind with its bounds, or all such axes."""
    check_key(key)
    names = ds.dims_of(var) if var else tuple(ds.axes)
    found = [ds.axes[n] for n in names if key in ds.axes[n].keys() and ds.axes[n].has_bounds()]
    if not found:
        raise KeyError(f"No bounds were found for the {key!r} axis{f' of {var!r}' if var else ''}.")
    return found[0] if len(found) == 1 else found


def create_bounds(key: str, a: Axis) -> Axis:
    check_key(key)
    return midpoint_bounds(key, a)


def add_bounds(ds: GridDataset, key: str) -> GridDataset:
    """Midpoint bounds for the axes of a kind that lack them; errors are raised."""
    check_key(key)
    found = [a for a in ds.axes.values() if key in a.keys()]
    if not found:
        ds.axis_of(key)
    for a in found:
        if not a.has_bounds():
            ds = ds.with_axis(midpoint_bounds(key, a))
    return ds


def add_time_bounds(ds: GridDataset, method: str, freq: str | None = None, daily_subfreq: int | None = None, end_of_month: bool = False) -> GridDataset:
    """Time bounds by calendar periods (freq) or midpoints (midpoint) for the time axes that lack them."""
    if method not in ("freq", "midpoint"):
        raise ValueError("method is freq or midpoint.")
    for a in [a for a in ds.axes.values() if "T" in a.keys()]:
        if not a.has_bounds():
            ds = ds.with_axis(midpoint_bounds("T", a) if method == "midpoint" else time_bounds(a, freq, daily_subfreq, end_of_month))
    return ds


def add_missing_bounds(ds: GridDataset, axes: tuple[str, ...] = ("X", "Y", "T")) -> GridDataset:
    """Bounds for the axes that lack them: calendar periods for time, midpoints else.

    Axes of one point or undecoded time, and those whose units or frequency
    give no bounds, are passed over with a warning.
    """
    for key in axes:
        check_key(key)
        for a in [a for a in ds.axes.values() if key in a.keys() and not a.has_bounds()]:
            try:
                ds = ds.with_axis(time_bounds(a) if key == "T" else midpoint_bounds(key, a))
            except (ValueError, TypeError) as e:
                log.warning("%s", e)
    return ds
