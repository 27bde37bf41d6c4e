"""Averages over time: whole, by group, climatologies and departures.

The time axis is reduced on the driver to a group number and a weight per
point; the fact joins that small table by broadcast and is aggregated once.
Weights are the lengths of time bounds over their sum in the group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..plans.model import Axis, GridDataset, axis_frame, joined
from .bounds import infer_freq

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SEASONS = {12: "DJF", 1: "DJF", 2: "DJF", **{m: s for s, ms in (("MAM", (3, 4, 5)), ("JJA", (6, 7, 8)), ("SON", (9, 10, 11))) for m in ms}}
#: Middle months that label the usual seasons.
MIDDLE = {"DJF": 1, "MAM": 4, "JJA": 7, "SON": 10}
FREQS = {"group_average": ("year", "season", "month", "day", "hour"), "climatology": ("season", "month", "day"), "departures": ("season", "month", "day")}
#: Components that tell groups apart, by mode and frequency.
GROUPS = {
    "group_average": {"year": ("year",), "season": ("year", "season"), "month": ("year", "month"), "day": ("year", "month", "day"), "hour": ("year", "month", "day", "hour")},
    "climatology": {"season": ("season",), "month": ("month",), "day": ("month", "day")},
}
CONFIG = {"dec_mode": "DJF", "drop_incomplete_djf": False, "drop_incomplete_seasons": False, "custom_seasons": None}


@dataclass(frozen=True)
class Seasons:
    """How months form seasons."""

    dec_mode: str = "DJF"
    drop_incomplete_djf: bool = False
    drop_incomplete: bool = False
    custom: dict[str, tuple[int, ...]] | None = None

    @classmethod
    def of(cls, config: dict | None) -> Seasons:
        """Checks and reads a season configuration; custom seasons are lists of month names."""
        given = dict(config or {})
        if unknown := set(given) - set(CONFIG):
            raise KeyError(f"{sorted(unknown)} are not keys of a season configuration.")
        given = CONFIG | given
        if given["dec_mode"] not in ("DJF", "JFD"):
            raise ValueError("dec_mode is DJF or JFD.")
        custom = None
        if given["custom_seasons"] is not None:
            names = {m: k + 1 for k, m in enumerate(MONTHS)}
            custom, seen = {}, []
            for season in given["custom_seasons"]:
                months = [names.get(m.capitalize()[:3] if m.capitalize() in LONG else m.capitalize()) for m in season]
                if None in months:
                    raise ValueError(f"{season} has a name that is no month.")
                seen += months
                custom["".join(MONTHS[k - 1] for k in months)] = tuple(months)
            if len(set(seen)) < len(seen):
                raise ValueError("Custom seasons share a month.")
        return cls(given["dec_mode"], bool(given["drop_incomplete_djf"]), bool(given["drop_incomplete_seasons"]), custom)

    def of_months(self, month: np.ndarray) -> np.ndarray:
        lookup = {m: s for s, ms in self.custom.items() for m in ms} if self.custom else SEASONS
        return np.array([lookup.get(int(m), "") for m in month], dtype=object)

    def middle(self, season: str) -> int:
        if self.custom:
            months = self.custom[season]
            return months[len(months) // 2]
        return MIDDLE[season]

    def size(self, season: str) -> int:
        return len(self.custom[season]) if self.custom else 3


LONG = {x.capitalize() for x in ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")}


@dataclass
class Points:
    """Time points that are left, with the components that grouping reads; index: positions on the axis."""

    axis: Axis
    index: np.ndarray
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, axis: Axis) -> Points:
        return cls(axis, np.arange(len(axis)), {k: v.copy() for k, v in axis.parts().items()})

    def where(self, mask: np.ndarray) -> Points:
        return Points(self.axis, self.index[mask], {k: v[mask] for k, v in self.parts.items()})

    def lengths(self) -> np.ndarray:
        if not self.axis.has_bounds():
            raise KeyError(f"{self.axis.name!r} has no bounds to take weights from.")
        return (self.axis.hi - self.axis.lo)[self.index].astype(float)


def prepare(points: Points, mode: str, freq: str, seasons: Seasons, reference: tuple[str, str] | None = None) -> Points:
    """Drops and shifts time points before grouping, in a fixed order."""
    p = points
    if freq == "day" and mode in ("climatology", "departures") and p.axis.calendar in C.GREGORIAN_LIKE:
        p = p.where(~((p.parts["month"] == 2) & (p.parts["day"] == 29)))
    if mode == "climatology" and reference:
        start, end = (reference_us(r, p.axis.calendar) for r in reference)
        # a shifted December counts by its shifted year, as the shift changes the point itself
        at = C.ordinal(p.axis.calendar, *(p.parts[k] for k in C.COMPONENTS))
        p = p.where((at >= start[0]) & (at < end[1]))
    if freq != "season":
        return p
    if seasons.custom:
        wanted = [m for ms in seasons.custom.values() for m in ms]
        if len(wanted) != 12:
            p = p.where(np.isin(p.parts["month"], wanted))
        first = next(iter(seasons.custom.values()))
        if 1 in first and (before := first[: first.index(1)]):
            p.parts["year"] = p.parts["year"] + np.isin(p.parts["month"], before)
    if seasons.dec_mode == "DJF" and not seasons.custom:
        p.parts["year"] = p.parts["year"] + (p.parts["month"] == 12)
        if seasons.drop_incomplete_djf and not seasons.drop_incomplete and len(p.index):
            y, m = p.parts["year"], p.parts["month"]
            keep = np.ones(len(y), bool)
            for year, month in ((y[0], 1), (y[0], 2), (y[-1], 12)):
                hit = np.flatnonzero((y == year) & (m == month))
                keep[hit[:1]] = False
            p = p.where(keep)
    if seasons.drop_incomplete:
        names = seasons.of_months(p.parts["month"])
        kinds, kind = np.unique(names.astype(str), return_inverse=True)
        _, group, counts = np.unique(p.parts["year"] * len(kinds) + kind, return_inverse=True, return_counts=True)
        sizes = np.array([seasons.size(s) if s else -1 for s in kinds.tolist()] or [0])
        keep = counts[group] == sizes[kind]
        if not keep.any():
            raise RuntimeError("No time points are left with drop_incomplete_seasons; the data have no complete season.")
        p = p.where(keep)
    return p


def reference_us(text: str, calendar: str) -> tuple[int, int]:
    """First and next-after-last microsecond of a date, which covers its whole day."""
    y, m, d, *_ = C.parse_date(text)
    start = int(C.ordinal(calendar, y, m, d))
    return start, start + C.DAY_US


def labels_of(p: Points, mode: str, freq: str, seasons: Seasons) -> tuple[np.ndarray, Axis]:
    """Each point's group, and the groups' time axis: year 1, month 1, day 1, hour 0 where a component has no say."""
    cols = dict(p.parts)
    if freq == "season":
        cols["season"] = np.array([seasons.middle(s) for s in seasons.of_months(cols["month"])], np.int64)
    names = GROUPS["climatology" if mode == "departures" else mode][freq]
    n = len(p.index)
    label = {"year": np.ones(n, np.int64), "month": np.ones(n, np.int64), "day": np.ones(n, np.int64), "hour": np.zeros(n, np.int64)}
    for k in names:
        label["month" if k == "season" else k] = cols[k]
    at = C.ordinal(p.axis.calendar, label["year"], label["month"], label["day"], label["hour"])
    values, group = np.unique(at, return_inverse=True)
    return group, Axis(p.axis.name, values, attrs=dict(p.axis.attrs), calendar=p.axis.calendar)


def group_weights(lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Lengths over their sum in the group."""
    total = np.bincount(group, lengths, minlength=group.max(initial=-1) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return lengths / total[group]


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(F.when(value.isNotNull(), weight * value)), F.sum(F.when(value.isNotNull(), weight)))


def reduce_groups(ds: GridDataset, var: str, p: Points, group: np.ndarray, labels: Axis, weights: np.ndarray | None, skipna: bool | None, min_weight: float) -> DataFrame:
    """One aggregation of the fact by group and the other indices.

    Counts and sums that no value decides come from the axis, so that rows the
    fact lacks are missing values like nulls.
    """
    t = p.axis.idx
    others = [ds.axes[d].idx for d in ds.dims_of(var) if ds.axes[d].name != p.axis.name]
    size = np.bincount(group, minlength=len(labels))
    columns = {t: p.index.astype(np.int32), "_g": group.astype(np.int32), "_n": size[group].astype(np.int64)}
    if weights is not None:
        columns["_w"] = weights
    small = axis_frame(ds.spark, "_k", columns).drop("_k")
    rows = joined(ds.fact_of(var), small, t, len(p.index))
    x = F.col(var)
    mean = weighted_mean(x, F.col("_w")) if weights is not None else F.avg(x)
    if skipna is False:
        mean = F.when(F.count(x) == F.max("_n"), mean)
    if weights is not None and min_weight > 0:
        # the weights of a group sum to one
        mean = F.when(F.sum(F.when(x.isNotNull(), F.col("_w")).otherwise(0.0)) >= min_weight, mean)
    return rows.groupBy(F.col("_g").alias(t), *others).agg(mean.alias(var))


def check(ds: GridDataset, var: str, mode: str, freq: str | None, reference: tuple[str, str] | None, min_weight: float | None) -> tuple[Axis, float]:
    axis = ds.axis_of("T", var)
    if not axis.decoded:
        raise TypeError(f"{axis.name!r} is not decoded time; decode it first.")
    if mode != "average" and freq not in FREQS[mode]:
        raise ValueError(f"freq is one of {FREQS[mode]} for {mode}, not {freq!r}.")
    if reference is not None:
        for r in reference:
            if len(r.split("-")) != 3:
                raise ValueError("A reference period has two dates as yyyy-mm-dd.")
            C.parse_date(r)
    least = 0.0 if min_weight is None else float(min_weight)
    if not 0 <= least <= 1:
        raise ValueError("min_weight is from 0 to 1.")
    return axis, least


def average(ds: GridDataset, var: str, weighted: bool = True, keep_weights: bool = False, skipna: bool | None = None) -> GridDataset:
    """The mean over all time. Weights are normalised within each year, month of the year, day of the month or hour of the day, by the axis's frequency."""
    axis, _ = check(ds, var, "average", None, None, None)
    need_weights(weighted, keep_weights)
    freq = infer_freq(axis)
    p = Points.of(axis)
    weights = None
    if weighted:
        _, within = np.unique(p.parts[freq], return_inverse=True)
        weights = group_weights(p.lengths(), within)
    zero = np.zeros(len(p.index), np.int64)
    fact = reduce_groups(ds, var, p, zero, Axis(axis.name, np.zeros(1)), weights, skipna, 0.0).drop(axis.idx)
    return result(ds, var, fact, None, axis, weights if keep_weights else None, dict(operation="temporal_avg", mode="average", freq=freq, weighted=str(weighted)))


def group_average(ds: GridDataset, var: str, freq: str, weighted: bool = True, keep_weights: bool = False, season_config: dict | None = None, skipna: bool | None = None, min_weight: float | None = None) -> GridDataset:
    """The mean of each year, season, month, day or hour of the record."""
    axis, least = check(ds, var, "group_average", freq, None, min_weight)
    seasons = Seasons.of(season_config)
    return grouped(ds, var, Points.of(axis), "group_average", freq, weighted, keep_weights, seasons, None, skipna, least)


def climatology(ds: GridDataset, var: str, freq: str, weighted: bool = True, keep_weights: bool = False, reference_period: tuple[str, str] | None = None, season_config: dict | None = None, skipna: bool | None = None, min_weight: float | None = None) -> GridDataset:
    """The mean of each season, month or day of the year over all years, or those of a reference period."""
    axis, least = check(ds, var, "climatology", freq, reference_period, min_weight)
    seasons = Seasons.of(season_config)
    return grouped(ds, var, Points.of(axis), "climatology", freq, weighted, keep_weights, seasons, reference_period, skipna, least)


def grouped(ds, var, points, mode, freq, weighted, keep_weights, seasons, reference, skipna, least) -> GridDataset:
    need_weights(weighted, keep_weights)
    p = prepare(points, mode, freq, seasons, reference)
    group, labels = labels_of(p, mode, freq, seasons)
    weights = group_weights(p.lengths(), group) if weighted else None
    fact = reduce_groups(ds, var, p, group, labels, weights, skipna, least)
    attrs = dict(operation="temporal_avg", mode=mode, freq=freq, weighted=str(weighted), min_weight=str(least))
    if freq == "season":
        attrs |= {"dec_mode": seasons.dec_mode} if not seasons.custom else {"custom_seasons": str(list(seasons.custom))}
        attrs |= {"drop_incomplete_djf": str(seasons.drop_incomplete_djf), "drop_incomplete_seasons": str(seasons.drop_incomplete)}
    return result(ds, var, fact, labels, p.axis.take(p.index), weights if keep_weights else None, attrs)


def need_weights(weighted: bool, keep: bool) -> None:
    if keep and not weighted:
        raise ValueError("There are no weights to keep without weighted=True.")


def result(ds: GridDataset, var: str, fact: DataFrame, labels: Axis | None, old: Axis, weights: np.ndarray | None, attrs: dict) -> GridDataset:
    """The averaged variable on its new time axis; weights, if kept, stand on the old one under time_original."""
    axes = {n: a for n, a in ds.axes.items() if n != old.name}
    dims = tuple(d for d in ds.dims_of(var) if d != old.name)
    if labels is not None:
        axes, dims = {old.name: labels, **axes}, (old.name, *dims)
    kept = {"weights": {f"{old.name}_wts": (old.with_(name=f"{old.name}_original"), weights)}} if weights is not None else {}
    return GridDataset(fact, axes, {var: dims}, {**ds.attrs, "averaging": {var: attrs}, **kept})


def departures(ds: GridDataset, var: str, freq: str, weighted: bool = True, keep_weights: bool = False, reference_period: tuple[str, str] | None = None, season_config: dict | None = None, skipna: bool | None = None, min_weight: float | None = None, december_shift: str = "twice") -> GridDataset:
    """Observations less their climatology, at freq.

    Observations are group averages where the data's frequency is another.
    Shifts and drops apply once to the data and once more in each average, so
    that a December moves two years on under DJF; december_shift="once" leaves
    the first pass out. Groups that the climatology lacks are null. The
    climatology, of one value per group and cell, is broadcast while it is
    short, so that the observations are not shuffled again.
    """
    axis, least = check(ds, var, "departures", freq, reference_period, min_weight)
    seasons = Seasons.of(season_config)
    need_weights(weighted, keep_weights)
    p = Points.of(axis)
    if december_shift == "twice" or freq != "season":
        p = prepare(p, "departures", freq, seasons)
    t = axis.idx
    copy = lambda: Points(p.axis, p.index, {k: v.copy() for k, v in p.parts.items()})
    if infer_freq(axis.take(p.index)) != freq:
        obs = grouped(ds, var, copy(), "group_average", freq, weighted, keep_weights, seasons, None, skipna, least)
        labels = obs.axes[axis.name]
        fact, parts = obs.fact, labels.parts()
        positions = np.arange(len(labels))
    else:
        labels, parts, positions = axis.take(p.index), p.parts, np.arange(len(p.index))
        moved = axis_frame(ds.spark, "_new", {t: p.index.astype(np.int32)})
        fact = joined(ds.fact_of(var), moved, t, len(p.index)).drop(t).withColumnRenamed("_new", t)
    climate = grouped(ds, var, copy(), "climatology", freq, weighted, keep_weights, seasons, reference_period, skipna, least)
    group_of = {(m, d): k for k, (m, d) in enumerate(zip(climate.axes[axis.name].parts()["month"].tolist(), climate.axes[axis.name].parts()["day"].tolist()))}
    if freq == "season" and infer_freq(axis.take(p.index)) == freq:
        months = [seasons.middle(s) for s in seasons.of_months(parts["month"])]
    else:
        months = parts["month"].tolist()
    days = parts["day"].tolist() if freq == "day" else [1] * len(months)
    group = np.array([group_of.get((int(m), int(d)), -1) for m, d in zip(months, days)], np.int32)
    others = [ds.axes[d].idx for d in ds.dims_of(var) if d != axis.name]
    link = axis_frame(ds.spark, "_k", {t: positions.astype(np.int32), "_c": group}).drop("_k")
    base = climate.fact.select(F.col(t).alias("_c"), *others, F.col(var).alias("_base"))
    cells = len(climate.axes[axis.name]) * int(np.prod([len(ds.axes[d]) for d in ds.dims_of(var) if d != axis.name]))
    out = joined(joined(fact, link, t, len(positions)), base, ["_c", *others], cells, "left").select(t, *others, (F.col(var) - F.col("_base")).alias(var))
    attrs = climate.attrs["averaging"][var] | {"operation": "temporal_avg", "mode": "departures", "min_weight": "0.0"}
    dims = (axis.name, *(d for d in ds.dims_of(var) if d != axis.name))
    axes = {**ds.axes, axis.name: labels}
    kept = {"weights": climate.attrs["weights"]} if keep_weights else {}
    return GridDataset(out, axes, {var: dims}, {**ds.attrs, "averaging": {var: attrs}, **kept})
