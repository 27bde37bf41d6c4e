"""Small datasets by name, made from formulas, for trying things out without a network."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..operators.bounds import add_missing_bounds
from ..plans.model import Axis, GridDataset

#: Name: frequency of the time points, their number, calendar, and levels.
SAMPLES = {
    "monthly": ("month", 36, "noleap", 0),
    "daily": ("day", 365, "standard", 0),
    "three_hourly": ("hour", 240, "360_day", 0),
    "levels": ("month", 12, "noleap", 10),
}


def open_sample(spark: SparkSession, name: str, add_bounds: tuple[str, ...] | None = ("X", "Y", "T")) -> GridDataset:
    """The sample of a name: ts over time, (lev,) lat (36) and lon (72)."""
    if name not in SAMPLES:
        raise ValueError(f"Samples are {sorted(SAMPLES)}, not {name!r}.")
    freq, n, calendar, levels = SAMPLES[name]
    k = np.arange(n)
    if freq == "month":
        time = C.ordinal(calendar, 2000 + k // 12, k % 12 + 1, 15)
    else:
        time = C.ordinal(calendar, 2000) + k * (C.DAY_US if freq == "day" else 3 * C.UNIT_US["hour"]) + (C.DAY_US // 2 if freq == "day" else 0)
    axes = [Axis("time", time, attrs={"axis": "T"}, calendar=calendar)]
    if levels:
        axes.append(Axis("lev", 1000.0 - 100 * np.arange(levels), attrs={"axis": "Z", "units": "hPa"}))
    axes += [Axis("lat", -87.5 + 5 * np.arange(36), attrs={"axis": "Y", "units": "degrees_north"}), Axis("lon", 2.5 + 5 * np.arange(72), attrs={"axis": "X", "units": "degrees_east"})]
    rows, left = spark.range(int(np.prod([len(a) for a in axes]))), F.col("id")
    for a in reversed(axes):
        rows, left = rows.withColumn(a.idx, (left % len(a)).cast("int")), F.floor(left / len(a))
    season = F.cos(F.col("time_idx") * (2 * np.pi / {"month": 12, "day": 365, "hour": 8}[freq]))
    value = 300 - 40 * F.pow(F.sin(F.radians(F.col("lat_idx") * 5 - 87.5)), 2) + 10 * season * F.sin(F.radians(F.col("lat_idx") * 5 - 87.5)) + F.sin(F.radians(F.col("lon_idx") * 5))
    if levels:
        value = value - 6.5 * F.col("lev_idx")
    ds = GridDataset(rows.select(*(a.idx for a in axes), value.alias("ts")), {a.name: a for a in axes}, {"ts": tuple(a.name for a in axes)}, {"title": name})
    return add_missing_bounds(ds, add_bounds) if add_bounds else ds
