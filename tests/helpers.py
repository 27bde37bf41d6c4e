import numpy as np

from isobar.functions import calendars as C
from isobar.plans.model import Axis, GridDataset


def time_axis(points, bounds=None, calendar="standard"):
    """Points and bounds as tuples of date components."""
    of = lambda ps: np.array([int(C.ordinal(calendar, *p)) for p in ps])
    lo = hi = None
    if bounds:
        lo, hi = of([b[0] for b in bounds]), of([b[1] for b in bounds])
    return Axis("time", of(points), lo, hi, {"axis": "T"}, calendar)


def month(y, m):
    return ((y, m, 1), (y + m // 12, m % 12 + 1, 1))


LAT = Axis("lat", [-90, -88.75, 88.75, 90], [-90, -89.375, 0, 89.375], [-89.375, 0, 89.375, 90], {"axis": "Y", "units": "degrees_north"})
LON = Axis("lon", [0, 1.875, 356.25, 358.125], [-0.9375, 0.9375, 179.0625, 357.1875], [0.9375, 179.0625, 357.1875, 359.0625], {"axis": "X"})
MONTHS = [(2000, m) for m in range(1, 13)] + [(2001, 1), (2001, 2), (2001, 12)]
TIME = time_axis([(y, m, 16, 12 if m in (1, 3, 5, 7, 8, 10, 12) else 0) if m != 2 else (y, 2, 15, 12 if y == 2000 else 0) for y, m in MONTHS], [month(*x) for x in MONTHS])


def dataset(spark, axes, data, name="ts"):
    """A dataset of an array over axes; NaN is missing."""
    data = np.asarray(data, float)
    rows = [(*r[0], r[1]) if isinstance(r[0], tuple) else r for r in [(ix, None if np.isnan(v) else float(v)) for ix, v in np.ndenumerate(data)]]
    ddl = ", ".join([*(f"{a.idx} int" for a in axes), f"{name} double"])
    return GridDataset(spark.createDataFrame(rows, ddl), {a.name: a for a in axes}, {name: tuple(a.name for a in axes)})


def array(ds, name="ts"):
    """The variable as an array, NaN where there is none."""
    dims = ds.variables[name]
    out = np.full([len(ds.axes[d]) for d in dims], np.nan)
    for r in ds.fact_of(name).collect():
        if r[name] is not None:
            out[tuple(r[ds.axes[d].idx] for d in dims)] = r[name]
    return out


def labels(ds):
    p = ds.axes["time"].parts()
    return list(zip(p["year"].tolist(), p["month"].tolist()))
