"""Differences between datasets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..plans.model import Axis, GridDataset


def str_to_bool(text: str) -> bool:
    """True and False from their names as attributes hold them."""
    if text not in ("True", "False"):
        raise ValueError(f"{text!r} is neither True nor False.")
    return text == "True"


def same_axis(a: Axis, b: Axis, attrs: bool) -> bool:
    pairs = ((a.values, b.values), (a.lo, b.lo), (a.hi, b.hi))
    equal = all((x is None) == (y is None) and (x is None or np.array_equal(x, y)) for x, y in pairs) and a.calendar == b.calendar
    return equal and (not attrs or a.attrs == b.attrs)


def same_values(one: GridDataset, two: GridDataset, var: str) -> bool:
    """Whether a variable has the same value, or none, in every cell: one full join, nothing collected but a count."""
    if one.dims_of(var) != two.dims_of(var):
        return False
    keys = [one.axes[d].idx for d in one.dims_of(var)]
    a, b = one.fact_of(var).withColumnRenamed(var, "_a"), two.fact_of(var).withColumnRenamed(var, "_b")
    return a.join(b, keys, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).count() == 0


def compare_datasets(one: GridDataset, two: GridDataset) -> dict[str, list[str]]:
    """Names of axes and variables that only one dataset has, that differ in values or axes, and that differ in these or attributes."""
    out = {
        "unique_coords": sorted(set(one.axes) ^ set(two.axes)),
        "unique_data_vars": sorted(set(one.variables) ^ set(two.variables)),
        "nonidentical_coords": sorted(n for n in set(one.axes) & set(two.axes) if not same_axis(one.axes[n], two.axes[n], True)),
        "nonequal_coords": sorted(n for n in set(one.axes) & set(two.axes) if not same_axis(one.axes[n], two.axes[n], False)),
    }
    both = sorted(set(one.variables) & set(two.variables))
    differ = [v for v in both if one.dims_of(v) != two.dims_of(v) or set(one.dims_of(v)) & set(out["nonequal_coords"]) or not same_values(one, two, v)]
    attrs = lambda ds, v: ds.attrs.get("variables", {}).get(v, {})
    more = [v for v in both if v not in differ and (set(one.dims_of(v)) & set(out["nonidentical_coords"]) or attrs(one, v) != attrs(two, v))]
    return out | {"nonidentical_data_vars": sorted(differ + more), "nonequal_data_vars": differ}
