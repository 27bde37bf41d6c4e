"""Axes and grids to regrid to."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..plans.model import DEFAULT_ATTRS, Axis, GridDataset
from .bounds import midpoint_bounds


@dataclass(frozen=True)
class Grid:
    """Axes of a target; mask: a table of the y and x indices and mask (1 valid), if any."""

    x: Axis | None = None
    y: Axis | None = None
    z: Axis | None = None
    mask: DataFrame | None = None

    def axis(self, key: str) -> Axis:
        found = getattr(self, key.lower())
        if found is None:
            raise KeyError(f"The grid has no {key!r} axis.")
        return found


def create_axis(name: str, data, bounds=None, generate_bounds: bool = True, attrs: dict | None = None) -> Axis:
    """An axis of a usual name; units in attrs override the defaults, bounds are midpoints unless given (n rows of two)."""
    found = Axis(name, np.asarray(data, float)).keys()
    if not found:
        raise ValueError(f"{name!r} is no usual name of an axis.")
    key = found.pop()
    a = Axis(name, np.asarray(data, float), attrs={**DEFAULT_ATTRS[key], **(attrs or {})})
    if bounds is not None:
        lo, hi = np.asarray(bounds, float).T
        return a.with_(lo=lo, hi=hi)
    return midpoint_bounds(key, a) if generate_bounds and len(a) > 1 else a


def create_grid(x=None, y=None, z=None, add_bounds: bool = False) -> Grid:
    """A grid of axes, each an Axis or a pair of an Axis and bounds (n rows of two, or None)."""
    if x is None and y is None and z is None:
        raise ValueError("A grid needs an axis at least.")
    out = {}
    for key, given in (("X", x), ("Y", y), ("Z", z)):
        if given is None:
            continue
        if isinstance(given, tuple):
            if len(given) != 2:
                raise ValueError(f"{key}: give an axis, or an axis and its bounds.")
            given, bounds = given
            if bounds is not None:
                lo, hi = np.asarray(bounds, float).T
                given = given.with_(lo=lo, hi=hi)
        given = given.with_(attrs={**DEFAULT_ATTRS[key], **given.attrs})
        if add_bounds and not given.has_bounds():
            given = midpoint_bounds(key, given)
        out[key.lower()] = given
    return Grid(**out)


def uniform(start: float, stop: float, step: float) -> np.ndarray:
    """start, start + step, ... up to stop, which counts if a step meets it."""
    return start + step * np.arange(int(np.floor((stop - start) / step + 1e-9)) + 1)


def create_uniform_grid(lat_start: float, lat_stop: float, lat_delta: float, lon_start: float, lon_stop: float, lon_delta: float) -> Grid:
    return create_grid(x=create_axis("lon", uniform(lon_start, lon_stop, lon_delta)), y=create_axis("lat", uniform(lat_start, lat_stop, lat_delta)))


def gaussian_latitudes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre latitudes from north to south, and the n + 1 edges whose sines part the weights."""
    nodes, weights = np.polynomial.legendre.leggauss(n)
    edges = np.degrees(np.arcsin(np.clip(1 - np.r_[0, np.cumsum(weights[::-1])], -1, 1)))
    edges[0], edges[-1] = 90, -90
    half = edges[: n // 2 + 1]
    edges[n + 1 - len(half) :] = -half[::-1]  # the same edges on either side
    return np.degrees(np.arcsin(nodes[::-1])), edges


def create_gaussian_grid(nlats: int) -> Grid:
    """nlats Gaussian latitudes, and 2 nlats + 1 longitudes of which the first and last are 0 and 360."""
    if nlats < 1:
        raise ValueError("A Gaussian grid has a latitude at least.")
    lat, edges = gaussian_latitudes(nlats)
    y = create_axis("lat", lat, bounds=np.c_[edges[:-1], edges[1:]])
    return create_grid(x=create_axis("lon", np.arange(2 * nlats + 1) * (180 / nlats)), y=y)


def one_cell(a: Axis, key: str) -> Axis:
    """An axis of one cell over all of another."""
    if not a.has_bounds():
        a = midpoint_bounds(key, a)
    lo, hi = min(a.lo[0], a.lo[-1], a.hi[0], a.hi[-1]), max(a.lo[0], a.lo[-1], a.hi[0], a.hi[-1])
    return a.with_(values=np.array([(a.values[0] + a.values[-1]) / 2]), lo=np.array([lo]), hi=np.array([hi]))


def global_mean_grid(grid: Grid) -> Grid:
    return Grid(x=one_cell(grid.axis("X"), "X"), y=one_cell(grid.axis("Y"), "Y"))


def zonal_grid(grid: Grid) -> Grid:
    return Grid(x=one_cell(grid.axis("X"), "X"), y=grid.axis("Y"))


def grid_of(ds: GridDataset, var: str | None = None) -> Grid:
    """The dataset's X, Y and Z axes with bounds, midpoints where they are missing; one axis of each kind."""
    out = {}
    for key in "XYZ":
        try:
            a = ds.axis_of(key, var)
        except KeyError:
            continue
        out[key.lower()] = a if a.has_bounds() or len(a) < 2 else midpoint_bounds(key, a)
    if not out:
        raise KeyError("The dataset has no X, Y or Z axis.")
    return Grid(**out)
