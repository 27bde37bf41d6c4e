"""Horizontal and vertical regridding by sparse weights.

Weights are worked out on the axes (driver, numpy) as tables of target index,
source index and weight. Rectilinear methods keep one table per axis, so that
the fact is reduced along one axis after the other, each time by a broadcast
join and one aggregation; other methods have a table of cell pairs.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.model import BROADCAST_ROWS, Axis, GridDataset, axis_frame, joined
from .grids import Grid
from .spatial import bounds_of

#: Targets of a source cell up to which both axes are reduced in one pass.
ONE_PASS = 8
METHODS = ("bilinear", "conservative", "conservative_normed", "patch", "nearest_s2d", "nearest_d2s")

Links = tuple[np.ndarray, np.ndarray, np.ndarray]  # target, source, weight


def ordered(a: Axis) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = bounds_of(a)
    return np.minimum(lo, hi), np.maximum(lo, hi)


def overlaps(dst: Axis, src: Axis, measure=lambda x: x, period: float | None = None) -> Links:
    """Every target and source cell that overlap, and measure of the overlap; with a period the source repeats."""
    (dlo, dhi), (slo, shi) = ordered(dst), ordered(src)
    found = []
    shifts = [0.0]
    if period:
        first, last = int(np.floor((dlo.min() - shi.max()) / period)), int(np.ceil((dhi.max() - slo.min()) / period))
        shifts = [k * period for k in range(first, last + 1)]
    order = np.argsort(slo)
    for shift in shifts:
        lo, hi = slo[order] + shift, shi[order] + shift
        reach = np.maximum.accumulate(hi)
        start, end = np.searchsorted(reach, dlo, "right"), np.searchsorted(lo, dhi, "left")
        n = np.maximum(end - start, 0)
        i = np.repeat(np.arange(len(dlo)), n)
        j = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        a, b = np.maximum(dlo[i], lo[j]), np.minimum(dhi[i], hi[j])
        w = measure(b) - measure(a)
        keep = b > a
        found.append((i[keep], order[j[keep]], w[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def sine(x: np.ndarray) -> np.ndarray:
    return np.sin(np.radians(x))


def latitude_links(dst: Axis, src: Axis) -> Links:
    return overlaps(dst, src, sine)


def longitude_links(dst: Axis, src: Axis) -> Links:
    return overlaps(dst, src, period=360.0)


def linear_links(dst: np.ndarray, src: np.ndarray, period: float | None = None) -> Links:
    """Weights of the two source points around each target; none outside. With a period the ends meet."""
    order = np.argsort(src)
    x = src[order]
    if period:
        x, order = np.r_[x[-1] - period, x, x[0] + period], np.r_[order[-1], order, order[0]]
        dst = (dst - x[1]) % period + x[1]
    if len(x) < 2:
        at = np.flatnonzero(np.isclose(dst, x[0])) if len(x) else np.empty(0, int)
        return at, np.zeros(len(at), int), np.ones(len(at))
    k = np.clip(np.searchsorted(x, dst, "right") - 1, 0, len(x) - 2)
    inside = (dst >= x[0]) & (dst <= x[-1])
    t = (dst - x[k]) / (x[k + 1] - x[k])
    i = np.flatnonzero(inside)
    links = np.r_[i, i], np.r_[order[k[i]], order[k[i] + 1]], np.r_[1 - t[i], t[i]]
    keep = links[2] != 0
    return tuple(v[keep] for v in links)


def patch_links(dst: np.ndarray, src: np.ndarray, period: float | None = None) -> Links:
    """Patch recovery along an axis: quadratics through three points around either neighbour, blended linearly."""
    order = np.argsort(src)
    x = src[order]
    if period:
        x, order = np.r_[x[-2:] - period, x, x[:2] + period], np.r_[order[-2:], order, order[:2]]
        dst = (dst - x[2]) % period + x[2]
    n = len(x)
    if n < 3:
        return linear_links(dst, src, period)
    out = ([], [], [])
    for i, v in enumerate(dst):
        if not x[0] <= v <= x[-1]:
            continue
        k = int(np.clip(np.searchsorted(x, v, "right") - 1, 0, n - 2))
        t = (v - x[k]) / (x[k + 1] - x[k])
        weights = {}
        for node, share in ((k, 1 - t), (k + 1, t)):
            three = np.clip(node, 1, n - 2) + np.array([-1, 0, 1])
            for a in three:
                others = x[three[three != a]]
                weights[a] = weights.get(a, 0.0) + share * float(np.prod((v - others) / (x[a] - others)))
        for a, w in weights.items():
            if w:
                out[0].append(i), out[1].append(order[a]), out[2].append(w)
    return np.array(out[0], int), np.array(out[1], int), np.array(out[2], float)


def links_frame(ds: GridDataset, dst_idx: str, src_idx: str, links: Links) -> DataFrame:
    return axis_frame(ds.spark, "_k", {dst_idx: links[0].astype(np.int32), src_idx: links[1].astype(np.int32), "_w": links[2].astype(float)}).drop("_k")


def along(rows: DataFrame, ds: GridDataset, src: Axis, links: Links) -> DataFrame:
    """One pass along an axis: sums of w x, w m and counts per target index; rows have _num, _den and _cnt."""
    t = links_frame(ds, "_to", src.idx, links)
    others = [c for c in rows.columns if c not in (src.idx, "_num", "_den", "_cnt")]
    w = F.col("_w")
    out = joined(rows, t, src.idx, len(links[0])).groupBy(*others, "_to").agg(F.sum(w * F.col("_num")).alias("_num"), F.sum(w * F.col("_den")).alias("_den"), F.sum("_cnt").alias("_cnt"))
    return out.withColumnRenamed("_to", src.idx)


def at_once(rows: DataFrame, ds: GridDataset, steps: list[tuple[Axis, Axis, Links]]) -> DataFrame:
    """What along() gives after all steps, by one aggregation: a row goes to the product of its targets, of which there are few."""
    w, moved = F.lit(1.0), []
    for k, (src, _, links) in enumerate(steps):
        table = links_frame(ds, f"_to{k}", src.idx, links).withColumnRenamed("_w", f"_w{k}")
        rows = joined(rows, table, src.idx, len(links[0])).drop(src.idx)
        w, moved = w * F.col(f"_w{k}"), [*moved, F.col(f"_to{k}").alias(src.idx)]
    others = [c for c in rows.columns if not c.startswith(("_to", "_w", "_num", "_den", "_cnt"))]
    return rows.groupBy(*others, *moved).agg(F.sum(w * F.col("_num")).alias("_num"), F.sum(w * F.col("_den")).alias("_den"), F.sum("_cnt").alias("_cnt"))


def separable(ds: GridDataset, var: str, steps: list[tuple[Axis, Axis, Links]], mask: DataFrame | None = None, normalise: bool = True, skipna: bool = False) -> DataFrame:
    """Reduces the variable along each axis of steps (source, target, links).

    A target is null if any source that it takes is missing, by a null or an
    absent row, unless skipna. mask (indices, mask) weighs sources in both sums.
    """
    x = F.col(var)
    rows = ds.fact_of(var)
    m = F.lit(1.0)
    if mask is not None:
        on = [a.idx for a, _, _ in steps if a.idx in mask.columns]
        cells = int(np.prod([len(a) for a, _, _ in steps if a.idx in on]))
        rows, m = joined(rows, mask.select(*on, F.col("mask").cast("double").alias("_m")), on, cells, "left"), F.coalesce("_m", F.lit(0.0))
    names = [ds.axes[d].idx for d in ds.dims_of(var)]
    value = F.when(x.isNotNull(), m * x).otherwise(0.0)
    rows = rows.select(*names, value.alias("_num"), (F.when(x.isNotNull(), m) if skipna else m).alias("_den"), x.isNotNull().cast("long").alias("_cnt"))
    counts = [(src.idx, np.bincount(links[0], minlength=len(dst))) for src, dst, links in steps]
    if np.prod([len(links[0]) / len(src) for src, _, links in steps]) <= ONE_PASS:
        rows = at_once(rows, ds, steps)
    else:
        for src, _, links in steps:
            rows = along(rows, ds, src, links)
    need = F.lit(1)
    for idx, n in counts:
        rows = rows.join(F.broadcast(axis_frame(ds.spark, idx, {f"_n{idx}": n.astype(np.int64)})), idx)
        need = need * F.col(f"_n{idx}")
    result = F.try_divide(F.col("_num"), F.col("_den")) if normalise else F.col("_num")
    if not skipna:
        result = F.when(F.col("_cnt") == need, result)
    return rows.select(*names, result.alias(var))


def placed(ds: GridDataset, var: str, fact: DataFrame, targets: dict[str, Axis], unmapped: bool, tool: str, method: str | None = None) -> GridDataset:
    """The regridded variable; unmapped: cells without a source as 0 rather than left out as missing."""
    dims = ds.dims_of(var)
    axes = {d: targets[d].with_(name=d) if d in targets else ds.axes[d] for d in dims}
    if unmapped:
        rest = [ds.axes[d].idx for d in dims if d not in targets]
        cells = fact.select(*rest).distinct() if rest else ds.spark.range(1).select()
        for d in dims:
            if d in targets:
                cells = cells.crossJoin(ds.spark.range(len(targets[d])).select(F.col("id").cast("int").alias(axes[d].idx)))
        keys = [axes[d].idx for d in dims]
        fact = cells.join(fact.withColumn("_there", F.lit(True)), keys, "left").select(*keys, F.when(F.col("_there"), F.col(var)).otherwise(0.0).alias(var))
    attrs = {**ds.attrs, "regridding": {var: {"regrid_tool": tool, **({"regrid_method": method} if method else {})}}}
    return GridDataset(fact, axes, {var: dims}, attrs)


def nan_mask(ds: GridDataset, var: str) -> DataFrame:
    """1 where the first step of the other axes has a value, else 0, for each cell of X and Y."""
    y, x = ds.axis_of("Y", var), ds.axis_of("X", var)
    rows = ds.fact_of(var)
    for d in ds.dims_of(var):
        if d not in (y.name, x.name):
            rows = rows.filter(F.col(ds.axes[d].idx) == 0)
    cells = ds.spark.range(len(y)).select(F.col("id").cast("int").alias(y.idx)).crossJoin(ds.spark.range(len(x)).select(F.col("id").cast("int").alias(x.idx)))
    return cells.join(rows, [y.idx, x.idx], "left").select(y.idx, x.idx, F.col(var).isNotNull().cast("int").alias("mask"))


def ones_mask(ds: GridDataset, dims: tuple[str, ...] | None = None) -> DataFrame:
    """1 for each cell of the axes of dims, X and Y unless given."""
    axes = [ds.axes[d] for d in dims] if dims else [ds.axis_of("Y"), ds.axis_of("X")]
    out = None
    for a in axes:
        own = ds.spark.range(len(a)).select(F.col("id").cast("int").alias(a.idx))
        out = own if out is None else out.crossJoin(own)
    return out.withColumn("mask", F.lit(1.0))


def regrid2(ds: GridDataset, var: str, grid: Grid, unmapped_to_nan: bool = True, create_nan_mask: bool = False, mask: DataFrame | None = None, dtype: str = "float", output_weights: bool = False) -> GridDataset:
    """Conservative regridding of rectilinear cells: sums of x w m over sums of w m, w the overlap in sine of latitude and in longitude.

    Any missing source of a target makes it missing. The mask is that of the
    data's first step (create_nan_mask), the one given, or ones.
    """
    y, x = ds.axis_of("Y", var), ds.axis_of("X", var)
    ty, tx = grid.axis("Y"), grid.axis("X")
    m = nan_mask(ds, var) if create_nan_mask else mask
    steps = [(x, tx, longitude_links(tx, x)), (y, ty, latitude_links(ty, y))]
    fact = separable(ds, var, steps, m).withColumn(var, F.col(var).cast(dtype))
    out = placed(ds, var, fact, {y.name: ty, x.name: tx}, not unmapped_to_nan, "regrid2")
    return out.with_(attrs={**out.attrs, "regrid_weights": regrid2_weights(ds, var, grid)}) if output_weights else out


def regrid2_weights(ds: GridDataset, var: str, grid: Grid) -> DataFrame:
    """The sparse weights (y_out, x_out, y_in, x_in, weight) of regrid2."""
    y, x = ds.axis_of("Y", var), ds.axis_of("X", var)
    a = links_frame(ds, "y_out", "y_in", latitude_links(grid.axis("Y"), y)).withColumnRenamed("_w", "_wy")
    b = links_frame(ds, "x_out", "x_in", longitude_links(grid.axis("X"), x)).withColumnRenamed("_w", "_wx")
    return a.crossJoin(F.broadcast(b)).select("y_out", "x_out", "y_in", "x_in", (F.col("_wy") * F.col("_wx")).alias("weight"))


def angles(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle angles in radians."""
    a, b, d = np.radians(lat1), np.radians(lat2), np.radians(lon1 - lon2)
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(d / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def nearest_cells(dst_y, dst_x, src_y, src_x) -> tuple[np.ndarray, np.ndarray]:
    """For each target (y, x) the flat index of the nearest source point of a rectilinear grid, and its angle.

    In any row of sources the nearest is the one of least turn, so each target
    looks at one point per row.
    """
    turn = np.abs((dst_x[:, None] - src_x[None, :] + 180) % 360 - 180)
    column = turn.argmin(axis=1)
    best = np.empty((len(dst_y), len(dst_x)), np.int64)
    far = np.empty((len(dst_y), len(dst_x)))
    for i, lat in enumerate(dst_y):
        d = angles(lat, dst_x[:, None], src_y[None, :], src_x[column][:, None])
        row = np.round(d, 12).argmin(axis=1)
        best[i], far[i] = row * len(src_x) + column, d[np.arange(len(row)), row]
    return best, far


def apply_cells(ds: GridDataset, var: str, links: Links, ny: int, nx: int, normalise: bool = False) -> DataFrame:
    """Sums of w x per target cell by a table of flat cell pairs; missing if a source is."""
    y, x = ds.axis_of("Y", var), ds.axis_of("X", var)
    to, source, w = links
    table = axis_frame(ds.spark, "_k", {"_ty": (to // nx).astype(np.int32), "_tx": (to % nx).astype(np.int32), y.idx: (source // len(x)).astype(np.int32), x.idx: (source % len(x)).astype(np.int32), "_w": w.astype(float), "_n": np.bincount(to, minlength=ny * nx)[to].astype(np.int64)}).drop("_k")
    names = [ds.axes[d].idx for d in ds.dims_of(var)]
    others = [n for n in names if n not in (y.idx, x.idx)]
    v = F.col(var)
    out = joined(ds.fact_of(var), table, [y.idx, x.idx], len(to)).groupBy(*others, "_ty", "_tx").agg(F.sum(F.col("_w") * v).alias("_s"), F.sum("_w").alias("_ws"), F.count(v).alias("_c"), F.max("_n").alias("_n"))
    value = F.try_divide(F.col("_s"), F.col("_ws")) if normalise else F.col("_s")
    return out.select(*others, F.col("_ty").alias(y.idx), F.col("_tx").alias(x.idx), F.when(F.col("_c") == F.col("_n"), value).alias(var)).select(*names, var)


class Regridder(ABC):
    """What a tool of one's own derives from; horizontal() and vertical() take the class in place of a tool's name."""

    def __init__(self, grid: Grid, **options):
        self.grid, self.options = grid, options

    @abstractmethod
    def horizontal(self, ds: GridDataset, var: str) -> GridDataset: ...

    @abstractmethod
    def vertical(self, ds: GridDataset, var: str) -> GridDataset: ...


def horizontal(ds: GridDataset, var: str, grid: Grid, tool: str | type[Regridder] = "xesmf", method: str | None = None, **options) -> GridDataset:
    """Regrids var to grid's X and Y. tool regrid2: conservative; xesmf: one of METHODS; or a Regridder."""
    if isinstance(tool, type):
        return tool(grid, **options, **({"method": method} if method else {})).horizontal(ds, var)
    if tool == "regrid2":
        return regrid2(ds, var, grid, **options)
    if tool != "xesmf":
        raise ValueError(f"Tools are xesmf and regrid2, not {tool!r}.")
    return by_method(ds, var, grid, method, **options)


def by_method(ds: GridDataset, var: str, grid: Grid, method: str | None, periodic: bool = False, extrap_method: str | None = None, extrap_dist_exponent: float = 2.0, extrap_num_src_pnts: int = 8, unmapped_to_nan: bool = True, mask: DataFrame | None = None, create_nan_mask: bool = False, output_weights: bool = False, ignore_degenerate: bool = True) -> GridDataset:
    """Rectilinear regridding by method; cells are boxes of longitude and latitude.

    output_weights puts the sparse weights into attrs["regrid_weights"]. Cells
    of no width take no part, or raise under ignore_degenerate=False.

    extrap_method fills targets that the method leaves out: nearest_s2d, or
    inverse_dist over extrap_num_src_pnts sources to a power of the distance.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}.")
    if extrap_method not in (None, "inverse_dist", "nearest_s2d"):
        raise ValueError("extrap_method is inverse_dist or nearest_s2d.")
    y, x = ds.axis_of("Y", var), ds.axis_of("X", var)
    ty, tx = grid.axis("Y"), grid.axis("X")
    m = nan_mask(ds, var) if create_nan_mask else mask
    ny, nx = len(ty), len(tx)
    sy, sx = y.values, x.values
    if not ignore_degenerate and any(a.has_bounds() and (a.lo == a.hi).any() for a in (y, x, ty, tx)):
        raise ValueError("There are cells of no width.")
    if method not in ("nearest_s2d", "nearest_d2s"):
        ly, lx = method_links(y, x, ty, tx, method, periodic)
        fact = separable(ds, var, [(x, tx, lx), (y, ty, ly)], m, normalise=method == "conservative_normed")
        covered = np.isin(np.arange(ny), ly[0])[:, None] & np.isin(np.arange(nx), lx[0])[None, :]
    elif method == "nearest_s2d":
        best, _ = nearest_cells(ty.values, tx.values, sy, sx)
        fact = apply_cells(ds, var, (np.arange(ny * nx), best.ravel(), np.ones(ny * nx)), ny, nx)
        covered = np.ones((ny, nx), bool)
    else:  # every source goes to its nearest target, which takes their sum
        best, _ = nearest_cells(sy, sx, ty.values, tx.values)
        source = np.arange(len(sy) * len(sx))
        fact = apply_cells(ds, var, (best.ravel(), source, np.ones(len(source))), ny, nx)
        covered = np.zeros(ny * nx, bool)
        covered[best.ravel()] = True
        covered = covered.reshape(ny, nx)
    if extrap_method and not covered.all():
        fact = fact.unionByName(apply_cells(ds, var, extrapolation(ty.values, tx.values, sy, sx, ~covered, extrap_method, extrap_dist_exponent, extrap_num_src_pnts), ny, nx, normalise=True))
    out = placed(ds, var, fact, {y.name: ty, x.name: tx}, not unmapped_to_nan, "xesmf", method)
    return out.with_(attrs={**out.attrs, "regrid_weights": method_weights(ds, var, grid, method, periodic)}) if output_weights else out


def method_links(y: Axis, x: Axis, ty: Axis, tx: Axis, method: str, periodic: bool = False) -> tuple[Links, Links]:
    """Links along Y and X of a method that goes by axis."""
    if method in ("conservative", "conservative_normed"):
        ly, lx = latitude_links(ty, y), longitude_links(tx, x)
        if method == "conservative":  # shares of the whole target cell
            (ylo, yhi), (xlo, xhi) = ordered(ty), ordered(tx)
            ly, lx = (ly[0], ly[1], ly[2] / (sine(yhi) - sine(ylo))[ly[0]]), (lx[0], lx[1], lx[2] / (xhi - xlo)[lx[0]])
        return ly, lx
    of = linear_links if method == "bilinear" else patch_links
    return of(ty.values, y.values), of(tx.values, x.values, 360.0 if periodic else None)


def method_weights(ds: GridDataset, var: str, grid: Grid, method: str, periodic: bool = False) -> DataFrame:
    """The sparse weights (y_out, x_out, y_in, x_in, weight) of a method, of all its targets."""
    y, x = ds.axis_of("Y", var), ds.axis_of("X", var)
    ty, tx = grid.axis("Y"), grid.axis("X")
    if method in ("nearest_s2d", "nearest_d2s"):
        back = method == "nearest_d2s"
        best = (nearest_cells(y.values, x.values, ty.values, tx.values) if back else nearest_cells(ty.values, tx.values, y.values, x.values))[0].ravel()
        every = np.arange(len(best))
        to, source = (best, every) if back else (every, best)
        columns = {"y_out": to // len(tx), "x_out": to % len(tx), "y_in": source // len(x), "x_in": source % len(x)}
        return axis_frame(ds.spark, "_k", {k: v.astype(np.int32) for k, v in columns.items()} | {"weight": np.ones(len(to))}).drop("_k")
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}.")
    ly, lx = method_links(y, x, ty, tx, method, periodic)
    a = links_frame(ds, "y_out", "y_in", ly).withColumnRenamed("_w", "_wy")
    b = links_frame(ds, "x_out", "x_in", lx).withColumnRenamed("_w", "_wx")
    return a.crossJoin(F.broadcast(b)).select("y_out", "x_out", "y_in", "x_in", (F.col("_wy") * F.col("_wx")).alias("weight"))


def extrapolation(ty, tx, sy, sx, missing: np.ndarray, method: str, power: float, points: int) -> Links:
    """Links of uncovered targets to their nearest source, or to several by inverse distance."""
    if method == "nearest_s2d":
        best, _ = nearest_cells(ty, tx, sy, sx)
        to = np.flatnonzero(missing.ravel())
        return to, best.ravel()[to], np.ones(len(to))
    gy, gx = np.repeat(sy, len(sx)), np.tile(sx, len(sy))
    out = ([], [], [])
    for i, j in zip(*np.nonzero(missing)):
        d = angles(ty[i], tx[j], gy, gx)
        near = np.argsort(np.round(d, 12), kind="stable")[: min(points, len(d))]
        w = 1 / np.maximum(d[near], 1e-12) ** power
        out[0].append(np.full(len(near), i * len(tx) + j)), out[1].append(near), out[2].append(w / w.sum())
    return tuple(np.concatenate(v) for v in out)


def curvilinear_nearest(cells: DataFrame, spark, grid: Grid, var: str, rest: tuple[str, ...] = ()) -> DataFrame:
    """A variable of a curvilinear table (lat, lon, var and rest) at the nearest point for each target of grid.

    Each task finds its own points' nearest to every target, by the greatest
    product of unit vectors; the least angle of all tasks wins, of equal ones
    the least (lat, lon). Points without a position are no one's nearest.
    """
    ty, tx = grid.axis("Y").values, grid.axis("X").values
    points = cells.select("lat", "lon").filter(~(F.isnan("lat") | F.isnan("lon"))).filter("lat is not null and lon is not null").distinct()

    def vectors(lat, lon):
        a, b = np.radians(lat), np.radians(lon)
        return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])

    goal_y, goal_x = np.repeat(ty, len(tx)), np.tile(tx, len(ty))
    goals = vectors(goal_y, goal_x).T
    ddl = "target int, far double, lat double, lon double"
    schema = pa.schema([("target", pa.int32()), ("far", pa.float64()), ("lat", pa.float64()), ("lon", pa.float64())])

    def nearest(batches):
        best, place = np.full(len(goals), -2.0), np.zeros((len(goals), 2))
        for batch in batches:
            lat, lon = (batch.column(k).to_numpy() for k in (0, 1))
            order = np.lexsort((lon, lat))
            lat, lon = lat[order], lon[order]
            own = vectors(lat, lon)
            for at in range(0, len(goals), 512):
                near = np.round(goals[at : at + 512] @ own, 14)
                k = near.argmax(axis=1)
                found = near[np.arange(len(k)), k]
                old, better = best[at : at + 512], np.zeros(len(k), bool)
                tie = (found == old) & ((lat[k] < place[at : at + 512, 0]) | ((lat[k] == place[at : at + 512, 0]) & (lon[k] < place[at : at + 512, 1])))
                better[:] = (found > old) | tie
                old[better] = found[better]
                place[at : at + 512][better] = np.c_[lat[k], lon[k]][better]
        some = np.flatnonzero(best > -2)
        far = np.round(angles(goal_y[some], goal_x[some], place[some, 0], place[some, 1]), 12)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(far), pa.array(place[some, 0]), pa.array(place[some, 1])], schema=schema)

    found = points.mapInArrow(nearest, ddl).groupBy("target").agg(F.min(F.struct("far", "lat", "lon")).alias("p"))
    table = found.select((F.floor(F.col("target") / len(tx))).cast("int").alias("y_idx"), (F.col("target") % len(tx)).alias("x_idx"), "p.lat", "p.lon")
    return joined(cells, table, ["lat", "lon"], len(goals)).select(*rest, "y_idx", "x_idx", var)


# --- vertical -------------------------------------------------------------


def padding_of(periodic: bool = False, extra_init_options: dict | None = None) -> dict:
    """Options of a column's ends as they hold: padding, of old its name boundary, else periodic or fill. They don't bear on the values, which stop at a column's ends."""
    given = dict(extra_init_options or {})
    old = given.pop("boundary", None)
    return {"padding": old or ("periodic" if periodic else "fill"), **given}


def vertical(ds: GridDataset, var: str, grid: Grid, method: str = "linear", target_data: str | DataFrame | None = None, tool: str | type[Regridder] = "xgcm", grid_positions: dict[str, str] | None = None, periodic: bool = False, extra_init_options: dict | None = None, mask_edges: bool = True) -> GridDataset:
    """Regrids var to grid's Z: linear, log, or conservative (sums over levels are kept).

    target_data names a variable whose values, rather than the Z coordinates,
    are the levels; infer takes them from the Z axis's formula_terms, and a
    table has them in the column level beside its axes' indices. They go by
    segments of each column. Targets outside the source's range are missing,
    or under mask_edges=False have the value of the nearer end. Where points
    stand in their cells is told by grid_positions ({position: axis}) or, where
    there are bounds, by these; conservative goes by the bounds.
    """
    if isinstance(tool, type):
        return tool(grid, method=method, target_data=target_data).vertical(ds, var)
    if tool != "xgcm":
        raise ValueError(f"The tool is xgcm, not {tool!r}.")
    if method not in ("linear", "log", "conservative"):
        raise ValueError("method is linear, log or conservative.")
    try:
        z, tz = ds.axis_of("Z", var), grid.axis("Z")
    except (KeyError, ValueError) as e:
        raise RuntimeError(str(e)) from e
    if grid_positions is None and method != "conservative" and z.has_bounds():
        grid_position(z, exact=False)
    if grid_positions is not None and not set(grid_positions) <= {"center", "left", "right", "inner", "outer"}:
        raise ValueError("grid_positions has positions as keys: center, left, right, inner or outer.")
    if target_data is not None:
        return note(by_segments(ds, var, z, tz, method, target_data, mask_edges), var, padding_of(periodic, extra_init_options))
    if method == "conservative":
        to, source, w = overlaps(tz, z)
        lo, hi = ordered(z)
        links = to, source, w / (hi - lo)[source]
    else:
        goals = tz.values if mask_edges else np.clip(tz.values, z.values.min(), z.values.max())
        scale = np.log if method == "log" else np.asarray
        links = linear_links(scale(goals), scale(z.values))
    fact = separable(ds, var, [(z, tz, links)], normalise=False)
    return note(placed(ds, var, fact, {z.name: tz}, False, "xgcm", method), var, padding_of(periodic, extra_init_options))


def note(ds: GridDataset, var: str, options: dict) -> GridDataset:
    """The dataset with options among the attributes of var's regridding."""
    return ds.with_(attrs={**ds.attrs, "regridding": {var: {**ds.attrs["regridding"][var], **options}}})


def grid_position(a: Axis, exact: bool = True) -> str:
    """Where a Z axis's points stand in their cells: center, left or right, by the first point; center is the middle, or if not exact any place within."""
    lo, hi = bounds_of(a)
    x = a.values[0]
    if np.isclose(x, (lo[0] + hi[0]) / 2) if exact else min(lo[0], hi[0]) < x < max(lo[0], hi[0]):
        return "center"
    if x in (lo[0], hi[0]):
        return "left" if x == lo[0] else "right"
    raise RuntimeError(f"The points of {a.name!r} are neither centres nor edges of their bounds; pass grid_positions.")


def level_rows(ds: GridDataset, var: str, z: Axis, given: str | DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of levels (level) by the indices of their axes, and these indices."""
    if not isinstance(given, str):
        on = [c for c in given.columns if c != "level"]
        if "level" not in given.columns or not set(on) <= {ds.axes[d].idx for d in ds.dims_of(var)}:
            raise ValueError("A table of levels has the column level and indices of the variable's axes.")
        return given.withColumn("level", F.col("level").cast("double")), on
    if given == "infer":
        return formula_levels(ds, z)
    if given not in ds.variables:
        raise RuntimeError(f"Could not find target variable {given!r} in dataset")
    return ds.fact_of(given).withColumnRenamed(given, "level"), [ds.axes[d].idx for d in ds.dims_of(given)]


#: Parametric levels by standard name: terms of which one of each set is needed, and the level from them.
FORMULAS = {
    "atmosphere_ln_pressure_coordinate": ((("p0", "lev"),), lambda t: t["p0"] * F.exp(-t["lev"])),
    "atmosphere_sigma_coordinate": ((("sigma", "ps", "ptop"),), lambda t: t["ptop"] + t["sigma"] * (t["ps"] - t["ptop"])),
    "atmosphere_hybrid_sigma_pressure_coordinate": ((("a", "b", "p0", "ps"), ("ap", "b", "ps")), lambda t: (t["ap"] if "ap" in t else t["a"] * t["p0"]) + t["b"] * t["ps"]),
    "atmosphere_hybrid_height_coordinate": ((("a", "b", "orog"),), lambda t: t["a"] + t["b"] * t["orog"]),
    "ocean_sigma_coordinate": ((("sigma", "eta", "depth"),), lambda t: t["eta"] + t["sigma"] * (t["depth"] + t["eta"])),
}


def formula_levels(ds: GridDataset, z: Axis) -> tuple[DataFrame, list[str]]:
    """Levels by the formula_terms of a Z axis: terms are variables of the dataset, the axis itself, or single values in attrs["scalars"]."""
    text = z.attrs.get("formula_terms")
    if not text:
        raise RuntimeError(f"Vertical coordinate {z.name!r} is not CF-compliant, {'missing' if text is None else 'empty'} 'formula_terms' attribute.")
    name = z.attrs.get("standard_name")
    if name not in FORMULAS:
        raise NotImplementedError(f"There is no formula for {name!r}.")
    words = text.replace(":", " ").split()
    terms = dict(zip(words[::2], words[1::2]))
    sets, level = FORMULAS[name]
    needed = next((s for s in sets if set(s) <= set(terms)), sets[0])
    scalars, columns, rows, on = ds.attrs.get("scalars", {}), {}, None, []
    for k in needed:
        source = terms.get(k)
        if source == z.name:
            own, idx = axis_frame(ds.spark, z.idx, {f"_{k}": z.values}), [z.idx]
        elif source in ds.variables:
            own, idx = ds.fact_of(source).withColumnRenamed(source, f"_{k}"), [ds.axes[d].idx for d in ds.dims_of(source)]
        elif source in scalars:
            columns[k] = F.lit(float(scalars[source]))
            continue
        else:
            raise KeyError(f"Required term {source or k} is absent in the dataset.")
        columns[k] = F.col(f"_{k}")
        small = int(np.prod([len(a) for a in ds.axes.values() if a.idx in idx]))
        common = [c for c in idx if c in on]
        if rows is None:
            rows = own
        elif common:
            rows = joined(rows, own, common, small)
        else:  # an axis's few terms with each of the others' cells
            rows = rows.crossJoin(F.broadcast(own)) if idx == [z.idx] else own.crossJoin(F.broadcast(rows))
        on += [c for c in idx if c not in on]
    return rows.select(*on, level(columns).alias("level")), on


def by_segments(ds: GridDataset, var: str, z: Axis, tz: Axis, method: str, target_data: str | DataFrame, mask_edges: bool = True) -> GridDataset:
    """Regridding by levels of each column: between neighbours, or for conservative over cells half way to them.

    A window gives each level the next ones of its column; the targets within a
    segment come out of a literal array, so that only matches make rows.
    """
    names = [ds.axes[d].idx for d in ds.dims_of(var)]
    others = [n for n in names if n != z.idx]
    scale = F.log if method == "log" else lambda c: c
    if isinstance(target_data, str) and ds.variables.get(target_data) == ds.dims_of(var):  # in the same rows
        rows = ds.frame_of(var).select(*names, F.nanvl(F.col(var).cast("double"), F.lit(None).cast("double")).alias(var), F.col(target_data).cast("double").alias("level"))
    else:
        table, on = level_rows(ds, var, z, target_data)
        small = int(np.prod([len(a) for a in ds.axes.values() if a.idx in on])) if set(on) < set(names) else BROADCAST_ROWS + 1
        rows = joined(ds.fact_of(var), table, on, small)
    rows = rows.select(*names, F.col(var).alias("_v"), scale(F.nanvl("level", F.lit(None).cast("double"))).alias("_l"))
    w = W.partitionBy(*others).orderBy(z.idx)
    if method == "conservative":
        return placed(ds, var, over_cells(rows, w, tz, z, others, names, var), {z.name: tz}, False, "xgcm", method)
    rows = rows.withColumn("_v1", F.lead("_v").over(w)).withColumn("_l1", F.lead("_l").over(w)).withColumn("_last", F.lead("_l", 2).over(w).isNull())
    at = np.log(tz.values) if method == "log" else tz.values
    targets = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(at)))
    low, high = F.least("_l", "_l1"), F.greatest("_l", "_l1")
    # half-open towards the next segment, so that a node belongs to one
    inside = lambda s: ((s["t"] >= low) & (s["t"] <= high)) & ((s["t"] != F.col("_l1")) | F.col("_last"))
    t = F.col("_s.t")
    if not mask_edges:  # the first and last segments go on, with the values of their ends
        rows = rows.withColumn("_first", F.lag("_l").over(w).isNull())
        up = F.col("_l1") > F.col("_l")
        before = lambda s: F.col("_first") & F.when(up, s["t"] < low).otherwise(s["t"] > high)
        after = lambda s: F.col("_last") & F.when(up, s["t"] > high).otherwise(s["t"] < low)
        own = F.filter(targets, lambda s: inside(s) | before(s) | after(s))
        t = F.least(F.greatest(t, low), high)
    else:
        own = F.filter(targets, inside)
    hit = rows.filter("_l is not null and _l1 is not null and _l <> _l1").withColumn("_s", F.explode(own))
    part = (t - F.col("_l")) / (F.col("_l1") - F.col("_l"))
    value = F.col("_v") + (F.col("_v1") - F.col("_v")) * part
    fact = hit.select(*others, F.col("_s.k").alias(z.idx), value.alias(var)).groupBy(*others, z.idx).agg(F.min(var).alias(var)).select(*names, var)
    return placed(ds, var, fact, {z.name: tz}, False, "xgcm", method)


def over_cells(rows: DataFrame, w, tz: Axis, z: Axis, others: list[str], names: list[str], var: str) -> DataFrame:
    """Sums over target layers of the shares of each level's cell, whose edges are half way to its neighbours' levels; missing if a share is."""
    before, after = F.lag("_l").over(w), F.lead("_l").over(w)
    rows = rows.withColumn("_a", F.coalesce(before, 2 * F.col("_l") - after)).withColumn("_b", F.coalesce(after, 2 * F.col("_l") - before))
    rows = rows.withColumn("_a", (F.col("_l") + F.col("_a")) / 2).withColumn("_b", (F.col("_l") + F.col("_b")) / 2)
    rows = rows.withColumn("_lo", F.least("_a", "_b")).withColumn("_hi", F.greatest("_a", "_b")).filter("_hi > _lo")
    lo, hi = ordered(tz)
    layers = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in enumerate(zip(lo, hi))))
    hit = rows.withColumn("_s", F.explode(F.filter(layers, lambda s: (s["a"] < F.col("_hi")) & (s["b"] > F.col("_lo")))))
    share = (F.least("_s.b", "_hi") - F.greatest("_s.a", "_lo")) / (F.col("_hi") - F.col("_lo"))
    out = hit.select(*others, F.col("_s.k").alias(z.idx), "_v", (share * F.col("_v")).alias("_x")).groupBy(*others, z.idx)
    return out.agg(F.when(F.count("_v") == F.count("*"), F.sum("_x")).alias(var)).select(*names, var)


def hybrid_levels(ds: GridDataset, surface: str, a: np.ndarray, b: np.ndarray, p0: float, z_name: str, name: str) -> DataFrame:
    """The parametric level a p0 + b ps of each surface value and Z position, as a fact column."""
    z = ds.axes[z_name]
    small = axis_frame(ds.spark, z.idx, {"_a": np.asarray(a, float), "_b": np.asarray(b, float)})
    return ds.fact_of(surface).crossJoin(F.broadcast(small)).withColumn(name, F.col("_a") * p0 + F.col("_b") * F.col(surface)).drop("_a", "_b", surface)
