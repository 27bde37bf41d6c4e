"""Queries of the spatial, regridding, mask and dataset operators, and SQL for the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import axes as A
from ..operators import bounds as B
from ..operators import compare, grids, masks, regrid
from ..operators import spatial as S
from ..operators import temporal as T
from ..sources import dataset as D
from ..sources.netcdf3 import write_netcdf3
from ..sources.shared import claim
from . import cubes
from .model import Axis, GridDataset, axis_frame
from .temporal_queries import GAPS, NUDGE, ORDERS, TIMES, gaps, rounded, shown

QUERIES, SQL = {}, {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def values(name: str, columns: str, rows) -> str:
    """Rows as a SQL table."""
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(repr(float(v)) + '::double' if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)})"


LAT = values("slat", "y, lat, lo, hi", [(y, -75.0 + 30 * y, -90.0 + 30 * y, -60.0 + 30 * y) for y in range(6)])
LON = values("slon", "x, lon, lo, hi", [(x, 22.5 + 45 * x, 45.0 * x, 45.0 * x + 45) for x in range(8)])
SIN = "sin(radians({}))"

# --- bounds ----------------------------------------------------------------


def axis_rows(spark, a: Axis, digits: int = 9) -> DataFrame:
    columns = {"value": a.values} | ({"lo": a.lo, "hi": a.hi} if a.has_bounds() else {})
    return axis_frame(spark, "i", columns).select("i", *(F.round(c, digits).alias(c) for c in columns))


def bounds_query(key: str, values_: np.ndarray, units: str):
    return lambda spark, sf_dir: axis_rows(spark, B.create_bounds(key, Axis({"X": "lon", "Y": "lat", "Z": "lev"}[key], values_, attrs={"units": units})))


def bounds_sql(values_: np.ndarray, clip: bool = False) -> str:
    lo = "value - coalesce(value - lag(value) over (order by i), lead(value) over (order by i) - value) / 2"
    hi = "value + coalesce(lead(value) over (order by i) - value, value - lag(value) over (order by i)) / 2"
    if clip:
        lo, hi = f"greatest(-90, least(90, {lo}))", f"greatest(-90, least(90, {hi}))"
    return f"with {values('a', 'i, value', list(enumerate(map(float, values_))))} select i, round(value, 9) as value, round({lo}, 9) as lo, round({hi}, 9) as hi from a"


LATS, LONS, LEVS = np.array([-90.0, -88.75, -30, 0, 41, 88.75, 90]), np.array([0, 1.875, 90, 200, 356.25, 358.125]), np.array([8000.0, 6000, 4500, 2000])
add("bounds_lat", bounds_query("Y", LATS, "degrees_north"), bounds_sql(LATS, True))
add("bounds_lon", bounds_query("X", LONS, "degrees_east"), bounds_sql(LONS))
add("bounds_lev", bounds_query("Z", LEVS, "m"), bounds_sql(LEVS))

# --- spatial averages --------------------------------------------------------


def spatial(axis=("X", "Y"), cube=gaps, **options):
    return lambda spark, sf_dir: shown(S.average(cube(spark, sf_dir), "v", axis, **options), stamp=True)


def lat_width(region=None) -> str:
    lo, hi = ("lo", "hi") if region is None else (f"least(greatest(lo, {region[0]}), {region[1]})", f"least(greatest(hi, {region[0]}), {region[1]})")
    return f"abs({SIN.format(hi)} - {SIN.format(lo)})"


def lon_width(region=None) -> str:
    """Overlap with the region on the circle."""
    if region is None or region[0] % 360 == region[1] % 360:
        return "hi - lo"
    a, b = region[0] % 360, region[1] % 360
    spans = [(a, b)] if a < b else [(a, 360), (0, b)]
    return " + ".join(f"greatest(0, least(hi, {q}) - greatest(lo, {p}))" for p, q in spans)


def spatial_sql(axis="XY", lat=None, lon=None, least: float = 0.0, skipna: bool = True) -> str:
    wy = f"wy as (select y, {lat_width(lat) if 'Y' in axis else '1'} as wy from slat)"
    wx = f"wx as (select x, {lon_width(lon) if 'X' in axis else '1'} as wx from slon)"
    keys = "t" + ("" if "Y" in axis else ", y") + ("" if "X" in axis else ", x")
    total = {"XY": "(select sum(wy) from wy) * (select sum(wx) from wx)", "X": "(select sum(wx) from wx)", "Y": "(select sum(wy) from wy)"}[axis]
    cells = {"XY": 48, "X": 8, "Y": 6}[axis]
    v = "sum(wx * wy * v) / nullif(sum(case when v is not null then wx * wy end), 0)"
    v = f"round({v} + {NUDGE}, 6)"
    if least:
        v = f"case when sum(case when v is not null then wx * wy else 0 end) / ({total}) >= {least} then {v} end"
    if not skipna:
        v = f"case when count(v) = {cells} then {v} end"
    return f"with {GAPS}, {LAT}, {LON}, {wy}, {wx} select {keys}, {v} as v from cube join wy using (y) join wx using (x) group by {keys}"


for name, axis in (("xy", "XY"), ("x", "X"), ("y", "Y")):
    add(f"spatial_average_{name}", spatial(tuple(axis)), spatial_sql(axis))
add("spatial_region_lat", spatial(lat_bounds=(-35, 50)), spatial_sql(lat=(-35, 50)))
add("spatial_region_latlon", spatial(lat_bounds=(-35, 50), lon_bounds=(30, 200)), spatial_sql(lat=(-35, 50), lon=(30, 200)))
add("spatial_region_wrap", spatial(lon_bounds=(300, 60)), spatial_sql(lon=(300, 60)))
add("spatial_region_negative", spatial(lon_bounds=(-170, -120)), spatial_sql(lon=(-170, -120)))
add("spatial_region_circular", spatial(lon_bounds=(-180, 180)), spatial_sql(lon=(180, 180)))
add("spatial_min_weight", spatial(min_weight=0.9), spatial_sql(least=0.9))
add("spatial_skipna_false", spatial(skipna=False), spatial_sql(skipna=False))


def custom(spark, sf_dir):
    ds = gaps(spark, sf_dir)
    w = regrid.ones_mask(ds).withColumn("weight", (F.col("lat_idx") + 2 * F.col("lon_idx") + 1).cast("double"))
    return shown(S.average(ds, "v", weights=w), stamp=True)


add("spatial_custom_weights", custom, f"with {GAPS} select t, round(sum((y + 2 * x + 1) * v) / sum(case when v is not null then y + 2 * x + 1 end) + {NUDGE}, 6) as v from cube group by t")
add(
    "spatial_weights",
    lambda s, d: S.get_weights(cubes.orders_cube(s, d), lat_bounds=(-35, 50), lon_bounds=(300, 60)).select(F.col("lat_idx").alias("y"), F.col("lon_idx").alias("x"), F.round("weight", 9).alias("w")),
    f"with {LAT}, {LON} select a.y, b.x, round(a.w * b.w, 9) as w from (select y, {lat_width((-35, 50))} as w from slat) a, (select x, {lon_width((300, 60))} as w from slon) b",
)

# --- longitude orientation ----------------------------------------------------


def swap(start: float, to):
    def run(spark, sf_dir):
        ds = cubes.orders_cube(spark, sf_dir).with_axis(cubes.lon_axis(start))
        ds = A.swap_lon_axis(ds, to)
        a = ds.axes["lon"]
        small = axis_frame(spark, a.idx, {"lon": a.values, "lo": a.lo, "hi": a.hi})
        return T.average(ds, "v", weighted=False).fact.join(F.broadcast(small), "lon_idx").select(F.col("lat_idx").alias("y"), F.col("lon_idx").alias("x"), "lon", "lo", "hi", rounded("v").alias("v"))

    return run


def swap_sql(cells: str) -> str:
    """cells: rows of old index, longitude and bounds."""
    return f"with {ORDERS}, c(old, lon, lo, hi) as ({cells}), r as (select *, cast(row_number() over (order by lon) - 1 as integer) as x from c) select cube.y, r.x, r.lon, r.lo, r.hi, round(avg(v) + {NUDGE}, 6) as v from cube join r on cube.x = r.old group by cube.y, r.x, r.lon, r.lo, r.hi"


def cell_rows(rows) -> str:
    return "values " + ", ".join(f"({o}, {a}::double, {b}::double, {c}::double)" for o, a, b, c in rows)


add("swap_lon_180", swap(22.5, (-180, 180)), swap_sql(cell_rows([(k, 22.5 + 45 * k - (360 if k > 3 else 0), 45 * k - (360 if k > 3 else 0), -180 if k == 3 else 45 * k + 45 - (360 if k > 3 else 0)) for k in range(8)])))
add("swap_lon_360", swap(-157.5, (0, 360)), swap_sql(cell_rows([(k, -157.5 + 45 * k + (360 if k < 4 else 0), -180 + 45 * k + (360 if k < 4 else 0), -135 + 45 * k + (360 if k < 4 else 0)) for k in range(8)])))
PM = [(k, -180 + 45 * k + (360 if k < 4 else 0), -202.5 + 45 * k + (360 if k < 4 else 0), -157.5 + 45 * k + (360 if k < 4 else 0)) for k in range(8)]
PM = [(0, 180, 157.5, 202.5), *PM[1:4], (4, 0, 0, 22.5), *PM[5:], (4, 360, 337.5, 360)]
add("swap_lon_prime_meridian", swap(-180.0, (0, 360)), swap_sql(cell_rows(PM)))

# --- grids ---------------------------------------------------------------------


def grid_rows(make):
    def run(spark, sf_dir):
        g = make()
        rows = [(k, i, float(a.values[i]), float(a.lo[i]), float(a.hi[i])) for k, a in (("X", g.x), ("Y", g.y)) for i in range(len(a))]
        return spark.createDataFrame(rows, "axis string, i int, value double, lo double, hi double").select("axis", "i", *(F.round(c, 6).alias(c) for c in ("value", "lo", "hi")))

    return run


UNIFORM = "select 'Y' as axis, cast(i as integer) as i, -90.0::double + 4 * i as value, greatest(-90.0::double, -92 + 4 * i) as lo, least(90.0::double, -88 + 4 * i) as hi from range(46) r(i) union all select 'X', cast(i as integer), 5.0::double * i, 5.0::double * i - 2.5, 5.0::double * i + 2.5 from range(73) r(i)"
add("grid_uniform", grid_rows(lambda: grids.create_uniform_grid(-90, 90, 4, 0, 360, 5)), UNIFORM)


def gaussian_sql(n: int) -> str:
    """Zeros of the Legendre polynomial as a sum of cosines, by Newton's method, and edges by running sums of the weights."""
    f, d = f"sum(c * cos(({n} - 2 * k) * th))", f"sum(({n} - 2 * k) * c * sin(({n} - 2 * k) * th))"
    steps = ", ".join(f"t{j + 1} as materialized (select i, th + {f} / {d} as th from t{j}, c group by i, th)" for j in range(6))
    return f"""with a as (select k, exp(sum(case when k = 0 then 0 else ln((2.0::double * k - 1) / (2 * k)) end) over (order by k)) as a from range({n + 1}) r(k)),
      c as materialized (select x.k, x.a * y.a as c from a x join a y on y.k = {n} - x.k), t0 as (select i, pi() * (i + 0.75) / ({n} + 0.5) as th from range({n}) r(i)), {steps},
      w as (select i, 90 - degrees(th) as value, 2 / pow({d}, 2) as w from t6, c group by i, th),
      e as (select i, value, 1 - sum(w) over (order by i) as s, w from w)
      select 'Y' as axis, cast(i as integer) as i, round(value, 6) as value, round(degrees(asin(greatest(-1, least(1, s + w)))), 6) + 0.0 as lo, round(degrees(asin(greatest(-1, least(1, s)))), 6) + 0.0 as hi from e
      union all select 'X', cast(i as integer), i * 180.0::double / {n}, (i - 0.5) * 180.0::double / {n}, (i + 0.5) * 180.0::double / {n} from range({2 * n + 1}) r(i)"""


add("grid_gaussian", grid_rows(lambda: grids.create_gaussian_grid(32)), gaussian_sql(32))
add("grid_global_mean", grid_rows(lambda: grids.global_mean_grid(grids.create_uniform_grid(-90, 90, 4, 0, 360, 5))), "select 'Y' as axis, 0 as i, 0.0::double as value, -90.0::double as lo, 90.0::double as hi union all select 'X', 0, 180.0::double, -2.5::double, 362.5::double")
add("grid_zonal", grid_rows(lambda: grids.zonal_grid(grids.create_uniform_grid(-90, 90, 4, 0, 360, 5))), f"select * from ({UNIFORM}) where axis = 'Y' union all select 'X', 0, 180.0::double, -2.5::double, 362.5::double")

# --- horizontal regridding --------------------------------------------------------


def target(lat: list[float], lon: list[float], dlat: float, dlon: float) -> grids.Grid:
    """Cells around centres."""
    y, x = np.array(lat, float), np.array(lon, float)
    return grids.Grid(x=Axis("lon", x, x - dlon / 2, x + dlon / 2, {"axis": "X"}), y=Axis("lat", y, np.maximum(y - dlat / 2, -90), np.minimum(y + dlat / 2, 90), {"axis": "Y"}))


COARSE = target([-60, 0, 60], [60, 180, 300], 60, 120)
FINE = target([-81 + 18 * k for k in range(10)], [15 + 30 * k for k in range(12)], 18, 30)
GLOBAL = grids.Grid(x=Axis("lon", [180.0], [0.0], [360.0], {"axis": "X"}), y=Axis("lat", [0.0], [-90.0], [90.0], {"axis": "Y"}))
ZONAL = grids.Grid(x=GLOBAL.x, y=cubes.lat_axis())


def horizontal(grid: grids.Grid, cube=cubes.orders_cube, **options):
    return lambda spark, sf_dir: shown(regrid.horizontal(cube(spark, sf_dir), "v", grid, **options), stamp=True).filter("v is not null")


def cells_sql(name: str, a: Axis) -> str:
    return values(name, "i, c, lo, hi", [(k, float(a.values[k]), float(a.lo[k]), float(a.hi[k])) for k in range(len(a))])


def overlap_sql(grid: grids.Grid) -> str:
    """Overlaps of target and source cells, sources repeated around the circle."""
    return f"""{LAT}, {LON}, {cells_sql("tlat", grid.y)}, {cells_sql("tlon", grid.x)},
      wy as (select a.i, b.y, {SIN.format("least(a.hi, b.hi)")} - {SIN.format("greatest(a.lo, b.lo)")} as wy, {SIN.format("a.hi")} - {SIN.format("a.lo")} as ay from tlat a join slat b on a.lo < b.hi and a.hi > b.lo),
      wx as (select a.i as j, b.x, least(a.hi, b.hi + s.k) - greatest(a.lo, b.lo + s.k) as wx, a.hi - a.lo as ax from tlon a, slon b, (values (-360), (0), (360)) s(k) where a.lo < b.hi + s.k and a.hi > b.lo + s.k)"""


def regrid_sql(grid: grids.Grid, value: str = "sum(wx * wy * v) / sum(wx * wy)", cube: str = ORDERS) -> str:
    return f"""with {cube}, {overlap_sql(grid)}, need as (select i, j, count(*) as n from wy, wx group by i, j),
      r as (select t, wy.i, wx.j, {value} as v, count(v) as c from cube join wy using (y) join wx using (x) group by t, wy.i, wx.j)
      select t, r.i as y, r.j as x, round(r.v + {NUDGE}, 6) as v from r join need using (i, j) where c = n and r.v is not null"""


for name, grid in (("coarsen", COARSE), ("refine", FINE), ("global_mean", GLOBAL), ("zonal", ZONAL)):
    add(f"regrid2_{name}", horizontal(grid, tool="regrid2", dtype="double"), regrid_sql(grid))


def masked(spark, sf_dir):
    ds = cubes.orders_cube(spark, sf_dir)
    m = regrid.ones_mask(ds).withColumn("mask", ((F.col("lat_idx") * 3 + F.col("lon_idx")) % 4 > 0).cast("double"))
    return shown(regrid.regrid2(ds, "v", COARSE, mask=m, dtype="double"), stamp=True).filter("v is not null")


MASKED = "sum(wx * wy * (case when (y * 3 + x) % 4 > 0 then 1 else 0 end) * v) / nullif(sum(wx * wy * (case when (y * 3 + x) % 4 > 0 then 1 else 0 end)), 0)"
add("regrid2_masked", masked, regrid_sql(COARSE, MASKED))
add(
    "regrid2_weights",
    lambda s, d: regrid.regrid2_weights(cubes.orders_cube(s, d), "v", COARSE).withColumn("weight", F.round("weight", 9)),
    f"with {overlap_sql(COARSE)} select wy.i as y_out, wx.j as x_out, wy.y as y_in, wx.x as x_in, round(wy.wy * wx.wx, 9) as weight from wy, wx",
)
add("nan_mask", lambda s, d: regrid.nan_mask(gaps(s, d), "v").select(F.col("lat_idx").alias("y"), F.col("lon_idx").alias("x"), "mask"), f"with {GAPS}, {LAT}, {LON} select slat.y, slon.x, cast(c.v is not null as integer) as mask from slat cross join slon left join (select * from cube where t = (select min(t) from cube)) c on c.y = slat.y and c.x = slon.x")
add("horizontal_conservative", horizontal(FINE, method="conservative"), regrid_sql(FINE, "sum(wx * wy / ax / ay * v)"))
PART = target([-85, 85], [100, 200], 20, 40)
add("horizontal_conservative_normed", horizontal(PART, method="conservative_normed"), regrid_sql(PART))
POINTS = target([-80, -50, -20, 10, 40, 70], [10, 70, 130, 190, 250, 310], 20, 20)
ANGLE = "2 * asin(sqrt(least(1, pow(sin(radians(a.c - b.lat) / 2), 2) + cos(radians(a.c)) * cos(radians(b.lat)) * pow(sin(radians(d.c - e.lon) / 2), 2))))"
NEAREST = f"select a.i, d.i as j, b.y, e.x, round({ANGLE}, 9) as far from tlat a, tlon d, slat b, slon e"
POINT_TABLES = f"{LAT}, {LON}, {cells_sql('tlat', POINTS.y)}, {cells_sql('tlon', POINTS.x)}"
add("horizontal_nearest_s2d", horizontal(POINTS, method="nearest_s2d"), f"with {ORDERS}, {POINT_TABLES}, n as (select * from ({NEAREST}) qualify row_number() over (partition by i, j order by far, y, x) = 1) select t, n.i as y, n.j as x, round(v + {NUDGE}, 6) as v from cube join n on cube.y = n.y and cube.x = n.x where v is not null")
WIDE = target([-70, 5, 65], [20, 140, 250], 20, 20)
WIDE_TABLES = f"{LAT}, {LON}, {cells_sql('tlat', WIDE.y)}, {cells_sql('tlon', WIDE.x)}"
add(
    "horizontal_nearest_d2s",
    horizontal(WIDE, method="nearest_d2s"),
    f"with {ORDERS}, {WIDE_TABLES}, n as (select * from ({NEAREST}) qualify row_number() over (partition by y, x order by far, i, j) = 1), need as (select i, j, count(*) as n from n group by i, j) select t, i as y, j as x, round(v + {NUDGE}, 6) as v from (select t, n.i, n.j, sum(v) as v, count(v) as c from cube join n on cube.y = n.y and cube.x = n.x group by t, n.i, n.j) join need using (i, j) where c = n",
)
LINEAR = f"""with {ORDERS}, {POINT_TABLES},
  ly as (select i, unnest([k, k + 1]) as y, unnest([1 - f, f]) as w from (select i, k, (c + 75) / 30 - k as f from (select i, c, cast(least(floor((c + 75) / 30), 4) as integer) as k from tlat where c >= -75 and c <= 75))),
  lx as (select i as j, unnest([k, k + 1]) as x, unnest([1 - f, f]) as w from (select i, k, (c - 22.5) / 45 - k as f from (select i, c, cast(least(floor((c - 22.5) / 45), 6) as integer) as k from tlon where c >= 22.5 and c <= 337.5))),
  fy as (select * from ly where w <> 0), fx as (select * from lx where w <> 0),
  need as (select i, j, count(*) as n from fy, fx group by i, j),
  r as (select t, fy.i, fx.j, sum(fy.w * fx.w * v) as v, count(v) as c from cube join fy on cube.y = fy.y join fx on cube.x = fx.x group by t, fy.i, fx.j)
  select t, r.i as y, r.j as x, round(r.v + {NUDGE}, 6) as v from r join need using (i, j) where c = n"""
add("horizontal_bilinear", horizontal(POINTS, method="bilinear"), LINEAR)
add(
    "bilinear_weights",
    lambda s, d: regrid.method_weights(cubes.orders_cube(s, d), "v", POINTS, "bilinear").withColumn("weight", F.round("weight", 9)),
    LINEAR.split(",\n  need as")[0] + " select fy.i as y_out, fx.j as x_out, fy.y as y_in, fx.x as x_in, round(fy.w * fx.w, 9) as weight from fy, fx",
)
ROUND_X = LINEAR.replace(LINEAR[LINEAR.index("lx as ("):LINEAR.index(",\n  fy as")], "lx as (select i as j, unnest([(k + 8) % 8, (k + 9) % 8]) as x, unnest([1 - f, f]) as w from (select i, k, (c - 22.5) / 45 - k as f from (select i, c, cast(floor((c - 22.5) / 45) as integer) as k from tlon)))")
add("horizontal_bilinear_periodic", horizontal(POINTS, method="bilinear", periodic=True), ROUND_X)


def patch_sql(name: str, index: str, table: str, u: str, n: int) -> str:
    """Weights of patches along an axis of n even points, u the target's place among them: quadratics about either neighbour, blended."""
    parts = " union all ".join(
        f"select i, m + {d} as {index}, share * ({w}) as w from (select i, greatest(1, least({n - 2}, node)) as m, share, u - greatest(1, least({n - 2}, node)) as s from (select i, u, unnest([k, k + 1]) as node, unnest([1 - (u - k), u - k]) as share from (select i, {u} as u, greatest(0, least({n - 2}, cast(floor({u}) as integer))) as k from {table}) where u >= 0 and u <= {n - 1}))"
        for d, w in ((-1, "s * (s - 1) / 2"), (0, "1 - s * s"), (1, "s * (s + 1) / 2"))
    )
    return f"{name} as (select i, {index}, sum(w) as w from ({parts}) group by i, {index} having abs(sum(w)) > 1e-12)"


add(
    "horizontal_patch",
    horizontal(POINTS, method="patch"),
    f"""with {ORDERS}, {POINT_TABLES}, {patch_sql("py", "y", "tlat", "(c + 75) / 30", 6)}, {patch_sql("px", "x", "tlon", "(c - 22.5) / 45", 8)},
      need as (select a.i, b.i as j, count(*) as n from py a, px b group by a.i, b.i),
      r as (select t, py.i, px.i as j, sum(py.w * px.w * v) as v, count(v) as c from cube join py on cube.y = py.y join px on cube.x = px.x group by t, py.i, px.i)
      select t, r.i as y, r.j as x, round(r.v + {NUDGE}, 6) as v from r join need using (i, j) where c = n""",
)
add(
    "horizontal_idw",
    horizontal(POINTS, method="bilinear", extrap_method="inverse_dist", extrap_num_src_pnts=4),
    f"""select * from ({LINEAR}) union all select * from (with {ORDERS}, {POINT_TABLES},
      n as (select i, j, y, x, 1 / pow(greatest(raw, 1e-12), 2) as w from (select a.i, d.i as j, b.y, e.x, {ANGLE} as raw from tlat a, tlon d, slat b, slon e where a.c not between -75 and 75 or d.c not between 22.5 and 337.5)
        qualify row_number() over (partition by i, j order by round(raw, 12), y, x) <= 4)
      select t, n.i as y, n.j as x, round(sum(w * v) / sum(w) + {NUDGE}, 6) as v from cube join n on cube.y = n.y and cube.x = n.x group by t, n.i, n.j having count(v) = 4)""",
)


def curvilinear(spark, sf_dir):
    """Customers as scattered points, at each target the balance of the nearest."""
    k = F.col("c_custkey")
    points = cubes.table(spark, sf_dir, "customer").select(((k * 7919) % 17989 / 100 - 90).alias("lat"), ((k * 104729) % 35983 / 100).alias("lon"), F.col("c_acctbal").cast("double").alias("v"))
    return regrid.curvilinear_nearest(points, spark, POINTS, "v").select(F.col("y_idx").alias("y"), F.col("x_idx").alias("x"), "v")


add(
    "curvilinear_nearest",
    curvilinear,
    f"""with {cells_sql("tlat", POINTS.y)}, {cells_sql("tlon", POINTS.x)}, b as (select (c_custkey * 7919) % 17989 / 100 - 90 as lat, cast(c_acctbal as double) as v, (c_custkey * 104729) % 35983 / 100 as lon from customer)
      select a.i as y, d.i as x, arg_min(b.v, {ANGLE.replace("e.lon", "b.lon")}) as v from tlat a, tlon d, b group by a.i, d.i""",
)

# --- vertical regridding -----------------------------------------------------------

LEVELS = grids.Grid(z=Axis("lev", [990.0 - 23 * k for k in range(40)], attrs={"axis": "Z"}))
LAYERS = grids.Grid(z=Axis("lev", [1000.0 - 60 * k for k in range(16)], [1030.0 - 60 * k for k in range(16)], [970.0 - 60 * k for k in range(16)], {"axis": "Z"}))
THETA = grids.Grid(z=Axis("lev", [305.25 + 7 * k for k in range(16)], attrs={"axis": "Z"}))


def vertical(grid: grids.Grid, method: str, **options):
    return lambda spark, sf_dir: shown(regrid.vertical(cubes.profiles(spark, sf_dir), "v", grid, method, **options)).filter("v is not null")


PROFILE = "profile as (select cast(vec_id as integer) as vec, cast(u.p - 1 as integer) as p, cast(embedding[u.p] as double) as v, 1000.0::double - 15 * (u.p - 1) as z, 300.0::double + 2 * (u.p - 1) + (vec_id % 10) / 10.0::double as theta from embeddings, lateral (select unnest(range(1, 65)) as p) u)"


def segments_sql(level: str, targets: list[float]) -> str:
    """Interpolation within the segment that a target is in, its upper end excluded but for the last."""
    return f"""with {PROFILE}, {values("t", "k, c", list(enumerate(map(float, targets))))},
      s as (select vec, p, v, {level} as l, lead(v) over w as v1, lead({level}) over w as l1 from profile window w as (partition by vec order by p)),
      r as (select s.vec, t.k as z, v + (v1 - v) * (t.c - l) / (l1 - l) as v, row_number() over (partition by s.vec, t.k order by p) as n from s join t on l1 is not null and t.c >= least(l, l1) and t.c <= greatest(l, l1))
      select vec, z, round(v + {NUDGE}, 6) as v from r where n = 1"""


add("vertical_linear", vertical(LEVELS, "linear"), segments_sql("z", list(LEVELS.z.values)))
add("vertical_log", vertical(LEVELS, "log"), segments_sql("ln(z)", list(np.log(LEVELS.z.values))))
LAYER_ROWS = values("t", "k, hi, lo", [(k, 1030.0 - 60 * k, 970.0 - 60 * k) for k in range(16)])
add("vertical_conservative", vertical(LAYERS, "conservative"), f"with {PROFILE}, {LAYER_ROWS} select vec, t.k as z, round(sum(v * (least(t.hi, z + 7.5) - greatest(t.lo, z - 7.5)) / 15) + {NUDGE}, 6) as v from profile join t on t.lo < z + 7.5 and t.hi > z - 7.5 group by vec, t.k")
add("vertical_target_data", vertical(THETA, "linear", target_data="theta"), segments_sql("theta", list(THETA.z.values)))

NEAR_ENDS = [1100.0 - 60 * k for k in range(20)]
add("vertical_unmasked", vertical(grids.Grid(z=Axis("lev", NEAR_ENDS, attrs={"axis": "Z"})), "linear", mask_edges=False), segments_sql("z", [min(1000.0, max(55.0, t)) for t in NEAR_ENDS]))
THETA_LAYERS = grids.Grid(z=Axis("lev", [308.0 + 16 * k for k in range(8)], [300.0 + 16 * k for k in range(8)], [316.0 + 16 * k for k in range(8)], {"axis": "Z"}))
add(
    "vertical_conservative_target_data",
    vertical(THETA_LAYERS, "conservative", target_data="theta"),
    f"with {PROFILE}, {values('t', 'k, lo, hi', [(k, 300.0 + 16 * k, 316.0 + 16 * k) for k in range(8)])} select vec, t.k as z, round(sum(v * (least(t.hi, theta + 1) - greatest(t.lo, theta - 1)) / 2) + {NUDGE}, 6) as v from profile join t on t.lo < theta + 1 and t.hi > theta - 1 group by vec, t.k",
)
HYBRID = [1020.0 - 19 * k for k in range(30)]


def by_formula(spark, sf_dir):
    """Levels ap + b ps by the axis's formula terms: ap and b along the axis, ps for each column."""
    ds = cubes.profiles(spark, sf_dir)
    p = np.arange(64)
    attrs = {**ds.axes["lev"].attrs, "standard_name": "atmosphere_hybrid_sigma_pressure_coordinate", "formula_terms": "ap: ap b: b ps: ps"}
    ds = ds.with_axis(ds.axes["lev"].with_(attrs=attrs)).with_frame(axis_frame(spark, "lev_idx", {"ap": 5.0 * p, "b": 1 - p / 64}), {"ap": ("lev",), "b": ("lev",)})
    ds = ds.with_frame(cubes.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("vec_idx"), (1000.0 + F.col("vec_id") % 50).alias("ps")), {"ps": ("vec",)})
    return shown(regrid.vertical(ds, "v", grids.Grid(z=Axis("lev", HYBRID, attrs={"axis": "Z"})), "linear", target_data="infer")).filter("v is not null")


add("vertical_formula_terms", by_formula, segments_sql("(5.0::double * p + (1 - p / 64.0::double) * (1000.0::double + vec % 50))", HYBRID))

# --- masks -----------------------------------------------------------------------------


def fraction(ds: GridDataset) -> DataFrame:
    return regrid.ones_mask(ds).withColumn("mask", ((F.col("lat_idx") * 3 + F.col("lon_idx")) % 6) / 5.0)


FRACTION = "((y * 3 + x) % 6) / 5.0"
add("mask_land", lambda s, d: shown(masks.mask_land(ds := cubes.orders_cube(s, d), "v", fraction(ds)), stamp=True), f"with {ORDERS} select t, y, x, case when {FRACTION} <= 0.2 then round(v + {NUDGE}, 6) end as v from cube")
add("mask_sea", lambda s, d: shown(masks.mask_sea(ds := cubes.orders_cube(s, d), "v", fraction(ds)), stamp=True), f"with {ORDERS} select t, y, x, case when {FRACTION} >= 0.8 then round(v + {NUDGE}, 6) end as v from cube")
RINGS = [np.array([[-150.0, -80], [-60, -50], [20, 70], [-100, 60]]), np.array([[40.0, -30], [170, -30], [170, 50], [100, 10], [40, 50]])]
EDGES = [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for r in RINGS for a, b in zip(r, np.roll(r, -1, axis=0))]
add(
    "polygon_mask",
    lambda s, d: masks.generate_mask(cubes.orders_cube(s, d), "v", "polygon", RINGS).select(F.col("lat_idx").alias("y"), F.col("lon_idx").alias("x"), "mask"),
    f"with {LAT}, {LON}, {values('e', 'x0, y0, x1, y1', EDGES)} select y, x, cast(count(x0) % 2 as integer) as mask from (select y, x, lat, case when lon > 180 then lon - 360 else lon end as lon from slat, slon) c left join e on (y0 > lat) <> (y1 > lat) and lon < x0 + (lat - y0) / (y1 - y0) * (x1 - x0) group by y, x",
)


def pcmdi(spark, sf_dir):
    ds = cubes.orders_cube(spark, sf_dir)
    share = ds.fact.groupBy("lat_idx", "lon_idx").agg((F.count("*") % 10 / 9.0).alias("land"))
    source = GridDataset(share, {k: ds.axes[k] for k in ("lat", "lon")}, {"land": ("lat", "lon")})
    return masks.generate_mask(ds, "v", "pcmdi", source=source, source_var="land").select(F.col("lat_idx").alias("y"), F.col("lon_idx").alias("x"), "mask")


def half_sql(name: str, index: str, table: str, c: str, clip: bool, measure: str, shifts: str) -> str:
    """The mean over the cells of every second point: shares of the axis's own cells in them."""
    lo, hi = f"{c} - coalesce({c} - lag({c}) over o, lead({c}) over o - {c}) / 2", f"{c} + coalesce(lead({c}) over o - {c}, {c} - lag({c}) over o) / 2"
    if clip:
        lo, hi = f"greatest(-90, {lo})", f"least(90, {hi})"
    w = f"{measure.format('least(h.hi, s.hi + k)')} - {measure.format('greatest(h.lo, s.lo + k)')}"
    return f"""{name}_cells as (select {index} as i, {lo} as lo, {hi} as hi from {table} window o as (partition by {index} % 2 order by {index})),
      {name} as materialized (select i, {index}, sum(w) / sum(sum(w)) over (partition by i) as w from (select h.i, s.{index}, {w} as w from {name}_cells h, {table} s, (values {shifts}) r(k) where h.lo < s.hi + k and h.hi > s.lo + k) group by i, {index})"""


def pcmdi_sql(rounds: int = 26) -> str:
    """Rounds of turning cells, each from the last one's mask."""
    steps = []
    for k in range(rounds):
        steps.append(f"""g{k} as materialized (select f.y, f.x, f.f, f.first, m.m, f.f - cast(cast(a.v as float) as double) as gap from frac f join m{k} m using (y, x)
          join (select hy.i as y, hx.i as x, sum(hy.w * hx.w * m) as v from m{k} join hy using (y) join hx using (x) group by hy.i, hx.i) a using (y, x)),
          c{k} as materialized (select *, gap > 0.2 and f > 0.3 as rise, gap < -0.2 and f < 0.7 as fall from g{k}),
          n{k} as materialized (select b.y, b.x, max(case when c.rise and c.first = 1 then 1 else 0 end) as land, max(case when c.fall and c.first = 0 then 1 else 0 end) as sea from beside b join c{k} c on c.y = b.ny and c.x = b.nx group by b.y, b.x),
          m{k + 1} as materialized (select c.y, c.x, case when c.y between 1 and 4 and fall and f < 1 - sea then 0 when c.y between 1 and 4 and rise and f > land then 1 else m end as m from c{k} c join n{k} using (y, x))""")
    return f"""with {ORDERS}, {LAT}, {LON}, {half_sql("hy", "y", "slat", "lat", True, SIN, "(0)")}, {half_sql("hx", "x", "slon", "lon", False, "({})", "(-360), (0), (360)")},
      frac as materialized (select y, x, f, case when f > 0.5 then 1 else 0 end as first from (select y, x, (count(*) % 10) / 9.0::double as f from cube group by y, x)),
      beside as materialized (select a.y, a.x, b.y as ny, b.x as nx from frac a join frac b on abs(a.y - b.y) <= 1 and (b.x - a.x + 9) % 8 <= 2 and (a.y <> b.y or a.x <> b.x)),
      m0 as materialized (select y, x, first as m from frac), {", ".join(steps)}
      select y, x, cast(m as integer) as mask from m{rounds}"""


add("pcmdi_mask", pcmdi, pcmdi_sql())


def mask_in_one_call(spark, sf_dir):
    """The variable at sea by polygons, and the mask as a variable beside it."""
    out = masks.masked(cubes.orders_cube(spark, sf_dir), "v", "polygon", "sea", output_mask="land", polygons=RINGS)
    both = shown(out, stamp=True).withColumn("name", F.lit("v")).unionByName(shown(out, var="land").withColumn("name", F.lit("land")).withColumn("t", F.lit(None).cast("timestamp_ntz")))
    return both


MASK_SQL = SQL["polygon_mask"]
add("mask_generate_and_apply", mask_in_one_call, f"with {ORDERS}, land as ({MASK_SQL}) select t, y, x, case when mask <= 0.2 then round(v + {NUDGE}, 6) end as v, 'v' as name from cube join land using (y, x) union all select null, y, x, round(cast(mask as double) + {NUDGE}, 6), 'land' from land")

# --- datasets -----------------------------------------------------------------------------


def between(ds: GridDataset, start: str, stop: str) -> GridDataset:
    """The dataset of some months alone, as a file would have it."""
    a = ds.axes["time"]
    keep = np.flatnonzero((a.values >= np.datetime64(start, "us").astype(np.int64)) & (a.values < np.datetime64(stop, "us").astype(np.int64)))
    first = int(keep[0]) if len(keep) else 0
    fact = ds.fact.filter(F.col("time_idx").between(first, first + len(keep) - 1)).withColumn("time_idx", (F.col("time_idx") - first).cast("int"))
    return ds.with_(fact=fact).with_axis(a.take(keep))


def two_files(join: str):
    def run(spark, sf_dir):
        ds = cubes.orders_cube(spark, sf_dir)
        return shown(D.combine([between(ds, "1995-01-01", "1998-07-01"), between(ds, "1998-01-01", "2002-01-01")], join), stamp=True)

    return run


def two_files_turned(join: str):
    """Two files of which the first has all latitudes from north to south, the second three of them the other way."""

    def run(spark, sf_dir):
        ds = cubes.orders_cube(spark, sf_dir)
        down = axis_frame(spark, "lat_idx", {"_new": np.arange(5, -1, -1).astype(np.int32)}).withColumn("_new", F.col("_new").cast("int"))
        one = ds.with_(fact=ds.fact.join(F.broadcast(down), "lat_idx").drop("lat_idx").withColumnRenamed("_new", "lat_idx").select(ds.fact.columns)).with_axis(ds.axes["lat"].take(slice(None, None, -1)))
        two = ds.with_(fact=ds.fact.filter("lat_idx < 3")).with_axis(ds.axes["lat"].take(slice(0, 3)))
        out = D.combine([one, two], join)
        lat = axis_frame(spark, "lat_idx", {"lat": out.axes["lat"].values})
        return shown(out, stamp=True).join(F.broadcast(lat.withColumnRenamed("lat_idx", "y")), "y")

    return run


add("mfdataset_left", two_files_turned("left"), f"with {ORDERS} select t, 5 - y as y, x, -75.0::double + 30 * y as lat, round(v + {NUDGE}, 6) as v from cube")
add("mfdataset_right", two_files_turned("right"), f"with {ORDERS} select t, y, x, -75.0::double + 30 * y as lat, round(v + {NUDGE}, 6) as v from cube where y < 3")


def overridden(spark, sf_dir):
    ds = cubes.orders_cube(spark, sf_dir)
    other = ds.with_(fact=ds.fact.withColumn("v", F.col("v") * 2))
    return shown(D.combine([between(ds, "1995-01-01", "1998-01-01"), other], "outer", "override"), stamp=True)


add("mfdataset_override", overridden, f"with {ORDERS} select t, y, x, round(case when t < timestamp '1998-01-01' then v else 2 * v end + {NUDGE}, 6) as v from cube")


def with_mean(spark, sf_dir) -> GridDataset:
    """The cube and, on other axes, each cell's mean over its months."""
    ds = cubes.orders_cube(spark, sf_dir)
    return ds.with_frame(ds.fact.groupBy("lat_idx", "lon_idx").agg(F.avg("v").alias("mean")), {"mean": ("lat", "lon")})


def both_facts(ds: GridDataset) -> DataFrame:
    one = shown(ds, stamp=True).withColumn("name", F.lit("v"))
    return one.unionByName(shown(ds, var="mean").withColumn("name", F.lit("mean")).withColumn("t", F.lit(None).cast("timestamp_ntz")))


def open_multi(spark, sf_dir):
    path = claim(spark, "grid")
    D.write_dataset(with_mean(spark, sf_dir), path)
    return both_facts(D.open_dataset(spark, path, add_bounds=None))


def open_turned(spark, sf_dir):
    """Written, read again as one variable, and turned to longitudes from -180 to 180."""
    path = claim(spark, "grid")
    D.write_dataset(with_mean(spark, sf_dir), path)
    return shown(D.open_dataset(spark, path, "mean", add_bounds=("X", "Y"), lon_orient=(-180, 180)), var="mean")


def netcdf_round_trip(spark, sf_dir):
    """Written as a folder of netCDF files of 12 months each, and read as one dataset."""
    folder = claim(spark, "netcdf")
    write_netcdf3(cubes.orders_cube(spark, sf_dir), folder, 12).count()
    return shown(D.open_mfdataset(spark, folder, "v", add_bounds=None, preprocess=lambda ds: ds), stamp=True).filter("v is not null")


MEAN_SQL = "select null as t, y, x, round(avg(v) + {}, 6) as v, 'mean' as name from cube group by y, x".format(NUDGE)
add("open_dataset_multi", open_multi, f"with {ORDERS} select t, y, x, round(v + {NUDGE}, 6) as v, 'v' as name from cube union all {MEAN_SQL}")
add("open_dataset_single", open_turned, f"with {ORDERS} select y, (x + 4) % 8 as x, v from ({MEAN_SQL})")
add("netcdf_round_trip", netcdf_round_trip, f"with {ORDERS} select t, y, x, round(v + {NUDGE}, 6) as v from cube")
add("mfdataset_outer", two_files("outer"), f"with {ORDERS} select t, y, x, round(v + {NUDGE}, 6) as v from cube")
add("mfdataset_inner", two_files("inner"), f"with {ORDERS} select t, y, x, round(v + {NUDGE}, 6) as v from cube where t >= timestamp '1998-01-01' and t < timestamp '1998-07-01'")


def single(spark, sf_dir):
    ds = cubes.orders_cube(spark, sf_dir)
    two = ds.with_(fact=ds.fact.withColumn("other", F.col("v") * 2), variables={**ds.variables, "other": ds.variables["v"]})
    return shown(D.keep_single_var(two, "v"), stamp=True)


add("keep_single_var", single, f"with {ORDERS} select t, y, x, round(v + {NUDGE}, 6) as v from cube")


def differences(spark, sf_dir):
    one = cubes.orders_cube(spark, sf_dir)
    other = A.swap_lon_axis(gaps(spark, sf_dir), (-180, 180), False)
    return spark.createDataFrame([(k, n) for k, names in compare.compare_datasets(one, other).items() for n in names], "kind string, name string")


add("compare_datasets", differences, "values ('nonidentical_coords', 'lon'), ('nonequal_coords', 'lon'), ('nonidentical_data_vars', 'v'), ('nonequal_data_vars', 'v')")
SQL["compare_datasets"] = f"select * from ({SQL['compare_datasets']}) r(kind, name)"
add("densify", lambda s, d: shown(cubes.orders_cube(s, d).densify("v"), stamp=True), f"with {ORDERS}, {TIMES}, {LAT}, {LON} select times.t, slat.y, slon.x, round(c.v + {NUDGE}, 6) as v from times cross join slat cross join slon left join cube c on c.t = times.t and c.y = slat.y and c.x = slon.x")
