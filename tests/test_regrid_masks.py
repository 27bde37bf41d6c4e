import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import grids as G
from isobar.operators import masks as M
from isobar.operators import regrid as R
from isobar.plans.model import Axis, GridDataset

from .helpers import LAT, LON, TIME, array, dataset


def cells(name, start, stop, step):
    edges = np.arange(start, stop + step / 2, step)
    lo, hi = edges[:-1], edges[1:]
    return Axis(name, (lo + hi) / 2, lo, hi)


COARSE_Y, FINE_Y = cells("lat", -90, 90, 60), cells("lat", -90, 90, 45)
COARSE_X, FINE_X = cells("lon", -0.5, 359.5, 180), cells("lon", -0.5, 359.5, 90)


def test_latitude_map():
    to, source, w = R.latitude_links(COARSE_Y, FINE_Y)
    assert [source[to == k].tolist() for k in range(3)] == [[0, 1], [1, 2], [2, 3]]
    assert np.concatenate([w[to == k] for k in range(3)]) == pytest.approx([0.29289322, 0.20710678, 0.5, 0.5, 0.20710678, 0.29289322], abs=1e-8)


def test_longitude_map():
    to, source, w = R.longitude_links(COARSE_X, FINE_X)
    assert [source[to == k].tolist() for k in range(2)] == [[0, 1], [2, 3]] and w.tolist() == [90] * 4


def test_regrid2_missing_source(spark):
    data = np.ones((3, 2))
    data[1, 0] = np.nan
    ds = dataset(spark, [COARSE_Y, COARSE_X], data)
    grid = G.Grid(x=FINE_X, y=FINE_Y)
    want = np.ones((4, 4))
    want[1:3, :2] = np.nan
    for options in ({}, {"create_nan_mask": True}):
        assert array(R.regrid2(ds, "ts", grid, **options)) == pytest.approx(want, nan_ok=True)
    back = R.horizontal(dataset(spark, [FINE_Y, FINE_X], np.ones((4, 4))), "ts", G.Grid(x=COARSE_X, y=COARSE_Y), tool="regrid2")
    assert array(back) == pytest.approx(np.ones((3, 2)))


def test_regrid2_unmapped(spark):
    src = cells("lat", 0, 90, 45)
    ds = dataset(spark, [src, COARSE_X], np.ones((2, 2)))
    out = R.regrid2(ds, "ts", G.Grid(x=COARSE_X, y=cells("lat", -90, 90, 45)), unmapped_to_nan=False)
    assert array(out) == pytest.approx(np.array([[0, 0], [0, 0], [1, 1], [1, 1]]))


def test_conservative_keeps_the_global_mean(spark):
    rng = np.random.default_rng(1)
    data = rng.random((4, 4))
    ds = dataset(spark, [FINE_Y, FINE_X], data)
    area = lambda y, x: (R.sine(y.hi) - R.sine(y.lo))[:, None] * (x.hi - x.lo)
    want = (data * area(FINE_Y, FINE_X)).sum()
    for options in (dict(method="conservative"), dict(method="conservative_normed"), dict(tool="regrid2", dtype="double")):
        out = array(R.horizontal(ds, "ts", G.Grid(x=COARSE_X, y=COARSE_Y), **options))
        assert (out * area(COARSE_Y, COARSE_X)).sum() == pytest.approx(want)


@pytest.mark.parametrize("method", R.METHODS)
def test_methods_on_their_own_grid(spark, method):
    data = np.arange(16.0).reshape(4, 4)
    out = R.horizontal(dataset(spark, [FINE_Y, FINE_X], data), "ts", G.Grid(x=FINE_X, y=FINE_Y), method=method)
    assert array(out) == pytest.approx(data)


def test_linear_and_quadratic_fields(spark):
    y, x = Axis("lat", np.arange(-80, 81, 20.0)), Axis("lon", np.arange(0, 360, 30.0))
    grid = G.Grid(x=Axis("lon", [7.0, 100]), y=Axis("lat", [-33.0, 70, 85]))
    field = lambda a, b: a[:, None] * 2 + b[None, :]
    ds = dataset(spark, [y, x], field(y.values, x.values))
    out = array(R.horizontal(ds, "ts", grid, method="bilinear"))
    assert out[:2] == pytest.approx(field(grid.y.values[:2], grid.x.values)) and np.isnan(out[2]).all()
    square = dataset(spark, [y, x], np.add.outer(y.values**2, x.values**2))
    assert array(R.horizontal(square, "ts", grid, method="patch"))[:2] == pytest.approx(np.add.outer(grid.y.values[:2] ** 2, grid.x.values**2))
    for extra in ("inverse_dist", "nearest_s2d"):
        assert not np.isnan(array(R.horizontal(ds, "ts", grid, method="bilinear", extrap_method=extra))).any()
    periodic = G.Grid(x=Axis("lon", [345.0]), y=Axis("lat", [0.0]))
    assert array(R.horizontal(ds, "ts", periodic, method="bilinear", periodic=True)) == pytest.approx(165)


def test_options_and_errors(spark):
    ds = dataset(spark, [FINE_Y, FINE_X], np.ones((4, 4)))
    grid = G.Grid(x=FINE_X, y=FINE_Y)
    for options in (dict(tool="none"), dict(method="cubic"), dict(method="bilinear", extrap_method="far")):
        with pytest.raises(ValueError):
            R.horizontal(ds, "ts", grid, **options)
    with pytest.raises(KeyError):
        R.regrid2(dataset(spark, [FINE_Y.with_(lo=None, hi=None), FINE_X], np.ones((4, 4))), "ts", grid)


def test_curvilinear_nearest(spark):
    rows = [(t, float(i * 10 + j), float(j * 20 + i), float(t * 100 + i * 4 + j)) for t in range(2) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "time_idx int, lat double, lon double, ts double")
    out = R.curvilinear_nearest(df, spark, G.Grid(x=Axis("lon", [21.0]), y=Axis("lat", [11.0])), "ts", ("time_idx",))
    assert sorted(map(tuple, out.collect())) == [(0, 0, 0, 5.0), (1, 0, 0, 105.0)]


Z = Axis("lev", [8000.0, 6000, 4000, 2000], [9000, 7000, 5000, 3000], [7000, 5000, 3000, 1000], {"axis": "Z"})


def test_vertical(spark):
    ds = dataset(spark, [LAT, Z], np.tile([8.0, 6, 4, 2], (4, 1)))
    to = G.Grid(z=Axis("lev", [9000.0, 8000, 5000, 2500, 2000], attrs={"axis": "Z"}))
    assert array(R.vertical(ds, "ts", to))[0] == pytest.approx([np.nan, 8, 5, 2.5, 2], nan_ok=True)
    logs = dataset(spark, [LAT, Z], np.tile(np.log(Z.values), (4, 1)))
    assert array(R.vertical(logs, "ts", to, method="log"))[0] == pytest.approx([np.nan, *np.log([8000, 5000, 2500, 2000])], nan_ok=True)
    wide = G.Grid(z=Axis("lev", [7000.0, 3000], [9000, 5000], [5000, 1000], {"axis": "Z"}))
    assert array(R.vertical(ds, "ts", wide, method="conservative"))[0] == pytest.approx([14, 6])
    with pytest.raises(ValueError):
        R.vertical(ds, "ts", to, method="cubic")


def test_vertical_by_other_levels(spark):
    ds = dataset(spark, [LAT, Z], np.tile([8.0, 6, 4, 2], (4, 1)))
    ds = ds.with_(fact=ds.fact.withColumn("theta", F.col("ts") * 10 + F.col("lat_idx")), variables={**ds.variables, "theta": ds.variables["ts"]})
    to = G.Grid(z=Axis("lev", [80.0, 50, 20], attrs={"axis": "Z"}))
    assert array(R.vertical(ds, "ts", to, target_data="theta")) == pytest.approx(np.array([[8, 5, 2], [7.9, 4.9, np.nan], [7.8, 4.8, np.nan], [7.7, 4.7, np.nan]]), nan_ok=True)
    surface = dataset(spark, [LAT], [1000.0, 900, 800, 700], "ps")
    rows = R.hybrid_levels(GridDataset(surface.fact, {**surface.axes, "lev": Z}, surface.variables), "ps", [0.1, 0.2, 0.3, 0.0], [0, 0.5, 0.7, 1], 100.0, "lev", "p").collect()
    assert {(r.lat_idx, r.lev_idx): r.p for r in rows}[1, 2] == pytest.approx(30 + 630)


def test_grid_sizes():
    for n in (32, 33, 128):
        g = G.create_gaussian_grid(n)
        assert (len(g.y), len(g.x)) == (n, 2 * n + 1) and g.y.values[0] > g.y.values[-1]
        assert g.y.lo[0] == 90 and g.y.hi[-1] == -90 and np.allclose(g.y.lo, -g.y.hi[::-1])
        w = np.sin(np.radians(g.y.lo)) - np.sin(np.radians(g.y.hi))
        assert w == pytest.approx(np.polynomial.legendre.leggauss(n)[1], abs=1e-9)
    g = G.create_uniform_grid(-90, 90, 4.0, 0, 360, 5.0)
    assert (len(g.y), len(g.x)) == (46, 73)


def test_mean_and_zonal_grids():
    g = G.create_grid(x=G.create_axis("lon", np.arange(0, 361, 45.0)), y=G.create_axis("lat", np.arange(-80, 81, 40.0), bounds=np.c_[[-90, -60, -20, 20, 60], [-60, -20, 20, 60, 90]]))
    mean = G.global_mean_grid(g)
    assert (mean.y.values[0], mean.y.lo[0], mean.y.hi[0]) == (0, -90, 90) and (mean.x.values[0], mean.x.lo[0], mean.x.hi[0]) == (180, -22.5, 382.5)
    assert len(G.zonal_grid(g).x) == 1 and G.zonal_grid(g).y is g.y
    with pytest.raises(ValueError):
        G.create_grid()
    with pytest.raises(ValueError):
        G.create_grid(x=(g.x, None, None))
    with pytest.raises(KeyError):
        G.Grid(x=g.x).axis("Y")


def test_pcmdi_mask(spark):
    source = dataset(spark, [LAT, LON], [[0.1, 0.1, 0.9, 0.2], [0.1, 0.9, 0.9, 0.1], [0.0, 0.1, 0.9, 0.9], [0.1, 0.1, 0.9, 0.1]], "land")
    assert M.pcmdi_mask(source, "land", G.Grid(x=LON, y=LAT)).tolist() == [[0, 0, 1, 0], [0, 1, 1, 0], [0, 0, 1, 1], [0, 0, 1, 0]]


def test_masks_apply(spark):
    ds = dataset(spark, [TIME, LAT, LON], np.ones((15, 4, 4)))
    mask = R.ones_mask(ds).withColumn("mask", F.when(F.col("lat_idx") < 2, 1.0).otherwise(0.1))
    land, sea = M.mask_sea(ds, "ts", mask), M.mask_land(ds, "ts", mask)
    assert np.isnan(array(land)[:, 2:]).all() and not np.isnan(array(land)[:, :2]).any()
    assert np.isnan(array(sea)[:, :2]).all() and not np.isnan(array(sea)[:, 2:]).any()
    assert np.isnan(array(M.mask_land(ds, "ts", mask, 0.05))).all() and not np.isnan(array(M.mask_land(ds, "ts", mask, 0.0))[:, 2:]).any()
    for bad in (dict(method="other"), dict(method="polygon"), dict(method="pcmdi"), dict(method="pcmdi", source=ds)):
        with pytest.raises(ValueError):
            M.generate_mask(ds, "ts", **bad)


def test_polygon(spark):
    ds = dataset(spark, [cells("lat", -90, 90, 60), cells("lon", 0, 360, 90)], np.ones((3, 4)))
    square = [np.array([[100.0, -40], [170, -40], [170, 40], [100, 40]])]
    got = {(r.lat_idx, r.lon_idx) for r in M.polygon_mask(ds, "ts", square).collect() if r["mask"]}
    assert got == {(1, 1)}


@pytest.mark.parametrize("method", R.METHODS)
def test_weights_apply_as_the_method(spark, method):
    data = np.arange(6.0).reshape(3, 2)
    ds = dataset(spark, [COARSE_Y, COARSE_X], data)
    grid = G.Grid(x=FINE_X, y=FINE_Y)
    out = np.zeros((4, 4))
    total = np.zeros((4, 4))
    for r in R.method_weights(ds, "ts", grid, method).collect():
        out[r.y_out, r.x_out] += r.weight * data[r.y_in, r.x_in]
        total[r.y_out, r.x_out] += r.weight
    if method == "conservative_normed":
        out = out / total
    out[total == 0] = np.nan
    assert array(R.horizontal(ds, "ts", grid, method=method)) == pytest.approx(out, nan_ok=True)


def test_positions():
    assert R.grid_position(Z) == "center"
    assert R.grid_position(Z.with_(values=Z.lo)) == "left" and R.grid_position(Z.with_(values=Z.hi)) == "right"
    with pytest.raises(RuntimeError):
        R.grid_position(Z.with_(values=Z.values + 10))
