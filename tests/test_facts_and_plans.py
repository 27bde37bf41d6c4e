"""Datasets of several facts, files with all their variables, options of regridding, and what plans shuffle."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import axes as A
from isobar.operators import bounds as B
from isobar.operators import compare
from isobar.operators import grids as G
from isobar.operators import masks as M
from isobar.operators import regrid as R
from isobar.operators import temporal as T
from isobar.plans import model
from isobar.plans.model import Axis, axis_frame
from isobar.sources import dataset as D
from isobar.sources import netcdf3

from .helpers import LAT, LON, TIME, array, dataset, month, time_axis
from .test_sources import netcdf3 as file_of

Z = Axis("lev", [8000.0, 6000, 4000, 2000], [9000, 7000, 5000, 3000], [7000, 5000, 3000, 1000], {"axis": "Z"})


def exchanges(df):
    """Shuffles of a plan, those of AQE's final plan once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range|RoundRobin)", plan.split("Initial Plan")[0]))


def two_facts(spark):
    ds = dataset(spark, [TIME, LAT, LON], np.random.default_rng(1).random((15, 4, 4)))
    land = dataset(spark, [LAT, LON], np.eye(4), "land")
    return ds.with_frame(land.fact, land.variables)


def test_variables_on_other_axes(spark, tmp_path):
    ds = two_facts(spark)
    assert array(ds, "land").tolist() == np.eye(4).tolist() and array(ds).shape == (15, 4, 4)
    D.write_dataset(ds, str(tmp_path / "x"))
    back = D.open_dataset(spark, str(tmp_path / "x"), add_bounds=None)
    assert not any(compare.compare_datasets(ds, back).values())
    turned = A.swap_lon_axis(back, (-180, 180))
    assert array(turned, "land")[0].tolist() == [0, 0, 1, 0] and turned.axes["lon"].values.tolist() == [-3.75, -1.875, 0, 1.875]
    assert D.keep_single_var(back, "land").axes.keys() == {"lat", "lon"}
    parts = [ds, ds.with_axis(ds.axes["time"].with_(values=ds.axes["time"].values + 10**15))]
    whole = D.combine(parts)
    assert array(whole).shape == (30, 4, 4) and array(whole, "land").tolist() == np.eye(4).tolist()
    more = ds.with_frame(dataset(spark, [LAT, LON], np.ones((4, 4)), "sea").fact, {"sea": ("lat", "lon")})
    assert array(more, "sea").sum() == 16 and array(more, "land").sum() == 4


def test_files_with_all_variables(spark, tmp_path):
    y, x = np.array([-45.0, 45.0]), np.array([0.0, 120, 240])
    variables = [
        ("lat", ["lat"], {"units": "degrees_north"}, y), ("lon", ["lon"], {"axis": "X"}, x), ("ts", ["lat", "lon"], {"units": "K"}, np.arange(6, dtype="f").reshape(2, 3)),
        ("area", ["lat"], {}, np.array([1.0, 2.0])), ("level", ["ilev", "lat"], {}, np.arange(8.0).reshape(4, 2)), ("height", [], {}, np.array(2.0)),
    ]
    (tmp_path / "a.nc").write_bytes(file_of([("lat", 2), ("lon", 3), ("ilev", 4)], variables))
    ds = D.open_dataset(spark, str(tmp_path / "a.nc"), decode_times=False)
    assert ds.variables == {"ts": ("lat", "lon"), "area": ("lat",), "level": ("ilev", "lat")}
    assert array(ds).tolist() == [[0, 1, 2], [3, 4, 5]] and array(ds, "area").tolist() == [1, 2] and array(ds, "level")[3].tolist() == [6, 7]
    assert ds.attrs["scalars"] == {"height": 2.0} and ds.attrs["variables"]["ts"] == {"units": "K"} and "height" not in ds.axes


def test_long_headers(spark, tmp_path, monkeypatch):
    y = np.array([-45.0, 45.0])
    data = file_of([("lat", 2)], [("lat", ["lat"], {"axis": "Y", "note": "n" * (3 << 20)}, y), ("ts", ["lat"], {}, y)])
    (tmp_path / "a.nc").write_bytes(data)
    assert array(D.open_dataset(spark, str(tmp_path / "a.nc"), decode_times=False)).tolist() == [-45, 45]
    (tmp_path / "b.nc").write_bytes(data[:1000])
    with pytest.raises(ValueError):
        D.open_dataset(spark, str(tmp_path / "b.nc"))


def test_written_files(spark, tmp_path):
    data = np.random.default_rng(2).random((15, 4, 4))
    data[3, 1, 2] = np.nan
    ds = dataset(spark, [TIME, LAT, LON], data)
    ds = ds.with_(attrs={"title": "t", "variables": {"ts": {"units": "K"}}}, fact=ds.fact.filter("not (time_idx = 4 and lat_idx = 0)"))
    data[4, 0] = np.nan
    found = netcdf3.write_netcdf3(ds, str(tmp_path / "out"), 4)
    assert [r.name for r in sorted(found.collect())] == [f"{k:08d}.nc" for k in range(4)]
    back = D.open_mfdataset(spark, f"file://{tmp_path}/out", add_bounds=None)
    assert array(back) == pytest.approx(data, nan_ok=True)
    assert np.array_equal(back.axes["time"].values, TIME.values) and np.array_equal(back.axes["time"].lo, TIME.lo) and back.attrs["variables"]["ts"]["units"] == "K"


@pytest.mark.parametrize("join, want", [("left", [3, 2, 1]), ("right", [1, 3]), ("outer", [1, 2, 3]), ("inner", [1, 3])])
def test_joins_on_axes_of_any_order(spark, join, want):
    a = dataset(spark, [Axis("lat", [20.0, 10, 0]), Axis("lon", [0.0])], [[3], [2], [1]])
    b = dataset(spark, [Axis("lat", [0.0, 20]), Axis("lon", [0.0])], [[1], [3]])
    out = D.combine([a, b], join)
    assert array(out)[:, 0].tolist() == want and out.axes["lat"].values.tolist() == [10 * (v - 1) for v in want]


def test_attributes_that_differ(spark):
    a = dataset(spark, [LAT, LON], np.ones((4, 4)))
    b = a.with_(attrs={"variables": {"ts": {"units": "K"}}})
    out = compare.compare_datasets(a, b)
    assert out["nonidentical_data_vars"] == ["ts"] and out["nonequal_data_vars"] == []
    with pytest.raises(ValueError):
        D.combine([a, b], "outer", "identical")
    assert array(D.combine([a, b], "outer", "equals")).sum() == 16


def test_bounds_that_can_not_be(spark, caplog):
    ds = dataset(spark, [Axis("lat", [0.0, 1], attrs={"units": "m"}), Axis("lon", [0.0])], np.ones((2, 1)))
    ds = ds.with_(axes={**ds.axes, "time": time_axis([(2000, 1, 1, 0), (2000, 1, 1, 3, 24)])})
    out = B.add_missing_bounds(ds)
    assert not any(a.has_bounds() for a in out.axes.values()) and len(caplog.records) >= 3


def test_masks_in_one_call(spark, tmp_path):
    ds = dataset(spark, [TIME, LAT, LON], np.ones((15, 4, 4)))
    share = np.array([[0.1, 0.1, 0.9, 0.2], [0.1, 0.9, 0.9, 0.1], [0.0, 0.1, 0.9, 0.9], [0.1, 0.1, 0.9, 0.1]])
    D.write_dataset(dataset(spark, [LAT, LON], share, "land"), str(tmp_path / "land"))
    out = M.masked(ds, "ts", "pcmdi", "land", output_mask=True, source=str(tmp_path / "land"), source_var="land")
    want = np.array([[0, 0, 1, 0], [0, 1, 1, 0], [0, 0, 1, 1], [0, 0, 1, 0]])
    assert array(out, "ts_mask").tolist() == want.tolist() and (np.isnan(array(out)[0]) == (want == 0)).all()
    given = M.masked(ds, "ts", keep="sea", mask=R.ones_mask(ds), threshold=0.5)
    assert np.isnan(array(given)).all() and "ts_mask" not in given.variables
    with pytest.raises(ValueError):
        M.masked(ds, "ts", keep="ice")


def test_half_grid_and_neighbours():
    rows = M.half_operator(LAT, "Y")
    assert rows.sum(axis=1) == pytest.approx(np.ones(4)) and (rows >= 0).all()
    marks = np.zeros((4, 5), bool)
    marks[1, 0] = True
    assert np.argwhere(M.beside(marks, False)).tolist() == [[0, 0], [0, 1], [1, 1], [2, 0], [2, 1]]
    assert [2, 4] in np.argwhere(M.beside(marks, True)).tolist()


@pytest.mark.parametrize("periodic, given, want", [
    (False, None, {"padding": "fill"}), (True, None, {"padding": "periodic"}), (True, {"boundary": "extend"}, {"padding": "extend"}),
    (True, {"boundary": "fill", "padding": "extend"}, {"padding": "extend"}), (True, {"boundary": "fill", "fill_value": 1e27}, {"padding": "fill", "fill_value": 1e27}),
])
def test_padding(spark, periodic, given, want):
    copy = dict(given or {})
    assert R.padding_of(periodic, given) == want and (given or {}) == copy
    ds = dataset(spark, [Z], [8.0, 6, 4, 2])
    out = R.vertical(ds, "ts", G.Grid(z=Axis("lev", [5000.0], attrs={"axis": "Z"})), periodic=periodic, extra_init_options=given)
    assert want.items() <= out.attrs["regridding"]["ts"].items() and array(out).tolist() == [5]


def test_positions_in_cells(spark):
    to = G.Grid(z=Axis("lev", [5000.0], attrs={"axis": "Z"}))
    for values in (Z.lo, Z.hi, Z.values + 10):
        R.vertical(dataset(spark, [Z.with_(values=values)], [8.0, 6, 4, 2]), "ts", to)
    odd = dataset(spark, [Z.with_(values=Z.values + 3000)], [8.0, 6, 4, 2])
    with pytest.raises(RuntimeError):
        R.vertical(odd, "ts", to)
    assert R.vertical(odd, "ts", to, grid_positions={"left": "lev"}).axes["lev"].values.tolist() == [5000]
    with pytest.raises(ValueError):
        R.vertical(odd, "ts", to, grid_positions={"below": "lev"})
    with pytest.raises(RuntimeError):
        R.vertical(dataset(spark, [LAT], np.ones(4)), "ts", to)


def test_levels_by_formula(spark):
    ds = dataset(spark, [LAT, Z.with_(values=[0.0, 1, 2, 3], lo=None, hi=None)], np.tile([8.0, 6, 4, 2], (4, 1)))
    to = G.Grid(z=Axis("lev", [10 * np.exp(-0.5), 20.0], attrs={"axis": "Z"}))
    named = lambda **attrs: ds.with_axis(ds.axes["lev"].with_(attrs={"axis": "Z", **attrs}))
    for attrs, error in (
        ({}, RuntimeError), ({"formula_terms": ""}, RuntimeError), ({"formula_terms": "p0: p0 lev: lev", "standard_name": "none"}, NotImplementedError),
        ({"formula_terms": "p0: p0 lev: lev", "standard_name": "atmosphere_ln_pressure_coordinate"}, KeyError),
    ):
        with pytest.raises(error):
            R.vertical(named(**attrs), "ts", to, target_data="infer")
    whole = named(formula_terms="p0: p0 lev: lev", standard_name="atmosphere_ln_pressure_coordinate").with_(attrs={"scalars": {"p0": 10.0}})
    got = array(R.vertical(whole, "ts", to, method="log", target_data="infer"))
    assert got[:, 0] == pytest.approx([7] * 4) and np.isnan(got[:, 1]).all()
    with pytest.raises(RuntimeError):
        R.vertical(ds, "ts", to, target_data="pressure")


def test_levels_by_table_and_ends(spark):
    ds = dataset(spark, [LAT, Z], np.tile([8.0, 6, 4, 2], (4, 1)))
    to = G.Grid(z=Axis("lev", [100.0, 35, 20, 5], attrs={"axis": "Z"}))
    table = axis_frame(spark, "lev_idx", {"level": np.array([40.0, 30, 20, 10])})
    want = [np.nan, 7, 4, np.nan]
    assert array(R.vertical(ds, "ts", to, target_data=table))[2] == pytest.approx(want, nan_ok=True)
    ends = [8, 7, 4, 2]
    assert array(R.vertical(ds, "ts", to, target_data=table, mask_edges=False))[1] == pytest.approx(ends)
    up = axis_frame(spark, "lev_idx", {"level": np.array([10.0, 20, 30, 40])})
    assert array(R.vertical(ds, "ts", to, target_data=up, mask_edges=False))[1] == pytest.approx([2, 3, 6, 8])
    wide = G.Grid(z=Axis("lev", [7000.0, 1000], attrs={"axis": "Z"}))
    assert array(R.vertical(ds, "ts", wide, mask_edges=False))[0] == pytest.approx([7, 2])
    layers = G.Grid(z=Axis("lev", [35.0, 15], [45, 25], [25, 5], {"axis": "Z"}))
    assert array(R.vertical(ds, "ts", layers, method="conservative", target_data=table))[0] == pytest.approx([14, 6])
    with pytest.raises(ValueError):
        R.vertical(ds, "ts", to, target_data=table.withColumnRenamed("level", "x"))


def test_curvilinear_points_without_position(spark):
    rows = [(0, float(y), float(x), float(10 * y + x)) for y in range(0, 60, 20) for x in range(0, 60, 20)] + [(0, float("nan"), 1.0, -1.0), (0, None, None, -2.0)]
    df = spark.createDataFrame(rows, "time_idx int, lat double, lon double, ts double").repartition(3)
    out = R.curvilinear_nearest(df, spark, G.Grid(x=Axis("lon", [1.0, 30.0]), y=Axis("lat", [11.0])), "ts", ("time_idx",))
    assert sorted(map(tuple, out.collect())) == [(0, 0, 0, 200.0), (0, 0, 1, 220.0)]


class Doubling(R.Regridder):
    def horizontal(self, ds, var):
        return ds.with_(fact=ds.fact.withColumn(var, F.col(var) * self.options.get("by", 2)))

    def vertical(self, ds, var):
        return self.horizontal(ds, var)


def test_tools_weights_and_cells_of_no_width(spark):
    ds = dataset(spark, [LAT, LON], np.ones((4, 4)))
    grid = G.create_uniform_grid(-60, 60, 60, 0, 270, 90)
    assert array(R.horizontal(ds, "ts", grid, Doubling, by=3)).sum() == 48 and array(R.vertical(ds, "ts", grid, tool=Doubling)).sum() == 32
    for options in (dict(tool="regrid2"), dict(method="bilinear")):
        weights = R.horizontal(ds, "ts", grid, output_weights=True, **options).attrs["regrid_weights"]
        assert set(weights.columns) == {"y_out", "x_out", "y_in", "x_in", "weight"} and weights.count() > 0
    flat = ds.with_axis(LAT.with_(lo=LAT.hi))
    R.horizontal(flat, "ts", grid, method="bilinear")
    with pytest.raises(ValueError):
        R.horizontal(flat, "ts", grid, method="bilinear", ignore_degenerate=False)


@pytest.mark.parametrize("passes", [0, 8])
def test_one_pass_or_two(spark, monkeypatch, passes):
    monkeypatch.setattr(R, "ONE_PASS", passes)
    rng = np.random.default_rng(3)
    y, x = G.create_uniform_grid(-80, 80, 20, 0, 330, 30).y, G.create_uniform_grid(-80, 80, 20, 0, 330, 30).x
    data = rng.random((9, 12))
    data[2, 3] = np.nan
    ds = dataset(spark, [y, x], data)
    out = R.horizontal(ds, "ts", G.create_uniform_grid(-60, 60, 30, 0, 300, 60), tool="regrid2", dtype="double")
    assert exchanges(out.fact) == (2 if passes == 0 else 1)
    both = array(out)
    monkeypatch.setattr(R, "ONE_PASS", 8 - passes)
    assert both == pytest.approx(array(R.horizontal(ds, "ts", G.create_uniform_grid(-60, 60, 30, 0, 300, 60), tool="regrid2", dtype="double")), nan_ok=True)


def test_departures_shuffle_sums_alone(spark, monkeypatch):
    months = [(y, m) for y in (2000, 2001, 2002) for m in range(1, 13)]
    time = time_axis([(y, m, 15, 0) for y, m in months], [month(*x) for x in months])
    ds = dataset(spark, [time, LAT, LON], np.random.default_rng(1).random((36, 4, 4)))
    out = T.departures(ds, "ts", "month")
    assert exchanges(out.fact) == 1
    whole = array(out)
    monkeypatch.setattr(model, "BROADCAST_ROWS", 0)
    assert exchanges(T.departures(ds, "ts", "month").fact) > 1
    assert array(T.departures(ds, "ts", "month")) == pytest.approx(whole)


def test_files_apart_are_put_together_without_a_shuffle(spark):
    ds = dataset(spark, [TIME, LAT, LON], np.ones((15, 4, 4)))
    split = lambda a, b: ds.with_(fact=ds.fact.filter(f"time_idx >= {a} and time_idx < {b}").withColumn("time_idx", (F.col("time_idx") - a).cast("int"))).with_axis(TIME.take(slice(a, b)))
    assert exchanges(D.combine([split(0, 8), split(8, 15)]).fact) == 0
    some = D.combine([split(0, 9), split(8, 15)])
    assert exchanges(some.fact) == 1 and array(some).sum() == 240
    assert "time_idx" in some.fact._jdf.queryExecution().optimizedPlan().toString() and array(D.combine([split(0, 9), split(8, 15)], "inner")).shape == (1, 4, 4)


def test_long_axes_go_by_arrow(spark):
    n = model.ARROW_ROWS + 5
    df = axis_frame(spark, "i", {"x": np.arange(n) / 2, "k_idx": np.arange(n), "s": np.array(["a"] * n, dtype=object), "b": np.arange(n) % 2 == 0})
    assert dict(df.dtypes) == {"i": "int", "x": "double", "k_idx": "int", "s": "string", "b": "boolean"}
    r = df.filter(F.col("i") == n - 1).first()
    assert (r.x, r.k_idx, r.s, r.b) == ((n - 1) / 2, n - 1, "a", (n - 1) % 2 == 0)
