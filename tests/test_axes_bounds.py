import numpy as np
import pytest

from isobar.operators import axes as A
from isobar.operators import bounds as B
from isobar.plans.model import Axis

from .helpers import LAT, LON, TIME, array, dataset, time_axis


def test_swap_with_prime_meridian_cell(spark):
    lon = Axis("lon", [-180, -1, 0, 1, 179], [-180.5, -1.5, -0.5, 0.5, 1.5], [-1.5, -0.5, 0.5, 1.5, 179.5], {"axis": "X"})
    out = A.swap_lon_axis(dataset(spark, [lon], range(5)), (0, 360))
    a = out.axes["lon"]
    assert a.values.tolist() == [0, 1, 179, 180, 359, 360] and array(out).tolist() == [2, 3, 4, 0, 1, 2]
    assert a.lo.tolist() == [0, 0.5, 1.5, 179.5, 358.5, 359.5] and a.hi.tolist() == [0.5, 1.5, 179.5, 358.5, 359.5, 360]


def test_swap_there_and_back(spark):
    lon = Axis("lon", [22.5, 112.5, 202.5, 292.5], [0, 90, 180, 270], [90, 180, 270, 360], {"axis": "X"})
    ds = dataset(spark, [lon], range(4))
    there = A.swap_lon_axis(ds, (-180, 180))
    assert there.axes["lon"].values.tolist() == [-157.5, -67.5, 22.5, 112.5] and array(there).tolist() == [2, 3, 0, 1]
    assert array(A.swap_lon_axis(there, (0, 360))).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        A.swap_lon_axis(ds, (0, 180))


def test_two_cells_across_the_meridian(spark):
    lon = Axis("lon", [0, 90], [5, 100], [3, 80], {"axis": "X"})
    with pytest.raises(ValueError):
        A.swap_lon_axis(dataset(spark, [lon], [1, 2]), (0, 360))


def test_lookups(spark):
    ds = dataset(spark, [TIME, LAT, LON], np.ones((15, 4, 4)))
    assert A.get_dim_keys(ds, "X") == "lon" and A.get_coords_by_name(ds, "Y").name == "lat"
    two = ds.with_(axes={**ds.axes, "lat2": LAT.with_(name="lat2")})
    assert A.get_dim_keys(two, "Y") == ["lat", "lat2"]
    for bad, error in (("Z", KeyError), ("Q", ValueError)):
        with pytest.raises(error):
            A.get_dim_coords(ds, bad)
    assert B.bounds_keys(ds) == ["lat_bnds", "lon_bnds", "time_bnds"] and set(B.bounds_map(ds)) == {"T", "X", "Y", "lat", "lon", "time"}
    with pytest.raises(KeyError):
        B.get_bounds(ds.with_axis(LAT.with_(lo=None, hi=None)), "Y")


def test_midpoints():
    a = B.create_bounds("Y", LAT.with_(lo=None, hi=None))
    assert a.lo.tolist() == [-90, -89.375, 0, 89.375] and a.hi.tolist() == [-89.375, 0, 89.375, 90]
    with pytest.raises(ValueError):
        B.create_bounds("X", Axis("lon", [1.0]))
    with pytest.raises(ValueError):
        B.create_bounds("Y", Axis("lat", [1.0, 2], attrs={"units": "m"}))


def test_time_bounds():
    t = time_axis([(2000, 1, 31, 23), (2000, 3, 1, 1), (2000, 12, 5)])
    parts = lambda a: [tuple(int(v[k]) for v in list(a.with_(values=x).parts().values())[:4]) for x in (a.lo, a.hi) for k in range(3)]
    assert parts(B.time_bounds(t, "month", end_of_month=True)) == [(2000, 1, 1, 0), (2000, 2, 1, 0), (2000, 12, 1, 0), (2000, 2, 1, 0), (2000, 3, 1, 0), (2001, 1, 1, 0)]
    assert parts(B.time_bounds(t, "hour", 4))[:3] == [(2000, 1, 31, 18), (2000, 3, 1, 0), (2000, 12, 5, 0)]
    assert parts(B.time_bounds(t, "year"))[3:] == [(2001, 1, 1, 0)] * 3
    for bad in (dict(freq="hour", daily_subfreq=5), dict(freq="week")):
        with pytest.raises(ValueError):
            B.time_bounds(t, **bad)


def test_missing_bounds_and_centres(spark):
    ds = dataset(spark, [TIME.with_(lo=None, hi=None), LAT.with_(lo=None, hi=None), LON], np.ones((15, 4, 4)))
    out = B.add_missing_bounds(ds)
    assert out.axes["time"].lo.tolist() == TIME.lo.tolist() and out.axes["lat"].has_bounds() and out.axes["lon"] is LON
    assert A.center_times(out).axes["time"].values.tolist() == ((TIME.lo + TIME.hi) // 2).tolist()
    single = dataset(spark, [Axis("lon", [3.0], attrs={"axis": "X"})], [1])
    assert not B.add_missing_bounds(single, ("X",)).axes["lon"].has_bounds()
    with pytest.raises(ValueError):
        B.add_time_bounds(ds, "guess")
