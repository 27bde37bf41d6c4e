import gzip
import struct

import numpy as np
import pytest

from isobar.operators import compare
from isobar.plans.model import Axis, from_table, axis_from
from isobar.sources import dataset as D
from isobar.sources import timecodec
from isobar.sources.samples import open_sample
from isobar.streaming.windows import windowed_average

from .helpers import LAT, LON, TIME, array, dataset


def netcdf3(dims, variables, attrs=()):
    """Bytes of a netCDF-3 file; dims: (name, size or 0 for records, records); variables: (name, dims, attrs, array)."""
    num = lambda x: struct.pack(">I", x)
    pad = lambda b: b + bytes(-len(b) % 4)
    name = lambda s: num(len(s)) + pad(s.encode())

    def attributes(given):
        out = b"".join(name(k) + (num(2) + num(len(v)) + pad(v.encode()) if isinstance(v, str) else num(6) + num(1) + struct.pack(">d", v)) for k, v in dict(given).items())
        return num(12) + num(len(dict(given))) + out if given else bytes(8)

    sizes, records = {n: s for n, s, *_ in dims}, max([r for _, s, *r_ in dims for r in r_ if s == 0], default=0)
    order = [n for n, *_ in dims]
    kind = {"f": (5, ">f4"), "d": (6, ">f8"), "h": (3, ">i2")}

    def head(begins):
        out = b"CDF\x01" + num(records) + num(10) + num(len(dims)) + b"".join(name(n) + num(s) for n, s, *_ in dims) + attributes(attrs) + num(11) + num(len(variables))
        for (n, ds, at, x), b in zip(variables, begins):
            code, k = kind[x.dtype.char]
            per = x[0].size if ds and sizes[ds[0]] == 0 else x.size
            out += name(n) + num(len(ds)) + b"".join(num(order.index(d)) for d in ds) + attributes(at) + num(code) + num(-(-per * np.dtype(k).itemsize // 4) * 4) + num(b)
        return out

    at = len(head([0] * len(variables)))
    fixed, rec, begins = b"", [], []
    for n, ds, _, x in variables:
        if not (ds and sizes[ds[0]] == 0):
            begins.append(at + len(fixed))
            fixed += pad(x.astype(kind[x.dtype.char][1]).tobytes())
        else:
            begins.append(None)
    at += len(fixed)
    lone = sum(b is None for b in begins) == 1
    offset = 0
    for k, (n, ds, _, x) in enumerate(variables):
        if begins[k] is None:
            begins[k] = at + offset
            each = [np.asarray(x[r], kind[x.dtype.char][1]).tobytes() for r in range(records)]
            rec.append(each if lone else [pad(e) for e in each])
            offset += len(rec[-1][0])
    return head(begins) + fixed + b"".join(r[k] for k in range(records) for r in rec)


def sample(start=0.0):
    y, x = np.array([-45.0, 45.0]), np.array([0.0, 120, 240])
    data = np.arange(12, dtype="f").reshape(2, 2, 3)
    data[0, 0, 1] = 1e20
    time = {"units": "days since 2000-01-01", "calendar": "noleap", "bounds": "time_bnds"}
    return netcdf3(
        [("time", 0, 2), ("lat", 2), ("lon", 3), ("bnds", 2)],
        [("time", ["time"], time, np.array([start, start + 59.0])), ("time_bnds", ["time", "bnds"], {}, np.array([[start, start + 1], [start + 59, start + 60]])), ("lat", ["lat"], {"units": "degrees_north"}, y), ("lon", ["lon"], {"axis": "X"}, x), ("ts", ["time", "lat", "lon"], {"_FillValue": 1e20}, data)],
        {"title": "sample"},
    )


def test_netcdf3(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(sample())
    ds = D.open_dataset(spark, str(tmp_path / "a.nc"), "ts", lon_orient=(-180, 180))
    want = np.arange(12.0).reshape(2, 2, 3)
    want[0, 0, 1] = np.nan
    assert array(ds) == pytest.approx(want[:, :, [2, 0, 1]], nan_ok=True)
    p = ds.axes["time"].parts()
    assert list(zip(p["month"], p["day"])) == [(1, 1), (3, 1)] and ds.axes["time"].calendar == "noleap"
    assert ds.axes["lat"].lo.tolist() == [-90, 0] and ds.axes["lon"].values.tolist() == [-120, 0, 120] and ds.attrs["title"] == "sample"
    (tmp_path / "b.nc.gz").write_bytes(gzip.compress(sample()))
    assert array(D.open_dataset(spark, str(tmp_path / "b.nc.gz"))) == pytest.approx(want, nan_ok=True)
    (tmp_path / "c.nc").write_bytes(b"CDF\x09")
    with pytest.raises(ValueError):
        D.open_dataset(spark, str(tmp_path / "c.nc"))


def test_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.nc").write_bytes(sample(365.0 * k))
    ds = D.open_mfdataset(spark, str(tmp_path), "ts")
    assert len(ds.axes["time"]) == 6 and array(ds).shape == (6, 2, 3)
    assert np.array_equal(array(ds)[2:4], array(ds)[:2], equal_nan=True)
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError):
        D.open_mfdataset(spark, str(empty))


def test_parquet_round_trip(spark, tmp_path):
    ds = dataset(spark, [TIME, LAT, LON], np.random.default_rng(1).random((15, 4, 4)))
    D.write_dataset(ds, str(tmp_path / "x"))
    back = D.open_dataset(spark, str(tmp_path / "x"), add_bounds=None)
    assert not any(compare.compare_datasets(ds, back).values())
    plan = D.open_dataset(spark, str(tmp_path / "x"), "ts").fact_of("ts")._jdf.queryExecution().toString()
    assert "ReadSchema" in plan


def pieces(spark):
    a = dataset(spark, [Axis("lat", [0.0, 10, 20]), Axis("lon", [0.0])], [[1], [2], [3]])
    b = dataset(spark, [Axis("lat", [10.0, 20, 30]), Axis("lon", [0.0])], [[2], [np.nan], [4]])
    return a, b


@pytest.mark.parametrize("join, want", [("outer", [1, 2, 3, 4]), ("inner", [2, 3]), ("left", [1, 2, 3]), ("right", [2, 3, 4])])
def test_joins(spark, join, want):
    assert array(D.combine([*pieces(spark)], join))[:, 0].tolist() == want


def test_join_and_conflict_errors(spark):
    a, b = pieces(spark)
    with pytest.raises(ValueError):
        D.combine([a, b], "exact")
    with pytest.raises(Exception, match="conflicting"):
        array(D.combine([a, b], "override"))
    assert array(D.combine([a, b], "override", "override"))[:, 0].tolist() == [1, 2, 3]
    with pytest.raises(Exception, match="conflicting"):
        array(D.combine([a, b], "outer", "equals"))
    for options in (("sideways",), ("outer", "maybe")):
        with pytest.raises(ValueError):
            D.combine([a, b], *options)


def test_single_variable(spark):
    ds = dataset(spark, [LAT, LON], np.ones((4, 4)))
    assert D.keep_single_var(ds, "ts").variables == {"ts": ("lat", "lon")}
    with pytest.raises(ValueError):
        D.keep_single_var(ds, "tas")


def test_decoding(spark):
    ds = dataset(spark, [Axis("time", [0, 1, 13], attrs={"units": "months since 2000-01-31"})], [1, 2, 3])
    p = timecodec.decode_time(ds).axes["time"].parts()
    assert list(zip(p["year"], p["month"], p["day"])) == [(2000, 1, 31), (2000, 2, 29), (2001, 2, 28)]
    a = timecodec.decode_time(ds).axes["time"]
    assert timecodec.decode_axis(timecodec.encode_axis(a)).values.tolist() == a.values.tolist()
    plain = dataset(spark, [Axis("time", [0, 1], attrs={"units": "months"})], [1, 2])
    assert not timecodec.decode_time(plain).axes["time"].decoded
    with pytest.raises(KeyError):
        timecodec.decode_time(dataset(spark, [LAT], np.ones(4)))


def test_compare(spark):
    a = dataset(spark, [LAT, LON], np.ones((4, 4)))
    b = dataset(spark, [LAT.with_(attrs={}), LON], np.eye(4))
    b = b.with_(axes={**b.axes, "lev": Axis("lev", [1.0])})
    out = compare.compare_datasets(a, b)
    assert out["unique_coords"] == ["lev"] and out["nonidentical_coords"] == ["lat"] and out["nonequal_coords"] == [] and out["nonequal_data_vars"] == ["ts"]
    assert compare.str_to_bool("True") and not compare.str_to_bool("False")
    with pytest.raises(ValueError):
        compare.str_to_bool("yes")


def test_from_table(spark):
    df = spark.createDataFrame([(10.0, 5.0, 1.0), (20.0, 5.0, 2.0), (10.0, 6.0, float("nan"))], "lat double, lon double, ts double")
    ds = from_table(df, [axis_from(df, "lat"), axis_from(df, "lon")], ["ts"])
    assert array(ds) == pytest.approx(np.array([[1, np.nan], [2, np.nan]]), nan_ok=True)
    assert ds.densify("ts").fact.count() == 4 and ds.table("ts").count() == 3


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", 1, 2.0), ("2024-01-01 05:00:00", 1, 4.0), ("2024-01-02 05:00:00", 1, None)]
    df = spark.createDataFrame(rows, "ts string, cell int, v double")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    query = windowed_average(stream, "ts", "v", ("cell",)).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.start.day, r.cell, r.v, r.n) for r in spark.table("win").collect())
    assert got == [(1, 1, 3.0, 2), (2, 1, None, 0)] == sorted((r.start.day, r.cell, r.v, r.n) for r in windowed_average(df, "ts", "v", ("cell",)).collect())


def test_samples(spark):
    ds = open_sample(spark, "levels")
    assert ds.variables["ts"] == ("time", "lev", "lat", "lon") and ds.fact.count() == 12 * 10 * 36 * 72 and ds.axes["time"].has_bounds()
    with pytest.raises(ValueError):
        open_sample(spark, "none")


def test_no_time_zone_has_a_say(spark):
    """An hour that New York leaves out in spring, and summer's offset."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([("2024-03-10 02:30:00.25", 1.0), ("2024-07-01 00:00:00", 2.0)], "t string, v double").selectExpr("cast(t as timestamp_ntz) as t", "v")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        a = axis_from(df, "t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert a.values.tolist() == [np.datetime64(x, "us").astype(int) for x in ("2024-03-10T02:30:00.25", "2024-07-01")]
