import numpy as np
import pytest

from isobar.functions import calendars as C
from isobar.operators import bounds as B
from isobar.operators import temporal as T
from isobar.plans.model import Axis

from .helpers import LAT, LON, TIME, array, dataset, labels, month, time_axis

SIX = [(2000, 1, 16, 12), (2000, 3, 16, 12), (2000, 6, 16), (2000, 9, 16), (2001, 2, 15, 12)]
F6 = time_axis(SIX, [month(p[0], p[1]) for p in SIX])
QUARTERS = {"custom_seasons": [["Jan", "Feb", "Mar"], ["Apr", "May", "Jun"], ["Jul", "Aug", "Sep"], ["Oct", "Nov", "Dec"]]}


def f6(spark, data=(2, 1, 1, 1, 2)):
    return dataset(spark, [F6], data)


def values(ds):
    return array(ds).tolist()


def test_average_with_a_reversed_bound_and_a_gap(spark):
    points = [(2000, 1, 1), (2000, 2, 1), (2000, 3, 1), (2000, 4, 1), (2001, 2, 1)]
    bounds = [month(2000, m) for m in (1, 2, 3, 4)] + [((2001, 1, 1), (2000, 3, 1))]
    ds = dataset(spark, [time_axis(points, bounds)], [2, np.nan, 1, 1, 1])
    assert array(T.average(ds, "ts")) == pytest.approx(1.24362357, abs=1e-8)
    assert array(T.average(ds, "ts", weighted=False)) == pytest.approx(1.25)


def test_custom_seasons(spark):
    out = T.group_average(f6(spark), "ts", "season", season_config=QUARTERS)
    assert dict(zip(labels(out), values(out))) == pytest.approx({(2000, 2): 1.5, (2000, 5): 1, (2000, 8): 1, (2001, 2): 2})
    months = [(2000, 11), (2000, 12), (2001, 1), (2001, 2), (2001, 3)]
    time = time_axis([(*m, 16) for m in months], [month(p[0], p[1]) for p in SIX])
    out = T.group_average(dataset(spark, [time], [2, 1, 1, 1, 2]), "ts", "season", season_config={"custom_seasons": [["Nov", "Dec", "Jan", "Feb", "Mar"]]})
    assert labels(out) == [(2001, 1)] and values(out) == pytest.approx([1.3933333], abs=1e-6)


def test_year_weights():
    p = T.Points.of(TIME)
    group, _ = T.labels_of(p, "group_average", "year", T.Seasons())
    w = T.group_weights(p.lengths(), group)
    assert w[:4] == pytest.approx([0.08469945, 0.07923497, 0.08469945, 0.08196721], abs=1e-8)
    assert w[12:] == pytest.approx([0.34444444, 0.31111111, 0.34444444], abs=1e-8)


def test_weights_sum_to_one_in_each_group():
    for freq in ("year", "season", "month"):
        p = T.prepare(T.Points.of(TIME), "group_average", freq, T.Seasons())
        group, _ = T.labels_of(p, "group_average", freq, T.Seasons())
        assert np.bincount(group, T.group_weights(p.lengths(), group)) == pytest.approx(1)


def test_season_departures_shift_december_twice(spark):
    points = [(1999, 12, 16), (2000, 1, 16, 12), (2000, 2, 15, 12), (2000, 3, 16, 12), (2000, 6, 16)]
    ds = dataset(spark, [time_axis(points, [month(p[0], p[1]) for p in points])], [2, 1, 1, 1, 1])
    out = T.departures(ds, "ts", "season")
    assert dict(zip(labels(out), values(out))) == pytest.approx({(2000, 1): -0.340659, (2000, 4): 0, (2000, 7): 0, (2001, 1): 0.659341}, abs=1e-6)
    once = T.departures(ds, "ts", "season", december_shift="once")
    assert labels(once) == [(2000, 1), (2000, 4), (2000, 7)]


def test_departures_with_reference_period(spark):
    period = ("2000-01-01", "2000-06-01")
    out = T.departures(f6(spark), "ts", "season", reference_period=period)
    got = values(out)
    assert len(got) == 5 and got[:2] == pytest.approx([0, 0]) and np.isnan(got[2]) and np.isnan(got[3]) and got[4] == pytest.approx(0)
    time = time_axis(SIX, [month(p[0], p[1]) for p in SIX])
    out = T.departures(dataset(spark, [time], [2, 1, 1, 1, 2]), "ts", "month", reference_period=period)
    assert np.isnan(array(out)[2:]).all() and array(out)[:2] == pytest.approx([0, 0])


def test_day_departures_drop_leap_days(spark):
    points = [(2000, 2, 28, 12), (2000, 2, 29, 12), (2000, 3, 1, 12), (2001, 2, 28, 12), (2001, 3, 1, 12)]
    ds = dataset(spark, [time_axis(points, [((*p[:3],), (p[0], p[1], p[2], 24)) for p in points])], [2, 9, 1, 2, 1])
    out = T.departures(ds, "ts", "day")
    assert values(out) == pytest.approx([0, 0, 0, 0])


@pytest.mark.parametrize("least, want", [(0.0, [1.5, 1.0]), (0.5, [1.5, np.nan]), (1.0, [1.5, np.nan])])
def test_min_weight(spark, least, want):
    time = time_axis([(2000, 1, 16), (2000, 3, 16), (2001, 1, 16), (2001, 2, 16)], [month(2000, 1), month(2000, 3), month(2001, 1), month(2001, 2)])
    out = T.group_average(dataset(spark, [time], [2, 1, np.nan, 1]), "ts", "year", min_weight=least)
    assert array(out) == pytest.approx(want, nan_ok=True)


def test_absent_rows_count_as_missing(spark):
    ds = f6(spark)
    ds = ds.with_(fact=ds.fact.filter("time_idx <> 0"))
    assert np.isnan(array(T.group_average(ds, "ts", "year", skipna=False))[0])
    assert np.isnan(array(T.group_average(ds, "ts", "year", min_weight=0.9))[0])


def test_constant_field_stays(spark):
    ds = dataset(spark, [TIME, LAT, LON], np.ones((15, 4, 4)))
    for out in (T.average(ds, "ts"), T.group_average(ds, "ts", "season"), T.climatology(ds, "ts", "month")):
        assert np.nanmin(array(out)) == pytest.approx(1) and np.nanmax(array(out)) == pytest.approx(1)
    assert labels(T.climatology(ds, "ts", "season")) == [(1, 1), (1, 4), (1, 7), (1, 10)]
    incomplete = T.group_average(ds, "ts", "season", season_config={"drop_incomplete_seasons": True})
    assert labels(incomplete) == [(2000, 4), (2000, 7), (2000, 10), (2001, 1)]
    old = T.group_average(ds, "ts", "season", season_config={"drop_incomplete_djf": True})
    assert (2000, 1) not in labels(old)


def test_errors(spark):
    ds = f6(spark)
    with pytest.raises(ValueError):
        T.group_average(ds, "ts", "decade")
    with pytest.raises(ValueError):
        T.climatology(ds, "ts", "hour")
    with pytest.raises(ValueError):
        T.group_average(ds, "ts", "season", season_config={"dec_mode": "DJ"})
    with pytest.raises(KeyError):
        T.group_average(ds, "ts", "season", season_config={"nothing": 1})
    with pytest.raises(ValueError):
        T.group_average(ds, "ts", "season", season_config={"custom_seasons": [["Jan", "Fab"]]})
    with pytest.raises(ValueError):
        T.group_average(ds, "ts", "season", season_config={"custom_seasons": [["Jan"], ["Jan"]]})
    with pytest.raises(RuntimeError):
        T.group_average(ds, "ts", "season", season_config={"drop_incomplete_seasons": True})
    with pytest.raises(ValueError):
        T.climatology(ds, "ts", "month", reference_period=("2000-01", "2001"))
    with pytest.raises(ValueError):
        T.group_average(ds, "ts", "year", min_weight=2)
    with pytest.raises(KeyError):
        T.group_average(ds, "none", "year")
    with pytest.raises(ValueError):
        T.average(ds, "ts", weighted=False, keep_weights=True)
    with pytest.raises(TypeError):
        T.average(dataset(spark, [Axis("time", [0, 1])], [1, 2]), "ts")


@pytest.mark.parametrize("hours, freq", [(1, "hour"), (24, "day"), (24 * 30, "month"), (24 * 365, "year")])
def test_infer_freq(hours, freq):
    assert B.infer_freq(Axis("time", np.arange(4) * hours * 3_600_000_000, calendar="standard")) == freq


@pytest.mark.parametrize("calendar", ["standard", "noleap", "360_day", "all_leap", "julian", "proleptic_gregorian"])
def test_calendars_round_trip(spark, calendar):
    days = np.arange(-200_000, 200_000, 7)
    assert (C.days_of(*C.date_of(days, calendar), calendar) == days).all()
    points = [(2001, m, 15) for m in range(1, 13)]
    time = B.time_bounds(time_axis(points, calendar=calendar), "month")
    lengths = (time.hi - time.lo) // C.DAY_US
    assert lengths.sum() == {"360_day": 360, "all_leap": 366}.get(calendar, 365)
    assert array(T.group_average(dataset(spark, [time], np.arange(12)), "ts", "year")) == pytest.approx([(lengths * np.arange(12)).sum() / lengths.sum()])

