"""Queries of the time operators, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..operators import axes as A
from ..operators import bounds as B
from ..operators import temporal as T
from ..sources import timecodec
from . import cubes
from .model import Axis, GridDataset, axis_frame

QUERIES, SQL = {}, {}
US = "timestampadd(MICROSECOND, {}, timestamp_ntz'1970-01-01 00:00:00')"


#: Added before rounding, so that means of cents, which may end on a half, round alike in any order of sums.
NUDGE = 1.23e-7


def rounded(column: str, digits: int = 6):
    return F.round(F.col(column) + NUDGE, digits)


def shown(ds: GridDataset, parts: tuple[str, ...] = (), var: str = "v", digits: int = 6, stamp: bool = False) -> DataFrame:
    """The variable with indices as y and x, and its time as components or as a timestamp."""
    out = ds.fact_of(var)
    if "time" in ds.variables[var]:
        a = ds.axes["time"]
        columns = {"_us": a.values, **{k: v for k, v in a.parts().items() if k in parts}}
        out = out.join(F.broadcast(axis_frame(ds.spark, a.idx, columns)), a.idx)
    names = {"lat_idx": "y", "lon_idx": "x", "lev_idx": "z", "vec_idx": "vec"}
    keys = [F.col(k).alias(n) for k, n in names.items() if k in out.columns]
    time = [F.expr(US.format("_us")).alias("t")] if stamp else []
    return out.select(*time, *parts, *keys, rounded(var, digits).alias("v"))


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def cube_sql(table: str, time: str, key: str, value: str, unit: str, gaps: bool = False) -> str:
    cells = f"select date_trunc('{unit}', {time}) as t, cast({key} % 6 as integer) as y, cast(({key} // 6) % 8 as integer) as x, avg({value}) as v from {table} group by 1, 2, 3"
    if gaps:
        cells = f"select t, y, x, case when month(t) % 5 = 0 and (y + x) % 3 = 0 then null else v end as v from ({cells})"
    return f"cube as ({cells})"


ORDERS = cube_sql("orders", "o_orderdate", "o_custkey", "o_totalprice", "month")
GAPS = cube_sql("orders", "o_orderdate", "o_custkey", "o_totalprice", "month", True)
DAILY = cube_sql("lineitem", "l_shipdate", "l_suppkey", "l_extendedprice", "day")
EVENTS = cube_sql("events", "ts", "user_id", "value", "hour")
TIMES = "times as (select distinct t from cube)"
MONTH_LEN = "epoch_us(t + interval 1 month) - epoch_us(t)"
MEAN = "sum(w * v) / nullif(sum(case when v is not null then w end), 0)"


def grouped_sql(cube: str, points: str, keys: str, value: str = MEAN) -> str:
    """points: a query for t, len and the key columns of the time points that count."""
    keys_ = f"{keys}, " if keys else ""
    return f"""with {cube}, {TIMES}, pts as ({points}),
      g as (select *, len / sum(len) over ({f"partition by {keys}" if keys else ""}) as w, count(*) over ({f"partition by {keys}" if keys else ""}) as n from pts)
      select {keys_}y, x, round({value} + {NUDGE}, 6) as v from cube join g using (t) group by {keys_}y, x"""


YEAR = f"select t, {MONTH_LEN} as len, year(t) as year from times"
MONTH = f"select t, {MONTH_LEN} as len, year(t) as year, month(t) as month from times"
MIDDLE = "cast(case when month(t) in (12, 1, 2) then 1 when month(t) <= 5 then 4 when month(t) <= 8 then 7 else 10 end as bigint)"
DJF = f"select t, {MONTH_LEN} as len, cast(year(t) + (case when month(t) = 12 then 1 else 0 end) as bigint) as year, {MIDDLE} as month from times"
JFD = f"select t, {MONTH_LEN} as len, year(t) as year, {MIDDLE} as month from times"


def group(cube, freq, parts, **options):
    return lambda spark, sf_dir: shown(T.group_average(cube(spark, sf_dir), "v", freq, **options), parts)


def gaps(spark, sf_dir):
    return cubes.with_gaps(cubes.orders_cube(spark, sf_dir))


add("group_average_year", group(cubes.orders_cube, "year", ("year",)), grouped_sql(ORDERS, YEAR, "year"))
add("group_average_month", group(cubes.ship_cube, "month", ("year", "month")), grouped_sql(cube_sql("lineitem", "l_shipdate", "l_suppkey", "l_extendedprice", "month"), MONTH, "year, month"))
add("group_average_season_djf", group(cubes.orders_cube, "season", ("year", "month")), grouped_sql(ORDERS, DJF, "year, month"))
add("group_average_season_jfd", group(cubes.orders_cube, "season", ("year", "month"), season_config={"dec_mode": "JFD"}), grouped_sql(ORDERS, JFD, "year, month"))
add("group_average_unweighted", group(gaps, "year", ("year",), weighted=False), grouped_sql(GAPS, YEAR, "year", "avg(v)"))
add("group_average_day", group(cubes.events_cube, "day", ("year", "month", "day")), grouped_sql(EVENTS, "select t, 3600000000 as len, year(t) as year, month(t) as month, day(t) as day from times", "year, month, day"))
add("group_average_hour", group(cubes.events_cube, "hour", ("year", "month", "day", "hour")), grouped_sql(EVENTS, "select t, 3600000000 as len, year(t) as year, month(t) as month, day(t) as day, hour(t) as hour from times", "year, month, day, hour"))
QUARTERS = {"custom_seasons": [["Jan", "Feb", "Mar"], ["Apr", "May", "Jun"], ["Jul", "Aug", "Sep"], ["Oct", "Nov", "Dec"]]}
WINTER = {"custom_seasons": [["Nov", "Dec", "Jan", "Feb", "Mar"]]}
add("group_average_custom_season", group(cubes.orders_cube, "season", ("year", "month"), season_config=QUARTERS), grouped_sql(ORDERS, f"select t, {MONTH_LEN} as len, year(t) as year, cast(((month(t) - 1) // 3) * 3 + 2 as bigint) as month from times", "year, month"))
add("group_average_custom_span", group(cubes.orders_cube, "season", ("year", "month"), season_config=WINTER), grouped_sql(ORDERS, f"select t, {MONTH_LEN} as len, cast(year(t) + (case when month(t) >= 11 then 1 else 0 end) as bigint) as year, cast(1 as bigint) as month from times where month(t) in (11, 12, 1, 2, 3)", "year, month"))
add("group_average_drop_incomplete", group(cubes.orders_cube, "season", ("year", "month"), season_config={"drop_incomplete_seasons": True}), grouped_sql(ORDERS, f"select t, len, year, month from (select *, count(*) over (partition by year, month) as c from ({DJF})) where c = 3", "year, month"))
FIRST_DJF = "(case when month(t) = 12 then year(t) + 1 else year(t) end)"
add("group_average_drop_incomplete_djf", group(cubes.orders_cube, "season", ("year", "month"), season_config={"drop_incomplete_djf": True}), grouped_sql(ORDERS, f"select d.* from ({DJF}) d where not ((d.year = (select min_by({FIRST_DJF}, t) from times) and month(d.t) in (1, 2)) or (d.year = (select max_by({FIRST_DJF}, t) from times) and month(d.t) = 12))", "year, month"))
add("group_average_min_weight", group(gaps, "season", ("year", "month"), min_weight=0.5), grouped_sql(GAPS, DJF, "year, month", f"case when sum(case when v is not null then w else 0 end) >= 0.5 then {MEAN} end"))
add("group_average_skipna_false", group(gaps, "year", ("year",), skipna=False), grouped_sql(GAPS, YEAR, "year", f"case when count(v) = max(n) then {MEAN} end"))


def climate(cube, freq, parts, **options):
    return lambda spark, sf_dir: shown(T.climatology(cube(spark, sf_dir), "v", freq, **options), parts)


CLIMATE_MONTH = f"select t, {MONTH_LEN} as len, month(t) as month from times"
CLIMATE_SEASON = f"select t, {MONTH_LEN} as len, {MIDDLE} as month from times"
CLIMATE_DAY = "select t, 86400000000 as len, month(t) as month, day(t) as day from times where not (month(t) = 2 and day(t) = 29)"
PERIOD = ("1996-01-01", "1999-12-31")
add("climatology_month", climate(cubes.orders_cube, "month", ("month",)), grouped_sql(ORDERS, CLIMATE_MONTH, "month"))
add("climatology_season", climate(gaps, "season", ("month",)), grouped_sql(GAPS, CLIMATE_SEASON, "month"))
add("climatology_day_noleap", climate(cubes.ship_daily, "day", ("month", "day")), grouped_sql(DAILY, CLIMATE_DAY, "month, day"))
add("climatology_reference_period", climate(cubes.orders_cube, "month", ("month",), reference_period=PERIOD), grouped_sql(ORDERS, CLIMATE_MONTH + " where t >= timestamp '1996-01-01' and t < timestamp '2000-01-01'", "month"))


def anomaly(cube, freq, **options):
    return lambda spark, sf_dir: shown(T.departures(cube(spark, sf_dir), "v", freq, **options), stamp=True)


def departures_sql(cube: str, obs: str, climo: str, keys: str) -> str:
    """obs: rows (t, y, x, v and keys); climo: points of the climatology."""
    base = grouped_sql("{}", climo, keys).split("pts as", 1)[1]
    base = f"cpts as{base}".replace("from pts)", "from cpts)").replace("g as (", "cg as (").replace("join g using", "join cg using").replace(f"round({MEAN} + {NUDGE}, 6)", MEAN)
    head, tail = base.rsplit("\n      select", 1)
    on = " and ".join(f"o.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"with {cube}, {TIMES}, {head.strip()}, base as (select {tail}), obs as ({obs}) select o.t, o.y, o.x, round(o.v - c.v + {NUDGE}, 6) as v from obs o left join base c on {on} and o.y = c.y and o.x = c.x"


add("departures_month_samefreq", anomaly(cubes.orders_cube, "month"), departures_sql(ORDERS, "select t, y, x, v, month(t) as month from cube", CLIMATE_MONTH, "month"))
add("departures_reference_period", anomaly(cubes.orders_cube, "month", reference_period=PERIOD), departures_sql(ORDERS, "select t, y, x, v, month(t) as month from cube", CLIMATE_MONTH + " where t >= timestamp '1996-01-01' and t < timestamp '2000-01-01'", "month"))
add("departures_day", anomaly(cubes.ship_daily, "day"), departures_sql(DAILY, "select t, y, x, v, month(t) as month, day(t) as day from cube where not (month(t) = 2 and day(t) = 29)", CLIMATE_DAY, "month, day"))
TWICE = f"select t as s, {MONTH_LEN} as len, cast(year(t) + (case when month(t) = 12 then 2 else 0 end) as bigint) as year, {MIDDLE} as month from times"
SEASON_OBS = f"""select make_timestamp(p.year, p.month, 1, 0, 0, 0.0) as t, c.y, c.x, sum(p.w * c.v) / nullif(sum(case when c.v is not null then p.w end), 0) as v, p.month
  from cube c join (select *, len / sum(len) over (partition by year, month) as w from ({TWICE})) p on c.t = p.s group by p.year, p.month, c.y, c.x"""
add("departures_season", anomaly(cubes.orders_cube, "season"), departures_sql(ORDERS, SEASON_OBS, CLIMATE_SEASON, "month"))
add("departures_month_from_day", anomaly(cubes.ship_daily, "month"), departures_sql(DAILY, "select date_trunc('month', t) as t, y, x, avg(v) as v, month(t) as month from cube group by date_trunc('month', t), month(t), y, x", "select t, 86400000000 as len, month(t) as month from times", "month"))

add("temporal_average_weighted", lambda s, d: shown(T.average(gaps(s, d), "v")), f"with {GAPS}, {TIMES}, g as (select t, len / sum(len) over (partition by month(t)) as w from (select t, {MONTH_LEN} as len from times)) select y, x, round({MEAN} + {NUDGE}, 6) as v from cube join g using (t) group by y, x")
add("temporal_average_unweighted", lambda s, d: shown(T.average(gaps(s, d), "v", weighted=False)), f"with {GAPS} select y, x, round(avg(v) + {NUDGE}, 6) as v from cube group by y, x")


def times(spark, axis: Axis, **columns) -> DataFrame:
    """Columns of a time axis; those of microseconds as timestamps."""
    given = {"t": axis.values, **columns}
    df = axis_frame(spark, "_k", given)
    return df.select(*(F.expr(US.format(k)).alias(k) if str(getattr(v, "dtype", "")) == "int64" else F.round(k, 9).alias(k) for k, v in given.items()))


def weights_query(freq: str):
    def run(spark, sf_dir):
        ds = T.group_average(cubes.orders_cube(spark, sf_dir), "v", freq, keep_weights=True)
        axis, w = ds.attrs["weights"]["time_wts"]
        return times(spark, axis, w=w)

    return run


for freq, points in (("year", YEAR), ("season", DJF), ("month", MONTH)):
    by = "year" if freq == "year" else "year, month"
    add(f"time_weights_{freq}", weights_query(freq), f"with {ORDERS}, {TIMES} select t, round(len / sum(len) over (partition by {by}), 9) as w from ({points})")


def bounds_query(unit: str, freq: str | None, parts: int | None = None, method: str = "freq", end_of_month: bool = False, shift: int = 0):
    def run(spark, sf_dir):
        ds = {"month": cubes.orders_cube, "day": cubes.ship_daily, "hour": cubes.events_cube}[unit](spark, sf_dir)
        a = ds.axes["time"]
        a = a.with_(values=a.values + shift, lo=None, hi=None)
        found = B.add_time_bounds(ds.with_axis(a), method, freq, parts, end_of_month).axes["time"]
        return times(spark, found, lo=found.lo, hi=found.hi)

    return run


def bounds_sql(cube: str, lo: str, hi: str, t: str = "t") -> str:
    return f"with {cube}, times as (select distinct {t} as t from cube) select t, {lo} as lo, {hi} as hi from times"


add("time_bounds_year", bounds_query("month", "year"), bounds_sql(ORDERS, "cast(date_trunc('year', t) as timestamp)", "cast(date_trunc('year', t) + interval 1 year as timestamp)"))
add("time_bounds_month", bounds_query("month", "month"), bounds_sql(ORDERS, "cast(t as timestamp)", "cast(t + interval 1 month as timestamp)"))
add("time_bounds_end_of_month", bounds_query("month", "month", end_of_month=True), bounds_sql(ORDERS, "cast(t - interval 1 month as timestamp)", "cast(t as timestamp)"))
add("time_bounds_day", bounds_query("hour", "day"), bounds_sql(EVENTS, "cast(date_trunc('day', t) as timestamp)", "cast(date_trunc('day', t) + interval 1 day as timestamp)"))
add("time_bounds_subdaily", bounds_query("hour", "hour", 4), bounds_sql(EVENTS, "date_trunc('day', t) + to_hours(cast(hour(t) // 6 * 6 as integer))", "date_trunc('day', t) + to_hours(cast(hour(t) // 6 * 6 + 6 as integer))"))
STEP = "coalesce(epoch_us(t) - lag(epoch_us(t)) over (order by t), lead(epoch_us(t)) over (order by t) - epoch_us(t))"
NEXT = "coalesce(lead(epoch_us(t)) over (order by t) - epoch_us(t), epoch_us(t) - lag(epoch_us(t)) over (order by t))"
add("time_bounds_midpoint", bounds_query("month", None, method="midpoint"), bounds_sql(ORDERS, f"make_timestamp(epoch_us(t) - ({STEP}) // 2)", f"make_timestamp(epoch_us(t) + ({NEXT}) // 2)"))


def centered(spark, sf_dir):
    a = A.center_times(cubes.orders_cube(spark, sf_dir)).axes["time"]
    return times(spark, a, lo=a.lo, hi=a.hi)


add("center_times", centered, f"with {ORDERS}, {TIMES} select make_timestamp((epoch_us(t) + epoch_us(t + interval 1 month)) // 2) as t, cast(t as timestamp) as lo, cast(t + interval 1 month as timestamp) as hi from times")


def frequencies(spark, sf_dir):
    found = [(n, B.infer_freq(c(spark, sf_dir).axes["time"])) for n, c in (("events", cubes.events_cube), ("orders", cubes.orders_cube), ("ship", cubes.ship_daily))]
    return spark.createDataFrame(found, "name string, freq string")


def infer_sql(name: str, cube: str) -> str:
    return f"select '{name}' as name, (with {cube} select case when m < 86400e6 then 'hour' when m < 21 * 86400e6 then 'day' when m < 300 * 86400e6 then 'month' else 'year' end from (select median(d) as m from (select epoch_us(t) - lag(epoch_us(t)) over (order by t) as d from (select distinct t from cube)))) as freq"


add("infer_freq", frequencies, " union all ".join(infer_sql(*x) for x in (("events", EVENTS), ("orders", ORDERS), ("ship", DAILY))))


def decode_query(units: str, calendar: str = "standard"):
    """Numbers of orders, decoded as time."""

    def run(spark, sf_dir):
        n = sorted(r[0] for r in cubes.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 400).alias("n")).distinct().collect())
        a = Axis("time", n, attrs={"units": units, "calendar": calendar})
        ds = timecodec.decode_time(GridDataset(spark.range(0), {"time": a}, {}))
        found = ds.axes["time"]
        if calendar in C.GREGORIAN_LIKE:
            df = axis_frame(spark, "_k", {"n": a.values.astype("int64"), "us": found.values})
            return df.select("n", F.expr(US.format("us")).alias("t"))
        p = found.parts()
        return axis_frame(spark, "_k", {"n": a.values.astype("int64"), "year": p["year"], "month": p["month"], "day": p["day"]}).drop("_k")

    return run


NUMBERS = "select distinct cast(o_orderkey % 400 as bigint) as n from orders"
add("decode_time_days", decode_query("days since 1995-01-01"), f"select n, timestamp '1995-01-01' + to_days(cast(n as integer)) as t from ({NUMBERS})")
add("decode_time_hours", decode_query("hours since 1995-01-01 12:30:00"), f"select n, timestamp '1995-01-01 12:30:00' + to_hours(n) as t from ({NUMBERS})")
add("decode_time_months", decode_query("months since 1995-01-31"), f"select n, timestamp '1995-01-31' + to_months(cast(n as integer)) as t from ({NUMBERS})")
add("decode_time_years", decode_query("years since 1996-02-29"), f"select n, timestamp '1996-02-29' + to_years(cast(n as integer)) as t from ({NUMBERS})")
add("decode_time_360_day", decode_query("days since 1995-02-30", "360_day"), f"select n, cast(1995 + (59 + n) // 360 as bigint) as year, cast((59 + n) % 360 // 30 + 1 as bigint) as month, cast((59 + n) % 30 + 1 as bigint) as day from ({NUMBERS})")
