"""Gridded datasets cut from the star-schema tables, as inputs of the registered queries."""

from __future__ import annotations

import contextlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bounds import time_bounds
from .model import Axis, GridDataset, axis_frame, axis_from, micros

NY, NX = 6, 8
#: Cubes that stay persisted.
KEPT = 4
_kept: deque[DataFrame] = deque()


def kept(df: DataFrame) -> DataFrame:
    """An aggregated cube, persisted so that its table is scanned once for the time axis and the values; the oldest ones are let go."""
    while len(_kept) >= KEPT:
        with contextlib.suppress(Exception):  # its session may have ended
            _kept.popleft().unpersist()
    _kept.append(df.persist())
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_axis() -> Axis:
    y = np.arange(NY)
    return Axis("lat", -75.0 + 30 * y, -90.0 + 30 * y, -60.0 + 30 * y, {"axis": "Y", "units": "degrees_north"})


def lon_axis(start: float = 22.5) -> Axis:
    x = start + 45.0 * np.arange(NX)
    return Axis("lon", x, x - 22.5, x + 22.5, {"axis": "X", "units": "degrees_east"})


def cube(df: DataFrame, t: str, key: str, value: str, unit: str, freq: str, name: str = "v") -> GridDataset:
    """The mean of value by month, day or hour of t and by a cell from key; one aggregation, then a broadcast join with the time axis."""
    at = {"month": lambda c: F.trunc(c.cast("date"), "MM").cast("timestamp_ntz"), "day": lambda c: c.cast("date").cast("timestamp_ntz"), "hour": lambda c: F.expr(f"cast(cast({t} as timestamp_ntz) as date) + make_dt_interval(0, hour({t}))").cast("timestamp_ntz")}[unit](F.col(t))
    k = F.col(key)
    cells = df.select(at.alias("time"), (k % NY).cast("int").alias("lat_idx"), (F.floor(k / NY) % NX).cast("int").alias("lon_idx"), F.col(value).cast("double").alias(name))
    cells = kept(cells.groupBy("time", "lat_idx", "lon_idx").agg(F.avg(name).alias(name)))
    time = time_bounds(axis_from(cells, "time", {"axis": "T"}), freq, 24 if unit == "hour" else 1 if unit == "day" else None)
    small = axis_frame(df.sparkSession, "time_idx", {"_us": time.values})
    fact = cells.join(F.broadcast(small), micros("time") == F.col("_us")).select("time_idx", "lat_idx", "lon_idx", name)
    return GridDataset(fact, {"time": time, "lat": lat_axis(), "lon": lon_axis()}, {name: ("time", "lat", "lon")})


def orders_cube(spark: SparkSession, sf_dir: str) -> GridDataset:
    return cube(table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey", "o_totalprice", "month", "month")


def ship_cube(spark: SparkSession, sf_dir: str) -> GridDataset:
    return cube(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey", "l_extendedprice", "month", "month")


def ship_daily(spark: SparkSession, sf_dir: str) -> GridDataset:
    return cube(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey", "l_extendedprice", "day", "day")


def events_cube(spark: SparkSession, sf_dir: str) -> GridDataset:
    return cube(table(spark, sf_dir, "events"), "ts", "user_id", "value", "hour", "hour")


def with_gaps(ds: GridDataset) -> GridDataset:
    """The cube with values taken out: months divisible by 5 where row plus column divides by 3."""
    month = F.array(*map(F.lit, ds.axes["time"].parts()["month"].tolist()))
    gone = (F.get(month, F.col("time_idx")) % 5 == 0) & ((F.col("lat_idx") + F.col("lon_idx")) % 3 == 0)
    return ds.with_(fact=ds.fact.withColumn("v", F.when(~gone, F.col("v"))))


def profiles(spark: SparkSession, sf_dir: str) -> GridDataset:
    """Embeddings as columns of air: position p is the level 1000 - 15 p, theta a level that rises with it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("vec_idx"), F.posexplode("embedding").alias("lev_idx", "v"))
    rows = rows.select("vec_idx", "lev_idx", F.col("v").cast("double").alias("v"), (300.0 + 2 * F.col("lev_idx") + (F.col("vec_idx") % 10) / 10).alias("theta"))
    p = 1000.0 - 15 * np.arange(64)
    lev = Axis("lev", p, p + 7.5, p - 7.5, {"axis": "Z", "units": "hPa"})
    vec = Axis("vec", np.zeros(1))  # its index is the id itself
    return GridDataset(rows, {"vec": vec, "lev": lev}, {"v": ("vec", "lev"), "theta": ("vec", "lev")})
