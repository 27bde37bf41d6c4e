"""Datasets on structured grids: one long fact DataFrame, and small axes beside it.

The fact has an integer index column per axis and a column per variable; null
is missing. An axis is a short table (positions, bounds, and for time calendar
components) that operators reduce to weights and labels before a broadcast
join with the fact.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars

#: Names by which an axis is known when no attribute tells.
NAMES = {"X": ("longitude", "lon"), "Y": ("latitude", "lat"), "T": ("time",), "Z": ("vertical", "height", "pressure", "lev", "plev")}
STANDARD = {"X": ("longitude",), "Y": ("latitude",), "T": ("time",), "Z": ("vertical", "height", "pressure", "air_pressure", "altitude", "depth")}
DEFAULT_ATTRS = {
    "X": {"axis": "X", "standard_name": "longitude", "units": "degrees_east"},
    "Y": {"axis": "Y", "standard_name": "latitude", "units": "degrees_north"},
    "T": {"axis": "T", "standard_name": "time"},
    "Z": {"axis": "Z", "standard_name": "height"},
}


#: Rows of a table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Rows from which on an axis's table goes to Spark by Arrow.
ARROW_ROWS = 10_000


def joined(rows: DataFrame, small: DataFrame, on, n: int, how: str = "inner") -> DataFrame:
    """Rows with a table of n rows: broadcast while that is short."""
    return rows.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


@dataclass(frozen=True)
class Axis:
    """One axis: name, values, bounds (lo, hi) and attributes. Time values are ordinals in microseconds, when decoded."""

    name: str
    values: np.ndarray
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    attrs: dict = field(default_factory=dict)
    calendar: str | None = None

    def __post_init__(self):
        kind = np.int64 if self.calendar else float
        for k in ("values", "lo", "hi"):
            if getattr(self, k) is not None:
                object.__setattr__(self, k, np.asarray(getattr(self, k), kind))

    def __len__(self) -> int:
        return len(self.values)

    @property
    def idx(self) -> str:
        """The fact's index column."""
        return f"{self.name}_idx"

    @property
    def bounds_name(self) -> str:
        return self.attrs.get("bounds", f"{self.name}_bnds")

    @property
    def decoded(self) -> bool:
        return self.calendar is not None

    def keys(self) -> set[str]:
        """Which of X, Y, Z, T this is, by attributes first and by name too."""
        found = set()
        if self.attrs.get("axis") in DEFAULT_ATTRS:
            found.add(self.attrs["axis"])
        for key, names in STANDARD.items():
            if self.attrs.get("standard_name") in names or self.attrs.get("_CoordinateAxisType", "").lower() in (*names, {"X": "lon", "Y": "lat"}.get(key)):
                found.add(key)
        units = str(self.attrs.get("units", ""))
        if units.startswith("degrees_e") or units.startswith("degree_e"):
            found.add("X")
        if units.startswith("degrees_n") or units.startswith("degree_n"):
            found.add("Y")
        if " since " in units or self.decoded:
            found.add("T")
        found |= {key for key, names in NAMES.items() if self.name in names}
        return found

    def has_bounds(self) -> bool:
        return self.lo is not None

    def parts(self) -> dict[str, np.ndarray]:
        """Calendar components of decoded time values."""
        return calendars.components(self.values, self.calendar)

    def with_(self, **changes) -> Axis:
        return replace(self, **changes)

    def take(self, index) -> Axis:
        """The positions of index, a mask or numbers."""
        return replace(self, values=self.values[index], lo=None if self.lo is None else self.lo[index], hi=None if self.hi is None else self.hi[index])


def axis_frame(spark: SparkSession, idx: str, columns: dict[str, np.ndarray]) -> DataFrame:
    """A small table of numpy columns with a running index, as a local relation."""
    n = len(next(iter(columns.values()))) if columns else 0
    data = {} if idx in columns else {idx: np.arange(n, dtype=np.int32)}
    data |= {k: (np.asarray(v, np.int32) if np.asarray(v).dtype.kind in "iu" and k.endswith("_idx") else v) for k, v in columns.items()}
    def ddl(v) -> str:
        v = np.asarray(v)
        return "int" if v.dtype == np.int32 else "bigint" if v.dtype.kind in "iu" else "double" if v.dtype.kind == "f" else "boolean" if v.dtype.kind == "b" else "string"

    schema = ", ".join(f"`{k}` {ddl(v)}" for k, v in data.items())
    if n >= ARROW_ROWS:
        return spark.createDataFrame(pa.table({k: pa.array(np.asarray(v).tolist() if np.asarray(v).dtype.kind == "O" else np.asarray(v)) for k, v in data.items()}), schema)
    rows = list(zip(*(np.asarray(v).tolist() for v in data.values())))
    return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class GridDataset:
    """A fact DataFrame, its axes by name, the axes of each variable, and attributes; more: facts of variables on other axes, by axes.

    Attributes of variables are in attrs["variables"], by name.
    """

    fact: DataFrame
    axes: dict[str, Axis]
    variables: dict[str, tuple[str, ...]]
    attrs: dict = field(default_factory=dict)
    more: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.fact.sparkSession

    def with_(self, **changes) -> GridDataset:
        return replace(self, **changes)

    def frame_of(self, var: str) -> DataFrame:
        """The fact that has a variable."""
        return self.more.get(self.dims_of(var), self.fact)

    def frames(self) -> dict[tuple[str, ...], DataFrame]:
        """All facts by axes."""
        main = [dims for dims in self.variables.values() if dims not in self.more][:1]
        return {**{dims: self.fact for dims in main}, **self.more}

    def with_frame(self, fact: DataFrame, variables: dict[str, tuple[str, ...]]) -> GridDataset:
        """This dataset with the variables, all on the same axes, of one more fact."""
        (dims,) = set(variables.values())
        if dims in self.frames():
            old = self.frames()[dims]
            fact = old.join(fact, [self.axes[d].idx for d in dims], "full")
            if dims not in self.more:
                return replace(self, fact=fact, variables={**self.variables, **variables})
        return replace(self, more={**self.more, dims: fact}, variables={**self.variables, **variables})

    def each_frame(self, change) -> GridDataset:
        """This dataset with change(fact, dims) in place of every fact."""
        found = {dims: change(df, dims) for dims, df in self.frames().items()}
        return replace(self, fact=next((df for dims, df in found.items() if dims not in self.more), self.fact), more={dims: found[dims] for dims in self.more})

    def with_axis(self, axis: Axis, old: str | None = None) -> GridDataset:
        """This dataset with one axis replaced."""
        return replace(self, axes={axis.name if k == (old or axis.name) else k: axis if k == (old or axis.name) else a for k, a in self.axes.items()})

    def dims_of(self, var: str) -> tuple[str, ...]:
        if var not in self.variables:
            raise KeyError(f"The data variable {var!r} does not exist in the dataset.")
        return self.variables[var]

    def axis_of(self, key: str, var: str | None = None) -> Axis:
        """The one axis of a kind, of var or of the dataset."""
        names = self.dims_of(var) if var else tuple(self.axes)
        found = [self.axes[n] for n in names if key in self.axes[n].keys()]
        if not found:
            raise KeyError(f"No {key!r} axis was found{f' for {var!r}' if var else ''}; set its axis or standard_name attribute.")
        if len(found) > 1:
            raise ValueError(f"{var or 'The dataset'} has {len(found)} {key!r} axes: {[a.name for a in found]}")
        return found[0]

    def fact_of(self, var: str) -> DataFrame:
        """Index columns and the variable, NaN as null."""
        value = F.nanvl(F.col(var).cast("double"), F.lit(None).cast("double")).alias(var)
        return self.frame_of(var).select(*(self.axes[d].idx for d in self.dims_of(var)), value)

    def table(self, var: str) -> DataFrame:
        """The variable with the coordinates of its axes in place of indices."""
        out = self.fact_of(var)
        for d in self.dims_of(var):
            a = self.axes[d]
            columns = {d: a.values} if not a.decoded else {d: a.values, **{k: v for k, v in a.parts().items() if k in ("year", "month", "day", "hour")}}
            out = out.join(F.broadcast(axis_frame(self.spark, a.idx, columns)), a.idx).drop(a.idx)
        return out

    def densify(self, var: str) -> GridDataset:
        """Every cell of the variable's axes as a row, absent ones null."""
        cells = None
        for d in self.dims_of(var):
            a = self.axes[d]
            own = self.spark.range(len(a)).select(F.col("id").cast("int").alias(a.idx))
            cells = own if cells is None else cells.crossJoin(F.broadcast(own))
        return self.with_(fact=cells.join(self.fact_of(var), [self.axes[d].idx for d in self.dims_of(var)], "left"), variables={var: self.dims_of(var)}, more={})


def from_table(df: DataFrame, axes: list[Axis], variables: list[str], attrs: dict | None = None) -> GridDataset:
    """A dataset of a table whose columns are named as axes and variables; values are looked up on the axes, rows off them are left out."""
    fact = df
    for a in axes:
        small = axis_frame(df.sparkSession, a.idx, {f"_{a.name}": a.values})
        fact = fact.join(F.broadcast(small), fact[a.name] == small[f"_{a.name}"]).drop(f"_{a.name}")
    fact = fact.select(*(a.idx for a in axes), *variables)
    return GridDataset(fact, {a.name: a for a in axes}, {v: tuple(a.name for a in axes) for v in variables}, attrs or {})


def micros(time: str) -> Column:
    """Microseconds from 1970-01-01 of a timestamp's date and clock; no time zone has a say, as timestampdiff would let it."""
    t = f"cast({time} as timestamp_ntz)"
    return F.expr(f"datediff(cast({t} as date), date'1970-01-01') * 86400000000L + (hour({t}) * 60 + minute({t})) * 60000000L + cast(extract(SECOND FROM {t}) * 1000000 as bigint)")


def axis_from(df: DataFrame, name: str, attrs: dict | None = None, calendar: str | None = None) -> Axis:
    """The distinct values of a column, ascending, as an axis; timestamps become decoded time. Axes are short, so they go to the driver."""
    column = F.col(name)
    if dict(df.dtypes)[name].startswith(("timestamp", "date")):
        column = micros(f"`{name}`")
        calendar = calendar or "proleptic_gregorian"
    values = sorted(r[0] for r in df.select(column.alias("v")).filter("v is not null").distinct().collect())
    return Axis(name, np.array(values), attrs=attrs or {}, calendar=calendar)
