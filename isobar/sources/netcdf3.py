"""netCDF-3 (classic, 64-bit offset) files, read in parallel by slabs of the first axis."""

from __future__ import annotations

import contextlib
import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Axis, GridDataset

#: Fixed values of the format: type codes and their numpy kinds.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
SLAB_VALUES = 4_000_000


class Header:
    """Dimensions, attributes and variables of a file."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a netCDF-3 file")
        self.data, self.at = data, 4
        self.offset = ">I" if data[3] == 1 else ">Q"
        self.records = self.number()
        self.dims = [(self.name(), self.number()) for _ in range(self.entries(DIMENSIONS))]
        self.attrs = self.attributes()
        self.variables = {}
        for _ in range(self.entries(VARIABLES)):
            name = self.name()
            dims = [self.number() for _ in range(self.number())]
            attrs, kind, size = self.attributes(), self.number(), self.number()
            (begin,) = struct.unpack_from(self.offset, self.data, self.at)
            self.at += struct.calcsize(self.offset)
            self.variables[name] = {"dims": dims, "attrs": attrs, "kind": KINDS[kind], "size": size, "begin": begin, "record": bool(dims) and self.dims[dims[0]][1] == 0}
        own = [v for v in self.variables.values() if v["record"]]
        self.stride = own[0]["size"] if len(own) == 1 else sum(v["size"] for v in own)
        if len(own) == 1:  # a lone record variable isn't padded
            v = own[0]
            self.stride = int(np.prod([self.dims[d][1] for d in v["dims"][1:]], dtype=np.int64)) * np.dtype(v["kind"]).itemsize

    def number(self) -> int:
        (x,) = struct.unpack_from(">I", self.data, self.at)
        self.at += 4
        return x

    def name(self) -> str:
        n = self.number()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def entries(self, tag: int) -> int:
        found, n = self.number(), self.number()
        if found not in (0, tag):
            raise ValueError("damaged netCDF-3 header")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.entries(ATTRIBUTES)):
            name, kind, n = self.name(), KINDS[self.number()], self.number()
            size = n * np.dtype(kind).itemsize
            raw = self.data[self.at : self.at + size]
            self.at += -(-size // 4) * 4
            out[name] = raw.decode(errors="replace").rstrip("\0") if kind == "S1" else (np.frombuffer(raw, kind).tolist() if n != 1 else np.frombuffer(raw, kind)[0].item())
        return out

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in self.variables[name]["dims"])


def load(path: str) -> tuple[Header, bytes | None]:
    """A file's header and, if it is compressed, its content; of others as much is read as the header takes."""
    with open_input(path) as f:
        if path.endswith(".gz"):
            whole = gzip.decompress(f.read())
            return Header(whole), whole
        size = 1 << 20
        while True:
            f.seek(0)
            head = f.read(size)
            try:
                return Header(head), None
            except (struct.error, IndexError, UnicodeDecodeError):
                if len(head) < size:
                    raise ValueError(f"{path} has a damaged netCDF-3 header") from None
                size *= 8


def open_input(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def values(path: str, h: Header, name: str, start: int = 0, stop: int | None = None, whole: bytes | None = None, file=None) -> np.ndarray:
    """A variable, or the slab start to stop of its first axis, with missing values as NaN and packing undone; file: path opened."""
    v, shape = h.variables[name], h.shape(name)
    kind = np.dtype(v["kind"])
    stop = (shape[0] if shape else 1) if stop is None else stop
    inner = int(np.prod(shape[1:], dtype=np.int64)) if shape else 1
    step = h.stride if v["record"] else inner * kind.itemsize
    low, n = v["begin"] + start * step, (stop - start) * step

    def read(f=None):
        raw = whole[low : low + n] if whole is not None else (f.seek(low), f.read(n))[1]
        if v["record"]:
            raw = b"".join(raw[k * step : k * step + inner * kind.itemsize] for k in range(stop - start))
        return np.frombuffer(raw[: (stop - start) * inner * kind.itemsize], kind).reshape((stop - start, *shape[1:]))

    if whole is not None or file is not None:
        x = read(file)
    else:
        with open_input(path) as f:
            x = read(f)
    out = x.astype(float)
    for key in ("_FillValue", "missing_value"):
        fill = v["attrs"].get(key)
        if isinstance(fill, (int, float)):
            out[x == np.asarray(fill, x.dtype)] = np.nan
    scale, add = v["attrs"].get("scale_factor", 1.0), v["attrs"].get("add_offset", 0.0)
    return out * scale + add if scale != 1.0 or add else out


def read_netcdf3(spark: SparkSession, path: str) -> GridDataset:
    """A dataset of a file: 1-D coordinates and their bounds as axes, other variables as facts, one for each set of axes.

    The driver reads header and axes; executors read slabs of the data, so the
    path must be one that they see (local or mounted folders, S3, GCS, HDFS).
    The variables on the most axes are the dataset's fact, others go to more;
    dimensions without coordinates count from 0, single values are in
    attrs["scalars"], attributes of variables in attrs["variables"]. A
    compressed file is read by each task, which keeps it for its slabs.
    """
    h, whole = load(path)
    names = [n for n, _ in h.dims]
    bounds = {v["attrs"]["bounds"]: n for n, v in h.variables.items() if "bounds" in v["attrs"]}
    plain = lambda attrs: {k: x for k, x in attrs.items() if isinstance(x, (str, int, float))}
    axes = {}
    for n, v in h.variables.items():
        if len(v["dims"]) == 1 and names[v["dims"][0]] == n and v["kind"] != "S1":
            lo = hi = None
            b = v["attrs"].get("bounds")
            if b in h.variables:
                edges = values(path, h, b, whole=whole)
                if edges.ndim != 2 or edges.shape[1] != 2:
                    raise ValueError(f"The bounds {b!r} have no dimension of two beside that of {n!r}.")
                lo, hi = edges.T
            axes[n] = Axis(n, values(path, h, n, whole=whole), lo, hi, plain(v["attrs"]))
    data = [n for n, v in h.variables.items() if n not in axes and n not in bounds and v["kind"] != "S1" and v["dims"]]
    for n in dict.fromkeys(names[d] for v in data for d in h.variables[v]["dims"]):
        if n not in axes:
            axes[n] = Axis(n, np.arange(h.records if dict(h.dims)[n] == 0 else dict(h.dims)[n], dtype=float))
    if not data:
        raise ValueError(f"{path} has no variables on its axes")
    dims_of = {n: tuple(names[d] for d in h.variables[n]["dims"]) for n in data}
    groups = sorted(dict.fromkeys(dims_of.values()), key=len, reverse=True)
    facts = {dims: slabs(spark, path, h, dims, [n for n in data if dims_of[n] == dims], axes) for dims in groups}
    scalars = {n: float(values(path, h, n, whole=whole).ravel()[0]) for n, v in h.variables.items() if not v["dims"] and v["kind"] != "S1" and n not in bounds}
    attrs = {**plain(h.attrs), "variables": {n: plain(h.variables[n]["attrs"]) for n in data}, **({"scalars": scalars} if scalars else {})}
    used = {d for dims in groups for d in dims}
    return GridDataset(facts[groups[0]], {n: a for n, a in axes.items() if n in used}, dims_of, attrs, {d: facts[d] for d in groups[1:]})


def slabs(spark: SparkSession, path: str, h: Header, dims: tuple[str, ...], data: list[str], axes: dict[str, Axis]) -> DataFrame:
    """A fact of variables on the same axes, read by slabs of the first."""
    shape = h.shape(data[0])
    inner = int(np.prod(shape[1:], dtype=np.int64))
    step = max(1, SLAB_VALUES // max(1, inner * len(data)))
    parts = max(1, -(-shape[0] // step))
    index = [axes[d].idx for d in dims]
    schema = pa.schema([*((c, pa.int32()) for c in index), *((n, pa.float64()) for n in data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = load(path)[1] if path.endswith(".gz") else None
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            start, stop = k * step, min(shape[0], (k + 1) * step)
            with contextlib.nullcontext() if whole is not None else open_input(path) as f:
                for at in range(start, stop):
                    grid = np.indices((1, *shape[1:])).reshape(len(shape), -1)
                    grid[0] += at
                    columns = [pa.array(g.astype(np.int32)) for g in grid]
                    columns += [pa.array(values(path, h, n, at, at + 1, whole, f).ravel(), from_pandas=True) for n in data]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = ", ".join([*(f"`{c}` int" for c in index), *(f"`{n}` double" for n in data)])
    return spark.range(0, -(-shape[0] // step), 1, parts).mapInArrow(run, ddl)


def attribute_bytes(attrs: dict) -> bytes:
    """Text and numbers of an attribute list; other values are left out."""
    out, n = b"", 0
    for k, v in attrs.items():
        if isinstance(v, str):
            body, kind, size = v.encode(), 2, len(v.encode())
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            body, kind, size = struct.pack(">d", v), 6, 1
        else:
            continue
        out, n = out + name_bytes(k) + struct.pack(">II", kind, size) + body + bytes(-len(body) % 4), n + 1
    return struct.pack(">II", ATTRIBUTES, n) + out if n else bytes(8)


def name_bytes(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">I", len(raw)) + raw + bytes(-len(raw) % 4)


def file_bytes(sizes: dict[str, int], variables: list[tuple[str, tuple[str, ...], dict, np.ndarray]], attrs: dict) -> bytes:
    """A file with 64-bit offsets and no records: sizes of dimensions, and variables as (name, dimensions, attributes, values)."""
    order = list(sizes)

    def head(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">III", 0, DIMENSIONS, len(sizes)) + b"".join(name_bytes(n) + struct.pack(">I", s) for n, s in sizes.items())
        out += attribute_bytes(attrs) + struct.pack(">II", VARIABLES, len(variables))
        for (name, dims, own, x), begin in zip(variables, begins):
            out += name_bytes(name) + struct.pack(f">{len(dims) + 1}I", len(dims), *map(order.index, dims)) + attribute_bytes(own)
            out += struct.pack(">IIQ", 6, min(x.size * 8, 2**32 - 4), begin)
        return out

    at = len(head([0] * len(variables)))
    begins = [at + 8 * sum(x.size for *_, x in variables[:k]) for k in range(len(variables))]
    return head(begins) + b"".join(np.ascontiguousarray(x, ">f8").tobytes() for *_, x in variables)


#: Fixed value: what stands for a missing value in files.
FILL = 1e20


def write_netcdf3(ds: GridDataset, folder: str, steps: int | None = None) -> DataFrame:
    """Writes a dataset's main fact as netCDF-3 files in a folder that all executors see, one for each run of `steps` positions of its first axis.

    Tasks write the files side by side, each whole, under names in the axis's
    order; open_mfdataset reads the folder as one dataset again. Decoded time
    goes as encode_axis gives it, missing values as FILL. Returns a table of
    the files (name, values).
    """
    from .timecodec import encode_axis

    frames = {dims: df for dims, df in ds.frames().items() if dims not in ds.more}
    (dims, fact), = frames.items()
    data = [v for v in ds.variables if ds.variables[v] == dims]
    axes = [encode_axis(ds.axes[d]) if ds.axes[d].decoded else ds.axes[d] for d in dims]
    shape = [len(a) for a in axes]
    steps = steps or max(1, SLAB_VALUES // max(1, int(np.prod(shape[1:], dtype=np.int64)) * len(data)))
    index, attrs = [a.idx for a in axes], dict(ds.attrs)
    own = attrs.pop("variables", {})
    rows = fact.select((F.col(index[0]) / steps).cast("int").alias("slab"), *index, *(F.col(v).cast("double").alias(v) for v in data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        held: dict[int, list[np.ndarray]] = {}

        def close(k: int) -> pa.RecordBatch:
            part = [axes[0].take(slice(k * steps, (k + 1) * steps)), *axes[1:]]
            variables = []
            for a in part:
                edges = {"bounds": a.bounds_name} if a.has_bounds() else {}
                variables.append((a.name, (a.name,), {**a.attrs, **edges}, a.values))
                if edges:
                    variables.append((a.bounds_name, (a.name, "bnds"), {}, np.c_[a.lo, a.hi]))
            cells = held.pop(k)
            variables += [(v, dims, {**own.get(v, {}), "_FillValue": FILL}, x) for v, x in zip(data, cells)]
            name = f"{k:08d}.nc"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(file_bytes({a.name: len(a) for a in part} | {"bnds": 2}, variables, attrs))
            return pa.RecordBatch.from_pylist([{"name": name, "values": sum(x.size for x in cells)}], schema=pa.schema([("name", pa.string()), ("values", pa.int64())]))

        for batch in batches:
            slab, *at = (c.to_numpy(zero_copy_only=False) for c in batch.columns[: 1 + len(index)])
            for k in np.unique(slab).tolist():
                for done in [x for x in held if x != k]:
                    yield close(done)
                if k not in held:
                    held[k] = [np.full((min(steps, shape[0] - k * steps), *shape[1:]), FILL) for _ in data]
                mine = slab == k
                where = (at[0][mine] - k * steps, *(x[mine] for x in at[1:]))
                for out, column in zip(held[k], batch.columns[1 + len(index) :]):
                    x = column.to_numpy(zero_copy_only=False)[mine].astype(float)
                    out[where] = np.where(np.isnan(x), FILL, x)
        for k in list(held):
            yield close(k)

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return rows.repartition("slab").sortWithinPartitions("slab").mapInArrow(run, "name string, values long")
