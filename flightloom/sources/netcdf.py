"""Gridded files of the classic NetCDF format (CDF-1 and CDF-2) as a Spark data source.

    spark.dataSource.register(NetCDF)
    spark.read.format("netcdf").option("variables", "t,u").load("/grids/2024-01-01/temperature")

A row is a cell of one time step: file, level, time, lat_i, lon_i, latitude,
longitude, and a double for each variable.  A partition reads one time step of one
file: the header, then only the bytes of that step of the chosen variables.
Conditions on time and level leave out partitions before they are planned.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format: numbers of types (big-endian) and tags of lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Files of a grid: the pressure level is the file's name.
LEVEL_NAME = re.compile(r"^(-?\d+)(?:\.tmp)?\.(?:nc|tmp)$|^(-?\d+)\.nc\.tmp$")
FIXED = ["file", "level", "time", "lat_i", "lon_i", "latitude", "longitude"]
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    name: str
    dimensions: list[str]
    shape: list[int]
    attributes: dict
    dtype: str
    begin: int
    record: bool

    def slab(self) -> int:
        """Bytes of one step along the first dimension."""
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


@dataclass
class Header:
    variables: dict[str, Variable]
    record_bytes: int

    def read(self, f, v: Variable, step: int | None = None) -> np.ndarray:
        """A variable's values, or those of one step of its first dimension; packed ones unpacked, missing ones NaN."""
        if step is None and not v.record:
            f.seek(v.begin)
            raw = np.frombuffer(f.read(int(np.prod(v.shape, dtype=np.int64)) * np.dtype(v.dtype).itemsize), dtype=v.dtype).reshape(v.shape)
        elif step is None:
            return np.stack([self.read(f, v, k) for k in range(v.shape[0])]) if v.shape[0] else np.zeros(v.shape)
        else:
            f.seek(v.begin + step * (self.record_bytes if v.record else v.slab()))
            raw = np.frombuffer(f.read(v.slab()), dtype=v.dtype).reshape(v.shape[1:])
        out = raw.astype(float)
        for name in ("_FillValue", "missing_value"):
            if name in v.attributes:
                out[raw == np.asarray(v.attributes[name]).astype(raw.dtype).ravel()[0]] = np.nan
        number = lambda name, other: float(np.asarray(v.attributes.get(name, other)).ravel()[0])
        return out * number("scale_factor", 1.0) + number("add_offset", 0.0)


class _Bytes:
    """Reads numbers and names of a header one after the other."""

    def __init__(self, f, wide: bool):
        self.f, self.wide = f, wide

    def take(self, n: int) -> bytes:
        got = self.f.read(n)
        if len(got) < n:
            raise ValueError("the header ends too early")
        return got

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.int()).decode()

    def list_of(self, tag: int, item) -> list:
        found, n = self.int(), self.int()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("not a classic NetCDF header")
        return [item() for _ in range(n)]

    def attribute(self) -> tuple:
        name, kind, n = self.name(), self.int(), self.int()
        raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
        return name, raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, dtype=TYPES[kind])

    def offset(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.wide else self.int()


def header(f) -> Header:
    """The header of an open file; HDF5-based files (NetCDF-4) raise a ValueError."""
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file (CDF-1 or CDF-2)")
    b = _Bytes(f, magic[3] == 2)
    records = b.int()
    dims = b.list_of(DIMENSIONS, lambda: (b.name(), b.int()))
    b.list_of(ATTRIBUTES, b.attribute)

    def variable() -> tuple:
        name = b.name()
        ids = [b.int() for _ in range(b.int())]
        attributes = dict(b.list_of(ATTRIBUTES, b.attribute))
        kind, size, begin = b.int(), b.int(), b.offset()
        record = bool(ids) and dims[ids[0]][1] == 0
        return Variable(name, [dims[i][0] for i in ids], [dims[i][1] for i in ids], attributes, TYPES[kind], begin, record), size

    found = b.list_of(VARIABLES, variable)
    of_records = [(v, size) for v, size in found if v.record]
    # one record variable alone is not padded
    width = of_records[0][0].slab() if len(of_records) == 1 else sum(size for _, size in of_records)
    if records < 0:
        f.seek(0, 2)
        first = min((v.begin for v, _ in of_records), default=0)
        records = (f.tell() - first) // width if width else 0
    for v, _ in of_records:
        v.shape[0] = records
    return Header({v.name: v for v, _ in found}, width)


def times(values: np.ndarray, units: str) -> np.ndarray:
    """Seconds since 1970 of `hours since 1900-01-01 00:00:00` and the like."""
    m = re.match(r"\s*(\w+?)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?", units)
    if not m or m[1] not in SECONDS:
        raise ValueError(f"unknown units of time: {units}")
    start = datetime(*[int(x or 0) for x in m.groups()[1:]], tzinfo=timezone.utc).timestamp()
    return np.round(values * SECONDS[m[1]] + start).astype(np.int64)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """A file system that driver and executors reach by the path's scheme, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The grid files below a folder, or the file itself: `.nc`, or `.tmp` where a folder has no `.nc`."""
    system, at = _place(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
    found = [n for n in names if n.endswith(".nc")] or [n for n in names if n.endswith(".tmp")]
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(scheme + n for n in found)


def _level(file: str) -> int | None:
    m = LEVEL_NAME.match(file.rsplit("/", 1)[-1])
    return int(m[1] or m[2]) if m else None


def _axis(h: Header, *names: str) -> Variable:
    for n in names:
        if n in h.variables:
            return h.variables[n]
    raise ValueError(f"no variable {' or '.join(names)}")


def _gridded(h: Header) -> list[str]:
    """Variables over time, latitude and longitude."""
    return [v.name for v in h.variables.values() if len(v.shape) == 3]


@dataclass
class Step(InputPartition):
    file: str
    level: int | None
    step: int
    time: int


class NetCDF(DataSource):
    """See the module. Options: path (a file or a folder), variables (names, by commas; all gridded ones of the first file by default)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _names(self) -> list[str]:
        if self.options.get("variables"):
            return [v.strip() for v in self.options["variables"].split(",")]
        files = _files(self.options["path"])
        if not files:
            raise ValueError("no grid files: name the variables")
        system, at = _place(files[0])
        with system.open_input_file(at) as f:
            return _gridded(header(f))

    def schema(self) -> str:
        return "file string, level int, time long, lat_i int, lon_i int, latitude double, longitude double, " + ", ".join(f"`{v}` double" for v in self._names())

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], [f.name for f in schema.fields if f.name not in FIXED])


class Reader(DataSourceReader):
    def __init__(self, path: str, variables: list[str]):
        self.path, self.variables, self.tests = path, variables, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is Spark's
        """Takes conditions on time and level; the others are Spark's."""
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and f.attribute in (("time",), ("level",)):
                self.tests.append((f.attribute[0], compare[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for file in _files(self.path):
            level = _level(file)
            if not all(level is not None and test(level, value) for name, test, value in self.tests if name == "level"):
                continue
            system, at = _place(file)
            with system.open_input_file(at) as f:
                h = header(f)
                axis = _axis(h, "time", "valid_time")
                found = times(h.read(f, axis), str(axis.attributes.get("units", "seconds since 1970-01-01")))
            out += [Step(file, level, k, int(t)) for k, t in enumerate(found) if all(test(int(t), value) for name, test, value in self.tests if name == "time")]
        return out

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        system, at = _place(partition.file)
        with system.open_input_file(at) as f:
            h = header(f)
            lat, lon = (h.read(f, _axis(h, *names)) for names in (("latitude", "lat"), ("longitude", "lon")))
            values = [h.read(f, h.variables[v], partition.step).ravel() if v in h.variables else np.full(lat.size * lon.size, np.nan) for v in self.variables]
        n = lat.size * lon.size
        lat_i, lon_i = np.repeat(np.arange(lat.size, dtype=np.int32), lon.size), np.tile(np.arange(lon.size, dtype=np.int32), lat.size)
        columns = [
            pa.array([partition.file] * n, pa.string()), pa.array([partition.level] * n, pa.int32()), pa.array(np.full(n, partition.time), pa.int64()), pa.array(lat_i), pa.array(lon_i), pa.array(lat[lat_i]), pa.array(lon[lon_i]),
            *[pa.array(v, pa.float64(), from_pandas=True) for v in values],
        ]
        yield pa.record_batch(columns, names=[*FIXED, *self.variables])


def grid_levels(df: DataFrame, variable: str) -> DataFrame:
    """(lat_i, lon_i, hour, level, val) of one variable, as `tables.grid_table` takes it."""
    return df.where(F.col(variable).isNotNull()).select("lat_i", "lon_i", F.expr("time div 3600").alias("hour"), F.col("level").cast("double").alias("level"), F.col(variable).alias("val"))
