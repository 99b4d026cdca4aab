"""Grid files written byte by byte, read as a data source."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.sources import netcdf, tables


def pad(b):
    return b + b"\0" * (-len(b) % 4)


def name(s):
    return struct.pack(">i", len(s)) + pad(s.encode())


def attribute(key, value):
    if isinstance(value, str):
        return name(key) + struct.pack(">ii", 2, len(value)) + pad(value.encode())
    kind = {np.dtype(">f8"): 6, np.dtype(">i2"): 3}[value.dtype]
    return name(key) + struct.pack(">ii", kind, value.size) + pad(value.tobytes())


def attributes(items):
    return struct.pack(">ii", 12, len(items)) + b"".join(attribute(*i) for i in items.items()) if items else struct.pack(">ii", 0, 0)


def encode(version, hours, lat, lon, fields, record):
    """A file with time (a record dimension or a fixed one), latitude, longitude and packed or plain fields (time, lat, lon)."""
    n, offset = len(hours), ">q" if version == 2 else ">i"
    dims = [("time", 0 if record else n), ("latitude", len(lat)), ("longitude", len(lon))]
    head = b"CDF" + bytes([version]) + struct.pack(">i", n if record else 0) + struct.pack(">ii", 10, 3) + b"".join(name(d) + struct.pack(">i", k) for d, k in dims) + struct.pack(">ii", 0, 0)
    variables = [("latitude", [1], {}, 6, lat.astype(">f8")), ("longitude", [2], {}, 6, lon.astype(">f8")), ("time", [0], {"units": "hours since 1900-01-01 00:00:00.0"}, 4, hours.astype(">i4"))]
    variables += [(k, [0, 1, 2], a, {"i": 3, "f": 5}[v.dtype.kind], v) for k, (v, a) in fields.items()]

    def body(begins):
        out = struct.pack(">ii", 11, len(variables))
        for (key, ids, a, kind, v), begin in zip(variables, begins, strict=True):
            size = v.nbytes if not record or ids[0] else v[0:1].nbytes
            out += name(key) + struct.pack(">i", len(ids)) + struct.pack(f">{len(ids)}i", *ids) + attributes(a) + struct.pack(">ii", kind, size + -size % 4) + struct.pack(offset, begin)
        return out

    start = len(head) + len(body([0] * len(variables)))
    begins, data, at = [0] * len(variables), b"", start
    inside = [i for i, v in enumerate(variables) if record and v[1][0] == 0]
    for i, v in enumerate(variables):
        if i not in inside:
            begins[i] = at
            data += pad(v[4].tobytes())
            at = start + len(data)
    for i in inside:
        begins[i] = at
        at += len(pad(variables[i][4][0:1].tobytes()))
    for step in range(n if inside else 0):
        for i in inside:
            data += pad(variables[i][4][step : step + 1].tobytes())
    return head + body(begins) + data


@pytest.fixture
def reader(spark):
    spark.dataSource.register(netcdf.NetCDF)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("netcdf")


LAT, LON, HOURS = np.array([50.0, 49.75, 49.5]), np.array([-1.0, -0.75, 0.0, 0.25, 0.5]), np.array([1086600, 1086601, 1086603])


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("record", [True, False])
def test_round_trip(reader, tmp_path, version, record):
    rng = np.random.default_rng(version)
    want = {}
    for level in (1000, 850):
        packed = rng.integers(-3000, 3000, (3, 3, 5)).astype(">i2")
        packed[1, 2, 3] = -32767
        wind = rng.normal(size=(3, 3, 5)).astype(">f4")
        scale = {"scale_factor": np.array([0.01], ">f8"), "add_offset": np.array([250.0], ">f8"), "_FillValue": np.array([-32767], ">i2")}
        (tmp_path / f"{level}.nc").write_bytes(encode(version, HOURS, LAT, LON, {"t": (packed, scale), "u": (wind, {})}, record))
        t = packed * 0.01 + 250
        for k, i, j in np.ndindex(3, 3, 5):
            missing = packed[k, i, j] == -32767
            want[level, int(HOURS[k]) * 3600 - 2208988800, i, j] = (LAT[i], LON[j], None if missing else t[k, i, j], float(wind[k, i, j]))
    df = reader.load(str(tmp_path))
    assert df.columns == [*netcdf.FIXED, "t", "u"] and df.rdd.getNumPartitions() == 6
    got = {(r.level, r.time, r.lat_i, r.lon_i): (r.latitude, r.longitude, r.t, r.u) for r in df.collect()}
    assert set(got) == set(want)
    for key, (a, b, t, u) in want.items():
        g = got[key]
        assert g[0] == a and g[1] == b and (g[2] is None if t is None else abs(g[2] - t) < 1e-9) and abs(g[3] - u) < 1e-9
    only = reader.option("variables", "u").load(str(tmp_path))
    assert only.columns == [*netcdf.FIXED, "u"]
    cells = tables.grid_table(netcdf.grid_levels(df, "t"))
    assert cells.count() == 44 and cells.where(F.size("levels") == 2).count() == 44


def test_conditions_leave_out_partitions(reader, tmp_path):
    for level in (1000, 850, 500):
        (tmp_path / f"{level}.nc").write_bytes(encode(2, HOURS, LAT, LON, {"t": (np.zeros((3, 3, 5), ">f4"), {})}, True))
    first = int(HOURS[0]) * 3600 - 2208988800
    df = reader.load(str(tmp_path)).where(f"level >= 850 and time > {first} and lat_i = 1")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 2 * 2 * 5
    assert reader.load(str(tmp_path)).where("level in (500)").rdd.getNumPartitions() == 3
    r = netcdf.Reader(str(tmp_path), ["t"])
    left = list(r.pushFilters([netcdf.EqualTo(("level",), 500), netcdf.LessThan(("time",), first + 1), netcdf.EqualTo(("t",), 0.0)]))
    assert len(left) == 1 and [(p.level, p.step) for p in r.partitions()] == [(500, 0)]


def test_other_files(reader, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "850.tmp").write_bytes(encode(1, HOURS, LAT, LON, {"t": (np.ones((3, 3, 5), ">f4"), {})}, True))
    assert reader.load(str(tmp_path / "a")).where("level = 850").count() == 45
    assert reader.load("file://" + str(tmp_path / "a" / "850.tmp")).count() == 45
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    with pytest.raises(Exception, match="classic"):
        reader.load(str(tmp_path / "b")).count()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.nc").write_bytes(b"CDF\x01\0\0")
    with pytest.raises(Exception, match="too early"):
        reader.load(str(tmp_path / "c")).count()
    with pytest.raises(Exception, match="no grid files|name the variables"):
        (tmp_path / "d").mkdir()
        reader.load(str(tmp_path / "d")).count()
