"""Uncompressed LAS files, point formats 0 to 3 and 6 to 8, in numpy: read, clipped, and written."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import binary_files, head, named, not_an_input, write_file

# The record layouts that the format's specification gives.
_OLD = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_NEW = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps", "<f8")]
_GPS, _RGB, _NIR = [("gps", "<f8")], [("r", "<u2"), ("g", "<u2"), ("b", "<u2")], [("nir", "<u2")]
RECORDS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR}
_BASE = "X double, Y double, Z double, Intensity int, ReturnNumber int, NumberOfReturns int, Classification int, UserData int, PointSourceID int, ScanAngle double, ScanDirectionFlag int, EdgeOfFlightline int, Synthetic int, Keypoint int, Withheld int"


@dataclass
class Header:
    version: tuple[int, int]
    offset: int
    format: int
    size: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    box: tuple[float, float, float, float]  # xmin, ymin, xmax, ymax
    adjusted_time: bool = False
    created: tuple[int, int] = (0, 0)  # day of the year, year


def header_of(raw: bytes) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError("this is no LAS file")
    version = (raw[24], raw[25])
    offset, = struct.unpack_from("<I", raw, 96)
    fmt = raw[104]
    if fmt & 0x80 or (fmt & 0x3F) not in RECORDS:
        raise ValueError(f"point format {fmt & 0x3F}{' (compressed)' if fmt & 0x80 else ''} is not read")
    size, count = struct.unpack_from("<HI", raw, 105)
    numbers = struct.unpack_from("<6d", raw, 131)
    if version >= (1, 4):
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    xmax, xmin, ymax, ymin = struct.unpack_from("<4d", raw, 179)
    flags, = struct.unpack_from("<H", raw, 6)
    return Header(version, offset, fmt & 0x3F, size, count, numbers[:3], numbers[3:], (xmin, ymin, xmax, ymax), bool(flags & 1), struct.unpack_from("<HH", raw, 90))


def schema_of(fmt: int) -> str:
    names = [n for n, _ in RECORDS[fmt]]
    extra = ", gpstime double" if "gps" in names else ""
    extra += ", R int, G int, B int" if "r" in names else ""
    extra += ", NIR int" if "nir" in names else ""
    extra += ", ScannerChannel int, Overlap int" if fmt >= 6 else ""
    return _BASE + extra


@dataclass
class Clip:
    """A rectangle (xmin, ymin, xmax, ymax) or a circle (x, y, radius), with a buffer around it."""

    rectangle: tuple[float, float, float, float] | None = None
    circle: tuple[float, float, float] | None = None
    buffer: float = 0.0

    @property
    def box(self) -> tuple[float, float, float, float]:
        if self.circle:
            x, y, r = self.circle
            return x - r - self.buffer, y - r - self.buffer, x + r + self.buffer, y + r + self.buffer
        x0, y0, x1, y1 = self.rectangle
        return x0 - self.buffer, y0 - self.buffer, x1 + self.buffer, y1 + self.buffer

    def misses(self, box: tuple[float, float, float, float]) -> bool:
        own = self.box
        return box[0] > own[2] or box[2] < own[0] or box[1] > own[3] or box[3] < own[1]

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = self.box
        inside = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
        if self.circle:
            cx, cy, r = self.circle
            inside &= (x - cx) ** 2 + (y - cy) ** 2 <= (r + self.buffer) ** 2
        return inside


def parse(raw: bytes, clip: Clip | None = None) -> pd.DataFrame:
    """The points of a file, of those within ``clip`` only."""
    h = header_of(raw)
    layout = list(RECORDS[h.format])
    used = np.dtype(layout).itemsize
    if h.size > used:
        layout.append(("extra", f"V{h.size - used}"))
    skipped = clip is not None and h.count and clip.misses(h.box)
    t = np.frombuffer(raw, dtype=layout, count=0 if skipped else h.count, offset=0 if skipped else h.offset)
    if clip is not None and len(t):
        t = t[clip.holds(t["x"] * h.scale[0] + h.shift[0], t["y"] * h.scale[1] + h.shift[1])]
    new = h.format >= 6
    bits = t["returns"] if new else t["bits"]
    flags = t["flags"] if new else t["class"] >> 5
    out = {a: t[a.lower()] * h.scale[k] + h.shift[k] for k, a in enumerate("XYZ")}
    out |= {
        "Intensity": t["intensity"], "ReturnNumber": bits & (15 if new else 7), "NumberOfReturns": bits >> 4 if new else (bits >> 3) & 7,
        "Classification": t["class"] if new else t["class"] & 31, "UserData": t["user"], "PointSourceID": t["source"],
        "ScanAngle": t["angle"] * (0.006 if new else 1.0), "ScanDirectionFlag": (flags >> 6) & 1 if new else (bits >> 6) & 1,
        "EdgeOfFlightline": flags >> 7 if new else bits >> 7, "Synthetic": flags & 1, "Keypoint": (flags >> 1) & 1, "Withheld": (flags >> 2) & 1,
    }
    names = t.dtype.names
    if "gps" in names:
        out["gpstime"] = t["gps"]
    if "r" in names:
        out |= {"R": t["r"], "G": t["g"], "B": t["b"]}
    if "nir" in names:
        out["NIR"] = t["nir"]
    if new:
        out |= {"ScannerChannel": (flags >> 4) & 3, "Overlap": (flags >> 3) & 1}
    return pd.DataFrame({k: np.asarray(v).astype(float if np.asarray(v).dtype.kind == "f" else np.int32) for k, v in out.items()})


def read_las(spark: SparkSession, path: str | list[str], conditions=None, rectangle=None, circle=None, buffer: float = 0.0) -> DataFrame:
    """Points of LAS files of one point format; a file is one task's work.

    With a rectangle or a circle, files whose box lies outside are skipped and only the
    points within it (and ``buffer`` around it) leave the task.
    """
    from ..functions.predicates import all_of

    fmt = header_of(head(spark, path, 375)).format
    clip = Clip(tuple(rectangle) if rectangle else None, tuple(circle) if circle else None, buffer) if rectangle or circle else None

    def run(batches):
        for batch in batches:
            for raw in batch["content"]:
                yield parse(bytes(raw), clip)

    df = binary_files(spark, path).mapInPandas(run, schema_of(fmt))
    return df.where(all_of(df, conditions))


def read_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, npoints, xmin, ymin, xmax, ymax, adjusted_time, year, day): what the files' headers say."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"]):
                h = header_of(bytes(raw))
                rows.append((name, h.count, *h.box, h.adjusted_time, h.created[1], h.created[0]))
            yield pd.DataFrame(rows, columns=["path", "npoints", "xmin", "ymin", "xmax", "ymax", "adjusted_time", "year", "day"])

    tops = binary_files(spark, path).select("path", F.substring("content", 1, 375).alias("content"))
    return tops.mapInPandas(run, "path string, npoints long, xmin double, ymin double, xmax double, ymax double, adjusted_time boolean, year int, day int")


def _checked(version: tuple[int, int], fmt: int) -> None:
    if version not in ((1, 0), (1, 1), (1, 2), (1, 3), (1, 4)) or fmt not in RECORDS:
        raise ValueError("versions 1.0 to 1.4 with point formats 0 to 3 and 6 to 8 are written")
    if (fmt >= 6 and version < (1, 4)) or (fmt in (2, 3) and version < (1, 2)):
        raise ValueError(f"point format {fmt} does not exist in version {version[0]}.{version[1]}")


def records(points: pd.DataFrame, scale: float, shift: list[float], fmt: int) -> bytes:
    """Points as records; values are rounded half away from zero and clamped, missing attributes are 0."""
    t = np.zeros(len(points), dtype=RECORDS[fmt])
    get = lambda name: points[name].to_numpy(dtype=float, na_value=0.0) if name in points else np.zeros(len(points))
    half = lambda v: np.sign(v) * np.floor(np.abs(v) + 0.5)
    clip = lambda v, lo, hi: np.clip(half(v), lo, hi).astype(np.int64)
    for k, a in enumerate("XYZ"):
        t[a.lower()] = clip((get(a) - shift[k]) / scale, -(2**31), 2**31 - 1)
    t["intensity"] = clip(get("Intensity"), 0, 65535)
    flags = clip(get("Synthetic"), 0, 1) | clip(get("Keypoint"), 0, 1) << 1 | clip(get("Withheld"), 0, 1) << 2
    if fmt >= 6:
        t["returns"] = clip(get("ReturnNumber"), 0, 15) | clip(get("NumberOfReturns"), 0, 15) << 4
        t["flags"] = flags | clip(get("Overlap"), 0, 1) << 3 | clip(get("ScannerChannel"), 0, 3) << 4 | clip(get("ScanDirectionFlag"), 0, 1) << 6 | clip(get("EdgeOfFlightline"), 0, 1) << 7
        t["class"], t["angle"] = clip(get("Classification"), 0, 255), clip(get("ScanAngle") / 0.006, -30000, 30000)
    else:
        t["bits"] = clip(get("ReturnNumber"), 0, 7) | clip(get("NumberOfReturns"), 0, 7) << 3 | clip(get("ScanDirectionFlag"), 0, 1) << 6 | clip(get("EdgeOfFlightline"), 0, 1) << 7
        t["class"], t["angle"] = clip(get("Classification"), 0, 31) | flags << 5, clip(get("ScanAngle"), -128, 127)
    t["user"], t["source"] = clip(get("UserData"), 0, 255), clip(get("PointSourceID"), 0, 65535)
    if "gps" in t.dtype.names:
        t["gps"] = get("gpstime")
    for name, column in (("r", "R"), ("g", "G"), ("b", "B"), ("nir", "NIR")):
        if name in t.dtype.names:
            t[name] = clip(get(column), 0, 65535)
    return t.tobytes()


def top_of(n: int, box: list[float], returns: list[int], scale: float, shift: list[float], version: tuple[int, int], fmt: int) -> bytes:
    """A header; ``box`` is xmax, xmin, ymax, ymin, zmax, zmin and ``returns`` counts by return number from 1."""
    _checked(version, fmt)
    size = 375 if version == (1, 4) else 235 if version == (1, 3) else 227
    top = bytearray(size)
    top[:4] = b"LASF"
    top[24], top[25], top[104] = version[0], version[1], fmt
    struct.pack_into("<HII", top, 94, size, size, 0)
    old = fmt < 6 and n < 2**32
    struct.pack_into("<HI5I", top, 105, np.dtype(RECORDS[fmt]).itemsize, n if old else 0, *(returns[:5] if old else [0] * 5))
    struct.pack_into("<6d", top, 131, scale, scale, scale, *shift)
    struct.pack_into("<6d", top, 179, *map(float, box))
    if version == (1, 4):
        struct.pack_into("<Q15Q", top, 247, n, *(returns + [0] * 15)[:15])
    return bytes(top)


def encode(points: pd.DataFrame, scale: float = 0.001, version: tuple[int, int] = (1, 2), fmt: int = 3) -> bytes:
    """A whole LAS file."""
    _checked(version, fmt)
    get = lambda a: points[a].to_numpy(dtype=float)
    some = len(points) > 0
    shift = [float(np.floor(get(a).min())) if some else 0.0 for a in "XYZ"]
    box = [float(f(get(a))) if some else 0.0 for a in "XYZ" for f in (np.max, np.min)]
    number = get("ReturnNumber") if "ReturnNumber" in points else np.zeros(len(points))
    returns = [int((number == k).sum()) for k in range(1, 16)]
    return top_of(len(points), box, returns, scale, shift, version, fmt) + records(points, scale, shift, fmt)


_WRITTEN = "path string, npoints long, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double"


def _row(path: str, n: int, box: list[float]) -> pd.DataFrame:
    xmax, xmin, ymax, ymin, zmax, zmin = box
    return pd.DataFrame([(path, n, xmin, ymin, zmin, xmax, ymax, zmax)], columns=[f.split()[0] for f in _WRITTEN.split(", ")])


def write_las(
    df: DataFrame, path: str, by: list[str] = (), conditions=None, scale: float = 0.001, version: tuple[int, int] | None = None, fmt: int = 3, inputs: list[str] = ()
) -> DataFrame:
    """LAS files of the accepted points; returns what was written: (path, npoints, box).

    A star in ``path`` stands for a group's key: one file for each group of ``by``, written
    in parallel, each by one task that holds the group.  Without a star all points go to
    one file, which one task writes batch by batch.
    """
    from ..functions.predicates import all_of

    version = version or ((1, 4) if fmt >= 6 else (1, 2))
    _checked(version, fmt)
    not_an_input(path, inputs)
    df = df.where(all_of(df, conditions))
    if ("*" in path) != bool(by):
        raise ValueError("a star in the path goes with groups, and groups with a star")
    columns = [c for c in df.columns if c not in by]
    if by:

        def group(key, own):
            target = named(path, key)
            write_file(target, [encode(own[columns], scale, version, fmt)])
            return _row(target, len(own), [float(f(own[a])) for a in "XYZ" for f in (np.max, np.min)])

        return _settled(df.groupBy(*by).applyInPandas(group, _WRITTEN))
    number = F.col("ReturnNumber") if "ReturnNumber" in df.columns else F.lit(0)
    n, *rest = df.agg(F.count(F.lit(1)), *[f(a) for a in "XYZ" for f in (F.max, F.min)], *[F.count_if(number == k) for k in range(1, 16)]).first()
    box, returns = [float(v or 0.0) for v in rest[:6]], list(rest[6:])
    shift = [float(np.floor(box[k])) for k in (1, 3, 5)]
    top = top_of(n, box, returns, scale, shift, version, fmt)

    def all_points(batches):
        write_file(path, (x for part in ([top], (records(b, scale, shift, fmt) for b in batches)) for x in part))
        yield _row(path, n, box)

    return _settled(df.repartition(1).mapInPandas(all_points, _WRITTEN))


def _settled(files: DataFrame) -> DataFrame:
    """The rows of files just written, a few for each; running the plan again would write again."""
    return files.sparkSession.createDataFrame(files.collect(), files.schema)
