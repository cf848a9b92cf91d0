"""ESRI ASCII grids and GeoTIFF files as raster tables, and back.

A grid is written by one task, row after row from the top, from rows that are put together
in parallel; it never holds more than a batch of rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import with_centre
from ..operators.raster import NODATA
from .files import binary_files, head, write_file

_KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def load_raster(spark: SparkSession, path: str, band: str | int = "z", window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The cells with data of one band of a grid whose corner lies on the lattice, of those in ``window`` only.

    ASCII grids are parsed line by line in parallel, GeoTIFF files by one task each.
    """
    raster = _load_tiff(spark, path, band) if path.lower().endswith((".tif", ".tiff")) else _load_ascii(spark, path, str(band))
    if window:
        x0, y0, x1, y1 = window
        raster = raster.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return raster


def _on_lattice(corner: float, res: float) -> int:
    at = round(corner / res)
    if abs(at * res - corner) > 1e-6 * max(1.0, res):
        raise ValueError("the grid does not lie on the lattice of its resolution")
    return at


def _load_ascii(spark: SparkSession, path: str, band: str) -> DataFrame:
    lines = spark.read.text(path)
    first = [r[0] for r in lines.limit(len(_KEYS)).collect()]
    top = {k.lower(): float(v) for k, v in (x.split() for x in first if x.split() and x.split()[0].lower() in _KEYS)}
    res, nodata = top["cellsize"], top.get("nodata_value", NODATA)
    c0, r0 = _on_lattice(top["xllcorner"], res), _on_lattice(top["yllcorner"], res)
    # parts of a text file follow each other, so a line's number is its place in its part and what came before
    placed = lines.where(F.length(F.trim("value")) > 0).select(F.btrim("value", F.lit(" \r\n\t")).alias("text"), F.monotonically_increasing_id().alias("id"))
    placed = placed.withColumns({"part": F.shiftright("id", 33), "at": F.col("id") % (1 << 33)})
    body = placed.where(~F.lower(F.split("text", r"\s+")[0]).isin(*_KEYS))
    starts, before = [], 0
    for part, n, least in body.groupBy("part").agg(F.count(F.lit(1)), F.min("at")).orderBy("part").collect():  # a row for each part
        starts.append((part, before - least))
        before += n
    if not starts:
        return with_centre(spark.createDataFrame([], f"col long, row long, `{band}` double"), res).select("col", "row", "x", "y", band)
    shift = F.broadcast(spark.createDataFrame(starts, "part long, shift long"))
    cells = body.join(shift, "part").select((F.col("at") + F.col("shift")).alias("line"), F.posexplode(F.split("text", r"\s+")).alias("i", "v"))
    row = F.lit(r0 + int(top["nrows"]) - 1) - F.col("line")
    out = cells.select((F.col("i") + c0).cast("bigint").alias("col"), row.cast("bigint").alias("row"), F.col("v").cast("double").alias(band))
    return with_centre(out.where(F.col(band) != nodata), res).select("col", "row", "x", "y", band)


def _rows(raster: DataFrame, bands: list[str]) -> DataFrame:
    """(row, cols, values) from the top, in one partition."""
    cell = F.struct("col", F.array(*[F.coalesce(F.col(b).cast("double"), F.lit(NODATA)) for b in bands]).alias("v"))
    rows = raster.groupBy("row").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return rows.select("row", "cells.col", F.col("cells.v").alias("v")).repartition(1).sortWithinPartitions(F.desc("row"))


def _grid_rows(batches, box, n_bands: int):
    """Every row of the box from the top as an array (columns, bands)."""
    c0, c1, r0, r1 = box
    following = r1
    empty = np.full((c1 - c0 + 1, n_bands), NODATA)
    for batch in batches:
        for row, cols, values in zip(batch["row"], batch["col"], batch["v"]):
            for _ in range(following - row):
                yield empty
            out = empty.copy()
            out[np.asarray(cols) - c0] = np.array([np.asarray(v) for v in values])
            yield out
            following = row - 1
    for _ in range(following - r0 + 1):
        yield empty


def write_raster(raster: DataFrame, path: str, band: str | list[str], res: float, epsg: int = 0) -> None:
    """An ASCII grid of one band, or, where the name ends in .tif, a GeoTIFF of one or several."""
    bands = [band] if isinstance(band, str) else list(band)
    tiff = path.lower().endswith((".tif", ".tiff"))
    if not tiff and len(bands) != 1:
        raise ValueError("an ASCII grid holds one band")
    box = tuple(raster.agg(F.min("col"), F.max("col"), F.min("row"), F.max("row")).first())
    if box[0] is None:
        raise ValueError("the raster has no cell")
    c0, c1, r0, r1 = box

    def run(batches):
        rows = _grid_rows(batches, box, len(bands))
        if tiff:
            chunks = (x for part in ([_tiff_top(c1 - c0 + 1, r1 - r0 + 1, c0 * res, (r1 + 1) * res, res, bands, epsg)], (r.astype("<f8").tobytes() for r in rows)) for x in part)
        else:
            top = [f"ncols {c1 - c0 + 1}", f"nrows {r1 - r0 + 1}", f"xllcorner {c0 * res}", f"yllcorner {r0 * res}", f"cellsize {res}", f"nodata_value {NODATA}"]
            chunks = ((line + "\n").encode() for part in (top, (" ".join(map(repr, r[:, 0].tolist())) for r in rows)) for line in part)
        write_file(path, chunks)
        yield pd.DataFrame({"path": [path]})

    _rows(raster, bands).mapInPandas(run, "path string").collect()


# Codes of tags and of value types of the TIFF and GeoTIFF specifications.
_SHORT, _LONG, _DOUBLE, _ASCII, _LONG8 = 3, 4, 12, 2, 16
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _COUNTS, _PLANAR, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
_PIXEL_SCALE, _TIEPOINT, _GEO_KEYS, _METADATA, _NODATA_TAG = 33550, 33922, 34735, 42112, 42113


def _tiff_top(width: int, height: int, x0: float, y1: float, res: float, bands: list[str], epsg: int) -> bytes:
    """Header and directory of an uncompressed file of doubles, a strip for each row; a BigTIFF always, so of any size."""
    n, strip = len(bands), width * len(bands) * 8
    names = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{b}</Item>' for k, b in enumerate(bands))
    keys = [1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1] + ([3072, 0, 1, epsg] if epsg else [])
    keys[3] = len(keys) // 4 - 1
    tags = {
        _WIDTH: (_LONG, [width]), _HEIGHT: (_LONG, [height]), _BITS: (_SHORT, [64] * n), _COMPRESSION: (_SHORT, [1]), _PHOTOMETRIC: (_SHORT, [1]),
        _OFFSETS: (_LONG8, [0] * height), _SAMPLES: (_SHORT, [n]), _ROWS_PER_STRIP: (_LONG, [1]), _COUNTS: (_LONG8, [strip] * height), _PLANAR: (_SHORT, [1]),
        _FORMAT: (_SHORT, [3] * n), _PIXEL_SCALE: (_DOUBLE, [res, res, 0.0]), _TIEPOINT: (_DOUBLE, [0.0, 0.0, 0.0, x0, y1, 0.0]), _GEO_KEYS: (_SHORT, keys),
        _METADATA: (_ASCII, f"<GDALMetadata>{names}</GDALMetadata>\0"), _NODATA_TAG: (_ASCII, f"{NODATA}\0"),
    }
    raw = lambda kind, v: v.encode() if kind == _ASCII else struct.pack(f"<{len(v)}{_SIZES[kind]}", *v)
    start = 16 + 8 + 20 * len(tags) + 8
    at, data = start, {}
    for tag, (kind, values) in tags.items():
        size = len(raw(kind, values))
        if size > 8:
            data[tag] = at
            at += size + (-size) % 8
    tags[_OFFSETS] = _LONG8, [at + k * strip for k in range(height)]
    out = [struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16), struct.pack("<Q", len(tags))]
    for tag, (kind, values) in sorted(tags.items()):
        value = raw(kind, values)
        out.append(struct.pack("<HHQ", tag, kind, len(values)) + (struct.pack("<Q", data[tag]) if tag in data else value.ljust(8, b"\0")))
    out.append(struct.pack("<Q", 0))
    for tag, (kind, values) in tags.items():
        if tag in data:
            value = raw(kind, values)
            out.append(value + bytes((-len(value)) % 8))
    return b"".join(out)


def _tiff_tags(raw: bytes) -> tuple[dict[int, tuple], str]:
    order = "<" if raw[:2] == b"II" else ">"
    magic, = struct.unpack_from(order + "H", raw, 2)
    if magic not in (42, 43) or raw[:2] not in (b"II", b"MM"):
        raise ValueError("this is no TIFF file")
    big = magic == 43
    at, = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)
    n, = struct.unpack_from(order + ("Q" if big else "H"), raw, at)
    at += 8 if big else 2
    tags = {}
    for k in range(n):
        here = at + k * (20 if big else 12)
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, here)
        if kind not in _SIZES:
            continue
        size = struct.calcsize(order + _SIZES[kind]) * count
        value = here + (12 if big else 8)
        if size > (8 if big else 4):
            value, = struct.unpack_from(order + ("Q" if big else "I"), raw, value)
        tags[tag] = (raw[value : value + count].rstrip(b"\0").decode("latin-1"),) if kind == _ASCII else struct.unpack_from(f"{order}{count}{_SIZES[kind]}", raw, value)
    return tags, order


def parse_tiff(raw: bytes, band: int = 0) -> tuple[np.ndarray, float, float, float, float | None]:
    """(values by row, left, top, resolution, nodata) of a band of an uncompressed file in strips."""
    tags, order = _tiff_tags(raw)
    if tags.get(_COMPRESSION, (1,))[0] != 1 or _OFFSETS not in tags:
        raise ValueError("only uncompressed TIFF files in strips are read")
    n, width, height = tags.get(_SAMPLES, (1,))[0], tags[_WIDTH][0], tags[_HEIGHT][0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(_FORMAT, (1,))[0]]
    values = b"".join(raw[o : o + c] for o, c in zip(tags[_OFFSETS], tags[_COUNTS]))
    grid = np.frombuffer(values, dtype=f"{order}{kind}{tags[_BITS][0] // 8}")
    grid = grid.reshape(n, height, width)[band] if tags.get(_PLANAR, (1,))[0] == 2 else grid.reshape(height, width, n)[:, :, band]
    res, tie = tags[_PIXEL_SCALE][0], tags[_TIEPOINT]
    nodata = float(tags[_NODATA_TAG][0]) if _NODATA_TAG in tags else None
    return grid.astype(float), tie[3] - tie[0] * res, tie[4] + tie[1] * res, res, nodata


def _load_tiff(spark: SparkSession, path: str, band: str | int) -> DataFrame:
    tags, _ = _tiff_tags(head(spark, path, 1 << 24))
    number, name = (band - 1, f"band{band}") if isinstance(band, int) else (0, band)
    if isinstance(band, str) and _METADATA in tags and (f">{band}<" in tags[_METADATA][0]):
        number = tags[_METADATA][0].split(f">{band}<")[0].count("<Item") - 1
    res = tags[_PIXEL_SCALE][0]

    def run(batches):
        for batch in batches:
            for raw in batch["content"]:
                grid, left, top, _, nodata = parse_tiff(bytes(raw), number)
                c0, r1 = _on_lattice(left, res), _on_lattice(top, res) - 1
                i, j = np.nonzero(~np.isnan(grid) & ((grid != nodata) if nodata is not None else True))
                yield pd.DataFrame({"col": j + c0, "row": r1 - i, name: grid[i, j]})

    cells = binary_files(spark, path).mapInPandas(run, f"col long, row long, `{name}` double")
    return with_centre(cells, res).select("col", "row", "x", "y", name)
