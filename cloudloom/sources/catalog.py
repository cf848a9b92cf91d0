"""File collections: virtual catalogues (VPC), octree hierarchies (EPT), and tile tables."""

from __future__ import annotations

import json
import posixpath
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import binary_files, read_text, write_text

CATALOG = "id string, path string, npoints long, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, epsg int"


def read_vpc(spark: SparkSession, path: str) -> DataFrame:
    """The files of a virtual catalogue: id, path, number of points, box, EPSG code."""
    doc = json.loads(read_text(spark, path))
    if doc.get("type") != "FeatureCollection":
        raise ValueError("a virtual catalogue is a FeatureCollection")
    rows = []
    for feature in doc["features"]:
        if feature.get("stac_version") != "1.0.0":
            raise ValueError(f"STAC version {feature.get('stac_version')} is not read")
        props, box = feature.get("properties", {}), feature["bbox"]
        href = next(iter(feature["assets"].values()))["href"]
        if "://" not in href and not href.startswith("/"):
            href = posixpath.normpath(posixpath.join(posixpath.dirname(path), href))
        box = box if len(box) == 6 else [box[0], box[1], 0.0, box[2], box[3], 0.0]
        native = props.get("proj:bbox")
        if native:
            box = native if len(native) == 6 else [native[0], native[1], box[2], native[2], native[3], box[5]]
        rows.append((feature.get("id"), href, props.get("pc:count"), *map(float, box), props.get("proj:epsg")))
    return spark.createDataFrame(rows, CATALOG)


def read_vpc_points(spark: SparkSession, path: str, conditions=None, **clip) -> DataFrame:
    """The points of a catalogue's files: LAS, PCD or Parquet, one kind in a catalogue.

    With a rectangle or a circle, files whose box in the catalogue lies outside are not opened.
    """
    from ..functions.predicates import all_of
    from .las import Clip, read_las
    from .pcd import read_pcd

    files = [(r["path"], (r["xmin"], r["ymin"], r["xmax"], r["ymax"])) for r in read_vpc(spark, path).toLocalIterator()]
    kinds = {name.rsplit(".", 1)[-1].lower() for name, _ in files}
    if len(kinds) != 1 or not kinds <= {"las", "pcd", "parquet"}:
        raise ValueError(f"a catalogue's files must be all LAS, PCD or Parquet, not {sorted(kinds)}")
    own = Clip(clip.get("rectangle"), clip.get("circle"), clip.get("buffer", 0.0)) if clip.get("rectangle") or clip.get("circle") else None
    wanted = [name for name, box in files if own is None or not own.misses(box)] or [files[0][0]]
    kind = kinds.pop()
    if kind == "las":
        return read_las(spark, wanted, conditions, **clip)
    df = read_pcd(spark, wanted) if kind == "pcd" else spark.read.parquet(*wanted)
    return clipped(df.where(all_of(df, conditions)), own)


def clipped(df: DataFrame, clip) -> DataFrame:
    """Points within a clip, as expressions."""
    if clip is None:
        return df
    x0, y0, x1, y1 = clip.box
    near = F.col("X").between(x0, x1) & F.col("Y").between(y0, y1)
    if clip.circle:
        x, y, r = clip.circle
        near &= (F.col("X") - x) * (F.col("X") - x) + (F.col("Y") - y) * (F.col("Y") - y) <= (r + clip.buffer) ** 2
    return df.where(near)


def gps_date(seconds: float) -> tuple[int, int] | None:
    """(year, day of the year) of an adjusted standard GPS time; None for 0, which is no time."""
    if not seconds:
        return None
    day = datetime(1980, 1, 6) + timedelta(seconds=seconds + 1e9)
    return day.year, day.timetuple().tm_yday


def write_vpc(catalog: DataFrame, path: str, epsg: int, absolute_path: bool = False, use_gpstime: bool = False) -> None:
    """A virtual catalogue of a file table: one feature per file (files, not points, go to the driver).

    A file's date comes from its columns ``year`` and ``day``, or, with ``use_gpstime``, from
    ``gpstime`` (the adjusted standard time of its first point), where there are such columns.
    """
    if not path.endswith(".vpc"):
        raise ValueError("a virtual catalogue's name ends in .vpc")
    if not epsg:
        raise ValueError("a virtual catalogue needs a reference system")
    features = []
    for r in catalog.toLocalIterator():
        href = r["path"] if absolute_path else "./" + posixpath.relpath(r["path"], posixpath.dirname(path))
        ring = [[r["xmin"], r["ymin"]], [r["xmax"], r["ymin"]], [r["xmax"], r["ymax"]], [r["xmin"], r["ymax"]], [r["xmin"], r["ymin"]]]
        box = [r[c] for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")]
        have = r.asDict()
        date = gps_date(have.get("gpstime") or 0.0) if use_gpstime else None
        date = date or ((have["year"], have["day"]) if have.get("year") and have.get("day") else None)
        when = {"datetime": (datetime(date[0], 1, 1) + timedelta(days=date[1] - 1)).strftime("%Y-%m-%dT00:00:00Z")} if date else {}
        features.append(
            {
                "type": "Feature", "stac_version": "1.0.0", "id": r["id"], "geometry": {"type": "Polygon", "coordinates": [ring]}, "bbox": box,
                "properties": {"pc:count": r["npoints"], "pc:type": "lidar", "proj:epsg": epsg, "proj:bbox": box} | when, "assets": {"data": {"href": href, "roles": ["data"]}},
            }
        )
    write_text(catalog.sparkSession, path, json.dumps({"type": "FeatureCollection", "features": features}, indent=1))


def read_ept(spark: SparkSession, folder: str, depth: int = -1, box: tuple[float, ...] | None = None) -> DataFrame:
    """The nodes of an octree hierarchy, pruned by depth and by a box (xmin, ymin, xmax, ymax).

    Columns: key, depth, npoints, the node's cube, and the path of its data.
    """
    meta = json.loads(read_text(spark, f"{folder}/ept.json"))
    x0, y0, z0, x1, _, _ = meta["bounds"]
    side = x1 - x0
    suffix = {"laszip": "laz", "binary": "bin", "zstandard": "zst"}[meta["dataType"]]
    rows, pages = [], ["0-0-0-0"]
    while pages:
        page = json.loads(read_text(spark, f"{folder}/ept-hierarchy/{pages.pop()}.json"))
        for key, count in page.items():
            d, i, j, k = map(int, key.split("-"))
            s = side / 2**d
            cube = (x0 + i * s, y0 + j * s, z0 + k * s, x0 + (i + 1) * s, y0 + (j + 1) * s, z0 + (k + 1) * s)
            if depth >= 0 and d > depth:
                continue
            if box and (cube[0] > box[2] or cube[3] < box[0] or cube[1] > box[3] or cube[4] < box[1]):
                continue
            if count == -1:
                pages.append(key)
            else:
                rows.append((key, d, count, *cube, f"{folder}/ept-data/{key}.{suffix}"))
    return spark.createDataFrame(rows, "key string, depth int, npoints long, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, path string")


def read_ept_points(spark: SparkSession, folder: str, depth: int = -1, box: tuple[float, ...] | None = None, conditions=None) -> DataFrame:
    """The points of an octree's nodes, pruned like ``read_ept``, with their ``depth``; a node is one task's work.

    Nodes in the ``binary`` and ``zstandard`` encodings are read; ``laszip`` needs a codec.
    """
    from ..functions.attributes import canonical
    from ..functions.predicates import all_of

    meta = json.loads(read_text(spark, f"{folder}/ept.json"))
    how = meta["dataType"]
    if how not in ("binary", "zstandard"):
        raise ValueError(f"nodes are {how}; only binary and zstandard ones are read")
    letters = {"signed": "i", "unsigned": "u", "float": "f"}
    fields = [(canonical(d["name"]), f"<{letters[d['type']]}{d['size']}", d.get("scale", 1.0), d.get("offset", 0.0)) for d in meta["schema"]]
    columns = ", ".join(f"`{n}` {'double' if t[1] == 'f' or s != 1.0 else 'long'}" for n, t, s, _ in fields)
    nodes = [r["path"] for r in read_ept(spark, folder, depth, box).where("npoints > 0").toLocalIterator()]
    if not nodes:
        return spark.createDataFrame([], f"{columns}, depth int")

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                raw = bytes(raw)
                if how == "zstandard":
                    import zstandard

                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                t = np.frombuffer(raw, dtype=[(n, k) for n, k, _, _ in fields])
                out = pd.DataFrame({n: t[n] * s + o if s != 1.0 else t[n] for n, _, s, o in fields})
                level = int(posixpath.basename(name).split("-")[0])
                if box:
                    out = out[(out.X >= box[0]) & (out.X <= box[2]) & (out.Y >= box[1]) & (out.Y <= box[3])]
                yield out.assign(depth=level)

    df = binary_files(spark, nodes).mapInPandas(run, f"{columns}, depth int")
    return df.where(all_of(df, conditions))


def with_depth(df: DataFrame, side: float, max_depth: int = 6, seed: int = 0) -> DataFrame:
    """Points with their level of detail: the first level at which the point comes first in its cell.

    Level d has cells of ``side`` / 2^d on the global lattice.  Cells are nested, so the
    first of a cell is the first of one of its quarters: each level is taken from the
    survivors of the finer one, and one join brings all levels back.  Minima are combined
    before the shuffle, so coarse cells are no hot keys.
    """
    from ..functions.lattice import column_of, row_of
    from ..operators.neighbours import write_once
    from ..operators.sampling import priority

    first = df.select(F.struct(priority(F.col("pid"), seed).alias("p"), "pid", "X", "Y", "Z").alias("o"))
    levels = None
    for d in reversed(range(max_depth)):
        s = side / 2**d
        keys = (column_of(F.col("o.X"), s).alias("i"), row_of(F.col("o.Y"), s).alias("j"), column_of(F.col("o.Z"), s).alias("k"))
        first = write_once(first.groupBy(*keys).agg(F.min("o").alias("o")).select("o"))
        own = first.select("o.pid", F.lit(d).alias("__d"))
        levels = own if levels is None else levels.unionByName(own)
    if levels is None:
        return df.withColumn("depth", F.lit(max_depth))
    levels = levels.groupBy("pid").agg(F.min("__d").alias("__d"))
    return df.join(levels, "pid", "left").withColumn("depth", F.coalesce("__d", F.lit(max_depth))).drop("__d")


def write_points(df: DataFrame, path: str, inputs: list[str] = (), tile: float | None = None, levels: bool = False) -> None:
    """A Parquet cloud, by tile or by level of detail, each sorted by cell; never over one of its inputs."""
    from ..operators.spatial import with_tile

    if any(path.rstrip("/") == i.rstrip("/") for i in inputs):
        raise ValueError("the output is one of the inputs")
    if levels:
        df.repartitionByRange("depth", "X", "Y").sortWithinPartitions("depth", "X", "Y").write.mode("overwrite").partitionBy("depth").parquet(path)
    elif tile:
        tiled = with_tile(df, tile)
        tiled.repartitionByRange("tile_x", "tile_y", "X").sortWithinPartitions("tile_x", "tile_y", "X", "Y").write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
