"""Vector features as GeoJSON: points, lines, boxes, triangles and rings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import write_file


def _geometry(df: DataFrame) -> tuple[Column, set[str]]:
    """The geometry that a table's columns describe, and the columns that it uses up."""
    have = set(df.columns)
    at = lambda *names: F.array(*[F.col(n).cast("double") for n in names])
    shape = lambda kind, coordinates: F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    if "ring" in have:
        return shape("Polygon", F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))), {"ring"}
    if {"ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"} <= have:
        corners = F.array(at("ax", "ay", "az"), at("bx", "by", "bz"), at("cx", "cy", "cz"), at("ax", "ay", "az"))
        return shape("Polygon", F.array(corners)), {f"{v}{c}" for v in "abc" for c in "xyz"}
    if {"x1", "y1", "x2", "y2"} <= have:
        return shape("LineString", F.array(at("x1", "y1"), at("x2", "y2"))), {"x1", "y1", "x2", "y2"}
    if {"xmin", "ymin", "xmax", "ymax"} <= have:
        box = F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmax", "ymax"), at("xmin", "ymax"), at("xmin", "ymin"))
        return shape("Polygon", F.array(box)), {"xmin", "ymin", "xmax", "ymax"}
    if {"x", "y", "z"} <= have:
        return shape("Point", at("x", "y", "z")), {"x", "y", "z"}
    if {"X", "Y", "Z"} <= have:
        return shape("Point", at("X", "Y", "Z")), {"X", "Y", "Z"}
    raise ValueError("no columns of the table describe a geometry")


def features(df: DataFrame) -> DataFrame:
    """(feature): one GeoJSON feature a row, with all other columns as properties; a fid counts once."""
    if "fid" in df.columns:
        df = df.dropDuplicates(["fid"])
    geometry, used = _geometry(df)
    rest = [c for c in df.columns if c not in used]
    properties = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.create_map().cast("map<string,string>")
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"}).alias("feature"))


def write_vector(df: DataFrame, path: str, epsg: int = 0) -> None:
    """Features as a folder of newline-delimited GeoJSON, or, where the name ends in .geojson, as one collection.

    The folder is written in parallel; the collection by one task, feature after feature.
    """
    rows = features(df)
    if not path.lower().endswith(".geojson"):
        rows.write.mode("overwrite").text(path)
        return
    crs = f'"crs": {{"type": "name", "properties": {{"name": "urn:ogc:def:crs:EPSG::{epsg}"}}}}, ' if epsg else ""

    def run(batches):
        def chunks():
            yield f'{{"type": "FeatureCollection", {crs}"features": ['.encode()
            first = True
            for batch in batches:
                for feature in batch["feature"]:
                    yield (("" if first else ",") + "\n" + feature).encode()
                    first = False
            yield b"\n]}\n"

        write_file(path, chunks())
        yield pd.DataFrame({"path": [path]})

    rows.repartition(1).mapInPandas(run, "path string").collect()
