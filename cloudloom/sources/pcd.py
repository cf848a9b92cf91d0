"""PCD files, ASCII and binary, as point tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.attributes import canonical
from .files import binary_files, head, named, not_an_input, write_file
from .las import _settled

_KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}


def header_of(raw: bytes) -> tuple[dict[str, list[str]], int]:
    """The header's entries by keyword, and where the data begin."""
    entries: dict[str, list[str]] = {}
    at = 0
    while True:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("the PCD header has no DATA line")
        line, at = raw[at:end].decode("ascii", "replace").strip(), end + 1
        if not line or line.startswith("#"):
            continue
        key, *values = line.split()
        entries[key.upper()] = values
        if key.upper() == "DATA":
            break
    if [f.lower() for f in entries.get("FIELDS", [])[:3]] != ["x", "y", "z"]:
        raise ValueError("x, y and z must be the first fields")
    return entries, at


def parse(raw: bytes) -> pd.DataFrame:
    """All fields in double precision, under their attributes' names."""
    entries, at = header_of(raw)
    names = [canonical(f) for f in entries["FIELDS"]]
    how = entries["DATA"][0].lower()
    if how == "ascii":
        table = np.loadtxt(io.BytesIO(raw[at:]), dtype=float, ndmin=2)
        table = table.reshape(-1, len(names))
        return pd.DataFrame({n: table[:, k] for k, n in enumerate(names)})
    if how != "binary":
        raise ValueError(f"PCD data are {how}; only ascii and binary are read")
    kinds = [_KINDS[t.upper(), int(s)] for t, s in zip(entries["TYPE"], entries["SIZE"])]
    n = int(entries["POINTS"][0]) if "POINTS" in entries else int(entries["WIDTH"][0]) * int(entries["HEIGHT"][0])
    table = np.frombuffer(raw, dtype=list(zip(names, kinds)), count=n, offset=at)
    return pd.DataFrame({c: table[c].astype(float) for c in names})


def read_pcd(spark: SparkSession, path: str | list[str]) -> DataFrame:
    entries, _ = header_of(head(spark, path, 65536))
    schema = ", ".join(f"`{canonical(f)}` double" for f in entries["FIELDS"])

    def run(batches):
        for batch in batches:
            for raw in batch["content"]:
                yield parse(bytes(raw))

    return binary_files(spark, path).mapInPandas(run, schema)


def _order(columns: list[str]) -> list[str]:
    return ["X", "Y", "Z"] + [c for c in columns if c not in ("X", "Y", "Z")]


def top_of(columns: list[str], n: int, binary: bool) -> bytes:
    """The header of ``n`` points, X, Y and Z first."""
    order = _order(columns)
    fields, k = [c.lower() if c in ("X", "Y", "Z") else c for c in order], len(order)
    lines = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", f"FIELDS {' '.join(fields)}", f"SIZE {' '.join(['8'] * k)}", f"TYPE {' '.join(['F'] * k)}", f"COUNT {' '.join(['1'] * k)}", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {'binary' if binary else 'ascii'}"]
    return ("\n".join(lines) + "\n").encode()


def body_of(points: pd.DataFrame, binary: bool) -> bytes:
    table = points[_order(list(points.columns))].to_numpy(dtype="<f8")
    if binary:
        return table.tobytes()
    return "".join(" ".join(repr(float(v)) for v in row) + "\n" for row in table).encode()


def encode(points: pd.DataFrame, binary: bool = True) -> bytes:
    """A PCD file of the points' numeric columns."""
    return top_of(list(points.columns), len(points), binary) + body_of(points, binary)


def write_pcd(df: DataFrame, path: str, by: list[str] = (), binary: bool = True, inputs: list[str] = ()) -> DataFrame:
    """PCD files; returns (path, npoints).

    A star in ``path`` stands for a group's key: one file for each group of ``by``, in
    parallel.  Without a star one task writes all points batch by batch.
    """
    not_an_input(path, inputs)
    if ("*" in path) != bool(by):
        raise ValueError("a star in the path goes with groups, and groups with a star")
    columns = [c for c in df.columns if c not in by]
    schema = "path string, npoints long"
    if by:

        def group(key, own):
            target = named(path, key)
            write_file(target, [encode(own[columns], binary)])
            return pd.DataFrame({"path": [target], "npoints": [len(own)]})

        return _settled(df.groupBy(*by).applyInPandas(group, schema))
    n = df.count()

    def all_points(batches):
        write_file(path, (x for part in ([top_of(columns, n, binary)], (body_of(b[columns], binary) for b in batches)) for x in part))
        yield pd.DataFrame({"path": [path], "npoints": [n]})

    return _settled(df.select(*columns).repartition(1).mapInPandas(all_points, schema))
