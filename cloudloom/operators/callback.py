"""User functions on the points of a tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.attributes import ALIASES, canonical, find
from .spatial import with_halo

_STANDARD = tuple(ALIASES)


def exposed(df: DataFrame, expose: str) -> list[str]:
    """Columns that a string of letters names: aliases, digits (n-th extra), ``E`` all extras, ``b`` the buffer flag, ``*`` all."""
    extras = [c for c in df.columns if canonical(c) not in _STANDARD and c != "pid"]
    if expose == "*":
        return [*df.columns, "Buffer"]
    out: list[str] = []
    for letter in expose:
        if letter == "E":
            out += extras
        elif letter == "b":
            out.append("Buffer")
        elif letter.isdigit():
            if not 1 <= int(letter) <= len(extras):
                raise ValueError(f"there is no extra attribute {letter}")
            out.append(extras[int(letter) - 1])
        elif (column := find(df, letter)) is not None:
            out.append(column)
        else:
            raise ValueError(f"there is no attribute {letter!r}")
    return list(dict.fromkeys(out))


def callback(df: DataFrame, function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], expose: str = "xyz", drop_buffer: bool = False, tile: float = 20.0, buffer: float = 0.0) -> DataFrame:
    """The function's arrays, by column, take the place of the tile's; nonzero ``Withheld`` deletes points.

    It gets the exposed columns as arrays of doubles, one call per tile.  A column that was
    not exposed, or another length, is an error.  Points of the halo are seen, not returned.
    """
    names = exposed(df, expose)
    schema, columns = df.schema, df.columns

    def run(own):
        if drop_buffer:
            own = own[~own["is_buffer"]]
        arrays = {n: own["is_buffer" if n == "Buffer" else n].to_numpy().astype(float) for n in names}
        result = function(arrays) or {}
        keep = ~own["is_buffer"].to_numpy()
        own = own[columns].copy()
        for name, values in result.items():
            if name == "Withheld":
                keep = keep & (np.asarray(values) == 0)
            if name == "Buffer" or (name == "Withheld" and name not in columns):
                continue
            if name not in names:
                raise ValueError(f"the function returned {name!r}, which was not exposed")
            if len(values) != len(own):
                raise ValueError(f"the function returned {len(values)} values of {name!r} for {len(own)} points")
            own[name] = np.asarray(values).astype(own[name].dtype)
        return own[keep]

    return with_halo(df, tile, buffer).groupBy("tile_x", "tile_y").applyInPandas(run, schema)


def collect_callback(df: DataFrame, function: Callable[[dict[str, np.ndarray]], dict[str, float]], schema: str, expose: str = "xyz", tile: float = 20.0) -> DataFrame:
    """One row per tile from a function that returns named numbers."""
    names = exposed(df, expose)

    def run(key, own):
        row = function({n: own["is_buffer" if n == "Buffer" else n].to_numpy().astype(float) for n in names})
        return pd.DataFrame([{"tile_x": key[0], "tile_y": key[1], **row}])

    return with_halo(df, tile, 0.0).groupBy("tile_x", "tile_y").applyInPandas(run, f"tile_x long, tile_y long, {schema}")
