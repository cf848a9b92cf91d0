"""Shape of neighbourhoods: eigenvalues of the 3-D covariance in closed form, as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import nearest_neighbours, nearest_reduced, radius_pairs

#: Letters that choose what is returned.
FEATURES = {
    "e": ("lambda1", "lambda2", "lambda3"),
    "a": ("anisotropy",),
    "p": ("planarity",),
    "s": ("sphericity",),
    "l": ("linearity",),
    "o": ("omnivariance",),
    "c": ("curvature",),
    "u": ("eigensum",),
    "i": ("inclination",),
    "n": ("normal_x", "normal_y", "normal_z"),
}


def eigenvalues(a: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Eigenvalues, largest first, of a symmetric matrix with entries xx, yy, zz, xy, xz, yz."""
    q = (a["xx"] + a["yy"] + a["zz"]) / 3.0
    off = a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"]
    dx, dy, dz = a["xx"] - q, a["yy"] - q, a["zz"] - q
    p = F.sqrt((dx * dx + dy * dy + dz * dz + F.lit(2.0) * off) / 6.0)
    det = dx * (dy * dz - a["yz"] * a["yz"]) - a["xy"] * (a["xy"] * dz - a["yz"] * a["xz"]) + a["xz"] * (a["xy"] * a["yz"] - dy * a["xz"])
    r = F.when(p > 0, det / (F.lit(2.0) * p * p * p)).otherwise(F.lit(0.0))
    phi = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))) / 3.0
    big = q + F.lit(2.0) * p * F.cos(phi)
    small = q + F.lit(2.0) * p * F.cos(phi + F.lit(2.0 * math.pi / 3.0))
    return big, F.lit(3.0) * q - big - small, small


def _normal(a: dict[str, Column], smallest: Column) -> tuple[Column, Column, Column]:
    """Unit eigenvector of the smallest eigenvalue: the longest cross product of two rows."""
    rows = [(a["xx"] - smallest, a["xy"], a["xz"]), (a["xy"], a["yy"] - smallest, a["yz"]), (a["xz"], a["yz"], a["zz"] - smallest)]
    candidates = []
    for u, v in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2])):
        x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        candidates.append(F.struct((x * x + y * y + z * z).alias("n"), x.alias("x"), y.alias("y"), z.alias("z")))
    best = F.greatest(*candidates)
    length = F.sqrt(best["n"])
    ok = best["n"] > 0
    return tuple(F.when(ok, best[c] / length).otherwise(F.lit(float(c == "z"))) for c in "xyz")


_PAIRS = {"xx": ("X2", "X2"), "yy": ("Y2", "Y2"), "zz": ("Z2", "Z2"), "xy": ("X2", "Y2"), "xz": ("X2", "Z2"), "yz": ("Y2", "Z2")}


def _covariances(pid, near, d2, held) -> dict:
    """Sample covariances of the neighbours' coordinates, and their number."""
    ok = near >= 0
    n = ok.sum(axis=1)
    xyz = {}
    for c in "XYZ":
        v = np.where(ok, held[c][np.maximum(near, 0)], 0.0)
        xyz[c + "2"] = np.where(ok, v - (v.sum(axis=1) / np.maximum(n, 1))[:, None], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"pid": pid, "n": n} | {name: np.where(n > 1, (xyz[u] * xyz[v]).sum(axis=1) / (n - 1), np.nan) for name, (u, v) in _PAIRS.items()}


def geometry_features(df: DataFrame, k: int = 8, r: float = 0.0, features: str = "aps", always_up: bool = False) -> DataFrame:
    """(pid, features) from the covariance of each point's neighbourhood, itself included.

    The ``k`` nearest, those within ``r``, or the k nearest within r.  Fewer than three
    neighbours give nulls.
    """
    slim = df.select("pid", "X", "Y", "Z")
    pairs = _PAIRS
    if r > 0:
        near = radius_pairs(slim, slim, r) if not k else nearest_neighbours(slim, slim, k, radius=r)
        moments = near.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *[(F.var_samp(u) if u == v else F.covar_samp(u, v)).alias(c) for c, (u, v) in pairs.items()])
    else:
        moments = nearest_reduced(slim, slim, k, _covariances, "pid bigint, n bigint, " + ", ".join(f"{c} double" for c in pairs))
    valid = moments.withColumns({c: F.when(F.col("n") >= 3, F.col(c)) for c in pairs})
    entries = {c: F.col(c) for c in pairs}
    with_values = valid.withColumns(dict(zip(("lambda1", "lambda2", "lambda3"), eigenvalues(entries))))
    with_values = with_values.withColumn("lambda3", F.greatest(F.col("lambda3"), F.when(F.col("lambda3").isNotNull(), F.lit(0.0))))
    l1, l2, l3 = F.col("lambda1"), F.col("lambda2"), F.col("lambda3")
    ratio = lambda x: F.when(l1 > 0, x / l1)
    total = l1 + l2 + l3
    nx, ny, nz = _normal(entries, l3)
    up = F.when(nz < 0, -1.0).otherwise(1.0) if always_up else F.lit(1.0)
    known = l3.isNotNull()
    values = {
        "lambda1": l1, "lambda2": l2, "lambda3": l3,
        "anisotropy": ratio(l1 - l3), "planarity": ratio(l2 - l3), "sphericity": ratio(l3), "linearity": ratio(l1 - l2),
        "omnivariance": F.pow(F.greatest(l1 * l2 * l3, F.lit(0.0)), F.lit(1.0 / 3.0)), "curvature": F.when(total > 0, l3 / total), "eigensum": total,
        "inclination": F.when(known, F.degrees(F.acos(F.least(F.lit(1.0), F.abs(nz))))),
        "normal_x": F.when(known, nx * up), "normal_y": F.when(known, ny * up), "normal_z": F.when(known, nz * up),
    }
    wanted = [n for letter in features for n in FEATURES[letter]]
    return with_values.select("pid", *[values[n].alias(n) for n in wanted])
