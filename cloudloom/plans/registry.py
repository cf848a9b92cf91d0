"""The engine's operators as queries over the driver's tables, with DuckDB counterparts.

Every query runs over its whole table.  ``P`` is the order lines as a point cloud,
``PP`` the same with point ids; both exist as DataFrames and as SQL.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as W
from ..functions.lattice import column_of, row_of
from ..operators import attributes as A
from ..operators import callback as K
from ..operators import geometry as G
from ..operators import ground as C
from ..operators import neighbours as N
from ..operators import raster as R
from ..operators import sampling as S
from ..operators import spatial as T
from ..operators import summary as M
from ..operators import surface as U
from ..operators import tin as I
from ..operators import transform as X
from ..sources import catalog as V
from ..sources.points import event_points, lineitem_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_VIEW = """
    (epoch(l_shipdate) / 86400 - 8035) / CAST(20 AS DOUBLE) + l_quantity / CAST(1000 AS DOUBLE) AS X,
    CAST(l_partkey AS DOUBLE) * CAST(0.05 AS DOUBLE) AS Y,
    l_extendedprice / CAST(1000 AS DOUBLE) AS Z,
    CAST(round(l_discount * 1000) AS INT) AS Intensity,
    l_linenumber AS ReturnNumber,
    CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 9 END AS Classification,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS NumberOfReturns,
    CAST(round(l_tax * 100) AS INT) AS UserData,
    l_suppkey AS PointSourceID"""
P = f"P AS (SELECT {_VIEW} FROM lineitem)"
PP = f"""PP AS (SELECT CAST((l_orderkey * 8 + l_linenumber) * 64 + row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)
    AS BIGINT) AS pid, {_VIEW} FROM lineitem)"""
#: Columns that identify a point in a result, rounded so that both engines print them alike.
_ALL = ["X", "Y", "Z", "Intensity", "ReturnNumber", "Classification", "NumberOfReturns", "UserData", "PointSourceID"]
_XYZ = "round(X, 6) AS X, round(Y, 6) AS Y, round(Z, 6) AS Z"


def _cell(res: float) -> str:
    return f"CAST(floor(X / {res:.1f}::DOUBLE) AS BIGINT) AS col, CAST(ceil(Y / {res:.1f}::DOUBLE) - 1 AS BIGINT) AS row"


def _xy(res: float) -> str:
    return f"round((col + 0.5::DOUBLE) * {res:.1f}::DOUBLE, 6) AS x, round((row + 0.5::DOUBLE) * {res:.1f}::DOUBLE, 6) AS y"


def _nudge(digits: int) -> float:
    """Added before rounding in both engines: means of prices often lie exactly between two results."""
    return 3 * 10.0 ** -(digits + 3)


def near(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double") + F.lit(_nudge(digits)), digits)


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """All doubles rounded; ``own`` gives single columns another number of digits."""
    return df.select(*[near(f"`{n}`", own.get(n, digits)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _nudged(sql: str) -> str:
    """``round(x, n)`` in a text as ``round(x + nudge, n)``."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        depth, comma, k = 1, -1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            comma = k if sql[k] == "," and depth == 1 else comma
            k += 1
        if comma > 0 and sql[comma + 1 : k - 1].strip().isdigit():
            digits = int(sql[comma + 1 : k - 1])
            out += sql[at:comma] + f" + {_nudge(digits)!r}::DOUBLE"
            at = comma
    return out + sql[at:]


def query(name: str, sql: str | None = None):
    """Register a query, with its DuckDB text where SQL can express it."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = _nudged(sql)
        return function

    return add


def _points(name: str, make: Callable[[DataFrame], DataFrame], where: str, columns: list[str] = _ALL) -> None:
    """A query that keeps some rows of the view."""
    text = ", ".join(f"round({c}, 6) AS {c}" if c in "XYZ" else c for c in columns)
    query(name, f"WITH {P} SELECT {text} FROM P WHERE {where}")(lambda spark, d: rounded(make(lineitem_points(spark, d)).select(columns)))


# --- predicates, deletion -----------------------------------------------------------------
_points("filter_between", lambda p: A.filter_points(p, "Z %between% 40 20"), "Z >= 20 AND Z < 40")
_points("filter_compare", lambda p: A.filter_points(p, ["Z > 20", "Intensity <= 50", "UserData != 3"]), "Z > 20 AND Intensity <= 50 AND UserData <> 3")
_points("filter_in", lambda p: A.filter_points(p, "Intensity %in% 10 30 70"), "Intensity IN (10, 30, 70)")
_points("filter_out", lambda p: A.filter_points(p, "Classification %out% 1 2"), "Classification NOT IN (1, 2)")
_points("filter_and", lambda p: A.filter_points(p, ["Classification == 2", "Z >= 50", "r < 4"]), "Classification = 2 AND Z >= 50 AND ReturnNumber < 4")
_points("filter_missing_attr", lambda p: A.filter_points(p, ["plop < 1", "u == 4"]), "UserData = 4")
_points("filter_abs", lambda p: A.filter_points(p.withColumn("Off", F.col("X") - 120.0), "|Off| < 5"), "abs(X - 120) < 5")
_points("filter_rectangle", lambda p: p.where(W.in_rectangle(80, 1, 100, 4)), "X BETWEEN 80 AND 100 AND Y BETWEEN 1 AND 4")
_points("filter_circle", lambda p: p.where(W.in_circle(100, 5, 4)), "(X - 100) * (X - 100) + (Y - 5) * (Y - 5) <= 16")
_points("filter_z_outside", lambda p: p.where(W.drop_z_between(p, 10, 90)), "NOT (Z >= 10 AND Z <= 90)")
_points("filter_z_between", lambda p: A.filter_points(p, W.keep_z_between(10, 90)), "Z >= 10 AND Z <= 90")
_points("filter_aliases", lambda p: A.filter_points(p, ["user_data > 2", "return_number <= 3", "NumberReturns == 1", "point_source_id < 5"]), "UserData > 2 AND ReturnNumber <= 3 AND NumberOfReturns = 1 AND PointSourceID < 5")
_points("delete_points", lambda p: A.delete_points(p, "Classification == 9"), "NOT Classification = 9")
_points("delete_noise", lambda p: A.delete_noise(A.edit_attribute(p, "Classification", 18, "Z > 90")), "NOT Z > 90")
_points("delete_ground", lambda p: A.delete_ground(p), "Classification <> 2")


# --- attributes ---------------------------------------------------------------------------
@query("edit_attribute", f"WITH {P} SELECT {_XYZ}, CASE WHEN Classification = 2 THEN 7 ELSE UserData END AS UserData FROM P")
def _edit(spark, d):
    return rounded(A.edit_attribute(lineitem_points(spark, d), "UserData", 7, "Classification == 2").select("X", "Y", "Z", "UserData"))


@query("edit_clamped", f"WITH {P} SELECT {_XYZ}, CASE WHEN Z > 50 THEN 255 ELSE UserData END AS UserData FROM P")
def _edit_clamped(spark, d):
    return rounded(A.edit_attribute(lineitem_points(spark, d), "u", 300, "Z > 50", kind="uchar").select("X", "Y", "Z", "UserData"))


@query("add_attribute", f"WITH {P} SELECT {_XYZ}, CAST(0 AS INT) AS Height, CAST(0 AS DOUBLE) AS Score FROM P")
def _add(spark, d):
    p = A.add_attribute(A.add_attribute(lineitem_points(spark, d), "int", "Height", "height"), "double", "Score")
    return rounded(p.select("X", "Y", "Z", "Height", "Score"))


@query("keep_attributes", f"WITH {P} SELECT {_XYZ}, Intensity FROM P")
def _keep(spark, d):
    return rounded(A.keep_attributes(lineitem_points(spark, d), ["i", "unknown"]))


@query("remove_attributes", f"WITH {P} SELECT {_XYZ}, Intensity, ReturnNumber, Classification, NumberOfReturns FROM P")
def _remove(spark, d):
    return rounded(A.remove_attributes(lineitem_points(spark, d), ["UserData", "p", "X", "unknown"]))


@query("add_rgb", f"WITH {P} SELECT {_XYZ}, CAST(0 AS INT) AS R, CAST(0 AS INT) AS G, CAST(0 AS INT) AS B FROM P")
def _rgb(spark, d):
    return rounded(A.add_rgb(lineitem_points(spark, d)).select("X", "Y", "Z", "R", "G", "B"))


@query("remove_rgb", f"WITH {P} SELECT {_XYZ} FROM P")
def _no_rgb(spark, d):
    return rounded(A.remove_rgb(A.add_rgb(lineitem_points(spark, d).select("X", "Y", "Z"))))


@query("set_crs", f"WITH {P} SELECT {_XYZ} FROM P")
def _crs(spark, d):
    return rounded(A.set_crs(lineitem_points(spark, d), 26917).select("X", "Y", "Z"))


@query(
    "sort_points_order",
    f"""WITH {PP} SELECT pid, CAST(floor(X / 50::DOUBLE) AS BIGINT) AS col, CAST(ceil(Y / 50::DOUBLE) - 1 AS BIGINT) AS row,
        row_number() OVER (PARTITION BY floor(X / 50::DOUBLE), ceil(Y / 50::DOUBLE) ORDER BY pid) AS place FROM PP""",
)
def _sorted(spark, d):
    from pyspark.sql import Window

    p = A.sort_points(lineitem_points(spark, d, True), 50.0).withColumns({"col": column_of(F.col("X"), 50.0), "row": row_of(F.col("Y"), 50.0)})
    return p.select("pid", "col", "row", F.row_number().over(Window.partitionBy("col", "row").orderBy("pid")).cast("bigint").alias("place"))


@query(
    "stop_if_outside",
    f"""WITH {P} SELECT {_XYZ} FROM P WHERE floor(X / 20::DOUBLE) * 20 <= 110 AND floor(X / 20::DOUBLE) * 20 + 20 >= 90
        AND (ceil(Y / 20::DOUBLE) - 1) * 20 <= 8 AND (ceil(Y / 20::DOUBLE) - 1) * 20 + 20 >= 2""",
)
def _stop(spark, d):
    return rounded(A.stop_if_outside(lineitem_points(spark, d), 90, 2, 110, 8, 20.0).select("X", "Y", "Z"))


@query("stop_if_chunk_id_below", f"WITH {P} SELECT {_XYZ} FROM P WHERE floor(X / 20::DOUBLE) - 2 >= 3")
def _stop_below(spark, d):
    return rounded(A.stop_if_chunk_id_below(lineitem_points(spark, d), 4, column_of(F.col("X"), 20.0) - 2).select("X", "Y", "Z"))


@query("nothing", f"WITH {P} SELECT {_XYZ} FROM P")
def _nothing(spark, d):
    return rounded(A.nothing(lineitem_points(spark, d)).select("X", "Y", "Z"))


@query(
    "info",
    f"""WITH {P} SELECT count(*) AS npoints, round(min(X), 6) AS min_x, round(max(X), 6) AS max_x, round(min(Y), 6) AS min_y, round(max(Y), 6) AS max_y,
        round(min(Z), 6) AS min_z, round(max(Z), 6) AS max_z, round((max(X) - min(X)) * (max(Y) - min(Y)), 4) AS area,
        round(count(*) / ((max(X) - min(X)) * (max(Y) - min(Y))), 6) AS density FROM P""",
)
def _info(spark, d):
    return rounded(A.info(lineitem_points(spark, d)).drop("schema"), area=4)


@query("union_points", f"WITH {P} SELECT {_XYZ}, Intensity FROM P WHERE Classification = 2 UNION ALL SELECT {_XYZ}, 0 AS Intensity FROM P WHERE Classification = 9")
def _union(spark, d):
    p = lineitem_points(spark, d)
    a = p.where("Classification = 2").select("X", "Y", "Z", "Intensity")
    return rounded(A.union_points(a, p.where("Classification = 9").select("X", "Y", "Z")))


@query("drop_duplicates", f"WITH {P} SELECT DISTINCT {_XYZ} FROM P")
def _distinct(spark, d):
    return rounded(W.drop_duplicates(lineitem_points(spark, d).select("X", "Y", "Z")))


# --- one point per cell, sampling ----------------------------------------------------------
def _best(attr: str, direction: str, where: str = "true") -> str:
    return f"""WITH {PP}, ranked AS (SELECT pid, {_XYZ}, Intensity, row_number() OVER (
        PARTITION BY floor(X / 2::DOUBLE), ceil(Y / 2::DOUBLE) ORDER BY {attr} {direction}, pid) AS k FROM PP WHERE {where})
        SELECT pid, X, Y, Z, Intensity FROM ranked WHERE k = 1"""


_PICK = ["pid", "X", "Y", "Z", "Intensity"]


@query("filter_grid_min", _best("Z", "ASC"))
def _grid_min(spark, d):
    return rounded(R.filter_with_grid(lineitem_points(spark, d, True), 2.0, "min").select(_PICK))


@query("filter_grid_max", _best("Z", "DESC", "Classification = 2"))
def _grid_max(spark, d):
    return rounded(R.filter_with_grid(lineitem_points(spark, d, True), 2.0, "max", "Classification == 2").select(_PICK))


@query("sampling_pixel_max_intensity", _best("Intensity", "DESC"))
def _pixel_max(spark, d):
    return rounded(S.sampling_pixel(lineitem_points(spark, d, True), 2.0, "max", "i").select(_PICK))


def _random(keys: str, where: str = "true") -> str:
    return f"""WITH {PP}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys}
        ORDER BY ((pid % 4294967296) * 2654435761) % 4294967296, pid) AS k FROM PP WHERE {where})
        SELECT pid, {_XYZ} FROM ranked WHERE k = 1"""


@query("sampling_pixel_random", _random("floor(X / 5::DOUBLE), ceil(Y / 5::DOUBLE)"))
def _pixel_random(spark, d):
    return rounded(S.sampling_pixel(lineitem_points(spark, d, True), 5.0).select("pid", "X", "Y", "Z"))


@query("sampling_pixel_filtered", _random("floor(X / 5::DOUBLE), ceil(Y / 5::DOUBLE)", "Classification = 1") + f" UNION ALL SELECT pid, {_XYZ} FROM PP WHERE Classification <> 1")
def _pixel_filtered(spark, d):
    return rounded(S.sampling_pixel(lineitem_points(spark, d, True), 5.0, conditions="Classification == 1").select("pid", "X", "Y", "Z"))


@query("sampling_voxel_random", _random("floor(X / 5::DOUBLE), floor(Y / 5::DOUBLE), floor(Z / 5::DOUBLE)"))
def _voxel_random(spark, d):
    return rounded(S.sampling_voxel(lineitem_points(spark, d, True), 5.0).select("pid", "X", "Y", "Z"))


@query("poisson")
def _poisson(spark, d):
    return rounded(S.sampling_poisson(_slim(spark, d), 2.0))


# --- rasters and metrics -------------------------------------------------------------------
def _raster_sql(res: float, bands: str, where: str = "true", having: str = "") -> str:
    return f"WITH {P}, cells AS (SELECT *, {_cell(res)} FROM P WHERE {where}) SELECT col, row, {_xy(res)}, {bands} FROM cells GROUP BY col, row {having}"


def _raster(name: str, bands: str, metrics: list[str], res: float = 2.0, where: str = "true", **options) -> None:
    query(name, _raster_sql(res, bands, where))(lambda spark, d: rounded(R.rasterize(lineitem_points(spark, d), res, metrics, **options)))


def _q(attr: str, p: float) -> str:
    return f"round(quantile_cont({attr}, {p}), 6)"


_raster("rasterize_basic", 'round(max(Z), 6) AS z_max, round(min(Z), 6) AS z_min, count(*) AS "count"', ["z_max", "z_min", "count"])
_raster(
    "rasterize_all_metrics",
    """round(avg(Z), 6) AS z_mean, round(quantile_cont(Z, 0.5), 6) AS z_median, round(stddev_samp(Z), 6) AS z_sd,
    round(CASE WHEN avg(Z) <> 0 THEN stddev_samp(Z) / avg(Z) END, 6) AS z_cv, round(sum(Z), 6) AS z_sum, CAST(sum(Intensity) AS DOUBLE) AS i_sum,
    round(avg(CASE WHEN Z > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS z_above50, CAST(max(ReturnNumber) AS DOUBLE) AS r_max, CAST(0 AS DOUBLE) AS plop_sum""",
    ["z_mean", "z_median", "z_sd", "z_cv", "z_sum", "i_sum", "z_above50", "r_max", "plop_sum"],
)
_raster("rasterize_percentiles", f"{_q('Z', 0.05)} AS z_p5, {_q('Z', 0.25)} AS z_p25, {_q('Z', 0.5)} AS z_p50, {_q('Z', 0.95)} AS z_p95, {_q('Intensity::DOUBLE', 0.9)} AS i_p90", ["z_p5", "z_p25", "z_p50", "z_p95", "i_p90"], 5.0)


@query(
    "rasterize_moments",
    f"""WITH {P}, cells AS (SELECT *, {_cell(5.0)} FROM P), means AS (SELECT *, avg(Z) OVER (PARTITION BY col, row) AS m FROM cells),
        moments AS (SELECT col, row, count(*) AS n, avg((Z - m) * (Z - m)) AS m2, avg((Z - m) * (Z - m) * (Z - m)) AS m3, avg((Z - m) * (Z - m) * (Z - m) * (Z - m)) AS m4 FROM means GROUP BY col, row)
        SELECT col, row, {_xy(5.0)}, round(CASE WHEN n > 1 AND m2 > 0 THEN m3 / pow(m2, 1.5) END, 5) AS z_skew, round(CASE WHEN n > 1 AND m2 > 0 THEN m4 / (m2 * m2) END, 5) AS z_kurt FROM moments""",
)
def _moments(spark, d):
    return rounded(R.rasterize(lineitem_points(spark, d), 5.0, ["z_skew", "z_kurt"]), z_skew=5, z_kurt=5)


@query(
    "rasterize_mode",
    f"""WITH {P}, counted AS (SELECT {_cell(5.0)}, CAST(Intensity AS DOUBLE) AS v, count(*) AS n FROM P GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY col, row ORDER BY n DESC, v) AS k FROM counted)
        SELECT col, row, {_xy(5.0)}, v AS i_mode FROM ranked WHERE k = 1""",
)
def _mode(spark, d):
    return rounded(R.rasterize(lineitem_points(spark, d), 5.0, ["i_mode"]))


@query(
    "rasterize_baba",
    f"""WITH {P}, wide AS (SELECT Z, unnest(range(CAST(floor((X - 2) / 2::DOUBLE) AS BIGINT), CAST(floor((X + 2) / 2::DOUBLE) AS BIGINT) + 1)) AS col, Y FROM P),
        cells AS (SELECT Z, col, unnest(range(CAST(ceil((Y - 2) / 2::DOUBLE) - 1 AS BIGINT), CAST(ceil((Y + 2) / 2::DOUBLE) AS BIGINT))) AS row FROM wide)
        SELECT col, row, {_xy(2.0)}, round(avg(Z), 6) AS z_mean, round(max(Z), 6) AS z_max FROM cells GROUP BY col, row""",
)
def _baba(spark, d):
    return rounded(R.rasterize(lineitem_points(spark, d), 2.0, ["z_mean", "z_max"], window=6.0))


@query(
    "rasterize_default_value",
    _raster_sql(2.0, "round(coalesce(max(Z) FILTER (WHERE Classification = 2), 0), 6) AS z_max, round(coalesce(avg(Z) FILTER (WHERE Classification = 2), 0), 6) AS z_mean"),
)
def _default(spark, d):
    return rounded(R.rasterize(lineitem_points(spark, d), 2.0, ["z_max", "z_mean"], "Classification == 2", default_value=0.0))


_raster("rasterize_filtered", 'round(max(Z), 6) AS z_max, count(*) AS "count"', ["z_max", "count"], where="Classification = 2 AND Z < 60", conditions=["Classification == 2", "Z < 60"])


@query("aggregate_expr", _raster_sql(5.0, "round(avg(Z) / avg(Intensity + 1), 6) AS ratio, round(max(Z) - min(Z), 6) AS span"))
def _expr(spark, d):
    return rounded(R.aggregate_expressions(lineitem_points(spark, d), 5.0, ratio=F.avg("Z") / F.avg(F.col("Intensity") + 1), span=F.max("Z") - F.min("Z")))


@query("aggregate_function", _raster_sql(5.0, "round(avg(Z), 6) AS mean, round(max(Z), 6) AS top"))
def _function(spark, d):
    return rounded(R.aggregate_function(lineitem_points(spark, d).select("X", "Y", "Z"), 5.0, lambda p: {"mean": p["Z"].mean(), "top": p["Z"].max()}, ["mean", "top"]))


def _focal_sql(size: float, f: str, res: float = 2.0) -> str:
    shifts = ", ".join(f"({i}, {j})" for i, j in R.offsets_within(size, res))
    return f"""WITH {P}, base AS (SELECT {_cell(res)}, max(Z) AS v FROM P GROUP BY ALL), shifts(i, j) AS (VALUES {shifts}),
        box AS (SELECT min(col) AS c0, max(col) AS c1, min(row) AS r0, max(row) AS r1 FROM base),
        wide AS (SELECT col + i AS col, row + j AS row, v FROM base, shifts)
        SELECT col, row, {_xy(res)}, round({f}, 6) AS z_max FROM wide, box WHERE col BETWEEN c0 AND c1 AND row BETWEEN r0 AND r1 GROUP BY col, row"""


for _name, _f in (("mean", "avg(v)"), ("median", "quantile_cont(v, 0.5)"), ("max", "max(v)"), ("min", "min(v)"), ("sum", "sum(v)")):

    @query(f"focal_{_name}", _focal_sql(6.0, _f))
    def _focal(spark, d, name=_name):
        return rounded(R.focal(R.rasterize(lineitem_points(spark, d), 2.0, ["z_max"]), 6.0, 2.0, name))


# --- summaries, plots, tiles ----------------------------------------------------------------
@query(
    "summarise",
    f"""WITH {P} SELECT 'npoints' AS section, 0::DOUBLE AS key, count(*) AS value FROM P
        UNION ALL SELECT 'nsingle', 0, count(*) FROM P WHERE NumberOfReturns = 1
        UNION ALL SELECT 'return', ReturnNumber, count(*) FROM P GROUP BY ReturnNumber
        UNION ALL SELECT 'class', Classification, count(*) FROM P GROUP BY Classification
        UNION ALL SELECT 'z_histogram', floor(Z / 2::DOUBLE) * 2, count(*) FROM P GROUP BY floor(Z / 2::DOUBLE)
        UNION ALL SELECT 'i_histogram', floor(Intensity / 50::DOUBLE) * 50, count(*) FROM P GROUP BY floor(Intensity / 50::DOUBLE)""",
)
def _summarise(spark, d):
    return M.summarise(lineitem_points(spark, d))


@query("summarise_zhist", f"WITH {P} SELECT floor(Z / 5::DOUBLE) * 5 AS key, count(*) AS value FROM P GROUP BY floor(Z / 5::DOUBLE)")
def _zhist(spark, d):
    return M.histogram(lineitem_points(spark, d), "Z", 5.0)


@query(
    "summarise_zhist_dense",
    f"""WITH {P}, bins AS (SELECT CAST(floor(Z / 0.5::DOUBLE) AS BIGINT) AS bin, count(*) AS value FROM P GROUP BY bin),
        ends AS (SELECT min(bin) AS lo, max(bin) AS hi FROM bins), every AS (SELECT unnest(range(lo, hi + 1)) AS bin FROM ends)
        SELECT every.bin * 0.5::DOUBLE AS key, coalesce(value, 0) AS value FROM every LEFT JOIN bins ON every.bin = bins.bin""",
)
def _zhist_dense(spark, d):
    return M.histogram(lineitem_points(spark, d), "Z", 0.5, dense=True)


@query(
    "summarise_by_tile",
    f"""WITH {P} SELECT CAST(floor(X / 20::DOUBLE) AS BIGINT) AS tile_x, CAST(ceil(Y / 20::DOUBLE) - 1 AS BIGINT) AS tile_y, count(*) AS "count",
        round(avg(Z), 6) AS z_mean, round(max(Intensity), 6)::DOUBLE AS i_max FROM P GROUP BY tile_x, tile_y""",
)
def _by_tile(spark, d):
    return rounded(M.metrics_by(T.with_tile(lineitem_points(spark, d), 20.0), ["tile_x", "tile_y"], ["count", "z_mean", "i_max"]))


_PLOTS = [(0, 80.0, 5.0, 3.0), (1, 120.0, 5.0, 3.0), (2, 900.0, 5.0, 3.0), (3, 100.0, 2.0, 4.5), (4, 101.0, 3.0, 4.5)]
_BOXES = [(0, 80.0, 1.0, 90.0, 4.0), (1, 85.0, 2.0, 95.0, 6.0), (2, 900.0, 0.0, 910.0, 5.0)]
_CIRCLES_SQL = "plots(query_id, xc, yc, r) AS (VALUES " + ", ".join(f"({q}, {x}::DOUBLE, {y}::DOUBLE, {r}::DOUBLE)" for q, x, y, r in _PLOTS) + ")"
_BOXES_SQL = "plots(query_id, xmin, ymin, xmax, ymax) AS (VALUES " + ", ".join(f"({q}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for q, a, b, c, e in _BOXES) + ")"
_IN_CIRCLE = "(X - xc) * (X - xc) + (Y - yc) * (Y - yc) <= r * r"


@query("plots_circle", f"WITH {P}, {_CIRCLES_SQL} SELECT query_id, {_XYZ} FROM P, plots WHERE {_IN_CIRCLE}")
def _circle(spark, d):
    return rounded(T.in_circles(lineitem_points(spark, d), T.circles(spark, _PLOTS)).select("query_id", "X", "Y", "Z"))


@query("plots_rectangle", f"WITH {P}, {_BOXES_SQL} SELECT query_id, {_XYZ} FROM P, plots WHERE X BETWEEN xmin AND xmax AND Y BETWEEN ymin AND ymax")
def _rectangle(spark, d):
    return rounded(T.in_rectangles(lineitem_points(spark, d), T.rectangles(spark, _BOXES)).select("query_id", "X", "Y", "Z"))


@query(
    "plot_metrics",
    f"""WITH {P}, {_CIRCLES_SQL} SELECT query_id, count(*) AS "count", round(avg(Z), 6) AS z_mean, round(quantile_cont(Z, 0.95), 6) AS z_p95, round(stddev_samp(Z), 6) AS z_sd
        FROM P, plots WHERE {_IN_CIRCLE} GROUP BY query_id""",
)
def _plot_metrics(spark, d):
    return rounded(M.metrics_by(T.in_circles(lineitem_points(spark, d), T.circles(spark, _PLOTS)), ["query_id"], ["count", "z_mean", "z_p95", "z_sd"]))


@query("chunk_counts", f"WITH {P} SELECT CAST(floor(X / 20::DOUBLE) AS BIGINT) AS tile_x, CAST(ceil(Y / 20::DOUBLE) - 1 AS BIGINT) AS tile_y, count(*) AS npoints FROM P GROUP BY ALL")
def _chunks(spark, d):
    return T.with_tile(lineitem_points(spark, d), 20.0).groupBy("tile_x", "tile_y").agg(F.count("*").alias("npoints"))


@query(
    "noprocess_buffer",
    f"""WITH {P}, shifts(i, j) AS (SELECT a.i, b.j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
        wide AS (SELECT X, Y, CAST(floor(X / 20::DOUBLE) AS BIGINT) + i AS tile_x, CAST(ceil(Y / 20::DOUBLE) - 1 AS BIGINT) + j AS tile_y, (i = 0 AND j = 0) AS core FROM P, shifts),
        near AS (SELECT * FROM wide WHERE core OR (X >= tile_x * 20 - 2 AND X <= tile_x * 20 + 22 AND Y >= tile_y * 20 - 2 AND Y <= tile_y * 20 + 22))
        SELECT tile_x, tile_y, count(*) FILTER (core) AS npoints, count(*) FILTER (NOT core) AS nbuffer FROM near GROUP BY tile_x, tile_y
        HAVING count(*) FILTER (core) > 0 AND tile_x <> 4""",
)
def _noprocess(spark, d):
    return T.halo_counts(lineitem_points(spark, d).select("X", "Y"), 20.0, 2.0, noprocess=F.col("tile_x") == 4)


@query(
    "hull_bbox",
    f"""WITH {P} SELECT CAST(floor(X / 20::DOUBLE) AS BIGINT) AS tile_x, CAST(ceil(Y / 20::DOUBLE) - 1 AS BIGINT) AS tile_y,
        round(min(X), 6) AS xmin, round(min(Y), 6) AS ymin, round(max(X), 6) AS xmax, round(max(Y), 6) AS ymax FROM P GROUP BY tile_x, tile_y""",
)
def _hull_bbox(spark, d):
    return rounded(M.bounding_boxes(T.with_tile(lineitem_points(spark, d), 20.0), ["tile_x", "tile_y"]))


# --- neighbourhoods -------------------------------------------------------------------------
def _slim(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Points with the columns that a query returns: operators in Python carry all that they get."""
    return lineitem_points(spark, d, True).select("pid", "X", "Y", "Z", *more)


@query(
    "ivf",
    f"""WITH {PP}, vox AS (SELECT pid, Classification, CAST(floor(X / 2::DOUBLE) AS BIGINT) AS a, CAST(floor(Y / 2::DOUBLE) AS BIGINT) AS b, CAST(floor(Z / 2::DOUBLE) AS BIGINT) AS c FROM PP),
        n AS (SELECT a, b, c, count(*) AS n FROM vox GROUP BY a, b, c), s(d) AS (VALUES (-1), (0), (1)),
        spread AS (SELECT a + i.d AS a, b + j.d AS b, c + k.d AS c, n FROM n, s i, s j, s k WHERE NOT (i.d = 0 AND j.d = 0 AND k.d = 0)),
        total AS (SELECT a, b, c, sum(n) AS n FROM spread GROUP BY a, b, c)
        SELECT pid, CASE WHEN coalesce(total.n, 0) < 6 THEN 18 ELSE Classification END AS Classification FROM vox LEFT JOIN total USING (a, b, c)""",
)
def _ivf(spark, d):
    return N.classify_with_ivf(_slim(spark, d, "Classification"), 2.0, 6).select("pid", "Classification")


def _hash_pairs(h: float, dims: int = 3) -> str:
    """SQL: pairs (pid, pid2, d2, and the second point's columns) at most h apart, by cells of side h."""
    axes = [("X", f"CAST(floor(X / {h}::DOUBLE) AS BIGINT)"), ("Y", f"CAST(floor(Y / {h}::DOUBLE) AS BIGINT)"), ("Z", f"CAST(floor(Z / {h}::DOUBLE) AS BIGINT)")][:dims]
    cells = ", ".join(f"{e} AS c{a}" for a, e in axes)
    d2 = " + ".join(f"(p.{a} - q.{a}) * (p.{a} - q.{a})" for a, _ in axes)
    on = " AND ".join(f"p.c{a} + s.d{a} = q.c{a}" for a, _ in axes)
    shifts = "SELECT " + ", ".join(f"{a}.d AS d{a}" for a, _ in axes) + " FROM " + ", ".join(f"(VALUES (-1), (0), (1)) {a}(d)" for a, _ in axes)
    return f"""cells AS (SELECT *, {cells} FROM PP), shifts AS ({shifts}),
        pairs AS (SELECT p.pid, q.pid AS pid2, {d2} AS d2, q.X AS X2, q.Y AS Y2, q.Z AS Z2, p.X AS X1, p.Y AS Y1, p.Z AS Z1, q.Intensity AS i2
                  FROM cells p, shifts s, cells q WHERE {on} AND {d2} <= {h * h}::DOUBLE)"""


@query(
    "ipf",
    f"""WITH {PP}, {_hash_pairs(1.0)}, n AS (SELECT pid, count(*) AS n FROM pairs GROUP BY pid)
        SELECT pid, CASE WHEN n <= 2 THEN 18 ELSE Classification END AS Classification FROM PP JOIN n USING (pid)""",
)
def _ipf(spark, d):
    return N.classify_with_ipf(_slim(spark, d, "Classification"), 1.0, 1).select("pid", "Classification")


def _knn(k: int, with_self: bool) -> str:
    own = "true" if with_self else "pid <> pid2"
    return f"""{_hash_pairs(9.0)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, pid2) AS k FROM pairs WHERE {own}),
        near AS (SELECT * FROM ranked WHERE k <= {k})"""


@query("knn", f"WITH {PP}, {_knn(3, True)} SELECT pid, pid2, CAST(k AS INT) AS rank, round(sqrt(d2), 6) AS distance FROM near")
def _knn_query(spark, d):
    p = _slim(spark, d)
    found = N.nearest_neighbours(p, p, 3, places=False)
    return found.select("pid", "pid2", F.col("rank").cast("int").alias("rank"), near(F.sqrt("d2")).alias("distance"))


@query(
    "sor",
    f"""WITH {PP}, {_knn(8, False)}, mean AS (SELECT pid, avg(sqrt(d2)) AS m FROM near GROUP BY pid), stat AS (SELECT avg(m) + 3 * stddev_samp(m) AS lim FROM mean)
        SELECT pid, CASE WHEN m > lim THEN 18 ELSE Classification END AS Classification FROM PP LEFT JOIN mean USING (pid), stat""",
)
def _sor(spark, d):
    return N.classify_with_sor(_slim(spark, d, "Classification"), 8, 3).select("pid", "Classification")


_COV = "var_samp(X2) AS xx, var_samp(Y2) AS yy, var_samp(Z2) AS zz, covar_samp(X2, Y2) AS xy, covar_samp(X2, Z2) AS xz, covar_samp(Y2, Z2) AS yz"
_EIGEN = f"""cov AS (SELECT pid, {_COV} FROM near GROUP BY pid), q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov),
    p AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
    r AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM p),
    phi AS (SELECT *, acos(least(1, greatest(-1, r))) / 3 AS phi FROM r),
    eig AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + {2 * math.pi / 3!r}) AS l3 FROM phi),
    vals AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM eig)"""


@query(
    "geom_features",
    f"""WITH {PP}, {_knn(8, True)}, {_EIGEN} SELECT pid, round((l1 - l3) / l1, 5) AS anisotropy, round((l2 - l3) / l1, 5) AS planarity, round(l3 / l1, 5) AS sphericity,
        round((l1 - l2) / l1, 5) AS linearity, round(l3 / (l1 + l2 + l3), 5) AS curvature, round(l1 + l2 + l3, 5) AS eigensum FROM vals""",
)
def _features(spark, d):
    return rounded(G.geometry_features(lineitem_points(spark, d, True), 8, features="apslcu"), 5)


@query(
    "geom_inclination",
    f"""WITH {PP}, {_knn(8, True)}, {_EIGEN}, rows AS (SELECT pid, xx - l3 AS a, xy AS b, xz AS c, yy - l3 AS e, yz AS f, zz - l3 AS g FROM vals),
        n AS (SELECT pid, b * f - c * e AS x1, c * b - a * f AS y1, a * e - b * b AS z1, b * g - c * f AS x2, c * c - a * g AS y2, a * f - b * c AS z2,
              e * g - f * f AS x3, f * c - b * g AS y3, b * f - e * c AS z3 FROM rows),
        len AS (SELECT *, x1 * x1 + y1 * y1 + z1 * z1 AS n1, x2 * x2 + y2 * y2 + z2 * z2 AS n2, x3 * x3 + y3 * y3 + z3 * z3 AS n3 FROM n),
        nz AS (SELECT pid, CASE WHEN n1 >= n2 AND n1 >= n3 THEN abs(z1) / sqrt(n1) WHEN n2 >= n3 THEN abs(z2) / sqrt(n2) ELSE abs(z3) / sqrt(n3) END AS nz FROM len)
        SELECT pid, round(degrees(acos(least(1, nz))), 3) AS inclination FROM nz""",
)
def _inclination(spark, d):
    return rounded(G.geometry_features(lineitem_points(spark, d, True), 8, features="i"), 3)


_LM = f"""beaten AS (SELECT DISTINCT pid FROM pairs WHERE d2 < 2.25 AND (Z2 > Z1 OR (Z2 = Z1 AND pid2 < pid AND (X2 <> X1 OR Y2 <> Y1)))),
    lm AS (SELECT * FROM PP WHERE Z >= 2 AND pid NOT IN (SELECT pid FROM beaten))"""


@query("local_max_points", f"WITH {PP}, {_hash_pairs(1.5, 2)}, {_LM} SELECT pid, {_XYZ} FROM lm")
def _local_max(spark, d):
    return rounded(N.local_maximum(_slim(spark, d), 3.0, 2.0))


@query("local_max_flag", f"WITH {PP}, {_hash_pairs(1.5, 2)}, {_LM} SELECT PP.pid, CASE WHEN lm.pid IS NULL THEN 0 ELSE 1 END AS is_maximum FROM PP LEFT JOIN lm USING (pid)")
def _local_max_flag(spark, d):
    return N.local_maximum_flag(_slim(spark, d), 3.0, 2.0).select("pid", "is_maximum")


@query(
    "local_max_raster",
    f"""WITH {P}, cells AS (SELECT *, {_cell(1.0)} FROM P), base AS (SELECT col, row, max(Z) AS v FROM cells GROUP BY col, row),
        PP AS (SELECT row * 4294967296 + ((col % 4294967296) + 4294967296) % 4294967296 AS pid, col + 0.5::DOUBLE AS X, row + 0.5::DOUBLE AS Y, round(v * 1000) / 1000 AS Z, 0 AS Intensity FROM base),
        {_hash_pairs(2.5, 2).replace("cells AS", "hashed AS").replace("FROM cells p, shifts s, cells q", "FROM hashed p, shifts s, hashed q")},
        beaten AS (SELECT DISTINCT pid FROM pairs WHERE d2 < 6.25 AND (Z2 > Z1 OR (Z2 = Z1 AND pid2 < pid AND (X2 <> X1 OR Y2 <> Y1))))
        SELECT pid AS fid, X AS x, Y AS y, round(Z, 3) AS z FROM PP WHERE Z >= 2 AND pid NOT IN (SELECT pid FROM beaten)""",
)
def _local_max_raster(spark, d):
    return N.local_maximum_raster(R.rasterize(lineitem_points(spark, d), 1.0, ["z_max"]), "z_max", 5.0).withColumn("z", near("z", 3))


@query(
    "neighborhood_metrics",
    f"""WITH {PP}, {_hash_pairs(1.5, 2)}, {_LM}, {_hash_pairs(2.0).replace("cells AS", "cells3 AS").replace("shifts AS", "shifts3 AS").replace("pairs AS", "pairs3 AS").replace("FROM cells p, shifts s, cells q", "FROM cells3 p, shifts3 s, cells3 q")}
        SELECT lm.pid, round(lm.X, 6) AS x, round(lm.Y, 6) AS y, round(lm.Z, 6) AS z, count(*) AS "count", round(avg(Z2), 6) AS z_mean, round(avg(i2), 6) AS i_mean
        FROM lm JOIN pairs3 ON lm.pid = pairs3.pid GROUP BY ALL""",
)
def _neighborhood(spark, d):
    p = lineitem_points(spark, d, True)
    return rounded(N.neighborhood_metrics(N.local_maximum(_slim(spark, d), 3.0, 2.0), p, ["count", "z_mean", "i_mean"], k=0, r=2.0))


# --- transformations ------------------------------------------------------------------------
_R5 = f"base AS (SELECT {_cell(5.0)}, avg(Z) AS v FROM PP WHERE Classification = 2 GROUP BY ALL)"


def _ground5(p: DataFrame) -> DataFrame:
    return R.rasterize(p, 5.0, ["z_mean"], "Classification == 2")


@query(
    "transform_raster_nearest",
    f"WITH {PP}, {_R5} SELECT pid, round(Z - v, 6) AS Z FROM PP JOIN base ON CAST(floor(X / 5::DOUBLE) AS BIGINT) = col AND CAST(ceil(Y / 5::DOUBLE) - 1 AS BIGINT) = row",
)
def _nearest(spark, d):
    p = lineitem_points(spark, d, True)
    return rounded(X.transform_with_raster(p, _ground5(p), "z_mean", 5.0, "-", bilinear=False).select("pid", "Z"))


_BILINEAR = f"""WITH {PP}, {_R5}, uv AS (SELECT pid, Z, X / 5::DOUBLE - 0.5::DOUBLE AS u, Y / 5::DOUBLE - 0.5::DOUBLE AS w FROM PP),
    c AS (SELECT *, CAST(floor(u) AS BIGINT) AS c0, CAST(floor(w) AS BIGINT) AS r0 FROM uv), s(i, j) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
    m AS (SELECT pid, Z, v, CASE WHEN i = 1 THEN u - c0 ELSE 1 - (u - c0) END * CASE WHEN j = 1 THEN w - r0 ELSE 1 - (w - r0) END AS wt
          FROM c, s LEFT JOIN base ON col = c0 + i AND row = r0 + j),
    val AS (SELECT pid, any_value(Z) AS Z, CASE WHEN sum(wt) FILTER (v IS NOT NULL) > 0 THEN sum(wt * v) / sum(wt) FILTER (v IS NOT NULL) END AS v FROM m GROUP BY pid)"""


@query("transform_raster_bilinear", f"{_BILINEAR} SELECT pid, round(Z - v, 6) AS Z FROM val WHERE v IS NOT NULL")
def _bilinear(spark, d):
    p = lineitem_points(spark, d, True)
    return rounded(X.transform_with_raster(p, _ground5(p), "z_mean", 5.0).select("pid", "Z"))


@query("transform_raster_set", f"{_BILINEAR} SELECT pid, round(Z, 6) AS Z, round(v, 6) AS Ground FROM val")
def _set(spark, d):
    p = lineitem_points(spark, d, True)
    return rounded(X.transform_with_raster(p, _ground5(p), "z_mean", 5.0, "=", "Ground").select("pid", "Z", "Ground"))


_COS, _SIN = math.cos(math.radians(20)), math.sin(math.radians(20))


@query(
    "transform_matrix",
    f"WITH {P} SELECT round({_COS!r}::DOUBLE * X - {_SIN!r}::DOUBLE * Y + 1000, 5) AS X, round({_SIN!r}::DOUBLE * X + {_COS!r}::DOUBLE * Y + 1000, 5) AS Y, round(Z, 5) AS Z FROM P",
)
def _matrix(spark, d):
    m = X.load_matrix([_COS, -_SIN, 0, 1000, _SIN, _COS, 0, 1000, 0, 0, 1, 0, 0, 0, 0, 1])
    return rounded(X.transform_with_matrix(lineitem_points(spark, d).select("X", "Y", "Z"), m), 5)


@query(
    "lod_depth",
    "WITH "
    + PP
    + ", ord AS (SELECT *, ((pid % 4294967296) * 2654435761) % 4294967296 AS h FROM PP), "
    + ", ".join(
        f"r{k} AS (SELECT pid, row_number() OVER (PARTITION BY floor(X / {s}::DOUBLE), ceil(Y / {s}::DOUBLE), floor(Z / {s}::DOUBLE) ORDER BY h, pid) AS k FROM ord)" for k, s in enumerate((16.0, 8.0, 4.0))
    )
    + " SELECT pid, CASE WHEN r0.k = 1 THEN 0 WHEN r1.k = 1 THEN 1 WHEN r2.k = 1 THEN 2 ELSE 3 END AS depth FROM r0 JOIN r1 USING (pid) JOIN r2 USING (pid) WHERE r0.k = 1 OR r1.k = 1 OR r2.k = 1",
)
def _lod(spark, d):
    return V.with_depth(lineitem_points(spark, d, True), 16.0, 3).where("depth <= 2").select("pid", "depth")


@query(
    "events_raster",
    """SELECT CAST(floor(((epoch_us(ts) / 1e6::DOUBLE) - 1704067200) / 3600::DOUBLE / 24::DOUBLE) AS BIGINT) AS col, CAST(ceil(CAST(user_id AS DOUBLE) / 24::DOUBLE) - 1 AS BIGINT) AS row,
        count(*) AS "count", round(max(value), 6) AS z_max, round(avg(CAST(json_extract(props, '$.k') AS INT)), 6) AS i_mean FROM events GROUP BY col, row""",
)
def _events(spark, d):
    return rounded(R.rasterize(event_points(spark, d), 24.0, ["count", "z_max", "i_mean"]).drop("x", "y"))


@query("shared_pipeline", _raster_sql(2.0, 'round(max(Z), 6) AS z_max, count(*) AS "count"', "Classification <> 9 AND Z < 80"))
def _pipeline(spark, d):
    from .pipeline import stage

    raster = stage("rasterize", res=2.0, operators=["z_max", "count"])
    plan = stage("delete_points", filter="Classification == 9") + stage("reader", filter="Z < 80") + raster + stage("summarise")
    return rounded(plan.execute(lineitem_points(spark, d))[raster.uid])


# --- beyond SQL: triangulations, ground, trees, callbacks ------------------------------------
@query("tin_raster")
def _tin(spark, d):
    return rounded(I.rasterize_triangulation(N.write_once(I.triangulate(lineitem_points(spark, d), conditions="Classification == 2")), 1.0))


@query("normalize_tin")
def _normalize(spark, d):
    return rounded(I.normalize(_slim(spark, d, "Classification"), "HAG").select("pid", "Z", "HAG"))


@query("hull_tin")
def _hull(spark, d):
    return rounded(I.hull_edges(I.triangulate(lineitem_points(spark, d), max_edge=3.0, conditions="Classification == 2")))


@query("hull_rings")
def _hull_rings(spark, d):
    rings = I.hull_rings(I.triangulate(lineitem_points(spark, d), max_edge=3.0, conditions="Classification == 2"))
    return rounded(rings.select("n", "area", F.array_min("ring.x").alias("xmin"), F.array_max("ring.x").alias("xmax")))


@query("dsm_tin")
def _dsm_tin(spark, d):
    return rounded(I.dsm(lineitem_points(spark, d), 2.0, tin=True))


@query("dtm")
def _dtm(spark, d):
    return rounded(I.dtm(lineitem_points(spark, d), 2.0))


@query("dsm", _raster_sql(1.0, "round(max(Z), 6) AS z"))
def _dsm(spark, d):
    return rounded(I.dsm(lineitem_points(spark, d), 1.0))


@query("pit_fill")
def _pits(spark, d):
    return rounded(U.pit_fill(R.rasterize(lineitem_points(spark, d), 1.0, ["z_max"]), "z_max", 1.0, thr_lap=20.0, thr_spk=-40.0))


@query("region_growing")
def _regions(spark, d):
    chm = N.write_once(R.rasterize(lineitem_points(spark, d), 1.0, ["z_max"]))
    return rounded(U.region_growing(chm, "z_max", N.local_maximum_raster(chm, "z_max", 5.0), 1.0))


@query("csf")
def _csf(spark, d):
    return C.classify_with_csf(_slim(spark, d, "Classification"), cloth_resolution=2.0, class_threshold=2.0).select("pid", "Classification")


@query("ptd")
def _ptd(spark, d):
    return C.classify_with_ptd(_slim(spark, d, "Classification"), angle=60.0).select("pid", "Classification")


@query("spikefree")
def _spikefree(spark, d):
    return rounded(U.spikefree(lineitem_points(spark, d), 1.0, 2.0, 1.0))


@query("callback_tile", f"WITH {PP} SELECT pid, round(Z * 2, 6) AS Z FROM PP WHERE NOT Z > 100")
def _callback(spark, d):
    p = A.add_attribute(lineitem_points(spark, d, True).select("pid", "X", "Y", "Z"), "int", "Withheld2")
    doubled = K.callback(p, lambda a: {"Z": a["Z"] * 2, "Withheld": a["Z"] > 100}, "xyz", tile=40.0)
    return rounded(doubled.select("pid", "Z"))
