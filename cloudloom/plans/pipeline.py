"""Pipelines of stages: composed with ``+``, stored as JSON, run as one DataFrame graph.

A stage is a name with parameters.  Point stages turn one point table into the next;
product stages (rasters, vectors, summaries) read the table as it is at their place and
leave it alone.  Nothing runs before a product is asked for; products that share a prefix
of stages share its plan, and ``execute(persist=True)`` stores that prefix.  Sinks (the
``write_*`` stages, and the ``output`` of a product) are written when ``execute`` is called.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.metrics import is_streamable
from ..operators import attributes as A
from ..operators import geometry as G
from ..operators import ground as C
from ..operators import neighbours as N
from ..operators import raster as R
from ..operators import sampling as P
from ..operators import spatial as S
from ..operators import summary as M
from ..operators import surface as U
from ..operators import tin as T
from ..operators import transform as X
from ..operators.callback import callback, collect_callback
from ..sources import catalog as V
from ..sources import las, pcd, raster_files, vectors


@dataclass
class Stage:
    """A named step; ``connect`` maps parameters to the uids of earlier stages."""

    name: str
    params: dict = field(default_factory=dict)
    connect: dict[str, str] = field(default_factory=dict)
    uid: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def __add__(self, other: Stage | Pipeline) -> Pipeline:
        return Pipeline([self]) + other


@dataclass(frozen=True)
class Operator:
    """How a stage runs: on points (to points), or to a product; its buffer, and whether it streams."""

    run: Callable
    product: bool = False
    streamable: Callable[[dict], bool] = lambda p: False
    buffer: Callable[[dict], float] = lambda p: 0.0
    reads_points: bool = True


def _with_features(df: DataFrame, **p) -> DataFrame:
    return df.join(G.geometry_features(df, **p), "pid", "left")


def _rasterize(df: DataFrame, res: float, operators=("max",), filter=None, window=None, default_value=None) -> DataFrame:  # noqa: A002
    return R.rasterize(df, res, list(operators), filter, default_value, window)


def _first_band(raster: DataFrame) -> str:
    return next(c for c in raster.columns if c not in ("col", "row", "x", "y"))


def _transform_raster(df: DataFrame, raster: DataFrame, res: float, operation="-", store_in_attribute="", bilinear=True) -> DataFrame:
    return X.transform_with_raster(df, raster, _first_band(raster), res, operation, store_in_attribute, bilinear)


def _chunk_order(df: DataFrame, tile: float):
    """Points with the number of their tile among all tiles with points, by row and column, from 0."""
    from pyspark.sql import functions as F

    tiles = S.with_tile(df, tile).select("tile_x", "tile_y").distinct().groupBy().agg(F.sort_array(F.collect_list(F.struct("tile_y", "tile_x"))).alias("all"))
    numbered = tiles.select(F.posexplode("all").alias("chunk", "t")).select("chunk", "t.tile_x", "t.tile_y")
    return S.with_tile(df, tile).join(F.broadcast(numbered), ["tile_x", "tile_y"])


def _stop_below(df: DataFrame, index: int, tile: float = 100.0) -> DataFrame:
    numbered = _chunk_order(df, tile)
    return A.stop_if_chunk_id_below(numbered, index, numbered["chunk"]).select(df.columns)


def _hulls(df: DataFrame, triangles: DataFrame | None = None, tile: float = 100.0) -> DataFrame:
    return T.hull_rings(triangles) if triangles is not None else M.bounding_boxes(S.with_tile(df, tile), ["tile_x", "tile_y"])


def _aggregate(df: DataFrame, res: float, function, bands: list[str], window: float | None = None, filter=None) -> DataFrame:  # noqa: A002
    return R.aggregate_function(df, res, function, list(bands), window, filter)


def _write_points(df: DataFrame, path: str, tile: float | None, write, **options) -> DataFrame:
    """One file, or, where the path has a star, one for each tile."""
    if "*" not in path:
        return write(df, path, **options)
    if not tile:
        raise ValueError("a star in the path needs a tile size")
    return write(S.with_tile(df, tile), path, ["tile_x", "tile_y"], **options)


def _write_vpc(df: DataFrame, path: str, files: str | list[str], epsg: int, absolute_path: bool = False, use_gpstime: bool = False) -> DataFrame:
    from pyspark.sql import functions as F

    tops = las.read_headers(df.sparkSession, files)
    tops = tops.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), "*", F.lit(0.0).alias("zmin"), F.lit(0.0).alias("zmax"))
    V.write_vpc(tops, path, epsg, absolute_path, use_gpstime)
    return tops


_always = lambda p: True
_of = lambda key, default=0.0: lambda p: float(p.get(key, default))
OPERATORS: dict[str, Operator] = {
    "nothing": Operator(lambda df, read=False, stream=False, loop=False: A.nothing(df, loop), streamable=lambda p: bool(p.get("stream")), reads_points=False),
    "reader": Operator(lambda df, filter=None: A.filter_points(df, filter), streamable=_always),
    "reader_circles": Operator(lambda df, plots, filter=None: S.in_circles(df, S.circles(df.sparkSession, [tuple(p) for p in plots]), filter), streamable=_always),
    "reader_rectangles": Operator(lambda df, plots, filter=None: S.in_rectangles(df, S.rectangles(df.sparkSession, [tuple(p) for p in plots]), filter), streamable=_always),
    "delete_points": Operator(lambda df, filter: A.delete_points(df, filter), streamable=_always),
    "edit_attribute": Operator(lambda df, attribute, value, filter=None: A.edit_attribute(df, attribute, value, filter), streamable=_always),
    "add_attribute": Operator(lambda df, data_type, name, description="", scale=1.0, offset=0.0: A.add_attribute(df, data_type, name, description, scale, offset)),
    "remove_attributes": Operator(lambda df, names: A.remove_attributes(df, names)),
    "remove_attribute": Operator(lambda df, name: A.remove_attributes(df, [name])),
    "keep_attributes": Operator(lambda df, names: A.keep_attributes(df, names)),
    "add_rgb": Operator(lambda df: A.add_rgb(df)),
    "remove_rgb": Operator(lambda df: A.remove_rgb(df)),
    "set_crs": Operator(lambda df, crs: A.set_crs(df, crs), streamable=_always, reads_points=False),
    "sort_points": Operator(lambda df, spatial=True: A.sort_points(df)),
    "stop_if_outside": Operator(lambda df, xmin, ymin, xmax, ymax, tile=100.0: A.stop_if_outside(df, xmin, ymin, xmax, ymax, tile), streamable=_always, reads_points=False),
    "filter_with_grid": Operator(lambda df, res, operation="min", filter=None: R.filter_with_grid(df, res, operation, filter), buffer=_of("res")),
    "sampling_pixel": Operator(lambda df, res=2.0, filter=None, method="random", use_attribute="Z": P.sampling_pixel(df, res, method, use_attribute, filter), buffer=_of("res", 2.0)),
    "sampling_voxel": Operator(lambda df, res=2.0, filter=None: P.sampling_voxel(df, res, filter), buffer=_of("res", 2.0)),
    "sampling_poisson": Operator(lambda df, distance=2.0: P.sampling_poisson(df, distance), buffer=_of("distance", 2.0)),
    "classify_with_sor": Operator(lambda df, k=8, m=6, classification=18: N.classify_with_sor(df, k, m, classification), buffer=lambda p: 10.0),
    "classify_with_ipf": Operator(lambda df, r=1.0, n=1, classification=18: N.classify_with_ipf(df, r, n, classification), buffer=_of("r", 1.0)),
    "classify_with_ivf": Operator(lambda df, res=5.0, n=6, classification=18, filter=None: N.classify_with_ivf(df, tuple(res) if isinstance(res, list) else res, n, classification, filter)),
    "classify_with_csf": Operator(lambda df, filter=None, **p: C.classify_with_csf(df, conditions=filter, **p), buffer=lambda p: 5 * p.get("cloth_resolution", 0.5)),
    "classify_with_ptd": Operator(lambda df, filter=None, **p: C.classify_with_ptd(df, conditions=filter, **p), buffer=lambda p: 30.0),
    "geometry_features": Operator(_with_features),
    "transform_with_raster": Operator(_transform_raster),
    "transform_with_triangulation": Operator(lambda df, triangles, operation="-", store_in_attribute="": X.transform_with_triangulation(df, triangles, operation, store_in_attribute)),
    "transform_with_matrix": Operator(lambda df, matrix: X.transform_with_matrix(df, X.load_matrix(matrix))),
    "normalize": Operator(lambda df, **p: T.normalize(df, **p), buffer=lambda p: 20.0),
    "hag": Operator(lambda df, **p: T.hag(df, **p), buffer=lambda p: 20.0),
    "aggregate": Operator(_aggregate, True, buffer=lambda p: max(p["res"], p.get("window") or 0.0)),
    "callback": Operator(lambda df, function, expose="xyz", drop_buffer=False, tile=20.0, buffer=0.0: callback(df, function, expose, drop_buffer, tile, buffer), buffer=_of("buffer")),
    "collect_callback": Operator(lambda df, function, schema, expose="xyz", tile=20.0: collect_callback(df, function, schema, expose, tile), True),
    "stop_if_chunk_id_below": Operator(_stop_below, streamable=_always, reads_points=False),
    "local_maximum_flag": Operator(lambda df, ws, min_height=2.0, store_in_attribute="is_maximum", filter=None, use_attribute="Z": N.local_maximum_flag(df, ws, min_height, store_in_attribute, conditions=filter, use_attribute=use_attribute), buffer=_of("ws")),
    "load_raster": Operator(lambda df, file, band="z": raster_files.load_raster(df.sparkSession, file, band), True, _always, reads_points=False),
    "load_matrix": Operator(lambda df, matrix, check=True: X.load_matrix(matrix, check), True, _always, reads_points=False),
    "transform_with": Operator(lambda df, matrix: X.transform_with_matrix(df, matrix), streamable=_always),
    "write_las": Operator(lambda df, path, filter=None, scale=0.001, version=None, fmt=3, tile=None, inputs=(): _write_points(df, path, tile, las.write_las, conditions=filter, scale=scale, version=tuple(version) if version else None, fmt=fmt, inputs=inputs), True, _always),
    "write_pcd": Operator(lambda df, path, binary=True, tile=None, inputs=(): _write_points(df, path, tile, pcd.write_pcd, binary=binary, inputs=inputs), True, _always),
    "write_vpc": Operator(_write_vpc, True, _always, reads_points=False),
    "write_lax": Operator(lambda df, embedded=False, overwrite=False: A.nothing(df), streamable=_always, reads_points=False),
    "write_points": Operator(lambda df, path, tile=None, levels=False, inputs=(): V.write_points(df, path, list(inputs), tile, levels), True),
    "hulls": Operator(_hulls, True, reads_points=False),
    "info": Operator(lambda df: A.info(df), True, _always, reads_points=False),
    "rasterize": Operator(_rasterize, True, lambda p: not p.get("window") and is_streamable(p.get("operators", ["max"])), lambda p: max(p["res"], p.get("window") or 0.0)),
    "summarise": Operator(lambda df, zwbin=2.0, iwbin=50.0, filter=None: M.summarise(df, zwbin, iwbin, filter), True, _always),
    "hull": Operator(lambda df, tile=100.0: M.bounding_boxes(S.with_tile(df, tile), ["tile_x", "tile_y"]), True, _always, reads_points=False),
    "hull_triangulation": Operator(lambda df, triangles: T.hull_edges(triangles), True),
    "triangulate": Operator(lambda df, max_edge=0.0, filter=None, use_attribute="Z": T.triangulate(df, max_edge, filter, use_attribute), True, buffer=lambda p: 20.0),
    "rasterize_triangulation": Operator(lambda df, triangles, res: T.rasterize_triangulation(triangles, res), True, buffer=_of("res")),
    "dtm": Operator(lambda df, res=1.0, add_class=(): T.dtm(df, res, tuple(add_class)), True, buffer=lambda p: 20.0),
    "dsm": Operator(lambda df, res=1.0, tin=False: T.dsm(df, res, tin), True),
    "chm": Operator(lambda df, res=1.0, tin=False: T.dsm(df, res, tin), True),
    "focal": Operator(lambda df, raster, size, res, fun="mean": R.focal(raster, size, res, fun), True, buffer=_of("size")),
    "pit_fill": Operator(lambda df, raster, res, **p: U.pit_fill(raster, _first_band(raster), res, **p), True, buffer=lambda p: p.get("lap_size", 3) * p["res"]),
    "local_maximum": Operator(lambda df, ws, min_height=2.0, filter=None, use_attribute="Z": N.local_maximum(df, ws, min_height, use_attribute, filter), True, buffer=_of("ws")),
    "local_maximum_raster": Operator(lambda df, raster, ws, min_height=2.0: N.local_maximum_raster(raster, _first_band(raster), ws, min_height), True, buffer=_of("ws")),
    "neighborhood_metrics": Operator(lambda df, seeds, metrics, k=10, r=0.0: N.neighborhood_metrics(seeds, df, metrics, k, r), True),
    "region_growing": Operator(lambda df, raster, seeds, res, **p: U.region_growing(raster, _first_band(raster), seeds, res, **p), True, buffer=lambda p: p.get("max_cr", 20.0)),
    "spikefree": Operator(lambda df, filter=None, **p: U.spikefree(df, conditions=filter, **p), True, buffer=lambda p: 2.0),
}


class Pipeline:
    """An ordered list of stages."""

    def __init__(self, stages: list[Stage] = ()):
        self.stages = list(stages)
        self.held: list[DataFrame] = []

    def __add__(self, other: Stage | Pipeline) -> Pipeline:
        return Pipeline(self.stages + (other.stages if isinstance(other, Pipeline) else [other]))

    def __getitem__(self, i: int) -> Stage:
        return self.stages[i]

    def __len__(self) -> int:
        return len(self.stages)

    def check(self) -> None:
        """Unknown names, repeated uids and links to no earlier stage are errors before anything runs."""
        seen: set[str] = set()
        for s in self.stages:
            if s.name not in OPERATORS:
                raise ValueError(f"there is no stage {s.name!r}")
            if s.uid in seen:
                raise ValueError(f"uid {s.uid!r} is there twice")
            for target in s.connect.values():
                if target not in seen:
                    raise ValueError(f"stage {s.name!r} is connected to {target!r}, which is no earlier stage")
            seen.add(s.uid)

    def info(self) -> dict:
        """What the plan needs: whether it streams, reads points, and the buffer around a tile."""
        self.check()
        ops = [(OPERATORS[s.name], s.params) for s in self.stages]
        return {
            "streamable": all(o.streamable(p) for o, p in ops),
            "read_points": any(o.reads_points for o, _ in ops),
            "buffer": max((o.buffer(p) for o, p in ops), default=0.0),
            "parallelizable": True,
        }

    def execute(self, points: DataFrame, persist: bool = False) -> dict[str, DataFrame]:
        """The products by uid, and the last state of the points under ``points``.

        Tables are lazy; what sinks write is written.  With ``persist`` the points that
        several products read are held until the application ends or ``release`` is called.
        """
        self.check()
        products: dict[str, DataFrame] = {}
        current = points
        consumers = sum(OPERATORS[s.name].product for s in self.stages)
        for s in self.stages:
            op = OPERATORS[s.name]
            linked = {k: products[u] for k, u in s.connect.items()}
            if op.product:
                if persist and consumers > 1 and not current.is_cached:
                    current = current.persist()
                    self.held.append(current)
                params = {k: v for k, v in s.params.items() if k != "output"}
                products[s.uid] = op.run(current, **linked, **params)
                if s.params.get("output"):
                    _write_product(products[s.uid], s.params["output"], self._resolution(s))
            else:
                current = op.run(current, **linked, **s.params)
        products["points"] = current
        return products

    def release(self) -> None:
        """Let go of the points that ``execute(persist=True)`` holds."""
        while self.held:
            self.held.pop().unpersist()

    def _resolution(self, s: Stage) -> float | None:
        """The cell size of a raster stage: its own, or that of the stage it is connected to."""
        if "res" in s.params:
            return s.params["res"]
        by_uid = {x.uid: x for x in self.stages}
        return next((r for u in s.connect.values() if (r := self._resolution(by_uid[u]))), None)

    def profile(self, points: DataFrame, path: str | None = None, progress: Callable[[str, float], None] | None = None) -> list[tuple[str, float, float, int]]:
        """(name, start, end, thread) in seconds for every product, each computed in full; written as CSV to ``path``.

        ``progress`` is called with a stage's name and the share of products that are done.
        """
        begun, rows = time.perf_counter(), []
        products = self.execute(points, persist=True)
        tables = [(s.name, products[s.uid]) for s in self.stages if s.uid in products] + [("points", products["points"])]
        for k, (name, table) in enumerate(tables):
            start = time.perf_counter() - begun
            if isinstance(table, DataFrame):
                table.write.format("noop").mode("overwrite").save()
            rows.append((name, start, time.perf_counter() - begun, 0))
            if progress:
                progress(name, (k + 1) / len(tables))
        self.release()
        if path:
            from ..sources.files import write_text

            write_text(points.sparkSession, path, "name, start, end, thread\n" + "".join(f"{n}, {a:.2f}, {b:.2f}, {t}\n" for n, a, b, t in rows))
        return rows

    def results(self, points: DataFrame, rows: int = 1000) -> str:
        """The outcome as JSON: success, per product its kind, columns and first ``rows`` rows, and the plan."""
        data: list[dict] = []
        try:
            products = self.execute(points)
            for s in self.stages:
                if isinstance(table := products.get(s.uid), DataFrame):
                    data.append({"uid": s.uid, "name": s.name, "columns": table.columns, "rows": [json.loads(r) for r in table.toJSON().take(rows)]})
        except Exception as error:  # noqa: BLE001
            return json.dumps({"success": False, "message": str(error), "data": [], "json_config": json.loads(self.to_json())})
        return json.dumps({"success": True, "data": data, "json_config": json.loads(self.to_json())})

    def to_json(self) -> str:
        return json.dumps({"pipeline": [{"algoname": s.name, "uid": s.uid, "connect": s.connect, "params": s.params} for s in self.stages]}, indent=1)

    @staticmethod
    def from_json(text: str) -> Pipeline:
        """A stored plan, a plan with plain stage entries, or a Drawflow graph, in topological order."""
        doc = json.loads(text)
        if "drawflow" in doc:
            doc = _from_drawflow(doc)
        stages: list[Stage] = []
        for entry in doc["pipeline"]:
            if isinstance(entry.get("params"), dict) or isinstance(entry.get("connect"), dict):
                stages.append(Stage(entry["algoname"], entry.get("params", {}), entry.get("connect", {}), entry.get("uid") or uuid.uuid4().hex[:12]))
            elif (s := _plain_stage(entry, stages)) is not None:
                stages.append(s)
        out = Pipeline(stages)
        out.check()
        return out


def _write_product(table: DataFrame, path: str, res: float | None) -> None:
    """A product's sink, by the name's ending: grids, GeoJSON, or Parquet."""
    ending = path.lower().rsplit(".", 1)[-1]
    if ending in ("asc", "tif", "tiff"):
        bands = [c for c in table.columns if c not in ("col", "row", "x", "y")]
        raster_files.write_raster(table, path, bands, res)
    elif ending in ("geojson", "geojsonl"):
        vectors.write_vector(table, path)
    else:
        table.write.mode("overwrite").parquet(path)


# Stage names and parameters of plain plan entries, and what they are called here.
PLAIN_NAMES = {"filter": "delete_points", "filter_grid": "filter_with_grid", "sort": "sort_points", "svd": "geometry_features", "reader_las": "reader", "reader_coverage": "reader", "delete_points": "delete_points"}
PLAIN_PARAMETERS = {
    "classify_with_sor": {"class": "classification"}, "classify_with_ipf": {"class": "classification", "radius": "r"}, "classify_with_ivf": {"class": "classification"},
    "classify_with_csf": {"class": "classification"}, "classify_with_ptd": {"class": "classification"}, "filter_with_grid": {"operator": "operation"},
    "rasterize": {"method": "operators"}, "write_las": {"output": "path", "pdrf": "fmt"}, "write_pcd": {"output": "path"}, "write_vpc": {"output": "path"},
    "transform_with_raster": {"operator": "operation"}, "transform_with_triangulation": {"operator": "operation"}, "focal": {"fun": "fun"},
}
#: Parameters of plain entries that only say how the work is scheduled, not what it gives.
PLAIN_IGNORED = frozenset({"algoname", "uid", "connect", "connect1", "connect2", "shuffle_size", "max_iter", "keep_buffer", "spatial", "wkt", "description_", "iteration"})
_TRIANGLES, _RASTERS = {"triangulate"}, {"rasterize", "rasterize_triangulation", "focal", "pit_fill", "load_raster", "dtm", "dsm", "chm", "spikefree", "aggregate"}


def _plain_stage(entry: dict, before: list[Stage]) -> Stage | None:
    """A stage from an entry with all parameters side by side; None for what only configures the run.

    Parameters that the stage does not know are an error.
    """
    name, own = entry["algoname"], dict(entry)
    by_uid = {s.uid: s for s in before}
    links = [own[k] for k in ("connect", "connect1", "connect2") if own.get(k)]
    if missing := [u for u in links if u not in by_uid]:
        raise ValueError(f"stage {name!r} is connected to {missing[0]!r}, which is no earlier stage")
    linked = [by_uid[u] for u in links]
    if name in ("build_catalog", "xptr"):
        return None
    name = PLAIN_NAMES.get(name, name)
    connect: dict[str, str] = {}
    res = next((r for s in linked if (r := Pipeline(before)._resolution(s))), None)

    def take(*names):
        return [own.pop(n) for n in names]

    if name == "reader" and "xcenter" in own:
        x, y, r = take("xcenter", "ycenter", "radius")
        name, own["plots"] = "reader_circles", [(k, *p) for k, p in enumerate(zip(*(v if isinstance(v, list) else [v] for v in (x, y, r))))]
    elif name == "reader" and "xmin" in own:
        ends = take("xmin", "ymin", "xmax", "ymax")
        name, own["plots"] = "reader_rectangles", [(k, *p) for k, p in enumerate(zip(*(v if isinstance(v, list) else [v] for v in ends)))]
    elif name == "rasterize" and linked:
        name, connect = "rasterize_triangulation", {"triangles": links[0]}
        own.pop("method", None), own.pop("window", None), own.pop("filter", None)
    elif name == "transform_with":
        kind = linked[0].name if linked else ""
        own.pop("bilinear", None) if kind not in _RASTERS else None
        if kind in _TRIANGLES:
            name, connect = "transform_with_triangulation", {"triangles": links[0]}
        elif kind in _RASTERS:
            name, connect, own["res"] = "transform_with_raster", {"raster": links[0]}, res
        elif kind == "load_matrix":
            connect = {"matrix": links[0]}
            own.pop("operator", None), own.pop("store_in_attribute", None)
        else:
            raise ValueError("a transformation is connected to a raster, a triangulation or a matrix")
    elif name in ("focal", "pit_fill"):
        connect, own["res"] = {"raster": links[0]}, res
    elif name == "region_growing":
        seeds = next(k for k, s in enumerate(linked) if s.name.startswith("local_maximum"))
        connect, own["res"] = {"raster": links[1 - seeds], "seeds": links[seeds]}, Pipeline(before)._resolution(linked[1 - seeds])
    elif name == "local_maximum" and linked:
        name, connect = "local_maximum_raster", {"raster": links[0]}
        own.pop("filter", None)
    elif name == "hulls" and linked:
        connect = {"triangles": links[0]}
    elif name == "neighborhood_metrics":
        connect = {"seeds": links[0]}
    elif name == "stop_if":
        name = {"outside_bbox": "stop_if_outside", "chunk_id_below": "stop_if_chunk_id_below"}[own.pop("condition")]
    elif name == "set_crs":
        own["crs"] = own.pop("epsg", 0) or own.get("wkt", "")
    elif name == "remove_attributes" and "keep" in own:
        name, own["names"] = "keep_attributes", own.pop("keep")
    elif name == "classify_with_ivf" and "res_x" in own:
        own["res"] = take("res_x", "res_y", "res_z")
    if name == "local_maximum":
        own.pop("record_attributes", None)  # points come with all of theirs
        if own.pop("store_in_attribute", ""):
            name, own["store_in_attribute"] = "local_maximum_flag", entry["store_in_attribute"]
    renamed = PLAIN_PARAMETERS.get(name, {})
    params = {renamed.get(k, k): v for k, v in own.items() if k not in PLAIN_IGNORED and v is not None}
    if name not in ("write_las", "write_pcd", "write_vpc") and params.get("output") in ("", "#temptif()#"):
        params.pop("output")
    if isinstance(params.get("operators"), str):
        params["operators"] = [params["operators"]]
    if "filter" in params and params["filter"] in ("", [], [""]):
        params.pop("filter")
    if isinstance(res_ := params.get("res"), list) and name == "rasterize":
        params["res"], params["window"] = res_[0], res_[-1] if len(res_) > 1 else None
    if "window" in params and params["window"] in (None, 0, params.get("res")):
        params.pop("window")
    _known(name, params, connect)
    return Stage(name, params, connect, entry.get("uid") or uuid.uuid4().hex[:12])


def _known(name: str, params: dict, connect: dict) -> None:
    """Names of parameters that a stage does not have are an error."""
    import inspect

    if name not in OPERATORS:
        raise ValueError(f"there is no stage {name!r}")
    signature = inspect.signature(OPERATORS[name].run).parameters
    if any(p.kind is p.VAR_KEYWORD for p in signature.values()):
        return
    unknown = set(params) - set(signature) - {"output"}
    if unknown:
        raise ValueError(f"stage {name!r} has no parameter {sorted(unknown)[0]!r}")


def _value(text):
    """Numbers and truth values that a graph's form holds as text."""
    if not isinstance(text, str):
        return text
    if text in ("true", "false"):
        return text == "true"
    try:
        return float(text) if not float(text).is_integer() else int(float(text))
    except (ValueError, OverflowError):
        return text


def _from_drawflow(doc: dict) -> dict:
    """A graph as a plain plan: nodes by their links, the first input being the cloud, others products."""
    nodes = {str(n["id"]): n for page in doc["drawflow"].values() for n in page["data"].values() if n["name"] != "processing_options"}
    inputs = {k: [[str(c["node"]) for c in port.get("connections", [])] for _, port in sorted((n.get("inputs") or {}).items())] for k, n in nodes.items()}
    before = {k: {u for port in ports for u in port} & set(nodes) for k, ports in inputs.items()}
    place = {k: i for i, k in enumerate(nodes)}
    order: list[str] = []
    while len(order) < len(nodes):
        ready = sorted((k for k in nodes if k not in order and before[k] <= set(order)), key=lambda k: (_depth(k, before), place[k]))
        if not ready:
            raise ValueError("the graph has a cycle")
        order.append(ready[0])
    entries = []
    for k in order:
        entry = {p: _value(v) for p, v in (nodes[k].get("data") or {}).items()} | {"algoname": nodes[k]["name"], "uid": k}
        linked = [u for port in inputs[k][1:] for u in port]
        if linked:
            entry["connect"] = linked[0]
            entry |= {f"connect{i + 1}": u for i, u in enumerate(linked)} if len(linked) > 1 else {}
            if len(linked) > 1:
                entry.pop("connect")
        entries.append(entry)
    return {"pipeline": entries}


def _depth(k: str, before: dict[str, set[str]]) -> int:
    return 1 + max((_depth(b, before) for b in before[k]), default=0)


def stage(name: str, connect: dict[str, Stage] | None = None, **params) -> Stage:
    """A stage; ``connect`` names the earlier stages whose products it takes."""
    return Stage(name, params, {k: s.uid for k, s in (connect or {}).items()})
