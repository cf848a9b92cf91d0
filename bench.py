"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

t1 to t6 are the published tests, all of their steps: max raster; ground triangulation and
its raster; three rasters of one reading; normalisation, write, ground and canopy rasters,
maxima and crowns; normalisation and write; local maxima.  Other entries are registered
queries.  Tables go to the no-op sink, so that all columns and rows are computed and none
is collected; what a test writes is written.  The better of two runs counts.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = {
    "metrics_raster": "rasterize_all_metrics",
    "percentiles": "rasterize_percentiles",
    "summarise": "summarise",
    "plot_metrics": "plot_metrics",
    "sampling_voxel": "sampling_voxel_random",
    "ivf": "ivf",
    "ipf": "ipf",
    "sor": "sor",
    "geometry_features": "geom_features",
    "focal_median": "focal_median",
    "transform_bilinear": "transform_raster_bilinear",
}


def _compute(*tables) -> None:
    for table in tables:
        table.write.format("noop").mode("overwrite").save()


def published(spark, sf_dir: str, folder: str) -> dict:
    """The published tests by name."""
    from cloudloom.operators import neighbours as N
    from cloudloom.operators import raster as R
    from cloudloom.operators import surface as U
    from cloudloom.operators import tin as I
    from cloudloom.sources.catalog import write_points
    from cloudloom.sources.points import lineitem_points

    def points(with_pid: bool = False):
        return lineitem_points(spark, sf_dir, with_pid)

    def normalised():
        path = f"{folder}/norm"
        write_points(I.normalize(points(True)), path)
        return spark.read.parquet(path)

    def three_rasters() -> None:
        held = points().select("X", "Y", "Z", "Intensity").persist()
        _compute(R.rasterize(held, 1.0, ["max"]), R.rasterize(held, 20.0, ["z_mean", "i_mean"]), R.rasterize(held, 5.0, ["count"]))
        held.unpersist()

    def trees() -> None:
        low = normalised()
        canopy = N.write_once(R.rasterize(low, 1.0, ["z_max"]))
        tops = N.write_once(N.local_maximum_raster(canopy, "z_max", 3.0))
        _compute(I.dtm(points(), 1.0), canopy, tops, U.region_growing(canopy, "z_max", tops, 1.0))

    return {
        "t1_max_raster": lambda: _compute(R.rasterize(points(), 1.0, ["max"])),
        "t2_ground_tin": lambda: _compute(I.surface_raster(I.ground_of(points(), (2,)), 1.0)),
        "t3_metrics_raster": three_rasters,
        "t4_tree_segmentation": trees,
        "t5_normalize": lambda: normalised() and None,
        "t6_local_maximum": lambda: _compute(N.local_maximum(points(True), 5.0)),
    }


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cloudloom-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cloudloom.plans.registry import QUERIES as registered

    folder = tempfile.mkdtemp(prefix="cloudloom-bench-")
    tests = published(spark, sf_dir, folder) | {label: lambda q=registered[name]: _compute(q(spark, sf_dir)) for label, name in QUERIES.items()}
    took: dict[str, float] = {}
    for label, test in tests.items():
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            test()
            runs.append(time.perf_counter() - start)
            if runs[0] > 60:
                break
        took[label] = round(min(runs), 3)
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
