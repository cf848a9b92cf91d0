"""Attributes, predicates, metrics and the lattice."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cloudloom.functions import attributes, lattice, metrics, predicates
from cloudloom.operators import attributes as A
from cloudloom.operators import raster as R


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0, 50), rng.randint(0, 9), rng.choice([1, 2, 9])) for i in range(400)]
    return spark.createDataFrame(rows, "pid long, X double, Y double, Z double, Intensity int, Classification int").cache()


def test_aliases_are_case_sensitive():
    assert attributes.canonical("r") == "ReturnNumber" and attributes.canonical("R") == "R"
    assert attributes.canonical("plop") == "plop"


@pytest.mark.parametrize(
    "text,parsed",
    [
        ("Z %between% 4 2", ("Z", "%between%", [4.0, 2.0])),
        ("Intensity %in% 1 2 3", ("Intensity", "%in%", [1.0, 2.0, 3.0])),
        ("x>=-1.5", ("x", ">=", [-1.5])),
        ("|ScanAngle| < 3e1", ("|ScanAngle|", "<", [30.0])),
        ("", None),
        ("-keep_first", None),
    ],
)
def test_predicates_are_parsed(text, parsed):
    assert predicates.parse(text) == parsed


@pytest.mark.parametrize("text", ["Z", "Z ~ 3", "Z == a", "Z %between% 1", "== 3", "Z > 1 2"])
def test_malformed_predicates_are_errors(text):
    with pytest.raises(ValueError):
        predicates.parse(text)


def test_filter_and_its_complement_share_the_points(cloud):
    for conditions in ("Z %between% 10 20", ["Z > 10", "c == 2"], "i %out% 1 2", "missing == 0"):
        assert A.filter_points(cloud, conditions).count() + A.delete_points(cloud, conditions).count() == cloud.count()
    assert A.filter_points(cloud, "missing == 0").count() == cloud.count()


def test_pushed_down_to_the_scan(spark, cloud, tmp_path):
    cloud.write.parquet(str(tmp_path / "c"))
    plan = A.filter_points(spark.read.parquet(str(tmp_path / "c")), "Z > 25").select("X")._jdf.queryExecution().toString()
    assert "GreaterThan(Z,25.0)" in plan.replace(" ", "") and "ReadSchema:struct<X:double,Z:double>" in plan.replace(" ", "")


@pytest.mark.parametrize("kind,value,stored", [("uchar", 300, 255), ("char", -129, -128), ("short", 2.5, 3), ("short", -2.5, -3), ("ushort", -1, 0), ("uint", 5e9, 4294967295), ("int", 1e10, 2147483647), ("double", 2.7, 2.7)])
def test_writes_are_rounded_and_clamped(spark, kind, value, stored):
    got = spark.range(1).select(attributes.clamped(F.lit(float(value)), attributes.TYPES[kind])).first()[0]
    assert got == pytest.approx(stored)


def test_lattice_matches_a_raster_grid(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.uniform(-9, 9), float(rng.randint(-9, 9))]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for res in (1.0, 0.5, 3.0):
        for r in df.select("v", lattice.column_of(F.col("v"), res).alias("c"), lattice.row_of(F.col("v"), res).alias("r")).collect():
            assert r.c == math.floor(r.v / res) and r.r == math.ceil(r.v / res) - 1


@pytest.mark.parametrize("text,attr,kind", [("max", "Z", "max"), ("z_p95", "z", "p"), ("my_extra_mean", "my_extra", "mean"), ("i_above10", "i", "above"), ("zmax", "z", "max")])
def test_metric_names(text, attr, kind):
    m = metrics.parse(text)
    assert (m.attribute, m.kind) == (attr, kind)


@pytest.mark.parametrize("text", ["z_p101", "z_foo", "foo", ""])
def test_unknown_metrics_are_errors(text):
    with pytest.raises(ValueError):
        metrics.parse(text)


def test_metrics_match_python(cloud):
    names = ["z_mean", "z_median", "z_p50", "z_sd", "z_cv", "z_sum", "z_min", "z_max", "count", "z_skew", "z_kurt", "z_above25", "c_mode", "plop_sum", "plop_sd"]
    got = cloud.agg(*metrics.aggregates(cloud, names)).first()
    rows = cloud.collect()
    z = [r.Z for r in rows]
    m = statistics.fmean(z)
    m2, m3, m4 = (statistics.fmean((v - m) ** k for v in z) for k in (2, 3, 4))
    want = [m, statistics.median(z), statistics.median(z), statistics.stdev(z), statistics.stdev(z) / m, sum(z), min(z), max(z), len(z), m3 / m2**1.5, m4 / m2**2, sum(v > 25 for v in z) / len(z), min(statistics.multimode(r.Classification for r in rows)), 0, 0]
    assert list(got) == pytest.approx(want)


def test_single_point_has_no_deviation(cloud):
    got = cloud.limit(1).agg(*metrics.aggregates(cloud, ["z_sd", "z_cv", "z_skew", "z_kurt"])).first()
    assert list(got) == [None] * 4


def test_window_of_one_cell_is_the_plain_raster(cloud):
    plain, wide = (R.rasterize(cloud, 4.0, ["z_max", "count"], window=w).orderBy("col", "row").collect() for w in (None, 4.0))
    assert plain == wide


def test_default_value_fills_cells_without_accepted_points(cloud):
    got = R.rasterize(cloud, 2.0, ["z_max", "count"], "Classification == 2", default_value=-1.0).collect()
    assert any(r.z_max == -1.0 and r["count"] == 0 for r in got)
    assert len(got) == R.rasterize(cloud, 2.0, ["count"]).count()
