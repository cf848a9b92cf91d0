"""Operators on analytic clouds: planes, cones, lattices, outliers."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import attributes as A
from cloudloom.operators import callback as K
from cloudloom.operators import geometry as G
from cloudloom.operators import ground as C
from cloudloom.operators import neighbours as N
from cloudloom.operators import raster as R
from cloudloom.operators import sampling as S
from cloudloom.operators import spatial as T
from cloudloom.operators import surface as U
from cloudloom.operators import tin as I
from cloudloom.operators import transform as X

SCHEMA = "pid long, X double, Y double, Z double"


def cloud_of(spark, rows, cls=None):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], SCHEMA)
    return df.withColumn("Classification", F.lit(1 if cls is None else cls))


@pytest.fixture(scope="module")
def plane(spark):
    rng = random.Random(3)
    rows = [(x, y, 2 * x - 3 * y + 200) for x, y in ((rng.uniform(0, 45), rng.uniform(0, 45)) for _ in range(3000))]
    return cloud_of(spark, rows, 2).cache()


def test_edits_and_definitions(spark, plane):
    with pytest.raises(ValueError):
        A.edit_attribute(plane, "Z", 1)
    with pytest.raises(ValueError):
        A.edit_attribute(plane, "nope", 1)
    with pytest.raises(ValueError):
        A.delete_points(plane, [])
    one = A.add_attribute(plane, "uchar", "Extra")
    assert A.add_attribute(one, "uchar", "Extra").columns == one.columns
    with pytest.raises(ValueError):
        A.add_attribute(one, "double", "Extra")
    assert A.edit_attribute(one, "Extra", 999).select(F.max("Extra")).first()[0] == 255
    assert A.remove_attributes(one, ["X", "Extra", "nope"]).columns == plane.columns


def test_delaunay_has_empty_circles_and_covers_the_hull():
    rng = np.random.default_rng(4)
    for n in (3, 4, 50, 400):
        x, y = rng.random(n), rng.random(n)
        t = I.delaunay(x, y)
        ax, ay, bx, by, cx, cy = x[t[:, 0]], y[t[:, 0]], x[t[:, 1]], y[t[:, 1]], x[t[:, 2]], y[t[:, 2]]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        r2 = (ax - ux) ** 2 + (ay - uy) ** 2
        inside = ((x[None] - ux[:, None]) ** 2 + (y[None] - uy[:, None]) ** 2 < (r2 * (1 - 1e-6))[:, None]).sum()
        assert inside == 0
        edges = {tuple(sorted(e)) for a, b, c in t.tolist() for e in ((a, b), (b, c), (c, a))}
        assert n - len(edges) + len(t) == 1  # Euler's formula for a disc
    grid = np.array([(i, j) for i in range(8) for j in range(8)], float)
    assert len(I.delaunay(grid[:, 0], grid[:, 1])) == 98
    assert len(I.delaunay(np.array([0.0, 1.0]), np.array([0.0, 1.0]))) == 0


def test_plane_is_reproduced(plane):
    tin = N.write_once(I.triangulate(plane))
    raster = I.rasterize_triangulation(tin, 1.0).toPandas()
    inner = raster[(raster.x > 1) & (raster.x < 44) & (raster.y > 1) & (raster.y < 44)]
    assert len(inner) == 43 * 43
    assert np.allclose(inner.z, 2 * inner.x - 3 * inner.y + 200, atol=1e-6)
    heights = X.transform_with_triangulation(plane, tin).select("Z").toPandas()["Z"]
    assert abs(heights).max() < 1e-6 and len(heights) == 3000
    flat = G.geometry_features(plane, 8, features="sin").toPandas()
    assert abs(flat.sphericity).max() < 1e-6
    assert np.allclose(flat.inclination, math.degrees(math.acos(1 / math.sqrt(14))), atol=1e-2)
    mean = R.rasterize(plane, 3.0, ["z_mean"]).select("col", "row", "x", "y", (2 * F.col("x") - 3 * F.col("y") + 200).alias("v"))
    left = X.transform_with_raster(plane.where("X between 3 and 42 and Y between 3 and 42"), mean, "v", 3.0).select("Z").toPandas()["Z"]
    assert np.median(abs(left)) < 1e-6


def test_hull_of_a_square(spark):
    tin = I.triangulate(cloud_of(spark, [(i, j, 0) for i in range(6) for j in range(6)]))
    (ring,) = I.hull_rings(tin).collect()
    assert ring.n == 21 and len(ring.ring) == 21 and ring.ring[0] == ring.ring[-1] and ring.area == pytest.approx(25)
    holed = cloud_of(spark, [(i, j, 0) for i in range(9) for j in range(9) if not (2 < i < 6 and 2 < j < 6)] + [(20 + i, j, 0) for i in range(3) for j in range(3)])
    rings = I.hull_rings(I.triangulate(holed, max_edge=1.9)).collect()
    assert sorted(round(r.area) for r in rings) == [-14, 4, 64]  # the corners of the gap are cut


def brute_knn(rows, k):
    a = np.array(rows)
    d2 = ((a[:, None] - a[None]) ** 2).sum(-1)
    return {i: [j for _, j in sorted(zip(d2[i], range(len(a))))[:k]] for i in range(len(a))}


def test_nearest_neighbours_are_proven(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(0, 5), rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(200)] + [(100 + i, 100, 0) for i in range(5)] + [(1, 1, 1)] * 12
    df = cloud_of(spark, rows)
    got = {}
    for r in N.nearest_neighbours(df.select("pid", "X", "Y", "Z"), df, 5).collect():
        got.setdefault(r.pid, {})[r["rank"]] = r.pid2
    want = brute_knn(rows, 5)
    assert {p: [own[k] for k in sorted(own)] for p, own in got.items()} == want
    few = cloud_of(spark, rows[:3])
    assert N.nearest_neighbours(few.select("pid", "X", "Y", "Z"), few, 8).count() == 9


@pytest.mark.parametrize("halo", [0.3, 2.0, np.inf])
def test_nearest_in_a_tile(halo):
    rng = np.random.default_rng(3)
    xyz = np.r_[rng.uniform(0, 6, (700, 3)), np.repeat([[1.0, 2.0, 3.0]], 40, axis=0), rng.normal(3, 0.05, (300, 3))]
    pid = rng.permutation(len(xyz)) * 3
    index, d2 = N.nearest_in_tile(xyz, xyz, pid, 6, halo)
    exact = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    for i in range(0, len(xyz), 7):
        order = np.lexsort((pid, exact[i]))[:6]
        if exact[i, order[-1]] <= halo * halo:
            assert index[i].tolist() == order.tolist()


def test_dense_spots_and_outliers_have_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE_POINTS", 60)
    rng = random.Random(15)
    rows = [(rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(0, 4)) for _ in range(500)]
    rows += [(20 + rng.gauss(0, 0.05), 20 + rng.gauss(0, 0.05), 1.0) for _ in range(500)] + [(5.0, 5.0, 0.5)] * 60
    rows += [(20.0, 20.0, 300.0), (-200.0, 20.0, 0.0)]
    df = cloud_of(spark, rows)
    got = {}
    for r in N.nearest_neighbours(df.select("pid", "X", "Y", "Z"), df, 4).collect():
        got.setdefault(r.pid, {})[r["rank"]] = r.pid2
    assert {p: [own[k] for k in sorted(own)] for p, own in got.items()} == brute_knn(rows, 4)
    want = brute_knn(rows, 9)
    a = np.array(rows)
    moments = G.geometry_features(df, 9, features="u").toPandas().set_index("pid").eigensum
    for i in range(0, len(rows), 50):
        assert moments[i] == pytest.approx(a[want[i]].var(axis=0, ddof=1).sum(), rel=1e-6, abs=1e-9)


def test_heights_come_from_the_triangle_above(spark):
    rng = np.random.default_rng(9)
    x, y = rng.uniform(0, 10, 400), rng.uniform(0, 10, 400)
    t = I.delaunay(x, y)
    px, py = rng.uniform(-1, 11, 500), rng.uniform(-1, 11, 500)
    v, at = I.heights_at(px, py, x, y, 3 * x - y + 2, t)
    inside = at >= 0
    assert np.allclose(v[inside], 3 * px[inside] - py[inside] + 2)
    for k in np.flatnonzero(inside)[::20]:
        a, b, c = ((x[i], y[i]) for i in t[at[k]])
        area = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        assert min(area(a, b, (px[k], py[k])), area(b, c, (px[k], py[k])), area(c, a, (px[k], py[k]))) >= -1e-6
    middle = (px > 1) & (px < 9) & (py > 1) & (py < 9)
    assert inside[middle].all() and not inside[(px < 0) | (px > 10)].any()


def test_tiles_agree_with_one_triangulation(spark):
    rng = random.Random(16)
    rows = [(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 5)) for _ in range(900)]
    rows = [r for r in rows if not (20 < r[0] < 34 and 20 < r[1] < 34)]  # a gap as wide as several tiles
    df = cloud_of(spark, rows).withColumn("Classification", F.lit(2))
    key = lambda frame: sorted(tuple(sorted(zip((r.ax, r.bx, r.cx), (r.ay, r.by, r.cy)))) for r in frame.collect())
    inner = "least(ax, bx, cx) > 8 and greatest(ax, bx, cx) < 52 and least(ay, by, cy) > 8 and greatest(ay, by, cy) < 52"
    whole, tiled = (I.triangulate(df, tile=t, halo=h).where(inner) for t, h in ((200.0, 200.0), (6.0, 30.0)))
    assert key(whole) == key(tiled)
    one, many = (I.dtm(df, 1.0, tile=t, halo=h).where("x between 8 and 52 and y between 8 and 52").toPandas().set_index(["col", "row"]).z.sort_index() for t, h in ((200.0, 200.0), (6.0, 30.0)))
    assert len(one) == len(many) == 44 * 44 and np.allclose(one, many)
    joined = I.rasterize_triangulation(N.write_once(I.triangulate(df, tile=200.0, halo=200.0)), 1.0).where("x between 8 and 52 and y between 8 and 52").toPandas().set_index(["col", "row"]).z.sort_index()
    assert np.allclose(one, joined)
    heights = I.normalize(df.withColumn("Z", F.col("Z") + 1), "HAG", tile=6.0).select("HAG").toPandas().HAG
    assert heights.abs().max() < 6 and len(heights) >= 0.9 * len(rows)


def test_regions_take_cells_over_the_smaller_bound_and_try_again():
    row = lambda *v: {(i, 0): float(x) for i, x in enumerate(v)}
    grow = lambda heights, **o: U.grow_regions(heights, [(7, 0, 0, 0.5, 0.5, 20.0)], 1.0, **{"th_tree": 2.0, "th_seed": 0.45, "th_cr": 0.55, "max_cr": 20.0} | o)
    assert set(grow(row(20, 10, 8.5))) == {(0, 0), (1, 0), (2, 0)}  # 8.5 is over 0.55 of the mean 15, not over 9
    assert set(grow(row(20, 8.9, 8.5))) == {(0, 0)}
    cross = row(20, 12) | {(0, 1): 8.0, (0, -1): 11.0, (1, -1): 11.0}
    assert set(grow(cross)) == set(cross)  # 8 waits until the mean has come down
    assert set(grow(row(20, 19, 18, 17), max_cr=4.0)) == {(0, 0), (1, 0)} and set(grow(row(20, 22, 15))) == {(0, 0)}


def test_noise_filters_flag_the_outliers(spark):
    rng = random.Random(6)
    rows = [(rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 2)) for _ in range(800)] + [(5, 5, 30 + 10 * i) for i in range(4)]
    df = cloud_of(spark, rows)
    for out in (N.classify_with_sor(df, 8, 6), N.classify_with_ipf(df, 2.0, 1), N.classify_with_ivf(df, 3.0, 3)):
        assert sorted(r.pid for r in out.where("Classification = 18").collect()) == [800, 801, 802, 803]
        assert out.count() == len(rows)


def test_cones_give_their_tops_and_one_region_each(spark):
    tops = [(10.5, 10.5, 20.0), (30.5, 12.5, 25.0), (20.5, 35.5, 18.0)]
    rows = [(x + 0.5, y + 0.5, max(1.0, max(h - 1.5 * math.hypot(x + 0.5 - cx, y + 0.5 - cy) for cx, cy, h in tops))) for x in range(45) for y in range(45)]
    df = cloud_of(spark, rows)
    found = N.local_maximum(df, 5.0).select("X", "Y", "Z").collect()
    assert sorted(tuple(r) for r in found) == sorted(tops)
    chm = R.rasterize(df, 1.0, ["z_max"])
    seeds = N.local_maximum_raster(chm, "z_max", 5.0)
    regions = U.region_growing(chm, "z_max", seeds, 1.0).toPandas()
    assert regions.region.nunique() == 3 and set(regions.region) == {r.fid for r in seeds.collect()}
    one, four = (U.region_growing(chm, "z_max", seeds, 1.0, tile=t).orderBy("col", "row").collect() for t in (100.0, 25.0))
    assert one == four


def test_equal_maxima_keep_the_first_and_doubles_stay(spark):
    df = cloud_of(spark, [(0, 0, 5), (1, 0, 5), (10, 0, 7), (10, 0, 7), (20, 0, 1)])
    assert sorted(r.pid for r in N.local_maximum(df, 4.0).collect()) == [0, 2, 3]


def test_poisson_sample_is_spread_and_full(spark):
    rng = random.Random(7)
    rows = np.array([(rng.uniform(0, 8), rng.uniform(0, 8), rng.uniform(0, 2)) for _ in range(500)])
    kept = S.sampling_poisson(cloud_of(spark, rows), 1.0).toPandas()[["X", "Y", "Z"]].to_numpy()
    d = np.sqrt(((kept[:, None] - kept[None]) ** 2).sum(-1))
    assert (d + np.eye(len(kept)) * 9).min() >= 1.0
    assert np.sqrt(((rows[:, None] - kept[None]) ** 2).sum(-1)).min(axis=1).max() < 1.0


def test_samples_have_one_point_per_cell(plane):
    assert S.sampling_pixel(plane, 3.0).count() == R.rasterize(plane, 3.0, ["count"]).count()
    assert S.sampling_pixel(plane, 3.0, conditions="X < 10").where("X >= 10").count() == plane.where("X >= 10").count()


def test_random_order_holds_for_large_ids(spark):
    ids = [0, 1, (1 << 32) - 1, 3_474_701_532, 3_474_701_533, 4_607_999_999, (1 << 62) + 3_900_000_000, -5]
    for seed in (0, 7, -3):
        got = spark.createDataFrame([(i,) for i in ids], "pid long").select(S.priority(F.col("pid"), seed)).collect()
        assert [r[0] for r in got] == [(i % (1 << 32) + seed) * 2654435761 % (1 << 32) for i in ids]
    far = 3_900_000_000
    cloud = spark.createDataFrame([(far + i, i % 10 * 0.1, 0.0, 0.0, i % 2) for i in range(40)], "pid long, X double, Y double, Z double, Classification int")
    order = lambda rows: min(rows, key=lambda p: (p % (1 << 32) * 2654435761 % (1 << 32), p))
    first = order(range(far, far + 40))
    assert [r.pid for r in S.sampling_pixel(cloud, 5.0).collect()] == [first]
    assert [r.pid for r in S.sampling_voxel(cloud, 5.0).collect()] == [first]
    filtered = {r.pid for r in S.sampling_pixel(cloud, 5.0, conditions="Classification == 1").collect()}
    assert filtered == {order(range(far + 1, far + 40, 2)), *range(far, far + 40, 2)}
    assert [r.pid for r in S.sampling_poisson(cloud, 2.0).collect()] == [first]
    from cloudloom.sources.catalog import with_depth

    assert [r.pid for r in with_depth(cloud, 16.0, 3).where("depth = 0").collect()] == [first]


def test_tiles_and_halos_agree_with_boxes(plane):
    spread = T.with_halo(plane, 10.0, 2.0)
    assert spread.where("not is_buffer").count() == plane.count()
    tile = spread.where("tile_x = 1 and tile_y = 2").count()
    assert tile == plane.where("X between 8 and 22 and Y between 18 and 32").count()
    with pytest.raises(ValueError):
        T.with_halo(plane, 1.0, 2.0)


def test_many_plots_are_matched_like_few(spark, plane, monkeypatch):
    plots = T.circles(spark, [(i, 3.0 * i, 40 - 2.5 * i, 4.0) for i in range(15)] + [(99, 900, 900, 3)])
    few = T.in_circles(plane, plots).select("query_id", "pid").orderBy("query_id", "pid").collect()
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert few == T.in_circles(plane, plots).select("query_id", "pid").orderBy("query_id", "pid").collect()


def test_cloth_and_densification_find_the_ground(spark):
    rng = random.Random(8)
    ground = [(x := rng.uniform(0, 30), y := rng.uniform(0, 30), 0.05 * x + rng.uniform(-0.03, 0.03)) for _ in range(2500)]
    trees = [(rng.uniform(5, 25), rng.uniform(5, 25), rng.uniform(5, 12)) for _ in range(500)]
    del y
    df = cloud_of(spark, ground + trees)
    for out in (C.classify_with_csf(df, tile=30.0), C.classify_with_ptd(df)):
        got = out.toPandas().set_index("pid").sort_index().Classification
        assert (got[:2500] == 2).mean() > 0.9 and (got[2500:] == 2).mean() < 0.02
    water = df.withColumn("Classification", F.lit(9))
    assert C.classify_with_csf(water, tile=30.0).where("Classification <> 9").count() == 0


def test_pits_are_filled_and_spikes_cut(spark):
    rows = [(c, r, c + 0.5, r + 0.5, 10.0) for c in range(9) for r in range(9)]
    rows[40], rows[20] = (*rows[40][:4], 1.0), (*rows[20][:4], 30.0)
    raster = spark.createDataFrame(rows, "col long, row long, x double, y double, z double")
    got = U.pit_fill(raster, "z", 1.0, thr_lap=3.0, thr_spk=-3.0).toPandas()
    assert len(got) == 81 and set(got.z) == {10.0}


def test_spikes_below_the_canopy_are_ignored(spark):
    rows = [(x / 2, y / 2, 20.0) for x in range(30) for y in range(30)] + [(3.3 + i, 3.3, 2.0) for i in range(5)]
    raster = U.spikefree(cloud_of(spark, rows), 0.5, 1.0, 1.0).toPandas()
    assert raster.z.min() == pytest.approx(20.0)


def test_matrix_is_checked_and_applied(spark):
    with pytest.raises(ValueError):
        X.load_matrix([2.0] + [0.0] * 15)
    with pytest.raises(ValueError):
        X.load_matrix([1.0])
    turn = X.load_matrix([0, -1, 0, 5, 1, 0, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1])
    got = X.transform_with_matrix(cloud_of(spark, [(1, 2, 3)]), turn).first()
    assert (got.X, got.Y, got.Z) == (3.0, 7.0, 10.0)


def test_operation_equals_needs_a_place(plane):
    with pytest.raises(ValueError):
        X.transform_with_raster(plane, R.rasterize(plane, 5.0), "z_max", 5.0, "=")


def test_callbacks_follow_their_contract(spark, plane):
    assert K.callback(plane, lambda a: {"Z": a["Z"] + 1}, "xyz").agg(F.sum("Z")).first()[0] == pytest.approx(plane.agg(F.sum(F.col("Z") + 1)).first()[0])
    for bad in (lambda a: {"Nope": a["Z"]}, lambda a: {"Z": a["Z"][:1]}):
        with pytest.raises(Exception, match="returned"):
            K.callback(plane, bad, "xyz").count()
    with pytest.raises(ValueError):
        K.exposed(plane, "q9")
    rows = K.collect_callback(plane, lambda a: {"top": float(a["Z"].max())}, "top double").collect()
    assert max(r.top for r in rows) == plane.agg(F.max("Z")).first()[0]


def test_user_functions_need_one_number_per_band(plane):
    with pytest.raises(Exception, match="bands"):
        R.aggregate_function(plane, 5.0, lambda p: [1, 2], ["a"]).count()


def test_empty_clouds_pass_through(spark):
    empty = spark.createDataFrame([], SCHEMA + ", Classification int")
    assert R.rasterize(empty, 1.0, ["z_max"]).count() == 0
    assert N.local_maximum(empty, 3.0).count() == 0
    assert N.classify_with_ivf(empty).count() == 0
    assert I.triangulate(empty).count() == 0 and I.dtm(empty, 1.0).count() == 0 and I.normalize(empty).count() == 0
    assert N.classify_with_sor(empty).count() == 0 and N.classify_with_ipf(empty).count() == 0 and G.geometry_features(empty).count() == 0
    assert isinstance(empty.toPandas(), pd.DataFrame)


def test_nearest_within_a_radius(spark):
    rng = random.Random(17)
    rows = [(rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 2)) for _ in range(150)]
    df = cloud_of(spark, rows)
    got = {}
    for r in N.nearest_neighbours(df.select("pid", "X", "Y", "Z"), df, 4, radius=0.9).collect():
        got.setdefault(r.pid, {})[r["rank"]] = r.pid2
    a = np.array(rows)
    for i, order in brute_knn(rows, 4).items():
        assert [got[i][k] for k in sorted(got[i])] == [j for j in order if ((a[i] - a[j]) ** 2).sum() <= 0.81]


def test_random_fractions_keep_their_share(plane):
    from cloudloom.functions.predicates import random_fraction

    assert abs(plane.where(random_fraction(0.3, 5)).count() / 3000 - 0.3) < 0.04
    assert plane.where(random_fraction(1.0)).count() == 3000 and plane.where(random_fraction(-1.0)).count() == 0


def moved_rows(spark, df):
    """Rows that a query shuffles, where no table is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

        def shuffled():
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            none = jvm.java.util.ArrayList()
            stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
            return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

        before = shuffled()
        df().write.format("noop").mode("overwrite").save()
        return sum(n for stage, n in shuffled().items() if stage not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def patchy(spark):
    """Even points, a crowded place, equal heights, copies, and points far off."""
    rng = random.Random(8)
    rows = [(rng.uniform(-30, 30), rng.uniform(-30, 30), rng.randint(0, 40) * 0.5) for _ in range(2500)]
    rows += [(7 + rng.gauss(0, 0.3), 3 + rng.gauss(0, 0.3), rng.randint(0, 3) * 1.0) for _ in range(400)]
    rows += [(1.0, 2.0, 30.0)] * 4 + [(400.0, -300.0, 5.0), (-29.0, 29.0, 90.0)]
    return rows, cloud_of(spark, rows).repartition(7).cache()


def by_joins(monkeypatch, run):
    with monkeypatch.context() as m:
        m.setattr(N.L, "MOST_POINTS", 0)
        return run()


@pytest.mark.parametrize("per", [40, 32_000])
def test_counts_and_maxima_in_tiles_agree_with_joins_and_all_pairs(spark, patchy, monkeypatch, per):
    rows, df = patchy
    monkeypatch.setattr(N.L, "TILE_POINTS", per)
    a = np.array(rows)
    d2 = ((a[:, None] - a[None]) ** 2).sum(-1)
    flagged = lambda q: {r.pid for r in q.where("Classification = 18").collect()}
    for r, n in ((1.0, 1), (2.5, 4)):
        run = lambda r=r, n=n: flagged(N.classify_with_ipf(df, r, n))
        assert run() == by_joins(monkeypatch, run) == set(np.flatnonzero((d2 <= r * r).sum(1) <= n + 1).tolist())
    for res, kept in ((2.0, None), ((3.0, 1.5, 4.0), "Z > 3")):
        run = lambda res=res, kept=kept: flagged(N.classify_with_ivf(df, res, 6, conditions=kept))
        assert run() == by_joins(monkeypatch, run)
    xy = ((a[:, None, :2] - a[None, :, :2]) ** 2).sum(-1)
    for ws in (3.0, 6.0):
        near, z, i = xy < ws * ws / 4, a[:, 2], np.arange(len(a))
        beaten = near & ((z > z[:, None]) | ((z == z[:, None]) & (i < i[:, None]) & (xy > 0)))
        want = set(np.flatnonzero((z >= 2) & ~beaten.any(axis=1)).tolist())
        run = lambda ws=ws: {r.pid for r in N.local_maximum(df, ws).collect()}
        assert run() == by_joins(monkeypatch, run) == want
        marks = N.local_maximum_flag(df, ws).collect()
        assert len(marks) == len(rows) and {r.pid for r in marks if r.is_maximum} == want


def test_points_without_a_place_stay(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 1), (2, None, 0.0, 5.0, 1), (3, 0.1, 0.0, None, 1), (4, 0.1, 0.1, 4.0, 1)], SCHEMA + ", Classification int")
    got = lambda q, c: {r.pid: r[c] for r in q.collect()}
    assert got(N.local_maximum_flag(df, 3.0), "is_maximum") == {1: 1, 2: 0, 3: 0, 4: 0}
    assert got(N.classify_with_ipf(df, 0.5, 1), "Classification") == {1: 18, 2: 1, 3: 1, 4: 18}
    assert got(N.classify_with_ivf(df, 1.0, 1), "Classification") == {1: 1, 2: 18, 3: 18, 4: 1}


@pytest.mark.parametrize(
    "operator, most",
    [
        (lambda p: N.classify_with_ipf(p, 1.0), 2),
        (lambda p: N.classify_with_ivf(p, 2.0), 2),
        (lambda p: N.local_maximum(p, 3.0), 2),
        (lambda p: N.local_maximum_flag(p, 3.0), 2),
        (lambda p: N.neighborhood_metrics(N.local_maximum(p, 3.0), p, ["count", "z_mean"], k=0, r=2.0), 5),
        (lambda p: N.nearest_neighbours(p, p, 3, places=False), 4),
        (lambda p: N.classify_with_sor(p), 4),
        (lambda p: G.geometry_features(p, 8, features="i"), 4),
        (lambda p: S.sampling_poisson(p, 1.0), 4),
        (lambda p: U.region_growing(R.rasterize(p, 1.0, ["z_max"]), "z_max", N.local_maximum_raster(R.rasterize(p, 1.0, ["z_max"]), "z_max", 5.0), 1.0), 5),
        (lambda p: C.classify_with_csf(p, cloth_resolution=2.0), 4),
        (lambda p: I.normalize(p.withColumn("Classification", F.when(F.col("pid") % 40 == 0, 2).otherwise(1)), "HAG"), 2),
    ],
    ids=["ipf", "ivf", "local_max_points", "local_max_flag", "neighborhood_metrics", "knn", "sor", "geom_inclination", "poisson", "region_growing", "csf", "normalize"],
)
def test_points_are_shuffled_a_few_times_only(spark, tmp_path, operator, most):
    rng = np.random.default_rng(4)
    n = 30_000
    path = str(tmp_path / "cloud")
    frame = pd.DataFrame({"pid": np.arange(n), "X": rng.uniform(0, 60, n), "Y": rng.uniform(0, 100, n), "Z": rng.uniform(0, 50, n), "Classification": 1})
    spark.createDataFrame(frame).write.parquet(path)
    assert moved_rows(spark, lambda: operator(spark.read.parquet(path))) <= most * n


def test_rings_close_where_triangles_are_doubled_or_overlap(spark):
    square = [((0, 0), (2, 0), (2, 2)), ((0, 0), (2, 2), (0, 2))]
    for extra in ([square[0]], [square[0], square[1]], [((2, 0), (2, 2), (1, 1))]):
        rows = [(i, *[float(v) for x, y in t for v in (x, y, 0)]) for i, t in enumerate([*square, *extra])]
        triangles = spark.createDataFrame(rows, I.TRIANGLE)
        twice = sum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in [*square, *extra])
        rings = I.hull_rings(triangles).collect()
        assert sum(r.area for r in rings) == pytest.approx(twice / 2)
        assert all(r.ring[0] == r.ring[-1] for r in rings)


def test_a_triangle_has_one_owner_whatever_its_first_corner():
    rng = np.random.default_rng(2)
    found = 0
    for x in rng.uniform(100, 200, (300, 3)):
        means = [np.mean(x[list(order)]) for order in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
        if min(means) < max(means):
            found += 1
            y = np.array([0.25, 0.5, 0.75])
            for size in (min(means), max(means)):
                owners = [{i for i in (0, 1) if len(I.own_triangles(x, y, np.array([t]), (i, 0), size))} for t in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
                assert owners[0] == owners[1] == owners[2] and len(owners[0]) == 1
    assert found


def plain_densify(x, y, z, res, angle, distance, spacing, rounds=12):
    """Every round triangulates anew and looks all points up."""
    n = len(x)
    seeds = pd.DataFrame({"i": np.floor(x / res), "j": np.floor(y / res), "z": z}).groupby(["i", "j"])["z"].idxmin().to_numpy()
    bx, by = (np.linspace(v.min() - res, v.max() + res, max(3, int(np.ptp(v) / res) + 2)) for v in (x, y))
    edge = np.array([(u, v) for u in bx for v in by if u in (bx[0], bx[-1]) or v in (by[0], by[-1])])
    nearest = np.argmin((edge[:, :1] - x[seeds]) ** 2 + (edge[:, 1:] - y[seeds]) ** 2, axis=1)
    x, y, z = np.r_[x, edge[:, 0]], np.r_[y, edge[:, 1]], np.r_[z, z[seeds][nearest]]
    ground = np.arange(len(x)) >= n
    ground[seeds] = True

    def under():
        own, rest = np.flatnonzero(ground), np.flatnonzero(~ground)
        t = own[I.delaunay(x[own], y[own])]
        (ax, bx, cx), (ay, by, cy) = x[t].T[:, :, None], y[t].T[:, :, None]
        det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        wa = ((by - cy) * (x[rest] - cx) + (cx - bx) * (y[rest] - cy)) / det
        wb = ((cy - ay) * (x[rest] - cx) + (ax - cx) * (y[rest] - cy)) / det
        at = ((wa >= -1e-9) & (wb >= -1e-9) & (wa + wb <= 1 + 1e-9)).argmax(axis=0)
        w = np.column_stack([v[at, np.arange(len(rest))] for v in (wa, wb, 1 - wa - wb)])
        return rest, at, t[at], np.abs(z[rest] - (w * z[t[at]]).sum(1))

    for _ in range(rounds):
        rest, at, corners, off = under()
        sides = np.hypot(x[rest][:, None] - x[corners], y[rest][:, None] - y[corners])
        slope = np.abs(z[rest][:, None] - z[corners]) / np.maximum(sides, 1e-9)
        joins = (off <= distance) & (slope.max(axis=1) <= np.tan(np.radians(angle))) & (sides.min(axis=1) >= spacing)
        if not joins.any():
            break
        rows = pd.DataFrame({"t": at[joins], "off": off[joins], "p": rest[joins]}).sort_values(["t", "off", "p"])
        ground[rows.drop_duplicates("t")["p"].to_numpy()] = True
    rest, _, _, off = under()
    ground[rest[off <= spacing]] = True
    return ground[:n].astype(np.int32)


def test_densification_inserts_a_point_once_and_looks_up_what_changed(monkeypatch):
    from cloudloom.operators import tin

    inserts = []
    plain = tin.Triangulation.insert
    monkeypatch.setattr(tin.Triangulation, "insert", lambda self, p, t=None: (inserts.append(p), plain(self, p, t))[1])
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x, y = rng.uniform(0, 40, 1500), rng.uniform(0, 40, 1500)
        z = np.sin(x / 9) * 3 + np.where(rng.random(1500) < 0.5, 0, rng.uniform(0, 30, 1500))
        inserts.clear()
        got = C.densify(x, y, z, 10.0, 60.0, 2.0, 0.25)
        assert len(inserts) <= got.sum() + 60
        assert (got == plain_densify(x, y, z, 10.0, 60.0, 2.0, 0.25)).all()


@pytest.mark.parametrize("per", [40, 32_000, None])
def test_poisson_takes_what_greedy_selection_takes(spark, patchy, monkeypatch, per):
    rows, df = patchy
    if per is None:
        monkeypatch.setattr(S, "side_of", lambda *_: None)
    else:
        monkeypatch.setattr(N.L, "TILE_POINTS", per)
    a = np.array(rows)
    for distance in (0.8, 2.5):
        taken = []
        for i in sorted(range(len(a)), key=lambda i: (i * 2654435761 % (1 << 32), i)):
            if not taken or (((a[taken] - a[i]) ** 2).sum(axis=1) >= distance * distance).all():
                taken.append(i)
        got = S.sampling_poisson(df, distance)
        assert got.columns == df.columns
        assert sorted(r.pid for r in got.collect()) == sorted(taken)
