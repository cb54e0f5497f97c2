"""Nearest points and sums within a radius against plain computations, over many tiles and odd places."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terraloom.operators import regression, spatial, tiles
from terraloom.plans import registry


@pytest.fixture
def small(monkeypatch):
    for name, size in (("TILE", 20), ("CHUNK", 60), ("WIDE", 25)):
        monkeypatch.setattr(tiles, name, size)


def scattered():
    """A cloud, a far point, a line, and one place of 90 points."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=150), [1e6], np.zeros(40), np.full(90, 0.25)])
    y = np.concatenate([rng.normal(size=150), [-1e6], np.linspace(-3, 3, 40), np.full(90, 0.5)])
    ids = rng.permutation(len(x)) * 3
    return ids, x, y, np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)


def frame(spark, ids, x, y, v):
    rows = [(int(i), float(a), float(b), float(c)) for i, a, b, c in zip(ids, x, y, v, strict=True)]
    return spark.createDataFrame([*rows, (10**6, float("nan"), 0.0, 1.0), (10**6 + 1, None, 0.0, 1.0)], "id long, x double, y double, value double").repartition(3)


@pytest.mark.parametrize("itself", [False, True])
def test_nearest_over_many_tiles(spark, small, itself):
    ids, x, y, far = scattered()
    p = frame(spark, ids, x, y, ids)
    b = p.filter("id % 2 = 0") if itself else p
    e = spatial.knn(p, 7, 0.1, b) if itself else spatial.knn(p, 7, 0.1)
    got = {(r["i"], r["rank"]): (r["j"], r["d"]) for r in e.collect()}
    assert len(got) == 7 * len(ids)
    for n, i in enumerate(ids):
        other = np.flatnonzero(ids % 2 == 0) if itself else np.flatnonzero(ids != i)
        for k, m in enumerate(other[np.lexsort((ids[other], far[n, other]))][:7]):
            assert got[i, k + 1] == (ids[m], far[n, m])


def test_nearest_of_few_sources(spark, small):
    ids, x, y, far = scattered()
    p = frame(spark, ids, x, y, ids)
    few = [int(i) for i in ids[::100]]
    got = tiles.nearest(p, p.filter(F.col("id").isin(few)), 5).groupBy("i").count().collect()
    assert len(got) == len(ids) and {r["count"] for r in got} == {len(few)}


def test_nearest_makes_rows_by_points_not_by_pairs(spark, small):
    ids, x, y, _ = scattered()
    assert tiles.nearest(frame(spark, ids, x, y, ids), frame(spark, ids, x, y, ids), 3, itself=False).count() < 3 * 4 * len(ids)


@pytest.fixture(scope="module")
def cloud(tmp_path_factory):
    """5,000 points, of which a fifth of all pairs are within 0.12: 5 million pairs."""
    rng, d = np.random.default_rng(1), tmp_path_factory.mktemp("cloud")
    e = pa.array((rng.normal(size=(5000, 3)) * 0.125).astype(np.float32).tolist(), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(5000), "embedding": e, "label": pa.array(rng.integers(0, 10, 5000), pa.int32())}), d / "embeddings.parquet")
    return str(d)


def shuffled(spark):
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("name, most", [("knn", 4), ("distance_to_class", 2), ("nearest_interp", 2), ("idw_interp", 2), ("gwr", 8), ("gwr_summary", 8), ("ols_against_gwr", 8), ("gwr_bandwidth", 30), ("distance_band_weights", 4), ("moran_i", 4), ("gi_star", 4), ("buffer_mean", 4)])
def test_shuffles_points_not_pairs(spark, cloud, name, most):
    before = shuffled(spark)
    q = registry.QUERIES[name](spark, cloud)
    assert q.count() and "__i" not in q._jdf.queryExecution().toString()
    assert shuffled(spark) - before < most * 1e6


def test_a_point_among_many_of_one_place_keeps_its_own_values(spark):
    rng = np.random.default_rng(2)
    rows = [(k, 0.0, 0.0, float(a), float(3 * a + 1)) for k, a in enumerate(rng.normal(size=40))]
    got = {r["id"]: r for r in regression.gwr(spark.createDataFrame(rows, "id long, x double, y double, u double, v double"), "v", ["u"], 11, 0.5).collect()}
    assert all(abs(got[k]["fitted"] - v) < 1e-6 and abs(got[k]["residual"]) < 1e-6 for k, *_, v in rows)


@pytest.mark.parametrize("itself", [False, True])
def test_sums_over_many_tiles(spark, small, itself):
    ids, x, y, far = scattered()
    v = np.where(ids % 50 == 0, 1e18, ids % 7.0)
    v[ids == 51] = np.nan
    p = frame(spark, ids, x, y, v)
    for radius in (0.05, 0.7, 50.0, 1e7):
        got = {r["id"]: r for r in tiles.sums_within(p, p, radius, ["value"], itself).collect()}
        assert got.keys() == set(ids)
        for n, i in enumerate(ids):
            near = (far[n] <= radius) & (itself | (ids != i))
            want = v[near].sum()
            assert got[i]["n"] == near.sum() and (np.isnan(want) and np.isnan(got[i]["value"]) or abs(got[i]["value"] - want) <= 1e-12 * abs(want)), (radius, i)


def test_bands_are_those_of_the_edges(spark, small):
    ids, x, y, _ = scattered()
    p = frame(spark, ids, x, y, ids % 11).filter("id < 1000000")
    e = spatial.neighbours(p, 0.3)
    one, two = spatial.moran(p, e).first(), spatial.moran_band(p, 0.3).first()
    assert all(abs(one[c] - two[c]) <= 1e-9 * abs(one[c]) for c in ("moran_i", "expected", "variance", "z"))
    for star in (False, True):
        want = {r["id"]: r["z"] for r in spatial.getis_ord(p, e, star).collect()}
        got = {r["id"]: r["z"] for r in spatial.getis_ord_band(p, 0.3, star).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - z) < 1e-8 for k, z in want.items())
    want = {r["i"]: (r["n"], r["d"]) for r in e.groupBy("i").agg(F.count("*").alias("n"), F.min("d").alias("d")).collect()}
    assert {r["id"]: (r["n"], r["nearest"]) for r in spatial.band(p, 0.3).collect()} == want
