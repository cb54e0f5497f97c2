"""Registered queries against plain computations over all rows."""

import duckdb
import numpy as np

from terraloom.operators import learning, regression
from terraloom.plans import registry

D = "/root/testdata/sf0.001"


def test_evi_of_every_cell(spark):
    bands = duckdb.sql(f"SELECT l_partkey, avg(l_quantity / 100), avg(l_discount), avg(l_tax + 0.1) FROM '{D}/lineitem.parquet' GROUP BY 1").fetchall()
    got = {r["cell_id"]: r["evi"] for r in registry.QUERIES["evi"](spark, D).collect()}
    assert got.keys() == {b[0] for b in bands}
    for cell, blue, red, nir in bands:
        below = nir + 6 * red - 7.5 * blue + 1
        want = 2.5 * (nir - red) / below
        assert abs(got[cell] - want) <= 1e-4 + 1e-9 * abs(want / below)


def plane():
    e = duckdb.sql(f"SELECT vec_id, embedding[1]::DOUBLE, embedding[2]::DOUBLE, label FROM '{D}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x, y, value = (np.array(c) for c in zip(*e, strict=True))
    return ids, value, np.hypot(x[:, None] - x, y[:, None] - y)


def test_knn_of_every_point(spark):
    ids, _, far = plane()
    got = {(r["i"], r["rank"]): r["j"] for r in registry.QUERIES["knn"](spark, D).collect()}
    assert got.keys() == {(i, k) for i in ids for k in range(1, 6)}
    for n, i in enumerate(ids):
        other = np.flatnonzero(ids != i)
        for k, m in enumerate(other[np.lexsort((ids[other], far[n, other]))][:5]):
            assert abs(far[n, ids == got[i, k + 1]][0] - far[n, m]) < 1e-9


def test_distance_to_class_of_every_point(spark):
    ids, value, far = plane()
    got = {r["id"]: r["distance"] for r in registry.QUERIES["distance_to_class"](spark, D).collect()}
    want = far[:, value == 3].min(1)
    assert got.keys() == set(ids) and all(abs(got[i] - want[n]) < 2e-6 for n, i in enumerate(ids))


def test_interpolation_reaches_the_nearest(spark):
    ids, value, far = plane()
    one, three = ({r["id"]: r["value"] for r in registry.QUERIES[q](spark, D).collect()} for q in ("nearest_interp", "idw_interp"))
    known = np.flatnonzero(ids % 5 != 0)
    assert one.keys() == three.keys() == {i for i in ids if i % 5 == 0}
    for n in np.flatnonzero(ids % 5 == 0):
        near = known[np.argsort(far[n, known], kind="stable")][:3]
        assert one[ids[n]] == value[near[0]] and abs(three[ids[n]] - (value[near] / far[n, near]).sum() / (1 / far[n, near]).sum()) < 1e-4


def test_gwr_has_eleven_neighbours(spark):
    far = spark.createDataFrame([(k, float(k * k * k), 0.0, 2.0 * k + 1, float(k)) for k in range(20)], "id long, x double, y double, v double, u double")
    got = {r["id"]: r for r in regression.gwr(far, "v", ["u"], 11, 0.5).collect()}
    assert len(got) == 20 and all(abs(r["b1"] - 2) < 1e-6 and abs(r["fitted"] - 2 * k - 1) < 1e-6 for k, r in got.items())


def test_simulation_fills_all_growing_classes(spark):
    rng = np.random.default_rng(3)
    grid = [(r, c, int(rng.integers(1, 5)), float(rng.random())) for r in range(20) for c in range(20)]
    have = {k: sum(g[2] == k for g in grid) for k in range(1, 5)}
    targets = {1: have[1] + 17, 2: have[2] + 9, 3: have[3] - 24, 4: have[4] - 2}
    cells = spark.createDataFrame(grid, "row int, col int, class_id int, s double").repartition(3)
    got = learning.simulate(cells, targets, "s").collect()
    assert len(got) == 400 and {k: sum(r["simulated"] == k for r in got) for k in targets} == targets
    moved = {(r["class_id"], r["simulated"]) for r in got if r["class_id"] != r["simulated"]}
    assert moved <= {(3, 1), (3, 2), (4, 1), (4, 2)}
    got = learning.simulate(cells, targets, "s", chance={(3, 1): 0.4, (4, 2): 0.3}).collect()
    assert {k: sum(r["simulated"] == k for r in got) for k in targets} == {1: have[1] + 17, 2: have[2] + 2, 3: have[3] - 17, 4: have[4] - 2}
