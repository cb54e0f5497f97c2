"""Neighbourhoods of a grid (row, col, value): windows and patches by tiles; sides by cells that send themselves to their neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept, ship_package

#: Rows and columns of a tile, which one task labels at a time.
TILE = 256


def _sent(cells: DataFrame, radius: int, value: str) -> DataFrame:
    steps = F.array(*(F.lit(k) for k in range(-radius, radius + 1)))
    d = cells.select("row", "col", F.col(value).alias("v")).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    return d.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", "v")


def _tiled(cells: DataFrame, value: str, radius: int, fn, name: str, kind: str, tile: int) -> DataFrame:
    """fn of each tile's array with a halo of `radius` cells around it: row, col and the result of the tile's own cells.

    A cell goes to its own tile and to those whose halo it is in, so little more than once; a window of any size costs no
    more rows. The array holds NaN where there is no cell or no value.
    """
    ship_package(cells.sparkSession)
    d = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"))
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + k) / tile) for k in (-radius, 0, radius))))
    d = d.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))

    def run(t: pa.Table) -> pa.Table:
        tr, tc = t.column("tr")[0].as_py() * tile, t.column("tc")[0].as_py() * tile
        row, col = t.column("row").to_numpy(), t.column("col").to_numpy()
        x = np.full((tile + 2 * radius, tile + 2 * radius), np.nan)
        x[row - tr + radius, col - tc + radius] = t.column("v").to_numpy(zero_copy_only=False)
        own = (row >= tr) & (row < tr + tile) & (col >= tc) & (col < tc + tile)
        got = fn(x)[row[own] - tr, col[own] - tc]
        return pa.table({"row": row[own], "col": col[own], name: pa.array(got, mask=np.isnan(got))})

    kinds = dict(cells.dtypes)
    found = d.groupBy(F.col("tr").alias("__r"), F.col("tc").alias("__c")).applyInArrow(lambda t: run(t), f"row long, col long, {name} double")
    return found.select(F.col("row").cast(kinds["row"]).alias("row"), F.col("col").cast(kinds["col"]).alias("col"), F.col(name).cast(kind).alias(name))


def _box(x: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the square window of each place that has a whole one."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    s[1:, 1:] = x.cumsum(0).cumsum(1)
    w = 2 * radius + 1
    return s[w:, w:] - s[:-w, w:] - s[w:, :-w] + s[:-w, :-w]


def mode(cells: DataFrame, value: str, radius: int = 1, tile: int = TILE) -> DataFrame:
    """The most frequent value of the square neighbourhood; of ties the smallest. Nulls don't count; null where all are."""

    def most(x: np.ndarray) -> np.ndarray:
        out, best = np.full((tile, tile), np.nan), np.zeros((tile, tile))
        for k in np.unique(x[~np.isnan(x)]):
            n = _box(x == k, radius)
            more = n > best
            out[more], best[more] = k, n[more]
        return out

    return _tiled(cells, value, radius, most, "mode", dict(cells.dtypes)[value], tile)


def mean(cells: DataFrame, value: str, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Sum over the square divided by its full size: outside and nulls count as zero."""
    return _tiled(cells, value, radius, lambda x: _box(np.nan_to_num(x), radius) / (2 * radius + 1) ** 2, "mean", "double", tile)


def edges(cells: DataFrame, value: str) -> DataFrame:
    """For each class: cells, and sides shared with cells of another class or the outside."""
    side = (F.abs("dr") + F.abs("dc")) == 1
    s = _sent(cells, 1, value).filter(side | ((F.col("dr") == 0) & (F.col("dc") == 0)))
    g = s.groupBy("row", "col").agg(F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("v"))).alias("own"), F.collect_list(F.when(side, F.col("v"))).alias("next"))  # four at most
    g = g.filter("own IS NOT NULL").withColumn("same", F.size(F.filter("next", lambda x: x == F.col("own"))))
    return g.groupBy(F.col("own").alias("class_id")).agg(F.count("*").alias("n_cells"), F.sum(4 - F.col("same")).alias("n_edges"), F.sum("same").alias("n_like"))


def terrain(cells: DataFrame, elevation: str, size: float) -> DataFrame:
    """Slope in degrees and aspect by Horn's formula; null at the border."""
    at = lambda r, c: F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("v")))
    s = _sent(cells, 1, elevation)
    g = s.groupBy("row", "col").agg(*(at(r, c).alias(f"v{r + 1}{c + 1}") for r in (-1, 0, 1) for c in (-1, 0, 1))).filter("v11 IS NOT NULL")
    v = lambda r, c: F.col(f"v{r + 1}{c + 1}")
    gx = (v(-1, 1) + 2 * v(0, 1) + v(1, 1) - v(-1, -1) - 2 * v(0, -1) - v(1, -1)) / (8 * size)
    gy = (v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)) / (8 * size)
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"), F.pmod(F.degrees(F.atan2(gy, -gx)) + 90, F.lit(360.0)).alias("aspect"))


def _labelled(batch: pa.Table, diagonal: bool) -> pa.Table:
    """A tile's cells with the least number of a cell that like cells connect each with."""
    row, col, v, number = (batch.column(c).to_numpy() for c in ("row", "col", "code", "id"))
    order = np.argsort(number, kind="stable")
    row, col, v, number = row[order], col[order], v[order], number[order]
    r, c = row - row.min(), col - col.min()
    at = np.full((r.max() + 3, c.max() + 3), -1)
    at[r + 1, c + 1] = np.arange(len(r))
    ends = []
    for dr, dc in [(0, 1), (1, 0), (1, 1), (1, -1)][: 4 if diagonal else 2]:
        other = at[r + 1 + dr, c + 1 + dc]
        k = np.flatnonzero((other >= 0) & (v[np.maximum(other, 0)] == v))
        ends.append((k, other[k]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    root = np.arange(len(r))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tolist() != root.tolist():
            root = up
    return batch.select(["row", "col"]).take(pa.array(order)).append_column("code", pa.array(v)).append_column("patch", pa.array(number[root]))


def patches(cells: DataFrame, value: str, diagonal: bool = False, rounds: int = 100, tile: int = TILE) -> DataFrame:
    """Connected cells of one value: row, col, value and the patch, named by its least cell number.

    Tiles are labelled by themselves; then only cells at tiles' edges meet those across, and the labels that they link
    spread their minimum, each round following a label to its own label, which halves long ways. Null values have no patch.
    """
    ship_package(cells.sparkSession)
    number = F.col("row").cast("long") * F.lit(1 << 31) + F.col("col")
    base = cells.filter(F.col(value).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("long").alias("code"), number.alias("id"))
    in_tile = base.groupBy(F.expr(f"row div {tile}").alias("tr"), F.expr(f"col div {tile}").alias("tc"))
    marked = kept(in_tile.applyInArrow(lambda t: _labelled(t, diagonal), "row long, col long, code long, patch long"), "patch-tiles")
    edge = (F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1))
    border = marked.filter(edge)
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in [(0, 1), (1, 0), (1, 1), (1, -1)][: 4 if diagonal else 2]))
    way = border.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "code", F.col("patch").alias("a"))
    links = kept(way.join(border, ["row", "col", "code"]).filter("a <> patch").select("a", F.col("patch").alias("b")).distinct(), "patch-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots, before = links.selectExpr("inline(array(struct(a AS a, a AS root), struct(b AS a, b AS root)))").distinct(), None
    for _ in range(rounds):
        near = both.join(roots.withColumnsRenamed({"a": "b"}), "b").select("a", "root")
        least = near.unionByName(roots).groupBy("a").agg(F.min("root").alias("root"))
        roots = kept(least.join(least.select(F.col("a").alias("root"), F.col("root").alias("up")), "root").select("a", F.least("root", "up").alias("root")), "patch-roots")
        state = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("patches did not settle")
    kinds = dict(cells.dtypes)
    found = marked.join(roots, marked["patch"] == roots["a"], "left").withColumn("patch", F.coalesce("root", "patch"))
    return found.select(F.col("row").cast(kinds["row"]).alias("row"), F.col("col").cast(kinds["col"]).alias("col"), F.col("code").cast(kinds[value]).alias(value), "patch")


def patch_metrics(labelled: DataFrame, value: str, cell_ha: float) -> DataFrame:
    """By class: patches, patch density, largest patch index, mean and deviation of patch areas."""
    p = labelled.groupBy(value, "patch").agg((F.count("*") * cell_ha).alias("a"))
    total = labelled.agg((F.count("*") * cell_ha).alias("t"))
    g = p.groupBy(value).agg(F.count("*").alias("np"), F.sum("a").alias("class_area"), F.max("a").alias("largest"), F.avg("a").alias("area_mn"), F.stddev_pop("a").alias("area_sd"))
    return g.join(F.broadcast(total)).select(value, "np", "class_area", (F.col("np") / F.col("t") * 100).alias("pd"), (F.col("largest") / F.col("t") * 100).alias("lpi"), "area_mn", "area_sd")


def _sides(cells: DataFrame, *names: str) -> DataFrame:
    """Each side that two cells share, once: their columns as a_... and b_..."""
    steps = F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")))
    a = cells.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), *(F.col(n).alias(f"a_{n}") for n in names))
    return a.join(cells.select("row", "col", *(F.col(n).alias(f"b_{n}") for n in names)), ["row", "col"])


def edge_cells(cells: DataFrame, value: str, size: float) -> DataFrame:
    """By class: cells with a neighbour (of eight) of another class, and the length that they stand for. The outside is no neighbour."""
    s = _sent(cells, 1, value)
    centre = (F.col("dr") == 0) & (F.col("dc") == 0)
    g = s.groupBy("row", "col").agg(F.max(F.when(centre, F.col("v"))).alias("own"), F.min("v").alias("low"), F.max("v").alias("high")).filter("own IS NOT NULL")
    return g.groupBy(F.col("own").alias("class_id")).agg(F.count_if(F.col("low") != F.col("high")).alias("n_edge")).withColumn("edge_length", F.col("n_edge") * size)


def fragmentation(labelled: DataFrame, value: str, size: float) -> DataFrame:
    """By class: total edge in metres, edge density (metres a hectare), cohesion and aggregation in percent.

    Edges are sides between two classes of the grid; a patch's perimeter counts the outside, too. The published formulas:
    cohesion (1 - sum p / sum p sqrt(a)) / (1 - 1 / sqrt(Z)) of perimeters in sides and areas in cells, Z cells in all;
    aggregation g / max g of like adjacencies, each counted once.
    """
    sides = _sides(labelled, value, "patch")
    like = sides.filter(F.col(f"a_{value}") == F.col(f"b_{value}")).groupBy(F.col("a_patch").alias("patch")).agg(F.count("*").alias("g"))
    unlike = sides.filter(F.col(f"a_{value}") != F.col(f"b_{value}")).select(F.explode(F.array(f"a_{value}", f"b_{value}")).alias(value)).groupBy(value).agg(F.count("*").alias("e"))
    p = labelled.groupBy(value, "patch").agg(F.count("*").alias("a")).join(like, "patch", "left").fillna(0, ["g"]).withColumn("p", 4 * F.col("a") - 2 * F.col("g"))
    c = p.groupBy(value).agg(F.sum("a").alias("a"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.col("p") * F.sqrt("a")).alias("pa"))
    d = c.join(unlike, value, "left").fillna(0, ["e"]).join(F.broadcast(labelled.agg(F.count("*").alias("z"))))  # one row
    n = F.floor(F.sqrt("a"))
    m = F.col("a") - n * n
    most = 2 * n * (n - 1) + F.when(m == 0, 0).when(m <= n, 2 * m - 1).otherwise(2 * m - 2)
    cohesion = F.try_divide(1 - F.try_divide("p", "pa"), 1 - 1 / F.sqrt("z")) * 100
    return d.select(value, (F.col("e") * size).alias("total_edge"), (F.col("e") * size / (F.col("z") * size * size / 10000)).alias("edge_density"), cohesion.alias("cohesion"), (F.try_divide("g", most) * 100).alias("aggregation"))
