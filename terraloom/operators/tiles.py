"""Points dealt over tiles of about as many points each: nearest points and sums within a radius, without rows of pairs.

Tiles are strips along x, each cut along y, at approximate quantiles. The cuts only balance the work: boxes of the points that a
tile holds decide what meets what, and they bound computed distances exactly, since rounding keeps order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import kept, ship_package

#: Sources of a tile, and targets that a task searches there at a time, for nearest points; points of a tile for sums.
TILE, CHUNK, WIDE = 2048, 8192, 16384
#: Points that have one box within a tile, and distances of nearest points held at a time.
LEAF, HELD = 32, 1 << 20


class Tiles:
    """Cuts along x, and for each strip cuts along y; the points, box and number of each tile that holds some."""

    def __init__(self, cuts: Sequence[float], rows: Sequence[Sequence[float]]):
        self.cuts, self.rows = np.unique(np.array(cuts, float)), [np.unique(np.array(r, float)) for r in rows]
        self.first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in self.rows])])
        self.ids, self.counts, self.boxes = np.zeros(0, int), np.zeros(0, int), np.zeros((0, 4))

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.cuts, x, "right")
        out = np.zeros(len(x), np.int32)
        for s in np.unique(strip):
            here = strip == s
            out[here] = self.first[s] + np.searchsorted(self.rows[s], y[here], "right") if s < len(self.rows) else 0
        return out


def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of the points of boxes (x0, y0, x1, y1), rows of a against rows of b."""
    a, b = a[:, None, :], b[None, :, :]
    gap = np.maximum(np.maximum(b[..., :2] - a[..., 2:], a[..., :2] - b[..., 2:]), 0.0)
    span = np.maximum(b[..., 2:] - a[..., :2], a[..., 2:] - b[..., :2])
    return np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2), np.sqrt(span[..., 0] ** 2 + span[..., 1] ** 2)


def finite(points: DataFrame) -> DataFrame:
    """Points with a place: no pair has a distance otherwise."""
    return points.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def placed(points: DataFrame, tiles: Tiles) -> DataFrame:
    """Points with the number of their tile."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tiles.of(_column(b, "x"), _column(b, "y")), pa.int32())], names=[*b.schema.names, "__tile"])

    return points.mapInArrow(lambda it: run(it), StructType([*points.schema.fields, StructField("__tile", IntegerType())]))


def boxes(at: DataFrame, tiles: Tiles) -> Tiles:
    """The tiles' points and boxes in `at`, a row a tile to the driver."""
    got = sorted(tuple(r) for r in at.groupBy("__tile").agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).collect())
    out = Tiles(tiles.cuts, tiles.rows)
    out.ids, out.counts, out.boxes = np.array([r[0] for r in got], int), np.array([r[1] for r in got], int), np.array([r[2:] for r in got], float).reshape(-1, 4)
    return out


def dealt(points: DataFrame, size: int) -> tuple[Tiles, DataFrame]:
    """Tiles of about `size` of the points, and the points with their tiles, kept."""
    grain = [k / 1000 for k in range(1, 1000)]
    row = points.agg(F.count("*"), F.percentile_approx("x", grain)).first()
    many = -(-row[0] // size)
    if many <= 1:
        tiles = Tiles([], [[]])
    else:
        tiles = Tiles(_every(row[1], min(1000, int(np.ceil(many**0.5)))), [])
        strips = Tiles(tiles.cuts, [[]] * (len(tiles.cuts) + 1))
        got = {r[0]: r for r in placed(points, strips).groupBy("__tile").agg(F.count("*"), F.percentile_approx("y", grain)).collect()}
        tiles = Tiles(tiles.cuts, [_every(got[s][2], min(1000, -(-got[s][1] // size))) if s in got else [] for s in range(len(tiles.cuts) + 1)])
    at = kept(placed(points, tiles), "tiles")
    return boxes(at, tiles), at


def _every(quantiles: Sequence[float], parts: int) -> list[float]:
    """The cuts into so many parts, of the 999 thousandths."""
    return [quantiles[round(k * 1000 / parts) - 1] for k in range(1, parts)]


def _over(df: DataFrame, keys: Sequence[str], groups: int):
    """Grouped, in as many partitions as there are groups: they are small and take long, so none are merged."""
    return df.repartition(max(1, min(groups, 1024)), *keys).groupBy(*keys)


def _nearest_here(x: np.ndarray, y: np.ndarray, ids: np.ndarray, sx: np.ndarray, sy: np.ndarray, sids: np.ndarray, k: int, itself: bool):
    """Blocks (first row, distances, the k-th least of each) of targets against sources in the order of their ids."""
    step = max(1, HELD // max(1, len(sx)))
    for a in range(0, len(x), step):
        d = np.sqrt((x[a : a + step, None] - sx) ** 2 + (y[a : a + step, None] - sy) ** 2)
        if not itself:
            d[ids[a : a + step, None] == sids] = np.inf
        yield a, d, np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    side = _column(table, "__side")
    t, s = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    return t, s.take(pa.array(np.argsort(_column(s, "id"), kind="stable")))


def nearest(targets: DataFrame, sources: DataFrame, k: int, payload: Sequence[str] = (), itself: bool = True) -> DataFrame:
    """Pairs (i, j, d, payload of j) that hold the k nearest sources of each target, ties by id; all of them if fewer.

    Each target is searched in its tile, and then in every tile that is as near as the k-th found there: a target of several
    tiles has up to k rows of each, for the caller to choose from. Without `itself` a source of the target's id is left out.
    """
    ship_package(targets.sparkSession)
    t, s = finite(targets.select("id", "x", "y")), finite(sources.select("id", "x", "y", *payload))
    tiles, s = dealt(s, TILE)
    if len(tiles.counts) and tiles.counts.max() > 4 * TILE:  # many points of one place: of these only the least ids can be among the k nearest
        w = Window.partitionBy("x", "y").orderBy("id")
        s = kept(s.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k + (not itself)).drop("__n"), "tiles")
        tiles = boxes(s, tiles)
    need = k + (not itself)
    t = placed(t, tiles)
    if len(tiles.ids) > 1:
        t = kept(t, "targets")

        def reach(table: pa.Table) -> pa.Table:
            here, there = _split(table)
            x, y, ids = (_column(here, c) for c in ("x", "y", "id"))
            which, out = [], []
            for a, d, far in _nearest_here(x, y, ids, *(_column(there, c) for c in ("x", "y", "id")), k, itself):
                n = len(d)
                at = np.column_stack([x[a : a + n], y[a : a + n]] * 2)
                short = ~np.isfinite(far)
                if short.any():  # a tile of too few: as far as the tiles that surely hold enough
                    for m in np.flatnonzero(short):
                        most = apart(at[m : m + 1], tiles.boxes)[1][0]
                        order = np.argsort(most)
                        enough = np.searchsorted(np.cumsum(tiles.counts[order]), need)
                        far[m] = most[order[enough]] if enough < len(order) else np.inf
                box = np.array([[at[:, 0].min(), at[:, 1].min(), at[:, 0].max(), at[:, 1].max()]])
                close = np.flatnonzero(apart(box, tiles.boxes)[0][0] <= far.max())
                row, col = np.nonzero(apart(at, tiles.boxes[close])[0] <= far[:, None])
                which.append(row + a)
                out.append(tiles.ids[close[col]])
            which, out = np.concatenate(which or [np.zeros(0, int)]), np.concatenate(out or [np.zeros(0, int)])
            return here.select(["id", "x", "y"]).take(pa.array(which)).append_column("__tile", pa.array(out, pa.int32()))

        t = _over(*_met(t, s.select("id", "x", "y", "__tile"))).applyInArrow(lambda g: reach(g), f"id {t.schema['id'].dataType.simpleString()}, x double, y double, __tile int")
        t = kept(t, "targets")

    def answer(table: pa.Table) -> pa.Table:
        here, there = _split(table)
        ids, left, right, dist = _column(here, "id"), [], [], []
        for a, d, far in _nearest_here(_column(here, "x"), _column(here, "y"), ids, *(_column(there, c) for c in ("x", "y", "id")), k, itself):
            row, col = np.nonzero((d <= far[:, None]) & np.isfinite(d))
            order = np.lexsort((d[row, col], row))  # stable: ties stay in the order of ids
            row, col = row[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            left.append(row[rank < k] + a)
            right.append(col[rank < k])
            dist.append(d[left[-1] - a, right[-1]])
        left, right = (pa.array(np.concatenate(c or [np.zeros(0, int)])) for c in (left, right))
        chosen = there.take(right)
        return pa.Table.from_arrays([here.column("id").take(left), chosen.column("id"), pa.array(np.concatenate(dist or [np.zeros(0)])), *(chosen.column(c) for c in payload)], names=["i", "j", "d", *payload])

    kinds = {f.name: f.dataType.simpleString() for f in s.schema}
    schema = f"i {t.schema['id'].dataType.simpleString()}, j {kinds['id']}, d double" + "".join(f", `{c}` {kinds[c]}" for c in payload)
    return _over(*_met(t, s)).applyInArrow(lambda g: answer(g), schema)


def _met(t: DataFrame, s: DataFrame) -> tuple[DataFrame, list[str], int]:
    """Targets and sources of a tile in one group; CHUNK targets at a time where a tile has more, with its sources for each."""
    many = {r[0]: -(-r[1] // CHUNK) for r in t.groupBy("__tile").count().collect()}  # a row a tile
    parts = max(many.values(), default=1)
    if parts > 1:
        rows = t.sparkSession.createDataFrame(list(many.items()), "__tile int, __parts int")
        t = t.join(F.broadcast(rows), "__tile").withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).drop("__parts")
        s = s.join(F.broadcast(rows), "__tile").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    else:
        t, s = t.withColumn("__part", F.lit(0)), s.withColumn("__part", F.lit(0))
    return t.withColumn("__side", F.lit(0)).unionByName(s.withColumn("__side", F.lit(1)), allowMissingColumns=True), ["__tile", "__part"], sum(many.values())


def _leaves(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of points, the firsts of its runs of LEAF near points, and the runs' boxes."""
    strip = LEAF * max(1, round((len(x) / LEAF) ** 0.5))
    order = np.argsort(x, kind="stable")
    order = order[np.lexsort((y[order], np.arange(len(x)) // strip))]
    first = np.arange(0, len(x), LEAF)
    px, py = x[order], y[order]
    return order, first, np.column_stack([np.minimum.reduceat(px, first), np.minimum.reduceat(py, first), np.maximum.reduceat(px, first), np.maximum.reduceat(py, first)])


def local_sums(tx: np.ndarray, ty: np.ndarray, tid: np.ndarray, sx: np.ndarray, sy: np.ndarray, sid: np.ndarray, v: np.ndarray, radius: float, itself: bool) -> np.ndarray:
    """For each target the sums of the rows of v whose sources are at most radius away.

    Runs of sources whose box is within the radius of a run of targets give their sum, those whose box isn't are passed over, and
    only the others are compared point by point.
    """
    out, odd = np.zeros((len(tx), v.shape[1])), ~np.isfinite(v)
    if not len(tx) or not len(sx):
        return out
    if odd.any():  # sums of NaN and infinities hold where they are met
        parts = local_sums(tx, ty, tid, sx, sy, sid, np.hstack([np.where(odd, 0.0, v), np.isnan(v), v == np.inf, v == -np.inf]).astype(float), radius, itself)
        total, nan, plus, minus = np.hsplit(parts, 4)
        total = np.where(plus > 0, np.inf, np.where(minus > 0, -np.inf, total))
        return np.where((nan > 0) | ((plus > 0) & (minus > 0)), np.nan, total)
    to, tfirst, tbox = _leaves(tx, ty)
    so, sfirst, sbox = _leaves(sx, sy)
    sx, sy, sid, v = sx[so], sy[so], sid[so], v[so]
    totals = np.add.reduceat(v, sfirst, axis=0)
    by_id = np.argsort(sid, kind="stable")
    ordered = sid[by_id]
    for a, begin in enumerate(tfirst):
        rows = to[begin : begin + LEAF]
        near, far = (m[0] for m in apart(tbox[a : a + 1], sbox))
        full, meets = far <= radius, near <= radius
        if not itself:
            lo, hi = np.searchsorted(ordered, tid[rows], "left"), np.searchsorted(ordered, tid[rows], "right")
            mine = by_id[np.concatenate([np.arange(p, q) for p, q in zip(lo, hi, strict=True)])]
            full[mine // LEAF] = False
        got = totals[full].sum(0)
        some = np.flatnonzero(meets & ~full)
        if len(some):
            cols = (sfirst[some, None] + np.arange(LEAF)).ravel()
            cols = cols[cols < len(sx)]
            close = np.sqrt((tx[rows, None] - sx[cols]) ** 2 + (ty[rows, None] - sy[cols]) ** 2) <= radius
            if not itself and len(mine):
                close &= tid[rows, None] != sid[cols]
            got = got + close.astype(float) @ v[cols]
        out[rows] = got
    return out


def sums_within(targets: DataFrame, sources: DataFrame, radius: float, values: Sequence[str], itself: bool = True) -> DataFrame:
    """id, n and the sums of `values` (doubles, none null) of the sources at most radius from each target that has a place.

    Tiles wholly within the radius of a tile give their sums, other tiles that it reaches meet it with their points. Without
    `itself` a source of the target's id, at its place, is left out.
    """
    ship_package(targets.sparkSession)
    tiles, s = dealt(finite(sources.select("id", "x", "y", *values)), WIDE)
    t = kept(placed(finite(targets.select("id", "x", "y")), tiles), "targets")
    goals = boxes(t, tiles)
    near, far = apart(goals.boxes, tiles.boxes)
    full = (far <= radius) & (itself | (goals.ids[:, None] != tiles.ids))
    meets = (near <= radius) & ~full
    total = {r[0]: np.array(r[1:], float) for r in s.groupBy("__tile").agg(F.count("*"), *(F.sum(v) for v in values)).collect()} if full.any() else {}
    base = {int(g): sum(total[tiles.ids[m]] for m in np.flatnonzero(full[n])) for n, g in enumerate(goals.ids) if full[n].any()}
    pairs = [(int(goals.ids[n]), int(tiles.ids[m])) for n, m in zip(*np.nonzero(meets), strict=True)]
    met = {p for p, _ in pairs}
    pairs += [(int(g), -1) for g in goals.ids if int(g) not in met]  # rows for targets that meet no points
    firsts = {p: q for p, q in reversed(pairs)}
    rows = targets.sparkSession.createDataFrame(pairs, "__tile int, __other int")
    both = t.join(F.broadcast(rows), "__tile").withColumn("__side", F.lit(0)).unionByName(s.withColumnRenamed("__tile", "__other").join(F.broadcast(rows), "__other").withColumn("__side", F.lit(1)), allowMissingColumns=True)

    def add(key, table: pa.Table) -> pa.Table:
        here, there = _split(table)
        v = np.column_stack([np.ones(len(there)), *(_column(there, c) for c in values)]).astype(float)
        got = local_sums(*(_column(here, c) for c in ("x", "y", "id")), *(_column(there, c) for c in ("x", "y", "id")), v, radius, itself)
        tile, other = (k.as_py() for k in key)
        if firsts[tile] == other and tile in base:
            got = got + base[tile]
        return pa.Table.from_arrays([here.column("id"), pa.array(got[:, 0].astype(np.int64)), *(pa.array(c) for c in got[:, 1:].T)], names=["id", "n", *values])

    schema = f"id {t.schema['id'].dataType.simpleString()}, n long" + "".join(f", `{c}` double" for c in values)
    part = _over(both, ["__tile", "__other"], len(pairs)).applyInArrow(lambda k, g: add(k, g), schema)
    return part.groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in values))
