"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import NOT_SPACE, U, Words, mix, pieces_of
from .common import keyed_texts, looked_up, small_batches, stored, texts_of
from .components import components

#: Words in a shingle; sets link when HUNDREDTHS hundredths of their union, or more, are common.
SHINGLE, HUNDREDTHS = 3, 90
#: Growth of the size bands.
BAND = 1.15
#: Classes of one signature, and their shingles, that a task compares with each other; more are compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Smallest signatures of a class that go with it, so that a pair with several in common meets under one.
LEAST = 8
#: Weight of an expected false candidate against a signature, in the cost of an allocation.
CANDIDATE_COST = 4.0
#: Cells in which all rows' shingles are counted to find common ones, and how many of them are sent together.
COMMON, TOGETHER = 1 << 21, 1 << 14
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def sets_of(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its shingles of n words; fewer words are one shingle."""
    w = Words(texts, NOT_SPACE)
    count, total = len(w.hash), np.zeros(len(w.hash), U)
    for k in range(n):
        shifted = np.zeros(count, U)
        shifted[: count - k] = w.hash[k:] if k < count else 0
        total += mix(shifted + _ODD[k % 3] * np.array([k + 1], U)) * _ODD[(k + 1) % 3]
    shingles = mix(total)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(shingles[a : b - n + 1])
        elif b > a:
            yield mix(np.array([int(np.bitwise_xor.reduce(mix(w.hash[a:b] + np.arange(1, b - a + 1, dtype=U))))], U) ^ U(b - a))
        else:
            yield np.zeros(0, U)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, as two signed numbers; the first names it among candidates, both decide."""
    size = mix(np.array([len(s)], U))
    both = mix(s ^ _ODD[0]).sum(dtype=U, keepdims=True) ^ size, mix(mix(s ^ _ODD[2]) + _ODD[1]).sum(dtype=U, keepdims=True) + size
    return tuple(int(x.view(np.int64)[0]) for x in both)


def differences(total: int, hundredths: int) -> int:
    """The most elements in only one of two linked sets with `total` elements together."""
    return total * (100 - hundredths) // (100 + hundredths)


def links(common: int, total: int, hundredths: int) -> bool:
    return 100 * common >= hundredths * (total - common)


@functools.cache
def bands(hundredths: int, most: int) -> list[tuple[int, int]]:
    """Sizes [lo, hi) of the bands, from the least size at which different sets can link."""
    lo = 1
    while differences(lo + lo * 100 // hundredths, hundredths) < 1:
        lo += 1
    out = []
    while lo <= most:
        hi = max(lo + 1, int(lo * BAND) + 1)
        out.append((lo, hi))
        lo = hi
    return out


def allocate(lo: int, hi: int, hundredths: int, rows: int) -> tuple[int, int, int]:
    """For a band: segments compared whole, segments compared up to one deletion, and weak segments that a set may skip.

    Two linked sets differ in H elements at most. A segment compared whole absorbs no difference, one compared with its
    one-deletion neighbourhood absorbs one; so segments + deletions > H + slack leaves a match that is not skipped. Among
    the allocations the cheapest is taken: signatures of a set, plus expected false candidates among `rows` sets.
    """
    h = differences(hi - 1 + (hi - 1) * 100 // hundredths, hundredths)
    best = None
    for near in sorted({0, 1, (h + 2) // 4, (h + 2) // 2}):
        skip = 0
        while True:
            whole = max(0, h + 1 + (2 if near else 1) * skip - 2 * near)
            m = whole + near
            size = lo / m
            weak = m * math.exp(-size) * (1 + (size if near else 0))
            tail = 1 - sum(math.exp(-weak) * weak**k / math.factorial(k) for k in range(skip + 1))
            if tail < 1e-6 or skip >= 8:
                break
            skip += 1
        false = rows * math.exp(-2 * size) * (whole + near * (1 + 2 * size))
        cost = whole + near * (1 + size) + CANDIDATE_COST * (false * max(tail, 1e-6) + rows * m * math.exp(-1.2 * size) * 1e-4)
        if best is None or cost < best[0]:
            best = (cost, whole, near, skip)
    return best[1:]


class Signatures:
    """Signatures of a set in its own band and in those of the smaller sets that it may link with."""

    def __init__(self, hundredths: int, counts: dict[int, int], most: int):
        self.hundredths, self.bands = hundredths, bands(hundredths, most)
        self.lows = np.array([lo for lo, _ in self.bands])
        self.plans = [allocate(lo, hi, hundredths, counts.get(k, 0)) for k, (lo, hi) in enumerate(self.bands)]

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        own = self.band(n) if len(self.bands) else -1
        if own < 0:
            return np.zeros(0, U)
        least = max(self.band(-(-n * self.hundredths // 100)), 0)
        value = mix(s ^ _ODD[1])
        sums = np.zeros(n + 1, U)
        np.cumsum(value, out=sums[1:])
        return np.concatenate([self._in_band(k, s, value, sums) for k in range(least, own + 1)])

    def _in_band(self, k: int, s: np.ndarray, value: np.ndarray, sums: np.ndarray) -> np.ndarray:
        whole, near, skip = self.plans[k]
        m = whole + near
        edges = (np.arange(1, m, dtype=object) * 2**64 // m).astype(U)  # hashes are spread evenly: equal ranges are segments
        cut = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]).astype(np.int64)
        size = np.diff(cut)
        content = sums[cut[1:]] - sums[cut[:-1]]
        weak = size <= np.where(np.arange(m) < near, 1, 0)
        cost = int((weak * np.where(np.arange(m) < near, 2, 1)).sum())
        use = np.ones(m, bool) if cost > skip else ~weak
        at = np.arange(m, dtype=U) * _ODD[0] + U(k) * _ODD[2]
        out = [mix(content[use] ^ mix(at[use] + U(1)))]
        for j in np.flatnonzero(use[:near]):
            out.append(mix((content[j] - value[cut[j] : cut[j + 1]]) ^ mix(at[j : j + 1] + U(1))))
        return np.concatenate(out)


class Prefixes:
    """Signatures of a set: its first shingles in one order of all shingles, those in the fullest cells last, else by hash.

    Of linked sets, each has HUNDREDTHS hundredths of its shingles in the other, so the sets meet in these prefixes. Any
    order gives every link; this one keeps a passage that many texts have from making them candidates.
    """

    def __init__(self, hundredths: int, counts: np.ndarray):
        self.hundredths, self.counts = hundredths, counts

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        often = self.counts[_cells(s, len(self.counts))] if len(self.counts) else np.zeros(n, np.int64)
        return s[np.argsort(often, kind="stable")[: n + 1 - -(-n * self.hundredths // 100)]] if n else s


def _cells(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles % U(cells)).astype(np.int64)


def _common(texts: DataFrame, n: int) -> np.ndarray:
    """How often all rows have the shingles of each of COMMON cells: of a shingle, its rows and those of others of its cell.

    Each task counts in all cells; tasks' counts are added up by TOGETHER cells, packed in as few bytes as the largest needs.
    """
    cells, together = COMMON, TOGETHER

    def packed(at: int, counts: np.ndarray) -> tuple[int, bytes]:
        return at, zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)

    def unpacked(data: bytes) -> np.ndarray:
        raw = zlib.decompress(data)
        return np.frombuffer(raw, f"u{len(raw) // together}").astype(U)

    def sent(parts: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        some = [packed(at, counts) for at, counts in parts if counts.any()]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["at", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((-(-cells // together), together), np.uint32)
        for _, sets in _rows(batches, n):
            for s in sets:
                np.add.at(held.reshape(-1), _cells(s, cells), np.uint32(1))
        yield sent(enumerate(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, data in zip(b.column("at").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[at] = sums[at] + unpacked(data) if at in sums else unpacked(data)
        yield sent(sums.items())

    if not cells:
        return np.zeros(0, np.uint8)
    out = np.zeros((-(-cells // together), together), U)
    for r in texts.mapInArrow(count, "at int, counts binary").repartition("at").mapInArrow(add, "at int, counts binary").collect():
        out[r["at"]] = unpacked(r["counts"])
    return out.reshape(-1)[:cells].astype(np.min_scalar_type(out.max()))


def _rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        every = texts_of(b, "text")
        yield b, [s for i, j in pieces_of(every) for s in sets_of(every[i:j], n)]


def _classes(texts: DataFrame, n: int) -> DataFrame:
    """texts(doc_id, text and more) as doc_id, n_shingles, the set's 128 bits, a hash of the text, its sketch, and the rest."""
    rest = [c for c in texts.columns if c not in ("doc_id", "text")]
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _rows(batches, n):
            ids = [class_of(s) for s in sets]
            cols = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([i[k] for i in ids], pa.int64()) for k in (0, 1))]
            cols += [b.column("said"), pa.array([sketches([s], 1 << (len(s) // 64).bit_length()).tobytes() for s in sets], pa.binary()), *(b.column(c) for c in rest)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "class", "check", "said", "sketch", *rest])

    said = texts.withColumn("said", F.xxhash64("text"))
    return said.mapInArrow(run, "doc_id long, n_shingles long, class long, check long, said long, sketch binary" + "".join(f", {c} {kinds[c]}" for c in rest))


def _signatures(texts: DataFrame, n: int, signs: Signatures | Prefixes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class signs once a task
        for _, sets in _rows(batches, n):
            sigs, owners = [], []
            for s in sets:
                c = class_of(s)[0]
                if c not in seen:
                    seen.add(c)
                    sigs.append(signs(s))
                    owners.append(np.full(len(sigs[-1]), c))
            if sigs and sum(map(len, sigs)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "class"])

    return texts.mapInArrow(run, "sig long, class long")


def sketches(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Parities of the elements that fall on each of 64 * words bits. Two sets differ in no fewer elements than bits."""
    out = np.zeros((len(sets), words), U)
    for k, s in enumerate(sets):
        h = mix(s ^ _ODD[2])
        np.bitwise_xor.at(out[k], (h >> U(6)) % U(words), U(1) << (h & U(63)))
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches, row by row, differ; the longer are folded to the length of the others."""
    while x.shape[1] != y.shape[1]:
        x, y = (x, y) if x.shape[1] > y.shape[1] else (y, x)
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _said(ids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """id, class, check and a text for each of the classes' ids; if two texts have one hash, a text that may be another's, too."""
    used = classes.join(ids, "id").select("id", "class", "check", F.col("said").alias("__said"), F.col("first").alias("__first"))
    found = texts.withColumn("__own", F.xxhash64("text")).join(used, F.expr("__own = __said AND doc_id <=> __first"))
    return stored(found.select("id", "class", "check", "text").distinct(), "jaccard-texts")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, hundredths: int) -> DataFrame:
    """The pairs (a, b) of classes' ids that are links: sketches drop most of the others, the sets decide."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("na").to_numpy() + b.column("nb").to_numpy()
            sa, sb = (b.column(c).to_pylist() for c in ("sa", "sb"))
            keep, kinds = np.zeros(b.num_rows, bool), {}
            for k, kind in enumerate(zip(map(len, sa), map(len, sb), strict=True)):
                kinds.setdefault(kind, []).append(k)
            for (la, lb), at in kinds.items():
                x, y = (np.frombuffer(b"".join(s[k] for k in at), U).reshape(-1, w // 8) for s, w in ((sa, la), (sb, lb)))
                keep[at] = _apart(x, y) <= differences(total[at], hundredths)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, keep = (texts_of(batch, "ta"), texts_of(batch, "tb")), []
            sets = [[s for i, j in pieces_of(t) for s in sets_of(t[i:j], shingle)] for t in both]
            for x, y, a, b in zip(*sets, *(zip(batch.column(f"c{k}").to_pylist(), batch.column(f"d{k}").to_pylist(), strict=True) for k in "ab"), strict=True):
                same = class_of(x) == a and class_of(y) == b  # two texts may have one hash
                keep.append(same and links(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), hundredths))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    near = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(sift, "a long, b long"), "jaccard-near")
    if near.isEmpty():
        return near
    found = _said(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, texts)
    left, right = (found.select(F.col("id").alias(k), F.col("class").alias(f"c{k}"), F.col("check").alias(f"d{k}"), F.col("text").alias(f"t{k}")) for k in "ab")
    return stored(near.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "da", "db", "ta", "tb").mapInArrow(decide, "a long, b long"), "jaccard-links")


def _close(sig: int, n: np.ndarray, root: np.ndarray, ids: np.ndarray, side: np.ndarray, sketch: list[bytes], least: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a block that sizes and sketches allow and that no link joins yet; side: 0 meets 1, and 2 meets itself.

    least: the LEAST smallest signatures of each. A pair that has a smaller one in common there meets under that one.
    """
    words = np.array([len(s) for s in sketch]) // 8
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for w in np.unique(words):
        one = np.flatnonzero(words == w)
        x = np.frombuffer(b"".join(sketch[k] for k in one), U).reshape(len(one), w)
        for v in (w, 2 * w):
            two = one if v == w else np.flatnonzero(words == v)
            if not len(two):
                continue
            y = x
            if v != w:
                y = np.frombuffer(b"".join(sketch[k] for k in two), U).reshape(len(two), v)
                y = y[:, :w] ^ y[:, w:]
            step = max(1, (1 << 20) // (len(two) * int(w)))
            for at in range(0, len(one), step):
                mine = one[at : at + step]
                low, high = np.minimum(n[mine][:, None], n[two]), np.maximum(n[mine][:, None], n[two])
                may = (100 * low >= hundredths * high) & (root[mine][:, None] != root[two]) & ((side[mine][:, None] != side[two]) | (side[two] == 2))
                if v == w:
                    may &= ids[mine][:, None] < ids[two]
                i, j = np.nonzero(may)
                if len(i):
                    near = np.bitwise_count(x[at + i] ^ y[j]).sum(1, dtype=np.int64) <= (n[mine[i]] + n[two[j]]) * (100 - hundredths) // (100 + hundredths)
                    i, j = mine[i[near]], two[j[near]]
                    for k in range(0, len(i), 1 << 16):
                        a, b = least[i[k : k + (1 << 16)]], least[j[k : k + (1 << 16)]]
                        common = (a[:, :, None] == b[:, None, :]).any(2)
                        here = np.where(common, a, np.iinfo(np.int64).max).min(1) >= sig
                        out.append((i[k : k + (1 << 16)][here], j[k : k + (1 << 16)][here]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by sig, low and high, as tables of whole pairs of blocks, and where in them each begins and the last ends."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([(x := t.column(c).to_numpy())[1:] != x[:-1] for c in ("sig", "low", "high")])
        return np.flatnonzero(new)

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        cuts = starts(held)
        if len(cuts) > 1:
            yield held.slice(0, cuts[-1]), cuts
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, np.append(starts(held), held.num_rows)


def _allowed(t: pa.Table, cuts: np.ndarray, hundredths: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each pair of blocks, t's rows i to j, the places after i of the pairs that may link."""
    sig, n, root, ids, side = (t.column(c).to_numpy() for c in ("sig", "n", "root", "id", "side"))
    sketch = t.column("sketch").to_pylist()
    least = np.array([x + [np.iinfo(np.int64).max] * (LEAST - len(x)) for x in t.column("least").to_pylist()], np.int64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j - i > 1:
            a, b = _close(sig[i], n[i:j], root[i:j], ids[i:j], side[i:j], sketch[i:j], least[i:j], hundredths)
            if len(a):
                yield i, j, a, b


def _joining(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], root: np.ndarray, hundredths: int) -> Iterator[tuple[int, int]]:
    """Of pairs of places, links enough to join what any of the pairs' links joins; at most one fewer than different roots."""
    root, order = root.copy(), np.argsort(a, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        k, left, most = int(a[some[0]]), b[some], 8
        mine = sets[k]
        while len(left := left[root[left] != root[k]]):
            now, left, most = left[:most], left[most:], 2 * most
            sizes = np.array([len(sets[x]) for x in now])
            both = np.concatenate([sets[x] for x in now])
            same = mine[np.minimum(np.searchsorted(mine, both), len(mine) - 1)] == both
            common = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
            for x in now[links(common, sizes + len(mine), hundredths)].tolist():
                if root[x] != root[k]:
                    root[root == root[x]] = root[k]
                    yield k, x


def _met(rest: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, hundredths: int) -> DataFrame:
    """Links (a, b) that join all classes that share a signature, aren't joined yet and are joined by links among them.

    rest(sig, id, n, root, met). A signature's classes meet in blocks of BLOCK, each pair of blocks in a task of its own, so
    a hot signature spreads. First a block holds numbers and sketches and keeps the classes of pairs that the sketches allow;
    these meet again, with their texts, and the sets decide. Pairs aren't rows: a pair of blocks gives classes, then fewer
    links than it has roots. Of signatures that the same classes have, one is enough. A pair with several signatures in
    common meets under the least, if that is among the LEAST smallest of both.
    """
    rest = stored(rest, "jaccard-rest")
    blocks = F.ceil(F.greatest(F.col("met") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    alike = rest.groupBy("sig", "met").agg(blocks, F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print"), F.min("id").alias("low"), F.max("id").alias("high"))
    one = alike.groupBy("met", "blocks", "print", "low", "high").agg(F.min("sig").alias("sig")).select("sig", "met", "blocks")
    rest = stored(looked_up(rest.drop("met"), one, "sig", "met", rest.count()), "jaccard-meet")
    few = rest.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LEAST).alias("least"))  # as many as a set has signatures
    sketched = classes.select("id", "sketch").join(few, "id")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") < F.col("other")).cast("int"))
    rest = rest.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "n", "root", side.alias("side"))
    rest = rest.join(sketched, "id").repartition(parts, "sig", "low", "high").sortWithinPartitions("sig", "low", "high")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _units(batches):
            at = [i + np.unique(np.concatenate([a, b])) for i, _, a, b in _allowed(t, cuts, hundredths)]
            if at:
                yield from t.take(pa.array(np.concatenate(at))).combine_chunks().to_batches()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ["sig", "low", "high", "id", "n", "root", "side", "sketch", "least"]
        for b, sets in _rows(batches, shingle):
            named = zip(sets, b.column("class").to_pylist(), b.column("check").to_pylist(), strict=True)
            right = pa.array([class_of(s) == (x, y) for s, x, y in named], pa.bool_())  # two texts may have one hash
            yield pa.RecordBatch.from_arrays([*b.select(cols).columns, pa.array([s.tobytes() for s in sets], pa.binary())], [*cols, "set"]).filter(right)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _units(hashed(batches)):
            ids, root, sets = t.column("id").to_numpy(), t.column("root").to_numpy(), [np.frombuffer(s, U) for s in t.column("set").to_pylist()]
            found = [(ids[i + x], ids[i + y]) for i, j, a, b in _allowed(t, cuts, hundredths) for x, y in _joining(a, b, sets[i:j], root[i:j], hundredths)]
            both = np.sort(np.array(found, np.int64).reshape(-1, 2), 1)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], ["a", "b"])

    kept = stored(rest.mapInArrow(keep, rest.schema), "jaccard-kept")
    if kept.isEmpty():
        return kept.select(F.col("id").alias("a"), F.col("id").alias("b"))
    again = kept.join(_said(kept.select("id").distinct(), classes, texts), "id").repartition(parts, "sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    return stored(again.mapInArrow(decide, "a long, b long").distinct(), "jaccard-links")


def linked(signed: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, hundredths: int) -> DataFrame:
    """Components (node, root) of the links between classes' ids; candidates are verified on the sets.

    classes(id, class, check, n, sketch, said, first); signed(sig, class). First each class meets one of those of its
    signature, another for each signature: as many pairs as signatures, and where many are alike they join most. After that,
    all that share a signature and are not joined yet meet in blocks.
    """
    signed = stored(signed, "jaccard-signed")
    mixed = F.col("class").bitwiseXOR(F.xxhash64("sig"))
    groups = signed.groupBy("sig").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high"), F.count("*").alias("met")).filter("low <> high")
    groups = groups.select("sig", F.col("low").bitwiseXOR(F.xxhash64("sig")).alias("hub"), "met")
    shared = stored(looked_up(signed, groups, "sig", "met", signed.count()), "jaccard-shared")
    sizes = classes.select("class", "id", "n")
    ways = shared.filter("class <> hub").select("class", "hub").distinct()
    ways = ways.join(sizes, "class").join(sizes.select(F.col("class").alias("hub"), F.col("id").alias("hub_id"), F.col("n").alias("hub_n")), "hub")
    alike = 100 * F.least("n", "hub_n") >= hundredths * F.greatest("n", "hub_n")
    pairs = stored(ways.filter(alike).select(F.greatest("id", "hub_id").alias("a"), F.least("id", "hub_id").alias("b")).distinct(), "jaccard-pairs")
    found = verified(pairs, classes, texts, shingle, hundredths)
    roots = components(found)
    named = classes.select("class", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("class", "id", "n", F.coalesce("root", "id").alias("root"))
    now = stored(shared.select("sig", "class").join(named, "class").select("sig", "id", "n", "root").distinct(), "jaccard-roots")
    groups = now.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("met")).filter("low <> high").select("sig", "met")
    rest = looked_up(now, groups, "sig", "met", now.count())
    more = _met(rest, classes, texts, shingle, hundredths)
    return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hundredths: int = HUNDREDTHS, prefixes: bool = False, row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the least doc_id that links reach.

    Shingles are hashed to 64 bits, sets to 128. Rows with one set are a class, which signs once a task. Hashes are cut into
    segments by size band; classes with a common signature (a segment's content, or, where the allocation says so, that
    content less one element) are candidates, which `linked` verifies pair by pair on the sets. With `prefixes`, a set's
    signatures are its rarest shingles instead, counted over all rows, as Prefixes has it: for sets that differ in so much
    that segments would be short.

    Null, empty and blank texts have no shingles and are alone. Repeated rows and ids are rows of one component where their
    texts are linked. A null id is a component's id only if all its ids are null. Empty table: no rows. Other columns are not
    read, but for row_col, a number of each row: with it, the rows also have `row` and `root`, which tells components apart
    even if ids repeat (null: no shingles).
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = keyed_texts(df, id_col, text_col)
    keyed = texts if row_col is None else df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(row_col).cast("long").alias("row"))
    rows = stored(_classes(keyed, shingle), "jaccard-rows")
    total = rows.count()
    classes = rows.filter("n_shingles > 0").groupBy("class", "check").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.min("said").alias("said"), F.min_by("doc_id", "said").alias("first"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")
    most = classes.agg(F.max("n")).first()[0] or 0
    every = bands(hundredths, most)
    label = classes.select("class", "check", "copies", F.col("first_doc").alias("component_id"), F.col("id").alias("root"))
    if every:
        if prefixes:
            signs = Prefixes(hundredths, _common(texts, shingle))
        else:
            lows = [lo for lo, _ in every]
            band = sum((F.col("n") >= lo).cast("int") for lo in lows) - 1
            counts = {r[0]: r[1] for r in classes.groupBy(band.alias("band")).count().collect()}
            signs = Signatures(hundredths, counts, most)
        roots = linked(_signatures(texts, shingle, signs), classes, texts, shingle, hundredths).withColumnRenamed("node", "id")
        label = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = label.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        label = label.join(least, "root").select("class", "check", "copies", "component_id", "root")
    label = stored(label, "jaccard-labels")
    extra = [] if row_col is None else ["row", "root"]
    alone = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("long"))
    some = looked_up(rows.filter("n_shingles > 0").drop("sketch", "said"), label, ["class", "check"], "copies", total)
    return some.select("doc_id", "n_shingles", "component_id", *extra).unionByName(alone.select("doc_id", "n_shingles", "component_id", *extra))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT x, y FROM c WHERE 100 * common >= 90 * (total - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON s.doc_id = m.x
"""
