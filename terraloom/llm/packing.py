"""Best-fit packing of token sequences by a grouping genetic algorithm."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merge_encoder
from .common import keyed_texts, small_batches, stored, texts_of

CAPACITY, END = 1024, 2
#: Pieces of a deme, and how often those of ill-filled sequences are dealt anew among demes.
DEME, ROUNDS = 4096, 2
#: Islands of a deme, each a task's row; epochs, between which elites migrate; solutions on an island, and its generations an epoch.
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 3, 4, 10
#: Sequences with more free places than this are dissolved between rounds.
SLACK = 2

Bins = list[tuple[int, list[int]]]


class BestFit:
    """Bins by free places; a bit for each number of places that some bin has."""

    def __init__(self, bins: Bins, capacity: int):
        self.capacity, self.by_free, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        for used, items in bins:
            self._put(capacity - used, items)

    def _put(self, free: int, items: list[int]) -> None:
        self.by_free[free].append(items)
        self.mask |= 1 << free

    def add(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self._put(self.capacity - size, [item])
            return
        free = size + (fits & -fits).bit_length() - 1
        items = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        items.append(item)
        self._put(free - size, items)

    def bins(self) -> Bins:
        return [(self.capacity - free, items) for free, every in enumerate(self.by_free) for items in every]


def fitness(bins: Bins, capacity: int) -> tuple:
    """Fewer bins first, then fuller ones."""
    return (-len(bins), sum((used / capacity) ** 2 for used, _ in bins))


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: Bins = ()) -> Bins:
    fit = BestFit([(u, list(i)) for u, i in bins], capacity)
    for i in order:
        fit.add(i, sizes[i])
    return fit.bins()


def completed(down: list[int], sizes: list[int], capacity: int) -> Bins:
    """Bins that each begin with the longest item left and are completed by one, two or three items that fill them best.

    The sizes at hand are the bits of a number; a pair that fills a gap is a common bit of that number and its mirror.
    """
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in reversed(down):
        by_size[sizes[i]].append(i)
    have = sum(1 << s for s, items in enumerate(by_size) if items)
    mirror = sum(1 << (capacity - s) for s, items in enumerate(by_size) if items)
    out: Bins = []

    def take(s: int, into: list[int]) -> None:
        nonlocal have, mirror
        into.append(by_size[s].pop())
        if not by_size[s]:
            have ^= 1 << s
            mirror ^= 1 << (capacity - s)

    def pair(gap: int) -> tuple[int, int] | None:
        both = have & (mirror >> (capacity - gap)) & ((1 << (gap + 1)) - 1)
        while both:
            s = both.bit_length() - 1
            if s != gap - s or len(by_size[s]) > 1:
                return s, gap - s
            both ^= 1 << s
        return None

    def filling(gap: int) -> tuple[int, ...]:
        """Sizes that fill the gap, or as much of it as one or two, or three of a few, can."""
        for goal in range(gap, 0, -1):
            if have >> goal & 1:
                return (goal,)
            if found := pair(goal):
                return found
            if goal >= gap - 1:
                few = have & ((1 << goal) - 1)
                for _ in range(6):
                    if not few:
                        break
                    s = few.bit_length() - 1
                    few ^= 1 << s
                    found = pair(goal - s)
                    if found and [s, *found].count(s) <= len(by_size[s]):
                        return (s, *found)
        return ()

    while have:
        items: list[int] = []
        gap = capacity - (have.bit_length() - 1)
        take(have.bit_length() - 1, items)
        while fits := have & ((1 << (gap + 1)) - 1):
            most = fits.bit_length() - 1
            chosen = (most,) if gap > 4 * most else filling(gap)
            if not chosen:
                break
            for s in chosen:
                take(s, items)
                gap -= s
        out.append((capacity - gap, items))
    return out


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Injects b's fullest bins whole into a, drops a's bins that hold any of their items, best-fits what was displaced."""
    good = sorted(b, key=lambda x: (-x[0], rng.random()))
    take = good[: max(1, int(len(good) * rng.uniform(0.2, 0.7)))]
    taken = {i for _, items in take for i in items}
    kept, displaced = [], []
    for used, items in a:
        if taken.isdisjoint(items):
            kept.append((used, items))
        else:
            displaced += [i for i in items if i not in taken]
    kept.sort(key=lambda x: x[0])
    loose = int(len(kept) * rng.uniform(0.02, 0.2)) + 1  # a's emptiest bins go too, so that something can move
    displaced += [i for _, items in kept[:loose] for i in items]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, capacity, [*take, *kept[loose:]])


def least_bins(sizes: list[int], capacity: int) -> int:
    """A bound that no packing beats: by the sum, or, for each length k, items over capacity - k alone and the rest over k by the sum."""
    have = np.bincount(sizes, minlength=capacity + 1)
    count, total = np.cumsum(have), np.cumsum(have * np.arange(capacity + 1))
    best = -(-int(total[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone, large = int(count[-1] - count[capacity - k]), int(count[capacity - k] - count[capacity // 2])
        rest = int(total[capacity // 2] - total[k - 1]) - (large * capacity - int(total[capacity - k] - total[capacity // 2]))
        best = max(best, alone + large + max(0, -(-rest // capacity)))
    return best


def evolve(sizes: list[int], capacity: int, population: list[Bins], elite: Bins | None, seed: int) -> list[Bins]:
    """An island's population after an epoch, best first. An empty one is started; an elite takes the place of the worst."""
    if not sizes:
        return [[]]
    score = lambda x: fitness(x, capacity)
    rng, least = random.Random(seed), least_bins(sizes, capacity)
    some = [*population]
    if not some:
        down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        some = [best_fit(down, sizes, capacity)]
        if len(some[0]) > least:
            some.append(completed(down, sizes, capacity))
        while len(some) < POPULATION and min(map(len, some)) > least:
            some.append(best_fit(sorted(down, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0)), sizes, capacity))
    if elite is not None and score(elite) not in {score(x) for x in some}:
        some[min(range(len(some)), key=lambda k: score(some[k]))] = elite
    for _ in range(GENERATIONS):
        if len(some) < 2 or min(map(len, some)) <= least:
            break
        a, b = rng.sample(some, 2)
        child = crossover(a, b, sizes, capacity, rng)
        worst = min(range(len(some)), key=lambda k: score(some[k]))
        if score(child) > score(some[worst]):
            some[worst] = child
    return sorted(some, key=score, reverse=True)


def _packed(bins: Bins, n: int) -> bytes:
    """The number of each item's bin."""
    out = np.zeros(n, "<i4")
    for k, (_, items) in enumerate(bins):
        out[items] = k
    return out.tobytes()


def _unpacked(blob: bytes, sizes: list[int]) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(np.frombuffer(blob, "<i4").tolist()):
        bins.setdefault(k, []).append(i)
    return [(sum(sizes[i] for i in items), items) for _, items in sorted(bins.items())]


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's tokens and the end, cut into pieces: doc_id, piece, start, length, ids_crc32 (and the ids)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merge_encoder(tokenizer_path)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts_of(b, "text")), strict=True):
                ids = np.append(ids, end).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, x in zip(cols, (doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), ids[i:j].tobytes() if with_ids else None), strict=True):
                        col.append(x)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 5 + with_ids], names[: 5 + with_ids])

    return keyed_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


STATE = "deme long, island int, sizes binary, population array<binary>, bins long, fill double"


def _epoch(state: DataFrame, capacity: int, turn: int) -> DataFrame:
    """state(deme, island, sizes, population, elite) after an epoch on each island, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                sizes = np.frombuffer(r["sizes"], "<i4").tolist()
                elite = _unpacked(r["elite"], sizes) if r["elite"] is not None else None
                some = evolve(sizes, capacity, [_unpacked(x, sizes) for x in r["population"]], elite, (turn * ISLANDS + r["island"]) * 1_000_003 + r["deme"])
                best = fitness(some[0], capacity)
                row = (r["deme"], r["island"], r["sizes"], [_packed(x, len(sizes)) for x in some], -best[0], float(best[1]))
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["deme", "island", "sizes", "population", "bins", "fill"])

    return stored(state.select("deme", "island", "sizes", "population", "elite").mapInArrow(run, STATE), "pack-islands")


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A deme's pieces, longest first, as two blobs."""
    for b in batches:
        column, cuts = b.column("pieces"), b.column("pieces").offsets.to_numpy()
        items, sizes = (column.values.field(c).to_numpy(zero_copy_only=False) for c in ("item", "length"))
        every = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            order = i + np.lexsort((items[i:j], -sizes[i:j]))
            every.append((items[order].astype("<i8").tobytes(), sizes[order].astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("deme"), *(pa.array([e[k] for e in every], pa.binary()) for k in (0, 1))], ["deme", "items", "sizes"])


def pack_items(items: DataFrame, capacity: int = CAPACITY, deme: int = DEME) -> DataFrame:
    """items(item long, length long <= capacity) to (item, sequence_id, offset).

    Items are dealt by hash into demes of about `deme`. A deme evolves on ISLANDS islands, each a row that any task may
    evolve, so that a deme's islands run on as many cores; between epochs the best solution of each island goes to the next
    of the ring, by a join. Of a deme's islands the best solution stands. Well-filled sequences stay; the items of others
    are dealt anew into the fewer demes of the next round, whose last result stays whole. The hash is of the item alone, so
    equal lengths and groups of copies spread evenly. Sequence ids are odd numbers here; an item that fills a sequence
    alone has an even one.
    """
    spark = items.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = items.filter(F.col("length") == capacity).select("item", (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, done = items.filter(F.col("length") < capacity), []
    for turn in range(ROUNDS):
        n = left.count()
        if not n:
            break
        demes = -(-n // deme)
        last = turn == ROUNDS - 1 or demes == 1
        dealt = left.select(F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(demes)).alias("deme"), F.struct("item", "length").alias("piece"))
        parts = min(demes * ISLANDS, most)
        pieces = stored(dealt.groupBy("deme").agg(F.collect_list("piece").alias("pieces")).mapInArrow(_blobs, "deme long, items binary, sizes binary"), "pack-demes")
        state = pieces.select("deme", "sizes", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))).alias("island"), F.array().cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("elite"))
        for epoch in range(EPOCHS):
            state = _epoch(state.repartition(parts), capacity, turn * EPOCHS + epoch)
            elite = state.select("deme", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elite, ["deme", "island"])
        best = state.groupBy("deme").agg(F.max(F.struct(-F.col("bins"), "fill", -F.col("island"), F.col("population")[0].alias("best"))).alias("m")).select("deme", F.col("m")["best"].alias("best"))

        def laid(batches: Iterator[pa.RecordBatch], turn: int = turn, last: bool = last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n in range(b.num_rows):
                    r = b.slice(n, 1).to_pylist()[0]
                    ids, sizes, rows = np.frombuffer(r["items"], "<i8").tolist(), np.frombuffer(r["sizes"], "<i4").tolist(), []
                    for k, (used, every) in enumerate(_unpacked(r["best"], sizes)):
                        at, number = 0, 2 * ((((turn << 36) + r["deme"]) << 20) + k) + 1
                        for i in every:
                            rows.append((ids[i], sizes[i], number, at, last or capacity - used <= SLACK))
                            at += sizes[i]
                    kinds = [pa.int64()] * 4 + [pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["item", "length", "sequence_id", "offset", "stays"])

        out = stored(pieces.join(best, "deme").select("deme", "items", "sizes", "best").repartition(min(demes, most)).mapInArrow(laid, "item long, length long, sequence_id long, offset long, stays boolean"), "pack-round")
        done.append(out.filter("stays").select("item", "sequence_id", "offset"))
        if last:
            break
        left = out.filter("NOT stays").select("item", "length")
    for d in done:
        full = full.unionByName(d)
    return full


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: a row for each piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids as little-endian 32-bit numbers). Ids are those
    that the tokenizers library gives for the file: added tokens' strings, such as special ones, are one id each. Only a
    document of more than `capacity` tokens, its end counted, is cut; its first piece takes the remainder. Null and empty
    texts are the end alone. Repeated rows and null ids are documents of their own. Empty table: no rows. Other columns are
    not read.
    """
    pieces = stored(token_pieces(df, tokenizer_path, id_col, text_col, capacity, with_ids=with_ids).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    return pieces.join(pack_items(pieces.select("item", "length"), capacity), "item").drop("item")
