"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words become 64-bit hashes; the sorted array of the training hashes gives each word its number. A bigram's key is the mix
of its two numbers, a bijection, so bigrams are told apart exactly. Each task adds up its own rows and sends one blob a
shard, so no word, however common, is a row group; shards are ranges of hashes and hence even. A shard's task merges its
blobs as they come and writes sorted arrays into the shared folder, under a name of its own that is moved into place when
whole unless another run of the task was first. Workers map the files; the driver gets a row of sums a shard.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import NOT_SPACE, U, Words, mix, pieces_of, spans
from .common import fresh_path, keyed_texts, small_batches, texts_of

END = mix(np.array([0x51ED270B, 0xB0A3C1D9], U))[0]
#: Entries that a task adds up before it sends them on; the numbers in one file of word sums.
MOST_ENTRIES, RANGE = 4_000_000, 1 << 18
#: Bytes of training text a shard, and shards at most: a task sends a blob to each shard, so their number can't grow without end.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 14
#: Bytes of files that a worker keeps in memory where the shared folder can't be mapped.
HELD_BYTES = 256 << 20
#: Sums of a word: tokens after it, distinct words after it seen once, twice, more often, and distinct words before it.
SUMS = np.dtype([("n", "<u8"), ("kinds", "<u4", 4)])


class Store:
    """Files in the shared folder: mapped where it is a path, otherwise read into memory, the latest HELD_BYTES of them."""

    def __init__(self, uri: str):
        self.uri, self.maps = uri, {}

    def __getstate__(self):
        return {"uri": self.uri, "maps": {}}

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("/") else self.uri.replace("file:", "file://", 1))
        fs.create_dir(path, recursive=True)
        return fs, path

    def put(self, name: str, data: np.ndarray) -> None:
        fs, path = self._fs()
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(np.ascontiguousarray(data).tobytes())
        if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
            fs.move(part, f"{path}/{name}")
        else:  # the same bytes, of another run of this task
            fs.delete_file(part)

    def map(self, name: str, kind) -> np.ndarray:
        if name not in self.maps:
            fs, path = self._fs()
            path = f"{path}/{name}"
            if isinstance(fs, pafs.LocalFileSystem):
                self.maps[name] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
            else:
                with fs.open_input_stream(path) as f:
                    self.maps[name] = np.frombuffer(f.read(), kind)
                while len(self.maps) > 1 and sum(x.nbytes for x in self.maps.values()) > HELD_BYTES:
                    del self.maps[next(iter(self.maps))]
        return self.maps[name]


def put_counts(store: Store, name: str, counts: np.ndarray) -> None:
    """A byte a count; 255 stands for counts that are listed, with their places, in a file of their own."""
    store.put(f"{name}.counts", np.minimum(counts, 255).astype(np.uint8))
    large = np.flatnonzero(counts >= 255)
    store.put(f"{name}.large", np.stack([large, counts[large]]).astype(np.int64))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, an end after each; where each text starts."""
    w = Words(texts, NOT_SPACE)
    return np.insert(w.hash, w.first[1:], END), w.first + np.arange(len(w.first))


def _blobs(keys: np.ndarray, counts: np.ndarray, shards: int, by: np.ndarray) -> pa.RecordBatch:
    """A row a shard; by: the hash whose top bits name the shard."""
    shard = (by >> U(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    cut = [*first[1:], len(keys)]
    keys, counts = keys[order], counts[order].astype(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(first, cut, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(first, cut, strict=True)], pa.binary())], ["shard", "keys", "counts"])


BLOB = "shard long, keys binary, counts binary"


def _counted(entries: Iterator[tuple[np.ndarray, np.ndarray]], shards: int, mixed: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, limit = 0, MOST_ENTRIES

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    for keys, counts in entries:
        held.append((keys, counts))
        n += len(keys)
        if n > limit:
            held[:] = [merged()]
            n = len(held[0][0])
            if n > limit // 2:
                yield _blobs(*held[0], shards, mix(held[0][0]) if mixed else held[0][0])
                held, n = [], 0
    if held:
        keys, counts = merged()
        yield _blobs(keys, counts, shards, mix(keys) if mixed else keys)


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
    """A shard's number, keys and sums from its blobs, merged whenever they have doubled."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U), np.zeros(0, np.int64))]
    n, limit, shard = 0, MOST_ENTRIES, -1
    for b in batches:
        shard = b.column("shard")[0].as_py()
        for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
            held.append((np.frombuffer(keys, U), np.frombuffer(counts, np.uint32).astype(np.int64)))
            n += len(held[-1][0])
            if n > limit:
                held[:] = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
                limit = max(MOST_ENTRIES, 2 * n)
    return shard, *summed(*(np.concatenate(x) for x in zip(*held, strict=True)))


class Model:
    """What workers need: the files' folder, the shards, and the global numbers."""

    def __init__(self, store: Store, shards: int, vocabulary_sizes: list[int]):
        self.store, self.shards, self.sizes = store, shards, vocabulary_sizes
        self.offsets = spans(np.array(vocabulary_sizes, np.int64))
        self.words, self.tokens = int(self.offsets[-1]), 0
        self.discounts = self.lower_discounts = np.zeros(4)
        self.bigrams, self.lower_types = 0, np.zeros(4)
        self.pair_sizes = [0] * shards

    def _find(self, prefix: str, keys: np.ndarray, sizes: list[int], offsets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """keys: sorted and distinct. Numbers (with offsets) and counts, -1 and 0 where absent."""
        number, count = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        bits = self.shards.bit_length() - 1
        edges = np.searchsorted(keys, np.arange(self.shards, dtype=U) << U(64 - bits)) if bits else np.array([0])
        for s, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
            if a == b or not sizes[s]:  # an empty shard has no file
                continue
            there = self.store.map(f"{prefix}-{s}.keys", U)
            at = np.minimum(np.searchsorted(there, keys[a:b]), len(there) - 1)
            hit = np.flatnonzero(there[at] == keys[a:b])
            number[a + hit] = at[hit] + (offsets[s] if offsets is not None else 0)
            count[a + hit] = self._counts(f"{prefix}-{s}", at[hit])
        return number, count

    def _counts(self, name: str, at: np.ndarray) -> np.ndarray:
        out = self.store.map(f"{name}.counts", np.uint8)[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            there = self.store.map(f"{name}.large", np.int64).reshape(2, -1)
            out[big] = there[1][np.searchsorted(there[0], at[big])]
        return out

    def numbered(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, -1 if unknown, and its training count."""
        keys, back = np.unique(hashes, return_inverse=True)
        number, count = self._find("words", keys, self.sizes, self.offsets)
        return number[back], count[back]

    def contexts(self, number: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each token's predecessor: that of the start at a text's first; -1 if unknown."""
        out = np.concatenate([[0], number[:-1]])
        out[starts] = self.words
        return out

    def sums(self, number: np.ndarray) -> np.ndarray:
        """For each word number >= 0: tokens after it, distinct words seen after it once, twice, more often, and before it."""
        out = np.zeros((len(number), 5), np.int64)
        for r in np.unique(number // RANGE):
            k = np.flatnonzero(number // RANGE == r)
            rows = self.store.map(f"sums-{r}", SUMS)[number[k] - r * RANGE]
            out[k, 0], out[k, 1:] = rows["n"], rows["kinds"]
        return out

    def lower(self, before: np.ndarray) -> np.ndarray:
        """The lower order's probability, from the number of distinct words that a word follows."""
        uniform = 1 / (self.words + 1)
        if not self.bigrams:
            return np.full(len(before), uniform)
        rest = float(self.lower_discounts[1:] @ self.lower_types[1:]) / self.bigrams
        return np.maximum(before - self.lower_discounts[np.minimum(before, 3)], 0) / self.bigrams + rest * uniform

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text."""
        hashes, at = tokens(texts)
        starts = at[:-1]
        number, count = self.numbered(hashes)
        base = np.log10((count + 1) / (self.tokens + self.words + 1))
        context = self.contexts(number, starts)
        known = (number >= 0) & (context >= 0)
        key = mix((context[known].astype(U) << U(32)) | number[known].astype(U))
        keys, back = np.unique(key, return_inverse=True)
        pair = np.zeros(len(number), np.int64)
        pair[known] = self._find("pairs", keys, self.pair_sizes, None)[1][back]
        every, back = np.unique(np.concatenate([np.maximum(number, 0), np.maximum(context, 0)]), return_inverse=True)
        sums = self.sums(every) if self.bigrams else np.zeros((len(every), 5), np.int64)
        before = np.where(number >= 0, sums[back[: len(number)], 4], 0)
        after = np.where((context >= 0)[:, None], sums[back[len(number) :]], 0)
        p = self.lower(before)
        seen = after[:, 0] > 0
        total = np.maximum(after[:, 0], 1)
        p = np.where(seen, np.maximum(pair - self.discounts[np.minimum(pair, 3)], 0) / total + (after[:, 1:4] @ self.discounts[1:]) / total * p, p)
        add = lambda x: np.add.reduceat(x, starts)
        return np.diff(at), add((count > 0).astype(np.int64)), add(base), add(np.log10(p))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, from how many entries have the counts 1 to 4; half a count each where too few do."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def train(texts: DataFrame) -> Model:
    """texts: a column `text`. Counts words, then bigrams by the words' numbers, then sums by word."""
    spark = texts.sparkSession
    store = Store(fresh_path(spark, "lm"))
    text_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = min(MOST_SHARDS, 1 << (-(-text_bytes // SHARD_BYTES) - 1).bit_length() if text_bytes else 1)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            for b in batches:
                every = texts_of(b, "text")
                for i, j in pieces_of(every):
                    yield np.unique(tokens(every[i:j])[0], return_counts=True)

        return _counted(entries(), shards, False)

    def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = _merged(batches)
        store.put(f"words-{shard}.keys", keys)
        put_counts(store, f"words-{shard}", counts)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    got = texts.mapInArrow(count_words, BLOB).groupBy("shard").applyInArrow(keep_words, "shard long, n long, total long").collect()
    sizes = {r["shard"]: r["n"] for r in got}
    model = Model(store, shards, [sizes.get(s, 0) for s in range(shards)])
    model.tokens = sum(r["total"] for r in got)
    if model.words >= 2**32 - 1:
        raise ValueError("more than 2**32 distinct words")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            for b in batches:
                every = texts_of(b, "text")
                for i, j in pieces_of(every):
                    hashes, at = tokens(every[i:j])
                    number, _ = model.numbered(hashes)
                    context = model.contexts(number, at[:-1])
                    yield np.unique((context.astype(U) << U(32)) | number.astype(U), return_counts=True)

        return _counted(entries(), shards, True)

    def keep_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = _merged(batches)
        hashed = mix(keys)
        order = np.argsort(hashed)
        store.put(f"pairs-{shard}.keys", hashed[order])
        put_counts(store, f"pairs-{shard}", counts[order])
        rows = [(-1, np.array([len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), shard], np.int64), np.zeros(0, np.int64))]
        left, right = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
        word, back = np.unique(np.concatenate([left, right]), return_inverse=True)
        sums = np.zeros((len(word), 5), np.int64)
        l, r = back[: len(keys)], back[len(keys) :]
        sums[:, 0] = np.bincount(l, counts, len(word))
        for k, mine in ((1, counts == 1), (2, counts == 2), (3, counts > 2)):
            sums[:, k] = np.bincount(l[mine], minlength=len(word))
        sums[:, 4] = np.bincount(r, minlength=len(word))
        for q in np.unique(word // RANGE):
            mine = word // RANGE == q
            rows.append((int(q), word[mine], sums[mine]))
        for q, a, x in rows:
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([a.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["shard", "keys", "counts"])

    def keep_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, totals, q = np.zeros((RANGE, 5), np.int64), [], -1
        for b in batches:
            q = b.column("shard")[0].as_py()
            for keys, sums in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if q < 0:
                    totals.append([int(x) for x in np.frombuffer(keys, "<i8")])
                else:
                    np.add.at(out, np.frombuffer(keys, "<i8") - q * RANGE, np.frombuffer(sums, "<i8").reshape(-1, 5))
        if q >= 0:
            rows = np.zeros(max(0, min(RANGE, model.words + 1 - q * RANGE)), SUMS)
            rows["n"], rows["kinds"] = out[: len(rows), 0], out[: len(rows), 1:]
            store.put(f"sums-{q}", rows)
            totals = [[int((out[:, 4] == k).sum()) for k in (1, 2, 3, 4)] + [int((out[:, 4] > 2).sum())]]
        yield pa.RecordBatch.from_arrays([pa.array([q] * len(totals), pa.int64()), pa.array(totals, pa.list_(pa.int64()))], ["shard", "sums"])

    pairs = texts.mapInArrow(count_pairs, BLOB).groupBy("shard").applyInArrow(keep_pairs, BLOB)
    rows = pairs.groupBy("shard").applyInArrow(keep_sums, "shard long, sums array<long>").collect()
    for r in rows:
        if r["shard"] < 0:
            model.pair_sizes[r["sums"][5]] = r["sums"][0]
    total = np.array([r["sums"][:5] for r in rows if r["shard"] < 0], np.int64).reshape(-1, 5).sum(0).tolist()
    types = np.array([r["sums"] for r in rows if r["shard"] >= 0], np.int64).reshape(-1, 5).sum(0)
    model.bigrams, model.discounts = total[0], discounts(*total[1:])
    model.lower_discounts, model.lower_types = discounts(*types[:4].tolist()), np.array([0, types[0], types[1], types[4]], float)
    model.store = Store(store.uri)
    return model


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row's whole text.

    Null and empty texts are the end alone. Repeated rows and null ids are rows like others; other columns are not read; an
    empty table gives no rows. A model of no texts gives every token the probability 1.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = texts_of(b, "text")
            n, known, base, score = (np.concatenate(x) for x in zip(*(model.score(every[i:j]) for i, j in pieces_of(every)), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n, known, np.full(len(n), model.tokens), base, score, 10 ** np.minimum(-score / n, 300)))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return keyed_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2


def lm_scores(df: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out, and scores all."""
    small_batches(df.sparkSession)
    model = train(df.filter(F.coalesce(~held_out(), F.lit(True))).select(F.col("text").cast("string").alias("text")))
    got = score_texts(df, model)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
