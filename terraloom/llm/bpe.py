"""Byte-level BPE over numpy matrices.

Texts are cut into matches of the public pattern by array operations on code points; each distinct match is encoded once
in a worker. Matches of like length make a padded matrix of token ids. In each round every row merges its leftmost pair
of minimum rank, found by hashed pair lookup; rows without a pair leave the matrix (compaction). A text's ids are
gathered from those of its matches and, since matches are looked up by hash, checked by decoding them.

A match of more than LONG bytes would make a matrix of one row with as many rounds as bytes. It goes through the same
rounds, a merge of the leftmost pair of minimum rank each, with its pairs in a heap: a round's cost is that of the heap.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bytehash import HashTable, U, gathered, mix, piece_hashes, pieces_of, spans
from .common import keyed_texts, small_batches, texts_of

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Upper lengths of the matrices' buckets; longer matches are padded to the next power of two.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32)
LONG = 256
NO_RANK = np.int32(2**31 - 1)
#: Distinct matches that a worker remembers; beyond, it starts anew.
REMEMBERED = 500_000


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each code point, by the properties that the pattern names."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    place = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            out[place[m.start() : m.end()]] = kind
    return out


def match_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the matches of the public pattern start in texts laid end to end, as code points.

    A run of white space that does not end its text gives up its last character, which starts a match: alone, or, if it
    is a blank, with the run after it. 's 't 'm 'd 're 've 'll are matches where the apostrophe starts one.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[text_starts] = True
    fresh[n] = True  # one more, so that the last place is the end of a text
    blank = points == 32
    space = kind == SPACE
    attached = np.zeros(n, bool)
    attached[1:] = blank[:-1] & ~space[1:] & ~fresh[1:n]
    start = fresh[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start &= ~attached
    start[:-1] |= space[:-1] & ~space[1:] & ~fresh[1:n]  # the last of a run of white space
    for i in np.flatnonzero((points == 39) & start):
        rest = points[i + 1 : i + 3]
        if not len(rest) or fresh[i + 1]:
            continue
        if rest[0] in (115, 116, 109, 100):  # s t m d
            size = 2
        elif len(rest) == 2 and not fresh[i + 2] and (int(rest[0]), int(rest[1])) in ((114, 101), (118, 101), (108, 108)):
            size = 3
        else:
            continue
        start[i + 1] = False
        if i + size < n:
            start[i + size] |= not attached[i + size]
    return np.flatnonzero(start)


class Vocabulary:
    """Tokens' bytes, and ranks of the pairs that merge."""

    def __init__(self, tokens: dict[bytes, int], pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray, added: dict[bytes, int] | None = None):
        #: Strings that are one token wherever they stand in a text, which they cut in two; the longest of those that start at a place.
        self.added = added or {}
        self.cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")") if self.added else None
        self.pairs = pairs
        self.size = max(tokens.values()) + 1
        by_id = [b""] * self.size
        for t, i in tokens.items():
            by_id[i] = t
        self.lengths = np.array([len(t) for t in by_id])
        self.starts = spans(self.lengths)[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        said = [b"%d," % i for i in range(self.size)]
        self.said_lengths = np.array([len(t) for t in said])
        self.said_starts, self.said = spans(self.said_lengths)[:-1], np.frombuffer(b"".join(said), np.uint8)
        self.of_byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.table = HashTable(len(pairs) * 2)
        self.table.add(mix(pairs.astype(U)), np.arange(len(pairs)))
        self.ranks, self.merged = ranks.astype(np.int32), merged.astype(np.int32)

    @functools.cached_property
    def ways(self) -> dict[int, tuple[int, int]]:
        """Rank and merged token by pair."""
        return dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.table.find(mix((a.astype(U) << U(32)) | b.astype(U)).ravel()).reshape(a.shape)
        return np.where(k < 0, NO_RANK, self.ranks[k]), self.merged[k]

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return gathered(self.said, self.said_starts[ids], self.said_lengths[ids]).tobytes()[:-1]


def _pair(a: int, b: int) -> int:
    return a << 32 | b


@functools.cache
def rank_vocabulary(path: str) -> Vocabulary:
    """A file of ranks: any two tokens merge whose concatenation is a token, by that token's rank."""
    with open(path, "rb") as f:
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    found = {_pair(tokens[t[:k]], tokens[t[k:]]): i for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens}
    ids = np.fromiter(found.values(), np.int64, len(found))
    return Vocabulary(tokens, np.fromiter(found, np.uint64, len(found)), ids, ids)


@functools.cache
def merge_vocabulary(path: str) -> Vocabulary:
    """A tokenizers file of byte-level BPE: the pairs that merge are listed in the order of their ranks."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"].encode(): t["id"] for t in whole.get("added_tokens", [])}
    if any(t[k] for t in whole.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take white space, stand as words or are normalised are not supported")
    tokens = {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if all(c in char for c in t) and t.encode() not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    v = model["vocab"]
    pairs = np.array([_pair(v[a], v[b]) for a, b in merges], np.uint64)
    return Vocabulary(tokens, pairs, np.arange(len(pairs)), np.array([v[a + b] for a, b in merges]), added)


def merge_rows(vocabulary: Vocabulary, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """rows: token ids of bytes, padded by -1. Returns (numbers of rows, their ids padded by -1), several times."""
    ids, who, out = rows.astype(np.int32), np.arange(len(rows)), []
    rank, new = vocabulary.rank_of(ids[:, :-1], ids[:, 1:])
    bad = ids[:, 1:] < 0
    rank[bad] = NO_RANK
    while len(who) and ids.shape[1] > 1:
        at = rank.argmin(1)  # the leftmost of the least
        row = np.arange(len(who))
        more = rank[row, at] != NO_RANK
        if not more.all():  # compaction
            out.append((who[~more], ids[~more]))
            who, ids, rank, new, at = who[more], ids[more], rank[more], new[more], at[more]
            row = np.arange(len(who))
            if not len(who):
                return out
        ids[row, at] = new[row, at]
        width = ids.shape[1]
        column = np.arange(width - 1)
        right = column[None, :] > at[:, None]
        ids = np.where(right, ids[:, 1:], ids[:, :-1])
        if width == 2:
            break
        right = column[None, :-1] > at[:, None]
        rank = np.where(right, rank[:, 1:], rank[:, :-1])
        new = np.where(right, new[:, 1:], new[:, :-1])
        for side in (at - 1, at):  # the two pairs that hold the new token
            k = np.flatnonzero((side >= 0) & (side < width - 2))
            a, b = ids[k, side[k]], ids[k, side[k] + 1]
            r, m = vocabulary.rank_of(a, np.maximum(b, 0))
            rank[k, side[k]], new[k, side[k]] = np.where(b < 0, NO_RANK, r), m
    if len(who):
        out.append((who, ids))
    return out


def merge_long(vocabulary: Vocabulary, row: np.ndarray) -> np.ndarray:
    """The ids of one long row of byte tokens: merge_rows' rounds with a heap of (rank, place) and a linked list of tokens."""
    n, ids, ways = len(row), row.tolist(), vocabulary.ways
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    rank, _ = vocabulary.rank_of(row[:-1], row[1:])
    at = np.flatnonzero(rank != NO_RANK)
    heap = ((rank[at].astype(np.int64) << 32) | at).tolist()
    heapq.heapify(heap)
    live = rank.tolist()  # the rank of the pair that starts at a place now
    live.append(-1)
    while heap:
        r, i = divmod(heapq.heappop(heap), 1 << 32)
        if live[i] != r:
            continue
        j = after[i]
        ids[i] = ways[_pair(ids[i], ids[j])][1]
        live[j], ids[j], after[i] = -1, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k < 0:
                continue
            way = ways.get(_pair(ids[k], ids[after[k]])) if after[k] >= 0 else None
            live[k] = way[0] if way else -1
            if way:
                heapq.heappush(heap, (way[0] << 32) | k)
    return np.array([x for x in ids if x >= 0], np.int32)


class Encoder:
    """Encodes lists of texts; remembers the matches that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.seen, self.starts, self.lengths, self.ids, self.n_ids = HashTable(1 << 17), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 18, np.int32), 0

    def _learn(self, buf: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        hashes, first = np.unique(hashes, return_index=True)
        starts, sizes = starts[first], (ends - starts)[first]
        lengths, parts = np.zeros(len(first), np.int64), []
        for k in np.flatnonzero(sizes > LONG):
            parts.append((np.array([k]), merge_long(self.v, self.v.of_byte[buf[starts[k] : starts[k] + sizes[k]]])))
            lengths[k] = len(parts[-1][1])
        longest = int(min(sizes.max(), LONG))
        edges = [*BUCKETS]
        while edges[-1] < longest:
            edges.append(edges[-1] * 2)
        bucket = np.where(sizes > LONG, -1, np.searchsorted(edges, sizes))
        for k in np.unique(bucket[bucket >= 0]):
            every, width = np.flatnonzero(bucket == k), edges[k]
            for at in range(0, len(every), max(1, (1 << 18) // width)):
                mine = every[at : at + max(1, (1 << 18) // width)]
                place = starts[mine][:, None] + np.arange(width)
                inside = np.arange(width) < sizes[mine][:, None]
                rows = np.where(inside, self.v.of_byte[buf[np.minimum(place, len(buf) - 1)]], -1)
                for who, ids in merge_rows(self.v, rows):
                    kept = ids >= 0
                    lengths[mine[who]] = kept.sum(1)
                    parts.append((mine[who], ids[kept]))
        base = len(self.starts)
        order = np.concatenate([w for w, _ in parts])
        flat = np.concatenate([i for _, i in parts])
        where = np.empty(len(first), np.int64)
        where[order] = self.n_ids + spans(lengths[order])[:-1]
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)
        self.starts, self.lengths = np.concatenate([self.starts, where]), np.concatenate([self.lengths, lengths])
        self.seen.add(hashes, base + np.arange(len(first)))

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.seen.n > REMEMBERED:
            self.forget()
        joined = b"".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        buf = np.frombuffer(joined, np.uint8)
        text_at = spans(np.fromiter(map(len, texts), np.int64, len(texts)))
        if joined.isascii():
            starts = match_starts(buf, text_at[:-1][np.diff(text_at) > 0])
        else:
            points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
            lead = np.flatnonzero((buf & 0xC0) != 0x80)  # the byte where each code point starts
            begin = text_at[:-1][np.diff(text_at) > 0]
            starts = lead[match_starts(points, np.searchsorted(lead, begin))]
        ends = np.append(starts[1:], len(buf))
        hashes = piece_hashes(buf, starts, ends)
        k = self.seen.find(hashes)
        if (k < 0).any():
            new = np.flatnonzero(k < 0)
            self._learn(buf, hashes[new], starts[new], ends[new])
            k[new] = self.seen.find(hashes[new])
        lengths = self.lengths[k]
        ids = gathered(self.ids, self.starts[k], lengths)
        first = np.searchsorted(starts, text_at)
        return ids, spans(lengths)[first]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text. Added tokens cut a text into parts, which are encoded as texts of their own."""
        if self.v.cut is None:
            yield from self._encoded(texts)
            return
        cut = [self.v.cut.split(t) for t in texts]  # parts and added tokens by turns
        ids = self._encoded([p for c in cut for p in c[::2]])
        for c in cut:
            parts = [next(ids)]
            for t in c[1::2]:
                parts += [np.array([self.v.added[t]], np.int32), next(ids)]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _encoded(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for i, j in pieces_of(texts):
            ids, at = self._encode(texts[i:j])
            if self.v.decode(ids) != b"".join(texts[i:j]):  # two matches with one hash, which must not be
                raise ValueError("a hash of a match is not unique")
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield ids[a:b]


@functools.cache
def rank_encoder(path: str) -> Encoder:
    return Encoder(rank_vocabulary(path))


@functools.cache
def merge_encoder(path: str) -> Encoder:
    return Encoder(merge_vocabulary(path))


def encode_texts(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids).

    One row for each input row, repeated rows and null ids too. Null and empty texts: no ids, the digests of no bytes.
    Other columns of the input are not read. An empty table gives an empty one. Special tokens' strings are ordinary text.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path)
        v, sha = encoder.v, hashlib.sha256
        for b in batches:
            every = list(encoder.encode(texts_of(b, "text")))
            cols = [b.column("doc_id"), pa.array([len(i) for i in every], pa.int64()), pa.array([sha(v.decimal(i)).hexdigest() for i in every], pa.string()), pa.array([sha(v.decode(i)).hexdigest() for i in every], pa.string())]
            if with_ids:
                cols.append(pa.array(every, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return keyed_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of arrays of ids: doc_id, decoded. Null: no bytes. An id outside the vocabulary raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = rank_vocabulary(ranks_path)
        for b in batches:
            out = [v.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return df.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id long, decoded binary")
