"""Licence scans by a positional index of rare words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import HashTable, Words, byte_table, gathered, pieces_of, spans
from .common import keyed_texts, small_batches, texts_of
from .licence_texts import TEMPLATES

#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
IN_WORD = byte_table("00-2F 3A-60 7B-7F")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Phrases whose every place is reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A template is found where this share of its words, in hundredths, stands at their places, its mandatory phrase among them.
SHARE = 80
#: Rare words of a template that must agree on its place before all its words are compared there.
AGREE = 2

Template = tuple[str, str, str]


def words_of(text: str) -> list[str]:
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


class Index:
    """From a word to its places in templates, for each template's rarest words.

    A template of n words is found where m = SHARE hundredths of n words or more stand at their places. Any n - m + AGREE of
    its words hold AGREE of those, so only that many, the ones of highest IDF, have postings, and none that is found is
    missed. Base phrases are templates of which all words must stand.
    """

    def __init__(self, idf: Mapping[str, float] | None = None, templates: Sequence[Template] = TEMPLATES, base: Mapping[str, str] = BASE):
        every = [*((label, words_of(key), words_of(text), SHARE) for label, key, text in templates), *((label, words_of(p), words_of(p), 100) for p, label in base.items())]
        self.n_own = len(templates)
        self.labels = [t[0] for t in every]
        self.names = sorted({w for _, _, words, _ in every for w in words})
        self.number = {w: i for i, w in enumerate(self.names)}
        self.coded = [w.encode() for w in self.names]
        self.table = HashTable(len(self.names) * 4)
        self.table.add(Words(self.coded, IN_WORD).hash, np.arange(len(self.names)))
        idf = idf or {}
        self.size, self.least, self.agree, self.lead, self.key = (np.zeros(len(every), np.int64) for _ in range(5))
        postings: list[tuple[int, int, int]] = []
        for t, (label, key, words, share) in enumerate(every):
            n = len(words)
            self.size[t], self.least[t], self.key[t] = n, -(-share * n // 100), len(key)
            places = [i for i in range(n) if words[i : i + len(key)] == key]
            if not places:
                raise ValueError(f"the mandatory phrase of {label} is not in its text")
            self.lead[t] = places[0]
            self.agree[t] = min(AGREE, self.least[t])
            rare = sorted(range(n), key=lambda i: (-idf.get(words[i], math.inf), i))[: n - self.least[t] + self.agree[t]]
            postings += [(self.number[words[i]], t, i) for i in rare]
        self.words = np.array([self.number[w] for _, _, words, _ in every for w in words])
        self.starts = spans(self.size)[:-1]
        posted = np.array(sorted(postings)).reshape(-1, 3)
        self.template, self.place = posted[:, 1], posted[:, 2]
        self.first = np.searchsorted(posted[:, 0], np.arange(len(self.names) + 1))

    def found(self, found: Words) -> tuple[np.ndarray, ...]:
        """Document, template, start (a number of a word, perhaps before the document's first) and share of what is found."""
        n_docs, none = len(found.first) - 1, np.zeros(0, np.int64)
        ids = self.table.find(found.hash)
        hits = np.flatnonzero(ids >= 0)
        hits = hits[self._same(found, hits, ids[hits])]
        if not len(hits):
            return none, none, none, none
        known = np.full(len(ids), -1)
        known[hits] = ids[hits]
        # postings of each word that has some, shifted to where the template would start
        w = known[hits]
        many = self.first[w + 1] - self.first[w]
        doc = np.repeat(np.searchsorted(found.first, hits, "right") - 1, many)
        k = gathered(np.arange(len(self.template)), self.first[w], many)
        template, start = self.template[k], np.repeat(hits, many) - self.place[k]
        # those that agree on a place
        low = int(start.min(initial=0))
        wide = len(ids) - low + 1
        way, agree = np.unique((doc * len(self.labels) + template) * wide + (start - low), return_counts=True)
        doc, template, start = way // wide // len(self.labels), way // wide % len(self.labels), way % wide + low
        some = agree >= self.agree[template]
        doc, template, start = doc[some], template[some], start[some]
        if not len(doc):
            return none, none, none, none
        # every word, then the mandatory phrase
        size = self.size[template]
        at = spans(size)
        step = np.arange(at[-1]) - np.repeat(at[:-1], size)
        place, own = np.repeat(start, size) + step, np.repeat(doc, size)
        inside = (place >= found.first[own]) & (place < found.first[own + 1])
        equal = inside & (known[np.clip(place, 0, len(known) - 1)] == gathered(self.words, self.starts[template], size))
        share = np.add.reduceat(equal.astype(np.int64), at[:-1])
        lead = np.repeat(self.lead[template], size)
        key = equal & (step >= lead) & (step < lead + np.repeat(self.key[template], size))
        good = (share >= self.least[template]) & (np.add.reduceat(key.astype(np.int64), at[:-1]) == self.key[template])
        return doc[good], template[good], start[good], share[good] / size[good]

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """For each text: words, places of base phrases, the first and the last, base labels, all labels, score."""
        found = Words(texts, IN_WORD)
        places: dict[int, list[int]] = {}
        said: dict[int, set[str]] = {}
        best: dict[int, dict[str, float]] = {}
        for d, t, start, share in zip(*(x.tolist() for x in self.found(found)), strict=True):
            label = self.labels[t]
            mine = best.setdefault(d, {})
            mine[label] = max(mine.get(label, 0.0), share)
            if t >= self.n_own:
                places.setdefault(d, []).append(start - int(found.first[d]))
                said.setdefault(d, set()).add(label)
        out = []
        for d in range(len(texts)):
            at, own = places.get(d, []), best.get(d, {})
            out.append((int(found.first[d + 1] - found.first[d]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(said.get(d, ()))), ",".join(sorted(own)), max(own.values(), default=0.0)))
        return out

    def _same(self, found: Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the words are those that their hashes say."""
        sizes = np.array([len(w) for w in self.coded])
        same = (found.ends[at] - found.starts[at]) == sizes[ids]
        k = np.flatnonzero(same)
        if not len(k):
            return same
        flat, offsets = np.frombuffer(b"".join(self.coded), np.uint8), spans(sizes)[:-1]
        lengths = sizes[ids[k]]
        equal = gathered(found.buf, found.starts[at[k]], lengths) == gathered(flat, offsets[ids[k]], lengths)
        same[k] = np.logical_and.reduceat(equal, spans(lengths)[:-1])
        return same


def inverse_frequencies(texts: DataFrame) -> dict[str, float]:
    """IDF over all documents of the templates' words; as many numbers as the templates have words."""
    index = Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(index.names), np.int64), 0
        for b in batches:
            every = texts_of(b, "text")
            rows += len(every)
            for i, j in pieces_of(every):
                found = Words(every[i:j], IN_WORD)
                ids = index.table.find(found.hash)
                at = np.flatnonzero(ids >= 0)
                of = np.searchsorted(found.first, at, "right") - 1
                counts += np.bincount(np.unique(of * len(index.names) + ids[at]) % len(index.names), minlength=len(index.names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(index.names))), pa.array(np.append(rows, counts))], ["word", "n"])

    got = {r["word"]: r["n"] for r in texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.get(-1, 0)
    return {w: math.log((total + 1) / (got.get(k, 0) + 1)) for k, w in enumerate(index.names)}


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    A file's licence words of highest IDF (those that a template has among its rarest) are looked up in the index; where
    postings of a template agree on its place, all its words are compared, and its mandatory phrase must stand. labels: of
    the templates found and of base phrases; score: the largest share of a template's words that stand, 1 with a base
    phrase, 0 with nothing found. A template may begin before a text or end after it. Null and empty texts: no words, no
    labels. Repeated rows and null ids are rows like others; other columns are not read; empty table: no rows.
    """
    small_batches(df.sparkSession)
    texts = keyed_texts(df, id_col, text_col)
    index = Index(inverse_frequencies(texts))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = texts_of(b, "text")
            rows = [r for i, j in pieces_of(every) for r in index.scan(every[i:j])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds)))], ["doc_id", *names])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
