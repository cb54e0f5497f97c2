"""Each operator against a library or a plain computation, on hard little tables."""

import base64
import hashlib
import json
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terraloom.llm import bpe, chat_format, components, exact_dedup, jaccard_join, langid, licences, lm, ogg_media, packing, sharding

RANKS, MERGES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
HARD = [None, "", " ", "\t\n ", "a", "A a", "it's they'll 'sx ''s", "naïve 日本語 😀", "x" * 3000, "word " * 4000, "Ein  Wort\r\nund\x0bnoch\x0ceins", "a\x85b\xa0c\x1cd", "12 3.4 ١٢", "<|endoftext|>", "same text here now", "same  text here\nnow", "same text here now", "ÀÉ Àé"]


@pytest.fixture(scope="module")
def table(spark):
    """Ids with a null and a repeat, extra columns with names that operators use."""
    rows = [(k, t, "en" if k % 2 else "fr", None if k % 5 == 0 else f"s{k % 3}", 1, "x", 9) for k, t in enumerate(HARD)]
    rows += [rows[4], (None, "same text here now", None, "s1", 1, "y", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest int, body string, shard int").repartition(3)


@pytest.fixture(scope="module")
def empty(table):
    return table.filter("false")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_bpe_is_tiktoken(table, empty):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.encode_texts(table, RANKS))
    assert len(got) == len(HARD) + 2 and not rows(bpe.encode_texts(empty, RANKS))
    for r in got:
        text = (HARD[r["doc_id"]] if r["doc_id"] is not None else "same text here now") or ""
        ids = enc.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = rows(bpe.decode_ids(bpe.encode_texts(table, RANKS).filter("doc_id = 7"), RANKS))
    assert back[0]["decoded"].decode() == HARD[7]


def test_bpe_on_random_texts():
    rng = random.Random(3)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "a", "B", "é", "１", "2", "!", "日", "́", "\x1c", "\x85", "\xa0", "😀", "'s", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = Tokenizer.from_file(MERGES)
    got = bpe.merge_encoder(MERGES).encode([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == want.encode(t, add_special_tokens=False).ids, t


def plain_kneser_ney(train, text):
    sents = [t.encode().lower().split() for t in train]
    big, cont, after = Counter(), defaultdict(set), defaultdict(Counter)
    for s in sents:
        p = "<s>"
        for w in [*s, "</s>"]:
            big[p, w] += 1
            p = w
    for (u, w), n in big.items():
        cont[w].add(u)
        after[u][w] = n
    v = len(cont)
    d = lm.discounts(*(sum(n == k for n in big.values()) for k in (1, 2, 3, 4)))
    e = lm.discounts(*(sum(len(x) == k for x in cont.values()) for k in (1, 2, 3, 4)))

    def lower(w):
        c = len(cont.get(w, ()))
        rest = sum(e[min(len(x), 3)] for x in cont.values())
        return max(c - e[min(c, 3)], 0) / len(big) + rest / len(big) / (v + 1)

    def p(u, w):
        if u not in after:
            return lower(w)
        t, n = sum(after[u].values()), after[u][w]
        return max(n - d[min(n, 3)], 0) / t + sum(d[min(x, 3)] for x in after[u].values()) / t * lower(w)

    out, u = 0.0, "<s>"
    for w in [*text.encode().lower().split(), "</s>"]:
        out += math.log10(p(u, w))
        u = w
    return out, p, [*cont]


def test_kneser_ney_against_dictionaries(spark):
    rng = random.Random(5)
    words = [f"W{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*t.lower().split(), ""])
    n = sum(count.values())
    for r in rows(lm.lm_scores(df)):
        toks = [*texts[r["doc_id"]].lower().split(), ""]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(toks), sum(count[t] > 0 for t in toks), n)
        assert abs(r["base_score"] - sum(math.log10((count[t] + 1) / (n + len(count) + 1)) for t in toks)) < 1e-6
        assert abs(r["score"] - plain_kneser_ney(train, texts[r["doc_id"]])[0]) < 1e-6
    _, p, vocabulary = plain_kneser_ney(train, "")
    assert abs(sum(p(b"w0", w) for w in vocabulary) + p(b"w0", b"new") - 1) < 1e-9


def test_kneser_ney_on_hard_rows(spark, table, empty):
    got = rows(lm.lm_scores(table))
    assert len(got) == len(HARD) + 2 and not rows(lm.lm_scores(empty))
    text = {k: t for k, t in enumerate(HARD)} | {None: "same text here now"}
    train = [r["text"] or "" for r in rows(table) if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    for r in got:
        assert not (r["doc_id"] is None and r["held_out"]) and abs(r["score"] - plain_kneser_ney(train, text[r["doc_id"]] or "")[0]) < 1e-6


@pytest.mark.parametrize("texts", [["one"], ["a b c", "a b", "", None], [None]])
def test_kneser_ney_with_more_shards_than_bigrams(spark, monkeypatch, texts):
    """Shards without a word or a bigram have no file."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 1)
    df = spark.createDataFrame([(10 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    train = [t or "" for k, t in enumerate(texts) if zlib.crc32(str(10 * k).encode()) % 7 != 2]
    for r in rows(lm.lm_scores(df)):
        assert abs(r["score"] - (plain_kneser_ney(train, texts[r["doc_id"] // 10] or "")[0] if train else 0)) < 1e-6


def test_calls_and_results(spark):
    calls = spark.createDataFrame([("a", None, "ask", '{"turn": 1, "text": "x"}'), ("b", "a", "ask", '{"turn":"1","text":"x"}'), ("c", "b", "none", "{}"), ("d", "e", "ask", "oops"), ("e", "d", "ask", "[1]"), (None, None, "ask", None), ("f", "gone", "ask", '{"z":{"b":1,"a":2},"text":"q","turn":2}')], "call_id string, parent_id string, name string, arguments string")
    results = spark.createDataFrame([("a", "r"), ("zz", "lost"), (None, None), ("a", "again")], "call_id string, content string")
    got = rows(chat_format.link_tool_calls(calls, results, chat_format.TURN_SCHEMAS))
    by = {(r["call_id"], r["kind"]): r for r in got}
    assert len(got) == 11 and [by[c, "call"]["depth"] for c in "abcdef"] == [0, 1, 2, None, None, 0]
    assert [by[c, "call"]["errors"] for c in "abcde"] == ["", "turn: not of type integer", "name: unknown", "arguments: not JSON", "arguments: not an object; text: missing; turn: missing"]
    assert by["a", "call"]["linked"] and not by["b", "call"]["linked"] and not by["zz", "result"]["linked"]
    assert json.loads(json.loads(by["f", "call"]["message"])["tool_calls"][0]["function"]["arguments"]) == {"text": "q", "turn": 2, "z": {"a": 2, "b": 1}}
    assert by["f", "call"]["message"] == json.dumps(json.loads(by["f", "call"]["message"]), sort_keys=True, separators=(",", ":"))


def test_a_repeated_call_has_its_least_parent(spark):
    calls = spark.createDataFrame([("c", "b"), ("c", "a"), ("a", None), ("b", "a"), ("c", None), ("d", "c"), ("d", "zz")], "call_id string, parent_id string")
    assert {r["call_id"]: r["depth"] for r in rows(chat_format.call_depths(calls.repartition(3)))} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_a_long_chain_has_its_depths(spark):
    calls = spark.createDataFrame([(f"c{k}", f"c{k - 1}" if k else None) for k in range(40)], "call_id string, parent_id string")
    assert {r["call_id"]: r["depth"] for r in rows(chat_format.call_depths(calls))} == {f"c{k}": k for k in range(40)}


def test_shards(spark, table, empty):
    n = 500
    data = [(k, "t" * (k % 7), f"s{min(k % 10, 3)}") for k in range(n)]
    got = rows(sharding.stratified_shards(spark.createDataFrame(data, "doc_id long, text string, source string")))
    draw = {k: hashlib.md5(f"{sharding.SEED}:{k}:{zlib.crc32(t.encode())}:{len(t) + 8}".encode()).hexdigest() for k, t, _ in data}
    by = defaultdict(list)
    for k, _, s in data:
        by[s].append(k)
    order = sorted(((2 * r - 1) / (2 * len(ks)), "=" + s, draw[k], k) for s, ks in by.items() for r, k in enumerate(sorted(ks, key=draw.get), 1))
    want = {k: at * 24 // n for at, (*_, k) in enumerate(order)}
    assert {r["doc_id"]: r["shard"] for r in got} == want
    assert all(r["size"] == len(data[r["doc_id"]][1]) + 8 and r["text_crc32"] == zlib.crc32(data[r["doc_id"]][1].encode()) for r in got)
    for s in range(24):
        mine = [r for r in got if r["shard"] == s]
        assert len(mine) in (20, 21) and sorted(r["slot"] for r in mine) == list(range(len(mine)))
        share = sum(data[r["doc_id"]][2] == "s3" for r in mine) / len(mine)
        assert abs(share - 0.7) < 0.1
    got = rows(sharding.stratified_shards(table))
    text = dict(enumerate(HARD)) | {None: "same text here now"}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows(table)) and text
    assert not rows(sharding.stratified_shards(empty))


def test_shards_of_equal_rows(spark, monkeypatch):
    """A source of one row, over and over, and null ids: counted, then spread over their ranks."""
    monkeypatch.setattr(sharding, "SPREAD", 16)
    data = [(None, "x", "a")] * 700 + [(5, "y", "a")] * 50 + [(k, "z", None) for k in range(250)]
    got = rows(sharding.stratified_shards(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)))
    assert len(got) == 1000 and Counter(r["doc_id"] for r in got)[None] == 700
    for s in range(24):
        mine = [r for r in got if r["shard"] == s]
        assert len(mine) in (41, 42) and sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["doc_id"] is None for r in mine) + sum(r["doc_id"] == 5 and r["size"] == 9 and r["text_crc32"] == zlib.crc32(b"y") for r in mine) - 0.75 * len(mine)) <= 2


def test_the_sharding_sql(spark):
    import duckdb

    docs = "/root/testdata/sf0.001/documents.parquet"
    got = Counter(tuple(r.asDict().values()) for r in sharding.stratified_shards(spark.read.parquet(docs)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{docs}')")
    assert got == Counter(con.sql(sharding.ORACLE_SQL).fetchall())


def test_ogg_round_trip_and_damage():
    rng = random.Random(2)
    for size in (192, 192 * 15, 3072, 3264, 6144, 192 * 500, 70_080):
        payload = bytes(rng.randrange(256) for _ in range(size))
        media = ogg_media.store_payload(payload)
        back, said = ogg_media.load_payload(media)
        assert back == payload and said["end"] == size / ogg_media.RATE
        bad = bytearray(media)
        bad[len(bad) // 2] ^= 1
        with pytest.raises(ValueError):
            ogg_media.load_payload(bytes(bad))
    packets = [(os.urandom(k), n) for n, k in enumerate((0, 254, 255, 256, 65_025, 70_000, 200_000, 1))]
    data = b"".join(p for _, p in ogg_media.stream_pages(9, packets))
    streams, errors = ogg_media.read_ogg(data)
    assert not errors and not streams[9].errors and streams[9].packets == [p for p, _ in packets]
    assert ogg_media.checksum(b"123456789") == 0x89A1897F


def test_media_of_hard_rows(table, empty):
    got = rows(ogg_media.text_media(table))
    for r in got:
        text = ((HARD[r["doc_id"]] if r["doc_id"] is not None else HARD[14]) or "").encode()
        payload = text + b" " * (-len(text) % 192 or 192 * (not text))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = ogg_media.store_payload(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and r["media"] == media
        said = dict(x.split("=") for x in r["feature"].split(";"))
        mean = sum(payload) / len(payload)
        crossings = sum((a > mean) != (b > mean) for a, b in zip(payload, payload[1:]))
        streams = ogg_media.read_ogg(media)[0]
        assert said == {"streams": "2", "pages": str(media.count(b"OggS")), "packets": str(-(-len(payload) // 3072)), "seconds": f"{len(payload) / ogg_media.RATE:.6f}", "mean": f"{mean:.4f}", "crossings": str(crossings)} and len(streams) == 2
    assert len(got) == len(HARD) + 2 and not rows(ogg_media.text_media(empty))
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (14, 16, None)}) == 1


def plain_licences(text):
    """Every template at every place, word by word."""
    import regex

    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    base = [(i, label) for p, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    best = {label: 1.0 for _, label in base}
    for label, key, body in licences.TEMPLATES:
        t, k = licences.words_of(body), key.split()
        lead = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        for start in range(1 - len(t), len(words)):
            if words[max(0, start + lead) : start + lead + len(k)] == k and start + lead >= 0:
                n = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t))
                if 100 * n >= licences.SHARE * len(t):
                    best[label] = max(best.get(label, 0), n / len(t))
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(best)), max(best.values(), default=0.0)


def test_licences_against_every_template_at_every_place(spark, table, empty):
    rng = random.Random(9)
    texts = ["All rights reserved. X CC-BY-NC 4.0 cc by", "general PUBLIC license general public license", "all rights", "reserved", "Released under the MIT License.", "É cc by", "they like the mit license", "cc by cc by cc by", None, ""]
    for _, _, body in licences.TEMPLATES:
        w = body.split()
        texts += [body, "some words before " + body + " and after", " ".join(w[len(w) // 8 :]), " ".join(w[: -max(1, len(w) // 6)]), " ".join(w[: len(w) // 2])]
        for share in (0.1, 0.18, 0.25):
            texts.append(" ".join(rng.choice(["a", "the", "of", "software"]) if rng.random() < share else x for x in w))
    texts.append(" ".join(b for _, _, b in licences.TEMPLATES))
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lower(text) LIKE '%licen%' OR lower(text) LIKE '%rights%'").limit(40).collect()]
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for r in rows(licences.scan_licences(df)):
        want = plain_licences(texts[r["doc_id"]])
        assert tuple(r[c] for c in names)[:-1] == want[:-1] and abs(r["score"] - want[-1]) < 1e-12
        some += bool(want[5])
    assert some > 100
    got = {r["doc_id"]: r["labels"] for r in rows(licences.scan_licences(df))}
    assert got[4] == "mit" and got[6] == ""
    text = dict(enumerate(HARD)) | {None: "same text here now"}
    for r in rows(licences.scan_licences(table)):
        assert tuple(r[c] for c in names) == plain_licences(text[r["doc_id"]])
    assert not rows(licences.scan_licences(empty))


def test_exact_dedup(table, empty):
    got = rows(exact_dedup.exact_dedup(table))
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0d]+", " ", t or "")
    text = {k: norm(t) for k, t in enumerate(HARD)} | {None: "same text here now"}
    every = Counter(text[r["doc_id"]] for r in got)
    assert len(got) == len(HARD) + 2 and not rows(exact_dedup.exact_dedup(empty))
    for r in got:
        t = text[r["doc_id"]]
        keep = min(k for k, x in text.items() if x == t and k is not None)
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, every[t], r["doc_id"] == keep, hashlib.sha256(t.encode()).hexdigest())


def test_long_matches_are_tiktokens():
    rng = random.Random(8)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    letters = "abcdefghijklmnopqrstuvwxyz"
    for text in ("".join(rng.choices(letters, k=1_200_000)), "ab" * 5000, "a" * 257 + " " + "é" * 700, "".join(rng.choices(letters, k=256))):
        assert next(bpe.rank_encoder(RANKS).encode([text.encode()])).tolist() == enc.encode_ordinary(text)


def test_packing(spark, table, empty):
    """Repeated rows and null ids are documents of their own; ids are the library's, special strings too."""
    tok = Tokenizer.from_file(MERGES)
    got = rows(packing.pack_documents(table, MERGES))
    bins, pieces = defaultdict(list), Counter()
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for b in bins.values():
        at = 0
        for off, size in sorted(b):
            assert off == at
            at += size
        assert at <= 1024
    want = Counter()
    for r in rows(table):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())] += 1
    assert pieces == want
    assert not rows(packing.pack_documents(empty, MERGES))


def test_packing_needs_few_sequences(spark):
    """No more than best-fit decreasing by one deme, and each item in one place."""
    rng = random.Random(6)
    sizes = [rng.randint(200, 700) for _ in range(3000)] + [1024] * 5
    got = rows(packing.pack_items(spark.createDataFrame(list(enumerate(sizes)), "item long, length long").repartition(3), deme=1000))
    assert sorted(r["item"] for r in got) == list(range(len(sizes)))
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], sizes[r["item"]]))
    for e in ends.values():
        assert [o for o, _ in sorted(e)] == [sum(n for _, n in sorted(e)[:k]) for k in range(len(e))] and sum(n for _, n in e) <= 1024
    assert len(ends) <= len(packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1024))


@pytest.mark.parametrize(("low", "high", "better"), [(200, 700, True), (250, 520, True), (1, 1023, False)])
def test_islands_beat_best_fit(low, high, better):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(2000)]
    islands, elites = [[] for _ in range(packing.ISLANDS)], [None] * packing.ISLANDS
    for epoch in range(packing.EPOCHS):
        islands = [packing.evolve(sizes, 1024, own, elite, 10 * epoch + k) for k, (own, elite) in enumerate(zip(islands, elites, strict=True))]
        elites = [islands[k - 1][0] for k in range(packing.ISLANDS)]
    best = min((own[0] for own in islands), key=len)
    assert sorted(i for _, items in best for i in items) == list(range(2000)) and all(used == sum(sizes[i] for i in items) <= 1024 for used, items in best)
    plain = len(packing.best_fit(sorted(range(2000), key=lambda i: -sizes[i]), sizes, 1024))
    assert packing.least_bins(sizes, 1024) <= len(best) <= plain - better


def shingles(t, n=3):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(texts, hundredths=90, n=3):
    sets = {k: shingles(t, n) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ks = sorted(texts)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize(("hundredths", "block"), [(90, 1024), (80, 3)])
def test_jaccard_against_all_pairs(spark, monkeypatch, hundredths, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(hundredths + block)
    words = [f"w{k}" for k in range(300)]
    texts, k = {}, 0
    for size in (1, 2, 3, 8, 11, 12, 14, 20, 30, 45, 70, 120, 300):
        for _ in range(4):
            base = rng.choices(words, k=size)
            for _ in range(6):
                t = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    at = rng.randrange(len(t))
                    t[at : at + 1] = rng.choice([[rng.choice(words)], [], [t[at], rng.choice(words)]])
                    t = t or ["x"]
                texts[k] = " ".join(t)
                k += 1
    for t in ("", None, " \n"):
        texts[k] = t
        k += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_components(df, hundredths=hundredths))}
    assert got == plain_components(texts, hundredths)


def five_word_groups(texts):
    """By id, the least id that links of five-word sets (0.8 or more in common) reach, by comparing all pairs."""
    sets = {}
    for k, t in texts.items():
        w = t.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[a] != least[b]:
                old, new = sorted((least[a], least[b]), reverse=True)
                least = {k: new if r == old else r for k, r in least.items()}
    return least


def near_texts():
    """Near copies on both sides of the border, chains of them, and a passage that half of the texts have."""
    rng = random.Random(5)
    words, passage = [f"w{k}" for k in range(400)], " ".join(f"p{k}" for k in range(40))
    texts = {}
    for size in (3, 6, 9, 15, 30, 60, 130, 300):
        for _ in range(5):
            t = rng.choices(words, k=size)
            for step in range(6):
                t = list(t)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    t[rng.randrange(len(t))] = rng.choice(words)
                texts[len(texts)] = " ".join(t) + (" " + passage if step % 2 and size < 60 else "")
    return texts


def test_near_stage_is_five_words_and_four_fifths(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = five_word_groups(texts)
    assert 5 < len(set(want.values())) < len(texts) - 5
    assert sorted(r["doc_id"] for r in rows(corpus_pipeline.near(spark, df, ""))) == sorted(k for k, r in want.items() if k == r)


@pytest.mark.parametrize(("common", "block"), [(0, 1024), (200_000, 4)])
def test_prefixes_against_all_pairs(spark, monkeypatch, common, block):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_texts()
    df = spark.createDataFrame([*texts.items(), (1000, ""), (1001, None)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in rows(jaccard_join.jaccard_components(df, shingle=5, hundredths=80, prefixes=True))}
    assert got == five_word_groups(texts) | {1000: 1000, 1001: 1001}


def test_all_rows_say_which_shingles_are_rare(spark, monkeypatch):
    """A passage that 200 of 41,000 rows have, none of them among the half that a draw by hash would take."""
    passage, own = " ".join(f"p{k}" for k in range(20)), " ".join(f"'a{k}x', doc_id, ' '," for k in range(12))
    df = spark.range(41_000).selectExpr("id AS doc_id").selectExpr("doc_id", f"concat(if(doc_id % 100 = 0, '{passage} ', ''), {own} 'z') AS text")
    df = df.filter("doc_id % 100 > 0 OR pmod(xxhash64(doc_id, text), 2) = 1")
    assert df.count() >= 40_000 and 100 < df.filter("doc_id % 100 = 0").count() < 300
    text = df.filter("doc_id % 100 = 0").first()["text"].encode()

    class Seen(Exception):
        pass

    def signed(texts, n, signs):
        raise Seen(signs)

    monkeypatch.setattr(jaccard_join, "_signatures", signed)
    with pytest.raises(Seen) as seen:
        jaccard_join.jaccard_components(df, shingle=5, hundredths=80, prefixes=True)
    every, common = jaccard_join.sets_of([text, passage.encode()], 5)
    first = seen.value.args[0](every)
    assert (len(every), len(common), len(first)) == (29, 16, 6) and not np.isin(first, common).any()


def test_groups_make_no_more_rows_than_signatures(spark, monkeypatch):
    """Sets that share most shingles, of one passage none linked, of the other all by a few that link to many."""
    rng = random.Random(6)

    def group(size):
        texts = {}
        for k in range(size):
            own = 3 if k % 2 and k % 5 == 0 else 8
            texts[k] = " ".join([f"{'ab'[k % 2]}{x}" for x in range(60)] + [f"w{rng.randrange(10**9)}" for _ in range(own)])
        return texts

    def run(texts):
        made = {}

        def counted(df, name, stored=jaccard_join.stored):
            out = stored(df, name)
            made[name] = max(made.get(name, 0), out.count())
            return out

        with monkeypatch.context() as m:
            m.setattr(jaccard_join, "stored", counted)
            df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
            got = {r["doc_id"]: r["component_id"] for r in rows(jaccard_join.jaccard_components(df, shingle=5, hundredths=80, prefixes=True))}
        want = five_word_groups(texts)
        assert got == want and len(set(want.values())) == len(texts) // 2 + 1
        return made

    made = run(group(400))
    assert {k: n for k, n in made.items() if n > made["jaccard-signed"]} == {}
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 700)
    run(group(80))


def test_jaccard_on_hard_rows(table, empty):
    text = dict(enumerate(HARD))
    want = plain_components(text)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_components(table)))
    assert got == Counter([(k, *want[k]) for k in text] + [(4, *want[4]), (None, *want[16])]) and not rows(jaccard_join.jaccard_components(empty))


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 200), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in rows(components.components(e))} == {k: 0 for k in range(1, 51)} | {200: 100}


def test_language_id(spark, table, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg(F.col("accepted").cast("int")).alias("accepted")).first()
    assert r["right"] > 0.93 and r["accepted"] > 0.95
    hard = {r["doc_id"]: r for r in rows(langid.languages(table))}
    assert all(hard[k]["lang_pred"] == "und" and hard[k]["score"] == 0 for k in (0, 1, 2, 3, 12)) and hard[4]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in hard.values()) and not rows(langid.languages(empty))


def plain_language(rows_):
    """A classifier of the same kind, from the rows alone: every text is drawn, since there are few."""
    drawn = {}
    for r in rows_:
        if r["lang"] is not None and r["text"] is not None and not (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2):
            drawn.setdefault(r["lang"], set()).add((xxhash.xxh64_intdigest(r["text"].encode(), 42) & (2**62 - 1), r["text"]))
    assert all(len(x) < langid.SAMPLE_ROWS and len(t) <= langid.WINDOW for x in drawn.values() for _, t in x)
    books = {k: b" ".join(w for _, t in sorted(x) if (w := langid.letters(t)))[: langid.DICTIONARY_BYTES] for k, x in drawn.items()}

    def size(book, text):
        d = zstandard.ZstdCompressionDict(book or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(tool.compress(text[i : i + langid.PIECE])) - 6 for i in range(0, len(text), langid.PIECE))

    def guess(text):
        plain = langid.letters(text or "")
        if not plain or not books:
            return "und", 0.0, False
        sizes = sorted((size(b, plain), k) for k, b in books.items())
        lead = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], lead, lead > langid.MARGIN

    return guess


@pytest.fixture(scope="module")
def corpus(spark):
    """Real texts with null ids, repeated ids and rows, ties, empties and copies."""
    real = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").limit(110).collect()]
    texts = [r["text"] for r in real]
    more = [(5, texts[0], "en"), (None, texts[1], "en"), (None, texts[1], "en"), (None, texts[2] + " and more", "de"), (7, texts[3], "fr"), (7, texts[4] + " x", "fr"), (7, "", None), (8, None, "en"), (9, "12 34", "en"), (9, "12 34", "en"), (None, None, None), (1000, texts[6].replace(" ", "  "), "es"), (-1, texts[7], "en"), (-1, texts[7], "en")]
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in real] + [(i, t, k, None, 1) for i, t, k in more], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)


def test_language_id_against_a_plain_classifier(spark, corpus):
    every = rows(corpus)
    guess = plain_language(every)
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9), r["accepted"]) for r in rows(langid.languages(corpus)))
    want = Counter((r["doc_id"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2, *((g := guess(r["text"]))[0], round(g[1], 9), g[2])) for r in every)
    assert got == want


def test_a_language_of_copies_is_learned(spark):
    """However often its one text was copied, and however many languages there are."""
    df = spark.createDataFrame([(k, "le chat dort sur la table de la maison", "xx") for k in range(5000)] + [(9000 + k, f"the dog number {k} barks", f"l{k % 40}") for k in range(400)], "doc_id long, text string, lang string")
    books = langid.train(df)
    assert len(books) == 41 and len(books["xx"]) > 30 and all(books.values())
    long = langid.train(spark.createDataFrame([("lorem ipsum dolor " * 100_000, "la")], "text string, lang string"))
    assert 1000 < len(long["la"]) <= langid.WINDOW


def test_pipeline_against_plain_stages(spark, corpus, tmp_path):
    every = rows(corpus)
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    guess = plain_language(every)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    want = [r for r in every if guess(r["text"])[2]]
    got = corpus_pipeline.language(spark, docs, str(tmp_path))
    plain = lambda rs: Counter(tuple(r.values()) for r in rs)
    assert got.columns == docs.columns and plain(rows(got)) == plain(want) and len(want) < len(every)
    first = {}
    for r in sorted(every, key=key):
        first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0d]+", r["text"] or "")), r)
    got = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in rows(got)) == Counter((r["doc_id"], r["text"]) for r in first.values())
    group = five_word_groups({k: r["text"] or "" for k, r in enumerate(every)})
    stay = {}
    for k, r in sorted(enumerate(every), key=lambda x: key(x[1])):
        stay.setdefault(group[k], r)
    got = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in rows(got)) == Counter((r["doc_id"], r["text"]) for r in stay.values())
    out = rows(corpus_pipeline.run(spark, str(tmp_path)))
    kept = []
    for r in sorted((r for r in want), key=key):
        if not any((r["text"] or "").split() == (q["text"] or "").split() for q in kept):
            kept.append(r)
    group = five_word_groups({k: r["text"] for k, r in enumerate(kept)})
    final = [r for k, r in enumerate(kept) if group[k] == k]
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(r["doc_id"] for r in final)


def test_pipeline_of_no_documents(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    assert not rows(corpus_pipeline.run(spark, str(tmp_path)))


def test_kept_documents_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "a b"), (None, "e"), (None, "e"), (3, "f"), (3, "f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in rows(exact_dedup.kept_documents(df)))
    assert got == [(0, "e"), (1, "a b"), (2, "c d"), (3, "f")]
