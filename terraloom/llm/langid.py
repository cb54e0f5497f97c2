"""Language identification by compression with one raw-content dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_texts, small_batches, texts_of

#: Training texts of a language: so many distinct ones, drawn by the hash of the text; of longer ones a window of WINDOW characters.
SAMPLE_ROWS, WINDOW = 400, 2048
#: Bytes of a language's dictionary, and of a piece of text that is compressed at once.
DICTIONARY_BYTES, PIECE = 192 * 1024, 1024
#: Bytes of all dictionaries: with more languages than fit at DICTIONARY_BYTES, each gets an equal share.
ALL_BYTES = 96 << 20
LEVEL = 3
#: A text is rejected if the second smallest size is within this share of the smallest.
MARGIN = 0.004
#: With more labels than this, the column does not hold languages: training raises.
MOST_LANGUAGES = 1 << 14
_LETTER = regex.compile(r"\p{L}")
_ASCII = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
UNKNOWN = "und"


def letters(text: str) -> bytes:
    """A text in lower case, runs of ASCII other than letters as one blank; empty if it has no letter.

    Neither case nor marks tell languages apart.
    """
    plain = b" ".join(text.lower().encode().translate(_ASCII).split())
    return plain if not plain.isascii() and _LETTER.search(text) or plain.isascii() else b""


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of rows with a label and a text.

    Distinct texts are counted over all rows, by language and approximately. A language's texts are drawn where their hash is
    below the share that gives half as many again as SAMPLE_ROWS, copies of a text once; the SAMPLE_ROWS of least hash stay.
    So the sample depends neither on partitions nor on how often a text was copied, and a language of fewer texts is drawn
    whole. A text longer than WINDOW gives the window at which its hash points. Sorted by hash, they are laid end to end up
    to the dictionary's bytes. Every language is learned; beyond MOST_LANGUAGES labels a ValueError is raised. No labelled
    rows: no languages.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    draw = F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1))
    rows = rows.withColumn("draw", draw)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    want = max(4, SAMPLE_ROWS * size // DICTIONARY_BYTES)
    limits = labelled.sparkSession.createDataFrame([(k, int(min(1.0, 1.5 * want / max(n, 1)) * (2**62 - 1))) for k, n in counts.items()], "lang string, most long")
    start = F.pmod(F.xxhash64("draw"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    drawn = rows.join(F.broadcast(limits), "lang").filter("draw <= most").select("lang", "draw", F.substring("text", start, F.lit(WINDOW)).alias("text")).distinct()
    parts: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted(drawn.collect(), key=lambda r: (r["draw"], r["lang"], r["text"])):
        mine = parts[r["lang"]]
        if len(mine) < want:
            mine.append(letters(r["text"]))
    return {k: b" ".join(t for t in parts[k] if t)[:size] for k in sorted(parts)}


class Classifier:
    """Sizes of a text, compressed with each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.tools = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        """Of a text's pieces, compressed one by one, so that the dictionary and not the text itself says what is cheap."""
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return [sum(len(t.compress(p)) - 6 for p in pieces) for t in self.tools]

    def __call__(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score (the smallest size's lead as a share of the second smallest, scaled to 0..1), and whether the margin is wide."""
        plain = letters(text.decode("utf-8", "replace"))
        if not self.languages or not plain:
            return UNKNOWN, 0.0, False
        sizes = self.sizes(plain)
        first = min(range(len(sizes)), key=lambda k: (sizes[k], self.languages[k]))
        others = [x for k, x in enumerate(sizes) if k != first]
        if not others:
            return self.languages[first], 1.0, True
        lead = 1 - sizes[first] / max(1, min(others))
        return self.languages[first], min(1.0, max(0.0, lead)), lead > MARGIN


def _predicted(df: DataFrame, text_col: str, dictionaries: dict[str, bytes], names: list[str]) -> DataFrame:
    """df with three more columns of the given names."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)  # at most ALL_BYTES
    made: list[Classifier] = []
    kinds = [pa.string(), pa.float64(), pa.bool_()]
    every = [*df.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not made:
                made.append(Classifier(sent.value))
            got = [made[0](t) for t in texts_of(b, text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], every)

    new = [T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row, from its whole text alone.

    `und`, score 0 and not accepted: null, empty and letterless texts, or no learned language. Ties go to the first
    language by name and, the margin being 0, are not accepted. Repeated rows and null ids are rows like others; other
    columns are not read; an empty table gives no rows.
    """
    return _predicted(keyed_texts(df, id_col, text_col), "text", dictionaries, ["lang_pred", "score", "accepted"]).drop("text")


def accepted(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of df whose text is accepted, with all their columns: row by row, without a join, so ids don't matter."""
    return _predicted(df, text_col, dictionaries, ["__lang", "__score", "__accepted"]).filter("__accepted").select(*df.columns)


def held_out(id_col: str = "doc_id"):
    """A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(df: DataFrame) -> DataFrame:
    """Learns from the labelled rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score, accepted."""
    found = identify(df, train(df.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
