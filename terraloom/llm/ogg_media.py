"""Ogg containers: pages with checksums, packets over lacing values, logical streams, granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, small_batches, texts_of

#: Fixed values of the format: https://www.rfc-editor.org/rfc/rfc3533
CAPTURE, HEADER, MOST_SEGMENTS = b"OggS", struct.Struct("<4sBBqIIIB"), 255
CONTINUED, FIRST, LAST = 1, 2, 4
#: Samples a second, samples in a frame, frames in a packet.
RATE, FRAME, FRAMES = 8000, 192, 16
#: Packets on a page at most, unless a packet goes on.
PAGE_PACKETS = 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC-32 (polynomial 04C11DB7, not reflected, start 0): that of zlib over mirrored bits, mirrored."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: list[int], body: bytes) -> bytes:
    page = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + bytes(lacing) + body)
    page[22:26] = struct.pack("<I", checksum(bytes(page)))
    return bytes(page)


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, each with the granule position that its place among other streams follows from.

    packets: (bytes, granule position after it). A page without the end of a packet has granule position -1.
    """
    out: list[tuple[int, bytes]] = []
    lacing: list[int] = []
    body: list[bytes] = []
    granule, ended, flags, order = -1, 0, FIRST, 0

    def close(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, ended, flags
        out.append((order, _page(serial, len(out), flags | LAST * last, granule, lacing, b"".join(body))))
        lacing, body, granule, ended, flags = [], [], -1, 0, CONTINUED * goes_on

    for k, (data, after) in enumerate(packets):
        order, rest, at = after, len(data), 0
        while True:
            if len(lacing) == MOST_SEGMENTS:
                close(False, at > 0)
            size = min(255, rest)
            lacing.append(size)
            body.append(data[at : at + size])
            at, rest = at + size, rest - size
            if size < 255:
                break
        granule, ended = after, ended + 1
        if k == len(packets) - 1 or ended == PAGE_PACKETS or k == 0:
            close(k == len(packets) - 1, False)
    return out


@dataclass
class Stream:
    """A logical stream as read: packets, the time in samples at which each ends (None if not told), damage."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: list[bytes] | None = None


def read_ogg(data: bytes) -> tuple[dict[int, Stream], list[str]]:
    """The logical streams by serial number, and what is wrong outside of them.

    Pages with a wrong checksum are skipped whole, and reading goes on at the next capture pattern; a missing page number
    is an error of its stream and ends the packet under way. Never raises for bad data.
    """
    streams: dict[int, Stream] = {}
    errors: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or at + 27 > len(data):
            found = data.find(CAPTURE, at + 1)
            errors.append(f"no page at byte {at}")
            at = found if found >= 0 else len(data)
            continue
        _, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        raw = data[at:end]
        if version or len(lacing) < segments or end > len(data) or checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            errors.append(f"bad page at byte {at}")
            found = data.find(CAPTURE, at + 4)
            at = found if found >= 0 else len(data)
            continue
        s = streams.setdefault(serial, Stream())
        if number != s.pages:
            s.errors.append(f"page {s.pages} is missing")
            s.pages, s.part = number, None
        s.pages += 1
        s.ended |= bool(flags & LAST)
        lost = flags & CONTINUED and s.part is None  # the rest of a packet whose start is lost
        if not flags & CONTINUED and s.part is not None:
            s.errors.append("a packet is cut off")
            s.part = None
        place, before = at + 27 + segments, len(s.packets)
        part = s.part if s.part is not None else []
        for size in lacing:
            part.append(data[place : place + size])
            place += size
            if size < 255:
                if not lost:
                    s.packets.append(b"".join(part))
                    s.granules.append(None)
                part, lost = [], False
        s.part = part if segments and lacing[-1] == 255 and not lost else None
        if len(s.packets) > before:
            s.granules[-1] = granule
        at = end
    for s in streams.values():
        if s.part is not None:
            s.errors.append("a packet is cut off")
    return streams, errors


def packet_times(stream: Stream, header: int = 1) -> list[float | None]:
    """Seconds at which each packet ends. A page tells it of its last packet; whole packets before it count back."""
    out: list[int | None] = list(stream.granules)
    for k in range(len(out) - 2, -1, -1):
        if out[k] is None and out[k + 1] is not None:
            out[k] = out[k + 1] - _samples(stream.packets[k + 1]) if k >= header else 0
    return [None if g is None else g / RATE for g in out]


def _samples(packet: bytes) -> int:
    """Samples on the time line that a packet moves its stream by: its own and those of the other stream's next."""
    return 2 * FRAME * FRAMES if len(packet) == FRAME * FRAMES else FRAME * FRAMES + len(packet)


def store_payload(payload: bytes) -> bytes:
    """8-bit samples as an Ogg file of two logical streams, to which packets go by turns; pages follow time.

    A stream's first packet tells its number, rate and frame. Granule positions count samples of the whole payload.
    Serial numbers follow from the payload's checksum, so equal payloads make equal files.
    """
    size = FRAME * FRAMES
    streams: list[list[tuple[bytes, int]]] = [[(b"TLraw8" + struct.pack("<BII", k, RATE, FRAME), 0)] for k in (0, 1)]
    for n, at in enumerate(range(0, len(payload), size)):
        streams[n % 2].append((payload[at : at + size], min(at + size, len(payload))))
    base = zlib.crc32(payload) & 0xFFFFFFFE
    pages = [(order, k, n, p) for k, packets in enumerate(streams) for n, (order, p) in enumerate(stream_pages(base + k, packets))]
    return b"".join(p for _, _, _, p in sorted(pages, key=lambda x: x[:3]))


def load_payload(media: bytes) -> tuple[bytes, dict]:
    """The samples of a file of store_payload, and what its containers say; raises ValueError on any damage."""
    streams, errors = read_ogg(media)
    errors += [e for s in streams.values() for e in s.errors] + [f"stream {n} does not end" for n, s in streams.items() if not s.ended]
    numbered = {}
    for s in streams.values():
        if not s.packets or s.packets[0][:6] != b"TLraw8":
            errors.append("a stream of another kind")
            continue
        numbered[s.packets[0][6]] = s
    if errors or sorted(numbered) != [0, 1]:
        raise ValueError("; ".join(errors) or "a stream is missing")
    timed = [(t, k, p) for k, s in numbered.items() for t, p in zip(packet_times(s)[1:], s.packets[1:], strict=True)]
    timed.sort(key=lambda x: x[:2])
    return b"".join(p for _, _, p in timed), {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(timed), "end": max((t for t, _, _ in timed), default=0.0)}


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Stores each whole text as an Ogg file, reads the file back, and describes it; see the columns below.

    The payload is the text's UTF-8 with blanks up to a positive multiple of 192 bytes. Null and empty texts are 192
    blanks. Everything follows from the text alone, so equal texts have equal values. One row for each input row, repeated
    rows and null ids too; no rows for an empty table; other columns are not read. feature: streams, pages, packets,
    seconds by the granule positions, and the samples' mean and zero-to-mean crossings.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), texts_of(b, "text"), strict=True):
                media = store_payload(text + b" " * (-len(text) % FRAME or FRAME * (not text)))
                back, said = load_payload(media)
                x = np.frombuffer(back, np.uint8)
                total = int(x.sum(dtype=np.int64))
                above = x.astype(np.int64) * len(x) > total
                feature = f"streams={said['streams']};pages={said['pages']};packets={said['packets']};seconds={said['end']:.6f};mean={total / len(x):.4f};crossings={int((above[1:] != above[:-1]).sum())}"
                rows.append((i, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media))
            cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(8 + with_media)]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    return keyed_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media)
