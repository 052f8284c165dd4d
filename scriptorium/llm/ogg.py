"""Ogg media columns: payloads stored as multiplexed logical streams and read back.

A stored medium has `STREAMS` logical streams. Each opens with a header packet (magic, stream number,
stream count, rate, packet size, payload length) on a page of its own; the payload's
packets go to the streams in turn, and the streams' pages alternate. A granule position counts
the 8-bit samples of a stream that are complete by the end of a page. Reading checks
every page's checksum and sequence number, joins packets from the lacing values across pages, keeps
streams apart by serial number and derives each packet's time from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAMS = 2
RATE = 8000
PACKET = 3072
UNIT = 192
MAGIC = b"PCM8data"
HEAD = struct.Struct("<8sBBIIQ")
#: An Ogg page: capture pattern, version, flags, granule position, serial, sequence, checksum, segments.
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Ogg's CRC is zlib's polynomial with bits in the other order: reverse the bits of each byte, and of the sum.
REVERSED = bytes(int(f"{n:08b}"[::-1], 2) for n in range(256))
ROWS = 256


class OggError(ValueError):
    """A medium that breaks the format: a wrong checksum, a lost page, or a cut packet."""


def page_crc(page: bytes) -> int:
    raw = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(REVERSED), "big")


def padded(payload: bytes) -> bytes:
    """The bytes followed by spaces, up to a positive multiple of `UNIT`."""
    return payload.ljust(max(1, -(-len(payload) // UNIT)) * UNIT, b" ")


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    start = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = start + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def stream_pages(serial: int, head: bytes, packets: list[bytes]) -> Iterator[bytes]:
    """A logical stream's pages: the header alone, then up to 255 segments a page, so that packets may run on."""
    yield make_page(serial, 0, FIRST | (0 if packets else LAST), 0, bytes([len(head)]), head)
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, at, done, number = b"".join(packets), 0, 0, 1
    ends = np.cumsum(np.frombuffer(lacing, np.uint8), dtype=np.int64)
    for first in range(0, len(lacing), 255):
        part = lacing[first : first + 255]
        end = int(ends[first + len(part) - 1])
        closing = max((k for k, n in enumerate(part) if n < 255), default=None) if part[-1] == 255 else len(part) - 1
        granule = -1 if closing is None else int(ends[first + closing])
        done = done if closing is None else granule
        flags = CONTINUED * (first > 0 and lacing[first - 1] == 255) | LAST * (first + 255 >= len(lacing))
        yield make_page(serial, number, flags, granule, part, body[at:end])
        at, number = end, number + 1


def write_ogg(payload: bytes) -> bytes:
    """The payload as an Ogg medium; equal payloads make equal media."""
    seed = zlib.crc32(payload)
    cut = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    streams = []
    for k in range(STREAMS):
        head = HEAD.pack(MAGIC, k, STREAMS, RATE, PACKET, len(payload))
        streams.append(list(stream_pages((seed + k) & 0xFFFFFFFF, head, cut[k::STREAMS])))
    longest = max(map(len, streams))
    return b"".join(pages[k] for k in range(longest) for pages in streams if k < len(pages))


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, sequence, flags, granule, lacing, body) of each page, its checksum verified."""
    at = 0
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise OggError("cut page header")
        mark, version, flags, granule, serial, number, crc, segments = PAGE.unpack_from(media, at)
        lacing = media[at + PAGE.size : at + PAGE.size + segments]
        end = at + PAGE.size + segments + sum(lacing)
        if mark != b"OggS" or version or end > len(media) or len(lacing) < segments:
            raise OggError("no page, or a cut one")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError("page checksum")
        yield serial, number, flags, granule, lacing, media[at + PAGE.size + segments : end]
        at = end


def demultiplex(media: bytes) -> tuple[dict[int, list[tuple[bytes, int]]], int]:
    """Each logical stream's packets, as (bytes, granule position at the packet's end), and the number of pages."""
    streams: dict[int, list] = {}
    state: dict[int, list] = {}  # next sequence number, bytes of an unfinished packet, granule so far
    pages = 0
    for serial, number, flags, granule, lacing, body in read_pages(media):
        pages += 1
        if serial not in state:
            if not flags & FIRST:
                raise OggError("a stream without its first page")
            state[serial], streams[serial] = [0, b"", 0], []
        own = state[serial]
        if number != own[0] or bool(flags & CONTINUED) != bool(own[1]):
            raise OggError("a lost page")
        own[0] += 1
        at, full, packet = 0, [], own[1]
        for n in lacing:
            packet += body[at : at + n]
            at += n
            if n < 255:
                full.append(packet)
                packet = b""
        own[1] = packet
        if full:
            end = granule
            ends = []
            for p in reversed(full):
                ends.append(end)
                end -= len(p)
            streams[serial] += zip(full, reversed(ends), strict=True)
    if any(own[1] for own in state.values()):
        raise OggError("an unfinished packet")
    return streams, pages


def read_ogg(media: bytes) -> dict:
    """The payload of a medium and what its pages tell.

    Packets are put in order by their time (granule position over rate), then by stream."""
    streams, pages = demultiplex(media)
    if not streams:
        raise OggError("no stream")
    timed, total, rate = [], 0, RATE
    for packets in streams.values():
        magic, k, count, rate, _, total = HEAD.unpack(packets[0][0])
        if magic != MAGIC or count != len(streams):
            raise OggError("not this stream's header")
        timed += [(end - len(p), k, p) for p, end in packets[1:]]
    timed.sort(key=lambda x: x[:2])
    payload = b"".join(p for _, _, p in timed)
    if len(payload) != total:
        raise OggError("payload length")
    end = max((at + len(p) for at, _, p in timed), default=0)
    return {"payload": payload, "streams": len(streams), "pages": pages, "packets": len(timed), "duration_ms": end * 1000 // rate}


def features(found: dict) -> str:
    """Signal figures in whole numbers: mean, mean square and sign changes about the mid level, and the medium's shape."""
    samples = np.frombuffer(found["payload"], np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return (
        f"mean={samples.sum() * 1000 // len(samples)};power={(samples * samples).sum() // len(samples)};turns={turns};"
        f"streams={found['streams']};packets={found['packets']};pages={found['pages']};ms={found['duration_ms']}"
    )


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            raw = [(x or "").encode() for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([write_ogg(padded(x)) for x in raw], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


READ_FIELDS = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
    "media_sha256": pa.string(), "feature": pa.string(), "pages": pa.int64(), "packets": pa.int64(), "duration_ms": pa.int64(), "error": pa.string(),
}


def _digest(media: bytes | None) -> list:
    if media is None:
        return [None] * (len(READ_FIELDS) - 1) + ["no medium"]
    stored = [len(media), hashlib.sha256(media).hexdigest()]
    try:
        found = read_ogg(media)
        payload = found["payload"]
        own = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])]
        return [*own, *stored, features(found), found["pages"], found["packets"], found["duration_ms"], None]
    except (OggError, struct.error, IndexError) as broken:
        return [None] * 3 + stored + [None] * 4 + [str(broken) or "cut header"]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            columns = zip(*map(_digest, part["media"].to_pylist()), strict=True)
            read = [pa.array(c, kind) for c, kind in zip(columns, READ_FIELDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], *read], ["doc_id", "n_bytes", *READ_FIELDS])


def encode_ogg(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row: its whole text, padded, as an Ogg medium.

    Null text counts as empty; an empty text is one unit of spaces. Every row is kept, repeated ones
    too, and other columns are left out. A row at a time is in memory, however long.
    """
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encode, "doc_id long, n_bytes long, media binary"
    )


def decode_ogg(media: DataFrame) -> DataFrame:
    """Digests, features, pages, packets and duration of each (doc_id, n_bytes, media), read back from the medium.

    A medium that breaks the format has its reason in `error` and nulls for what can't be read.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _decode,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, pages long, packets long, duration_ms long, error string",
    )
