"""Ogg media columns: writing, checking and demultiplexing Ogg files held as binaries.

A file is a sequence of pages.  Each page names its logical stream, its place in that
stream, a granule position (here: samples up to the last packet that ends on the page), a
checksum and a lacing table that gives the lengths of the packet pieces it carries.

Edge cases: a null payload is an empty one; an empty payload gives streams without data
packets; null or damaged media give a null payload and a note in ``errors``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.llm.common import id_type, map_batches

#: Fixed values of the format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
MAX_LACING = 255
NO_GRANULE = -1

#: Identification packet of our sample streams: mark, sample rate, block, stream index and count.
IDENTITY = struct.Struct("<8sIHBB")
MARK = b"\x7fpcm8\x00\x00\x00"
SAMPLE_RATE = 8000
BLOCK = 576

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """The format's CRC (polynomial 0x04C11DB7, most significant bit first, start 0).

    It equals zlib's reflected CRC of the bit-reversed bytes, bit-reversed, once zlib's
    inversions before and after are undone.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(packets: list[bytes], granules: list[int], serial: int) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, each with the granule by which pages are interleaved."""
    segments: list[tuple[int, int]] = []  # lacing value, packet or -1 if it goes on
    for k, packet in enumerate(packets):
        full, rest = divmod(len(packet), MAX_LACING)
        segments += [(MAX_LACING, -1)] * full + [(rest, k)]
    body, at, pages, continued, reached = b"".join(packets), 0, [], False, 0
    cuts = [0, 1] if segments and segments[0][1] == 0 else [0]  # the identification packet has a page of its own
    while cuts[-1] < len(segments):
        cuts.append(min(cuts[-1] + MAX_LACING, len(segments)))
    for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = segments[a:b]
        size = sum(x for x, _ in part)
        ended = [k for _, k in part if k >= 0]
        granule = granules[ended[-1]] if ended else NO_GRANULE
        kind = CONTINUED * continued | FIRST * (number == 0) | LAST * (b == len(segments))
        pages.append((reached, _page(kind, granule, serial, number, bytes(x for x, _ in part), body[at : at + size])))
        at, continued, reached = at + size, part[-1][1] < 0, max(reached, granule)
    return pages


def write(payload: bytes, streams: int = 2, block: int = BLOCK, serial: int = 1) -> bytes:
    """``payload`` as unsigned 8-bit samples, its blocks dealt in turn to logical streams."""
    blocks = [payload[i : i + block] for i in range(0, len(payload), block)]
    first, rest = [], []
    for s in range(streams):
        own = blocks[s::streams]
        granules = np.cumsum([0, *map(len, own)]).tolist()
        identity = IDENTITY.pack(MARK, SAMPLE_RATE, block, s, streams)
        pages = stream_pages([identity, *own], granules, serial + s)
        first.append(pages[0][1])
        rest += [(at, s, k, page) for k, (at, page) in enumerate(pages[1:])]
    return b"".join(first) + b"".join(page for *_, page in sorted(rest, key=lambda x: x[:3]))


class Stream:
    """What has been read of one logical stream."""

    def __init__(self) -> None:
        self.packets: list[bytes] = []
        self.granules: list[int] = []  # of the page on which each packet ends
        self.partial: list[bytes] = []
        self.next = 0
        self.pages = 0
        self.ended = False


def read(media: bytes) -> tuple[dict[int, Stream], list[str]]:
    """Logical streams by serial number, and what was wrong.

    A page with a false checksum is skipped, and reading goes on at the next capture
    pattern.  A gap in page numbers drops the packet that it cuts.
    """
    streams: dict[int, Stream] = {}
    errors: list[str] = []
    at = 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE or at + HEADER.size > len(media):
            errors.append(f"no page at {at}")
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        _, version, kind, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or len(page) < end - at or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            errors.append(f"bad page at {at}")
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        stream = streams.setdefault(serial, Stream())
        if number != stream.next:
            errors.append(f"stream {serial}: page {stream.next} is missing")
            stream.partial = []
        skip = bool(kind & CONTINUED) and not stream.partial
        if not kind & CONTINUED and stream.partial:
            errors.append(f"stream {serial}: a packet is cut before page {number}")
            stream.partial = []
        piece = start
        for size in lacing:
            piece += size
            if size < MAX_LACING:
                if not skip:
                    stream.packets.append(b"".join([*stream.partial, media[start:piece]]))
                    stream.granules.append(granule)
                stream.partial, start, skip = [], piece, False
        if lacing and lacing[-1] == MAX_LACING and not skip:
            stream.partial.append(media[start:piece])
        stream.next, stream.pages, stream.ended = number + 1, stream.pages + 1, bool(kind & LAST)
        at = end
    errors += [f"stream {s}: no last page" for s, x in streams.items() if not x.ended]
    return streams, errors


def payload_of(streams: dict[int, Stream]) -> bytes:
    """The sample blocks of our streams, back in the order in which they were dealt."""
    own = {}
    for x in streams.values():
        if x.packets and len(x.packets[0]) == IDENTITY.size and x.packets[0].startswith(MARK[:5]):
            own[IDENTITY.unpack(x.packets[0])[3]] = x.packets[1:]
    out = [b""] * sum(map(len, own.values()))
    for s, packets in own.items():
        out[s :: len(own)] = packets
    return b"".join(out)


def feature(streams: dict[int, Stream], payload: bytes) -> str:
    """Streams, pages, packets, playing time from granules, and mean, deviation and zero crossings of the samples."""
    seconds = max((max((g for g in x.granules if g >= 0), default=0) for x in streams.values()), default=0) / SAMPLE_RATE
    samples = np.frombuffer(payload, np.uint8)
    if len(samples):
        mean, deviation = samples.mean(), samples.std()
        high = samples >= 128
        crossings = int((high[1:] != high[:-1]).sum())
    else:
        mean, deviation, crossings = 0.0, 0.0, 0
    return f"streams={len(streams)};pages={sum(x.pages for x in streams.values())};packets={sum(len(x.packets) for x in streams.values())};seconds={seconds:.6f};mean={mean:.4f};deviation={deviation:.4f};crossings={crossings}"


def write_media(rows: DataFrame, id_col: str = "doc_id", payload_col: str = "payload", streams: int = 2) -> DataFrame:
    """(id, media): every payload as an Ogg file."""

    def work(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "media": pa.array([write(x or b"", streams) for x in batch.column(1).to_pylist()], pa.binary())}

    return map_batches(rows.select(id_col, payload_col), work, f"{id_col} {id_type(rows, id_col)}, media binary", size_col=payload_col)


def read_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, media, payload, feature, packet_ms, errors) of Ogg files.

    ``packet_ms`` has, for each stream by serial number, the end of each page's packets in
    milliseconds, from the granule positions.
    """

    def work(batch: pa.RecordBatch) -> dict:
        payloads, features, times, errors = [], [], [], []
        for media in batch.column(1).to_pylist():
            streams, wrong = read(media or b"")
            ok = media is not None and not wrong
            payload = payload_of(streams) if ok else None
            payloads.append(payload)
            features.append(feature(streams, payload) if ok else None)
            times.append([sorted({g * 1000 // SAMPLE_RATE for g in streams[s].granules if g >= 0}) for s in sorted(streams)])
            errors.append(wrong if media is not None else ["no media"])
        return {
            id_col: batch.column(0), "media": batch.column(1), "payload": pa.array(payloads, pa.binary()), "feature": pa.array(features, pa.string()),
            "packet_ms": pa.array(times, pa.list_(pa.list_(pa.int64()))), "errors": pa.array(errors, pa.list_(pa.string())),
        }

    return map_batches(rows.select(id_col, media_col), work, f"{id_col} {id_type(rows, id_col)}, media binary, payload binary, feature string, packet_ms array<array<bigint>>, errors array<string>", size_col=media_col)
