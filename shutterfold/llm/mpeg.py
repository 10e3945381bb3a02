"""MPEG audio columns: frame streams that carry bytes, and a reader for any MPEG audio.

``store`` puts a payload losslessly into a standard MPEG-1 Layer III stream:
an ID3v2 tag with the exact sizes, a Xing frame (frame count, byte count,
seek table) and CRC-protected mono frames whose side information is zero, so
that the payload is ancillary data and players hear silence.  The last frame
takes the smallest bit rate that fits, which makes the stream a
variable-bitrate one.

``probe`` reads MPEG 1, 2 and 2.5, layers I to III: it skips and parses ID3v2
and ID3v1 tags, resynchronises on frame headers (a header counts when the next
one stands where it says), reads Xing/Info and VBRI tables, verifies Layer III
checksums, and returns exact sample counts, durations and frame seek offsets.

Null payloads are empty.  A payload is padded with zero bytes to a positive
multiple of 64.  Bytes without any frame give zero frames and an empty
payload.  Other columns pass through; an existing output name is replaced.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64

# Fixed values of the format: bit rates in kbit/s by index, sample rates in Hz by index.
RATES_V1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES_V2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)

INFO = (
    "struct<version:int,layer:int,sample_rate:int,channels:int,frames:int,samples:bigint,duration_us:bigint,"
    "crc_good:int,crc_bad:int,skipped_bytes:bigint,vbr_table:string,table_frames:bigint,table_bytes:bigint,"
    "tags:map<string,string>,offsets:array<bigint>,payload_size:bigint,n_bytes:bigint,payload:binary>"
)


@lru_cache(maxsize=4096)
def header(word: int) -> tuple[int, int, int, int, int, int, bool] | None:
    """(version 10|20|25, layer, sample rate, channels, frame bytes, samples, protected) of a 32-bit header."""
    if word >> 21 != 0x7FF:
        return None
    version = {3: 10, 2: 20, 0: 25}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate, speed, padding = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1
    if version is None or layer == 4 or rate in (0, 15) or speed == 3 or word & 3 == 2:
        return None
    hertz = SAMPLE_RATES[speed] // {10: 1, 20: 2, 25: 4}[version]
    bits = (RATES_V1 if version == 10 else RATES_V2)[layer][rate] * 1000
    if layer == 1:
        size, samples = (12 * bits // hertz + padding) * 4, 384
    elif layer == 3 and version != 10:
        size, samples = 72 * bits // hertz + padding, 576
    else:
        size, samples = 144 * bits // hertz + padding, 1152
    return version, layer, hertz, 1 if word >> 6 & 3 == 3 else 2, size, samples, not word >> 16 & 1


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def _side_bytes(version: int, channels: int) -> int:
    return (17 if channels == 1 else 32) if version == 10 else (9 if channels == 1 else 17)


def _prefix(rate_index: int, protected: bool) -> bytes:
    head = bytes([0xFF, 0xFA if protected else 0xFB, rate_index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return head + (struct.pack(">H", crc16(head[2:] + side)) if protected else b"") + side


_FRAMES = [(3 * rate - 23, _prefix(i, True)) for i, rate in enumerate(RATES_V1[3]) if rate]
_XING_RATE = 5  # 64 kbit/s: 192 bytes hold the whole table


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\0" + name.encode("latin-1") + b"\0" + value.encode("latin-1")
    return b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body


def store(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A complete MPEG stream that holds the payload, which is padded here."""
    n_bytes = len(payload) if n_bytes is None else n_bytes
    payload += bytes(-len(payload) % UNIT or (0 if payload else UNIT))
    most, full = _FRAMES[-1]
    at, parts = 0, []
    while len(payload) - at > most:
        parts.append(full + payload[at : at + most])
        at += most
    room, last = next(x for x in _FRAMES if x[0] >= len(payload) - at)
    parts.append(last + payload[at:] + bytes(room - len(payload) + at))
    sizes = [len(x) for x in parts]
    table = _prefix(_XING_RATE, False)
    total = 3 * RATES_V1[3][_XING_RATE] + sum(sizes)
    ends, run = [], 3 * RATES_V1[3][_XING_RATE]
    for size in sizes:
        ends.append(run)
        run += size
    toc = bytes(min(255, 256 * ends[i * len(parts) // 100] // total) for i in range(100))
    table += b"Xing" + struct.pack(">III", 7, len(parts), total) + toc
    table += bytes(3 * RATES_V1[3][_XING_RATE] - len(table))
    tags = _text_frame("PAYLOAD", str(len(payload))) + _text_frame("BYTES", str(n_bytes))
    return b"".join([b"ID3\x03\0\0" + _synchsafe(len(tags)) + tags, table, *parts])


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(size of the tag, its text frames); (0, {}) without one."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 0x80 for x in data[6:10]):
        return 0, {}
    size = 10 + sum(x << s for x, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    tags, at = {}, 10
    while data[3] in (3, 4) and at + 10 <= min(size, len(data)) and data[at : at + 4].isalnum():
        raw = data[at + 4 : at + 8]
        n = sum(x << s for x, s in zip(raw, (21, 14, 7, 0), strict=True)) if data[3] == 4 else int.from_bytes(raw)
        body = data[at + 10 : at + 10 + n]
        if data[at : at + 1] == b"T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            name, _, value = text.partition("\0") if data[at : at + 4] == b"TXXX" else (data[at : at + 4].decode(), "", text)
            tags[name] = value.rstrip("\0")
        at += 10 + n
    return size + (10 if data[5] & 0x10 else 0), tags


def probe(data: bytes) -> dict:
    """Everything that INFO names, from the bytes alone."""
    start, tags = _id3v2(data)
    stop = len(data)
    if data[-128:-125] == b"TAG" and stop - 128 >= start:
        stop -= 128
        tags |= {k: v for k, (a, b) in {"title": (3, 33), "artist": (33, 63), "album": (63, 93)}.items() if (v := data[stop + a : stop + b].split(b"\0")[0].decode("latin-1").strip())}
    found: list[tuple[int, tuple]] = []
    at, skipped, kind = start, 0, None
    word = lambda i: int.from_bytes(data[i : i + 4])
    while at + 4 <= stop:
        h = header(word(at)) if data[at] == 0xFF else None
        if h and at + h[4] <= stop and (kind is None or h[:4] == kind):
            after = at + h[4]
            h2 = header(word(after)) if after + 4 <= stop else None
            if kind is not None or after >= stop or (h2 and h2[:3] == h[:3]):
                kind = h[:4]
                found.append((at, h))
                at = after
                continue
        step = data.find(b"\xff", at + 1, stop)
        step = stop if step < 0 else step
        skipped += step - at
        at = step
    skipped += max(0, stop - at) if found and at < stop else 0
    out = dict.fromkeys(("version", "layer", "sample_rate", "channels"))
    out |= {"vbr_table": None, "table_frames": None, "table_bytes": None}
    if found:
        out["version"], out["layer"], out["sample_rate"], out["channels"] = kind
        at, h = found[0]
        side = _side_bytes(h[0], h[3])
        x, v = at + 4 + side, at + 36
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags = word(x + 4)
            out["vbr_table"] = data[x : x + 4].decode()
            out["table_frames"] = word(x + 8) if flags & 1 else None
            out["table_bytes"] = word(x + 8 + 4 * (flags & 1)) if flags & 2 else None
        elif data[v : v + 4] == b"VBRI":
            out |= {"vbr_table": "VBRI", "table_bytes": word(v + 10), "table_frames": word(v + 14)}
        if out["vbr_table"]:
            found = found[1:]
    good = bad = 0
    parts = []
    for at, h in found:
        side = _side_bytes(h[0], h[3])
        if h[6] and h[1] == 3:
            if crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) == int.from_bytes(data[at + 4 : at + 6]):
                good += 1
            else:
                bad += 1
        parts.append(data[at + 4 + 2 * h[6] + side : at + h[4]])
    samples = sum(h[5] for _, h in found)
    size = int(tags["PAYLOAD"]) if tags.get("PAYLOAD", "").isdigit() else None
    return out | {
        "frames": len(found), "samples": samples, "duration_us": samples * 1_000_000 // kind[2] if kind else 0,
        "crc_good": good, "crc_bad": bad, "skipped_bytes": skipped, "tags": list(tags.items()), "offsets": [x for x, _ in found],
        "payload_size": size, "n_bytes": int(tags["BYTES"]) if tags.get("BYTES", "").isdigit() else None,
        "payload": b"".join(parts)[:size] if size is not None else b"",
    }


def store_column(df: DataFrame, payload: str = "text", out: str = "media") -> DataFrame:
    """Adds ``out binary``: the stream that holds the column's bytes (strings as UTF-8)."""

    @F.arrow_udf("binary")
    def stored(values: pa.Array) -> pa.Array:
        return pa.array([store(x or b"") for x in values.cast(pa.binary()).to_pylist()], pa.binary())

    return df.withColumn(out, stored(F.col(payload)))


def probe_column(df: DataFrame, media: str = "media", out: str = "info") -> DataFrame:
    """Adds ``out``: what ``probe`` reads from the stored bytes."""
    fields = {
        "version": pa.int32(), "layer": pa.int32(), "sample_rate": pa.int32(), "channels": pa.int32(), "frames": pa.int32(), "samples": pa.int64(),
        "duration_us": pa.int64(), "crc_good": pa.int32(), "crc_bad": pa.int32(), "skipped_bytes": pa.int64(), "vbr_table": pa.string(),
        "table_frames": pa.int64(), "table_bytes": pa.int64(), "tags": pa.map_(pa.string(), pa.string()), "offsets": pa.list_(pa.int64()),
        "payload_size": pa.int64(), "n_bytes": pa.int64(), "payload": pa.binary(),
    }

    @F.arrow_udf(INFO)
    def probed(values: pa.Array) -> pa.Array:
        rows = [probe(x or b"") for x in values.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields.items()], list(fields))

    return df.withColumn(out, probed(F.col(media)))
