"""MPEG transport streams in a media column: written from payload bytes, and parsed with their tables and timestamps.

A stream has one program with one elementary stream of private data. Each elementary packet holds UNIT bytes and a
timestamp; every RAP_EVERY-th opens with a random-access point, a clock reference and, before it, the two tables. The
parser reads the program tables (with their checksums), checks the continuity counters of every PID, drops repeated
packets, puts the elementary packets together, and lists for each its timestamp, its place in the payload, and whether
it is a random-access point. Streams of other muxers may interleave PIDs and repeat tables as they like.

Defined results: a null text is an empty one, which is stored as one block of spaces; equal texts give equal streams;
repeated rows and null ids come out as they came; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PACKET = 188
BLOCK = 192
#: Payload bytes of an elementary packet, and its time in ticks of the 90 kHz clock.
UNIT = 50 * BLOCK
TICKS = 3600
RAP_EVERY = 8
PAT_PID, PMT_PID, MEDIA_PID = 0x0000, 0x0100, 0x0101
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06


@functools.lru_cache(4096)
def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0")


def _pts(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    out, tables, counter = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, ticks, rap = payload[at : at + UNIT], k * TICKS, k % RAP_EVERY == 0
        if rap:
            out += [_table_packet(PAT_PID, tables, _PAT), _table_packet(PMT_PID, tables, _PMT)]
            tables += 1
        # Adaptation fields: flags and clock reference on a random-access point, filling in the last packet.
        data = b"\0\0\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ticks) + unit
        field = b"\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big") if rap else None
        first = 184 - (8 if rap else 0)
        n = 1 + max(0, -(-(len(data) - first) // 184))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, MEDIA_PID >> 8, MEDIA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        bytes_ = np.frombuffer(data, np.uint8)
        if n > 2:
            packets[1:-1, 4:] = bytes_[first : first + 184 * (n - 2)].reshape(n - 2, 184)
        for j in {0, n - 1}:
            own = bytes_[0 if j == 0 else first + 184 * (j - 1) :][: first if j == 0 else 184]
            extra = field if j == 0 else None
            spare = 184 - len(own)
            if spare:
                fill = (extra or (b"\0" if spare > 1 else b"")).ljust(spare - 1, b"\xff")
                packets[j, 3] |= 0x20
                packets[j, 4:] = np.concatenate([np.frombuffer(bytes([spare - 1]) + fill, np.uint8), own])
            else:
                packets[j, 4:] = own
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(blob: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Checked sections of one PID's payloads that begin at unit starts."""
    data, found = blob.tobytes(), []
    for at in starts.tolist():
        at += 1 + data[at] if at < len(data) else 0
        size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)
        section = data[at : at + size]
        if len(section) == size and size > 12 and crc_mpeg(section[:-4]) == int.from_bytes(section[-4:], "big"):
            found.append(section)
    return found


def demux(stream: bytes) -> dict:
    """payload, units (pts, offset, length, random access) and counts of a transport stream's first program."""
    n = len(stream) // PACKET
    packets = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    ok = packets[:, 0] == 0x47
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    flags = packets[:, 3]
    adapted, carries = (flags & 0x20 > 0), (flags & 0x10 > 0) & ok
    begin = np.where(adapted, 5 + packets[:, 4].astype(np.int64), 4)
    access = adapted & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 > 0)
    counter = flags & 15
    errors = 0

    def of(p: int):
        nonlocal errors
        rows = np.flatnonzero((pid == p) & carries)
        step = np.diff(counter[rows].astype(np.int64)) & 15
        again = np.zeros(len(rows), bool)
        again[1:][step == 0] = (packets[rows[1:]] == packets[rows[:-1]]).all(1)[step == 0]
        errors += int(((step != 1) & ~again[1:]).sum())
        rows = rows[~again]
        sizes = np.maximum(PACKET - begin[rows], 0)
        blob = packets[rows][np.arange(PACKET) >= begin[rows, None]]
        at = np.cumsum(sizes) - sizes
        return rows, blob, at, packets[rows, 1] & 0x40 > 0

    _, blob, at, opens = of(PAT_PID)
    pmt = next((int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF for s in _sections(blob, at[opens]) for k in range(8, len(s) - 4, 4) if s[k : k + 2] != b"\0\0"), None)
    media, kind = None, None
    if pmt is not None:
        _, blob, at, opens = of(pmt)
        for s in _sections(blob, at[opens])[:1]:
            k = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            kind, media = s[k], int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF
    units, parts, offset = [], [], 0
    if media is not None:
        rows, blob, at, opens = of(media)
        ends = np.append(at[opens][1:], len(blob)).tolist()
        for row, a, b in zip(rows[opens].tolist(), at[opens].tolist(), ends):
            head = blob[a : a + 14].tobytes()
            if len(head) < 9 or head[:3] != b"\0\0\x01":
                continue
            pts = None
            if head[7] & 0x80:
                pts = (head[9] >> 1 & 7) << 30 | head[10] << 22 | head[11] >> 1 << 15 | head[12] << 7 | head[13] >> 1
            size = int.from_bytes(head[4:6], "big")
            body = blob[a + 9 + head[8] : min(b, a + 6 + size) if size else b]
            units.append({"pts": pts, "offset": offset, "length": len(body), "random_access": bool(access[row])})
            parts.append(body)
            offset += len(body)
    payload = np.concatenate(parts).tobytes() if parts else b""
    return {"payload": payload, "units": units, "packets": n, "errors": errors + int((~ok).sum()), "stream_type": kind}


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b" ")


def _written(texts: pa.Array) -> pa.Array:
    return pa.array([mux(padded(t)[1]) for t in texts.to_pylist()], pa.binary())


UNITS_DDL = "array<struct<pts:bigint,offset:bigint,length:bigint,random_access:boolean>>"
PARSED_DDL = f"struct<payload:binary,units:{UNITS_DDL},packets:bigint,errors:bigint,stream_type:int>"
_PARSED = pa.struct([
    ("payload", pa.binary()),
    ("units", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_())]))),
    ("packets", pa.int64()), ("errors", pa.int64()), ("stream_type", pa.int32()),
])


def _parsed(streams: pa.Array) -> pa.Array:
    return pa.array([None if s is None else demux(s) for s in streams.to_pylist()], _PARSED)


def write(text: Column | str) -> Column:
    """A transport stream of the text's padded bytes."""
    return F.arrow_udf(_written, "binary")(text)


def parse(stream: Column | str) -> Column:
    """payload, units, packets, errors and stream_type of a binary column of streams."""
    return F.arrow_udf(_parsed, PARSED_DDL)(stream)


def feature(parsed: dict) -> str:
    """What the parser learned, and the payload's histogram of the upper three bits."""
    units = parsed["units"]
    bins = np.bincount(np.frombuffer(parsed["payload"], np.uint8) >> 5, minlength=8).tolist()
    times = f"{units[0]['pts']}-{units[-1]['pts']}" if units else "-"
    raps = ".".join(str(u["offset"]) for u in units if u["random_access"])
    return f"packets={parsed['packets']};units={len(units)};errors={parsed['errors']};pts={times};access={raps};bits={'.'.join(map(str, bins))}"


_DIGEST = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"


def _digest(streams: pa.Array) -> pa.Array:
    out = []
    for stream in streams:
        stream = stream.as_py()
        parsed = demux(stream)
        p = parsed["payload"]
        out.append({
            "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:]),
            "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "feature": feature(parsed),
        })
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    return pa.array(out, pa.struct([*kinds, ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))


def op7_media(spark, sf_dir: str) -> DataFrame:
    """The media column is written as a table and read again; what is returned comes from the stored bytes."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), write("text").alias("media"))
    stored, _ = common.stored(docs, "media")
    return stored.select("doc_id", "n_bytes", F.arrow_udf(_digest, _DIGEST)("media").alias("d")).select("doc_id", "n_bytes", "d.*")
