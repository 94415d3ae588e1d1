"""Media columns: MPEG transport streams.

Payloads are muxed into 188-byte packets (program tables, elementary stream in PES packets with timestamps and
random-access points) and demuxed again: tables with their CRC, continuity counters, reassembly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, stored, table

PACKET, SYNC, UNIT = 188, 0x47, 576
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0, 0x1000, 0x101, 0x1FFF
#: Bytes of an access unit; access units between random-access points; 90 kHz ticks of an access unit.
UNIT_BYTES, GROUP, TICKS = UNIT * 32, 8, 3600
OUT_ROWS = 128


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    s = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0) + body
    s += struct.pack(">I", crc_mpeg(s))
    return b"\0" + s + b"\xff" * (PACKET - 5 - len(s))  # pointer field, section, stuffing


PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
PMT = _section(2, 1, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", 6, 0xE000 | ES_PID, 0xF000))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0xE) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def _pcr(t: int) -> bytes:
    return struct.pack(">IH", t >> 1 & 0xFFFFFFFF, (t & 1) << 15 | 0x7E00)


def mux(payload: bytes) -> bytes:
    """A transport stream of one private elementary stream; tables before every random-access point."""
    out, cc, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        part, pts, rap = payload[at : at + UNIT_BYTES], k * TICKS & 0x1FFFFFFFF, k % GROUP == 0
        if rap:
            for pid, body in ((PAT_PID, PAT), (PMT_PID, PMT)):
                out.append(struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | tables & 15) + body)
            tables += 1
        pes = b"\0\0\1\xbd" + struct.pack(">H", len(part) + 8) + b"\x84\x80\x05" + _stamp(2, pts) + part
        pos, first = 0, True
        while pos < len(pes):
            field = b"\x50" + _pcr(pts) if first and rap else b""
            room = PACKET - 4 - (1 + len(field) if field else 0)
            left = len(pes) - pos
            if left < room:  # stuffing
                pad = room - left
                if not field:
                    field, pad = (b"", 0) if pad == 1 else (b"\0", pad - 2)
                    head = bytes([len(field) + pad]) + field + b"\xff" * pad
                else:
                    head = bytes([len(field) + pad]) + field + b"\xff" * pad
                take = left
            else:
                head, take = (bytes([len(field)]) + field if field else b""), room
            out.append(struct.pack(">BHB", SYNC, (0x4000 if first else 0) | ES_PID, (0x30 if head else 0x10) | cc) + head + pes[pos : pos + take])
            pos, cc, first = pos + take, cc + 1 & 15, False
    return b"".join(out)


@dataclass
class Stream:
    """What a demuxer has of one elementary stream: payload, pts of each PES (None without), rap (indexes of the PES that
    are random-access points), rap_offsets (into the payload), lost (PES begun but not whole)."""

    kind: int
    payload: bytes = b""
    pts: list[int | None] = field(default_factory=list)
    rap: list[int] = field(default_factory=list)
    rap_offsets: list[int] = field(default_factory=list)
    lost: int = 0


# Stream ids whose PES have no header fields after the length.
_BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


class Demuxer:
    """Reads a transport stream packet by packet; each PID has its own counter, table sections and PES in the making."""

    def __init__(self) -> None:
        self.cc_errors = self.bad = self.tables = self.scrambled = 0
        self.streams: dict[int, Stream] = {}
        self._pmts: set[int] = set()
        self._last: dict[int, tuple[int, bytes]] = {}
        self._sections: dict[int, bytearray] = {}
        self._known: set[tuple[int, bytes]] = set()
        self._open: dict[int, tuple[bool, list[bytes]]] = {}
        self._parts: dict[int, list[bytes]] = {}
        self._size: dict[int, int] = {}

    def packet(self, p: bytes) -> None:
        b1, b3 = p[1], p[3]
        if b1 & 0x80:
            self.bad += 1
            return
        pid, start = (b1 & 0x1F) << 8 | p[2], 4
        if pid == NULL_PID or not b3 & 0x10:
            return
        rap = jump = False
        if b3 & 0x20:
            n = p[4]
            if n:
                rap, jump = bool(p[5] & 0x40), bool(p[5] & 0x80)
            start = 5 + n
            if start > PACKET:
                self.bad += 1
                return
        cc, before = b3 & 15, self._last.get(pid)
        self._last[pid] = cc, p
        if before is not None and not jump:
            if cc == before[0] and p == before[1]:
                return  # a repeated packet
            if cc != before[0] + 1 & 15:
                self.cc_errors += 1
                self._sections.pop(pid, None)
                if self._open.pop(pid, None):
                    self.streams[pid].lost += 1
        first = bool(b1 & 0x40)
        if pid in self.streams:
            if b3 & 0xC0:
                self.scrambled += 1
            elif first:
                self._end(pid)
                self._open[pid] = rap, [p[start:]]
            elif pid in self._open:
                self._open[pid][1].append(p[start:])
        elif pid == PAT_PID or pid in self._pmts:
            self._psi(pid, first, p[start:])

    def _psi(self, pid: int, first: bool, body: bytes) -> None:
        if first:
            if (pid, body) in self._known:  # a whole table again
                self.tables += 1
                return
            head = 1 + body[0] if body else 0
            if pid in self._sections:  # what is before the pointer ends the section before
                self._sections[pid] += body[1:head]
                self._take(pid)
            self._sections[pid] = bytearray(body[head:])
            if self._take(pid) and head == 1:
                self._known.add((pid, body))
        elif pid in self._sections:
            self._sections[pid] += body
            self._take(pid)

    def _take(self, pid: int) -> bool:
        """Read the whole sections held; whether nothing is left of them."""
        held = self._sections[pid]
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                return False
            s = bytes(held[:size])
            del held[:size]
            if size < 12 or crc_mpeg(s):
                self.bad += 1
            elif s[5] & 1:
                self.tables += 1
                self._read(pid, s)
        if not held or held[0] == 0xFF:
            del self._sections[pid]
            return True
        return False

    def _read(self, pid: int, s: bytes) -> None:
        body = s[8:-4]
        if pid == PAT_PID and s[0] == 0:
            self._pmts |= {(body[i + 2] & 0x1F) << 8 | body[i + 3] for i in range(0, len(body) - 3, 4) if body[i] | body[i + 1]}
        elif s[0] == 2 and len(body) >= 4:
            i = 4 + ((body[2] & 0x0F) << 8 | body[3])
            while i + 5 <= len(body):
                self.streams.setdefault((body[i + 1] & 0x1F) << 8 | body[i + 2], Stream(body[i]))
                i += 5 + ((body[i + 3] & 0x0F) << 8 | body[i + 4])

    def _end(self, pid: int) -> None:
        """The PES in the making of this PID is at its end."""
        if pid not in self._open:
            return
        rap, parts = self._open.pop(pid)
        pes, out = b"".join(parts), self.streams[pid]
        length = pes[4] << 8 | pes[5] if len(pes) >= 6 else 0
        if pes[:3] != b"\0\0\1" or len(pes) < 6 + length or (pes[3] not in _BARE and (len(pes) < 9 or len(pes) < 9 + pes[8])):
            out.lost += 1
            return
        end, t = 6 + length if length else len(pes), b""
        if pes[3] in _BARE:
            body = pes[6:end]
        else:
            body = pes[9 + pes[8] : end]
            t = pes[9:14] if pes[7] & 0x80 and pes[8] >= 5 else b""
        at = self._size.get(pid, 0)
        if rap:
            out.rap.append(len(out.pts))
            out.rap_offsets.append(at)
        out.pts.append((t[0] & 0xE) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1 if t else None)
        self._parts.setdefault(pid, []).append(body)
        self._size[pid] = at + len(body)

    def close(self) -> Demuxer:
        for pid in list(self._open):
            self._end(pid)
        for pid, parts in self._parts.items():
            self.streams[pid].payload = b"".join(parts)
        return self


def demux(ts: bytes) -> Demuxer:
    """All elementary streams that the program tables name (streams: by PID, in table order), with counts: cc_errors, bad
    (stretches without sync, packets with errors, sections with a wrong CRC, a truncated last packet), tables, scrambled.

    A PES that meets a continuity error or is cut off is dropped whole and counted as lost. Null packets, unknown PIDs and
    repeated packets are skipped. After a loss of sync reading goes on at the next two sync bytes a packet apart. An empty
    stream has no elementary streams."""
    out, at, n = Demuxer(), 0, len(ts)
    while at + PACKET <= n:
        if ts[at] == SYNC:
            out.packet(ts[at : at + PACKET])
            at += PACKET
            continue
        out.bad += 1
        at = ts.find(SYNC, at)
        while at >= 0 and at + PACKET < n and ts[at + PACKET] != SYNC:
            at = ts.find(SYNC, at + 1)
        if at < 0:
            break
    else:
        out.bad += at < n
    return out.close()


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _mux_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        for i in range(0, len(df), OUT_ROWS):
            part = df.iloc[i : i + OUT_ROWS]
            data = [b"" if x is None else bytes(x) for x in part["data"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(x) for x in data], "media": [mux(padded(x)) for x in data]})


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, rap_pts array<long>, rap_offsets array<long>"


def _demux_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for doc, n, media in zip(df["doc_id"], df["n_bytes"], df["media"], strict=True):
            media = b"" if media is None else bytes(media)
            m = demux(media)
            s = next(iter(m.streams.values()), Stream(0))
            p, known = s.payload, [t for t in s.pts if t is not None]
            raps = zlib.crc32(",".join(map(str, s.rap_offsets)).encode())
            times = f"{known[0]}-{known[-1]}" if known else "-"
            feature = f"streams={len(m.streams)};tables={m.tables};pes={len(s.pts)};pts={times};rap={len(s.rap)}@{raps:08x};cc_errors={m.cc_errors};bad={m.bad};lost={s.lost}"
            rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.pts, [s.pts[i] for i in s.rap], s.rap_offsets))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])
        yield out.astype({"doc_id": "Int64", "n_bytes": "Int64"})


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media), written as a Parquet table in the shared folder and read from there.

    The payload is the text as UTF-8 (null: empty) and bytes 255 up to a positive multiple of 576. Null ids stay null,
    repeated rows repeat, an empty table gives an empty one; other columns are not read.
    """
    frugal(docs.sparkSession)
    media = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")).mapInPandas(_mux_frames, "doc_id long, n_bytes long, media binary")
    return stored(media, "media", compression="zstd", **{"parquet.block.size": str(16 << 20)})


def media_features(media: DataFrame) -> DataFrame:
    """FEATURES of (doc_id, n_bytes, media): digests and a feature text of the first elementary stream, its timestamps (null
    where a PES has none), the timestamps and payload offsets of all its random-access points.

    Null and empty media have no stream: an empty payload and empty arrays. Damaged media give what can be read, and the
    feature says what was lost. Null ids stay null, repeated rows repeat, an empty table gives an empty one."""
    return media.select("doc_id", "n_bytes", "media").mapInPandas(_demux_frames, FEATURES)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents")))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, octet_length(b)::BIGINT AS n, b FROM b),
p AS (SELECT doc_id, n, greatest(1, ceil(n / 576.0))::BIGINT * 576 AS m, b FROM s)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || unhex(repeat('FF', (m - n)::INT))) AS payload_sha256 FROM p
"""
