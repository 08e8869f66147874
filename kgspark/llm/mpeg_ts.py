"""Media columns: MPEG transport streams.

``mux`` stores a byte string as the one elementary stream of a program: access
units of at most ``UNIT`` bytes, each in a PES packet with a presentation time
stamp, each preceded by the program tables and marked as a random-access point.
``demux`` reads any stream of one program back: it parses PAT and PMT over any
number of packets (with their CRCs), checks the continuity counters of every PID
(a packet may be repeated once, and a break may be announced by the
discontinuity indicator), reassembles the PES packets and returns their time
stamps and random-access points.

Defined results for damaged input: packets without the sync byte, a bad CRC, a
missing or cut table or a truncated PES packet give a ``Stream`` whose ``errors`` names
them; the bytes that could be reassembled are kept. Null media is an empty
stream with the error ``empty``. Nothing raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import record_batches, text_or_empty

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC = 188, 0x47
PAT_PID, PAT_TABLE, PMT_TABLE = 0x0000, 0x00, 0x02
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK_HZ = 90_000

# Choices of this writer.
PROGRAM, PMT_PID, DATA_PID = 1, 0x1000, 0x0100
UNIT = 32 * 1024
UNIT_TICKS = CLOCK_HZ // 25
ALIGN = 64


@lru_cache(maxsize=256)
def crc32_mpeg(section: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 04C11DB7, most significant bit first, no final xor."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, bytes]:
    """The PAT and PMT packets, with continuity counter 0."""
    pat = _section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return tuple((bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff") for pid, section in ((PAT_PID, pat), (PMT_PID, pmt)))


def _pts(ticks: int, mark: int = 0x2) -> bytes:
    return bytes([mark << 4 | (ticks >> 29 & 0xE) | 1, ticks >> 22 & 0xFF, (ticks >> 14 & 0xFE) | 1, ticks >> 7 & 0xFF, (ticks << 1 & 0xFE) | 1])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream that holds ``payload``; an empty one has no access unit."""
    pat, pmt = _tables()
    out, cc = [], 0
    for number, at in enumerate(range(0, len(payload), unit)):
        data, ticks = payload[at : at + unit], number * UNIT_TICKS
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ticks) + data
        # The first packet has the clock reference and the random-access mark: 8 bytes of adaptation field.
        clock = (ticks << 15 | 0x7E << 8).to_bytes(6, "big")
        first = b"\x50" + clock
        for table in (pat, pmt):
            out.append(table[:3] + bytes([0x10 | number & 15]) + table[4:])
        room = PACKET - 5 - len(first)
        head, rest = pes[:room], pes[room:]
        field_ = first + b"\xff" * (room - len(head))
        out.append(bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | cc, len(field_)]) + field_ + head)
        cc = cc + 1 & 15
        whole, tail = divmod(len(rest), PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            packets[:, 3] = 0x10 | (cc + np.arange(whole)) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            out.append(packets.tobytes())
            cc = (cc + whole) & 15
        if tail:
            size = PACKET - 5 - tail  # of the adaptation field that fills the packet
            stuffing = b"\x00" + b"\xff" * (size - 1) if size else b""
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | cc, size]) + stuffing + rest[len(rest) - tail :])
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What ``demux`` finds. A row of ``units`` is (pts, offset, size, packet, random access)."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    units: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    continuity_errors: int = 0
    errors: list[str] = field(default_factory=list)

    def feature(self) -> str:
        """Digest of structure and time line, equal for equal streams."""
        times = ",".join(f"{pts}@{packet}{'r' * rap}" for pts, _, _, packet, rap in self.units)
        line = times if len(self.units) <= 4 else hashlib.sha256(times.encode()).hexdigest()[:16]
        return f"packets={self.packets};programs={len(self.programs)};streams={len(self.streams)};units={len(self.units)};random={sum(u[4] for u in self.units)};continuity={self.continuity_errors};errors={'|'.join(self.errors) or '-'};times={line}"


def _payload_starts(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload starts; 188 where it has none."""
    control = packets[:, 3] >> 4 & 3
    start = np.full(len(packets), 4, np.int64)
    adapted = control >= 2
    start[adapted] = np.minimum(PACKET, 5 + packets[adapted, 4].astype(np.int64))
    start[(control & 1) == 0] = PACKET
    return start


def _sections(payloads: list[tuple[bool, bytes]]) -> tuple[list[bytes], bool]:
    """The sections in the payloads of one PID, in order, and whether one was cut off.

    A payload is (starts a section, bytes); a section may go on over any number
    of packets, and a packet may hold the end of one and the begin of others.
    """
    found, cut, held = [], False, None

    def drain(buffer: bytes) -> bytes | None:
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + (int.from_bytes(buffer[1:3], "big") & 0xFFF)
            if len(buffer) < size:
                return buffer
            found.append(buffer[:size])
            buffer = buffer[size:]
        return None if not buffer or buffer[0] == 0xFF else buffer

    for begins, raw in payloads:
        if not begins:
            held = drain(held + raw) if held is not None else None
            continue
        pointer = raw[0] if raw else 0
        if held is not None:
            held = drain(held + raw[1 : 1 + pointer])
            cut |= held is not None
        held = drain(raw[1 + pointer :])
    return found, cut or held is not None


def _duplicates(packets: np.ndarray, starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Which of the counted packets of one PID repeat the one before, as a packet may be sent twice and no more."""
    out = np.zeros(len(counted), bool)
    same = np.flatnonzero((packets[counted[1:], 3] & 15) == (packets[counted[:-1], 3] & 15)) + 1
    for k in same:
        one, two = packets[counted[k - 1]], packets[counted[k]]
        a, b = starts[counted[k - 1]], starts[counted[k]]
        out[k] = not out[k - 1] and one[1] == two[1] and np.array_equal(one[a:], two[b:])
    return out


def demux(media: bytes | None) -> Stream:
    out = Stream()
    if not media:
        out.errors.append("empty")
        return out
    if len(media) % PACKET:
        out.errors.append("ragged")
    packets = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    out.packets = len(packets)
    synced = packets[:, 0] == SYNC
    if not synced.all():
        out.errors.append("sync")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pid[~synced] = -1
    begins = (packets[:, 1] & 0x40) != 0
    starts = _payload_starts(packets)

    # Continuity: counters of packets with payload go up by one, but for one repetition and announced breaks.
    broken = ((packets[:, 3] & 0x20) != 0) & (packets[:, 4] > 0) & ((packets[:, 5] & 0x80) != 0)
    kept: dict[int, np.ndarray] = {}
    for one in sorted({int(x) for x in np.unique(pid)} - {-1, 0x1FFF}):
        rows = np.flatnonzero(pid == one)
        counted = rows[(packets[rows, 3] & 0x10) != 0]
        repeated = _duplicates(packets, starts, counted)
        counted = counted[~repeated]
        counter = (packets[counted, 3] & 15).astype(np.int32)
        breaks = np.cumsum(broken[rows])[np.searchsorted(rows, counted)]
        jump = (counter[1:] - counter[:-1] - 1 & 15) != 0
        out.continuity_errors += int((jump & (breaks[1:] == breaks[:-1])).sum())
        kept[one] = counted

    def tables(at_pid: int, name: str) -> list[bytes]:
        raw = [(bool(begins[k]), packets[k, starts[k] :].tobytes()) for k in kept.get(at_pid, ())]
        sections, cut = _sections(raw)
        if cut:
            out.errors.append(f"{name}-short")
        found = []
        for section in dict.fromkeys(sections):
            if len(section) < 12 or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
                out.errors.append(f"{name}-crc")
            else:
                found.append(section[:-4])
        return found

    for section in tables(PAT_PID, "pat"):
        for k in range(8, len(section) - 3, 4):
            if number := int.from_bytes(section[k : k + 2], "big"):
                out.programs[number] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
    for pmt_pid in sorted(set(out.programs.values())):
        for section in tables(pmt_pid, "pmt"):
            k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while k + 5 <= len(section):
                out.streams[int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)
    if not out.streams:
        out.errors.append("no-stream")
    parts, offset = [], 0
    for one in sorted(out.streams):
        rows = kept.get(one, np.zeros(0, np.int64))
        if not len(rows):
            continue
        own, own_starts = packets[rows], starts[rows]
        raw = own[np.arange(PACKET) >= own_starts[:, None]].tobytes()
        edges = np.concatenate([[0], np.cumsum(PACKET - own_starts)])
        heads = np.flatnonzero(begins[rows])
        for head, after in zip(heads, [*heads[1:], len(rows)], strict=True):
            pes = raw[edges[head] : edges[after]]
            if len(pes) < 14 or pes[:3] != b"\x00\x00\x01":
                out.errors.append("pes-start")
                continue
            size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            data = pes[skip : 6 + size] if size else pes[skip:]
            if size and len(pes) < 6 + size:
                out.errors.append("pes-short")
            pts = -1
            if pes[7] & 0x80:
                pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
            random = bool(own[head, 3] & 0x20 and own[head, 4] and own[head, 5] & 0x40)
            out.units.append((pts, offset, len(data), int(rows[head]), random))
            parts.append(data)
            offset += len(data)
    out.payload = b"".join(parts)
    return out


def padded(data: bytes, align: int = ALIGN) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``align``."""
    return data.ljust(max(align, -(-len(data) // align) * align), b"\x00")


MEDIA_SCHEMA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def encode_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``media``: the padded UTF-8 text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], names=[*keep, "n_bytes", "media"])

    picked = docs.select(*keep, text_or_empty(text).alias("text_"))
    return picked.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, *MEDIA_SCHEMA.fields]))


UNIT_SCHEMA = "unit int, pts long, offset long, size long, packet long, random_access boolean"


def unit_index(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """A row for each access unit: time stamp, place in the payload, first packet, random access."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            rows, at = [], []
            for k, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for number, unit in enumerate(demux(raw).units):
                    rows.append((number, *unit))
                    at.append(k)
            taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(batch.num_columns - 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*keep, "unit", "pts", "offset", "size", "packet", "random_access"])

    schema = T.StructType([*media.select(*keep).schema.fields, *T._parse_datatype_string(UNIT_SCHEMA).fields])
    return media.select(*keep, F.col(column)).mapInArrow(run, schema)


DIGEST_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each text stored as a stream, read back and digested in one pass.

    A null text counts as empty. A stream that does not give back its payload is
    an error of the operator, so it raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = mux(padded(raw))
                back = demux(media)
                if back.payload[: len(raw)] != raw or back.errors or back.continuity_errors:
                    raise ValueError(f"a stream was not read back whole: {back.feature()}")
                rows.append((len(raw), len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), back.feature()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", *(c.split()[0] for c in DIGEST_SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, {DIGEST_SCHEMA}")
