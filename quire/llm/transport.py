"""Media columns as MPEG transport streams: multiplexing and reading back.

A payload of bytes (8-bit samples) is cut into access units of ACCESS_UNIT bytes.
Each becomes one elementary-stream packet with a time stamp, preceded by the
program tables and marked as a random-access point with a clock reference, so
decoding can begin at any of them. Reading parses the program association and
program map tables (with their CRC), checks the continuity counter of each
packet identifier, reassembles the elementary packets and returns the payload
with the time stamps and random-access points. Features are computed from the
samples that were read back: energy and crossings about the middle, and their
spread over LEVELS equal ranges.

Defined cases: a null text counts as empty and an empty text is one unit of
fill bytes; a null media value gives a null payload and empty lists; bytes that
aren't in sync, damaged tables, lost and repeated packets are counted and
don't stop the reading; rows are independent, so ties, repeats and null keys
need no care; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, batch_of

# Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, NULL_PID = 0x0000, 0x0100, 0x0101, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
CRC_POLY = 0x04C11DB7
CLOCK = 90_000

#: Samples in a second, and in a frame; texts are filled up to whole frames.
RATE, FRAME = 8_000, 576
#: Bytes of payload in an elementary packet at most: 16 frames.
ACCESS_UNIT = 16 * FRAME
#: Ranges of the histogram of samples; the middle of their 256 values.
LEVELS, MIDDLE = 8, 128
#: Samples that are looked at at once.
AT_ONCE = 1 << 20


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ CRC_POLY if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


def section_crc(data: bytes) -> int:
    """The CRC of program tables; 0 over a section that ends with its own CRC."""
    t, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2) + number.to_bytes(2) + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4)


@functools.cache
def _tables() -> np.ndarray:
    """The two packets with the program tables, continuity counters left at 0."""
    out = np.full((2, PACKET), 0xFF, np.uint8)
    association = _section(0, 1, (1).to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))
    program = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2) + (0xF000).to_bytes(2) + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2) + (0xF000).to_bytes(2))
    for row, pid, section in ((0, PAT_PID, association), (1, PMT_PID, program)):
        head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
        out[row, : len(head)] = np.frombuffer(head, np.uint8)
    return out


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 29 & 0xE) | 1, t >> 22 & 255, (t >> 14 & 0xFE) | 1, t >> 7 & 255, (t << 1 & 0xFE) | 1])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream of one program with one stream."""
    parts, counter = [], 0
    for unit, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        part = payload[at : at + ACCESS_UNIT]
        time = at * CLOCK // RATE & 0x1FFFFFFFF
        data = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(part) + 8).to_bytes(2) + b"\x84\x80\x05" + _stamp(2, time) + part, np.uint8)
        n = len(data)
        first = min(n, PACKET - 12)  # beside the header and the adaptation field with the clock
        k = 1 + -(-(n - first) // 184)
        out = np.full((2 + k, PACKET), 0xFF, np.uint8)
        out[:2] = _tables()
        out[:2, 3] |= unit & 15
        own = out[2:]
        own[:, 0], own[:, 1], own[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        own[:, 3] = 0x10 | ((counter + np.arange(k)) & 15)
        counter += k
        own[0, 1] |= 0x40
        own[0, 3] |= 0x20
        own[0, 4], own[0, 5] = 183 - first, 0x50
        own[0, 6:12] = np.frombuffer((time << 15 | 0x7E00).to_bytes(6), np.uint8)
        own[0, PACKET - first :] = data[:first]
        if k > 1:
            last = n - first - 184 * (k - 2)
            own[1 : k - 1, 4:] = data[first : first + 184 * (k - 2)].reshape(k - 2, 184)
            own[k - 1, PACKET - last :] = data[n - last :]
            if last < 184:
                own[k - 1, 3] |= 0x20
                own[k - 1, 4] = 183 - last
                if last < 183:
                    own[k - 1, 5] = 0
        parts.append(out.tobytes())
    return b"".join(parts)


def _aligned(media: bytes) -> tuple[np.ndarray, int]:
    """Packets in sync, and how many bytes were skipped to find them."""
    a = np.frombuffer(media, np.uint8)
    if len(a) % PACKET == 0 and (a[::PACKET] == SYNC).all():
        return a.reshape(-1, PACKET), 0
    rows, at = [], 0
    while at + PACKET <= len(a):
        if a[at] == SYNC and (at + PACKET == len(a) or a[at + PACKET] == SYNC):
            rows.append(a[at : at + PACKET])
            at += PACKET
        else:
            at += 1
    return np.stack(rows) if rows else np.empty((0, PACKET), np.uint8), len(a) - PACKET * len(rows)


def _sections(rows: np.ndarray, start: np.ndarray) -> Iterator[bytes]:
    """Sections that a packet identifier carries, those with a wrong CRC left out; equal packets once."""
    seen, open_ = set(), b""
    for row, at in zip(rows, start, strict=True):
        body = row[at:].tobytes()
        if row[1] & 0x40:
            pointer = body[0] if body else 0
            open_ = body[1 + pointer :]
        elif open_:
            open_ += body
        while len(open_) >= 3 and open_[0] != 0xFF:
            n = 3 + (int.from_bytes(open_[1:3]) & 0xFFF)
            if len(open_) < n:
                break
            section, open_ = open_[:n], open_[n:]
            if section not in seen and n >= 12 and section_crc(section) == 0:
                yield section
            seen.add(section)


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes | None) -> dict[str, Any]:
    """What a transport stream holds.

    programs: (program, table_pid, pid, stream_type); packets, skipped (bytes out
    of sync), lost (breaks of a continuity counter), repeated (packets sent
    twice); units: (pid, offset in the payload, size, pts, dts, random_access);
    payload: the units in their order of arrival.
    """
    out: dict[str, Any] = {"programs": [], "packets": 0, "skipped": 0, "lost": 0, "repeated": 0, "units": [], "payload": None}
    if media is None:
        return out
    a, out["skipped"] = _aligned(media)
    out["packets"] = len(a)
    pids = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    control = a[:, 3] >> 4 & 3
    field = np.where(control & 2, a[:, 4].astype(np.int32) + 1, 0)
    start = np.where((control & 1) & (field <= 183) & (a[:, 1] & 0x80 == 0), 4 + field, PACKET)  # nothing from damaged packets

    def rows_of(pid: int) -> np.ndarray:
        """Packets with payload of a stream, without repeats; counts breaks of its continuity."""
        rows = np.flatnonzero((pids == pid) & (control & 1 == 1))
        if len(rows) > 1:
            counter = a[rows, 3] & 15
            step = (counter[1:] - counter[:-1]) & 15
            again = np.flatnonzero(step == 0)
            same = again[(a[rows[again + 1]] == a[rows[again]]).all(axis=1)] + 1
            jump = (field[rows[1:]] > 1) & (a[rows[1:], 5] & 0x80 != 0)  # a break that is announced
            out["lost"] += int(((step != 1) & ~jump).sum()) - len(same)
            out["repeated"] += len(same)
            rows = np.delete(rows, same)
        return rows

    tables = rows_of(PAT_PID)
    streams: list[int] = []
    for s in _sections(a[tables], start[tables]):
        for i in range(8, len(s) - 4, 4):
            program, pmt = int.from_bytes(s[i : i + 2]), int.from_bytes(s[i + 2 : i + 4]) & 0x1FFF
            if s[0] or not program:
                continue
            maps = rows_of(pmt)
            for m in _sections(a[maps], start[maps]):
                j = 12 + (int.from_bytes(m[10:12]) & 0xFFF)
                while m[0] == 2 and j + 5 <= len(m) - 4:
                    pid = int.from_bytes(m[j + 1 : j + 3]) & 0x1FFF
                    out["programs"].append((program, pmt, pid, m[j]))
                    streams += [pid] * (pid not in streams)
                    j += 5 + (int.from_bytes(m[j + 3 : j + 5]) & 0xFFF)
    found = []
    for pid in streams:
        rows = rows_of(pid)
        data = a[rows][np.arange(PACKET) >= start[rows, None]].tobytes()
        size = PACKET - start[rows]
        before = np.cumsum(size) - size
        begins = np.flatnonzero(a[rows, 1] & 0x40)
        ends = [*before[begins[1:]].tolist(), len(data)] if len(begins) else []
        for row, at, end in zip(rows[begins].tolist(), before[begins].tolist(), ends, strict=True):
            if data[at : at + 3] != b"\x00\x00\x01" or end - at < 9:
                continue
            said = int.from_bytes(data[at + 4 : at + 6])
            body, stamps = at + 9 + data[at + 8], data[at + 7] >> 6
            stop = min(end, at + 6 + said) if said else end
            pts = _time(data[at + 9 : at + 14]) if stamps & 2 else None
            dts = _time(data[at + 14 : at + 19]) if stamps == 3 else pts
            found.append((row, pid, data[body:stop], pts, dts, bool(field[row] > 1 and a[row, 5] & 0x40)))
    found.sort(key=lambda x: x[0])
    at = 0
    for _, pid, body, pts, dts, point in found:
        out["units"].append((pid, at, len(body), pts, dts, point))
        at += len(body)
    out["payload"] = b"".join(x[2] for x in found)
    return out


def measured(payload: bytes | None) -> dict[str, Any] | None:
    """energy: the sum of squared distances of the samples from MIDDLE; crossings: neighbours on different sides of it; levels: samples in each range."""
    if payload is None:
        return None
    energy = crossings = 0
    levels = np.zeros(LEVELS, np.int64)
    whole = np.frombuffer(payload, np.uint8)
    for at in range(0, len(whole), AT_ONCE):
        x = whole[at : at + AT_ONCE + 1]  # with the first sample of what follows
        crossings += int(np.count_nonzero((x[1:] >= MIDDLE) != (x[:-1] >= MIDDLE)))
        x = x[:AT_ONCE]
        levels += np.bincount(x >> 5, minlength=LEVELS)
        d = x.astype(np.int64) - MIDDLE
        energy += int(d @ d)
    return {"energy": energy, "crossings": crossings, "levels": levels.tolist()}


def store_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_bytes, media) for each row: the text's UTF-8 bytes, filled up with 255 to whole frames, as a transport stream."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media = [mux(x + b"\xff" * (-len(x) % FRAME if x else FRAME)) for x in raw]
            yield batch_of({"key": b.column(0), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array(media, pa.binary())})

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, store, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes bigint, media binary").withColumnRenamed("key", key)


READ = "programs array<struct<program:int,table_pid:int,pid:int,stream_type:int>>, packets bigint, skipped bigint, lost bigint, repeated bigint, units array<struct<pid:int,offset:bigint,size:bigint,pts:bigint,dts:bigint,random_access:boolean>>, samples struct<energy:bigint,crossings:bigint,levels:array<bigint>>, payload binary"
_PROGRAM = pa.list_(pa.struct([("program", pa.int32()), ("table_pid", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32())]))
_SAMPLES = pa.struct([("energy", pa.int64()), ("crossings", pa.int64()), ("levels", pa.list_(pa.int64()))])
_UNIT = pa.list_(pa.struct([("pid", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_())]))


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns in keep, the media column, and the fields of demux for each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [demux(x) for x in b.column("media").to_pylist()]
            named = lambda kind, names: pa.array([[dict(zip(names, x, strict=True)) for x in g[kind]] for g in got], _PROGRAM if kind == "programs" else _UNIT)
            yield batch_of(
                dict(zip(b.schema.names, b.columns, strict=True))
                | {"programs": named("programs", ("program", "table_pid", "pid", "stream_type"))}
                | {k: pa.array([g[k] for g in got], pa.int64()) for k in ("packets", "skipped", "lost", "repeated")}
                | {"units": named("units", ("pid", "offset", "size", "pts", "dts", "random_access")), "samples": pa.array([measured(g["payload"]) for g in got], _SAMPLES), "payload": pa.array([g["payload"] for g in got], pa.binary())}
            )

    rows = df.select(*keep, F.col(media).alias("media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return arrow_map(rows, read, f"{schema}, {READ}")


def feature() -> Column:
    """A line on what was read: packets, units, errors, last time stamp, random-access points, stream type, and of the samples their mean energy, crossings and levels."""
    last = F.element_at("units", -1)
    points = F.size(F.filter("units", lambda u: u["random_access"]))
    mean = F.floor(F.try_divide(F.col("samples.energy"), F.octet_length("payload"))).cast("string")
    said = {"packets": F.col("packets"), "units": F.size("units"), "lost": F.col("lost") + F.col("skipped"), "pts": last["pts"], "points": points, "type": F.element_at("programs", 1)["stream_type"], "energy": mean, "crossings": F.col("samples.crossings"), "levels": F.array_join(F.transform("samples.levels", lambda n: n.cast("string")), ",")}
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v) for k, v in said.items()])
