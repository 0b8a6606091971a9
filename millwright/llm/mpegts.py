"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a binary column as transport streams: program association and
map tables, then elementary packets of private data with presentation
timestamps, cut into 188-byte packets with continuity counters. Units at which
a reader may start carry the random-access flag and a clock reference.
``demux`` is an independent reader: it parses the tables and checks their
checksums, follows the continuity counters, reassembles the elementary packets
of the program's streams and returns the payload with one entry per unit.

A null payload counts as empty; a null, empty or damaged stream gives what
could be read and a list of faults, never an exception. Repeated rows get equal
streams. Empty tables give empty results. The columns asked for are carried
along, others are not read, so their names cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import common

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0101
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
#: Payload bytes in one unit, units between random-access points, 90 kHz ticks between units.
UNIT_BYTES, RANDOM_EVERY, TICKS = 8192, 8, 3600
_WRAP = 1 << 33


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(pid: int, table_id: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, extension, 0xC1, 0, 0)
    section = head + body
    section += struct.pack(">I", crc32_mpeg(section))
    packet = struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = _section(PAT_PID, 0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)) + _section(
    PMT_PID, 0x02, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000)
)


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | pts >> 29 & 0x0E, pts >> 14 & 0xFFFE | 1, pts << 1 & 0xFFFE | 1)


def mux_bytes(payload: bytes) -> bytes:
    """One program with one private stream that carries the payload; the last unit may be short or empty."""
    out, counter = [TABLES], 0
    plain = [struct.pack(">BHB", 0x47, DATA_PID, 0x10 | c) for c in range(16)]
    for n, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        pts = n * TICKS % _WRAP
        data = payload[at : at + UNIT_BYTES]
        unit = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data
        random = n % RANDOM_EVERY == 0
        clock = struct.pack(">BIH", 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00) if random else b""
        begin = 0
        while begin < len(unit):
            if begin and len(unit) - begin >= BODY:
                out += plain[counter], unit[begin : begin + BODY]
                begin += BODY
            else:
                # the adaptation field holds the clock and fills up the packet
                field = clock if not begin else b""
                fill = BODY - (1 + len(field) if field else 0) - (len(unit) - begin)
                if fill > 0:
                    field = struct.pack("B", fill - 1 + len(field) + (1 if field else 0)) + (field or b"\0"[: fill - 1]) + b"\xff" * (fill if field else fill - 2)
                elif field:
                    field = struct.pack("B", len(field)) + field
                head = struct.pack(">BHB", 0x47, (0 if begin else 0x4000) | DATA_PID, (0x30 if field else 0x10) | counter) + field
                body = unit[begin : begin + PACKET - len(head)]
                out += head, body
                begin += len(body)
            counter = counter + 1 & 15
    return b"".join(out)


def demux_bytes(media: bytes) -> dict:
    """Payload, units (pts, offset, bytes, random_access), packets by kind and faults of a transport stream."""
    faults: list[str] = []
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    last: dict[int, int] = {}
    doubled: set[int] = set()
    open_units: dict[int, list] = {}
    units, payload, offset, packets, clocks = [], [], 0, 0, 0

    def close(pid: int) -> None:
        nonlocal offset
        begun = open_units.pop(pid, None)
        if begun is None:
            return
        random, data = begun[0], b"".join(begun[1])
        if len(data) < 9 or data[:3] != b"\0\0\1":
            faults.append("broken elementary packet")
            return
        length, flags, header = int.from_bytes(data[4:6], "big"), data[7], data[8]
        end = 6 + length if length else len(data)
        if end > len(data):
            faults.append("short elementary packet")
        pts = None
        if flags & 0x80 and len(data) >= 14:
            a, b, c, d, e = data[9:14]
            pts = (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1
        body = data[9 + header : end]
        units.append({"pts": pts, "offset": offset, "bytes": len(body), "random_access": random})
        payload.append(body)
        offset += len(body)

    if len(media) % PACKET:
        faults.append("length is no multiple of 188")
    for at in range(0, len(media) - PACKET + 1, PACKET):
        packets += 1
        if media[at] != 0x47:
            faults.append("lost sync")
            continue
        second, flags = media[at + 1], media[at + 3]
        pid, begin, random = (second & 0x1F) << 8 | media[at + 2], at + 4, False
        if flags & 0x20:
            size = media[begin]
            if size:
                random = bool(media[begin + 1] & 0x40)
                clocks += media[begin + 1] >> 4 & 1
            begin += 1 + size
        if not flags & 0x10:
            continue
        if begin > at + PACKET:
            faults.append("broken adaptation field")
            continue
        if pid in last and flags & 15 != last[pid] + 1 & 15:
            if flags & 15 == last[pid] and pid not in doubled:
                doubled.add(pid)  # the standard allows one duplicate
                continue
            faults.append("continuity")
        doubled.discard(pid)
        last[pid] = flags & 15
        body = media[begin : at + PACKET]
        if pid in streams:
            if second & 0x40:
                close(pid)
                open_units[pid] = [random, [body]]
            elif pid in open_units:
                open_units[pid][1].append(body)
            else:
                faults.append("packet before a unit's start")
        elif (pid == PAT_PID or pid in programs) and second & 0x40 and body:
            section = body[1 + body[0] :]
            size = 3 + (int.from_bytes(section[1:3], "big") & 0x0FFF)
            if size > len(section) or size < 12 or crc32_mpeg(section[:size]):
                faults.append("table checksum")
                continue
            if pid == PAT_PID:
                for i in range(8, size - 4, 4):
                    number, to = struct.unpack(">HH", section[i : i + 4])
                    if number:
                        programs[to & 0x1FFF] = number
            else:
                i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                while i < size - 4:
                    streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)
    for pid in list(open_units):
        close(pid)
    return {"payload": b"".join(payload), "units": units, "packets": packets, "clocks": clocks, "programs": len(programs), "streams": len(streams), "faults": faults}


def mux(df: DataFrame, payload_col: str, *, keep: list[str], media_col: str = "media") -> DataFrame:
    """The ``keep`` columns and the payload as a transport stream."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + f", `{media_col}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            media = [mux_bytes(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(media, pa.binary())], [*keep, media_col])

    return df.select(*keep, F.col(payload_col).alias("_ts_payload")).mapInArrow(run, schema)


_READ = pa.struct(
    [
        ("payload", pa.binary()),
        ("units", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_())]))),
        *((x, pa.int64()) for x in ("packets", "clocks", "programs", "streams")),
        ("faults", pa.list_(pa.string())),
    ]
)


def demux(df: DataFrame, media_col: str = "media", *, keep: list[str], to: str = "read") -> DataFrame:
    """The ``keep`` columns, with what the stream holds as a struct."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    schema += f", `{to}` struct<payload: binary, units: array<struct<pts: bigint, offset: bigint, bytes: bigint, random_access: boolean>>, packets: bigint, clocks: bigint, programs: bigint, streams: bigint, faults: array<string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            read = [demux_bytes(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(read, _READ)], [*keep, to])

    return df.select(*keep, F.col(media_col).alias("_ts_media")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), F.expr(f"rpad(cast(coalesce(text, '') as binary), greatest(64, cast(ceil(octet_length(coalesce(text, '')) / 64.0D) * 64 as int)), X'00')").alias("payload"))
    stored = mux(docs, "payload", keep=["doc_id", "n_bytes"])
    stored = stored.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    back = demux(stored, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    units = "read.units"
    feature = F.concat_ws(
        ";",
        *(
            F.concat(F.lit(f"{name}="), x.cast("string"))
            for name, x in [
                ("packets", F.col("read.packets")),
                ("programs", F.col("read.programs")),
                ("streams", F.col("read.streams")),
                ("clocks", F.col("read.clocks")),
                ("units", F.size(units)),
                ("random", F.size(F.filter(units, lambda u: u["random_access"]))),
                ("first", F.col(units)[0]["pts"]),
                ("last", F.element_at(units, -1)["pts"]),
                ("longest", F.array_max(F.transform(units, lambda u: u["bytes"]))),
                ("faults", F.size("read.faults")),
            ]
        ),
    )
    payload = F.col("read.payload")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
