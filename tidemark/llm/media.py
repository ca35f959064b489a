"""Media columns: MPEG transport streams.

`mux` carries a payload in an ISO/IEC 13818-1 transport stream: a program association table, a program map table and one
private elementary stream whose packets (PES) hold 8-bit samples, a presentation timestamp and, in the adaptation field
of their first transport packet, a clock reference and the random-access flag.  `demux` parses the program tables with
their checksums, checks continuity counters, reassembles the elementary packets, and keeps timestamps and random-access
points.  Both work on whole values; memory is a few times one value.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, fresh, table, text_bytes

# Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE_DATA, PRIVATE_STREAM_1 = 188, 0x47, 0x0000, 0x1000, 0x0100, 1, 0x06, 0xBD
#: Bytes of payload to a block of samples, and to an elementary packet; timestamps tick at 90 kHz, 40 ms to a packet.
UNIT, ACCESS_UNIT, TICKS = 192, 192 * 256, 3600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, as the tables carry it."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | n >> 8, n & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


_PAT = _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
_PMT = _section(0x02, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds `payload`; deterministic."""
    out, counter = [], 0
    plain = [bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10 | c]) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        out += [_table_packet(PAT_PID, _PAT, k), _table_packet(PMT_PID, _PMT, k)]
        data, pts = payload[at : at + ACCESS_UNIT], k * TICKS & (1 << 33) - 1
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        room, n = PACKET - 4 - 8, len(data)
        stuffing = max(0, room - n)
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter, 7 + stuffing, 0x50]) + clock + b"\xff" * stuffing + data[:room])
        counter = counter + 1 & 15
        pos = room
        while n - pos >= PACKET - 4:
            out.append(plain[counter] + data[pos : pos + PACKET - 4])
            counter = counter + 1 & 15
            pos += PACKET - 4
        if pos < n:
            gap = PACKET - 4 - (n - pos)
            fill = b"\x00" if gap == 1 else bytes([gap - 1, 0]) + b"\xff" * (gap - 2)
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + fill + data[pos:])
            counter = counter + 1 & 15
    return b"".join(out)


class StreamError(ValueError):
    """A stream that breaks the format."""


def _parse_section(packet: bytes, at: int, table_id: int) -> bytes:
    at += 1 + packet[at]
    n = (packet[at + 1] & 0x0F) << 8 | packet[at + 2]
    section = packet[at : at + 3 + n]
    if section[0] != table_id or section_crc(section):
        raise StreamError("program table with a wrong id or checksum")
    return section[8:-4]


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(stream: bytes) -> dict:
    """payload, programs {number: map PID}, streams {PID: type}, timestamps, random_access (payload offsets), packets, pes, discontinuities.

    A gap in a continuity counter is counted and the packet under way given up, as a receiver does; a repeated counter is
    a repeated packet and skipped.
    """
    if len(stream) % PACKET:
        raise StreamError("not a whole number of packets")
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    last: dict[int, int] = {}
    units: list[bytes] = []
    stamps: list[int] = []
    access: list[int] = []
    gathered: list[bytes] = []
    total = gaps = 0
    maps: set[int] = set()
    random = False

    def close() -> None:
        nonlocal total
        if not gathered:
            return
        pes = b"".join(gathered)
        gathered.clear()
        if pes[:3] != b"\x00\x00\x01":
            raise StreamError("elementary packet without a start code")
        size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        if size and len(pes) < 6 + size:
            raise StreamError("elementary packet cut short")
        if pes[7] & 0x80:
            stamps.append(_unstamp(pes[9:14]))
        data = pes[skip : 6 + size if size else None]
        if random:
            access.append(total)
        units.append(data)
        total += len(data)

    for at in range(0, len(stream), PACKET):
        if stream[at] != SYNC:
            raise StreamError(f"no sync byte at {at}")
        b1, b3 = stream[at + 1], stream[at + 3]
        pid = (b1 & 0x1F) << 8 | stream[at + 2]
        if not b3 & 0x10:
            continue
        before, counter = last.get(pid), b3 & 15
        last[pid] = counter
        lost = before is not None and counter != (before + 1) & 15
        if lost and counter == before:
            continue
        gaps += lost
        begin, flags = at + 4, 0
        if b3 & 0x20:
            flags = stream[begin + 1] if stream[begin] else 0
            begin += 1 + stream[begin]
        if pid in streams:
            if b1 & 0x40:
                close()
                random = bool(flags & 0x40)
                gathered.append(stream[begin : at + PACKET])
            elif lost:
                gathered.clear()
            elif gathered:
                gathered.append(stream[begin : at + PACKET])
        elif pid == PAT_PID and b1 & 0x40:
            body = _parse_section(stream[at : at + PACKET], begin - at, 0x00)
            programs = {body[i] << 8 | body[i + 1]: (body[i + 2] & 0x1F) << 8 | body[i + 3] for i in range(0, len(body), 4)}
            maps = set(programs.values())
        elif pid in maps and b1 & 0x40:
            body = _parse_section(stream[at : at + PACKET], begin - at, 0x02)
            i = 4 + ((body[2] & 0x0F) << 8 | body[3])
            while i < len(body):
                streams[(body[i + 1] & 0x1F) << 8 | body[i + 2]] = body[i]
                i += 5 + ((body[i + 3] & 0x0F) << 8 | body[i + 4])
    close()
    return {"payload": b"".join(units), "programs": programs, "streams": streams, "timestamps": stamps, "random_access": access, "packets": len(stream) // PACKET, "pes": len(units), "discontinuities": gaps}


def padded(text: bytes | None) -> bytes:
    """Bytes 32 appended up to a positive multiple of UNIT."""
    data = text or b""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def to_streams(df: DataFrame, text_col: str, out_col: str = "media") -> DataFrame:
    """`df` with a binary column more: each text (null: empty) as a transport stream; see `fresh` for its name."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(fresh(df, out_col), T.BinaryType())])
    at = df.columns.index(text_col)

    def over(batches):
        for batch in batches:
            media = pa.array([mux(padded(t)) for t in text_bytes(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, media], names=schema.names)

    return df.mapInArrow(over, schema)


FEATURES = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("program_pids", T.ArrayType(T.IntegerType())), T.StructField("stream_pids", T.ArrayType(T.IntegerType())), T.StructField("stream_types", T.ArrayType(T.IntegerType())), T.StructField("timestamps", T.ArrayType(T.LongType())), T.StructField("random_access", T.ArrayType(T.LongType())), T.StructField("packets", T.LongType()), T.StructField("pes", T.LongType()), T.StructField("discontinuities", T.LongType())])


def parse_streams(df: DataFrame, media_col: str, out_col: str = "parsed") -> DataFrame:
    """`df` with a struct column more (FEATURES) from its transport streams; null for null; see `fresh` for its name."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(fresh(df, out_col), FEATURES)])
    at = df.columns.index(media_col)
    kind = pa.struct([("payload", pa.binary()), ("program_pids", pa.list_(pa.int32())), ("stream_pids", pa.list_(pa.int32())), ("stream_types", pa.list_(pa.int32())), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("packets", pa.int64()), ("pes", pa.int64()), ("discontinuities", pa.int64())])

    def row(stream: bytes | None) -> dict | None:
        if stream is None:
            return None
        x = demux(stream)
        return x | {"program_pids": sorted(x["programs"].values()), "stream_pids": sorted(x["streams"]), "stream_types": [x["streams"][p] for p in sorted(x["streams"])]}

    def over(batches):
        for batch in batches:
            parsed = pa.array([row(s) for s in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, parsed], names=schema.names)

    return df.mapInArrow(over, schema)


def op4_media(spark, sf_dir: str) -> DataFrame:
    """Each document as a transport stream in a column, parsed back into another, and digests of both.

    A null text is an empty one; null and repeated doc_ids are rows of their own.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    x = parse_streams(to_streams(docs, "text"), "media")
    data = F.col("parsed.payload")
    counts = {"programs": F.size("parsed.program_pids"), "pid": F.col("parsed.stream_pids")[0], "type": F.col("parsed.stream_types")[0], "packets": F.col("parsed.packets"), "pes": F.col("parsed.pes")}
    counts |= {"pts": F.concat_ws("-", F.col("parsed.timestamps")[0], F.element_at("parsed.timestamps", -1)), "random_access": F.size("parsed.random_access"), "discontinuities": F.col("parsed.discontinuities")}
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in counts.items()])
    size = F.octet_length(data)
    return x.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), size.cast("long").alias("payload_bytes"), F.sha2(data, 256).alias("payload_sha256"),
        F.crc32(F.substring(data, -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
