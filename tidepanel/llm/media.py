"""MPEG transport streams: storing payloads in them and reading their tables, packets and timestamps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the transport format: packet size, sync byte, the program table's id, private stream ids.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
PMT_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
#: Payload bytes of one access unit, ticks of 90 kHz between two, units between random-access points.
UNIT, TICKS, ACCESS_EVERY = 576 * 8, 3600, 12
PAD = 576


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: CRC-32 with the polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, table: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + table).ljust(PACKET, b"\xff")


TABLES = table_packet(PAT_PID, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def timestamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A stream of one program with one private data stream that holds the payload."""
    out, counter = [TABLES], 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(2, n * TICKS % (1 << 33)) + data
        first = True
        access = n % ACCESS_EVERY == 0
        while pes:
            field = b"\x01\x40" if first and access else b""
            room = PACKET - 4 - len(field)
            if len(pes) < room:
                stuffing = room - len(pes)
                if field:
                    field = bytes([1 + stuffing]) + field[1:] + b"\xff" * stuffing
                else:
                    field = b"\x00" if stuffing == 1 else bytes([stuffing - 1, 0]) + b"\xff" * (stuffing - 2)
                room = len(pes)
            head = bytes([SYNC]) + (0x4000 * first | DATA_PID).to_bytes(2, "big") + bytes([(0x30 if field else 0x10) | counter & 15])
            out += (head, field, pes[:room])
            pes, first, counter = pes[room:], False, counter + 1
    return b"".join(out)


def parse(media: bytes | None) -> dict:
    """Read a transport stream.

    Returns programs {number: [(pid, stream type)]}, packets (elementary packets in order of their starts: pid,
    pts, dts, random_access, data), continuity_errors, table_errors and lost_bytes.  Null and empty input has
    none; bytes out of step with the sync byte are passed over and counted; packets with the error flag or
    scrambling, broken elementary packets and tables with a wrong checksum are left out and counted.
    """
    out = {"programs": {}, "packets": [], "continuity_errors": 0, "table_errors": 0, "lost_bytes": 0}
    if not media:
        return out
    if len(media) % PACKET == 0 and (np.frombuffer(media, np.uint8)[::PACKET] == SYNC).all():
        starts = range(0, len(media), PACKET)
    else:
        starts, at = [], 0
        while at + PACKET <= len(media):
            if media[at] == SYNC and (at + PACKET == len(media) or media[at + PACKET] == SYNC):
                starts.append(at)
                at += PACKET
            else:
                at += 1
        out["lost_bytes"] = len(media) - PACKET * len(starts)
    tables, streams, counters, open_packets, done = {PAT_PID}, set(), {}, {}, []
    for at in starts:
        flags, pid = media[at + 1], (media[at + 1] & 0x1F) << 8 | media[at + 2]
        control = media[at + 3]
        if flags & 0x80 or control & 0xC0 or pid == 0x1FFF:
            continue
        body, access = at + 4, False
        if control & 0x20:
            size = media[body]
            access = size > 0 and bool(media[body + 1] & 0x40)
            if size and media[body + 1] & 0x80:
                counters.pop(pid, None)  # a marked discontinuity
            body += 1 + size
        if not control & 0x10 or body > at + PACKET:
            continue
        last = counters.get(pid)
        counters[pid] = control & 15
        if last is not None and (control & 15) != (last + 1) % 16:
            if (control & 15) == last:
                continue  # a repeated packet
            out["continuity_errors"] += 1
            open_packets.pop(pid, None)
        payload = media[body : at + PACKET]
        start = flags & 0x40
        if pid in tables:
            if start and payload:
                read_table(out, payload[1 + payload[0] :], pid, tables, streams)
        elif pid in streams:
            if start:
                open_packets[pid] = [pid, access, [payload]]
                done.append(open_packets[pid])
            elif pid in open_packets:
                open_packets[pid][2].append(payload)
    for pid, access, parts in done:
        p = b"".join(parts)
        if p[:3] != b"\x00\x00\x01" or len(p) < 9:
            continue
        size, marks, data = int.from_bytes(p[4:6], "big"), p[7] >> 6, 9 + p[8]
        if size and len(p) < 6 + size:
            continue
        stamps = [(p[x] & 0x0E) << 29 | p[x + 1] << 22 | (p[x + 2] & 0xFE) << 14 | p[x + 3] << 7 | p[x + 4] >> 1 for x in ((9, 14)[: {2: 1, 3: 2}.get(marks, 0)])]
        pts = stamps[0] if stamps else None
        out["packets"].append((pid, pts, stamps[1] if len(stamps) > 1 else pts, access, p[data : 6 + size] if size else p[data:]))
    return out


def read_table(out: dict, s: bytes, pid: int, tables: set, streams: set) -> None:
    size = 3 + ((s[1] & 0x0F) << 8 | s[2]) if len(s) > 2 else 0
    if size < 12 or len(s) < size or (s[:size] != checked.get(s[:size]) and crc32_mpeg(s[:size])):
        out["table_errors"] += 1
        return
    if len(checked) < 64:
        checked[s[:size]] = s[:size]
    number, body = int.from_bytes(s[3:5], "big"), s[8 : size - 4]
    if pid == PAT_PID and s[0] == 0:
        for x in range(0, len(body) - 3, 4):
            program, at = int.from_bytes(body[x : x + 2], "big"), int.from_bytes(body[x + 2 : x + 4], "big") & 0x1FFF
            if program:
                out["programs"].setdefault(program, [])
                tables.add(at)
    elif s[0] == 2:
        x = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
        found = []
        while x + 5 <= len(body):
            found.append((int.from_bytes(body[x + 1 : x + 3], "big") & 0x1FFF, body[x]))
            x += 5 + (int.from_bytes(body[x + 3 : x + 5], "big") & 0x0FFF)
        out["programs"][number] = found
        streams.update(p for p, _ in found)


#: Tables whose checksum was found right in this process.
checked: dict[bytes, bytes] = {}


def stored(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store whole texts as transport streams: (doc_id, n_bytes, media binary).

    The payload is the text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576.  Null and empty
    texts have a payload of padding alone; ids may be null or repeat, and repeated rows are stored each; equal texts have equal
    streams, so ties don't matter; a very long text is one stream, in memory that its length bounds; an empty table gives no
    rows; other columns are not used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in range(0, len(batch), 1000):
                some = batch.iloc[x : x + 1000]
                raw = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in some["text"]]
                media = [mux(r + b"\xff" * (PAD - len(r) if not r else -len(r) % PAD)) for r in raw]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "n_bytes": [len(r) for r in raw], "media": media})

    return texts.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Parse the binary column ``media`` and describe each row's stream.

    Adds payload (digests of the reassembled data), timestamps with random-access points, and counts.  Broken or
    null streams give empty payloads and their error counts; see ``parse``.  Equal streams have equal features, rows are described each
    however often they repeat, and an empty table gives no rows.
    """
    kinds = dict(media.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in keep)
    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, programs int, pts array<long>, random_access array<long>, continuity_errors long, feature string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch["media"]:
                raw = bytes(raw) if raw is not None else b""
                found = parse(raw)
                payload = b"".join(p[4] for p in found["packets"])
                pts = [p[1] for p in found["packets"]]
                access = [p[1] for p in found["packets"] if p[3]]
                entropy = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / max(1, len(payload))
                bits = float(-(entropy[entropy > 0] * np.log2(entropy[entropy > 0])).sum())
                feature = f"programs={len(found['programs'])};units={len(pts)};access={len(access)};last_pts={pts[-1] if pts else ''};lost={found['continuity_errors']};bits={bits:.6f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), len(found["programs"]), pts, access, found["continuity_errors"], feature))
            names = [c.split()[0] for c in more.split(", ")]
            out = batch[list(keep)].reset_index(drop=True)
            yield out.assign(**{c: [r[i] for r in rows] for i, c in enumerate(names)})

    return media.select(*keep, "media").mapInPandas(run, f"{columns}, {more}")
