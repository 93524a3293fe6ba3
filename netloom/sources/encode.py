"""Datagrams and capture files from records: what exporters and agents send, for tests, simulations and replays.

A record here is a dict with src, dst, src_port, dst_port, proto, tcp_flags, bytes, packets, in_if, out_if, vlan, start_ms,
end_ms and, where a format can say it, rate, reverse_bytes and reverse_packets.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterable, Iterator

#: Template ids used here: records of either family, and options that declare a rate.
V4, V6, RATE = 300, 301, 400
LINK = 1  # of capture files: Ethernet


def packed(address: str) -> bytes:
    return ipaddress.ip_address(address).packed


# -- version 5
def nf5(records: list[dict], secs: int, seq: int = 0, engine: int = 0, rate: int = 0) -> bytes:
    """A version 5 datagram of up to 30 IPv4 records; the device's clock began an hour before secs."""
    up = 3_600_000
    ago = lambda ms: up - (secs * 1000 - ms) & 0xFFFFFFFF
    out = struct.pack("!HHIIIIBBH", 5, len(records), up, secs, 0, seq, 0, engine, 1 << 14 | rate)
    for r in records:
        out += packed(r["src"]) + packed(r["dst"]) + bytes(4) + struct.pack("!HHIIII", r["in_if"], r["out_if"], r["packets"], r["bytes"], ago(r["start_ms"]), ago(r["end_ms"]))
        out += struct.pack("!HHBBBBHHBBH", r["src_port"], r["dst_port"], 0, r["tcp_flags"], r["proto"], 0, 0, 0, 0, 0, 0)
    return out


# -- version 9 and IPFIX: element and length of each field, by version
def _fields(version: int, six: bool, reverse: bool) -> list[tuple[int, int, int]]:
    addresses = [(27, 16), (28, 16)] if six else [(8, 4), (12, 4)]
    times = [(22, 4), (21, 4)] if version == 9 else [(152, 8), (153, 8)]
    plain = [*addresses, (7, 2), (11, 2), (4, 1), (6, 1), (1, 8), (2, 8), (10, 4), (14, 4), (58, 2), *times]
    return [(0, i, n) for i, n in plain] + ([(29305, 1, 8), (29305, 2, 8)] if reverse else [])


def _set(sid: int, body: bytes) -> bytes:
    pad = -len(body) % 4
    return struct.pack("!HH", sid, 4 + len(body) + pad) + body + bytes(pad)


def templates(version: int, reverse: bool = False, rate: int = 0) -> list[bytes]:
    """Sets with the templates of both families and, if the exporter samples one in rate packets, options that say so."""
    body = b""
    for tid, six in ((V4, False), (V6, True)):
        fields = _fields(version, six, reverse and version == 10)
        body += struct.pack("!HH", tid, len(fields))
        for ent, i, n in fields:
            body += struct.pack("!HH", i | (0x8000 if ent else 0), n) + (struct.pack("!I", ent) if ent else b"")
    out = [_set(0 if version == 9 else 2, body)]
    if rate:
        form = struct.pack("!HHHHHHH", RATE, 4, 4, 1, 4, 34, 4) if version == 9 else struct.pack("!HHHHHHH", RATE, 2, 1, 149, 4, 34, 4)
        out += [_set(1 if version == 9 else 3, form), _set(RATE, struct.pack("!II", 0, rate))]
    return out


def data_sets(version: int, records: Iterable[dict], secs: int, up: int = 3_600_000, reverse: bool = False) -> list[bytes]:
    """Data sets of records, one for each family that occurs."""
    bodies = {V4: b"", V6: b""}
    for r in records:
        six = ":" in r["src"]
        times = [r["start_ms"], r["end_ms"]] if version == 10 else [up - (secs * 1000 - r[k]) & 0xFFFFFFFF for k in ("start_ms", "end_ms")]
        body = packed(r["src"]) + packed(r["dst"]) + struct.pack("!HHBBQQIIH", r["src_port"], r["dst_port"], r["proto"], r["tcp_flags"], r["bytes"], r["packets"], r["in_if"], r["out_if"], r["vlan"])
        body += struct.pack("!QQ" if version == 10 else "!II", *times)
        if reverse and version == 10:
            body += struct.pack("!QQ", r.get("reverse_bytes", 0), r.get("reverse_packets", 0))
        bodies[V6 if six else V4] += body
    return [_set(tid, body) for tid, body in bodies.items() if body]


def message(version: int, sets: list[bytes], secs: int, seq: int = 0, domain: int = 0, up: int = 3_600_000) -> bytes:
    body = b"".join(sets)
    if version == 9:
        return struct.pack("!HHIIII", 9, len(sets), up, secs, seq, domain) + body
    return struct.pack("!HHIII", 10, 16 + len(body), secs, seq, domain) + body


# -- frames, sFlow, capture files
def frame(r: dict) -> bytes:
    """The headers of an Ethernet frame of a TCP or UDP packet."""
    tag = struct.pack("!HH", 0x8100, r["vlan"]) if r["vlan"] else b""
    tcp = struct.pack("!HHIIBBHHH", r["src_port"], r["dst_port"], 0, 0, 0x50, r["tcp_flags"], 0, 0, 0)
    l4 = tcp if r["proto"] == 6 else struct.pack("!HHHH", r["src_port"], r["dst_port"], 8, 0)
    src, dst = packed(r["src"]), packed(r["dst"])
    if len(src) == 16:
        l3 = struct.pack("!IHBB", 6 << 28, len(l4), r["proto"], 64) + src + dst
    else:
        l3 = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(l4), 0, 0, 64, r["proto"], 0) + src + dst
    return b"\x02" * 12 + tag + (b"\x86\xdd" if len(src) == 16 else b"\x08\x00") + l3 + l4


def flow_sample(r: dict, frame_length: int, rate: int, seq: int = 0, source: int = 1, pool: int = 0) -> bytes:
    head = frame(r)
    raw = struct.pack("!IIII", 1, frame_length, 4, len(head)) + head + bytes(-len(head) % 4)
    body = struct.pack("!IIIIIIII", seq, source, rate, pool, 0, r["in_if"], r["out_if"], 1) + struct.pack("!II", 1, len(raw)) + raw
    return struct.pack("!II", 1, len(body)) + body


def counter_sample(c: dict, seq: int = 0) -> bytes:
    """Interface counters: ifindex, speed, in_oct, out_oct, in_pkts, out_pkts."""
    record = struct.pack("!IIQIIQIIIIIIQIIIIII", c["ifindex"], 6, c["speed"], 1, 3, c["in_oct"], c["in_pkts"], 0, 0, 0, 0, 0, c["out_oct"], c["out_pkts"], 0, 0, 0, 0, 0)
    body = struct.pack("!III", seq, c["ifindex"] & 0xFFFFFF, 1) + struct.pack("!II", 1, len(record)) + record
    return struct.pack("!II", 2, len(body)) + body


def sflow(agent: str, samples: list[bytes], seq: int = 0) -> bytes:
    a = packed(agent)
    return struct.pack("!II", 5, 1 if len(a) == 4 else 2) + a + struct.pack("!IIII", 0, seq, 0, len(samples)) + b"".join(samples)


def capture_file(packets: Iterator[tuple[int, bytes, int]]) -> bytes:
    """A capture file of (microseconds, bytes kept, length on the wire)."""
    out = [struct.pack("!IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65_535, LINK)]
    for us, kept, length in packets:
        out += [struct.pack("!IIII", us // 1_000_000, us % 1_000_000, len(kept), length), kept]
    return b"".join(out)
