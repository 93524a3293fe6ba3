"""Capture files (pcap and pcapng) and the flows their packets make."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from netloom.core.arrow import rows_mapped
from netloom.core.columns import floor_div
from netloom.sources import packet

# Link types, block types, the largest packet.
ETHERNET, RAW, NULL, LOOP, SLL, SLL2 = 1, {12, 14, 101, 228, 229}, 0, 108, 113, 276
SECTION, INTERFACE, OLD_PACKET, SIMPLE, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
MOST = 1 << 18
SOURCE = 5  # of a record: a capture
IDLE_US, ACTIVE_US = 15_000_000, 60_000_000
PACKETS = "path string, nth long, us long, wire long, l2 boolean, src string, dst string, src_port int, dst_port int, proto short, tos short, tcp_flags short, vlan int, encap short, l2_hdr short"


def file_format(head: bytes) -> str:
    """pcap, pcapng, or '' for neither (compressed files are neither)."""
    if head[:4] in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
        return "pcap"
    return "pcapng" if head[:4] == b"\x0a\x0d\x0d\x0a" else ""


def packets(raw: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(epoch microseconds, length on the wire, captured bytes, link type). A file cut short ends at its last whole packet."""
    kind = file_format(raw)
    if not kind:
        raise ValueError("not a pcap or pcapng file (it may not be compressed)")
    yield from (_pcap if kind == "pcap" else _pcapng)(raw)


def _pcap(raw: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    order = "<" if raw[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    nanos = raw[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    if len(raw) < 24:
        return
    link, at = struct.unpack_from(order + "I", raw, 20)[0] & 0xFFFF, 24  # the high bits may say that frames end with a check sequence
    while at + 16 <= len(raw):
        sec, part, held, size = struct.unpack_from(order + "IIII", raw, at)
        if held > MOST:
            raise ValueError(f"damaged record of {held} bytes")
        if at + 16 + held > len(raw):
            return
        yield sec * 1_000_000 + (part // 1000 if nanos else part), max(size, held), raw[at + 16 : at + 16 + held], link
        at += 16 + held


def _pcapng(raw: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    at, order, faces, last = 0, "", [], 0
    while at + 12 <= len(raw):
        if raw[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(raw[at + 8 : at + 12], "")
            if not order:
                raise ValueError("section of unknown byte order")
            faces = []  # interfaces are counted anew in each section
        if not order:
            raise ValueError("no section")
        kind, size = struct.unpack_from(order + "II", raw, at)
        if size < 12 or size % 4 or (kind != SECTION and size > MOST + 64):
            raise ValueError(f"damaged block of {size} bytes")
        if at + size > len(raw):
            return
        body = raw[at + 8 : at + size - 4]
        at += size
        if kind == INTERFACE and len(body) >= 8:
            faces.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order)))
        elif kind in (PACKET, OLD_PACKET) and len(body) >= 20:
            face, high, low, held, whole = struct.unpack_from(order + "IIIII", body)
            if kind == OLD_PACKET:
                face = struct.unpack_from(order + "H", body)[0]
            if face < len(faces) and 20 + held <= len(body):
                link, (num, den) = faces[face]
                last = (high << 32 | low) * 1_000_000 * num // den
                yield last, max(whole, held), body[20 : 20 + held], link
        elif kind == SIMPLE and len(body) >= 4 and faces:
            whole = struct.unpack_from(order + "I", body)[0]
            data = body[4 : 4 + whole]
            yield last, max(whole, len(data)), data, faces[0][0]


def _resolution(options: bytes, order: str) -> tuple[int, int]:
    """Seconds per tick as a fraction; microseconds if the interface doesn't say."""
    at = 0
    while at + 4 <= len(options):
        code, n = struct.unpack_from(order + "HH", options, at)
        if code == 0 or at + 4 + n > len(options):
            break
        if code == 9 and n:
            v = options[at + 4]
            return (1, 1 << (v & 0x7F)) if v & 0x80 else (1, 10**v)
        at += 4 + (n + 3) // 4 * 4
    return 1, 1_000_000


def headers(data: bytes, link: int) -> tuple[bool, dict | None]:
    """Whether the link layer is Ethernet, and the packet's fields."""
    if link == ETHERNET:
        return True, packet.ethernet(data)
    if link in RAW:
        return False, packet.ip(data)
    if link in (NULL, LOOP):
        return False, packet.ip(data[4:])
    skip, kind = (16, data[14:16]) if link == SLL else (20, data[:2]) if link == SLL2 else (0, b"")
    return False, packet.ip(data[skip:]) if kind in (b"\x08\x00", b"\x86\xdd") and len(data) >= skip else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Packets of capture files, each file read by one task. A damaged file gives the packets before the damage; packets
    without an IP header are left out."""
    return packets_in(spark.read.format("binaryFile").load(path).select("path", "content"))


def packets_in(files: DataFrame) -> DataFrame:
    """read() of files (path, content) that are rows already."""

    def each(r: dict) -> Iterator[dict]:
        try:
            for k, (us, size, data, link) in enumerate(packets(r["content"])):
                l2, f = headers(data, link)
                if f is not None:
                    yield {"path": r["path"], "nth": k, "us": us, "wire": size + 4 * l2, "l2": l2} | f  # captured frames lack the check sequence
        except ValueError:
            return

    return rows_mapped(files.select("path", "content"), each, PACKETS)


KEY = ["path", "src", "dst", "src_port", "dst_port", "proto", "vlan", "encap", "l2", "l2_hdr"]


def flows(packets: DataFrame, exporter: str = "127.0.0.1") -> DataFrame:
    """Records (see operators.ingest.RECORD) of packets: a flow ends after 15 idle seconds and is reported every 60.

    Gaps split a key's packets into sessions, and sessions into reports of 60 seconds from their first packet; a key's
    packets are cut by the hour first, so that a key that never falls idle isn't one task's work.  Who opened a TCP flow is
    told by its first packet's flags, or by those of the other direction.
    """
    hour = floor_div(F.col("us"), 3_600_000_000)
    w = Window.partitionBy(*KEY, "_h").orderBy("us", "nth")
    gap = F.col("us") - F.lag("us").over(w)
    p = packets.withColumn("_h", hour).withColumn("_n", F.when(gap.isNull() | (gap >= IDLE_US), 1).otherwise(0)).withColumn("_s", F.sum("_n").over(w))
    p = p.withColumn("_f", F.min("us").over(Window.partitionBy(*KEY, "_h", "_s"))).withColumn("_a", floor_div(F.col("us") - F.col("_f"), ACTIVE_US))
    opened = lambda f: F.when(f.bitwiseAND(0x12) == 0x02, 1).when(f.bitwiseAND(0x12) == 0x12, -1).otherwise(0)
    first = p.groupBy(*KEY, "_h", "_s").agg(F.min_by("tcp_flags", F.struct("us", "nth")).cast("int").alias("_ff"), F.min("us").alias("_f")).withColumn("own", opened(F.col("_ff")))
    f = p.groupBy(*KEY, "_h", "_s", "_a").agg(F.min("us").alias("s"), F.max("us").alias("e"), F.count("*").alias("packets"), F.sum("wire").alias("bytes"), F.bit_or("tcp_flags").alias("tcp_flags"), F.min("nth").alias("nth"), F.first("tos").alias("tos"))
    f = f.join(first.select(*KEY, "_h", "_s", "own"), [*KEY, "_h", "_s"])
    swap = {"src": "dst", "dst": "src", "src_port": "dst_port", "dst_port": "src_port"}
    back = first.groupBy(*KEY, "_h").agg(F.max("own").alias("hi"), F.min("own").alias("lo")).select(*[F.col(swap.get(k, k)).alias(k) for k in KEY], "_h", F.when(F.col("hi") == 1, 1).otherwise(F.col("lo")).alias("other"))
    f = f.join(back, [*KEY, "_h"], "left")
    opener = F.when(F.col("proto") != 6, 0).when(F.col("own") != 0, F.col("own")).otherwise(-F.coalesce("other", F.lit(0))).cast("short")
    lit = lambda v, t: F.lit(v).cast(t)
    return f.select(
        F.timestamp_micros("s").alias("start"), F.timestamp_micros("e").alias("end"), "src", "dst", "src_port", "dst_port", "proto", F.col("tcp_flags").cast("short").alias("tcp_flags"), "tos", "bytes", "packets", "l2", "l2_hdr",
        lit(1, "long").alias("sampling"), lit(1.0, "double").alias("mult"), F.lit(True).alias("sampling_known"), lit(0, "long").alias("in_if"), lit(0, "long").alias("out_if"), "vlan", "encap", lit(255, "short").alias("direction"), opener.alias("opener"),
        lit(0, "long").alias("src_as"), lit(0, "long").alias("dst_as"), F.lit(exporter).alias("exporter"), lit(0, "long").alias("domain"), lit(0, "long").alias("observation"), lit(SOURCE, "short").alias("source"), F.col("nth").alias("arrival_seq"), F.timestamp_micros("e").alias("arrived"),
    )
