"""sFlow version 5."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from netloom.core.arrow import rows_mapped
from netloom.sources import packet
from netloom.sources.netflow import numbered
from netloom.sources.wire import Fields, Short

# Formats of samples and records, kinds of sampled headers.
FLOW, COUNTER, FLOW_WIDE, COUNTER_WIDE = 1, 2, 3, 4
RAW, DATA4, DATA6, SWITCH, GATEWAY, INTERFACE = 1, 3, 4, 1001, 1003, 1
HEAD_ETHERNET, HEAD_IP4, HEAD_IP6 = 1, 11, 12
MOST_SAMPLES = 4096
SOURCE = 1  # of a record: sFlow
SAMPLE = "agent string, sub_agent long, dgram_seq long, kind string, seq long, source_id long, rate long, pool long, drops long, in_if long, out_if long, decoded boolean, src string, dst string, src_port int, dst_port int, proto short, tos short, tcp_flags short, vlan int, encap short, l2_hdr short, l2 boolean, bytes long, src_as long, dst_as long, ifindex long, speed long, in_oct long, out_oct long, in_pkts long, out_pkts long, error string, arrived timestamp, arrival_seq long, nth int, crc long"


def interface(form: int, value: int) -> int:
    """An interface field names an interface only in format 0; else it is a reason or a number of interfaces."""
    return value if form == 0 else 0


def decode(raw: bytes) -> list[dict]:
    """Flow and interface-counter samples of a datagram. What follows a broken sample is given up: its row has error."""
    f, out = Fields(raw), []
    version, kind = f.read("II")
    if version != 5:
        raise ValueError("not sFlow version 5")
    if kind not in (1, 2):
        raise ValueError("bad agent address type")
    agent = packet.text4(f.take(4)) if kind == 1 else packet.text6(f.take(16))
    sub, seq, _, n = f.read("IIII")
    head = {"agent": agent, "sub_agent": sub, "dgram_seq": seq}
    if n > MOST_SAMPLES:
        raise ValueError(f"implausible sample count {n}")
    try:
        for _ in range(n):
            form, size = f.read("II")
            body = Fields(f.take(size))
            if form in (FLOW, FLOW_WIDE):
                out.append(head | _flow(body, form == FLOW_WIDE))
            elif form in (COUNTER, COUNTER_WIDE):
                out += [head | c for c in _counters(body, form == COUNTER_WIDE)]
    except Short as e:
        out.append(head | {"kind": "error", "error": f"truncated: {e}"})
    return out


def _records(f: Fields) -> Iterator[tuple[int, Fields]]:
    for _ in range(f.u32()):
        form, size = f.read("II")
        yield form, Fields(f.take(size))


def _flow(f: Fields, wide: bool) -> dict:
    seq = f.u32()
    if wide:
        kind, index = f.read("II")
        source = (kind << 24 | index & 0xFFFFFF) & 0xFFFFFFFF
    else:
        source = f.u32()
    rate, pool, drops = f.read("III")
    if wide:
        a, b, c, d = f.read("IIII")
        inward, outward = interface(a, b), interface(c, d)
    else:
        inward, outward = (interface(w >> 30, w & 0x3FFFFFFF) for w in f.read("II"))
    out = {"kind": "flow", "seq": seq, "source_id": source, "rate": rate, "pool": pool, "drops": drops, "in_if": inward, "out_if": outward, "decoded": False, "l2": False, "bytes": 0, "src_as": 0, "dst_as": 0} | packet.EMPTY
    for form, body in _records(f):
        try:
            if form == RAW:
                _header(body, out)
            elif form in (DATA4, DATA6) and not out["decoded"]:
                _data(body, form == DATA6, out)
            elif form == SWITCH:
                out["vlan"] = out["vlan"] or body.u32() & 0xFFF
            elif form == GATEWAY:
                _gateway(body, out)
        except Short:
            continue
    return out


def _header(f: Fields, out: dict) -> None:
    kind, length, _, size = f.read("IIII")
    head = f.take(size)
    seen = packet.ethernet(head) if kind == HEAD_ETHERNET else packet.ip(head, None, {HEAD_IP4: 4, HEAD_IP6: 6}[kind]) if kind in (HEAD_IP4, HEAD_IP6) else None
    out["bytes"], out["l2"] = length, out["l2"] or kind == HEAD_ETHERNET  # a frame's length has its check sequence
    if seen:
        vlan = out["vlan"]
        out.update(seen, decoded=True)
        out["vlan"] = vlan or out["vlan"]


def _data(f: Fields, six: bool, out: dict) -> None:
    length, proto = f.read("II")
    src, dst = (packet.text6(f.take(16)), packet.text6(f.take(16))) if six else (packet.text4(f.take(4)), packet.text4(f.take(4)))
    sport, dport, flags, tos = f.read("IIII")
    out.update(bytes=length, proto=proto & 255, src=src, dst=dst, src_port=sport & 0xFFFF, dst_port=dport & 0xFFFF, tcp_flags=flags & 255, tos=tos & 255, decoded=True)
    if out["encap"] == packet.NO_TUNNEL:
        out["encap"] = packet.tunnel(out["proto"], out["dst_port"], ":" in src)


def _gateway(f: Fields, out: dict) -> None:
    hop = f.u32()
    if hop not in (1, 2):
        return
    f.take(4 if hop == 1 else 16)
    own, source, _ = f.read("III")
    out["src_as"] = out["src_as"] or source
    last = 0
    try:
        for _ in range(min(f.u32(), 16)):
            _, n = f.read("II")
            path = f.read(f"{min(n, 64)}I")
            last = path[-1] if path else last
    except Short:
        pass
    out["dst_as"] = last or own or out["dst_as"]


def _counters(f: Fields, wide: bool) -> Iterator[dict]:
    f.take(12 if wide else 8)
    for form, body in _records(f):
        if form != INTERFACE:
            continue
        try:
            index, _, speed, _, _, in_oct, *inward = body.read("IIQIIQIII")
            body.take(12)
            out_oct, *outward = body.read("QIII")
        except Short:
            continue
        yield {"kind": "counter", "ifindex": index, "speed": speed, "in_oct": in_oct, "out_oct": out_oct, "in_pkts": sum(inward), "out_pkts": sum(outward)}


def samples(datagrams: DataFrame) -> DataFrame:
    """Samples of datagrams (payload binary, arrived timestamp, arrival_seq long). A datagram that can't be read is a row of
    kind 'error'; nothing a sender puts into one ends the job."""

    def each(r: dict) -> list[dict]:
        raw = r["payload"] or b""
        try:
            got = decode(raw)
        except Exception as e:  # a hostile datagram must not reach further than its row
            got = [{"kind": "error", "error": str(e)[:200]}]
        return [g | {"arrived": r["arrived"], "arrival_seq": r["arrival_seq"], "nth": i, "crc": zlib.crc32(raw)} for i, g in enumerate(got)]

    return rows_mapped(datagrams.select("payload", "arrived", "arrival_seq"), each, SAMPLE)


def once(rows: DataFrame) -> DataFrame:
    """Samples of datagrams that came twice (same agent, sequence and content) once."""
    first = rows.groupBy("agent", "sub_agent", "dgram_seq", "crc").agg(F.min("arrival_seq").alias("arrival_seq"))
    return rows.join(first, ["agent", "sub_agent", "dgram_seq", "crc", "arrival_seq"], "left_semi").unionByName(rows.where("kind = 'error' and agent is null"))


#: Seconds of a window, the most that lost samples may raise a rate, samples a verdict rests on.
WINDOW_S, MOST_RAISE, ENOUGH = 30, 20.0, 30


def effective_rates(rows: DataFrame) -> DataFrame:
    """Flow samples with mult: the declared rate, raised by the samples lost on the way or dropped by the agent.

    Losses are the gaps of the sequence numbers in windows of 30 seconds per source.  The pool of packets seen checks them:
    some agents number all interfaces in one sequence, and where the pool grew no faster than the rate while the gaps say
    that most samples are missing, the pool is believed.  A window of few samples keeps the declared rate.
    """
    flows = rows.where("kind = 'flow'").withColumn("win", F.floor(F.unix_seconds("arrived") / WINDOW_S))
    source = ["agent", "sub_agent", "source_id"]
    w = Window.partitionBy(*source, "win").orderBy("seq", "arrival_seq")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    near = flows.withColumn("_gap", step("seq") - 1).withColumn("_pool", step("pool")).withColumn("_drop", step("drops"))
    ok = F.col("_gap").between(0, 1 << 16)
    per = near.groupBy(*source, "win").agg(
        F.count("*").alias("recv"), F.coalesce(F.sum(F.when(ok, F.col("_gap"))), F.lit(0)).alias("miss"), F.coalesce(F.sum(F.when(ok & F.col("_drop").between(0, 1 << 31), F.col("_drop"))), F.lit(0)).alias("drops_"),
        F.avg(F.when(ok & F.col("_pool").between(0, 1 << 31), F.col("_pool"))).alias("pool_"), F.count(F.when(ok, 1)).alias("pooled"), F.max("rate").alias("cfg"),
    )
    by_gaps = F.col("cfg") * (F.col("recv") + F.col("miss") + F.col("drops_")) / F.col("recv")
    shared = (F.col("pooled") >= ENOUGH) & (F.col("pool_") >= F.col("cfg") / 2) & (by_gaps > F.col("pool_") * (1.5 + 2 / F.sqrt("pooled")))
    rate = F.when(shared, F.greatest(F.col("cfg").cast("double"), F.col("pool_"))).otherwise(by_gaps)
    raised = F.when((F.col("recv") >= ENOUGH) & (F.col("cfg") > 0), F.least(rate, F.col("cfg") * MOST_RAISE) / F.col("cfg")).otherwise(1.0)
    return flows.join(per.select(*source, "win", raised.alias("_r")), [*source, "win"]).withColumn("mult", F.col("rate") * F.col("_r")).drop("_r", "win")


def records(rows: DataFrame) -> DataFrame:
    """Decoded flow samples as records (see operators.ingest.RECORD), with arrived."""
    f = effective_rates(rows).where("decoded")
    return f.select(
        F.col("arrived").alias("start"), F.col("arrived").alias("end"), "src", "dst", "src_port", "dst_port", "proto", "tcp_flags", "tos", "bytes", F.lit(1).cast("long").alias("packets"), "l2", "l2_hdr",
        F.col("rate").alias("sampling"), "mult", (F.col("rate") > 0).alias("sampling_known"), "in_if", "out_if", "vlan", "encap", F.lit(255).cast("short").alias("direction"), F.lit(0).cast("short").alias("opener"),
        "src_as", "dst_as", F.col("agent").alias("exporter"), F.col("sub_agent").alias("domain"), F.col("source_id").alias("observation"), F.lit(SOURCE).cast("short").alias("source"), numbered(F.col("arrival_seq"), F.col("nth")).alias("arrival_seq"), "arrived",
    )


def counters(rows: DataFrame) -> DataFrame:
    """Interface counters: ts, exporter, ifindex, speed and the counters."""
    return rows.where("kind = 'counter'").select(F.col("arrived").alias("ts"), F.col("agent").alias("exporter"), "ifindex", "speed", "in_oct", "out_oct", "in_pkts", "out_pkts", "arrived")
