"""Decoders against datagrams and files that are put together here."""

import struct
from datetime import datetime, timedelta, timezone

import pytest

from netloom.operators import ingest, ranges
from netloom.sources import capture, files, netflow, packet, sflow
from netloom.sources.wire import dispatch

T0 = datetime(2026, 3, 10, 12, 0, tzinfo=timezone.utc)


def ip4(a):
    return bytes(map(int, a.split(".")))


def tcp4(src="10.0.0.1", dst="192.0.2.7", sp=50000, dp=443, flags=0x02, proto=6):
    l4 = struct.pack("!HHIIBBHHH", sp, dp, 0, 0, 0x50, flags, 0, 0, 0) if proto == 6 else struct.pack("!HHHH", sp, dp, 8, 0)
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 0, 0, 64, proto, 0, ip4(src), ip4(dst)) + l4


def frame(body, vlan=None, kind=0x0800):
    tag = struct.pack("!HH", 0x8100, vlan) if vlan else b""
    return b"\1" * 12 + tag + struct.pack("!H", kind) + body


def test_packet_headers():
    f = packet.ethernet(frame(tcp4(), vlan=12))
    assert (f["src"], f["dst"], f["src_port"], f["dst_port"], f["proto"], f["tcp_flags"], f["vlan"], f["l2_hdr"]) == ("10.0.0.1", "192.0.2.7", 50000, 443, 6, 2, 12, 18)
    mpls = frame(struct.pack("!II", 1 << 12, 1 << 12 | 1 << 8) + tcp4(), kind=0x8847)
    assert packet.ethernet(mpls)["encap"] == 7 and packet.ethernet(mpls)["l2_hdr"] == 22
    six = struct.pack("!IHBB16s16s", 0x60000000, 28, 0, 64, bytes(15) + b"\1", bytes(15) + b"\2") + bytes([17, 0, 1, 4, 0, 0, 0, 0]) + struct.pack("!HHHH", 9, 4789, 8, 0)
    f = packet.ip(six)
    assert (f["src"], f["proto"], f["dst_port"], f["encap"]) == ("::1", 17, 4789, 5)
    assert packet.ethernet(b"short") is None and packet.ethernet(frame(b"", kind=0x0806)) is None
    assert packet.ip(tcp4()[:22])["src_port"] == 0  # cut short


def sflow_sample(seq=1, rate=100, source=3, out=7, frame_len=1000, header=None, pool=0):
    header = frame(tcp4()) if header is None else header
    header += bytes(-len(header) % 4)
    raw = struct.pack("!IIII", 1, frame_len, 4, len(header)) + header
    record = struct.pack("!II", 1, len(raw)) + raw
    body = struct.pack("!IIIIIIII", seq, source, rate, pool, 0, 3, out, 1) + record
    return struct.pack("!II", 1, len(body)) + body


def sflow_counter():
    body = struct.pack("!IIQIIQIIIIIIQIIIIII", 5, 6, 10**9, 1, 3, 1000, 1, 2, 3, 0, 0, 0, 2000, 4, 5, 6, 0, 0, 0)
    record = struct.pack("!II", 1, len(body)) + body
    sample = struct.pack("!III", 1, 3, 1) + record
    return struct.pack("!II", 2, len(sample)) + sample


def sflow_datagram(*samples, seq=1):
    return struct.pack("!II4sIIII", 5, 1, ip4("10.9.9.9"), 0, seq, 1000, len(samples)) + b"".join(samples)


DATAGRAM = "payload binary, exporter string, arrived timestamp, arrival_seq long"


def grams(spark, raws, exporter="10.9.9.9", every=1.0):
    return spark.createDataFrame([(bytearray(r), exporter, T0 + timedelta(seconds=every * i), i) for i, r in enumerate(raws)], DATAGRAM)


def test_sflow(spark):
    raw = sflow_datagram(sflow_sample(), sflow_sample(seq=2, out=1 << 30 | 5), sflow_counter())
    got = sflow.decode(raw)
    assert [g["kind"] for g in got] == ["flow", "flow", "counter"]
    assert (got[0]["bytes"], got[0]["l2"], got[0]["l2_hdr"], got[0]["dst_port"], got[0]["out_if"], got[1]["out_if"]) == (1000, True, 14, 443, 7, 0)
    assert (got[2]["ifindex"], got[2]["in_oct"], got[2]["out_oct"], got[2]["in_pkts"], got[2]["out_pkts"]) == (5, 1000, 2000, 6, 15)
    rows = sflow.samples(grams(spark, [raw, raw, b"\0\0\0\5junk", raw[:60], None or b""]))
    rec = sflow.records(sflow.once(rows)).collect()
    assert len(rec) == 2 and rec[0].exporter == "10.9.9.9" and rec[0].mult == 100.0 and rec[0].packets == 1
    assert sflow.counters(sflow.once(rows)).count() == 1
    assert rows.where("kind = 'error'").count() == 3
    assert dispatch(raw) == "sflow" and dispatch(b"\0\x09") == "nf9" and dispatch(b"") == ""


def test_sflow_rate_is_raised_by_what_was_lost(spark):
    kept = [k for k in range(1, 121) if k % 4]  # a quarter never arrives
    raws = [sflow_datagram(sflow_sample(seq=k, pool=100 * k), seq=k) for k in kept]
    rec = sflow.records(sflow.samples(grams(spark, raws, every=0.2))).collect()
    assert all(abs(r.mult / 133.3 - 1) < 0.03 for r in rec)
    shared = [sflow_datagram(sflow_sample(seq=4 * k, pool=100 * k), seq=k) for k in range(1, 80)]  # gaps, but a pool that knows of no loss
    rec = sflow.records(sflow.samples(grams(spark, shared, every=0.2))).collect()
    assert {r.mult for r in rec} == {100.0}


def v5(n=2, sampling=0, src="10.0.0.1"):
    rec = struct.pack("!4s4s4sHHIIIIHHBBBBHHBBH", ip4(src), ip4("192.0.2.7"), ip4("0.0.0.0"), 3, 7, 10, 5000, 90_000, 100_000, 50000, 443, 0, 2, 6, 0, 1, 2, 0, 0, 0)
    return struct.pack("!HHIIIIBBH", 5, n, 120_000, int(T0.timestamp()), 0, 1, 0, 1, sampling) + rec * n


def template(tid, *fields, version=9):
    body = struct.pack("!HH", tid, len(fields)) + b"".join(struct.pack("!HH", *f) for f in fields)
    return struct.pack("!HH", 0 if version == 9 else 2, 4 + len(body)) + body


def message(*sets, version=9, domain=1, seq=1):
    body = b"".join(sets)
    if version == 9:
        return struct.pack("!HHIIII", 9, len(sets), 120_000, int(T0.timestamp()), seq, domain) + body
    return struct.pack("!HHIII", 10, 16 + len(body), int(T0.timestamp()), seq, domain) + body


FIELDS = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4), (10, 4), (22, 4), (21, 4)]


def data(tid, *rows):
    body = b"".join(struct.pack("!4s4sHHBIIIII", ip4(r[0]), ip4("192.0.2.7"), 50000, 443, 6, r[1], r[2], 3, 90_000, 100_000) for r in rows)
    return struct.pack("!HH", tid, 4 + len(body)) + body


def options(tid, rate, version=9):
    if version == 9:
        t = struct.pack("!HHH", tid, 4, 4) + struct.pack("!HHHH", 1, 4, 34, 4)
        t = struct.pack("!HH", 1, 4 + len(t)) + t
    else:
        t = struct.pack("!HHH", tid, 2, 1) + struct.pack("!HHHH", 149, 4, 34, 4)
        t = struct.pack("!HH", 3, 4 + len(t)) + t
    d = struct.pack("!II", 0, rate)
    return t, struct.pack("!HH", tid, 4 + len(d)) + d


def test_netflow5(spark):
    rec = netflow.records(grams(spark, [v5(), v5(1, 1000), v5()[:40]])).orderBy("arrival_seq").collect()
    assert [(r.mult, r.sampling_known) for r in rec] == [(1.0, False), (1.0, False), (1000.0, True)]
    r = rec[0]
    assert (r.src, r.dst_port, r.bytes, r.packets, r.in_if, r.out_if) == ("10.0.0.1", 443, 5000, 10, 3, 7)
    assert r.end.replace(tzinfo=timezone.utc) == T0 - timedelta(seconds=20) and (r.end - r.start) == timedelta(seconds=10)


@pytest.mark.parametrize("version", [9, 10])
def test_templates_rates_and_waiting(spark, version):
    opt, rate = options(400, 10, version)
    raws = [
        message(data(300, ("10.0.0.1", 100, 1)), version=version),  # before its template: waits
        message(template(300, *FIELDS, version=version), version=version),
        message(data(300, ("10.0.0.2", 200, 2), ("10.0.0.3", 300, 3)), version=version),
        message(data(301, ("10.0.0.9", 1, 1)), version=version),  # never described
        message(opt, rate, version=version),
        b"\0\x0a\0\1",
    ]
    batch = netflow.records(grams(spark, raws)).orderBy("bytes").collect()
    assert [(r.src, r.bytes, r.packets, r.sampling, r.sampling_known) for r in batch] == [("10.0.0.1", 100, 1, 10, True), ("10.0.0.2", 200, 2, 10, True), ("10.0.0.3", 300, 3, 10, True)]
    if version == 9:
        assert batch[0].end.replace(tzinfo=timezone.utc) == T0 - timedelta(seconds=20)
    session, got = netflow.Session(), []
    for i, raw in enumerate(raws[:-1]):
        got += session.take(raw, "10.9.9.9", float(i))
    assert sorted((r["src"], r["bytes"], r["mult"]) for r in got) == [("10.0.0.1", 100, 10.0), ("10.0.0.2", 200, 10.0), ("10.0.0.3", 300, 10.0)]


def test_a_template_that_changes_holds_from_then_on(spark):
    short = [(8, 4), (12, 4), (1, 4)]
    d = struct.pack("!HH4s4sI", 300, 16, ip4("10.0.0.5"), ip4("192.0.2.7"), 777)
    raws = [message(template(300, *FIELDS)), message(data(300, ("10.0.0.1", 100, 1))), message(template(300, *short)), message(d), message(template(300, *short)), message(d)]
    assert sorted((r.src, r.bytes) for r in netflow.records(grams(spark, raws)).collect()) == [("10.0.0.1", 100), ("10.0.0.5", 777), ("10.0.0.5", 777)]


def test_running_totals(spark):
    t = template(300, (8, 4), (12, 4), (85, 4), (86, 4), (150, 4), (151, 4))
    d = lambda b, p, start=50: struct.pack("!HH4s4sIIII", 300, 28, ip4("10.0.0.1"), ip4("192.0.2.7"), b, p, start, 60)
    raws = [message(t), message(d(100, 1)), message(d(250, 3)), message(d(250, 3)), message(d(40, 1)), message(d(70, 2, 55))]
    assert sorted(r.bytes for r in netflow.records(grams(spark, raws)).collect()) == [40, 70, 100, 150]
    session = netflow.Session()
    assert sorted(r["bytes"] for i, raw in enumerate(raws) for r in [*session.take(raw, "e", float(i)), *session._rated([], 1e6 + i)]) == [40, 70, 100, 150]


def test_hostile_sets_never_raise():
    import random

    rng = random.Random(3)
    base = message(template(300, *FIELDS), data(300, ("10.0.0.1", 1, 1)), version=10)
    for _ in range(3000):
        raw = bytearray(base)
        for _ in range(rng.randint(1, 8)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        raw = bytes(raw[: rng.randint(2, len(raw))])
        try:
            netflow.Session().take(raw, "e", 0.0)
        except (ValueError, struct.error, KeyError):
            pass
        try:
            sflow.decode(raw)
        except (ValueError, struct.error):
            pass


def pcap(*packets, link=1):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for us, data in packets:
        out += struct.pack("<IIII", us // 10**6, us % 10**6, len(data), len(data)) + data
    return out


def pcapng(*packets):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body) + -len(body) % 4) + body + bytes(-len(body) % 4) + struct.pack("<I", 12 + len(body) + -len(body) % 4)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9))
    for us, data in packets:
        ns = us * 1000
        out += block(6, struct.pack("<IIIII", 0, ns >> 32, ns & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


def test_capture_files_and_flows(spark, tmp_path):
    us = int(T0.timestamp()) * 10**6
    there, back = frame(tcp4()), frame(tcp4("192.0.2.7", "10.0.0.1", 443, 50000, 0x12))
    more = [(us + k * 10_000_000, frame(tcp4(flags=0x10))) for k in range(1, 10)]  # never idle: cut every minute
    packets = [(us, there), (us + 1000, back), *more, (us + 200_000_000, there), (us + 200_000_001, frame(b"", kind=0x0806))]
    (tmp_path / "a.pcap").write_bytes(pcap(*packets) + b"cut")
    (tmp_path / "b.pcapng").write_bytes(pcapng(*packets))
    (tmp_path / "c.pcap").write_bytes(b"\x1f\x8bgzip")
    p = capture.read(spark, str(tmp_path))
    assert p.count() == 2 * 12
    got = sorted((r.start.replace(tzinfo=timezone.utc), r.src, r.packets, r.bytes, r.opener) for r in capture.flows(p.where("path like '%pcapng'")).collect())
    size = len(there) + 4
    assert got == [(T0, "10.0.0.1", 6, 6 * size, 1), (T0 + timedelta(milliseconds=1), "192.0.2.7", 1, size, -1), (T0 + timedelta(seconds=60), "10.0.0.1", 4, 4 * size, 1), (T0 + timedelta(seconds=200), "10.0.0.1", 1, size, 1)]
    rows = ingest.flow_rows(capture.flows(p), T0 + timedelta(days=1))
    assert {r.client for r in rows.collect()} == {"10.0.0.1"} and rows.where("app <> 'HTTPS'").count() == 0


def test_inventory():
    inv = files.Inventory.parse("""
# ours
net 10.0.0.0/8 All of it
net 10.1.0.0/16 Office LAN country=jp
device 192.0.2.1 Core router room=Room_1 rack=A03 sampling=1:100
device 192.0.2.2 Edge unsampled
iface 192.0.2.1 3 Uplink A speed=1000000000 isp=Some_Carrier circuit=X-1 default
host 10.1.0.5 File server
snmp 192.0.2.1 public 198.51.100.1:1161
""")
    assert inv.nets == [("10.0.0.0/8", "All of it", ""), ("10.1.0.0/16", "Office LAN", "JP")]
    assert inv.devices[0] == ("192.0.2.1", "Core router", "Room 1", "A03", False, 100) and inv.rates() == {"192.0.2.1": 100, "192.0.2.2": 1}
    assert inv.ifaces == [("192.0.2.1", 3, "Uplink A", 10**9, "Some Carrier", "X-1", "", True)]
    assert inv.snmp == [("192.0.2.1", "198.51.100.1:1161", "public")]
    for bad in ("net 10.0.0.0/8", "net 10.0.0.0 x", "device nowhere x", "iface 10.0.0.1 x y", "what 1 2", "net 10.0.0.0/8 x country=JPN", "device 10.0.0.1 x sampling=0"):
        with pytest.raises(ValueError, match="line 1"):
            files.Inventory.parse(bad)


def test_ranges_lists_and_longest_prefix(spark, tmp_path):
    (tmp_path / "asn.tsv").write_text("198.51.100.0\t198.51.100.255\t64501\tDE\tExample\n198.51.0.0\t198.51.255.255\t64500\tNone\tWide\n203.0.113.0\t203.0.113.255\t0\tXX\tnone\n2001:db8::\t2001:db8:ffff:ffff:ffff:ffff:ffff:ffff\t64502\tJP\tSix\nbroken\n")
    asns = files.asn_ranges(spark, str(tmp_path / "asn.tsv"))
    addr = spark.createDataFrame([(a,) for a in ("198.51.100.7", "198.51.7.7", "203.0.113.1", "2001:db8::5", "not one", None)], "addr string")
    got = {r.addr: (r.asn, r.cc, r.org) for r in ranges.asn_of(addr, asns).collect()}
    assert got == {"198.51.100.7": (64501, "DE", "Example"), "198.51.7.7": (64500, "", "Wide"), "2001:db8::5": (64502, "JP", "Six")}
    threats = files.threat_list(spark, {"a": "203.0.113.0/24 # net\n; nothing\n", "b": "203.0.113.1\n203.0.113.128/25\nrubbish"})
    addr = spark.createDataFrame([("203.0.113.1",), ("203.0.113.200",), ("10.0.0.1",)], "addr string")
    assert {r.addr: r.list for r in ranges.first_listed(addr, threats, ["list"]).collect()} == {"203.0.113.1": "b", "203.0.113.200": "a"}
    nets = ranges.networks(spark, [("10.0.0.0/8", "all"), ("10.1.0.0/16", "office"), ("10.1.0.0/16", "again"), ("::/0", "six")], "name string")
    addr = spark.createDataFrame([("10.1.2.3",), ("10.9.2.3",), ("192.0.2.1",), ("fe80::1",)], "addr string")
    assert {r.addr: r.name for r in ranges.longest_prefix(addr, nets, ["name"]).collect()} == {"10.1.2.3": "office", "10.9.2.3": "all", "fe80::1": "six"}
    blocked = spark.createDataFrame([("10.0.0.1",)], "addr string")
    grams_ = spark.createDataFrame([("10.0.0.1", 1), ("10.0.0.2", 2)], "exporter string, n int")
    assert [r.n for r in files.not_blocked(grams_, blocked).collect()] == [2]


def mmdb(entries, version=4, size=24):
    """entries: (prefix bits as text, record)."""
    def value(v):
        if isinstance(v, str):
            n = len(v)
            return (bytes([0x40 | n]) if n < 29 else bytes([0x40 | 29, n - 29])) + v.encode()
        if isinstance(v, int):
            raw = v.to_bytes(4)
            return bytes([0xC0 | 4]) + raw
        return bytes([0xE0 | len(v)]) + b"".join(value(k) + value(x) for k, x in v.items())

    tree, records, offsets = [[None, None]], b"", []
    for bits, record in entries:
        offsets.append(len(records))
        records += value(record)
        node = 0
        for k, bit in enumerate(bits):
            if k == len(bits) - 1:
                tree[node][int(bit)] = ("data", offsets[-1])
            else:
                if tree[node][int(bit)] is None:
                    tree.append([None, None])
                    tree[node][int(bit)] = ("node", len(tree) - 1)
                node = tree[node][int(bit)][1]
    n = len(tree)
    number = lambda c: n if c is None else c[1] if c[0] == "node" else n + 16 + c[1]
    pack = {24: lambda a, b: a.to_bytes(3) + b.to_bytes(3), 28: lambda a, b: (a & 0xFFFFFF).to_bytes(3) + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3), 32: lambda a, b: a.to_bytes(4) + b.to_bytes(4)}[size]
    out = b"".join(pack(number(a), number(b)) for a, b in tree)
    return out + bytes(16) + records + files.MaxMind.MARK + value({"node_count": n, "record_size": size, "ip_version": version})


@pytest.mark.parametrize("size", [24, 28, 32])
def test_maxmind(spark, tmp_path, size):
    raw = mmdb([("00001010", {"country": {"iso_code": "DE"}}), ("1100011000110011", {"autonomous_system_number": 64500, "autonomous_system_organization": "Ex"}), ("01", {"asn": "AS77", "as_name": "Flat", "country_code": "JP"})], size=size)
    got = list(files.MaxMind(raw).ranges())
    assert got == [("40a000000", "40affffff", 0, "DE", ""), ("440000000", "47fffffff", 77, "JP", "Flat"), ("4c6330000", "4c633ffff", 64500, "", "Ex")]
    (tmp_path / "x.mmdb").write_bytes(raw)
    addr = spark.createDataFrame([("10.1.1.1",), ("198.51.3.3",)], "addr string")
    assert {r.addr: (r.asn, r.cc) for r in ranges.asn_of(addr, files.maxmind_ranges(spark, str(tmp_path / "x.mmdb"), 1)).collect()} == {"10.1.1.1": (0, "DE"), "198.51.3.3": (64500, "")}
    with pytest.raises(ValueError):
        files.MaxMind(b"nothing")
