"""Headers of one packet: link layer, labels, IP, transport and the outermost tunnel."""

from __future__ import annotations

import ipaddress
import struct

from netloom.functions.net import GENEVE, GRE, IPIP, MPLS, NO_TUNNEL, SIX_IN_FOUR, SIX_IN_SIX, VXLAN

# Ethernet types, and transports by number.
TAGS, LABELS, IP4, IP6 = {0x8100, 0x88A8, 0x9100}, {0x8847, 0x8848}, 0x0800, 0x86DD
ICMP, TCP, UDP, GRE_PROTO, ICMP6, SCTP, IPV4_IN, IPV6_IN = 1, 6, 17, 47, 58, 132, 4, 41
TUNNEL_PORTS = {4789: VXLAN, 6081: GENEVE}
#: Extension headers looked through.
EXTENSIONS, FRAGMENT, MOST_EXTENSIONS = {0, 43, 60}, 44, 8
EMPTY = {"src": None, "dst": None, "src_port": 0, "dst_port": 0, "proto": 0, "tos": 0, "tcp_flags": 0, "vlan": 0, "encap": NO_TUNNEL, "l2_hdr": 0}


def text4(raw: bytes) -> str:
    return ".".join(map(str, raw))


def text6(raw: bytes) -> str:
    a = ipaddress.IPv6Address(raw)
    return str(a.ipv4_mapped or a)


def ethernet(b: bytes) -> dict | None:
    """Fields of a frame that holds an IP packet; None if it holds none."""
    out = dict(EMPTY)
    if len(b) < 14:
        return None
    kind, at = struct.unpack_from("!H", b, 12)[0], 14
    while kind in TAGS:
        if len(b) < at + 4:
            return None
        tag, kind = struct.unpack_from("!HH", b, at)
        out["vlan"] = out["vlan"] or tag & 0xFFF
        at += 4
    if kind in LABELS:
        bottom = False
        while not bottom:
            if len(b) < at + 4:
                return None
            bottom = bool(b[at + 2] & 1)
            at += 4
        out["encap"] = MPLS
    elif kind not in (IP4, IP6):
        return None
    out["l2_hdr"] = at if at <= 255 else 0
    wanted = {IP4: 4, IP6: 6}.get(kind)
    return ip(b[at:], out, wanted)


def ip(b: bytes, out: dict | None = None, version: int | None = None) -> dict | None:
    """Fields of an IP packet of the given version, or of the one its first bits name."""
    out = dict(EMPTY) if out is None else out
    named = b[0] >> 4 if b else 0
    if named not in (4, 6) or version not in (None, named):
        return None
    return _four(b, out) if named == 4 else _six(b, out)


def _four(b: bytes, out: dict) -> dict | None:
    head = (b[0] & 15) * 4
    if len(b) < 20 or head < 20:
        return None
    out.update(tos=b[1], proto=b[9], src=text4(b[12:16]), dst=text4(b[16:20]))
    first_part = not struct.unpack_from("!H", b, 6)[0] & 0x1FFF
    if first_part and len(b) >= head:
        _transport(b[head:], out, False)
    return out


def _six(b: bytes, out: dict) -> dict | None:
    if len(b) < 40:
        return None
    out.update(tos=struct.unpack_from("!H", b)[0] >> 4 & 0xFF, src=text6(b[8:24]), dst=text6(b[24:40]))
    kind, at = b[6], 40
    for _ in range(MOST_EXTENSIONS):
        if kind not in EXTENSIONS and kind != FRAGMENT:
            break
        if len(b) < at + 8:
            out["proto"] = kind
            return out
        if kind == FRAGMENT:
            offset, kind = struct.unpack_from("!H", b, at + 2)[0] >> 3, b[at]
            if offset:
                out["proto"] = kind
                return out
            at += 8
            continue
        size, kind = (b[at + 1] + 1) * 8, b[at]
        if len(b) < at + size:
            out["proto"] = kind
            return out
        at += size
    out["proto"] = kind
    _transport(b[at:], out, True)
    return out


def _transport(b: bytes, out: dict, outer6: bool) -> None:
    p = out["proto"]
    if p in (TCP, UDP, SCTP) and len(b) >= 4:
        out["src_port"], out["dst_port"] = struct.unpack_from("!HH", b)
    if p == TCP and len(b) >= 14:
        out["tcp_flags"] |= b[13]
    if p in (ICMP, ICMP6) and len(b) >= 2:
        out["dst_port"] = struct.unpack_from("!H", b)[0]  # type and code, as exporters do
    if out["encap"] == NO_TUNNEL:
        out["encap"] = tunnel(p, out["dst_port"], outer6)


def tunnel(proto: int, dst_port: int, outer6: bool) -> int:
    """Kind of tunnel that protocol and port show."""
    if proto == UDP:
        return TUNNEL_PORTS.get(dst_port, NO_TUNNEL)
    return {GRE_PROTO: GRE, IPV4_IN: IPIP, IPV6_IN: SIX_IN_SIX if outer6 else SIX_IN_FOUR}.get(proto, NO_TUNNEL)
