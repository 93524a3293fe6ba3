"""Addresses as sortable keys, services, roles and the other per-row rules of the flow model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of services by transport and port, and of protocols.
TCP_SERVICES = {
    20: "FTP-data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 88: "Kerberos", 110: "POP3", 111: "RPC", 135: "MS-RPC", 139: "NetBIOS", 143: "IMAP", 179: "BGP",
    389: "LDAP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 514: "Syslog", 548: "AFP", 587: "SMTP-submission", 636: "LDAPS", 873: "rsync", 993: "IMAPS", 995: "POP3S", 1080: "SOCKS", 1194: "OpenVPN",
    1433: "MS-SQL", 1521: "Oracle", 1723: "PPTP", 1883: "MQTT", 2049: "NFS", 2375: "Docker", 2376: "Docker", 3128: "HTTP-proxy", 3260: "iSCSI", 3306: "MySQL", 3389: "RDP", 5060: "SIP", 5061: "SIP-TLS",
    5222: "XMPP", 5432: "PostgreSQL", 5671: "AMQPS", 5672: "AMQP", 5900: "VNC", 5985: "WinRM", 5986: "WinRM", 6379: "Redis", 6443: "Kubernetes", 8080: "HTTP-alt", 8443: "HTTPS-alt", 8883: "MQTTS",
    9000: "HTTP-alt", 9092: "Kafka", 9100: "Printer", 9200: "Elasticsearch", 11211: "Memcached", 27017: "MongoDB",
}
UDP_SERVICES = {
    53: "DNS", 67: "DHCP", 68: "DHCP", 69: "TFTP", 123: "NTP", 137: "NetBIOS", 138: "NetBIOS", 161: "SNMP", 162: "SNMP-trap", 443: "QUIC", 500: "IPsec", 514: "Syslog", 520: "RIP", 1194: "OpenVPN",
    1812: "RADIUS", 1813: "RADIUS", 1900: "SSDP", 2055: "NetFlow", 3478: "STUN", 3479: "STUN", 3480: "Teams", 4500: "IPsec-NAT", 4739: "IPFIX", 4789: "VXLAN", 5060: "SIP", 5353: "mDNS", 6081: "GENEVE",
    6343: "sFlow", 8801: "Zoom", 51820: "WireGuard",
}
PROTOCOL_NAMES = {1: "ICMP", 2: "IGMP", 4: "IPIP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 103: "PIM", 112: "VRRP", 132: "SCTP"}
TCP, UDP, SCTP = 6, 17, 132
# Addresses that are internal everywhere, as first and last key (see address_key).
SPECIAL = {
    "10.0.0.0/8": ("40a000000", "40affffff"), "172.16.0.0/12": ("4ac100000", "4ac1fffff"), "192.168.0.0/16": ("4c0a80000", "4c0a8ffff"), "100.64.0.0/10": ("464400000", "4647fffff"),
    "127.0.0.0/8": ("47f000000", "47fffffff"), "169.254.0.0/16": ("4a9fe0000", "4a9feffff"),
    "fc00::/7": ("6fc" + "0" * 30, "6fd" + "f" * 30), "fe80::/10": ("6fe8" + "0" * 29, "6feb" + "f" * 29), "::1/128": ("6" + "0" * 31 + "1", "6" + "0" * 31 + "1"),
}


def _lookup(table: dict[int, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key.cast("int"))


def ipv4_number(a: Column) -> Column:
    """The number of a dotted quad, 0 for any other address."""
    p = F.split(a, r"\.")
    n = sum((F.get(p, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(p, F.lit(0)).try_cast("long") * 256**3)
    return F.when(a.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), n).otherwise(F.lit(0).cast("long"))


def address_key(a: Column) -> Column:
    """'4' and 8 hex digits or '6' and 32: keys of one family sort as its addresses; null for what is no address."""
    v4 = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_number(a))), 8, "0"))
    halves = F.split(a, "::")
    words = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
    left = words(F.get(halves, F.lit(0)))
    right = F.when(F.size(halves) > 1, words(F.try_element_at(halves, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    full = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
    v6 = F.concat(F.lit("6"), F.lower(F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), "")))
    return F.when(a.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), v4).when(a.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") & (F.length(v6) == 33), v6)


def is_address(a: Column) -> Column:
    """Whether a text has the form of an address; one look at it, where address_key takes it apart."""
    return a.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:]*)$")


def special(key: Column) -> Column:
    """Whether an address key lies in a range that is internal everywhere. Give a column, not an expression: it is compared
    with every range."""
    inside = F.lit(False)
    for lo, hi in SPECIAL.values():
        inside = inside | key.between(lo, hi)
    return F.coalesce(inside, F.lit(False))


def known_service(proto: Column, port: Column) -> Column:
    return ((proto == TCP) & port.isin(list(TCP_SERVICES))) | ((proto == UDP) & port.isin(list(UDP_SERVICES)))


def ports_matter(proto: Column) -> Column:
    return proto.isin(TCP, UDP, SCTP)


def source_is_client() -> Column:
    """Whether the source of a record opened the conversation.

    TCP: the side seen to open it; else the flags, which tell only for a record of one packet.  Then the side whose port
    isn't a known service's; equal ports: the source; else the side with the higher port.  Other protocols: the source.
    """
    proto, sp, dp = F.col("proto"), F.col("src_port"), F.col("dst_port")
    flags = F.col("tcp_flags").cast("int").bitwiseAND(0x12)
    one = (proto == TCP) & (F.col("packets") == 1)
    sk, dk = known_service(proto, sp), known_service(proto, dp)
    return (
        F.when(~ports_matter(proto), True)
        .when((proto == TCP) & (F.col("opener") != 0), F.col("opener") > 0)
        .when(one & (flags == 0x02), True)
        .when(one & (flags == 0x12), False)
        .when(dk & ~sk, True)
        .when(sk & ~dk, False)
        .otherwise(dp <= sp)
    )


def app_name(proto: Column, port: Column) -> Column:
    name = F.coalesce(_lookup(PROTOCOL_NAMES, proto), proto.cast("string"))
    service = F.when(proto == TCP, _lookup(TCP_SERVICES, port)).when(proto == UDP, _lookup(UDP_SERVICES, port))
    return F.when(ports_matter(proto), F.coalesce(service, F.concat_ws("/", name, port.cast("string")))).otherwise(name)


def direction(cli_int: Column, srv_int: Column) -> Column:
    """1 outbound, 2 inbound, 3 internal, 4 transit."""
    return F.when(cli_int & srv_int, 3).when(cli_int, 1).when(srv_int, 2).otherwise(4).cast("short")


# Kinds of tunnel.
NO_TUNNEL, GRE, IPIP, SIX_IN_FOUR, SIX_IN_SIX, VXLAN, GENEVE, MPLS = range(8)


def encap_from_tuple() -> Column:
    """encap of a record, or where it names none the tunnel that the flow's key alone shows."""
    proto, dport = F.col("proto"), F.col("dst_port")
    seen = (
        F.when(proto == 47, GRE).when(proto == 4, IPIP)
        .when(proto == 41, F.when(F.col("src").contains(":"), SIX_IN_SIX).otherwise(SIX_IN_FOUR))
        .when((proto == UDP) & (dport == 4789), VXLAN).when((proto == UDP) & (dport == 6081), GENEVE).otherwise(NO_TUNNEL)
    )
    return F.when(F.coalesce(F.col("encap"), F.lit(0)) == NO_TUNNEL, seen).otherwise(F.col("encap")).cast("short")
