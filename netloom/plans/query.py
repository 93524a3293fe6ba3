"""A query: a half-open range of time, conditions that all must hold, and the clock that buckets are cut on."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

HOUR = timedelta(hours=1)
LONG_RANGE = 6 * HOUR
STEPS = [timedelta(minutes=m) for m in (1, 5, 15, 60, 180, 360, 1440)]
MOST_POINTS, MOST_FILTERS = 300, 20
# The named ranges in minutes, the directions, and the protocols known by name.
RANGES = {"5m": 5, "15m": 15, "30m": 30, "1h": 60, "6h": 360, "12h": 720, "24h": 1440, "7d": 10080, "30d": 43200}
DIRECTIONS = {"outbound": 1, "inbound": 2, "internal": 3, "transit": 4}
PROTOCOLS = {"icmp": 1, "igmp": 2, "ipip": 4, "tcp": 6, "udp": 17, "ipv6": 41, "gre": 47, "esp": 50, "ah": 51, "icmpv6": 58, "ospf": 89, "sctp": 132}


@dataclass(frozen=True)
class Filter:
    field: str
    value: str
    neg: bool = False


def utc(t: datetime) -> datetime:
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def trunc(t: datetime, step: timedelta, offset: timedelta = timedelta()) -> datetime:
    """The start of t's bucket on a clock that is offset ahead of UTC."""
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    passed = utc(t) - epoch + offset
    return epoch + passed // step * step - offset


def step_for(span: timedelta) -> timedelta:
    """The finest step with at most 300 points."""
    return next((s for s in STEPS if span // s <= MOST_POINTS), STEPS[-1])


def bucket_count(start: datetime, to: datetime, step: timedelta) -> int:
    """Buckets from start to to; a last one of less than 15 seconds is left out."""
    n = (to - start) // step + 1
    return n - 1 if n > 1 and to - (start + (n - 1) * step) < timedelta(seconds=15) else n


def bucket_seconds(start: datetime, i: int, step: timedelta, to: datetime, data_from: datetime | None, now: datetime) -> float:
    """Seconds of bucket i that data can cover: cut by the start of the data and the end of the range.

    A range that ended more than two minutes before now counts its last minute whole.
    """
    b = start + i * step
    end = to
    if now - to > timedelta(minutes=2) and trunc(to, STEPS[0]) < to:
        end = trunc(to, STEPS[0]) + STEPS[0]
    e = min(b + step, end)
    if data_from is not None and b < data_from < e:
        b = data_from
    return max(1.0, (e - b).total_seconds())


def settled_to(to: datetime, now: datetime, settle: timedelta, rollup: bool) -> datetime:
    """The moment up to which a range's data is complete; a range in the past is so throughout."""
    settle += STEPS[0] if rollup else timedelta()
    if now - to > settle + timedelta(minutes=2):
        return to
    done = trunc(now - settle, STEPS[0]) if settle > timedelta(seconds=5) else now
    return min(done, to)


def _number(v: str, what: str) -> int:
    if not re.fullmatch(r"-?\d+", v):
        raise ValueError(f"bad {what} {v!r}")
    return int(v)


def plain_address(v: str) -> str:
    a = ipaddress.ip_address(v)
    return str(a.ipv4_mapped or a) if a.version == 6 else str(a)


def _hosts(f: Filter, sides: list[str]) -> Column:
    v = f.value.strip()
    net = None
    try:
        net = ipaddress.ip_network(v, strict=False)
    except ValueError:
        pass
    if net is not None and net.num_addresses > 1:
        if net.version == 6:
            raise ValueError(f"IPv6 prefixes can't be filtered by: {v}")
        number = {"client": "cli4", "server": "srv4"}
        parts = [F.col(number[s]).between(int(net[0]), int(net[-1])) for s in sides]
    else:
        if net is not None:
            v = plain_address(str(net[0]))
        parts = [F.col(s) == v for s in sides]
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def _port(f: Filter) -> Column:
    port, _, name = f.value.strip().partition("/")
    c = F.col("svc_port") == _number(port, "port")
    if name:
        c = c & (F.col("proto") == (PROTOCOLS[name.lower()] if name.lower() in PROTOCOLS else _number(name, "protocol")))
    return c


def _bytes(f: Filter) -> Column:
    src = F.when(F.col("src") == F.col("client"), F.col("cli_int")).otherwise(F.col("srv_int"))
    dst = F.when(F.col("dst") == F.col("client"), F.col("cli_int")).otherwise(F.col("srv_int"))
    if f.value not in ("in", "out"):
        raise ValueError(f"bad byte direction {f.value!r}")
    return ~src & dst if f.value == "in" else src & ~dst


def _interface(f: Filter) -> Column:
    device, slash, index = f.value.strip().rpartition("/")
    if not slash or not device:
        raise ValueError(f"bad interface {f.value!r}")
    n = _number(index, "interface")
    side = {"iface_in": F.col("in_if") == n, "iface_out": F.col("out_if") == n}.get(f.field, (F.col("in_if") == n) | (F.col("out_if") == n))
    return (F.col("exporter") == device) & side


def _country(f: Filter) -> Column:
    v = f.value.strip()
    if v.lower() == "__internal__":
        return F.col("dir") == DIRECTIONS["internal"]
    if v.lower() == "__unknown__":
        return (F.col("peer_cc") == "") & (F.col("dir") != DIRECTIONS["internal"])
    return F.col("peer_cc") == v.upper()


def _direction(f: Filter) -> Column:
    if f.value.strip() not in DIRECTIONS:
        raise ValueError(f"bad direction {f.value!r}")
    return F.col("dir") == DIRECTIONS[f.value.strip()]


def _protocol(f: Filter) -> Column:
    v = f.value.strip().lower()
    return F.col("proto") == (PROTOCOLS[v] if v in PROTOCOLS else _number(v, "protocol"))


def _equal(f: Filter) -> Column:
    return F.col(f.field) == f.value.strip()


def _whole(f: Filter) -> Column:
    return F.col(f.field) == _number(f.value.strip(), f.field)


FIELDS = {
    "ip": lambda f: _hosts(f, ["client", "server"]), "client": lambda f: _hosts(f, ["client"]), "server": lambda f: _hosts(f, ["server"]),
    "src": lambda f: F.col("src") == plain_address(f.value.strip()), "dst": lambda f: F.col("dst") == plain_address(f.value.strip()),
    "port": _port, "app": _equal, "exporter": _equal, "segment": _equal, "threat": _equal, "country": _country,
    "asn": lambda f: F.col("peer_asn") == _number(re.sub(r"^as", "", f.value.strip(), flags=re.I), "AS"),
    "proto": _protocol, "dir": _direction, "bytes": _bytes, "encap": _whole, "vlan": _whole,
    "iface": _interface, "iface_in": _interface, "iface_out": _interface,
}


def condition(f: Filter) -> Column:
    """The filter as a column; ValueError for an unknown field or a value it can't have."""
    if f.field not in FIELDS:
        raise ValueError(f"unknown filter field {f.field!r}")
    c = FIELDS[f.field](f)
    return ~c if f.neg else c


@dataclass(frozen=True)
class Query:
    start: datetime
    end: datetime
    filters: tuple[Filter, ...] = ()
    include_dup: bool = False
    offset: timedelta = field(default_factory=timedelta)

    def __post_init__(self) -> None:
        object.__setattr__(self, "start", utc(self.start))
        object.__setattr__(self, "end", utc(self.end))
        object.__setattr__(self, "filters", tuple(self.filters))
        if len(self.filters) > MOST_FILTERS:
            raise ValueError("too many filters")

    @property
    def span(self) -> timedelta:
        return self.end - self.start

    def one_device(self) -> bool:
        """Within one device or interface its repeats of other devices' traffic are its own traffic and count."""
        return any(not f.neg and (f.field == "exporter" or f.field.startswith("iface")) for f in self.filters)

    def in_range(self, ts: str = "ts") -> Column:
        return (F.col(ts) >= F.lit(self.start)) & (F.col(ts) < F.lit(self.end))

    def where(self) -> Column:
        c = self.in_range()
        if not self.include_dup and not self.one_device():
            c = c & ~F.col("dup")
        for f in self.filters:
            c = c & condition(f)
        return c

    def bucket(self, step: timedelta, ts: str = "ts") -> Column:
        """Start of a row's bucket on the viewer's clock, as epoch seconds."""
        s, off = int(step.total_seconds()), int(self.offset.total_seconds())
        at = F.unix_seconds(F.col(ts)) + off
        return at - F.pmod(at, F.lit(s)) - off

    def trunc(self, t: datetime, step: timedelta) -> datetime:
        return trunc(t, step, self.offset)

    def aligned(self, step: timedelta) -> Query:
        return replace(self, start=self.trunc(self.start, step))

    def shifted(self, by: timedelta) -> Query:
        return replace(self, start=self.start + by, end=self.end + by)

    def also(self, *filters: Filter) -> Query:
        return replace(self, filters=(*self.filters, *filters))


def parse(now: datetime, range: str = "", start_ms: int | None = None, end_ms: int | None = None, filters: tuple[Filter, ...] = (), dup: bool = False, zone_minutes: int = 0) -> Query:
    """A query from what a caller names: a range that ends now, or a start and an end. Long ranges cover whole hours."""
    off = timedelta(minutes=zone_minutes) if abs(zone_minutes) <= 14 * 60 else timedelta()
    if start_ms is not None and end_ms is not None:
        if end_ms <= start_ms:
            raise ValueError("bad from/to")
        start, end = (datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=ms) for ms in (start_ms, end_ms))
        if end - start > LONG_RANGE:
            start = trunc(start, HOUR)
            end = end if trunc(end, HOUR) == end else trunc(end, HOUR) + HOUR
    else:
        if range and range not in RANGES:
            raise ValueError("bad range")
        span = timedelta(minutes=RANGES[range or "24h"])
        end = utc(now)
        start = trunc(end - span, HOUR) if span > LONG_RANGE else end - span
    return Query(start, end, filters, dup, off)
