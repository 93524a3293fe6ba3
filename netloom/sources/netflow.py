"""NetFlow version 5, and template-driven NetFlow version 9 and IPFIX.

Version 5 is stateless.  For the others a batch is read in three steps, none of which walks an exporter's datagrams in one
task: sets are cut out of the datagrams; templates become versions with the span of arrivals they hold for; data sets meet
the version that held when they came (or, if none had come yet, the first that came soon after) and are decoded on their
own.  Sampling rates that exporters declare are versions of the same kind.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.core.arrow import rows_mapped
from netloom.core.shared import cut
from netloom.sources import packet
from netloom.sources.wire import Fields, Short

# Sources of records, the enterprise of reversed elements, seconds from 1900 to 1970.
NF5, NF9, IPFIX = 2, 3, 4
REVERSE, NTP = 29305, 2_208_988_800
#: Seconds that sets wait for a template and records for a rate.
HOLD_S = 300
# Information elements by number.
ELEMENTS = {
    1: "octets", 2: "packets", 4: "proto", 5: "tos", 6: "tcp_flags", 7: "src_port", 8: "src4", 10: "in_if", 11: "dst_port", 12: "dst4", 14: "out_if", 16: "src_as", 17: "dst_as", 21: "end_up", 22: "start_up",
    23: "post_octets", 24: "post_packets", 27: "src6", 28: "dst6", 32: "icmp", 34: "interval", 48: "sampler", 50: "interval", 58: "vlan", 61: "direction", 85: "total_octets", 86: "total_packets", 139: "icmp",
    150: "start_s", 151: "end_s", 152: "start_ms", 153: "end_ms", 154: "start_ntp", 155: "end_ntp", 156: "start_ntp", 157: "end_ntp", 158: "start_delta", 159: "end_delta", 160: "init_ms",
    231: "init_octets", 232: "resp_octets", 243: "vlan", 298: "init_packets", 299: "resp_packets", 302: "sampler", 305: "every", 306: "space", 309: "size", 310: "population", 311: "probability",
}
REVERSED = {1: "rev_octets", 2: "rev_packets"}


# -- version 5
def decode5(raw: bytes) -> list[dict]:
    f = Fields(raw)
    _, count, uptime, secs, nanos, seq, engine, slot, sampling = f.read("HHIIIIBBH")
    if f.left() < count * 48:
        raise Short("records truncated")
    export, declared = secs * 1000 + nanos // 1_000_000, sampling & 0x3FFF  # 0: no rate was declared
    out = []
    for _ in range(count):
        src, dst, _, inward, outward, pkts, size, first, last, sp, dp, _, flags, proto, tos, sa, da, _, _, _ = f.read("4s4s4sHHIIIIHHBBBBHHBBH")
        src, dst = packet.text4(src), packet.text4(dst)
        ago = lambda up: export - (uptime - up & 0xFFFFFFFF)
        out.append({
            "start_ms": ago(first), "end_ms": ago(last), "src": src, "dst": dst, "src_port": sp, "dst_port": dp, "proto": proto, "tcp_flags": flags, "tos": tos, "bytes": size, "packets": pkts, "in_if": inward, "out_if": outward,
            "vlan": 0, "encap": packet.tunnel(proto, dp, False), "direction": 0, "src_as": sa, "dst_as": da, "domain": engine << 8 | slot, "rate": declared, "source": NF5, "seq": seq, "sampler": -1, "running": False, "known_start": True,
        })
    return out


# -- templates
@dataclass
class Template:
    fields: list[tuple[int, int, int, bool]]  # element, enterprise, length, in the scope
    options: bool = False
    nf9: bool = False  # scopes are kinds of scope, not elements

    def spec(self) -> str:
        return f"{int(self.options)}{int(self.nf9)};" + ",".join(f"{i}:{e}:{n}:{int(s)}" for i, e, n, s in self.fields)

    @staticmethod
    def of(spec: str) -> Template:
        head, _, rest = spec.partition(";")
        fields = [(int(i), int(e), int(n), s == "1") for i, e, n, s in (x.split(":") for x in rest.split(",") if x)]
        return Template(fields, head[0] == "1", head[1] == "1")


def templates_of(body: bytes, version: int, options: bool) -> list[tuple[int, Template | None]]:
    """(id, template) of a template set; None where IPFIX withdraws one. Reading stops at what makes no sense."""
    f, out = Fields(body), []
    try:
        while f.left() >= 4:
            tid = f.u16()
            if version == 9 and options:
                scope, own = f.read("HH")
                if tid < 256:
                    break
                fields = [(*f.read("HH"), True) for _ in range(scope // 4)] + [(*f.read("HH"), False) for _ in range(own // 4)]
                out.append((tid, Template([(i, 0, n, s) for i, n, s in fields], True, True)))
                continue
            count = f.u16()
            if tid < 256:
                break
            if count == 0:
                if version != 10:
                    break
                out.append((tid, None))
                continue
            scopes = f.u16() if options else 0
            fields = []
            for k in range(count):
                i, n = f.read("HH")
                ent = f.u32() if version == 10 and i & 0x8000 else 0
                fields.append((i & 0x7FFF if version == 10 else i, ent, n, k < scopes))
            out.append((tid, Template(fields, options)))
    except Short:
        pass
    return out


def sets_of(raw: bytes) -> tuple[dict, list[tuple[int, bytes]]]:
    """Header and (set id, body) of a version 9 or IPFIX message."""
    f = Fields(raw)
    version = f.u16()
    if version == 9:
        _, uptime, secs, seq, domain = f.read("HIIII")
    elif version == 10:
        length, secs, seq, domain = f.read("HIII")
        if not 16 <= length <= len(raw):
            raise ValueError("length mismatch")
        f.raw, uptime = raw[:length], 0
    else:
        raise ValueError(f"version {version}")
    head, out = {"version": version, "uptime": uptime, "secs": secs, "seq": seq, "domain": domain}, []
    while f.left() >= 4:
        sid, size = f.read("HH")
        if size < 4 or size - 4 > f.left():
            break
        out.append((sid, f.take(size - 4)))
    return head, out


# -- data
def values_of(t: Template, body: bytes) -> Iterator[dict]:
    """Named values of each record of a data set; a length of 65535 stands for one given in the record."""
    least = sum(1 if n == 0xFFFF else n for _, _, n, _ in t.fields)
    f = Fields(body)
    while least and f.left() >= least:
        v: dict = {}
        try:
            for i, ent, n, scope in t.fields:
                if n == 0xFFFF:
                    n = f.take(1)[0]
                    n = f.u16() if n == 255 else n
                raw = f.take(n)
                if scope and t.nf9:
                    if i == 2:
                        v["scope_if"] = int.from_bytes(raw)
                    continue
                name = (ELEMENTS if ent == 0 else REVERSED if ent == REVERSE else {}).get(i)
                if name is None:
                    continue
                if name in ("src4", "dst4", "src6", "dst6"):
                    if n == (4 if name.endswith("4") else 16):
                        v[name[:3]] = packet.text4(raw) if n == 4 else packet.text6(raw)
                    continue
                if name == "probability":
                    p = struct.unpack("!d", raw)[0] if n == 8 else 0
                    if 0 < p <= 1:
                        v[name] = p
                    continue
                x = int.from_bytes(raw)
                if name in ("interval", "vlan") and (x == 0 or (name == "vlan" and v.get("vlan"))):
                    continue  # two elements may say it; a zero in one doesn't hide the other
                v[name] = x & 0xFFF if name == "vlan" else x
                if name == "in_if" and scope:
                    v["scope_if"] = x
        except Short:
            return
        yield v


def rate_of(v: dict) -> int:
    """One in how many packets is sampled, from whichever elements say so; 0 if none does."""
    if v.get("every"):
        return (v["every"] + v.get("space", 0)) // v["every"]
    if v.get("size") and v.get("population"):
        return v["population"] // v["size"]
    return v.get("interval") or (round(1 / v["probability"]) if v.get("probability") else 0)


def span_of(v: dict, head: dict) -> tuple[int, int, bool]:
    """Start and end in epoch milliseconds, and whether the exporter gave the start; by the best clock there is."""
    export = head["secs"] * 1000
    ntp = lambda x: ((x >> 32) - NTP) * 1000 + ((x & 0xFFFFFFFF) * 1000 >> 32)
    start = v.get("start_ms") or v.get("start_s", 0) * 1000 or (ntp(v["start_ntp"]) if "start_ntp" in v else 0)
    end = v.get("end_ms") or v.get("end_s", 0) * 1000 or (ntp(v["end_ntp"]) if "end_ntp" in v else 0)
    known = bool(end > 0 and start > 0) or "end_delta" in v or "start_delta" in v or ("end_up" in v and "start_up" in v)
    if end > 0:
        start = start or end
    elif "start_delta" in v or "end_delta" in v:
        start, end = export - v.get("start_delta", 0) // 1000, export - v.get("end_delta", 0) // 1000
    elif "end_up" in v and head["version"] == 9:
        up = lambda x: export - (head["uptime"] - x & 0xFFFFFFFF)
        end = up(v["end_up"])
        start = up(v["start_up"]) if "start_up" in v else end
    elif "end_up" in v and (v.get("init_ms") or head.get("init_ms")):
        boot = v.get("init_ms") or head["init_ms"]
        end = boot + v["end_up"]
        start = boot + v["start_up"] if "start_up" in v else end
    elif "end_up" in v and "start_up" in v:
        end = export
        start = end - (v["end_up"] - v["start_up"] & 0xFFFFFFFF)
    else:
        start = end = export
    return min(start, end), end, known


def records_of(v: dict, head: dict) -> list[dict]:
    """Records of one data record: the flow, and its reverse where both directions are reported. Counts are taken from
    deltas, else from initiator and responder, else from those after the device, else from running totals."""
    if "src" not in v or "dst" not in v:
        return []
    start, end, known = span_of(v, head)
    back, running = (v.get("rev_octets", 0), v.get("rev_packets", 0)), False
    if "octets" in v:
        size, pkts = v["octets"], v.get("packets", 0)
    elif v.get("init_octets") or v.get("resp_octets"):
        size, pkts, back = v.get("init_octets", 0), v.get("init_packets", 0), (v.get("resp_octets", 0), v.get("resp_packets", 0))
    elif v.get("post_octets"):
        size, pkts = v["post_octets"], v.get("post_packets", 0)
    else:
        size, pkts, running = v.get("total_octets", 0), v.get("total_packets", 0), True
    dport = v.get("dst_port", 0) or v.get("icmp", 0)
    proto = v.get("proto", 0) & 255
    one = {
        "start_ms": start, "end_ms": end, "src": v["src"], "dst": v["dst"], "src_port": v.get("src_port", 0) & 0xFFFF, "dst_port": dport & 0xFFFF, "proto": proto, "tcp_flags": v.get("tcp_flags", 0) & 255, "tos": v.get("tos", 0) & 255,
        "bytes": size, "packets": pkts, "in_if": v.get("in_if", 0), "out_if": v.get("out_if", 0), "vlan": v.get("vlan", 0), "encap": packet.tunnel(proto, dport, ":" in v["src"]), "direction": v.get("direction", 255) & 255,
        "src_as": v.get("src_as", 0), "dst_as": v.get("dst_as", 0), "domain": head["domain"], "rate": rate_of(v), "source": NF9 if head["version"] == 9 else IPFIX, "seq": head["seq"], "sampler": v.get("sampler", -1), "running": running, "known_start": known,
    }
    out = [one] if size or pkts else []
    if any(back):
        swapped = {a: one[b] for x, y in (("src", "dst"), ("src_port", "dst_port"), ("in_if", "out_if"), ("src_as", "dst_as")) for a, b in ((x, y), (y, x))}
        out.append(one | swapped | {"bytes": back[0], "packets": back[1], "running": False})
    return out


# -- batches of datagrams
RECORD = (
    "start_ms long, end_ms long, src string, dst string, src_port int, dst_port int, proto short, tcp_flags short, tos short, bytes long, packets long, in_if long, out_if long, vlan int, encap short, direction short, "
    "src_as long, dst_as long, domain long, rate long, source short, seq long, sampler long, running boolean, known_start boolean, exporter string, arrived timestamp, arrival_seq long, error string"
)
#: Numbers that the records of a datagram take: two for each of its bytes at most, as a record has one at least and its reverse
#: counts as another.
NUMBERS = 1 << 17


def numbered(arrival_seq: Column, place: Column) -> Column:
    """The number of a record in order of arrival, from its datagram's (below 2**46) and its place there (below NUMBERS)."""
    return arrival_seq * NUMBERS + place


SETS = "exporter string, domain long, version int, uptime long, secs long, seq long, sid int, body binary, arrived timestamp, arrival_seq long, place int, error string"


def records5(datagrams: DataFrame) -> DataFrame:
    """Records of version 5 datagrams (payload, exporter, arrived, arrival_seq)."""

    def each(r: dict) -> list[dict]:
        try:
            got = decode5(r["payload"])
        except Exception as e:  # a hostile datagram must not reach further than its row
            got = [{"error": str(e)[:200]}]
        return [g | {k: r[k] for k in ("exporter", "arrived", "arrival_seq")} | {"nth": i} for i, g in enumerate(got)]

    return rows_mapped(datagrams.select("payload", "exporter", "arrived", "arrival_seq"), each, RECORD + ", nth int")


def message_sets(datagrams: DataFrame) -> DataFrame:
    """Sets of version 9 and IPFIX datagrams, in the order they came: arrival_seq, place (the byte a set begins at)."""

    def each(r: dict) -> list[dict]:
        base = {k: r[k] for k in ("exporter", "arrived", "arrival_seq")}
        try:
            head, sets = sets_of(r["payload"])
        except Exception as e:
            return [base | {"error": str(e)[:200]}]
        at = {9: 20, 10: 16}[head["version"]]
        out = []
        for sid, body in sets:
            out.append(base | head | {"sid": sid, "body": body, "place": at})
            at += 4 + len(body)
        return out

    return rows_mapped(datagrams.select("payload", "exporter", "arrived", "arrival_seq"), each, SETS)


def versions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, since, until: spans of (arrival_seq, place) that a value holds for; repeats of the same value are one.

    since of the first is open; born is when it arrived, so that what came earlier can tell how long it would have waited.
    """
    order = F.struct("arrival_seq", "place", "nth")
    w = Window.partitionBy(*keys).orderBy("at")
    changes = rows.withColumn("at", order).withColumn("before", F.lag(value).over(w)).withColumn("first", F.row_number().over(w) == 1)
    changes = changes.where(F.col("first") | ~F.col(value).eqNullSafe(F.col("before")))
    w = Window.partitionBy(*keys).orderBy("at")
    return changes.select(*keys, value, F.when(~F.col("first"), F.col("at")).alias("since"), F.lead("at").over(w).alias("until"), F.col("arrived").alias("born"))


def _holds(at: Column) -> Column:
    early = F.col("since").isNull() & (F.unix_seconds("born") - F.unix_seconds("arrived") <= HOLD_S)
    return (early | (F.col("since") <= at)) & (F.col("until").isNull() | (at < F.col("until")))


TEMPLATE = "exporter string, domain long, version int, tid int, spec string, arrived timestamp, arrival_seq long, place int, nth int"


def template_versions(sets: DataFrame) -> DataFrame:
    def each(r: dict) -> list[dict]:
        options = r["sid"] == (1 if r["version"] == 9 else 3)
        base = {k: r[k] for k in ("exporter", "domain", "version", "arrived", "arrival_seq", "place")}
        return [base | {"tid": tid, "spec": t and t.spec(), "nth": k} for k, (tid, t) in enumerate(templates_of(r["body"], r["version"], options))]

    own = sets.where("(version = 9 and sid in (0, 1)) or (version = 10 and sid in (2, 3))")
    found = rows_mapped(own.select("exporter", "domain", "version", "sid", "body", "arrived", "arrival_seq", "place"), each, TEMPLATE)
    return versions(found, ["exporter", "domain", "version", "tid"], "spec")


DECODED = RECORD + ", option boolean, scope_if long, init_ms long, place int, nth int"


def decoded_sets(sets: DataFrame) -> DataFrame:
    """Records, and rows of options (rates and clocks), of the data sets whose template is known."""
    def each(r: dict) -> list[dict]:
        t, out = Template.of(r["spec"]), []
        head = {k: r[k] for k in ("version", "uptime", "secs", "seq", "domain")}
        base = {k: r[k] for k in ("exporter", "arrived", "arrival_seq", "place")} | {"option": t.options}
        try:
            for k, v in enumerate(values_of(t, r["body"])):
                if t.options:
                    out.append(base | {"nth": 2 * k, "domain": r["domain"], "rate": rate_of(v), "sampler": v.get("sampler", -1), "scope_if": v.get("scope_if", -1), "init_ms": v.get("init_ms", 0)})
                else:
                    out += [base | {"nth": 2 * k + j, "scope_if": -1, "init_ms": 0} | x for j, x in enumerate(records_of(v, head))]
        except Exception as e:
            out.append(base | {"error": str(e)[:200]})
        return out

    known = template_versions(sets).withColumnRenamed("tid", "sid")
    at = F.struct(F.col("d.arrival_seq"), F.col("d.place"), F.lit(0).alias("nth"))
    data = sets.where("sid >= 256")
    joined = data.alias("d").join(known, ["exporter", "domain", "version", "sid"]).where(_holds(at) & F.col("spec").isNotNull())
    cols = ["exporter", "domain", "version", "uptime", "secs", "seq", "body", "spec", "arrival_seq", "place"]
    return rows_mapped(joined.select(*cols, F.col("d.arrived").alias("arrived")), each, DECODED)


def with_rates(rows: DataFrame, manual: dict[str, int] | None = None) -> DataFrame:
    """Records with sampling, mult and sampling_known.

    The rate is the record's own, else that of its sampler, its interface in, its interface out, the exporter's, the only one
    the domain declares, the only one another domain of the device declares, or the one set by hand.  A rate that came up to
    five minutes later counts as well.  None at all: taken as not sampled, not known.
    """
    rows = cut(rows, "decoded")
    options = rows.where("option and rate > 0")
    domain = ["exporter", "domain"]

    def declared(part: DataFrame, keys: list[str]) -> DataFrame:
        return versions(part, keys, "rate").withColumnRenamed("rate", "found")

    flows = rows.where("not option and error is null").withColumn("_id", F.struct("arrival_seq", "place", "nth", "src"))

    def add(df: DataFrame, known: DataFrame, keys: list[str], match: dict[str, str], name: str) -> DataFrame:
        renamed = known.withColumnsRenamed(match)
        at = F.struct("f.arrival_seq", "f.place", "f.nth")
        early = F.col("since").isNull() & (F.unix_seconds("born") - F.unix_seconds("f.arrived") <= HOLD_S)
        cond = [F.col(f"f.{k}") == F.col(f"k.{k}") for k in keys]
        holds = (early | (F.col("since") <= at)) & (F.col("until").isNull() | (at < F.col("until")))
        every = cond[0]
        for c in [*cond[1:], holds]:
            every = every & c
        return df.alias("f").join(renamed.alias("k"), every, "left").select("f.*", F.col("k.found").alias(name))

    by_sampler = declared(options.where("sampler >= 0"), [*domain, "sampler"])
    by_if = declared(options.where("sampler < 0 and scope_if >= 0"), [*domain, "scope_if"])
    whole = declared(options.where("sampler < 0 and scope_if < 0"), domain)
    out = add(flows, by_sampler, [*domain, "sampler"], {}, "r_sampler")
    out = add(out, by_if, [*domain, "in_if"], {"scope_if": "in_if"}, "r_in")
    out = add(out, by_if, [*domain, "out_if"], {"scope_if": "out_if"}, "r_out")
    out = add(out, whole, domain, {}, "r_domain")
    only = options.groupBy(*domain).agg(F.min("rate").alias("lo"), F.max("rate").alias("hi")).where("lo = hi").select(*domain, F.col("lo").alias("r_only"))
    lent = only.groupBy("exporter").agg(F.min("r_only").alias("lo"), F.max("r_only").alias("hi")).where("lo = hi").select("exporter", F.col("lo").alias("r_lent"))
    out = out.join(only, domain, "left").join(lent, "exporter", "left")
    by_hand = F.lit(None).cast("long")
    for device, n in (manual or {}).items():
        by_hand = F.when(F.col("exporter") == device, n).otherwise(by_hand)
    rate = F.coalesce(*[F.nullif(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in ("rate", "r_sampler", "r_in", "r_out", "r_domain", "r_only", "r_lent")], by_hand)
    return out.select(*[c for c in flows.columns if c != "_id"], F.coalesce(rate, F.lit(1)).alias("sampling"), F.coalesce(rate, F.lit(1)).cast("double").alias("mult"), rate.isNotNull().alias("sampling_known"))


def running_deltas(rows: DataFrame) -> DataFrame:
    """Reports of running totals become the growth since the flow's report before; a total that fell is taken whole.

    A flow is its key, interfaces and start (none where the exporter gave none), so its reports are few.
    """
    start = F.when(F.col("known_start"), F.col("start_ms"))
    w = Window.partitionBy("exporter", "domain", "src", "dst", "src_port", "dst_port", "proto", "in_if", "out_if", "_s").orderBy("arrival_seq", "place", "nth")
    totals = rows.where("running").withColumn("_s", start).withColumn("_b", F.lag("bytes").over(w)).withColumn("_p", F.lag("packets").over(w))
    grew = (F.col("bytes") >= F.col("_b")) & (F.col("packets") >= F.col("_p"))
    totals = totals.withColumns({c: F.when(grew, F.col(c) - F.col(b)).otherwise(F.col(c)) for c, b in (("bytes", "_b"), ("packets", "_p"))})
    return rows.where("not running").unionByName(totals.drop("_s", "_b", "_p").where("bytes > 0 or packets > 0"))


#: Seconds of a window of losses, and the bounds of what they may raise the counts by.
LOSS_S, LEAST_RAISE, MOST_RAISE = 60, 1.005, 2.0
#: Records that a window must hold to be believed, and the largest gap that is taken for a loss.
ENOUGH, MOST_GAP = 100, 1 << 20


def losses(sets: DataFrame, counted: DataFrame) -> DataFrame:
    """exporter, domain, win, raise: by how much to raise counts for what sequence numbers show as lost, per minute.

    counted: data records per message (exporter, domain, arrival_seq, n).  IPFIX numbers records, version 9 messages, whose
    share of records is the window's average.  Under half a per cent counts as none; no more than double.
    """
    heads = sets.where("error is null").select("exporter", "domain", "version", "seq", "arrived", "arrival_seq").distinct()
    m = heads.join(counted, ["exporter", "domain", "arrival_seq"], "left").fillna(0, ["n"]).withColumn("win", F.floor(F.unix_seconds("arrived") / LOSS_S))
    w = Window.partitionBy("exporter", "domain", "win").orderBy("seq", "arrival_seq")
    unit = F.when(F.col("version") == 9, F.lit(1)).otherwise(F.col("n"))
    gaps = m.withColumn("gap", F.lead("seq").over(w) - F.col("seq") - unit)
    per = gaps.groupBy("exporter", "domain", "version", "win").agg(F.sum("n").alias("recv"), F.count("*").alias("messages"), F.coalesce(F.sum(F.when(F.col("gap").between(1, MOST_GAP), F.col("gap"))), F.lit(0)).alias("lost"))
    lost = F.when(F.col("version") == 9, F.col("lost") * F.col("recv") / F.col("messages")).otherwise(F.col("lost"))
    up = F.least((F.col("recv") + lost) / F.col("recv"), F.lit(MOST_RAISE))
    return per.select("exporter", "domain", "win", F.when((F.col("recv") >= ENOUGH) & (up >= LEAST_RAISE), up).otherwise(1.0).alias("raise"))


def records(datagrams: DataFrame, manual: dict[str, int] | None = None) -> DataFrame:
    """Records (see operators.ingest.RECORD) of version 5, 9 and IPFIX datagrams (payload, exporter, arrived, arrival_seq)."""
    kind = F.conv(F.hex(F.substring("payload", 1, 2)), 16, 10).cast("int")
    five = records5(datagrams.where(kind == 5)).where("error is null").select("*", F.lit(0).alias("place"), F.lit(False).alias("option"), F.lit(-1).cast("long").alias("scope_if"), F.lit(0).cast("long").alias("init_ms"))
    sets = cut(message_sets(datagrams.where(kind.isin(9, 10))), "sets")
    decoded = cut(decoded_sets(sets), "values")
    counted = decoded.groupBy("exporter", "domain", "arrival_seq").agg(F.count_distinct("place", F.expr("nth div 2")).alias("n"))
    rows = running_deltas(with_rates(decoded.unionByName(five.select(*decoded.columns)), manual).withColumn("place", F.col("place")))
    rows = rows.withColumn("win", F.floor(F.unix_seconds("arrived") / LOSS_S)).join(losses(sets, counted), ["exporter", "domain", "win"], "left")
    mult = F.col("mult") * F.coalesce("raise", F.lit(1.0))
    return rows.select(
        F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"), "src", "dst", "src_port", "dst_port", "proto", "tcp_flags", "tos", "bytes", "packets", F.lit(False).alias("l2"), F.lit(0).cast("short").alias("l2_hdr"),
        "sampling", mult.alias("mult"), "sampling_known", "in_if", "out_if", "vlan", "encap", "direction", F.lit(0).cast("short").alias("opener"), "src_as", "dst_as", "exporter", "domain", F.lit(0).cast("long").alias("observation"), "source",
        numbered(F.col("arrival_seq"), 2 * F.col("place") + F.col("nth")).alias("arrival_seq"), "arrived",
    )


# -- one exporter at a time, for streams
@dataclass
class Session:
    """What a stream keeps of one exporter: templates, rates, sets and records that wait, totals, sequence, by domain.

    Nothing is dropped for lack of room: what waits leaves after HOLD_S seconds of the exporter's own time, records as not
    sampled and sets that no template came for as rows with an error, so that they can be counted.  Totals are forgotten
    when a flow hasn't been heard of for TOTALS_S seconds; such a flow's next report counts whole.
    """

    templates: dict = field(default_factory=dict)  # (version, domain, id) -> spec
    rates: dict = field(default_factory=dict)  # (domain, kind, number) -> rate
    sets: dict = field(default_factory=dict)  # (version, domain, id) -> waiting: (arrived, head, body)
    waiting: deque = field(default_factory=deque)  # records without a rate, in order of arrival
    single: dict = field(default_factory=dict)  # domain -> the only rate declared there or else on the device, as far as asked for
    news: bool = False  # whether a rate has been declared since the waiting records were last looked at
    totals: dict = field(default_factory=dict)  # flow -> (arrived, bytes, packets), by the last time it was heard of
    clocks: dict = field(default_factory=dict)  # domain -> milliseconds of the device's start
    order: dict = field(default_factory=dict)  # domain -> Losses

    TOTALS_S = 3_600

    def take(self, raw: bytes, exporter: str, arrived: float) -> list[dict]:
        """Records that can be given out after this datagram."""
        if raw[:2] == b"\0\5":
            got = decode5(raw)
        else:
            head, sets = sets_of(raw)
            head["init_ms"] = self.clocks.get(head["domain"], 0)
            got, n = [], 0
            for sid, body in sets:
                found, count = self._set(sid, body, head, arrived)
                got, n = got + found, None if n is None or count is None else n + count
            self.order.setdefault(head["domain"], Losses()).take(head["version"], head["seq"], n, arrived)
        while self.totals and arrived - next(iter(self.totals.values()))[0] >= self.TOTALS_S:
            self.totals.pop(next(iter(self.totals)))
        for r in got:
            r.update(exporter=exporter, arrived=arrived)
        return self._rated([x for x in map(self._grown, got) if x], arrived)

    def _set(self, sid: int, body: bytes, head: dict, arrived: float) -> tuple[list[dict], int]:
        """Records, and how many data records the set itself holds (None if that can't be told)."""
        v, d = head["version"], head["domain"]
        own = {9: (0, 1), 10: (2, 3)}[v]
        if sid in own:
            out = []
            for tid, t in templates_of(body, v, sid == own[1]):
                if t is None:
                    self.templates.pop((v, d, tid), None)
                    continue
                self.templates[v, d, tid] = t.spec()
                for _, h, b in self.sets.pop((v, d, tid), []):
                    out += self._data(t, b, h)[0]
            return out, 0
        if sid < 256:
            return [], 0
        if (v, d, sid) not in self.templates:
            self.sets.setdefault((v, d, sid), []).append((arrived, head, body))
            return [], None
        return self._data(Template.of(self.templates[v, d, sid]), body, head)

    def _data(self, t: Template, body: bytes, head: dict) -> tuple[list[dict], int]:
        out, d, n = [], head["domain"], 0
        for v in values_of(t, body):
            n += 1
            if not t.options:
                out += records_of(v, head)
                continue
            if v.get("init_ms"):
                self.clocks[d] = v["init_ms"]
            if rate := rate_of(v):
                kind, number = ("sampler", v["sampler"]) if "sampler" in v else ("if", v["scope_if"]) if "scope_if" in v else ("all", 0)
                if self.rates.get((d, kind, number)) != rate:
                    self.rates[d, kind, number], self.single, self.news = rate, {}, True
        return out, n

    def _grown(self, r: dict) -> dict | None:
        if not r["running"]:
            return r
        key = (r["domain"], r["src"], r["dst"], r["src_port"], r["dst_port"], r["proto"], r["in_if"], r["out_if"], r["start_ms"] if r["known_start"] else None)
        _, b, p = self.totals.pop(key, (0, None, None))
        self.totals[key] = (r["arrived"], r["bytes"], r["packets"])
        if b is not None and r["bytes"] >= b and r["packets"] >= p:
            r = r | {"bytes": r["bytes"] - b, "packets": r["packets"] - p}
        return r if r["bytes"] or r["packets"] else None

    def rate(self, r: dict) -> int:
        d = r["domain"]
        if d not in self.single:
            own, every = {x for (dd, _, _), x in self.rates.items() if dd == d}, set(self.rates.values())
            self.single[d] = own.pop() if len(own) == 1 else every.pop() if len(every) == 1 else 0
        say = (r["rate"], self.rates.get((d, "sampler", r["sampler"])), self.rates.get((d, "if", r["in_if"])), self.rates.get((d, "if", r["out_if"])), self.rates.get((d, "all", 0)), self.single[d])
        return next((x for x in say if x), 0)

    def _rated(self, new: list[dict], arrived: float) -> list[dict]:
        """Records with a rate, raised by what is being lost; those without one when they have waited long enough. Those that
        wait are looked at again only when a rate has been declared."""
        out = []
        if self.news:
            new, self.waiting, self.news = [*self.waiting, *new], deque(), False

        def give(r: dict, rate: int) -> None:
            raised = self.order[r["domain"]].factor if r["source"] != NF5 and r["domain"] in self.order else 1.0
            out.append(r | {"sampling": rate or 1, "mult": (rate or 1) * raised, "sampling_known": bool(rate)})

        for r in new:
            rate = self.rate(r)
            if rate or r["source"] == NF5:
                give(r, rate)
            else:
                self.waiting.append(r)
        while self.waiting and arrived - self.waiting[0]["arrived"] >= HOLD_S:
            give(self.waiting.popleft(), 0)
        for key, held in list(self.sets.items()):
            gone = [s for s in held if arrived - s[0] >= HOLD_S]
            out += [{"arrived": at, "domain": key[1], "error": f"no template {key[2]} came"} for at, _, _ in gone]
            if len(gone) == len(held):
                del self.sets[key]
            elif gone:
                self.sets[key] = held[len(gone) :]
        return out


@dataclass
class Losses:
    """What the sequence numbers of a domain show as lost, by windows of LOSS_S seconds; a window's share raises the counts of
    the next one, as its own isn't known yet."""

    window: int | None = None
    due: int | None = None  # the sequence number expected next
    received: int = 0
    messages: int = 0
    lost: int = 0
    factor: float = 1.0

    def take(self, version: int, seq: int, n: int | None, arrived: float) -> None:
        """n: data records of the message, None if it holds some that can't be read yet."""
        now = int(arrived // LOSS_S)
        if self.window is not None and now != self.window:
            lost = self.lost * self.received / self.messages if version == 9 and self.messages else self.lost
            up = min((self.received + lost) / self.received, MOST_RAISE) if self.received >= ENOUGH else 1.0
            self.factor = up if up >= LEAST_RAISE else 1.0
            self.received = self.messages = self.lost = 0
        self.window = now
        gap = seq - self.due & 0xFFFFFFFF if self.due is not None else 0
        if 0 < gap <= MOST_GAP:
            self.lost += gap
        if gap <= MOST_GAP or self.due is None or self.due - seq & 0xFFFFFFFF > MOST_GAP:  # not one that was overtaken
            self.due = seq + 1 & 0xFFFFFFFF if version == 9 else None if n is None else seq + n & 0xFFFFFFFF
        self.received, self.messages = self.received + (n or 0), self.messages + 1
