"""Records as exporters send them into one-minute flow rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.core.columns import address
from netloom.core.shared import cut
from netloom.functions import net
from netloom.operators import ranges

RECORD = (
    "start timestamp, end timestamp, src string, dst string, src_port int, dst_port int, proto short, tcp_flags short, tos short, bytes long, packets long, "
    "l2 boolean, l2_hdr short, sampling long, mult double, sampling_known boolean, in_if long, out_if long, vlan int, encap short, direction short, opener short, "
    "src_as long, dst_as long, exporter string, domain long, observation long, source short, arrival_seq long"
)
# What no device sends.
MOST_MULT, MOST_BYTES, MOST_PACKET, FIRST_YEAR = 1 << 24, 1 << 46, 512 << 10, 1990
OVERHEAD, TAG = 18, 4
MINUTE_US = 60_000_000
LONGEST_US, KEPT_US = 6 * 60 * MINUTE_US, 60 * MINUTE_US


def corrected_times(records: DataFrame, arrived: str = "arrived") -> DataFrame:
    """A record whose end is over two minutes ahead of its arrival, or over three hours behind, ended on arrival; its length
    is kept if a day at most."""
    off = (F.col("end") > F.col(arrived) + F.expr("interval 2 minutes")) | (F.col("end") < F.col(arrived) - F.expr("interval 3 hours"))
    length = F.unix_micros("end") - F.unix_micros("start")
    moved = F.when(length.between(0, 86_400_000_000), F.timestamp_micros(F.unix_micros(arrived) - length)).otherwise(F.col(arrived))
    return records.withColumn("start", F.when(off, moved).otherwise(F.col("start"))).withColumn("end", F.when(off, F.col(arrived)).otherwise(F.col("end")))


def plausible(now: datetime) -> Column:
    """Whether a record is one that a device can have sent; null sizes count as 0."""
    mult = F.when(F.coalesce(F.col("mult"), F.lit(0.0)) > 0, F.col("mult")).otherwise(F.lit(1.0))
    size, packets = F.coalesce("bytes", F.lit(0)), F.coalesce("packets", F.lit(0))
    time = lambda c: F.col(c).isNull() | ((F.year(c) >= FIRST_YEAR) & (F.col(c) < F.lit(now + timedelta(hours=48))))
    return (
        net.is_address(F.col("src")) & net.is_address(F.col("dst")) & time("start") & time("end")
        & (mult <= MOST_MULT) & (size * mult <= MOST_BYTES) & (packets * mult <= MOST_BYTES) & ((packets == 0) | (size <= packets * MOST_PACKET + packets - 1))
    )


def refused(records: DataFrame, now: datetime) -> DataFrame:
    """exporter, n: records of each that flow_rows leaves out as implausible."""
    clean = records.withColumns({c: address(F.col(c)) for c in ("src", "dst", "exporter")})
    return clean.where(~F.coalesce(plausible(now), F.lit(False))).groupBy("exporter").agg(F.count("*").alias("n"))


def normalised(records: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """Adds l3, wire and pkts, scaled by the sampling rate, whichever layer's bytes were counted.

    Frames: the header as read from the frame, or 18 bytes (22 with a tag), is taken off for l3.  Packets: overhead (and a
    tag's four bytes) is put on for wire.
    """
    mult = F.when(F.coalesce(F.col("mult"), F.lit(0.0)) > 0, F.col("mult")).otherwise(F.lit(1.0))
    out = records.withColumn("mult", mult).withColumn("p", F.coalesce("packets", F.lit(0)) * F.col("mult")).withColumn("b", F.coalesce("bytes", F.lit(0)) * F.col("mult"))
    tagged = F.coalesce(F.col("vlan"), F.lit(0)) != 0
    head = F.when(F.coalesce(F.col("l2_hdr"), F.lit(0)) != 0, F.col("l2_hdr") + 4.0).when(tagged, F.lit(18.0 + TAG)).otherwise(18.0)
    put = F.when(tagged, F.lit(float(overhead + TAG))).otherwise(float(overhead))
    l2 = F.coalesce(F.col("l2"), F.lit(False))
    return out.select(
        *[c for c in out.columns if c not in ("p", "b")], F.when(l2, F.greatest(F.lit(0.0), F.col("b") - F.col("p") * head)).otherwise(F.col("b")).alias("l3"),
        F.when(l2, F.col("b")).otherwise(F.col("b") + F.col("p") * put).alias("wire"), F.col("p").alias("pkts"),
    )


def minute_slices(records: DataFrame, now: datetime, counters: dict[str, str]) -> DataFrame:
    """A row per minute that a record touches: ts, flows (1 in its last minute), and each counter's share.

    counters: total column -> share column.  Up to the end of each minute a counter has given round(total x part of the
    span passed); a minute's share is what that grew by, so shares are never negative and add up to the rounded total.  No
    start, or one not before the end: one slice.  A span over six hours: its last hour.  No end: now.
    """
    end = F.unix_micros(F.coalesce(F.col("end"), F.lit(now)))
    start = F.unix_micros("start")
    long = end - start > LONGEST_US
    out = records.withColumn("_e", end).withColumn("_s", F.when(start.isNull() | (start >= end), None).when(long, end - KEPT_US).otherwise(start))
    at = lambda c: c - F.pmod(c, F.lit(MINUTE_US))
    first, last = at(F.coalesce("_s", "_e")), F.when(F.col("_s").isNull(), at(F.col("_e"))).otherwise(at(F.col("_e") - 1))
    out = out.withColumn("_last", last).withColumn("_m", F.explode(F.sequence(first, last, F.lit(MINUTE_US).cast("long"))))

    def part(t: Column) -> Column:
        passed = (F.least(t, F.col("_e")) - F.col("_s")) / (F.col("_e") - F.col("_s"))
        return F.when(F.col("_s").isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), passed))

    is_last = F.col("_m") == F.col("_last")
    upto = F.when(is_last, F.lit(1.0)).otherwise(part(F.col("_m") + MINUTE_US))
    before = F.when(F.col("_m") <= F.coalesce("_s", "_m"), F.lit(0.0)).otherwise(part(F.col("_m")))
    shares = {s: (F.round(F.col(t) * upto) - F.round(F.col(t) * before)).cast("long") for t, s in counters.items()}
    keep = [c for c in records.columns if c not in {*counters, *counters.values()}]
    return out.select(*keep, F.timestamp_micros("_m").alias("ts"), F.when(is_last, 1).otherwise(0).cast("long").alias("flows"), *[v.alias(k) for k, v in shares.items()])


FLOW_KEY = ["ts", "src", "dst", "sport", "dport", "proto"]
POINT = ["exporter", "domain", "observation", "in_if", "out_if", "direction"]


def mark_duplicates(rows: DataFrame, window: timedelta | None = None) -> DataFrame:
    """Adds dup: another observation point reported this packet direction in this minute before.

    Before means by arrival_seq; rows of the point that came first are never duplicates.  A key is one flow in one minute.
    window: rows that arrived later than this after their minute are compared with nothing and are no duplicates (needs a
    column arrived); they don't count as first reports either.
    """
    point = F.struct(*POINT)
    w = Window.partitionBy(*FLOW_KEY, *(["_on"] if window else [])).orderBy("arrival_seq")
    if window is None:
        return rows.withColumn("dup", ~F.first(point).over(w).eqNullSafe(point))
    late = F.unix_micros("arrived") - F.unix_micros("ts") - MINUTE_US > int(window.total_seconds() * 1e6)
    timed = rows.withColumn("_on", ~F.coalesce(late, F.lit(True)))
    # What is too late never enters the shuffle.
    inside = timed.where("_on").withColumn("dup", ~F.first(point).over(w).eqNullSafe(point))
    return inside.unionByName(timed.where("not _on").withColumn("dup", F.lit(False))).drop("_on")


def mark_against(rows: DataFrame, origins: DataFrame | None, window: timedelta) -> tuple[DataFrame, DataFrame]:
    """mark_duplicates for a batch of a stream, and the origins after it: the point that first reported each flow and minute.

    origins: the flow's key and origin, from the batches before; None for the first.  Rows that arrived later than window
    after their minute are compared with nothing (if they have arrived); origins of minutes further back than window before
    the newest minute that has arrived are forgotten.
    """
    point = F.struct(*POINT)
    late = F.unix_micros("arrived") - F.unix_micros("ts") - MINUTE_US > int(window.total_seconds() * 1e6) if "arrived" in rows.columns else F.lit(False)
    timed = rows.drop("dup").withColumn("_on", ~F.coalesce(late, F.lit(True)))
    first = F.first(point).over(Window.partitionBy(*FLOW_KEY).orderBy("arrival_seq"))
    inside = timed.where("_on").withColumn("_first", first)
    if origins is not None:
        inside = inside.join(origins, FLOW_KEY, "left").withColumn("_first", F.coalesce("origin", "_first")).drop("origin")
    marked = inside.withColumn("dup", ~F.col("_first").eqNullSafe(point))
    out = marked.drop("_first").unionByName(timed.where("not _on").withColumn("dup", F.lit(False))).drop("_on")
    own = marked.groupBy(*FLOW_KEY).agg(F.first("_first").alias("origin"))
    every = own if origins is None else own.unionByName(origins.join(own.select(*FLOW_KEY), FLOW_KEY, "left_anti"))
    seen = F.least(F.col("ts"), F.col("arrived")) if "arrived" in rows.columns else F.col("ts")
    newest = rows.agg(F.max(seen)).first()[0]
    return out, every if newest is None else every.where(F.col("ts") >= F.lit(newest - window))


def observed_interface() -> Column:
    """The interface a record was sampled on; 0 where it can't be told."""
    source = F.col("observation")
    own = (source != 0) & (F.shiftright(source, 24) == 0)
    return F.when(own, source.bitwiseAND(0xFFFFFF)).when(F.col("direction") == 0, F.col("in_if")).when(F.col("direction") == 1, F.col("out_if")).otherwise(0).cast("long")


def _joined(rows: DataFrame, facts: DataFrame, side: str) -> DataFrame:
    return rows.join(facts.withColumnRenamed("addr", side), side, "left")


def default_segment(addr: Column, key: Column) -> Column:
    """The /24 or /48 an address lies in."""
    v6 = F.concat_ws(":", *[F.regexp_replace(F.substring(key, 2 + 4 * i, 4), "^0+(?=.)", "") for i in range(3)])
    v6 = F.regexp_replace(F.regexp_replace(v6, "(:0)+$", ""), "^0$", "")
    return F.when(key.startswith("4"), F.concat(F.regexp_replace(addr, r"\.\d+$", ".0"), F.lit("/24"))).otherwise(F.concat(v6, F.lit("::/48")))


def enriched(records: DataFrame, nets: DataFrame | None = None, asns: DataFrame | None = None, threats: DataFrame | None = None) -> DataFrame:
    """Adds roles, locality, direction, service, the peer's AS and country, segment and threat.

    nets: lo, hi, ordinal, len, name (the inventory's networks, internal all).  asns: see ranges.asn_of.  threats: lo, hi,
    ordinal, len, list.  The distinct addresses are looked up once for each question and the answers joined back.
    """
    client_first = net.source_is_client()
    out = records.withColumn("_c", client_first).withColumn("client", F.when(F.col("_c"), F.col("src")).otherwise(F.col("dst")))
    out = out.withColumn("server", F.when(F.col("_c"), F.col("dst")).otherwise(F.col("src"))).withColumn("_sp", F.when(F.col("_c"), F.col("dst_port")).otherwise(F.col("src_port"))).drop("_c")
    addresses = out.select(F.col("client").alias("addr")).unionByName(out.select(F.col("server").alias("addr"))).distinct()
    # The key is a column of its own before it is used many times over.
    facts = addresses.withColumn("key", net.address_key(F.col("addr"))).withColumn("inside", net.special(F.col("key")))
    named = ranges.longest_prefix(addresses, nets, ["name"]).withColumnRenamed("name", "net") if nets is not None else None
    facts = facts.join(named, "addr", "left") if named is not None else facts.withColumn("net", F.lit(None).cast("string"))
    found = ranges.first_listed(addresses, threats, ["list"]) if threats is not None else None
    facts = facts.join(found, "addr", "left") if found is not None else facts.withColumn("list", F.lit(None).cast("string"))
    who = ranges.asn_of(addresses, asns) if asns is not None else None
    facts = facts.join(who, "addr", "left") if who is not None else facts.select("*", F.lit(None).cast("long").alias("asn"), F.lit(None).cast("string").alias("cc"), F.lit(None).cast("string").alias("org"))
    facts = facts.select("addr", (F.col("inside") | F.col("net").isNotNull()).alias("int"), F.coalesce("net", default_segment(F.col("addr"), F.col("key"))).alias("seg"), "list", "asn", "cc", "org")
    facts = cut(facts, "facts")  # used for both ends
    for side, p in (("client", "c_"), ("server", "s_")):
        out = _joined(out, facts.select("addr", *[F.col(x).alias(p + x) for x in facts.columns[1:]]), side)
    out = out.withColumn("dir", net.direction(F.col("c_int"), F.col("s_int")))
    inbound, internal = F.col("dir") == 2, F.col("dir") == 3
    peer = lambda x, none: F.when(internal, none).otherwise(F.coalesce(F.when(inbound, F.col("c_" + x)).otherwise(F.col("s_" + x)), none))
    asn = peer("asn", F.lit(0).cast("long"))
    is_dst = F.when(inbound, F.col("client")).otherwise(F.col("server")) == F.col("dst")
    own = F.when(is_dst, F.col("dst_as")).otherwise(F.col("src_as"))
    svc = F.when(net.ports_matter(F.col("proto")), F.col("_sp")).otherwise(0)
    return out.select(
        *records.columns, "client", "server", net.ipv4_number(F.col("client")).alias("cli4"), net.ipv4_number(F.col("server")).alias("srv4"),
        svc.cast("int").alias("svc_port"), net.app_name(F.col("proto"), svc).alias("app"), "dir", F.col("c_int").alias("cli_int"), F.col("s_int").alias("srv_int"),
        peer("cc", F.lit("")).alias("peer_cc"), F.when(internal, F.lit(0).cast("long")).when(asn == 0, F.coalesce(own, F.lit(0))).otherwise(asn).alias("peer_asn"), peer("org", F.lit("")).alias("peer_org"),
        F.when(inbound, F.col("s_seg")).otherwise(F.col("c_seg")).alias("segment"), F.coalesce("s_list", "c_list", F.lit("")).alias("threat"),
    )


def flow_rows(records: DataFrame, now: datetime, nets: DataFrame | None = None, asns: DataFrame | None = None, threats: DataFrame | None = None, overhead: int = OVERHEAD, dedup: bool = True) -> DataFrame:
    """The flow table's rows, with obs_if and arrival_seq beside its 34 columns.

    Addresses are taken in their plain form; implausible records are left out (refused() counts them); times are corrected
    by the arrival, where records have one.  dedup=False leaves dup to a later stage.
    """
    records = corrected_times(records) if "arrived" in records.columns else records
    clean = records.withColumns({c: address(F.col(c)) for c in ("src", "dst", "exporter")}).where(F.coalesce(plausible(now), F.lit(False)))
    clean = clean.withColumn("encap", net.encap_from_tuple())
    rich = normalised(enriched(clean, nets, asns, threats), overhead).withColumnRenamed("pkts", "_pkts").withColumnRenamed("wire", "_wire")
    rows = minute_slices(rich.drop("bytes"), now, {"l3": "bytes", "_wire": "wire", "_pkts": "pkts"})
    rows = rows.withColumnsRenamed({"src_port": "sport", "dst_port": "dport", "source": "src_type", "sampling_known": "samp_known"}).withColumn("obs_if", observed_interface())
    rows = mark_duplicates(rows) if dedup else rows.withColumn("dup", F.lit(False))
    cols = "ts src dst sport dport proto client server cli4 srv4 svc_port app bytes wire pkts flows exporter src_type in_if out_if vlan encap dir peer_cc peer_asn peer_org segment threat tcp_flags".split()
    extra = [c for c in ("domain", "observation", "direction", "obs_if", "arrival_seq", "arrived") if c in rows.columns]
    return rows.select(*cols, F.col("mult").cast("float").alias("mult"), "samp_known", "dup", "cli_int", "srv_int", *extra)


# Bounds of the delay steps in seconds, and the share of bytes that must have arrived.
DELAYS, ARRIVED, MOST_SETTLE = (2, 5, 10, 20, 30, 45, 60, 90, 120), 0.97, 120


def settle_seconds(records: DataFrame, arrived: str = "arrived") -> DataFrame:
    """seconds: the step of delay by which 97 per cent of the bytes had arrived, a second more; no row without records."""
    delay = (F.unix_micros(arrived) - F.unix_micros("start")) / 1e6
    step = F.lit(len(DELAYS))
    for i, d in reversed(list(enumerate(DELAYS))):
        step = F.when(delay <= d, i).otherwise(step)
    weight = F.greatest(F.coalesce("bytes", F.lit(0)) * F.greatest(F.coalesce("mult", F.lit(1.0)), F.lit(1.0)), F.lit(1.0))
    hist = records.where(delay.isNotNull()).groupBy(step.alias("i")).agg(F.sum(weight).alias("w"))  # ten rows
    parts = [F.sum(F.when(F.col("i") <= i, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i in range(len(DELAYS))]
    wide = hist.agg(*parts, F.sum("w").alias("w")).where("w is not null")
    out = F.lit(MOST_SETTLE)
    for i, d in reversed(list(enumerate(DELAYS))):
        out = F.when(F.col(f"w{i}") >= ARRIVED * F.col("w"), d).otherwise(out)
    return wide.select((out + 1).alias("seconds"))
