"""Detection rules, each over any number of windows at once.

A rule takes rows that carry `win`, the end of a window in epoch seconds (see windowed), and gives one row per sighting:
win, kind, sev, src, dst, port, first, last and its own measures.  A single run is the same thing with one window.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.core.columns import floor_div

# Services that ask for a password, and services of administration and file sharing.
LOGIN_PORTS = [21, 22, 23, 445, 1433, 1521, 3306, 3389, 5432, 5900, 5985, 5986, 6379, 27017]
ADMIN_PORTS = [22, 135, 139, 445, 3389, 5900, 5985, 5986]
#: Average frame above which traffic to an administration service is a session; bytes to a destination worth remembering.
SESSION, REMEMBERED = 250, 1_000_000
DAY = 86_400
REPORTED = ("win", "kind", "sev", "src", "dst", "port", "first", "last")


@dataclass(frozen=True)
class Limits:
    """Thresholds; those ending in _sampled hold where packets were sampled.

    most: the largest number of sightings of a kind in one window, the most striking first; kinds it doesn't name have no
    such limit.
    """

    window: int = 600
    every: int = 300
    scan_targets: int = 50
    scan_targets_sampled: int = 5
    scan_ports: int = 30
    scan_ports_sampled: int = 5
    brute: int = 30
    brute_sampled: int = 5
    new_service_clients: int = 5
    fast_targets: int = 40
    fast_ports: int = 10
    beacon_minutes: int = 6
    beacon_bytes: float = 4096
    beacon_jitter: float = 0.2
    chain_within: int = 300
    probe_avg: float = 90
    icmp_avg: float = 160
    brute_avg: float = 300
    exfil_bytes: float = 100e6
    exfil_ratio: float = 3
    flood_pps: float = 20_000
    flood_avg: float = 120
    flood_ratio: float = 10
    model_orgs: tuple[str, ...] = ()
    model_bytes: float = 1e6
    most: dict[str, int] = field(default_factory=dict)


def windowed(flows: DataFrame, limits: Limits, start: datetime, end: datetime) -> DataFrame:
    """Rows without duplicates, once for every window [win - window, win) that holds them; ends are multiples of every in
    (start, end]."""
    at = F.unix_seconds("ts")
    first = floor_div(at, limits.every) * limits.every + limits.every
    wins = F.filter(F.sequence(first, at + limits.window, F.lit(limits.every).cast("long")), lambda w: (w > int(start.timestamp())) & (w <= int(end.timestamp())) & (w - limits.window <= at))
    return flows.where("not dup").where((F.col("ts") >= F.lit(start) - F.expr(f"interval {limits.window} seconds")) & (F.col("ts") < F.lit(end))).withColumn("win", F.explode(wins))


def port_label(port: Column, proto: Column) -> Column:
    return F.when(proto.isin(1, 58), "icmp").when(proto == 17, F.concat(port.cast("string"), F.lit("/udp"))).otherwise(F.concat(port.cast("string"), F.lit("/tcp")))


def src_internal() -> Column:
    return F.when(F.col("src") == F.col("client"), F.col("cli_int")).otherwise(F.col("srv_int"))


def _common() -> list[Column]:
    return [F.sum("pkts").alias("pkts"), F.sum("wire").alias("wire"), F.max("mult").cast("double").alias("sampling"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bool_or(src_internal()).alias("own"), F.sum(F.col("pkts") / F.greatest(F.col("mult"), F.lit(1.0))).alias("seen")]


def _sampled(yes: float, no: float) -> Column:
    return F.when(F.col("sampling") > 1, yes).otherwise(no)


def _best(df: DataFrame, by: list[Column], limit: int | None) -> DataFrame:
    """At most limit sightings per window (None: all); the order decides, then the key, so that a run can be repeated."""
    if limit is None:
        return df
    w = Window.partitionBy("win").orderBy(*by)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def _examples(df: DataFrame, rows: DataFrame, keys: list[str], col: str, n: int) -> DataFrame:
    """Adds the first n values of col of each sighting: distinct values are cut to n before they are gathered."""
    w = Window.partitionBy(*keys).orderBy(col)
    few = rows.join(df.select(*keys), keys, "left_semi").select(*keys, col).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    lists = few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(col).cast("string").alias("v")))), lambda x: x["v"]).alias("examples"))
    return df.join(lists, keys, "left")


def _report(df: DataFrame, kind: str, sev: Column, src: Column, dst: Column, port: Column, *measures: Column) -> DataFrame:
    last = F.col("last") + F.expr("interval 1 minute")
    return df.select("win", F.lit(kind).alias("kind"), sev.cast("int").alias("sev"), src.alias("src"), dst.alias("dst"), port.alias("port"), "first", last.alias("last"), *measures)


def _by_source() -> Column:
    return F.when(F.col("own"), 3).otherwise(1)


def _average() -> Column:
    return (F.col("wire") / F.greatest(F.col("pkts"), F.lit(1))).alias("avg")



def _no() -> Column:
    return F.lit("")


def scan(rows: DataFrame, c: Limits) -> DataFrame:
    """One source, many hosts, one port, with small packets and few of them per host."""
    keys = ["win", "src", "dport", "proto"]
    part = rows.where(F.col("proto").isin(1, 6, 58))
    g = part.groupBy(*keys).agg(F.count_distinct("dst").alias("targets"), *_common())
    g = g.where(
        (F.col("wire") <= F.col("pkts") * F.when(F.col("proto") == 6, c.probe_avg).otherwise(c.icmp_avg))
        & (F.col("targets") >= _sampled(c.scan_targets_sampled, c.scan_targets)) & (F.col("seen") <= 3 * F.col("targets"))
    )
    g = _examples(_best(g, [F.desc("targets"), F.col("src"), F.col("dport"), F.col("proto")], c.most.get("scan")), part, keys, "dst", 6)
    return _report(g, "scan", _by_source(), F.col("src"), _no(), port_label(F.col("dport"), F.col("proto")), "targets", "pkts", _average(), "sampling", "examples")


def portscan(rows: DataFrame, c: Limits) -> DataFrame:
    """One source, one host, many ports; ports of clients (32768 and above) don't count."""
    keys = ["win", "src", "dst"]
    part = rows.where("proto = 6 and dport < 32768")
    g = part.groupBy(*keys).agg(F.count_distinct("dport").alias("ports"), *_common())
    g = g.where((F.col("wire") <= F.col("pkts") * c.probe_avg) & (F.col("ports") >= _sampled(c.scan_ports_sampled, c.scan_ports)) & (F.col("seen") <= 3 * F.col("ports")))
    g = _examples(_best(g, [F.desc("ports"), F.col("src"), F.col("dst")], c.most.get("portscan")), part, keys, "dport", 8)
    return _report(g, "portscan", _by_source(), F.col("src"), F.col("dst"), _no(), "ports", "pkts", _average(), "sampling", "examples")


def brute(rows: DataFrame, c: Limits) -> DataFrame:
    """Many short connections from one source to one login service."""
    g = rows.where((F.col("proto") == 6) & F.col("dport").isin(LOGIN_PORTS)).groupBy("win", "src", "dst", "dport").agg(F.count_distinct("sport").alias("conns"), *_common())
    g = g.where(
        (F.col("wire") <= F.col("pkts") * _sampled(min(c.brute_avg, 200), c.brute_avg)) & (F.col("conns") >= _sampled(c.brute_sampled, c.brute))
        & ((F.col("sampling") <= 1) | (F.col("conns") >= 0.7 * F.col("seen")))
    )
    g = _best(g, [F.desc("conns"), F.col("src"), F.col("dst"), F.col("dport")], c.most.get("brute"))
    return _report(g, "brute", _by_source(), F.col("src"), F.col("dst"), port_label(F.col("dport"), F.lit(6)), "conns", "pkts", _average(), "sampling")


# -- what has been seen before
SEEN = "kind string, a string, b string, port int, first_ts timestamp, last_ts timestamp"


def sightings(rows: DataFrame) -> DataFrame:
    """win, kind, a, b, port, first_ts, last_ts: services that had sessions and destinations that took uploads."""
    span = [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    admin = rows.where((F.col("dir") == 3) & (F.col("proto") == 6) & F.col("svc_port").isin(ADMIN_PORTS))
    svc = admin.groupBy("win", "server", "svc_port").agg(*span, F.sum("wire").alias("w"), F.sum("pkts").alias("p")).where(F.col("w") > SESSION * F.col("p"))
    up = rows.where("dir = 1").groupBy("win", "client", "server").agg(*span, F.sum("wire").alias("w")).where(F.col("w") >= REMEMBERED)
    return svc.select("win", F.lit("svc").alias("kind"), F.col("server").alias("a"), F.lit("").alias("b"), F.col("svc_port").cast("int").alias("port"), "first_ts", "last_ts").unionByName(
        up.select("win", F.lit("up").alias("kind"), F.col("client").alias("a"), F.col("server").alias("b"), F.lit(0).alias("port"), "first_ts", "last_ts")
    )


def learn(seen: DataFrame | None, rows: DataFrame, keep_days: int = 30) -> DataFrame:
    """The memory after the windows of rows; what wasn't seen for keep_days before the last of them is forgotten."""
    new = sightings(rows)
    now = rows.agg(F.max("win")).first()[0]
    both = new.drop("win") if seen is None else seen.unionByName(new.drop("win"))
    out = both.groupBy("kind", "a", "b", "port").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return out if now is None else out.where(F.unix_seconds("last_ts") >= now - keep_days * DAY)


def _memory(seen: DataFrame | None, rows: DataFrame, kind: str) -> DataFrame:
    """a, b, port, since: when each was first seen, in the memory or in a window of this run.

    Windows only look back, and a first sighting inside the run lies in the very window or before it, so one minimum stands
    for the memory before each window; a run spans 30 days at most, so nothing is forgotten on the way.
    """
    own = sightings(rows).where(F.col("kind") == kind).select("a", "b", "port", F.col("first_ts").alias("t"))
    if seen is not None:
        own = own.unionByName(seen.where(F.col("kind") == kind).select("a", "b", "port", F.col("first_ts").alias("t")))
    return own.groupBy("a", "b", "port").agg(F.unix_seconds(F.min("t")).alias("since"))


def _fresh(c: Limits) -> Column:
    """Not known, or only since a day before the window began."""
    return F.col("since").isNull() | (F.col("since") >= F.col("win") - c.window - DAY)


def _hops(rows: DataFrame, c: Limits, seen: DataFrame | None) -> DataFrame:
    """Sessions of administration between internal hosts to services not offered before, unless many took them up at once."""
    admin = rows.where((F.col("dir") == 3) & (F.col("proto") == 6) & F.col("svc_port").isin(ADMIN_PORTS))
    h = admin.groupBy("win", "client", "server", "svc_port").agg(F.sum("wire").alias("wire"), F.sum("pkts").alias("p"), F.max("mult").cast("double").alias("sampling"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    known = _memory(seen, rows, "svc").select(F.col("a").alias("server"), F.col("port").alias("svc_port"), "since")
    h = h.where(F.col("wire") > SESSION * F.col("p")).join(known, ["server", "svc_port"], "left").where(_fresh(c))
    users = h.groupBy("win", "server", "svc_port").agg(F.count("*").alias("users")).where(F.col("users") < c.new_service_clients)
    return h.join(users.drop("users"), ["win", "server", "svc_port"], "left_semi")


def lateral(rows: DataFrame, c: Limits, seen: DataFrame | None = None) -> DataFrame:
    g = _hops(rows, c, seen).groupBy("win", "client", "svc_port").agg(
        F.array_sort(F.collect_set("server")).alias("targets"), F.count_distinct("server").alias("hosts"), F.sum("wire").alias("bytes"), F.max("sampling").alias("sampling"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return _report(g, "lateral", F.lit(3), F.col("client"), _no(), port_label(F.col("svc_port"), F.lit(6)), "targets", "hosts", "bytes", "sampling")


def chain(rows: DataFrame, c: Limits, seen: DataFrame | None = None) -> DataFrame:
    """A host that was reached so and within minutes reached another; one sighting per host in between."""
    h = _hops(rows, c, seen)
    i = h.select("win", F.col("client").alias("a"), F.col("server").alias("b"), F.col("svc_port").alias("in_port"), F.col("first").alias("i_first"))
    o = h.select("win", F.col("client").alias("b"), F.col("server").alias("to"), F.col("svc_port").alias("out_port"), F.col("first").alias("o_first"), F.col("last").alias("o_last"))
    gap = F.unix_micros("o_first") - F.unix_micros("i_first")
    pairs = i.join(o, ["win", "b"]).where((F.col("to") != F.col("a")) & (gap >= 0) & (gap <= c.chain_within * 1_000_000))
    g = pairs.groupBy("win", "b").agg(
        F.array_sort(F.collect_set("a")).alias("from"), F.array_sort(F.collect_set("to")).alias("to"), F.count_distinct("to").alias("onward"),
        F.min_by("to", F.struct("i_first", "to", "out_port")).alias("first_to"), F.min_by("in_port", F.struct("i_first", "to", "in_port")).alias("in_port"), F.min_by("out_port", F.struct("i_first", "to", "out_port")).alias("out_port"),
        F.min("i_first").alias("first"), F.max("o_last").alias("last"),
    )
    out = port_label(F.col("out_port"), F.lit(6))
    return _report(g, "chain", F.lit(3), F.col("b"), F.col("first_to"), out, F.col("b").alias("via"), "from", "to", port_label(F.col("in_port"), F.lit(6)).alias("in_port"), out.alias("out_port"), "onward")


def exfil(rows: DataFrame, c: Limits, seen: DataFrame | None = None) -> DataFrame:
    """An internal host that sends far more than it gets to a destination not used before the last day."""
    sent = lambda end: F.coalesce(F.sum(F.when(F.col("src") == F.col(end), F.col("wire"))), F.lit(0))
    g = rows.where("dir = 1").groupBy("win", "client", "server").agg(sent("client").alias("up"), sent("server").alias("down"), F.max("mult").cast("double").alias("sampling"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("peer_cc").alias("cc"), F.min("peer_org").alias("org"))
    known = _memory(seen, rows, "up").select(F.col("a").alias("client"), F.col("b").alias("server"), "since")
    g = g.where((F.col("up") >= c.exfil_bytes) & (F.col("up") >= c.exfil_ratio * F.col("down"))).join(known, ["client", "server"], "left").where(_fresh(c))
    return _report(g, "exfil", F.lit(3), F.col("client"), F.col("server"), _no(), "up", "down", "sampling", "cc", "org")


def flood(rows: DataFrame, c: Limits, r_host: DataFrame | None = None) -> DataFrame:
    """Small packets to one address at a high rate, far above what it exchanged per hour in the week before."""
    g = rows.where(F.col("wire") <= F.col("pkts") * c.flood_avg).groupBy("win", "dst").agg(F.count_distinct("src").alias("sources"), *_common())
    g = g.where(F.col("pkts") >= c.flood_pps * c.window)
    modes = rows.where(F.col("wire") <= F.col("pkts") * c.flood_avg).join(g.select("win", "dst"), ["win", "dst"], "left_semi").groupBy("win", "dst").agg(F.mode("dport", True).alias("dport"), F.mode("proto", True).alias("proto"))
    g = _best(g, [F.desc("pkts"), F.col("dst")], c.most.get("flood")).join(modes, ["win", "dst"])
    if r_host is not None:
        hours = r_host.groupBy("ip", "ts").agg(F.sum("pkts").alias("hp"))
        at = F.unix_seconds("ts")
        before = g.select("win", "dst").join(hours, F.col("dst") == F.col("ip")).where((at >= F.col("win") - c.window - 7 * DAY) & (at < F.col("win") - c.window - 3600))
        g = g.join(before.groupBy("win", "dst").agg((F.sum("hp") / (F.count("*") * 3600)).alias("usual")), ["win", "dst"], "left")
    else:
        g = g.withColumn("usual", F.lit(None).cast("double"))
    g = g.withColumn("usual", F.coalesce("usual", F.lit(0.0))).withColumn("pps", F.col("pkts") / c.window).where(F.col("pps") >= c.flood_ratio * F.col("usual"))
    return _report(g, "flood", F.lit(2), _no(), F.col("dst"), port_label(F.col("dport"), F.col("proto")), "pps", "usual", _average(), "sources", "sampling")


def threat(rows: DataFrame, c: Limits) -> DataFrame:
    """Traffic with a listed address: serious where an internal host began it, noise where it came from outside."""
    sent = lambda end: F.coalesce(F.sum(F.when(F.col("src") == F.col(end), F.col("wire"))), F.lit(0))
    g = rows.where("threat <> ''").groupBy("win", "client", "server", "threat").agg(F.min("dir").alias("dir"), sent("client").alias("up"), sent("server").alias("down"), F.sum("flows").alias("flows"), F.max("mult").cast("double").alias("sampling"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    g = _best(g, [F.desc(F.col("up") + F.col("down")), F.col("client"), F.col("server"), F.col("threat")], c.most.get("threat"))
    sev = F.when(F.col("dir") == 1, 3).when(F.col("dir") == 2, 1).otherwise(2)
    return _report(g, "threat", sev, F.col("client"), F.col("server"), F.col("threat"), F.col("threat").alias("list"), "dir", "up", "down", "flows", "sampling")


def fastscan(rows: DataFrame, c: Limits) -> DataFrame:
    """Many hosts and many ports in one minute."""
    keys = ["win", "src", "minute"]
    part = rows.where("proto = 6").withColumn("minute", F.date_trunc("minute", "ts"))
    g = part.groupBy(*keys).agg(F.count_distinct("dst").alias("targets"), F.count_distinct("dport").alias("ports"), *_common())
    g = g.where((F.col("targets") >= c.fast_targets) & (F.col("ports") >= c.fast_ports) & (F.col("wire") <= F.col("pkts") * c.probe_avg))
    g = _examples(_best(g, [F.desc(F.col("targets") * F.col("ports")), F.col("src"), F.col("minute")], c.most.get("fastscan")), part, keys, "dst", 6)
    g = g.withColumn("first", F.col("minute")).withColumn("last", F.col("minute"))
    return _report(g, "fastscan", F.when(F.col("own"), 3).otherwise(2), F.col("src"), _no(), _no(), "targets", "ports", "pkts", _average(), "sampling", "examples")


def beacon(rows: DataFrame, c: Limits) -> DataFrame:
    """Small exchanges with an outside service at an even pace: the mean gap and the mean deviation from it."""
    keys = ["win", "client", "server", "svc_port", "proto"]
    part = rows.where("not srv_int and proto in (6, 17)").withColumn("minute", F.unix_seconds(F.date_trunc("minute", "ts")))
    per = part.groupBy(*keys, "minute").agg(F.sum("wire").alias("w"), F.sum("pkts").alias("p"), F.max("mult").alias("m"), F.min("peer_org").alias("org"))
    w = Window.partitionBy(*keys)  # a row per minute of a window
    per = per.withColumn("gap", F.col("minute") - F.lag("minute").over(w.orderBy("minute"))).withColumn("mean", F.avg("gap").over(w))
    g = per.groupBy(*keys).agg(
        F.count("*").alias("checkins"), F.sum("w").alias("bytes"), F.sum("p").alias("pkts"), F.max("m").cast("double").alias("sampling"), F.min("org").alias("org"), F.max("mean").alias("period_s"),
        (F.avg(F.abs(F.col("gap") - F.col("mean"))) / F.max("mean")).alias("jitter"), F.timestamp_seconds(F.min("minute")).alias("first"), F.timestamp_seconds(F.max("minute")).alias("last"),
    )
    g = g.where((F.col("checkins") >= F.greatest(F.lit(c.beacon_minutes), F.lit(3))) & (F.col("bytes") <= c.beacon_bytes * F.col("checkins")) & (F.col("jitter") <= c.beacon_jitter))
    g = _best(g, [F.desc("checkins"), F.col("client"), F.col("server"), F.col("svc_port"), F.col("proto")], c.most.get("beacon"))
    return _report(g, "beacon", F.lit(2), F.col("client"), F.col("server"), port_label(F.col("svc_port"), F.col("proto")), "period_s", "jitter", "checkins", "bytes", "pkts", "sampling", "org")


def model_api(rows: DataFrame, c: Limits) -> DataFrame:
    """An internal host that sends much to an organisation that runs model APIs; what names them is given with the limits, and no name turns the rule off."""
    named = F.lit(False)
    for org in c.model_orgs:
        named = named | F.lower("peer_org").contains(org.lower())
    g = rows.where((F.col("dir") == 1) & ~F.col("srv_int") & named).groupBy("win", "client", "server", "svc_port").agg(F.min("peer_org").alias("org"), F.sum("bytes").alias("bytes"), F.sum("pkts").alias("pkts"), F.count_distinct(F.date_trunc("minute", "ts")).alias("minutes"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    g = _best(g.where(F.col("bytes") >= c.model_bytes), [F.desc("bytes"), F.col("client"), F.col("server"), F.col("svc_port")], c.most.get("llm"))
    return _report(g, "llm", F.lit(1), F.col("client"), F.col("server"), port_label(F.col("svc_port"), F.lit(6)), "org", "bytes", "pkts", "minutes")


ALWAYS = (scan, portscan, brute, threat, fastscan, beacon, model_api)
LEARNED = (lateral, exfil, chain)
