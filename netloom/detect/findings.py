"""Findings: sightings of one thing merged over time, their evidence, and the run over a span of windows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.core.shared import cut
from netloom.detect import rules
from netloom.detect.rules import REPORTED, Limits

KEY = ["kind", "src", "dst", "port"]
FINDING = "kind string, src string, dst string, port string, sev int, first timestamp, last timestamp, hits long, ev string, status string"
OPEN, DONE, FALSE = "open", "done", "false"
#: Seconds without a sighting after which a new finding opens; entries of a list of evidence.
GAP, LISTED = 1800, 12


def packed(sightings: DataFrame) -> DataFrame:
    """The reported columns and the rule's own measures as JSON text in ev."""
    own = [c for c in sightings.columns if c not in REPORTED]
    return sightings.select(*REPORTED, F.to_json(F.struct(*own)).alias("ev"))


def _evidence(parts: DataFrame, listed: int | None) -> DataFrame:
    """group, ev of parts (group, last, ev): numbers keep the largest, lists are joined (sorted, the first listed of them),
    anything else takes the newest."""
    each = parts.select("group", "last", F.explode(F.from_json("ev", "map<string,string>")).alias("k", "v"))
    lists = each.where(F.col("v").startswith("["))
    entries = lists.select("group", "k", F.explode(F.from_json("v", "array<string>")).alias("e")).distinct()
    w = Window.partitionBy("group", "k").orderBy("e")
    entries = entries if listed is None else entries.withColumn("r", F.row_number().over(w)).where(F.col("r") <= listed)
    joined = entries.groupBy("group", "k").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("v"))
    number = F.expr("try_cast(v as double)")
    plain = each.where(~F.col("v").startswith("[")).groupBy("group", "k").agg(F.max(number).alias("n"), F.max_by("v", F.struct("last", "v")).alias("s"), F.bool_and(number.isNotNull()).alias("num"))
    # Whole numbers are written without a fraction, text quoted.
    text = F.when(F.col("num"), F.when(F.col("n") == F.floor("n"), F.format_string("%d", F.col("n").cast("long"))).otherwise(F.col("n").cast("string"))).otherwise(F.to_json(F.array("s")).substr(F.lit(2), F.length(F.to_json(F.array("s"))) - 2))
    every = plain.select("group", "k", text.alias("v")).unionByName(joined)
    pair = F.concat(F.lit('"'), "k", F.lit('":'), "v")
    return every.groupBy("group").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("ev"))


def merge(existing: DataFrame | None, sightings: DataFrame, gap: int = GAP, listed: int | None = LISTED) -> DataFrame:
    """Findings after new sightings (as packed gives them).

    A sighting that begins at most gap seconds after the last moment of an open finding with its kind, source, target and
    port extends it; otherwise it opens one.  What was marked false is never reported again; what was marked done stays as
    it is.  Sightings are taken in the order of their windows: islands of the running latest moment, no loop.  listed: entries
    kept of each list of evidence, None for all.
    """
    new = sightings.select(*KEY, "sev", "first", "last", F.lit(1).cast("long").alias("hits"), "ev", F.lit(OPEN).alias("status"), F.col("win").alias("at"))
    if existing is not None:
        new = new.join(existing.where(F.col("status") == FALSE).select(*KEY).distinct(), KEY, "left_anti")
        new = new.unionByName(existing.where(F.col("status") == OPEN).withColumn("at", F.lit(0).cast("long")))
    # A finding has at most one sighting per window and rule.
    w = Window.partitionBy(*KEY).orderBy("at", "first", "last")
    upto = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = upto.isNull() | (F.unix_micros(upto) < F.unix_micros("first") - gap * 1_000_000)
    numbered = new.withColumn("_new", opens.cast("int")).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = cut(numbered.withColumn("group", F.sha2(F.to_json(F.struct(*KEY, "_i")), 256)), "sightings")
    heads = numbered.groupBy("group", *KEY).agg(F.max("sev").alias("sev"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("hits").alias("hits"))
    out = heads.join(_evidence(numbered, listed), "group", "left").select(*KEY, "sev", "first", "last", "hits", F.coalesce("ev", F.lit("{}")).alias("ev"), F.lit(OPEN).alias("status"))
    return out if existing is None else out.unionByName(existing.where(F.col("status") != OPEN).select(*out.columns))


READ = ("ts", "src", "dst", "sport", "dport", "proto", "client", "server", "svc_port", "bytes", "wire", "pkts", "flows", "dir", "peer_cc", "peer_org", "threat", "mult", "dup", "cli_int", "srv_int")


def run(flows: DataFrame, start: datetime, end: datetime, limits: Limits = Limits(), seen: DataFrame | None = None, r_host: DataFrame | None = None, learned: bool = True) -> DataFrame:
    """Packed sightings of all rules in every window whose end lies in (start, end]; rules that need a memory only if learned.

    The rows of the span are read once, in the columns that rules look at, and shared by the rules.
    """
    span = (F.col("ts") >= F.lit(start) - F.expr(f"interval {limits.window} seconds")) & (F.col("ts") < F.lit(end))
    rows = rules.windowed(cut(flows.where(span).where("not dup").select(*READ), "watched"), limits, start, end)
    parts = [rule(rows, limits) for rule in rules.ALWAYS] + [rules.flood(rows, limits, r_host)]
    if learned:
        parts += [rule(rows, limits, seen) for rule in rules.LEARNED]
    out = packed(parts[0])
    for p in parts[1:]:
        out = out.unionByName(packed(p))
    return out


def caught_up(flows: DataFrame, findings: DataFrame | None, last: datetime | None, now: datetime, limits: Limits = Limits(), seen: DataFrame | None = None, r_host: DataFrame | None = None, back: timedelta = timedelta(days=1)) -> tuple[DataFrame, DataFrame, datetime]:
    """Findings, memory and the moment up to which they hold, after everything since `last` has been looked at.

    last: end of the last window that was looked at; None on the first run, which looks at `back` of what is stored and has
    no memory to tell new from old with: what it sees is only remembered by the rules that learn.  Windows missed while
    nothing ran are looked at together, each with what was known before it.
    """
    end = datetime.fromtimestamp(int(now.timestamp()) // limits.every * limits.every, timezone.utc)
    start = end - back if last is None else last
    sightings = run(flows, start, end, limits, seen, r_host, learned=last is not None)
    rows = rules.windowed(flows, limits, start, end)
    return merge(findings, sightings), rules.learn(seen, rows), end


def select(findings: DataFrame, start: datetime, end: datetime, status: str = "", ip: str = "", limit: int | None = 500) -> DataFrame:
    """Findings seen in [start, end), open ones first, then by severity and recency; limit: how many, None for all."""
    c: Column = (F.col("last") >= F.lit(start)) & (F.col("first") < F.lit(end))
    if status not in ("", "all"):
        c = c & (F.col("status") == status)
    if ip:
        c = c & ((F.col("src") == ip) | (F.col("dst") == ip) | F.col("ev").contains(f'"{ip}"'))
    out = findings.where(c).orderBy(F.desc(F.col("status") == OPEN), F.desc("sev"), F.desc("last"), *KEY)
    return out if limit is None else out.limit(limit)


def with_status(findings: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    """Findings with those named by keys (kind, src, dst, port, first) set to status."""
    if status not in (OPEN, DONE, FALSE):
        raise ValueError(f"unknown status {status!r}")
    named = keys.select(*KEY, "first").distinct().withColumn("_set", F.lit(True))
    return findings.join(named, [*KEY, "first"], "left").withColumn("status", F.when(F.col("_set"), status).otherwise(F.col("status"))).drop("_set").select(*findings.columns)
