"""The largest groups of a dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions.flow import COUNTRY, PORT, SUMS, sums
from netloom.plans.query import Query
from netloom.plans.tables import Tables

MOST_ROWS, ROWS = 1000, 66


@dataclass(frozen=True)
class Dim:
    """keys: shown key, key2, key3 as SQL text; extra: shown beside them; peers: the opposite end; internal: whose locality;
    rollup: the summary that can answer (a role of r_host or a dim of r_dim)."""

    keys: tuple[str, ...]
    extra: str = ""
    peers: str = ""
    internal: str = ""
    rollup: str = ""


DIMS = {
    "client": Dim(("client",), peers="server", internal="cli_int", rollup="host:1"),
    "server": Dim(("server",), "min(peer_cc)", "client", "srv_int", "host:2"),
    "service": Dim(("server", PORT), "min(app)", "client", "srv_int"),
    "conv": Dim(("client", "server", PORT), "min(peer_cc)"),
    "app": Dim(("app",), rollup="app"),
    "port": Dim((PORT,), "min(app)", rollup="port"),
    "country": Dim((COUNTRY,), rollup="country"),
    "asn": Dim(("CAST(peer_asn AS STRING)",), "min(peer_org)", rollup="asn"),
    "proto": Dim(("CAST(proto AS STRING)",), rollup="proto"),
    "dir": Dim(("CAST(dir AS STRING)",), rollup="dir"),
    "exporter": Dim(("exporter",), rollup="exporter"),
    "segment": Dim(("segment",), rollup="segment"),
    "encap": Dim(("CAST(encap AS STRING)",), rollup="encap"),
    "threat": Dim(("threat", "client", "server"), "concat(min(peer_cc), '|', min(dir))"),
    "vlan": Dim(("CAST(vlan AS STRING)",)),
}
RANKINGS = ("wire", "bytes", "pkts", "flows", "peers", "avg")
COLUMNS = ("key", "key2", "key3", "extra", *SUMS, "peers", "internal")


def ranking(by: str) -> Column:
    return F.col("wire") / F.greatest(F.col("pkts"), F.lit(1)) if by == "avg" else F.col(by)


def ordered(df: DataFrame, by: str, asc: bool, limit: int) -> DataFrame:
    """The first rows by rank, then wire, then keys, so that equal ranks have one order."""
    rank = ranking(by).asc() if asc else ranking(by).desc()
    return df.orderBy(rank, F.desc("wire"), "key", "key2", "key3").limit(limit)


def top_n(tables: Tables, q: Query, dim: str, limit: int = ROWS, by: str = "wire", asc: bool = False) -> DataFrame:
    """key, key2, key3, extra, bytes, wire, pkts, flows, peers, internal of the largest groups.

    Ranked by one of wire, bytes, pkts, flows, peers or avg (average packet size).  Groups are ranked on their sums alone;
    peers, which need distinct pairs, and extras are taken for the listed groups only, from the flow rows.  Ranked by peers,
    distinct pairs are counted for all groups, in two steps, so that no group is held in memory.  Summaries hold no peers:
    there they are 0, and a ranking by peers ranks by wire.  limit: 1 to MOST_ROWS groups; anything else asks for ROWS.
    """
    if by not in RANKINGS:
        raise ValueError(f"unknown ranking {by!r}")
    if dim not in DIMS:
        raise ValueError(f"unknown dimension {dim!r}")
    d, limit = DIMS[dim], limit if 0 < limit <= MOST_ROWS else ROWS
    if d.rollup:
        host = d.rollup.startswith("host:")
        rows = tables.rollup(q, "r_host" if host else "r_dim")
        if rows is not None:
            return _from_rollup(rows, d.rollup, limit, by, asc)
    rows = tables.detail(q)
    if dim == "threat":
        rows = rows.where("threat <> ''")
    names = ("key", "key2", "key3")[: len(d.keys)]
    keyed = rows.select(*[F.expr(k).alias(n) for n, k in zip(names, d.keys)], *[c for c in rows.columns if c not in names])
    blank = [F.lit("").alias(n) for n in ("key", "key2", "key3")[len(d.keys) :]]
    groups = keyed.groupBy(*names).agg(*sums()).select("*", *blank)
    if by == "peers":
        pairs = keyed.select(*names, F.expr(d.peers).alias("peer")).distinct().groupBy(*names).agg(F.count("peer").alias("peers")) if d.peers else None
        groups = groups.join(pairs, list(names)) if pairs is not None else groups.withColumn("peers", F.lit(0).cast("long"))
    top = ordered(groups, by, asc, limit)
    if not (d.extra or d.peers or d.internal):
        out = top
    else:
        more = [F.expr(d.extra or "''").alias("extra"), F.expr(f"bool_or({d.internal})" if d.internal else "false").alias("internal")]
        if d.peers and by != "peers":
            more.append(F.count_distinct(F.expr(d.peers)).alias("peers"))
        details = keyed.join(top.select(*names), list(names), "left_semi").groupBy(*names).agg(*more)
        out = ordered(top.join(details, list(names)), by, asc, limit)
    return _shown(out)


def _shown(df: DataFrame) -> DataFrame:
    missing = {"extra": F.lit(""), "peers": F.lit(0).cast("long"), "internal": F.lit(False)}
    out = df.select("*", *[c.alias(n) for n, c in missing.items() if n not in df.columns])
    return out.select(*[F.coalesce("extra", F.lit("")).alias("extra") if c == "extra" else F.col(c) for c in COLUMNS])


def _from_rollup(rows: DataFrame, rollup: str, limit: int, by: str, asc: bool) -> DataFrame:
    by = "wire" if by == "peers" else by
    key, kind = ("ip", "role") if rollup.startswith("host:") else ("val", "dim")
    wanted = F.col(kind) == (int(rollup[5:]) if kind == "role" else rollup)
    internal = F.bool_or(F.coalesce("internal", F.lit(False))) if kind == "role" else F.lit(False)
    groups = rows.where(wanted).groupBy(F.col(key).alias("key")).agg(*sums(), internal.alias("internal")).select("*", F.lit("").alias("key2"), F.lit("").alias("key3"))
    top = ordered(groups, by, asc, limit)
    if rollup in ("port", "asn"):  # the value carries "key<tab>extra"
        # A value is split after ranking, as it was stored.
        top = top.withColumn("extra", F.when(F.instr("key", "\t") > 0, F.substring_index("key", "\t", -1)).otherwise("")).withColumn("key", F.substring_index("key", "\t", 1))
    return _shown(top)
