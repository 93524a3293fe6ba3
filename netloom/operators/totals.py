"""Headline numbers, records and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions.flow import sums
from netloom.plans.query import Query, step_for
from netloom.plans.tables import Tables, view_of

#: Columns of a record as shown.
RECORD = ("client", "server", "cport", "svc_port", "proto", "app", "peer_cc", "peer_asn", "encap", "wire", "pkts", "exporter", "in_if", "out_if", "vlan", "tcp_flags", "mult", "dir", "threat")


def _one_row(df: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-row frames side by side."""
    return df.withColumn("_j", F.lit(1)).join(other.withColumn("_j", F.lit(1)), "_j").drop("_j")


def host_counts(tables: Tables, q: Query) -> DataFrame:
    """hosts: internal addresses on either side, each once; peers: external ones, the server's side first.

    Counted by grouping, which spills, not by sets held in memory; an address enters the shuffle once per task.
    """
    rows = tables.detail(q)
    inside = rows.where("cli_int").select("client").unionByName(rows.where("srv_int").select(F.col("server").alias("client"))).distinct()
    outside = rows.where("not srv_int or not cli_int").select(F.expr("CASE WHEN NOT srv_int THEN server ELSE client END").alias("peer")).distinct()
    return _one_row(inside.agg(F.count("*").alias("hosts")), outside.agg(F.count("*").alias("peers")))


def totals(tables: Tables, q: Query) -> DataFrame:
    """bytes, wire, pkts, flows, hosts, peers, countries of the range, one row."""
    r_ts, r_dim = tables.rollup(q, "r_ts"), tables.rollup(q, "r_dim")
    if r_ts is not None and r_dim is not None:
        head = r_ts.agg(*sums())
        lands = r_dim.where("dim = 'country' and val not in ('', '__internal__')").agg(F.count_distinct("val").alias("countries"))
        r_host = tables.rollup(q, "r_host") if not view_of(q).key else None
        if r_host is not None:
            seen = r_host.groupBy("internal", "ip").agg(F.lit(1).alias("x"))
            hosts = seen.agg(F.count(F.when(F.col("internal"), 1)).alias("hosts"), F.count(F.when(~F.col("internal"), 1)).alias("peers"))
        else:
            hosts = host_counts(tables, q)
        return _one_row(_one_row(head, hosts), lands)
    rows = tables.detail(q)
    head = rows.agg(*sums(), F.count_distinct(F.expr("nullif(peer_cc, '')")).alias("countries"))
    return _one_row(head, host_counts(tables, q)).select("bytes", "wire", "pkts", "flows", "hosts", "peers", "countries")


def records(tables: Tables, q: Query, limit: int = 200, offset: int = 0) -> DataFrame:
    """Flow rows, newest first, then by wire; ties by the columns that name a flow, so that pages don't overlap."""
    limit = limit if 0 < limit <= 2000 else 200
    cport = F.expr("CASE WHEN client = src THEN sport ELSE dport END")
    rows = tables.detail(q).withColumn("cport", cport)
    order = [F.desc("ts"), F.desc("wire"), "client", "server", "cport", "svc_port", "proto", "exporter", "in_if", "out_if", "dir", "vlan", "pkts", "src"]
    return rows.orderBy(*order).offset(max(0, offset)).limit(limit).select(F.unix_millis("ts").alias("ts_ms"), *RECORD)


def record_counts(tables: Tables, q: Query) -> DataFrame:
    """bucket, rows, flows: matching rows and flows per bucket; a flow counts in the minute it ended in."""
    step = step_for(q.span)
    q = q.aligned(step)
    return tables.detail(q).groupBy(q.bucket(step).alias("bucket")).agg(F.count("*").alias("rows"), F.sum("flows").alias("flows"))
