"""Flow paths, two-level rings and lines on the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from netloom.functions.flow import COUNTRY_NAMED, OWN, PORT, SERVICE, total
from netloom.plans.query import Query
from netloom.plans.tables import Tables

OTHER = "__other__"
PATHS = {"host": (OWN, "app", COUNTRY_NAMED), "segment": ("segment", "app", COUNTRY_NAMED), "conv": ("client", PORT, "server")}
RINGS = {"server": "server", "client": "client", "service": SERVICE}


def _top(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """The n largest values of c, as column out; n rows, hence broadcast."""
    return F.broadcast(df.groupBy(c).agg(F.sum("wire").alias("_w")).orderBy(F.desc("_w"), c).limit(n).select(F.col(c).alias(out)))


def _fold(df: DataFrame, c: str, n: int, keep_other: bool = True) -> DataFrame:
    """c with all but its n largest values as OTHER."""
    top = _top(df, c, n, "_top")
    kept = F.col("_top").isNotNull() if keep_other else F.col("_top").isNotNull() & (F.col("_top") != OTHER)
    return df.join(top, F.col(c) == F.col("_top"), "left").withColumn(c, F.when(kept, F.col(c)).otherwise(F.lit(OTHER))).drop("_top")


def sankey(tables: Tables, q: Query, mode: str = "host", n0: int = 8, n2: int = 6) -> DataFrame:
    """c0, c1, c2, wire: traffic by three columns; all but the n0 and n2 largest of the first and last are '__other__'."""
    if mode not in PATHS:
        raise ValueError(f"unknown flow paths mode {mode!r}")
    rows = tables.detail(q).select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(PATHS[mode])], "wire")
    folded = _fold(rows, "c0", n0)
    # The last column is ranked over all rows, before the first one is folded.
    top = _top(rows, "c2", n2, "_top2")
    out = folded.join(top, F.col("c2") == F.col("_top2"), "left").withColumn("c2", F.when(F.col("_top2").isNotNull(), F.col("c2")).otherwise(F.lit(OTHER)))
    return out.groupBy("c0", "c1", "c2").agg(total("wire").alias("wire"))


def sankey_links(tables: Tables, q: Query, mode: str = "host") -> DataFrame:
    """side (1 or 2), source, target, wire: the chart's two sets of links, with 8, 6 and 6 nodes (8, 6, 8 for conv)."""
    n2 = 8 if mode == "conv" else 6
    links = sankey(tables, q, mode, 8, n2)
    for c, n in (("c0", 8), ("c1", 6), ("c2", n2)):
        links = _fold(links, c, n, keep_other=False) if c != "c1" else _fold(links, c, n)
    side = lambda k, a, b: links.groupBy(F.col(a).alias("source"), F.col(b).alias("target")).agg(F.sum("wire").alias("wire")).select(F.lit(k).alias("side"), "source", "target", "wire")
    return side(1, "c0", "c1").unionByName(side(2, "c1", "c2"))


def rings(tables: Tables, q: Query, inner: str, outer: str, n_inner: int = 8, n_outer: int = 8) -> DataFrame:
    """level (1 inner, 2 outer), parent, key, wire: the n_inner largest values, each split into its n_outer largest.

    The rest of either is '__other__', and values beyond the inner ones are not split.  Pairs are added up for the listed
    inner values only.
    """
    if inner == outer or inner not in RINGS or outer not in RINGS:
        raise ValueError(f"unknown ring pair {inner}/{outer}")
    rows = tables.detail(q)
    if "service" in (inner, outer):
        rows = rows.where("svc_port <> 0")
    rows = rows.select(F.expr(RINGS[inner]).alias("i"), F.expr(RINGS[outer]).alias("o"), "wire")
    top = _top(rows, "i", n_inner, "_top")
    pairs = rows.join(top, F.col("i") == F.col("_top"), "left").select(
        F.when(F.col("_top").isNotNull(), F.col("i")).otherwise(F.lit(OTHER)).alias("i"), F.when(F.col("_top").isNotNull(), F.col("o")).otherwise(F.lit(OTHER)).alias("o"), "wire"
    ).groupBy("i", "o").agg(F.sum("wire").alias("wire"))
    w = Window.partitionBy("i")
    ranked = pairs.withColumn("rn", F.row_number().over(w.orderBy(F.desc("wire"), "o")))
    name = F.when((F.col("rn") <= n_outer) & (F.col("i") != OTHER), F.col("o")).otherwise(F.lit(OTHER))
    outer_ring = ranked.groupBy(F.col("i").alias("parent"), name.alias("key")).agg(F.sum("wire").alias("wire")).where("wire > 0")
    inner_ring = pairs.groupBy(F.col("i").alias("key")).agg(F.sum("wire").alias("wire"))
    return inner_ring.select(F.lit(1).alias("level"), F.lit("").alias("parent"), "key", "wire").unionByName(outer_ring.select(F.lit(2).alias("level"), "parent", "key", "wire"))


def segment_countries(tables: Tables, q: Query, limit: int = 2000) -> DataFrame:
    """segment, country, wire of traffic with other networks, the largest first."""
    rows = tables.detail(q).where("dir in (1, 2) and peer_cc <> ''")
    return rows.groupBy("segment", F.col("peer_cc").alias("country")).agg(total("wire").alias("wire")).orderBy(F.desc("wire"), "segment", "country").limit(limit)


def geo_lines(tables: Tables, q: Query, origins: DataFrame) -> DataFrame:
    """source, target, wire between countries. origins: segment, cc; segments without one and traffic at home are left out."""
    own = origins.select("segment", F.col("cc").alias("source"))
    lines = segment_countries(tables, q).join(own, "segment").where("source <> '' and source <> country")
    return lines.groupBy("source", F.col("country").alias("target")).agg(F.sum("wire").alias("wire"))


