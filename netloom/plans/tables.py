"""The tables of an installation, and which of them answer a query."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netloom.core.columns import address, as_timestamp
from netloom.plans.query import LONG_RANGE, Query

DEVICE, IN, OUT, BOTH = range(4)
#: What a flow row holds where nothing is known.
BLANK = {"bytes": 0, "wire": 0, "pkts": 0, "flows": 0, "peer_cc": "", "peer_asn": 0, "peer_org": "", "segment": "", "threat": "", "app": "", "dup": False}


ARRIVAL = ("arrival_seq", "arrived")


def once(df: DataFrame, needed: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """One delivery of each record. Copies are equal but for their arrival, so any order among equal arrivals will do.

    also: columns that questions put conditions on.  Equal in all copies, they are part of the key, so Catalyst moves such
    conditions below the shuffle and down to the scan.
    """
    keyed = df.where("arrival_seq is not null")
    w = Window.partitionBy("arrival_seq", *also).orderBy(F.col("arrived").asc_nulls_last())
    first = keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return first.select(*needed).unionByName(df.where("arrival_seq is null").select(*needed))


def has_arrivals(df: DataFrame) -> bool:
    return set(ARRIVAL) <= set(df.columns)


def blanked_flows(hot: DataFrame) -> DataFrame:
    """Flow rows as queries take them, but for second deliveries: rows without ts left out, blanks for nulls."""
    rows = hot.where("ts is not null").withColumn("ts", as_timestamp(F.col("ts")))
    return rows.fillna({k: v for k, v in BLANK.items() if k in rows.columns})


def clean_flows(hot: DataFrame) -> DataFrame:
    """blanked_flows, each record once."""
    rows = blanked_flows(hot)
    return once(rows, [c for c in rows.columns if c not in ARRIVAL], ("ts",)) if has_arrivals(rows) else rows


def clean_rollup(df: DataFrame, key: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Partial rows of a rollup, each once; rows without ts or key left out, null sums 0."""
    rows = df.where("ts is not null").withColumn("ts", as_timestamp(F.col("ts")))
    rows = once(rows, [c for c in rows.columns if c not in ARRIVAL], ("ts", *also)) if has_arrivals(rows) else rows
    rows = rows.withColumn(key, address(F.col(key))) if key == "ip" else rows
    return rows.where(F.col(key).isNotNull()).fillna(0, ["bytes", "wire", "pkts", "flows"])


@dataclass(frozen=True)
class View:
    """Which summaries a query's filters describe: all traffic (no key), or one device or interface and its sides."""

    key: str = ""
    sides: tuple[int, ...] = ()


def view_of(q: Query) -> View | None:
    """None if the filters narrow the query in a way that only the flow rows can answer."""
    key = device = ""
    sides = {IN, OUT, BOTH}
    for f in q.filters:
        wanted = {"iface": {IN, OUT, BOTH}, "iface_in": {IN, BOTH}, "iface_out": {OUT, BOTH}}.get(f.field)
        if f.neg or (wanted is None and f.field != "exporter"):
            return None
        if wanted is None:
            if device not in ("", f.value):
                return None
            device = f.value
            continue
        if key not in ("", f.value):
            return None
        key, sides = f.value, sides & wanted
    if not q.filters:
        return View()
    if not key:
        return View(device, (DEVICE,))
    if (device and not key.startswith(device + "/")) or not sides:
        return None
    return View(key, tuple(sorted(sides)))


@dataclass(frozen=True)
class Tables:
    """flows and the rollups built from them. Rollups may be missing; queries then read flows.

    flows may hold second deliveries (then with arrival_seq and arrived); read them with rows() or detail().
    """

    flows: DataFrame
    r_ts: DataFrame | None = None
    r_host: DataFrame | None = None
    r_dim: DataFrame | None = None
    r_ts_if: DataFrame | None = None
    r_dim_if: DataFrame | None = None
    ifc: DataFrame | None = None
    data_from: datetime | None = None

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Tables:
        t = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
        return Tables(blanked_flows(t("hot")), clean_rollup(t("r_ts"), "app"), clean_rollup(t("r_host"), "ip", ("role",)), clean_rollup(t("r_dim"), "val", ("dim",)), ifc=t("ifc"))

    def rows(self, cond: Column | None = None) -> DataFrame:
        """The flow rows for which cond holds, each record once.

        The condition comes first: copies of a record agree on it, so what it leaves out never enters the shuffle that
        finds copies, and its bounds reach the scan.
        """
        rows = self.flows if cond is None else self.flows.where(cond)
        return once(rows, [c for c in rows.columns if c not in ARRIVAL], ("ts",)) if has_arrivals(rows) else rows

    @staticmethod
    def _parts(df: DataFrame, q: Query) -> DataFrame:
        """The partitions of a stored table that a query's range touches; tables without partitions as they are."""
        if "date" in df.columns:
            df = df.where(F.col("date").between(F.lit(q.start.date()), F.lit(q.end.date())))
        if "hour" in df.columns and q.start.date() == q.end.date():
            df = df.where(F.col("hour").between(q.start.hour, q.end.hour))
        return df

    def rollup(self, q: Query, name: str) -> DataFrame | None:
        """The rows of rollup `name` (r_ts, r_host or r_dim) that answer q, or None if the flow rows must.

        Summaries serve ranges over six hours with no filter but a device or interface; by address only all traffic has
        one.  Decide before rounding the range: a rounded six-hour range must not switch to summaries.
        """
        v = view_of(q)
        if v is None or q.span <= LONG_RANGE:
            return None
        if not v.key:
            whole = getattr(self, name)
            return None if whole is None else self._parts(whole, q).where(q.in_range())
        part = getattr(self, f"{name}_if", None)
        return None if part is None else self._parts(part, q).where((F.col("iface") == v.key) & F.col("side").isin(*v.sides) & q.in_range())

    def detail(self, q: Query) -> DataFrame:
        return replace(self, flows=self._parts(self.flows, q)).rows(q.where())

    def without_rollups(self) -> Tables:
        return replace(self, r_ts=None, r_host=None, r_dim=None, r_ts_if=None, r_dim_if=None)
