"""Most frequent items by three-phase threshold counting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from netloom.core.columns import address
from netloom.core.deliveries import first_deliveries
from netloom.core.shared import cut

LOCAL = "node long, item string, rows long, bytes long, lead boolean"


def _merge(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by("item").aggregate([("rows", "sum"), ("bytes", "sum")])
    return t.select(["item", "rows_sum", "bytes_sum"]).rename_columns(["item", "rows", "bytes"])


def local_counter(k: int, most: int):
    """Counts of one task's rows. A task that meets more than most items writes them out and goes on as a new node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, held, loose = TaskContext.get().partitionId(), 0, None, []

        def written(t: pa.Table) -> list[pa.RecordBatch]:
            marks = [pc.greater_equal(t[c], pc.min(pc.take(t[c], pc.select_k_unstable(t, min(k, len(t)), [(c, "descending")])))) for c in ("rows", "bytes")]
            lead = pc.or_(*marks)
            node = pa.array([task * 1_000_000 + turn] * len(t), pa.int64())
            return pa.table([node, t["item"], t["rows"], t["bytes"], lead], names=["node", "item", "rows", "bytes", "lead"]).to_batches(max_chunksize=20_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            loose.append(_merge([pa.Table.from_batches([batch])]))
            if sum(map(len, loose)) > most // 2:
                held = _merge([held, *loose] if held is not None else loose)
                loose = []
                if len(held) > most:
                    yield from written(held)
                    held, turn = None, turn + 1
        if held is not None or loose:
            yield from written(_merge([held, *loose] if held is not None else loose))

    return run


def frequent_items(rows: DataFrame, one_in: int | None = None, k: int = 100, most: int = 1_000_000) -> DataFrame:
    """measure, item, amount: items with at least one in one_in of all rows or of the sum of bytes, or else the k largest.

    rows: item string, bytes long, one row each; rows without item are left out, null bytes are 0, bytes are not negative.
    Ties at the k-th place are broken by item.  No rows, or a sum of 0, give no items for that measure.

    1. Each node (a task's rows, at most `most` items in memory) counts its own rows and names its k leaders; the k-th
    largest sum of the leaders is a lower bound of the k-th largest total.  2. An item that reaches the bound has at least
    bound / nodes on one node; all such items are candidates, at most nodes * sum / bound of them.  3. The counts of the
    candidates are summed over all nodes, so the amounts are exact.  A hot item enters the shuffle once per node.
    """
    clean = rows.where(F.col("item").isNotNull()).select("item", F.lit(1).cast("long").alias("rows"), F.coalesce(F.col("bytes").cast("long"), F.lit(0).cast("long")).alias("bytes"))
    local = cut(clean.mapInArrow(local_counter(max(k, one_in or 0), most), LOCAL), "local")
    total = local.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count_distinct("node").alias("nodes")).first()
    leaders = local.where("lead").groupBy("item").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    bound: dict[str, int] = {}
    for m in ("rows", "bytes"):
        if one_in:
            bound[m] = -(-(total[m] or 0) // one_in)
        else:
            best = leaders.orderBy(F.desc(m)).limit(k).agg(F.count("*").alias("n"), F.min(m).alias("least")).first()
            bound[m] = best.least if best.n == k else 1
    reach = [F.col(m) * total.nodes >= max(1, bound[m]) for m in bound]
    candidates = local.where(reach[0] | reach[1]).select("item").distinct()
    exact = cut(local.join(candidates, "item", "left_semi").groupBy("item").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")), "exact")
    out = None
    for m in bound:
        part = exact.where(F.col(m) >= max(1, bound[m])).select(F.lit(m).alias("measure"), "item", F.col(m).alias("amount"))
        part = part if one_in else part.orderBy(F.desc("amount"), "item").limit(k)
        out = part if out is None else out.unionByName(part)
    return out


def host_items(r_host: DataFrame) -> DataFrame:
    """item (plain address) and bytes of r_host, second deliveries once."""
    first = first_deliveries(r_host.select("ip", "bytes", "arrival_seq", "arrived"))
    return first.select(address(F.col("ip")).alias("item"), "bytes")
