"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from netloom.core.arrow import spread
from netloom.core.shared import cut
from netloom.llm import tokens

#: Items of one size that one task ranks, roughly.
RANKED = 200_000


class Gaps:
    """Open containers by free room, as ranges of container numbers."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.ranges or not self.ranges[room]:
                insort(self.rooms, room)
            self.ranges[room].append((first, n))

    def take(self, size: int, n: int) -> tuple[int, int, int] | None:
        """Room, first container and number of at most n containers with the least room that holds size."""
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, have = self.ranges[room].pop()
        if have > n:
            self.ranges[room].append((first + n, have - n))
        if not self.ranges[room]:
            self.rooms.pop(i)
        return room, first, min(n, have)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, rank, container, n): the n items of that size from that rank on go to n consecutive containers; and the
    number of containers.

    Only the number of items of each size matters, so the plan's work depends on the capacity and hardly on the number of
    items.  Sizes above a third of the capacity come two to a container at most: each, from the largest, is matched with the
    largest that still fits beside it.  The smaller ones, from the largest, go where they leave the least room, and open new
    containers only when they fit nowhere.
    """
    runs: list[tuple[int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n and 0 < s <= capacity}
    rank = dict.fromkeys(left, 0)
    gaps, opened = Gaps(), 0

    def put(size: int, container: int, n: int) -> None:
        runs.append((size, rank[size], container, n))
        rank[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        fits = bisect_left(large, capacity - size + 1) - 1
        partner = large[fits] if fits >= 0 else None
        if partner == size and left[size] == 1:
            partner = large[fits - 1] if fits else None
        if partner is None:
            n = left[size]
            put(size, opened, n)
            gaps.add(capacity - size, opened, n)
        else:
            n = left[size] // 2 if partner == size else min(left[size], left[partner])
            put(size, opened, n)
            put(partner, opened, n)
            gaps.add(capacity - size - partner, opened, n)
        opened += n
        large = [s for s in large if left[s]]
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            found = gaps.take(size, left[size])
            if found is None:
                n = -(-left[size] // (capacity // size))
                gaps.add(capacity, opened, n)
                opened += n
                continue
            room, first, n = found
            put(size, first, n)
            gaps.add(room - size, first, n)
    return runs, opened


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens; a null text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [tokens.count(t.as_py(), path) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, tokens long")


def containers(documents: DataFrame, capacity: int, path: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, piece, from_token, tokens, container: every document in a container of capacity tokens.

    Only a document of more than capacity tokens is divided: into pieces of exactly capacity tokens, which fill containers
    of their own, and the rest, which is an item like any other.  Empty and null texts have no tokens and go to containers
    in turn (to container 0 if there is no other).  Repeated rows are items of their own; an empty table gives no rows.

    The driver sees one count per size, at most capacity of them.  Items of one size are numbered in hashed parts and the
    parts' offsets added, so a size that a third of all documents share is not numbered by one task.
    """
    sized = cut(token_counts(documents, path), "tokens")
    cap = F.lit(capacity).cast("long")
    items = sized.select(
        "doc_id", F.col("tokens").alias("all"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(tokens + {capacity - 1}) div {capacity}") - 1, F.lit(0)))).alias("piece"),
    ).select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * cap).alias("from_token"), F.least(F.col("all") - F.col("piece") * cap, cap).alias("tokens"))
    counts = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    parts = max(32, sum(counts.values()) // RANKED)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    offsets = items.groupBy("tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("tokens", "part").orderBy("doc_id", "piece")
    ranked = items.join(offsets, ["tokens", "part"]).withColumn("rank", F.col("offset") + F.row_number().over(order) - 1)

    runs, opened = plan(counts, capacity)
    grouped: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size, rank, container, _ in runs:
        grouped[size].append((rank, container))
    # A few runs per size, whatever the number of documents: small enough to broadcast.
    table = {size: tuple(np.array(x, np.int64) for x in zip(*sorted(own))) for size, own in grouped.items()}
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("tokens").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            out = rank % max(1, opened)
            for s in np.unique(size):
                if s:
                    here = size == s
                    ranks, first = shared.value[int(s)]
                    i = np.searchsorted(ranks, rank[here], "right") - 1
                    out[here] = first[i] + rank[here] - ranks[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "from_token", "tokens")), pa.array(out, pa.int64())], names=["doc_id", "piece", "from_token", "tokens", "container"])

    return ranked.select("doc_id", "piece", "from_token", "tokens", "rank").mapInArrow(place, "doc_id long, piece int, from_token long, tokens long, container long")
