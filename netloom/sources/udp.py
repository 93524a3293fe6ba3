"""Datagrams off the network. Spark has no such source, and a socket can't be read twice, so they are landed in files first;
the stream reads the files and can start over from them."""

from __future__ import annotations

import os
import socket
import time
import uuid
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "payload binary, exporter string, arrived timestamp, arrival_seq long"
#: Where the numbering of datagrams starts: the seconds since then times 65,536 stay far below 2**46.
SINCE = int(datetime(2025, 1, 1, tzinfo=timezone.utc).timestamp())
_ARROW = pa.schema([("payload", pa.binary()), ("exporter", pa.string()), ("arrived", pa.timestamp("us", "UTC")), ("arrival_seq", pa.int64())])


def land(sock: socket.socket, folder: str, blocked: frozenset[str] = frozenset(), seconds: float = 1.0, until: float | None = None) -> int:
    """Write what arrives on a bound socket to files in folder, one each `seconds`; those from blocked addresses are dropped
    unread. Runs until the given time (for ever by default); the number of datagrams written."""
    os.makedirs(folder, exist_ok=True)
    seq, rows = (int(time.time()) - SINCE) << 16, []  # later than any number of an earlier run
    sock.settimeout(min(seconds, 0.2))
    due, written = time.time() + seconds, 0
    while until is None or time.time() < until:
        try:
            raw, (sender, *_) = sock.recvfrom(65_535)
            if sender not in blocked:
                seq += 1
                rows.append((raw, sender.removeprefix("::ffff:"), datetime.now(timezone.utc), seq))
        except TimeoutError:
            pass
        if time.time() >= due:
            written += _write(rows, folder)
            rows, due = [], time.time() + seconds
    return written + _write(rows, folder)


def _write(rows: list[tuple], folder: str) -> int:
    if rows:
        name = f"{time.time_ns()}-{uuid.uuid4().hex}.parquet"
        hidden = os.path.join(folder, "." + name)
        pq.write_table(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW), hidden)
        os.rename(hidden, os.path.join(folder, name))  # whole when it is seen
    return len(rows)


def stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The landed datagrams as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
