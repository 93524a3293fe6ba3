"""Whether sources deliver, what a page waits for, and the numbers a monitor reads."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

#: Seconds without data after which a source is silent; clock error, losses and drops worth a word.
SILENT_S, SKEW_S, LOST, DROPPED = 300, 120, 0.01, 0.0
CODES = ("silent", "waiting_sampling", "assumed_unsampled", "loss", "agent_drops", "no_template", "clock_skew", "decode_errors")


def source_health(sources: DataFrame, now: datetime) -> DataFrame:
    """exporter and codes of what is wrong with each source.

    sources: exporter, last_seen, pending (records that wait for a rate), assumed (taken as not sampled), received, lost,
    drops, no_template, skew_s, errors; nulls count as nothing wrong, a source never seen is silent.
    """
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    at = F.unix_seconds("last_seen")
    wrong = {
        "silent": at.isNull() | (at < int(now.timestamp()) - SILENT_S), "waiting_sampling": c("pending") > 0, "assumed_unsampled": F.coalesce(F.col("assumed"), F.lit(False)),
        "loss": c("lost") > LOST * (c("received") + c("lost")), "agent_drops": c("drops") > DROPPED, "no_template": c("no_template") > 0, "clock_skew": F.abs(c("skew_s")) > SKEW_S, "decode_errors": c("errors") > 0,
    }
    found = F.filter(F.array(*[F.when(wrong[n], F.lit(n)) for n in CODES]), lambda x: x.isNotNull())
    return sources.select("exporter", found.alias("codes"))


def waiting_for(datagrams: int, templates: bool, records: int, pending: int, rows: int, first_data: datetime | None, now: datetime, settle: timedelta = timedelta(minutes=1)) -> str:
    """What an installation that shows nothing yet waits for; '' once it shows something."""
    if not datagrams:
        return "nothing"
    if not templates and not records:
        return "templates"
    if pending and not rows:
        return "sampling"
    return "settling" if first_data is None or now - first_data < settle else ""


def rates(samples: DataFrame, weight: float = 0.6) -> DataFrame:
    """exporter, at, rate: records per second, smoothed: weight of the newest interval, the rest of what was before.

    samples: exporter, at (epoch seconds), records so far.  A count that fell starts over.  The smoothed value after k
    intervals is a sum of powers of 1 - weight, of which those beyond 16 don't count.
    """
    w = Window.partitionBy("exporter").orderBy("at")  # one row per exporter and interval of the sampler
    now = (F.col("records") - F.lag("records").over(w)) / (F.col("at") - F.lag("at").over(w))
    each = samples.withColumn("r", now).where("r is not null").withColumn("r", F.greatest("r", F.lit(0.0)))
    near = each.withColumn("last", F.collect_list("r").over(w.rowsBetween(-15, 0)))
    first = F.get("last", F.lit(0))
    smooth = F.aggregate(F.slice("last", 2, 16), first, lambda a, x: a * (1 - weight) + x * weight)
    return near.select("exporter", "at", smooth.alias("rate"))


def metrics_text(values: DataFrame) -> DataFrame:
    """line: values (name, labels map<string,string>, value) in the text form that monitors read."""
    label = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    shown = F.when(F.size(F.coalesce("labels", F.create_map().cast("map<string,string>"))) > 0, F.concat(F.lit("{"), label, F.lit("}"))).otherwise("")
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return values.select(F.concat("name", shown, F.lit(" "), number).alias("line"))
