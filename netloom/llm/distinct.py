"""Distinct counts from multiresolution bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.core.columns import address, micros
from netloom.core.shared import cut

#: Bits of a level's bitmap (a power of two) and number of levels; up to BITS * 2**LEVELS identifiers.
SLOT_BITS, LEVELS = 15, 28
BITS = 1 << SLOT_BITS
#: A level filled beyond this share is saturated.
FULL = 0.8
#: What an estimate may be off in a comparison: so many standard errors, and so many identifiers, as a few that share a slot
#: by chance are more than a multiple of the deviation while both are small.
SURE, SLIPS = 5, 2


def sketch(rows: DataFrame, keys: list[str], identifier: str) -> DataFrame:
    """keys, level, word, bits: the bitmap words of each group that have a bit set; null identifiers are left out.

    The hash of an identifier picks its level (level l with probability 2**-(l+1)) and its bit there.  Words are OR-ed
    before the shuffle, so a group of any size brings at most BITS / 64 words per level and task.
    """
    h = F.xxhash64(identifier)
    high = F.shiftrightunsigned(h, SLOT_BITS).bitwiseOR(F.lit(1 << (LEVELS - 1)))
    level = F.bit_count(high.bitwiseAND(-high) - 1)  # trailing zeros
    slot = h.bitwiseAND(BITS - 1)
    marked = rows.where(F.col(identifier).isNotNull()).select(*keys, level.cast("int").alias("level"), slot.alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
    return marked.groupBy(*keys, "level", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of the union of the groups that share keys: days into weeks, parts into wholes."""
    return parts.groupBy(*keys, "level", "word").agg(F.bit_or("bits").alias("bits"))


def estimates(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, estimate, error (one standard deviation, as a share of the estimate).

    The lowest level that isn't saturated and all above it hold a 2**-base sample of the identifiers; each level counts by
    linear counting.  error comes from the levels used: what a bitmap of BITS slots loses to shared slots, m(e^t - t - 1) at t
    identifiers a slot, and from the sample's own spread.  It is about 0.4 per cent up to as many identifiers as slots and
    below 1 per cent at any number.
    """
    ones = parts.groupBy(*keys, "level").agg(F.sum(F.bit_count("bits")).alias("ones"))
    found = ones.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "ones"))).alias("ls"))  # at most LEVELS entries
    full = F.filter("ls", lambda x: x["ones"] > FULL * BITS)
    base = F.coalesce(F.array_max(F.transform(full, lambda x: x["level"])) + 1, F.lit(0))
    fill = lambda x: -F.log1p(-F.least(x["ones"], F.lit(BITS - 1)) / F.lit(float(BITS)))
    used = F.transform(F.filter("ls", lambda x: x["level"] >= F.col("base")), fill)
    add = lambda each: F.aggregate("fills", F.lit(0.0), lambda a, t: a + each(t))
    out = found.withColumn("base", base).withColumn("fills", used).withColumn("sample", add(lambda t: t * BITS))
    shared = add(lambda t: (F.exp(t) - t - 1) * BITS)
    error = F.sqrt(shared + F.col("sample") * (1 - F.pow(F.lit(2.0), -F.col("base")))) / F.col("sample")
    return out.select(*keys, (F.pow(F.lit(2.0), "base") * F.col("sample")).alias("estimate"), error.alias("error"))


def group_members(r_host: DataFrame, r_dim: DataFrame) -> DataFrame:
    """day (epoch day), part (finest group), id. part is 'dim=D', or 'role=R,internal=B' with B true, false or unknown."""
    day = F.floor(micros(F.col("ts")) / 86_400_000_000).cast("int")
    inner = F.when(F.col("internal").isNull(), "unknown").otherwise(F.col("internal").cast("string"))
    hosts = r_host.where("ts is not null and ip is not null and role is not null").select(
        day.alias("day"), F.concat(F.lit("role="), F.col("role").cast("string"), F.lit(",internal="), inner).alias("part"), address(F.col("ip")).alias("id")
    )
    values = r_dim.where("ts is not null and val is not null and dim is not null").select(
        day.alias("day"), F.concat(F.lit("dim="), "dim").alias("part"), F.substring_index("val", "\t", 1).alias("id")
    )
    return hosts.unionByName(values).where("id is not null")


def groups_of(part: Column) -> Column:
    """The reported groups a finest group belongs to."""
    role = F.substring_index(part, ",", 1)
    return (
        F.when(part.startswith("dim="), F.array(part))
        .when(part.endswith("=unknown"), F.array(role))
        .otherwise(F.array(role, part))
    )


def daily_sketches(r_host: DataFrame, r_dim: DataFrame) -> DataFrame:
    """day, grp, level, word, bits: sketched per finest group, the wider groups merged from them."""
    fine = sketch(group_members(r_host, r_dim), ["day", "part"], "id")
    return merged(fine.withColumn("grp", F.explode(groups_of(F.col("part")))), ["day", "grp"])


def _day_text(day: str) -> Column:
    return F.date_format(F.date_from_unix_date(F.col(day).cast("int")), "yyyy-MM-dd")


def _monday() -> Column:
    return (F.col("day") - F.pmod(F.col("day") + 3, F.lit(7))).cast("int")


def daily_counts(r_host: DataFrame, r_dim: DataFrame) -> DataFrame:
    """day, grp, estimate, error."""
    return estimates(daily_sketches(r_host, r_dim), ["day", "grp"]).withColumn("day", _day_text("day"))


def weekly_counts(r_host: DataFrame, r_dim: DataFrame) -> DataFrame:
    """week (its Monday), grp, days, estimate, error: the daily sketches of a week merged, no identifier read again."""
    daily = daily_sketches(r_host, r_dim).withColumn("week", _monday())
    return estimates(merged(daily, ["week", "grp"]), ["week", "grp"]).withColumn("week", _day_text("week"))


def exact_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: different ids per group. Ids are made distinct first, spread by id, so that no group is in one task."""
    return members.select(*keys, "id").distinct().groupBy(*keys).agg(F.count("*").alias("n"))


def in_groups(members: DataFrame, names: list[str] | None = None) -> DataFrame:
    """day, grp, id: members under each group they belong to; only the groups named, if any are."""
    grps = groups_of(F.col("part"))
    if names is None:
        return members.select("day", F.explode(grps).alias("grp"), "id")
    kept = F.filter(grps, lambda g: g.isin(names))
    return members.where(F.size(kept) > 0).select("day", F.explode(kept).alias("grp"), "id")


def judged_days(r_host: DataFrame, r_dim: DataFrame, times: float = 1.5) -> DataFrame:
    """day, grp, estimate, error, usual, busy, open: whether each day has at least times the group's median by the bitmaps,
    and whether that could be otherwise, SURE standard errors and SLIPS identifiers off."""
    est = cut(estimates(daily_sketches(r_host, r_dim), ["day", "grp"]), "estimates")
    usual = est.groupBy("grp").agg(F.median("estimate").alias("usual"), F.max("error").alias("worst"))
    limit = times * F.col("usual")
    slack = SURE * F.sqrt(F.pow(F.col("estimate") * F.col("error"), 2) + F.pow(limit * F.col("worst"), 2)) + SLIPS * (1 + times)
    return est.join(usual, "grp").select("day", "grp", "estimate", "error", "usual", (F.col("estimate") >= limit).alias("busy"), (F.abs(F.col("estimate") - limit) <= slack).alias("open"))


def busy_days(r_host: DataFrame, r_dim: DataFrame, times: float = 1.5) -> DataFrame:
    """day, grp: days with at least times as many different identifiers as on the group's median day.

    The bitmaps decide; an exact check follows for the groups of which some day is too close to its limit to tell (see
    judged_days): their days are counted exactly, and those counts decide.  The driver learns the names of these groups,
    roles and dims; identifiers stay where they are.  Rows with null ts, identifier, role or dim are left out; second
    deliveries and other spellings are the same identifiers and change nothing; empty tables give no rows.
    """
    judged = judged_days(r_host, r_dim, times)  # a few rows per group and day, from the estimates on disk
    names = [r.grp for r in judged.where("open").select("grp").distinct().collect()]
    decided = judged.where("busy").where(~F.col("grp").isin(names)).select("day", "grp")
    if not names:
        return decided.select(_day_text("day").alias("day"), "grp")
    exact = cut(exact_counts(in_groups(group_members(r_host, r_dim), names), ["day", "grp"]), "exact")
    usual = exact.groupBy("grp").agg(F.median("n").alias("usual"))
    settled = exact.join(usual, "grp").where(F.col("n") >= times * F.col("usual")).select("day", "grp")
    return decided.unionByName(settled).select(_day_text("day").alias("day"), "grp")


def within_error(r_host: DataFrame, r_dim: DataFrame, weekly: bool = False) -> DataFrame:
    """day (or week), grp, n, ok: exact counts, and whether the estimate lies within SURE stated errors and SLIPS identifiers of them. For
    checking the bitmaps; it reads every identifier."""
    members = in_groups(group_members(r_host, r_dim))
    key = "week" if weekly else "day"
    members = members.withColumn("week", _monday()) if weekly else members
    found = (weekly_counts if weekly else daily_counts)(r_host, r_dim)
    exact = exact_counts(members, [key, "grp"]).withColumn(key, _day_text(key))
    off = F.abs(F.col("estimate") - F.col("n"))
    return exact.join(found, [key, "grp"], "left").select(key, "grp", "n", F.coalesce(off <= SURE * F.col("error") * F.col("n") + SLIPS, F.lit(False)).alias("ok"))
