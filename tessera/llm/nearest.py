"""Pairing each record with the nearest record in time of the same entity, within a tolerance.

Time is cut into buckets at least as wide as a probe's tolerance, so its nearest candidate lies in its own bucket or an adjacent one.
Probes fall into classes of tolerance, each with its own width, so a wide probe does not widen the buckets of the others.
Probes go to three buckets of their class; records go to their bucket in every class, unless no probe can have it: a filter of a
fixed size keeps those out of the shuffle. The two sides of a bucket are joined by merging them in time order: each probe
takes the last candidate before it and the first one after it. No pairs are formed, so a crowded bucket costs what it
holds, not the product of its sides. A bucket with too many candidates is salted: the candidates are spread, each salt is
searched, and the nearest over all salts is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut
from tessera.skew import heavy_groups, may_match, salt_of

#: Buckets of a class are at most this many times as wide as the tolerances in it.
STEP = 8


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def nearest_in_time(
    probes: DataFrame, records: DataFrame, *, probe_id: str, probe_time: str, tolerance_ms: str, record_id: str, record_time: str,
    keys: list[tuple[Column, Column]], hot_rows: int = 1_000_000,
) -> DataFrame:
    """For each probe the record with equal keys and the least time difference, if that is within the probe's tolerance.

    keys: pairs of expressions (of a probe, of a record) that must be equal. Gives `probe_id`, `record_id`.
    On a tie the smallest record id wins, whichever side of the probe it lies on. Probes without a match, and
    probes or records with a NULL in a key or time, are left out; so are probes with a NULL or negative tolerance.
    Records repeated under other ids are ties; a probe repeated under its id counts once. Empty tables give no rows.
    """
    names = [f"k{i}" for i in range(len(keys))]
    p = probes.select(
        F.col(probe_id).cast("bigint").alias("pid"), _micros(probe_time).alias("at"), (F.col(tolerance_ms).cast("bigint") * 1000).alias("tol"),
        *[a.alias(n) for n, (a, _) in zip(names, keys, strict=True)],
    ).where(" and ".join(f"{n} is not null" for n in ("at", *names)) + " and tol >= 0")
    # The class of a tolerance: the powers of STEP below it, so there are at most 22 in use.
    level = sum((F.col("tol") > STEP**k).cast("int") for k in range(21))
    p = p.withColumn("cls", level)
    classes = sorted(x[0] for x in p.select("cls").distinct().collect())
    r = records.select(
        F.col(record_id).cast("bigint").alias("rid"), _micros(record_time).alias("at"), *[b.alias(n) for n, (_, b) in zip(names, keys, strict=True)]
    ).where(" and ".join(f"{n} is not null" for n in ("rid", "at", *names)))
    own = lambda c: F.struct(F.lit(c).alias("cls"), F.floor(F.col("at") / F.lit(STEP**c)).alias("bucket"))
    near = lambda c: F.array(*[F.struct(F.lit(c).alias("cls"), (F.floor(F.col("at") / F.lit(STEP**c)) + d).alias("bucket")) for d in (-1, 0, 1)])
    buckets = F.coalesce(*[F.when(F.col("cls") == c, near(c)) for c in classes], near(0))
    p = p.withColumn("b_", F.explode(buckets)).select("pid", "at", "tol", *names, "b_.cls", "b_.bucket")
    r = r.withColumn("b_", F.explode(F.array(*map(own, classes or [0])))).select("rid", "at", *names, "b_.cls", "b_.bucket")
    group = [*names, "cls", "bucket"]
    r = cut(may_match(r, p, group))
    hot = heavy_groups(r, group, hot_rows)
    if hot is not None:
        hot = hot.withColumn("salts", F.ceil(F.col("rows_") / hot_rows).cast("int")).drop("rows_")
        salts = F.coalesce("salts", F.lit(1))
        r = r.join(hot, group, "left").withColumn("salt", salt_of(F.col("rid"), salts)).drop("salts")
        p = p.join(hot, group, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        group = [*group, "salt"]
    r = r.select(*group, "at", "rid", F.lit(None).cast("bigint").alias("pid"), F.lit(None).cast("bigint").alias("tol"))
    p = p.select(*group, "at", F.lit(None).cast("bigint").alias("rid"), "pid", "tol")
    both = r.unionAll(p)
    seen = F.when(F.col("rid").isNotNull(), F.struct("at", "rid"))
    # Records sort before probes of the same time, and larger ids before smaller ones, so the last one seen is the best.
    back = Window.partitionBy(*group).orderBy("at", F.col("rid").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*group).orderBy(F.col("at").desc(), F.col("rid").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.last(seen, True).over(back)).withColumn("after", F.last(seen, True).over(ahead)).where("pid is not null")
    near = both.select("pid", "tol", "at", F.explode(F.array("before", "after")).alias("c")).where("c is not null")
    near = near.withColumn("gap", F.abs(F.col("c.at") - F.col("at"))).where("gap <= tol")
    best = near.groupBy("pid").agg(F.min(F.struct("gap", F.col("c.rid").alias("rid"))).alias("b"))
    return best.select(F.col("pid").alias("probe_id"), F.col("b.rid").alias("record_id"))
