"""Tables of records: upserts, the last version of each, searches, related records, lineage, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without a new version, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def last_version(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The greatest row of each key in an order; whole rows are combined on the map side, so a hot key is one row per task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v_")).select(*keys, "v_.*").select(*df.columns)


def search(df: DataFrame, **equal: str) -> DataFrame:
    """Rows whose columns, as texts, equal the given values; the conditions reach the scan."""
    for k, v in equal.items():
        df = df.where(F.col(k).cast("string") == F.lit(str(v)))
    return df


def recent(df: DataFrame, by: str, n: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *tie).limit(n)


def recency(age_days: Column, half_life: float) -> Column:
    """Halved every half-life; ages below 0 count as 0, and without a half-life it is 0."""
    return F.lit(0.0) if half_life <= 0 else F.pow(F.lit(0.5), F.greatest(age_days.cast("double"), F.lit(0.0)) / half_life)


def overlap(a: Column, b: Column) -> Column:
    """Shared by all entries of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def related(df: DataFrame, similarity: Column, tags: Column, wanted: Sequence[str], age_days: Column, half_life: float, n: int, tie: Sequence[str], least: float = 0.0) -> DataFrame:
    """The n most related records: 0.6 similarity, 0.3 shared tags, 0.1 recency, rounded to 6 places, at least `least`."""
    want = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    score = F.round(0.6 * similarity + 0.3 * overlap(tags, want) + 0.1 * recency(age_days, half_life), 6)
    return df.withColumn("score", score).where(F.col("score") >= least).orderBy(F.col("score").desc(), *tie).limit(n)


def lineage(df: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """Every record with its root and its depth below it. A parent that is not there makes a root; cycles have none and are left out.

    Pointer doubling: each round joins the open records with the records they point to, so that they point twice as
    far, and cuts the result from its lineage; depths up to d take log2(d) + 1 rounds. The record just beyond the reach of
    a round ends in it, so when none ends the open ones are proved to lead into cycles. Repeated ids give a row for
    each way to a root; if a cycle makes these endless, it is an error.
    """
    base = df.select(F.col(id).alias("id"), F.col(parent).alias("parent_id"))
    known = base.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    root, depth = F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("id")), F.when(F.col("known"), 1).otherwise(0)
    first = cut(base.join(known, "parent_id", "left").select("id", root.alias("root"), depth.alias("depth"), F.col("known").isNull().alias("ended")))
    out, open_ = first.where("ended"), first.where("not ended")
    reach, rows = 1, first.count()
    while not open_.isEmpty():
        to = out.unionAll(open_).select(F.col("id").alias("root"), F.col("root").alias("to"), F.col("depth").alias("more"), F.col("ended").alias("end"))
        level = cut(open_.join(to, "root").select("id", F.col("to").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("ended")))
        if level.where("ended").isEmpty():
            break
        if reach > rows:
            raise ValueError("a repeated id leads out of a cycle: its depth has no end")
        out, open_, reach = out.unionAll(level.where("ended")), level.where("not ended"), 2 * reach
    return out.select("id", "root", "depth")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row with a hash of a table that does not depend on the order of rows or columns, and its number of rows.

    Row hashes are added and xored, so nothing is sorted or collected; repeated rows count.
    """
    names = sorted(df.columns)
    h = F.xxhash64(*[F.col(c) for c in names])
    schema = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)
    sums = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"))
    return sums.select("rows", F.substring(F.sha2(F.concat_ws("|", F.lit(schema), "rows", "s", "x"), 256), 1, 16).alias("fingerprint"))


def classify(text: Column, patterns: Mapping[str, str], otherwise: str = "other") -> Column:
    """The name of the first pattern that a text matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()], F.lit(otherwise))


def new_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of a later snapshot whose key an earlier one does not have."""
    return after.join(before.select(key).distinct(), key, "left_anti")


def one_per(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first row of each key, and of those the first n."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_").orderBy(*order).limit(n)
