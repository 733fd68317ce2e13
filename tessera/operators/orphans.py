"""References to records that are missing, deleted, or not there yet.

Parents and children are put into one long table of tagged keys and grouped by parent table, key and period;
a child that no live parent precedes in its group is an orphan. A hot key does not make a hot group: children are
first counted per key and load time on the map side, and a key's history is cut by period, where a parent that
lives through the start of a period is carried into it as a row of its own.

A flag per group would say whether a key ever has a parent; since a parent is live for a time only, the flag is the
running number of live parents within the group, in order of time. The groups without one are written once; the report sums
their counts, and the rows are found by them, so each child table is scanned twice and the parent once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


@dataclass(frozen=True)
class Parent:
    """A table referred to: its key, and the columns between which a row is live (end NULL: still live)."""

    name: str
    df: DataFrame
    key: Column
    start: str
    end: str


@dataclass(frozen=True)
class Child:
    """A table that refers: its key, the time at which the reference must hold, and its row id."""

    name: str
    df: DataFrame
    key: Column
    at: str
    id: str


def number_key(code: Column) -> Column:
    """The number in a code, whatever the notation around it ('00427', '427 HK Equity', 'HK00427'); NULL without one."""
    return F.regexp_replace(F.nullif(F.regexp_extract(code, "([0-9]+)", 1), F.lit("")), "^0+(?=.)", "")


def _references(children: list[Child]) -> DataFrame:
    """All children in long form: table, key (NULL as an empty text), time, id."""
    parts = [
        c.df.select(F.lit(c.name).alias("table_name"), F.coalesce(c.key, F.lit("")).alias("key"),
                    F.col(c.at).cast("timestamp_ntz").alias("at"), F.col(c.id).cast("bigint").alias("row_id"))
        for c in children
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def orphan_groups(parent: Parent, children: list[Child]) -> DataFrame:
    """Groups of references without a live parent: table_name, key, at, n (rows).

    A NULL key, or one without a number, refers to nothing and is an orphan; a NULL time is one too, since no
    parent is live then. A parent is live at its start and not at its end; one without a start, or that ends before
    it starts, is never live. Repeated parents and children change nothing but the counts. With no children
    the result is empty; with no parents every child is an orphan.
    """
    counted = cut(_references(children).groupBy("table_name", "key", "at").agg(F.count(F.lit(1)).alias("n")))
    span = counted.agg(F.min("at"), F.max("at")).first()
    slot = lambda c: F.date_trunc("month", c).cast("timestamp_ntz")
    own = counted.select(F.lit(parent.name).alias("parent"), "key", slot(F.col("at")).alias("slot"), "at", F.lit(1).alias("kind"), F.lit(0).alias("delta"), "table_name", "n")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (span[0], span[1]))
    life = (
        parent.df.select(F.coalesce(parent.key, F.lit("")).alias("key"), F.col(parent.start).cast("timestamp_ntz").alias("s"), F.col(parent.end).cast("timestamp_ntz").alias("e"))
        .where("key <> '' and s is not null and (e is null or e > s)")
        .where((F.col("s") <= high) & (F.col("e").isNull() | (F.col("e") >= low)))
    )
    # A parent's begin, its end, and the months it lives into.
    first, last = F.greatest(slot(low), F.add_months(slot(F.col("s")), 1).cast("timestamp_ntz")), slot(F.least(F.coalesce("e", high), high))
    carried = F.when(last >= first, F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda m: F.struct(m.alias("at"), F.lit(1).alias("delta"))))
    ends = F.when(F.col("e").isNotNull(), F.array(F.struct(F.col("e").alias("at"), F.lit(-1).alias("delta"))))
    none = F.array().cast("array<struct<at: timestamp_ntz, delta: int>>")
    all_ = F.concat(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("delta"))), F.coalesce(ends, none), F.coalesce(carried, none))
    events = (
        life.select("key", F.explode(all_).alias("e_")).select("key", "e_.at", "e_.delta")
        .groupBy("key", "at").agg(F.sum("delta").cast("int").alias("delta"))
        .select(F.lit(parent.name).alias("parent"), "key", slot(F.col("at")).alias("slot"), "at", F.lit(0).alias("kind"), "delta", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("bigint").alias("n"))
    )
    w = Window.partitionBy("parent", "key", "slot").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    live = own.unionAll(events).withColumn("live", F.sum("delta").over(w))
    # A key without a number can have no parent, a time that is NULL no live one.
    return live.where("kind = 1 and (live <= 0 or at is null)").select("table_name", "key", "at", "n")


def orphan_rows(parent: Parent, children: list[Child]) -> DataFrame:
    """The orphan rows themselves: table_name, period ('yyyy-MM' of the time), row_id."""
    rows, groups = _references(children), cut(orphan_groups(parent, children))
    on = (rows.table_name == groups.table_name) & (rows.key == groups.key) & rows["at"].eqNullSafe(groups["at"])
    return rows.join(groups, on, "left_semi").select("table_name", F.date_format("at", "yyyy-MM").alias("period"), "row_id")


def orphan_report(parent: Parent, children: list[Child]) -> DataFrame:
    """Orphan rows and keys per table and period."""
    return (
        orphan_groups(parent, children)
        .groupBy("table_name", F.date_format("at", "yyyy-MM").alias("period"))
        .agg(F.sum("n").alias("orphan_rows"), F.count_distinct("key").alias("orphan_keys"))
    )
