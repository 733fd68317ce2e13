"""Event tables: curation of extracted terms, point-in-time event features, event studies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.safe import correlation
from tessera.operators.panel import nearest_events


def latest_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of the greatest run."""
    return df.join(df.agg(F.max(run).alias(run)), run, "left_semi")


def first_reason(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that holds, NULL if none does (a NULL condition does not)."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in rules.items()])


def without_rejected(rows: DataFrame, rejected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with no rejected row of the same keys, where NULL equals NULL."""
    r = rejected.select(*[F.col(k).alias(f"r_{k}") for k in keys]).distinct()
    on = [rows[k].eqNullSafe(r[f"r_{k}"]) for k in keys]
    return rows.join(r, on, "left_anti")


def event_dates(terms: DataFrame) -> DataFrame:
    """One row per source, kind and date of event: an id, counts and sums of its terms, days from listing, the primary source.

    The primary source is the first by rank, confidence (highest), document and term. Terms without a date are left out.
    Primary source and sums come from the same aggregation.
    """
    order = F.struct(F.coalesce("source_priority_rank", F.lit(2**31 - 1)), F.coalesce(-F.col("confidence"), F.lit(1e9)), F.coalesce("source_doc_id", F.lit("")), "term_id")
    given = terms.where("event_date is not null")
    keys = ["stock_code", "event_type", "event_date"]
    out = given.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("term_count"), F.count_distinct("party_name").alias("party_count"), F.sum("shares").alias("total_shares"), F.sum("pct_of_offer").alias("total_pct_of_offer"),
        F.max("lockup_months").alias("max_lockup_months"), F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence"),
        F.min_by(F.struct("source_priority", "source_doc_id", "source_page"), order).alias("p_"),
    )
    listing = given.where("event_type = 'listing_date'").groupBy("stock_code").agg(F.min("event_date").alias("listing_date"))
    out = out.join(listing, "stock_code", "left")
    name = F.md5(F.concat_ws("|", "stock_code", "event_type", F.col("event_date").cast("string")))
    return out.select(
        name.alias("event_id"), *keys, "listing_date", F.datediff("event_date", "listing_date").alias("days_from_listing"), "term_count", "party_count", "total_shares", "total_pct_of_offer",
        "max_lockup_months", "avg_confidence", "max_confidence", F.col("p_.source_priority").alias("primary_source_priority"), F.col("p_.source_doc_id").alias("primary_source_doc_id"),
        F.col("p_.source_page").alias("primary_source_page"),
    )


def event_features(calendar: DataFrame, events: DataFrame, families: Mapping[str, str], near_days: int = 5) -> DataFrame:
    """Days to the next and since the last event of each family per calendar row, and whether one is near.

    families: {name: kind of event}. `is_pre_` is 1 from `near_days` before an event to it, `is_near_` within as many
    days on either side, else 0. Point in time: only the dates of events are used.
    """
    near = nearest_events(calendar, events, ["stock_code"], "date", "event_date", list(families.values()), "event_type")
    out: list[Column] = []
    for name, kind in families.items():
        to, since = F.datediff(F.col(f"next_{kind}"), F.col("date")), F.datediff(F.col("date"), F.col(f"prev_{kind}"))
        out += [to.alias(f"days_to_next_{name}"), since.alias(f"days_since_prev_{name}")]
        out += [F.when(to.between(0, near_days), 1).otherwise(0).alias(f"is_pre_{name}"), F.when((to <= near_days) | (since <= near_days), 1).otherwise(0).alias(f"is_near_{name}")]
    return near.select("stock_code", "date", *out)


def event_window(panel: DataFrame, events: DataFrame, before: int = 10, after: int = 10, shift: int = 0, whole: bool = False) -> DataFrame:
    """Panel rows around each event, with `tau`, the offset in rows from the first row on or after the event (plus `shift`).

    panel: symbol, timestamp and others; events: symbol, event_id, event_date. With `whole`, only events whose whole window is in
    the panel. Overlapping windows repeat rows. The event's row is found by carrying row numbers over the union of
    days and events; the join that follows is on symbol and row number, so it does not grow with history.
    """
    rows = panel.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp")))
    days = rows.select("symbol", F.to_date("timestamp").alias("d"), "rn", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(1).alias("k"))
    marks = events.select("symbol", F.col("event_date").alias("d"), F.lit(None).cast("int").alias("rn"), "event_id", F.lit(0).alias("k"))
    ahead = Window.partitionBy("symbol").orderBy(F.col("d").desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = days.unionAll(marks).withColumn("rn0", F.last("rn", True).over(ahead)).where("k = 0 and rn0 is not null")
    wanted = placed.select("symbol", "event_id", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("tau"), "rn0").withColumn("rn", F.col("rn0") + shift + F.col("tau")).drop("rn0")
    out = wanted.join(rows, ["symbol", "rn"]).drop("rn")
    if whole:
        full = out.groupBy("symbol", "event_id").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") == before + after + 1)
        out = out.join(full, ["symbol", "event_id"], "left_semi")
    return out


def profile_by_tau(window: DataFrame, value: str = "ar", others: Sequence[str] = ()) -> DataFrame:
    """Mean abnormal return, its number of events, the cumulated mean, and the means of other columns, per offset."""
    by = window.groupBy("tau").agg(F.avg(value).alias("mean_ar"), F.count(value).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in others])
    return by.withColumn("car", F.sum("mean_ar").over(Window.orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)))  # one row per offset


def cumulated(window: DataFrame, start: int = -1, end: int = 3, value: str = "ar", first: Sequence[str] = ()) -> DataFrame:
    """Cumulated abnormal return per event over offsets start to end, and the first value there of other columns."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("tau"))).alias(c) for c in first]
    return window.where(F.col("tau").between(start, end)).groupBy("symbol", "event_id").agg(F.sum(value).alias("car"), F.count(value).alias("n"), *firsts)


def t_statistic(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, its t statistic and the number of values."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.try_divide(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))).alias("t"), F.count(x).alias("n"))


def welch(df: DataFrame, value: str, group: Column) -> DataFrame:
    """The two-sample t statistic of unequal variances between rows where `group` holds and where it does not."""
    rows = df.withColumn("g_", group)
    a, b = (F.when(F.col("g_") == g, F.col(value)) for g in (True, False))
    spread = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return rows.agg(F.count(a).alias("n_in"), F.count(b).alias("n_out"), F.avg(a).alias("mean_in"), F.avg(b).alias("mean_out"), F.try_divide(F.avg(a) - F.avg(b), spread).alias("t"))


def sign_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Values above, below and at 0: what a sign test needs (see selection.sign_test_p)."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"))


def median_split(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median and number of a value on either side of the median of another column (the median itself is low)."""
    middle = df.agg(F.median(by).alias("middle_"))  # one row
    split = df.join(F.broadcast(middle)).where(F.col(by).isNotNull()).withColumn("side", F.when(F.col(by) > F.col("middle_"), "high").otherwise("low"))
    return split.groupBy("side").agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count(value).alias("n"))


def safe_correlation(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation and number of pairs; NULL where a side is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return df.groupBy(*keys).agg(correlation(x, y).alias("corr"), F.count_if(x.isNotNull() & y.isNotNull()).alias("n"))


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys that only one of two tables has: side and the keys."""
    l, r = (d.select(*keys).distinct() for d in (left, right))
    return l.join(r, list(keys), "left_anti").withColumn("only_in", F.lit(names[0])).unionByName(r.join(l, list(keys), "left_anti").withColumn("only_in", F.lit(names[1])))


#: States of a check, the worst first: it could not be run, rows that must not be, rows to look at, none.
STATES = ("FAILED", "BLOCKED", "REVIEW_REQUIRED", "PASSED")


def audit(spark: SparkSession, checks: Mapping[str, tuple[bool, Callable[[], DataFrame]]]) -> DataFrame:
    """A row per check (check_name, failed, status) and one of name 'all' with the worst status and the sum.

    checks: name -> (whether it blocks, what gives a table with one number, the rows that fail). A check that cannot be planned, for
    want of a table or column say, has failed = NULL and the status FAILED.
    """
    rows = None
    for name, (blocks, make) in checks.items():
        try:
            one = make()
            part = one.select(F.lit(name).alias("check_name"), F.coalesce(one[one.columns[0]].cast("bigint"), F.lit(0)).alias("failed"))
            part = part.withColumn("state", F.when(F.col("failed") == 0, 3).otherwise(1 if blocks else 2))
        except AnalysisException:
            part = spark.range(1).select(F.lit(name).alias("check_name"), F.lit(None).cast("bigint").alias("failed"), F.lit(0).alias("state"))
        rows = part if rows is None else rows.unionByName(part)
    named = F.element_at(F.array(*map(F.lit, STATES)), F.col("state") + 1)
    total = rows.agg(F.lit("all").alias("check_name"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.min("state").alias("state"))
    return rows.unionByName(total).select("check_name", "failed", named.alias("status"))
