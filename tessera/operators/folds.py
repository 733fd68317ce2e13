"""Walk-forward folds, holdouts and splits: small date arithmetic on the driver, one distributed evaluation for all folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import evaluate

#: Folds the driver writes out; a range join with them is a nested loop over this few rows.
MOST_FOLDS = 1000


@dataclass(frozen=True)
class Folds:
    """How a span is cut: at most `count` windows of `size` days, `step` apart, each less `embargo` days at its end, of at least `least` days.

    Without an embargo it is as long as the labels look ahead: their lag and horizon.
    """

    count: int = 4
    size: int = 90
    step: int = 45
    embargo: int | None = 2
    least: int = 20
    lag: int = 1
    horizon: int = 1

    @property
    def gap(self) -> int:
        return self.lag + self.horizon if self.embargo is None else self.embargo


def windows(start: date, end: date, rule: Folds) -> list[tuple[int, date, date]]:
    """(fold, first day, last day). A window that ends after the span ends the list; one that is too short uses up its turn."""
    out = []
    for i in range(min(rule.count, MOST_FOLDS)):
        first = start + timedelta(days=i * rule.step)
        gross = first + timedelta(days=rule.size - 1)
        if gross > end:
            break
        last = gross - timedelta(days=rule.gap)
        if (last - first).days + 1 >= rule.least:
            out.append((i, first, last))
    return out


@dataclass(frozen=True)
class Plan:
    """The folds of a span, how many were tried and how many of these were too short, and why there is no walk-forward, if so."""

    folds: list[tuple[int, date, date]]
    attempted: int
    embargo: int
    skipped: str | None

    @property
    def purged(self) -> int:
        return max(0, self.attempted - len(self.folds))


def plan(start: date, end: date, rule: Folds) -> Plan:
    """The plan of a walk-forward. With fewer than two folds it is skipped: then the whole span is one fold, number -1."""
    kept = windows(start, end, rule)
    tried = sum(start + timedelta(days=i * rule.step + rule.size - 1) <= end for i in range(min(rule.count, MOST_FOLDS)))
    return Plan(kept, tried, rule.gap, "span too short" if len(kept) < 2 else None)


def planned(panel: DataFrame, start: date, end: date, rule: Folds, keys: Sequence[str] = ()) -> DataFrame:
    """walk_forward over the plan of a span, or over the whole span where that is skipped, with `skipped`."""
    p = plan(start, end, rule)
    spans = [(-1, start, end)] if p.skipped else p.folds
    return walk_forward(panel, spans, rule.lag, rule.horizon, keys).withColumn("skipped", F.lit(p.skipped).cast("string"))


def holdout_span(start: date, end: date, share: float) -> tuple[tuple[date, date], tuple[date, date]]:
    """The span without its last days, and those: a share of its days, rounded to even, at least one, never all."""
    total = (end - start).days + 1
    days = min(max(1, round(total * share)), total - 1)
    cut = end - timedelta(days=days)
    return (start, cut), (cut + timedelta(days=1), end)


def add_months(day: date, months: int) -> date:
    """The same day some months later, or the month's last."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


def month_splits(start: date, end: date, first: int, second: int, step: int, gap: int = 0) -> list[tuple[date, date, date, date]]:
    """Rolling pairs of spans (a training and a test one, in months, with a gap of days between) that fit before the end."""
    out, at = [], start
    while True:
        a_end = add_months(at, first) - timedelta(days=1)
        b = a_end + timedelta(days=1 + gap)
        b_end = add_months(b, second) - timedelta(days=1)
        if b_end > end:
            return out
        out.append((at, a_end, b, b_end))
        at = add_months(at, step)


def frame(spark: SparkSession, folds: Sequence[tuple[int, date, date]]) -> DataFrame:
    if len(folds) > MOST_FOLDS:
        raise ValueError("too many folds")
    return spark.createDataFrame(list(folds), "fold int, fold_start date, fold_end date")


def assign(df: DataFrame, folds: Sequence[tuple[int, date, date]], time: str = "timestamp") -> DataFrame:
    """Rows with the folds they lie in (windows may overlap, rows then repeat); no shuffle, the folds are at most MOST_FOLDS rows."""
    f = F.broadcast(frame(df.sparkSession, folds))
    return df.join(f, F.to_date(df[time]).between(f.fold_start, f.fold_end)).drop("fold_start", "fold_end")


def walk_forward(panel: DataFrame, folds: Sequence[tuple[int, date, date]], lag: int = 1, horizon: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics per fold in one job. The signal comes with the panel, made over all of it; returns are made inside each fold."""
    rows = assign(panel.select(*keys, "symbol", "timestamp", "close", "signal"), folds)
    labelled = evaluate.with_forward(rows, [*keys, "fold", "symbol"], horizons={"fwd": (lag, horizon)})
    return evaluate.evaluation(labelled, [*keys, "fold"])


#: How what is no mean over folds is put together: the worst of concentrations, the least of counts.
OVER_FOLDS = {"tail_concentration": F.max, "median_share": F.max, "max_share": F.max, "least_gains": F.min, "hit_rate": F.avg, "vol": F.avg, "same_sign": F.min, "max_correlation": F.max, "lift": F.avg, "positive_lift": F.avg}


def summarise(per_fold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Over folds: means, the population deviation of rank-IC, the share of folds in which it is positive, periods and assets."""
    means = [F.avg(c).alias(c) for c in ("ic", "rank_ic", "quantile_spread", "net_spread", "turnover", "sharpe", "max_drawdown")]
    return per_fold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), *means, F.coalesce(F.stddev_pop("rank_ic"), F.lit(0.0)).alias("rank_ic_deviation"),
        F.avg(F.when(F.col("rank_ic") > 0, 1.0).when(F.col("rank_ic").isNotNull(), 0.0)).alias("positive_share"),
        F.sum("n_periods").alias("n_periods"), F.max("n_assets").alias("n_assets"), *[how(c).alias(c) for c, how in OVER_FOLDS.items() if c in per_fold.columns],
    )


def date_blocks(days: DataFrame, count: int, drop: int, least: int = 5, day: str = "timestamp") -> DataFrame:
    """Distinct days in `count` consecutive blocks (the first ones longer), each without its last `drop` days, if `least` remain.

    The windows run over one row per day.
    """
    d = days.select(F.to_date(day).alias("day")).distinct().withColumn("block", F.ntile(count).over(Window.orderBy("day")))
    d = d.withColumn("from_end", F.row_number().over(Window.partitionBy("block").orderBy(F.col("day").desc()))).where(F.col("from_end") > drop)
    kept = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("block")))
    return kept.where(F.col("n") >= least).select("block", "day")
