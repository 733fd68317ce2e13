"""Queries of the expression language over the daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expression
from tessera.operators import panel as panels
from tessera.operators import selection
from tessera.plans.common import FACTORS, PANEL, bars, rank_sql, rounded
from tessera.tables import table

_W = "over (partition by symbol order by timestamp{0})"
_ROWS = lambda n: _W.format(f" rows {n - 1} preceding")
_PLAIN = _W.format("")
_Z = "({0} - avg({0}) over (partition by timestamp)) / nullif(stddev_samp({0}) over (partition by timestamp), 0)"

#: name: (expression, the same as SQL steps over `panel`; the last step is the value)
EXPRESSIONS = {
    "dsl_ts_mean": ("ts_mean(close, 20)", [f"avg(close) {_ROWS(20)}"]),
    "dsl_ts_std": ("ts_std(close, 10)", [f"stddev_samp(close) {_ROWS(10)}"]),
    "dsl_ts_sum": ("ts_sum(volume, 7)", [f"sum(volume) {_ROWS(7)}"]),
    "dsl_ts_min": ("ts_min(low, 15)", [f"min(low) {_ROWS(15)}"]),
    "dsl_ts_max": ("ts_max(high, 15)", [f"max(high) {_ROWS(15)}"]),
    "dsl_ts_delta": ("ts_delta(close, 3)", [f"close - lag(close, 3) {_PLAIN}"]),
    "dsl_lag": ("lag(vwap, 2) + ts_lag(vwap, 4)", [f"lag(vwap, 2) {_PLAIN} + lag(vwap, 4) {_PLAIN}"]),
    "dsl_rank": ("rank(volume)", [f"case when volume is not null then {rank_sql('volume')} / count(volume) over (partition by timestamp) end"]),
    "dsl_zscore": ("zscore(close)", [_Z.format("close")]),
    "dsl_arith": ("-(close - open) / (high - low) * 2 + 3 / 4", ["-(close - open) / nullif(high - low, 0) * 2 + 0.75"]),
    "dsl_nested": (
        "rank(ts_mean(zscore(close), 5)) - zscore(ts_std(rank(volume), 10))",
        [
            f"{_Z.format('close')} as a, case when volume is not null then {rank_sql('volume')} / count(volume) over (partition by timestamp) end as b",
            f"avg(a) {_ROWS(5)} as c, stddev_samp(b) {_ROWS(10)} as d",
            f"case when c is not null then {rank_sql('c')} / count(c) over (partition by timestamp) end - {_Z.format('d')}",
        ],
    ),
}


def _query(text: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(expression.with_factors(bars(spark, folder), {"value": text}).select("symbol", "timestamp", "value"))

    run.__doc__ = f"The value of {text} for every bar."
    return run


def _sql(steps: list[str]) -> str:
    source, ctes = "panel", [PANEL]
    for i, step in enumerate(steps[:-1]):
        ctes.append(f"x{i} as (select *, {step} from {source})")
        source = f"x{i}"
    return f"with {', '.join(ctes)} select symbol, timestamp, round({steps[-1]}, 6) + 0.0 as value from {source}"


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    days = bars(spark, folder).select(F.col("symbol").alias("stock_code"), F.col("timestamp").alias("date"))
    near = panels.nearest_events(days, table(spark, folder, "ipo_event_dates_curated"), ["stock_code"], "date", "event_date", ["cornerstone_lockup_expiry"], "event_type")
    to = F.datediff("next_cornerstone_lockup_expiry", "date").cast("double")
    return bars(spark, folder).join(near.select(F.col("stock_code").alias("symbol"), F.col("date").alias("timestamp"), to.alias("days_to_next")), ["symbol", "timestamp"], "left")


def dsl_event_decay(spark: SparkSession, folder: str) -> DataFrame:
    """A decaying weight of the distance to the next lock-up expiry, 0 without one, as a field beyond the basic ones."""
    out = expression.with_factors(_distances(spark, folder), {"value": "event_decay(days_to_next, 10)"}, extra_fields=["days_to_next"])
    return rounded(out.select("symbol", "timestamp", "value"))


def dsl_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Several factors in one pass: the number of values and the mean of each."""
    out = expression.with_factors(bars(spark, folder), FACTORS)
    entries = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("value")) for k in FACTORS])
    long = out.select(F.explode(entries).alias("e")).select("e.*")
    return rounded(long.groupBy("factor").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


def dsl_single_series(spark: SparkSession, folder: str) -> DataFrame:
    """Without a symbol: expanding z-score of the market's mean close per day."""
    market = bars(spark, folder).groupBy("timestamp").agg(F.avg("close").alias("close"))
    return rounded(expression.with_factors(market, {"value": "zscore(close)"}, symbol=None).select("timestamp", "value"))


#: Expressions whose novelty is judged: the listed factors, their variations, and some equal to others.
KNOWN = sorted({v for text in FACTORS.values() for v, _ in expression.variations(text)} | set(FACTORS.values()) | {"(ts_mean(volume, 5)) / ts_mean(volume, 20)", "(-low + high) / close"})


def _classes() -> dict[str, str]:
    return {text: expression.canonical_id(expression.parse(text)) for text in KNOWN}


def _class_features() -> list[tuple[str, str, int]]:
    forms = {expression.canonical_id(t := expression.parse(text)): expression.canonical(t) for text in KNOWN}
    return sorted((c, repr(f), n) for c, form in forms.items() for f, n in expression.features(form).items())


def novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Each known expression with the class of expressions equal to it, and how many other classes resemble that."""
    linked = selection.links(spark.createDataFrame(_class_features(), "candidate string, feature string, n int"), 0.7)
    classes = spark.createDataFrame(sorted(_classes().items()), "expression string, class string")
    return classes.join(linked.withColumnRenamed("candidate", "class"), "class").select("expression", "class", "links")


QUERIES = {k: _query(text) for k, (text, _) in EXPRESSIONS.items()} | {
    "dsl_event_decay": dsl_event_decay, "dsl_batch": dsl_batch, "dsl_single_series": dsl_single_series, "novelty": novelty,
}
SQL = {k: _sql(steps) for k, (_, steps) in EXPRESSIONS.items()} | {
    "dsl_event_decay": f"""with {PANEL} select symbol, timestamp, round(coalesce(exp(-ln(2) * abs(date_diff('day', timestamp, (
  select min(event_date) from ipo_event_dates_curated e where e.stock_code = symbol and e.event_type = 'cornerstone_lockup_expiry' and e.event_date >= timestamp))) / 10), 0), 6) as value from panel""",
    "dsl_single_series": f"""with {PANEL}, m as (select timestamp, avg(close) as close from panel group by timestamp)
select timestamp, round((close - avg(close) over w) / nullif(stddev_samp(close) over w, 0), 6) + 0.0 as value from m window w as (order by timestamp rows unbounded preceding)""",
}
from tessera.plans.common import FACTORS_SQL  # noqa: E402

SQL["dsl_batch"] = f"with {FACTORS_SQL} " + " union all ".join(f"select '{k}' as factor, count({k}) as n, round(avg({k}), 6) as mean from fac" for k in FACTORS)

_VALUES = ", ".join("('{}', '{}', {})".format(c, f.replace("'", "''"), n) for c, f, n in _class_features())
_CLASS = ", ".join(f"('{e}', '{c}')" for e, c in sorted(_classes().items()))
SQL["novelty"] = f"""with f(c, f, n) as (values {_VALUES}), e(expression, class) as (values {_CLASS}), t as (select c, sum(n) s from f group by c),
p as (select a.c, b.c d, coalesce((select sum(least(x.n, y.n)) from f x join f y on x.f = y.f where x.c = a.c and y.c = b.c), 0) m, a.s + b.s u from t a, t b where a.c <> b.c),
l as (select c, count(*) filter (m / (u - m) >= 0.7 - 1e-9) links from p group by c) select expression, class, links from e join l on l.c = e.class"""
