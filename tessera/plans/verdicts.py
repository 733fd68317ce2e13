"""Queries that judge candidates and take studies further: gates, novelty, selection, fold plans, attribution, costs, event statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import expression
from tessera.functions.expression import with_factors
from tessera.functions.safe import mean_rank
from tessera.operators import evaluate, events, folds, panel, registry, selection
from tessera.operators.rolling import last_loaded
from tessera.plans import evaluation as ev
from tessera.plans import pipelines
from tessera.plans.common import FACTORS, SIGNALS, bars, ic_sql, long_short_sql, rank_ic_sql, rank_sql, rounded, signals
from tessera.tables import table

IN, OUT = folds.holdout_span(ev.START, ev.END, 0.2)
SPANS = [*folds.windows(*IN, ev.RULE), (-1, *OUT)]
#: A regime whose levels some of the listed factors reach, so that later gates are reached too.
LOOSE = selection.replace(selection.LENIENT, ic=-0.02, rank_ic=-0.02, quantile_spread=-0.01, min_periods=40)


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """What the gates read, for every listed factor: means over folds, agreement over horizons, the held-out rank-IC."""
    long = ev._long(spark, folder)
    per = folds.walk_forward(long, SPANS, keys=["factor"])
    inside = folds.summarise(per.where("fold >= 0"), ["factor"]).select("factor", "n_periods", "n_assets", "ic", "rank_ic", "quantile_spread", "folds", "positive_share", "tail_concentration")
    held = per.where("fold = -1").select("factor", F.col("rank_ic").alias("holdout_rank_ic"))
    wide = evaluate.with_forward(with_factors(bars(spark, folder), FACTORS), horizons={c: (1, h) for h, c in ev.HORIZONS.items()})
    entries = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("signal")) for k in FACTORS])
    over = wide.select("symbol", "timestamp", *ev.HORIZONS.values(), F.explode(entries).alias("e")).select("symbol", "timestamp", *ev.HORIZONS.values(), "e.*")
    agree = evaluate.ic_by_horizon(over, ev.HORIZONS, ["factor"]).groupBy("factor").agg(F.count(F.lit(1)).alias("horizons"), F.max("same_sign").alias("same_sign"))
    return inside.join(held, "factor", "left").join(agree, "factor", "left")


def _judged(rules: selection.Regime, trials: int):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(selection.judged(_metrics(spark, folder), rules, trials))

    run.__doc__ = f"The listed factors by the gates in order, {trials} tried."
    return run


def complement(spark: SparkSession, folder: str) -> DataFrame:
    """Rank-IC of a base signal, of the base with another, the gain, and the mean correlation of their ranks."""
    gain = ev.complement(spark, folder)
    corr = evaluate.pairwise_rank_correlation(ev._factors(spark, folder), ["f1", "f2"]).where("left = 'f1' and right = 'f2'").select("rank_corr")
    return rounded(gain.join(corr, F.lit(True), "left"))  # one row each


def _selected(mode: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        """The two components of a basket."""
        if mode == "persistence":
            return selection.components(selection.persistence(ev._per_fold(spark, folder), ["factor"]), mode, 2, "factor").select("factor")
        return selection.components(evaluate.mean_rank_ic(ev._long(spark, folder), ["factor"]), mode, 2, "factor").select("factor")

    return run


def sign_test(spark: SparkSession, folder: str) -> DataFrame:
    """Exact two-sided p of the signs of rank-ICs over folds; zeros are ties."""
    return rounded(ev.sign_counts(spark, folder).withColumn("p", selection.sign_p(F.col("positive"), F.col("negative"))))


def selector_corr(spark: SparkSession, folder: str) -> DataFrame:
    """Spearman correlation (mean ranks of ties) over factors between their rank-IC, to two places, in the first and in the last fold."""
    wide = ev._per_fold(spark, folder).groupBy("factor").agg(*[F.round(F.max(F.when(F.col("fold") == k, F.col("rank_ic"))), 2).alias(n) for k, n in ((0, "a"), (3, "b"))])
    ranked = wide.where("a is not null and b is not null").select(F.lit(1).alias("one"), "a", "b")
    ranked = ranked.select(mean_rank(F.col("a"), "one").alias("a"), mean_rank(F.col("b"), "one").alias("b"))  # one row per factor
    return rounded(events.safe_correlation(ranked, "a", "b"))


def brief(spark: SparkSession, folder: str) -> DataFrame:
    """What is weak about each factor, as a list."""
    m = _metrics(spark, folder)
    weak = selection.weaknesses({
        "weak_cross_sectional": F.abs("rank_ic") < 0.02, "sign_inconsistent": F.col("positive_share").between(0.3, 0.7), "horizons_disagree": F.col("same_sign") < 2,
        "concentrated": F.col("tail_concentration") > 0.5, "holdout_flips": (F.col("holdout_rank_ic") > 0) != (F.col("rank_ic") > 0),
    })
    return m.select("factor", F.concat_ws(",", weak).alias("weak"))


PLANS = {
    "derived embargo": folds.Folds(count=4, size=90, step=45, embargo=None, least=20, lag=1, horizon=5), "all purged": folds.Folds(count=4, size=30, step=20, embargo=15, least=20),
    "does not fit": folds.Folds(count=4, size=400, step=45), "more than fit": folds.Folds(count=9, size=90, step=45, embargo=2, least=20),
}


def fold_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Folds attempted, kept and purged, the embargo, and why a walk-forward is skipped, for several rules."""
    rows = [(n, p.attempted, len(p.folds), p.purged, p.embargo, p.skipped) for n, r in PLANS.items() for p in [folds.plan(ev.START, ev.END, r)]]
    return spark.createDataFrame(rows, "rule string, attempted int, kept int, purged int, embargo int, skipped string")


def walk_forward_short(spark: SparkSession, folder: str) -> DataFrame:
    """A walk-forward whose folds do not fit falls back to the whole span."""
    out = folds.planned(signals(spark, folder), ev.START, ev.END, PLANS["does not fit"])
    return rounded(out.select("fold", "skipped", "n_periods", "n_assets", "ic", "rank_ic"))


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    s = signals(spark, folder)
    m = table(spark, folder, "ipo_master").where("stock_code is not null")
    listed = m.groupBy(F.col("stock_code").alias("symbol")).agg(F.max_by("listing_date", F.struct("registered_at_utc", F.coalesce("listing_date", F.lit("1900-01-01").cast("date")))).alias("listing_date"))
    kinds = list(pipelines.FAMILIES.values())
    days = s.select(F.col("symbol").alias("stock_code"), F.col("timestamp").alias("date"))
    near = panel.nearest_events(days, table(spark, folder, "ipo_event_dates_curated"), ["stock_code"], "date", "event_date", kinds, "event_type")
    gaps = [F.abs(F.datediff(F.col("date"), F.col(f"{p}_{k}"))) for k in kinds for p in ("next", "prev")]
    near = near.select(F.col("stock_code").alias("symbol"), F.col("date").alias("timestamp"), F.least(*gaps).alias("gap"))
    age = F.datediff("timestamp", "listing_date")
    return s.join(listed, "symbol", "left").join(near, ["symbol", "timestamp"], "left").withColumns({
        "listing_age": F.when(age.isNull(), "unknown").when(age <= 30, "0_30").when(age <= 90, "31_90").otherwise("91_plus"),
        "event_proximity": F.when(F.col("gap").isNull(), "no_event").when(F.col("gap") <= 5, "0_5").when(F.col("gap") <= 30, "6_30").otherwise("31_plus"),
    })


def attribution_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The stream's metrics within each listing age and each distance to the nearest event."""
    return rounded(evaluate.grouped_streams(_grouped(spark, folder), ["listing_age", "event_proximity"]).select("grouping", "label", "n", "mean_return", "hit_rate", "max_drawdown", "tail_concentration"))


def tail_after_debut(spark: SparkSession, folder: str) -> DataFrame:
    """How concentrated the stream is without each symbol's first 20 days."""
    nth = F.dense_rank().over(Window.partitionBy("symbol").orderBy("timestamp"))
    later = signals(spark, folder).withColumn("nth", nth).where("nth > 20")
    return rounded(evaluate.portfolio_metrics(evaluate.long_short(later)).select("n", "mean_return", "tail_concentration"))


def _micro(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "micro_features_daily").where("stock_code is not null and trading_date is not null")
    return last_loaded(m, ["stock_code", "trading_date"], ["ofi", "rel_spread"], ["loaded_at_utc", "row_id"]).withColumnsRenamed({"stock_code": "symbol", "trading_date": "timestamp"})


def half_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Half the mean relative spread, in basis points."""
    return rounded(_micro(spark, folder).agg((F.avg("rel_spread") * 1e4 / 2).alias("half_spread_bps")))


def long_only_net(spark: SparkSession, folder: str) -> DataFrame:
    """The long-only stream after the measured cost of what it turns over."""
    cost = _micro(spark, folder).agg((F.avg("rel_spread") / 2).alias("half"))  # one row
    stream = evaluate.long_only(signals(spark, folder), ev._market(spark, folder))
    return rounded(evaluate.long_only_net(stream, F.lit(0.0)).join(cost, F.lit(True), "left").withColumn("net", F.col("mean") - F.col("turnover") * 2 * F.col("half")).drop("half"))


def _study(spark: SparkSession, folder: str) -> DataFrame:
    """The event window with order-flow imbalance and the overhang: the share of the offer that the next expiry sets free."""
    kind = "cornerstone_lockup_expiry"
    dates = table(spark, folder, "ipo_event_dates_curated")
    days = bars(spark, folder).select(F.col("symbol").alias("stock_code"), F.col("timestamp").alias("date"))
    near = panel.nearest_events(days, dates, ["stock_code"], "date", "event_date", [kind], "event_type").select(F.col("stock_code").alias("symbol"), F.col("date").alias("timestamp"), F.col(f"next_{kind}").alias("next_date"))
    free = dates.where((F.col("event_type") == kind) & F.col("event_date").isNotNull()).groupBy(F.col("stock_code").alias("symbol"), F.col("event_date").alias("next_date")).agg(F.max("total_pct_of_offer").alias("overhang"))
    w = pipelines._study(spark, folder).join(_micro(spark, folder).select("symbol", "timestamp", "ofi"), ["symbol", "timestamp"], "left")
    return w.join(near, ["symbol", "timestamp"], "left").join(free, ["symbol", "next_date"], "left")


def tau_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Mean abnormal return, its running sum and mean imbalance per day around the event."""
    return rounded(events.profile_by_tau(_study(spark, folder), others=["ofi"]))


def event_cars(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulated abnormal return of each event, with its overhang."""
    return rounded(events.cumulated(_study(spark, folder), first=["overhang"]))


def event_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The study's statistics: mean, t and median of the CAR, its signs, its correlation with the overhang, imbalance before the event."""
    w = _study(spark, folder)
    c = events.cumulated(w, first=["overhang"])
    pre = events.t_statistic(w.where("tau between -5 and -1"), "ofi").toDF("pre_ofi", "pre_ofi_t", "pre_ofi_n")
    both = F.col("car").isNotNull() & F.col("overhang").isNotNull()
    x, y = F.when(both, F.col("car")), F.when(both, F.col("overhang"))
    one = events.t_statistic(c, "car").join(c.agg(
        F.median("car").alias("median"), F.count_if(F.col("car") > 0).alias("positive"), F.count_if(F.col("car") < 0).alias("negative"),
        F.when(F.count(x) >= 3, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))).alias("overhang_corr"), F.count(x).alias("overhang_n"),
    )).join(pre)  # one row each
    return rounded(one.withColumn("sign_p", selection.sign_p(F.col("positive"), F.col("negative"))))


def placebo_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The same CAR 40 days before and after the events, where the whole stretch is traded: mean, t, number and median."""
    out = None
    for shift in (-40, 40):
        c = events.cumulated(pipelines._study(spark, folder, shift, True, 1, 3))
        one = events.t_statistic(c, "car").join(c.agg(F.median("car").alias("median"))).withColumn("shift", F.lit(shift))  # one row each
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# Expressions as records ------------------------------------------------------------------------------------------------

#: Expressions with tags and ages in days, as a registry would hold them.
RECORDS = [
    (f"e{i:02d}", text, sorted({"volume", "close", "high"} & set(text.replace("(", " ").replace(",", " ").split()) | {"ratio"} if "/" in text else {"plain"}), 3 * i)
    for i, text in enumerate(sorted({v for t in FACTORS.values() for v, _ in expression.variations(t)} | set(FACTORS.values())))
]


def _features_of(text: str) -> dict[str, int]:
    return {repr(f): n for f, n in expression.features(expression.canonical(expression.parse(text))).items()}


def related_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten records most related to a listed factor: likeness of expressions, shared tags and recency (a top-k list)."""
    rows = spark.createDataFrame([(i, t, g, d, _features_of(t)) for i, t, g, d in RECORDS], "id string, expression string, tags array<string>, age int, features map<string,int>").where(F.col("expression") != FACTORS["f1"])
    want = F.create_map(*[x for f, n in sorted(_features_of(FACTORS["f1"]).items()) for x in (F.lit(f), F.lit(n))])
    like = selection.likeness(F.col("features"), want)
    tie = [like.desc(), F.col("age"), F.size("tags").desc(), F.col("id")]
    return registry.related(rows, like, F.col("tags"), ["ratio", "volume"], F.col("age"), 30, 10, tie, least=0.1).select("id", "score")


def novelty_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Variations of the listed factors, and one of them written otherwise, against the factors as a corpus."""
    def rows(texts):
        forms = {expression.canonical_id(expression.parse(t)): t for t in texts}
        return spark.createDataFrame([(c, f, n) for c, t in forms.items() for f, n in _features_of(t).items()], "candidate string, feature string, n int")

    out = selection.novelty(rows(_CANDIDATES), rows(FACTORS.values()), 0.85)
    names = spark.createDataFrame([(expression.canonical_id(expression.parse(t)), t) for t in _CANDIDATES], "candidate string, expression string")
    return rounded(names.join(out, "candidate").select("expression", "likeness", "known"))


#: Two written otherwise than the factor they equal, one near to one, one less near, and one far from all.
_CANDIDATES = ["(ts_mean(volume, 5)) / ts_mean(volume, 20)", "(-low + high) / close", "ts_mean(volume, 6) / ts_mean(volume, 20)", "ts_mean(volume, 5) / ts_mean(close, 20)", "rank(open)"]


def refinement_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """How many records lie at each depth of the chains of records."""
    from tessera.plans.records import lineage

    return lineage(spark, folder).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def run_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run: records, records by status, kinds, mean confidence, first and last time."""
    t = table(spark, folder, "ipo_event_terms_curated")
    return rounded(t.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "candidate").alias("n_candidate"), F.count_distinct("event_type").alias("kinds"),
        F.avg(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("mean_confidence"), F.min("curated_at_utc").alias("first_at"), F.max("curated_at_utc").alias("last_at"),
    ))


def type_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of event: rows, stocks, and the share of registered stocks that have one."""
    e = table(spark, folder, "ipo_event_dates_curated")
    all_ = table(spark, folder, "ipo_master").agg(F.count_distinct("stock_code").alias("all_"))  # one row
    known = e.join(table(spark, folder, "ipo_master").select("stock_code").distinct().withColumn("held", F.lit(True)), "stock_code", "left")
    by = known.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("stock_code").alias("stocks"), F.count_distinct(F.when(F.col("held"), F.col("stock_code"))).alias("held"))
    return rounded(by.join(all_, F.lit(True), "left").select("event_type", "rows", "stocks", (F.col("held") / F.col("all_")).alias("share")))


def missing_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of event: terms without a document, an address, a page or a text."""
    t = table(spark, folder, "ipo_event_terms_curated")
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("terms"), *[empty(c).alias(f"no_{n}") for c, n in (("source_doc_id", "document"), ("source_url", "address"), ("source_page", "page"), ("source_text", "text"))])


def manifest_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per load of the manifest: rows, rows whose counts do not add up, repeated stocks, and rows that end before they begin."""
    m = table(spark, folder, "tick_manifest_target")
    parts = F.col("trade_rows") + F.col("bid_rows") + F.col("ask_rows") + F.col("other_rows")
    return m.groupBy("load_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(parts != F.col("total_rows")).alias("off"), (F.count(F.lit(1)) - F.count_distinct("stock_code") - F.max(F.col("stock_code").isNull().cast("int"))).alias("repeated"),
        F.count_if(F.col("last_event_utc") < F.col("first_event_utc")).alias("reversed"),
    )


QUERIES = {
    f.__name__: f for f in (
        complement, sign_test, selector_corr, brief, fold_plan, walk_forward_short, attribution_groups, tail_after_debut, half_spread, long_only_net, tau_profile, event_cars, event_tests, placebo_stats,
        related_expressions, novelty_verdict, refinement_rounds, run_reports, type_coverage, missing_evidence, manifest_quality,
    )
} | {"judge": _judged(selection.LENIENT, 4), "judge_loose": _judged(LOOSE, 1), "select_rank_ic": _selected("rank_ic"), "select_persistence": _selected("persistence"), "select_input_order": _selected("input_order")}

_R = ev._R
_SPANS_SQL = " union all ".join(f"select {i} as fold, date '{a}' as a, date '{b}' as b" for i, a, b in SPANS)
_TAIL = "case when sum(ret) > 0 and count(*) >= 3 then sum(ret) filter (place <= 3) / sum(ret) end"
_METRICS = f"""with {ev._LONGSQL}, folds as ({_SPANS_SQL}), fl as (
  select symbol, timestamp, factor, signal, fold, lead(close, 2) over w / nullif(lead(close, 1) over w, 0) - 1 as fwd from flong join folds on timestamp between a and b
  window w as (partition by factor, fold, symbol order by timestamp)),
base as (select factor, fold, count(distinct timestamp) p, count(distinct symbol) s from fl group by 1, 2),
r as (select factor, fold, avg(ic) as rank_ic from {rank_ic_sql('fl', 'factor, fold, timestamp')} group by 1, 2),
i as (select factor, fold, avg(ic) as ic from {ic_sql('fl', 'factor, fold, timestamp')} group by 1, 2),
st as (select * from {long_short_sql('fl', 'factor, fold, timestamp')}), q as (select factor, fold, avg(ret) as spread from st group by 1, 2),
t as (select factor, fold, {_TAIL} as tail from (select *, row_number() over (partition by factor, fold order by ret desc, timestamp) place from st) group by 1, 2),
inside as (select factor, sum(p)::bigint as n_periods, max(s) as n_assets, avg(ic) as ic, avg(rank_ic) as rank_ic, avg(spread) as quantile_spread, count(*) as folds,
  avg(case when rank_ic is not null then (rank_ic > 0)::int end) as positive_share, max(tail) as tail_concentration
  from base left join r using (factor, fold) left join i using (factor, fold) left join q using (factor, fold) left join t using (factor, fold) where fold >= 0 group by 1),
held as (select factor, rank_ic as holdout_rank_ic from r where fold = -1),
hz as (select timestamp, factor, horizon, signal, fwd from (select *, lead(close, 2) over w / nullif(lead(close, 1) over w, 0) - 1 as h1, lead(close, 6) over w / nullif(lead(close, 1) over w, 0) - 1 as h5,
  lead(close, 11) over w / nullif(lead(close, 1) over w, 0) - 1 as h10 from fac window w as (partition by symbol order by timestamp)),
  lateral (select unnest(['f1', 'f2', 'f3', 'f4']) as factor, unnest([f1, f2, f3, f4]) as signal), lateral (select unnest([1, 5, 10]) as horizon, unnest([h1, h5, h10]) as fwd)),
hr as (select factor, horizon, avg(ic) as x from {rank_ic_sql('hz', 'factor, horizon, timestamp')} group by 1, 2),
agree as (select factor, count(*) as horizons, count(*) filter ((x > 0) = (first > 0)) as same_sign from hr join (select factor, x as first from hr where horizon = 1) using (factor) group by 1),
m as (select * from inside left join held using (factor) left join agree using (factor))"""


def _judge_sql(rules: selection.Regime, trials: int) -> str:
    z = selection.bonferroni_multiplier(trials, rules.alpha)
    ic, rank, spread = rules.ic * z, rules.rank_ic * z, rules.quantile_spread
    margins = " or ".join(f"({x!r} > 0 and ({c} - {x!r}) / {abs(x)!r} < {rules.margin})" for c, x in (("ic", ic), ("rank_ic", rank), ("quantile_spread", spread)))
    return f"""{_METRICS}, g as (select *, case when n_periods < {rules.min_periods} or n_assets < {rules.min_assets} then 'insufficient data'
  when ic is null or rank_ic is null or quantile_spread is null or ic < {ic!r} or rank_ic < {rank!r} or quantile_spread < {spread!r} then 'weak' when horizons >= 2 and same_sign < 2 then 'signs differ'
  when folds >= 2 and positive_share < 0.6 then 'unstable' when tail_concentration > 0.5 then 'concentrated'
  when rank_ic <> 0 and ((rank_ic > 0) <> (holdout_rank_ic > 0) or holdout_rank_ic / rank_ic < 0.5) then 'decayed' when {margins} then 'margin' else 'none' end as gate from m)
select factor, n_periods, n_assets, {_R('ic')} as ic, {_R('rank_ic')} as rank_ic, {_R('quantile_spread')} as quantile_spread, folds, {_R('positive_share')} as positive_share, {_R('tail_concentration')} as tail_concentration,
  {_R('holdout_rank_ic')} as holdout_rank_ic, horizons, same_sign, gate, case gate when 'none' then 'promote' when 'margin' then 'refine' else 'reject' end as decision from g"""


def _plan_sql() -> str:
    parts = []
    for name, r in PLANS.items():
        gap = r.lag + r.horizon if r.embargo is None else r.embargo
        tried = f"(select count(*) from range({r.count}) t(i) where date '{ev.START}' + (i * {r.step} + {r.size} - 1)::int <= date '{ev.END}')"
        parts.append(f"select '{name}' as rule, {tried} as attempted, case when {r.size} - {gap} >= {r.least} then {tried} else 0 end as kept, {gap} as embargo")
    return f"select rule, attempted, kept, attempted - kept as purged, embargo, case when kept < 2 then 'span too short' end as skipped from ({' union all '.join(parts)})"


_SIGN_P = "case when positive + negative = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(positive, negative) + 1), lambda i: exp(lgamma(positive + negative + 1) - lgamma(i + 1) - lgamma(positive + negative - i + 1) - (positive + negative) * ln(2))))) end"
_MICRO = "micro as (select stock_code as symbol, trading_date as timestamp, ofi, rel_spread from micro_features_daily where stock_code is not null and trading_date is not null qualify row_number() over (partition by stock_code, trading_date order by loaded_at_utc desc, row_id desc) = 1)"
_KINDS = ", ".join(f"'{k}'" for k in pipelines.FAMILIES.values())
_GROUPED = f"""with {SIGNALS}, listed as (select stock_code as symbol, arg_max(listing_date, (registered_at_utc, coalesce(listing_date, date '1900-01-01'))) as listing_date from ipo_master where stock_code is not null group by 1),
g0 as (select l.*, date_diff('day', listing_date, timestamp) as age, (select min(abs(date_diff('day', l.timestamp, event_date))) from ipo_event_dates_curated e where e.stock_code = l.symbol and e.event_type in ({_KINDS})) as gap
  from lab l left join listed using (symbol)),
g1 as (select symbol, timestamp, signal, fwd, case when age is null then 'unknown' when age <= 30 then '0_30' when age <= 90 then '31_90' else '91_plus' end as a,
  case when gap is null then 'no_event' when gap <= 5 then '0_5' when gap <= 30 then '6_30' else '31_plus' end as b from g0),
g2 as (select symbol, timestamp, signal, fwd, 'listing_age' as grouping, a as label from g1 union all select symbol, timestamp, signal, fwd, 'event_proximity', b from g1), st as (select * from {long_short_sql('g2', 'grouping, label, timestamp')})"""
_EVENTS = pipelines._STUDY + f""", {_MICRO}, wx as (select w.*, ofi, (select max(total_pct_of_offer) from ipo_event_dates_curated e where e.stock_code = w.symbol and e.event_type = 'cornerstone_lockup_expiry' and e.event_date = (
    select min(event_date) from ipo_event_dates_curated n where n.stock_code = w.symbol and n.event_type = 'cornerstone_lockup_expiry' and n.event_date >= w.timestamp)) as overhang
  from w left join micro using (symbol, timestamp)),
cx as (select symbol, event_id, sum(ar) as car, count(ar) as n, arg_min(overhang, tau) filter (overhang is not null) as overhang from wx where tau between -1 and 3 group by 1, 2)"""
_T = "ipo_event_terms_curated"


def _placebo(shift: int) -> str:
    return f"""select {shift} as shift, {_R('avg(car)')} as mean, {_R('avg(car) / nullif(stddev_samp(car) / sqrt(count(car)), 0)')} as t, count(car) as n, {_R('median(car)')} as median from (
  select e0.symbol, event_id, sum(ar) as car from e0 join ar on ar.symbol = e0.symbol and rn between rn0 + {shift - 1} and rn0 + {shift + 3} group by 1, 2 having count(*) = 5)"""


def _likeness_sql() -> str:
    """Overlaps from literal lists of features, one entry for each occurrence."""
    spread = lambda t: "[" + ", ".join("'{}#{}'".format(f.replace("'", "''"), k) for f, n in sorted(_features_of(t).items()) for k in range(n)) + "]"
    rows = ", ".join("('{}', {}, {}, {}::varchar[])".format(i, d, spread(t), g) for i, t, g, d in RECORDS if t != FACTORS["f1"])
    return f"""with r(id, age, f, tags) as (values {rows}), s as (select *, len(list_intersect(f, {spread(FACTORS['f1'])})) * 1.0 / len(list_distinct(list_concat(f, {spread(FACTORS['f1'])}))) as likeness from r),
k as (select *, round(0.6::double * likeness + 0.3::double * len(list_intersect(tags, ['ratio', 'volume'])) / len(list_distinct(list_concat(tags, ['ratio', 'volume']))) + 0.1::double * pow(0.5::double, age / 30.0::double), 6) as score from s)
select id, score from k where score >= 0.1 order by score desc, likeness desc, age, len(tags) desc, id limit 10"""


SQL = {
    "judge": _judge_sql(selection.LENIENT, 4), "judge_loose": _judge_sql(LOOSE, 1),
    "complement": ev.SQL["complement"].replace("select round(b.x", "select (select round(avg(c), 6) + 0.0 from (select timestamp, case when stddev_samp(p) > 0 and stddev_samp(o) > 0 then covar_samp(p, o) / nullif(stddev_samp(case when o is not null then p end) * stddev_samp(case when p is not null then o end), 0) end c from (select timestamp, case when f1 is not null then "
    + rank_sql("f1") + " end p, case when f2 is not null then " + rank_sql("f2") + " end o from fac) group by timestamp)) as rank_corr, round(b.x"),
    "select_rank_ic": f"with {ev._LONGSQL} select factor from (select factor, avg(ic) as x from {rank_ic_sql('flong', 'factor, timestamp')} group by 1) order by x desc nulls last, factor limit 2",
    "select_persistence": f"""{ev._PERFOLD}, s as (select factor, avg((rank_ic > 0)::int) as share, avg(rank_ic) / nullif(stddev_pop(rank_ic) / sqrt(count(rank_ic)), 0) as score, avg(rank_ic) as mean from per group by 1)
select factor from s order by share desc, score desc, mean desc, factor limit 2""",
    "select_input_order": "select unnest(['f1', 'f2']) as factor",
    "sign_test": f"{ev._PERFOLD}, c as (select factor, count(*) filter (rank_ic > 0) as positive, count(*) filter (rank_ic < 0) as negative, count(*) filter (rank_ic = 0) as zero from per group by 1) select *, {_R(_SIGN_P)} as p from c",
    "selector_corr": f"""{ev._PERFOLD}, w as (select factor, round(max(rank_ic) filter (fold = 0), 2) a, round(max(rank_ic) filter (fold = 3), 2) b from per group by 1), v as (select * from w where a is not null and b is not null),
k as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 a, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 b from v)
select {_R('covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0)')} as corr, count(*) as n from k""",
    "brief": f"""{_METRICS} select factor, concat_ws(',', case when abs(rank_ic) < 0.02 then 'weak_cross_sectional' end, case when positive_share between 0.3 and 0.7 then 'sign_inconsistent' end, case when same_sign < 2 then 'horizons_disagree' end,
  case when tail_concentration > 0.5 then 'concentrated' end, case when (holdout_rank_ic > 0) <> (rank_ic > 0) then 'holdout_flips' end) as weak from m""",
    "fold_plan": _plan_sql(),
    "walk_forward_short": f"""with {SIGNALS}, {ev._fold_labels(f"select -1 as fold, date '{ev.START}' as a, date '{ev.END}' as b")}
select -1 as fold, 'span too short' as skipped, count(distinct timestamp) as n_periods, count(distinct symbol) as n_assets, (select {_R('avg(ic)')} from {ic_sql('flab')}) as ic, (select {_R('avg(ic)')} from {rank_ic_sql('flab')}) as rank_ic from flab""",
    "attribution_groups": f"""{_GROUPED}, pf as ({ev._PORTFOLIO.format(', grouping, label', 'grouping, label', '', 'st', 'group by grouping, label')})
select grouping, label, n, mean_return, hit_rate, max_drawdown, tail_concentration from pf""",
    "tail_after_debut": f"""with {SIGNALS}, later as (select * from (select *, dense_rank() over (partition by symbol order by timestamp) as nth from lab) where nth > 20), st as (select * from {long_short_sql('later')}),
pf as ({ev._PORTFOLIO.format('', '1', '', 'st', '')}) select n, mean_return, tail_concentration from pf""",
    "half_spread": f"with {_MICRO} select {_R('avg(rel_spread) * 1e4 / 2')} as half_spread_bps from micro",
    "long_only_net": ev.SQL["long_only"].replace(f"select t.timestamp, {_R('avg(fwd) - any_value(mk)')} as ret, {_R('avg(case when p is null then null when exists (select 1 from top u where u.symbol = t.symbol and u.timestamp = p) then 0 else 1 end)')} as turnover", ", lo as (select t.timestamp, avg(fwd) - any_value(mk) as ret, avg(case when p is null then null when exists (select 1 from top u where u.symbol = t.symbol and u.timestamp = p) then 0 else 1 end) as turnover")
    + f"), {_MICRO} select count(ret) as days, {_R('avg(ret)')} as mean, {_R('avg((ret > 0)::int)')} as hit_rate, {_R('avg(coalesce(turnover, 0))')} as turnover, {_R('avg(ret) - avg(coalesce(turnover, 0)) * (select avg(rel_spread) from micro)')} as net from lo",
    "tau_profile": _EVENTS + f", p as (select tau, avg(ar) as m, count(ar) as n, avg(ofi) as o from wx group by 1) select tau, {_R('m')} as mean_ar, n, {_R('o')} as mean_ofi, {_R('sum(m) over (order by tau)')} as car from p",
    "event_cars": _EVENTS + f" select symbol, event_id, {_R('car')} as car, n, {_R('overhang')} as overhang from cx",
    "event_tests": _EVENTS + f""", c as (select avg(car) as mean, avg(car) / nullif(stddev_samp(car) / sqrt(count(car)), 0) as t, count(car) as n, median(car) as median, count(*) filter (car > 0) as positive, count(*) filter (car < 0) as negative,
  case when count(car) filter (overhang is not null) >= 3 then covar_samp(car, overhang) / nullif(stddev_samp(car) filter (overhang is not null) * stddev_samp(overhang) filter (car is not null), 0) end as oc, count(car) filter (overhang is not null) as overhang_n from cx),
o as (select avg(ofi) as m, avg(ofi) / nullif(stddev_samp(ofi) / sqrt(count(ofi)), 0) as t, count(ofi) as n from wx where tau between -5 and -1)
select {_R('c.mean')} as mean, {_R('c.t')} as t, c.n, {_R('median')} as median, positive, negative, {_R('oc')} as overhang_corr, overhang_n, {_R('o.m')} as pre_ofi, {_R('o.t')} as pre_ofi_t, o.n as pre_ofi_n, {_R(_SIGN_P)} as sign_p from c, o""",
    "placebo_stats": pipelines._STUDY + " " + _placebo(-40) + " union all " + _placebo(40),
    "related_expressions": _likeness_sql(),
    # Counted by hand: windows of 5 and 6 are of one size class; of 7 and 7 features 6 are shared by the fourth, 6 / 8; the last shares none.
    "novelty_verdict": "select unnest([{}]) as expression, unnest([1.0::double, 1.0, 1.0, null, null]) as likeness, unnest([true, true, true, false, false]) as known".format(", ".join(f"'{t}'" for t in _CANDIDATES)),
    "refinement_rounds": f"select depth, count(*) as n from (select row_number() over (partition by stock_code, event_type, party_name order by curated_at_utc, term_id) - 1 as depth from {_T}) group by 1",
    "run_reports": f"""select run_id, count(*) as n, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'candidate') as n_candidate, count(distinct event_type) as kinds, {_R('avg(case when not isnan(confidence) then confidence end)')} as mean_confidence,
  min(curated_at_utc) as first_at, max(curated_at_utc) as last_at from {_T} group by 1""",
    "type_coverage": f"""select event_type, count(*) as "rows", count(distinct stock_code) as stocks, {_R('count(distinct stock_code) filter (stock_code in (select stock_code from ipo_master where stock_code is not null)) / (select count(distinct stock_code) from ipo_master)')} as share from ipo_event_dates_curated group by 1""",
    "missing_evidence": f"""select event_type, count(*) as terms, count(*) filter (coalesce(trim(source_doc_id), '') = '') as no_document, count(*) filter (coalesce(trim(source_url), '') = '') as no_address, count(*) filter (source_page is null) as no_page,
  count(*) filter (coalesce(trim(source_text), '') = '') as no_text from {_T} group by 1""",
    "manifest_quality": """select load_id, count(*) as "rows", count(*) filter (trade_rows + bid_rows + ask_rows + other_rows <> total_rows) as off, count(*) - count(distinct stock_code) - max((stock_code is null)::int) as repeated,
  count(*) filter (last_event_utc < first_event_utc) as reversed from tick_manifest_target group by 1""",
}
