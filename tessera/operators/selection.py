"""Choosing among candidates: rules in order, multiple testing, persistence, rankings, exact tests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(df: DataFrame, rules: Sequence[tuple[str, str, Column]], otherwise: str) -> DataFrame:
    """The rows with `decision` and `gate`: those of the first rule (gate, decision, condition) that holds; a NULL condition does not."""
    gate = F.coalesce(*[F.when(c, F.lit(g)) for g, _, c in rules], F.lit("none"))
    said = {g: d for g, d, _ in rules} | {"none": otherwise}
    mapping = F.create_map(*[x for g, d in said.items() for x in (F.lit(g), F.lit(d))])
    return df.withColumn("gate", gate).withColumn("decision", F.element_at(mapping, F.col("gate")))


def bonferroni_multiplier(trials: int, alpha: float = 0.05) -> float:
    """How much higher a one-sided normal threshold is when the level is shared by so many trials."""
    z = NormalDist().inv_cdf
    return 1.0 if trials <= 1 else z(1 - alpha / trials) / z(1 - alpha)


@dataclass(frozen=True)
class Regime:
    """What a candidate must reach; the levels of ic and rank_ic rise with the number of trials (see bonferroni_multiplier).

    required: metrics that must be there. margin: share by which a candidate must clear every level that is above 0, else it is refined.
    """

    ic: float = 0.02
    rank_ic: float = 0.03
    quantile_spread: float = 0.005
    required: tuple[str, ...] = ("ic", "rank_ic", "quantile_spread")
    min_periods: int = 60
    min_assets: int = 10
    same_sign: int = 2
    positive_folds: float = 0.6
    correlation: float = 0.5
    lift_share: float = 0.6
    tail: float = 0.5
    holdout_ratio: float = 0.5
    novelty: float = 0.85
    margin: float = 0.2
    alpha: float = 0.05


STRICT = Regime()
LENIENT = replace(STRICT, ic=0.01, rank_ic=0.015, quantile_spread=0.0025, min_periods=40)

#: What the gates read. A metric that is NULL was not asked for, and its gate passes; with `complemented` the complement's must be there.
METRICS = {
    "n_periods": "bigint", "n_assets": "bigint", "ic": "double", "rank_ic": "double", "quantile_spread": "double", "horizons": "bigint", "same_sign": "bigint", "folds": "bigint", "positive_share": "double",
    "complemented": "boolean", "max_correlation": "double", "lift_share": "double", "holdout_lift": "double", "tail_concentration": "double", "holdout_rank_ic": "double", "likeness": "double", "trials": "int",
}


def gates(rules: Regime, multiplier: Column) -> list[tuple[str, str, Column]]:
    """The gates in order, each with its decision and the condition under which a candidate stops at it."""
    c = F.col
    level = {m: F.lit(getattr(rules, m)) * (multiplier if m in ("ic", "rank_ic") else F.lit(1.0)) for m in rules.required}
    either = lambda conditions: F.coalesce(conditions[0], F.lit(False)) if len(conditions) == 1 else F.coalesce(conditions[0], F.lit(False)) | either(conditions[1:])
    asked = F.coalesce(c("complemented"), F.lit(False))
    ratio = F.try_divide(c("holdout_rank_ic"), c("rank_ic"))
    return [
        ("insufficient data", "reject", either([c("n_periods") < rules.min_periods, c("n_assets") < rules.min_assets])),
        ("weak", "reject", either([c(m).isNull() | (c(m) < level[m]) for m in rules.required])),
        ("signs differ", "reject", (c("horizons") >= 2) & (c("same_sign") < rules.same_sign)),
        ("unstable", "reject", (c("folds") >= 2) & (c("positive_share") < rules.positive_folds)),
        ("no complement", "reject", asked & either([
            c("max_correlation").isNull() | (c("max_correlation") > rules.correlation), c("lift_share").isNull() | (c("lift_share") < rules.lift_share), c("holdout_lift").isNull() | (c("holdout_lift") <= 0),
        ])),
        ("concentrated", "reject", c("tail_concentration") > rules.tail),
        ("decayed", "reject", (c("rank_ic") != 0) & (((c("rank_ic") > 0) != (c("holdout_rank_ic") > 0)) | (ratio < rules.holdout_ratio))),
        ("known", "reject", c("likeness") >= rules.novelty),
        ("margin", "refine", either([(level[m] > 0) & ((c(m) - level[m]) / level[m] < rules.margin) for m in rules.required])),
    ]


def judged(metrics: DataFrame, rules: Regime = STRICT, trials: int | None = None) -> DataFrame:
    """Candidates with `gate` and `decision` (reject, refine, promote): the first gate that stops each.

    metrics: any of METRICS; those that are not there count as NULL. trials: how many candidates were tried, unless the column
    `trials` says so for each (it must have few values: a multiplier is made for every one on the driver).
    """
    df = metrics.withColumns({m: F.lit(None).cast(t) for m, t in METRICS.items() if m not in metrics.columns})
    if trials is None:
        values = [r[0] for r in df.select("trials").distinct().collect()]
        table = F.create_map(*[x for n in values if n is not None for x in (F.lit(n), F.lit(bonferroni_multiplier(n, rules.alpha)))] or [F.lit(0), F.lit(1.0)])
        multiplier = F.coalesce(F.try_element_at(table, F.col("trials")), F.lit(1.0))
    else:
        multiplier = F.lit(bonferroni_multiplier(trials, rules.alpha))
    return decide(df, gates(rules, multiplier), "promote").select(*metrics.columns, "gate", "decision")


def sign_p(positive: Column, negative: Column) -> Column:
    """Two-sided exact binomial p of counts of signs (up to about a thousand), in the JVM; 1 without a sign."""
    n = (positive + negative).cast("double")
    first = F.struct(F.pow(F.lit(2.0), -n).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), F.least(positive, negative).cast("int")), first, step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def components(df: DataFrame, mode: str, k: int | None = None, order: str = "position", tie: Sequence[str] = ()) -> DataFrame:
    """The candidates of a basket: in the order given, or the k best (at least 2) by `rank_ic` or by persistence (see persistence).

    df: a row per candidate, with `order` and what the mode needs (rank_ic, or positive_share, score and mean).
    """
    if mode not in ("input_order", "rank_ic", "persistence"):
        raise ValueError(f"unknown mode {mode!r}")
    if k is None and mode != "input_order" or k is not None and k < 2:
        raise ValueError("a number of candidates, at least 2, is needed")
    by = {"input_order": [F.col(order)], "rank_ic": [F.col("rank_ic").desc_nulls_last()], "persistence": [F.col(c).desc_nulls_last() for c in ("positive_share", "score", "mean")]}[mode]
    out = df.orderBy(*by, order, *tie)
    return out if k is None else out.limit(k)


def sign_test_p(positive: int, negative: int, zeros: int = 0, count_zeros: bool = False) -> float:
    """Two-sided exact binomial p of so many signs; zeros are ties, or count as trials without a sign."""
    n = positive + negative + (zeros if count_zeros else 0)
    if n == 0:
        return 1.0
    k = min(positive, n - positive)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def persistence(per_fold: DataFrame, keys: Sequence[str], value: str = "rank_ic") -> DataFrame:
    """Candidates by persistence: share of folds above 0, mean by its error (population deviation), mean; place 1 is best.

    Without a deviation the second key is infinite with the mean's sign. Candidates without a value come last.
    """
    x = F.col(value)
    error = F.stddev_pop(x) / F.sqrt(F.count(x).cast("double"))
    score = F.when(F.stddev_pop(x) > 0, F.avg(x) / error).when(F.avg(x) > 0, F.lit(float("inf"))).when(F.avg(x) < 0, F.lit(float("-inf"))).when(F.avg(x) == 0, F.lit(0.0))
    out = per_fold.groupBy(*keys).agg(F.count(x).alias("n_folds"), F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)).alias("positive_share"), score.alias("score"), F.avg(x).alias("mean"))
    order = [F.col(c).desc_nulls_last() for c in ("positive_share", "score", "mean")]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order, *keys)))  # one row per candidate


def best(df: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows of greatest value, NULLs last: a top-k, not a sort of everything."""
    return df.orderBy(F.col(by).desc_nulls_last(), *tie).limit(k)


def tally(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts, signs and mean of a value per combination of keys and over all, from one aggregation (NULL keys: over all)."""
    x = F.col(value)
    return df.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        F.count(x).alias("n"), F.count_if(x > 0).alias("positive"), F.avg(x).alias("mean"), F.grouping_id().alias("level")
    )


def resembling(features: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs of candidates that resemble each other: left < right and overlap, the weighted overlap of their features, at least `least`.

    features: candidate, feature, n (occurrences); one row per candidate and feature. Give one candidate for each group of equal ones.
    Two candidates can only reach the overlap if they share one of their rarest features (as many as the threshold
    leaves), and if their sizes are close; only such candidates meet, and the test that follows is exact. Common
    features pair nothing.
    """
    rarity = features.groupBy("feature").agg(F.count(F.lit(1)).alias("common"))
    items = features.join(rarity, "feature").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    w = Window.partitionBy("candidate")
    items = items.withColumns({"size": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy("common", "feature", "k"))})
    # Kept per candidate for the test: its features with their occurrences, bounded by the length of an expression.
    sets = features.groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.struct("feature", "n"))).alias("m"))
    rare = items.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("candidate", "size", "feature", "k")
    a, b = (rare.select(F.col("candidate").alias(n), F.col("size").alias(f"size_{n}"), "feature", "k") for n in ("left", "right"))
    near = a.join(b, ["feature", "k"]).where("left < right").where((F.least("size_left", "size_right") >= least * F.greatest("size_left", "size_right") - 1e-9))
    near = near.select("left", "right", "size_left", "size_right").distinct()
    near = near.join(sets.select(F.col("candidate").alias("left"), F.col("m").alias("ml")), "left").join(sets.select(F.col("candidate").alias("right"), F.col("m").alias("mr")), "right")
    shared = shared_features(F.col("ml"), F.col("mr"))
    overlap = F.col("shared") / (F.col("size_left") + F.col("size_right") - F.col("shared"))
    return near.withColumn("shared", shared).withColumn("overlap", overlap).where(F.col("overlap") >= least - 1e-9).select("left", "right", "overlap")


def shared_features(a: Column, b: Column) -> Column:
    """How many features, with their occurrences, two maps (feature to occurrences) share."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("long"))
    return F.aggregate(F.map_values(both), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """The weighted overlap of two maps of features, 1 for equal ones."""
    size = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.coalesce(F.try_divide(shared_features(a, b).cast("double"), size(a) + size(b) - shared_features(a, b)), F.lit(0.0))


def links(features: DataFrame, least: float = 0.85) -> DataFrame:
    """How many other candidates each one resembles (see resembling): candidate, links."""
    linked = resembling(features, least)
    ends = linked.select(F.explode(F.array("left", "right")).alias("candidate")).groupBy("candidate").agg(F.count(F.lit(1)).alias("links"))
    return features.select("candidate").distinct().join(ends, "candidate", "left").na.fill(0, ["links"])


def novelty(candidates: DataFrame, corpus: DataFrame, least: float = 0.85) -> DataFrame:
    """Whether each candidate is known: candidate, likeness (the greatest overlap with a member of the corpus that reaches `least`, else NULL), known.

    Both are tables of features (see resembling) whose candidates are named by their canonical form, so equal ones have equal
    names and a likeness of 1. Use 0.95 while refining, when relatives are wanted.
    """
    names = corpus.select("candidate").distinct()
    all_ = candidates.unionByName(corpus).distinct()
    pairs = resembling(all_, least)
    ends = pairs.select(F.explode(F.array(F.struct("left", "right", "overlap"), F.struct(F.col("right").alias("left"), F.col("left").alias("right"), "overlap"))).alias("e")).select("e.*")
    to = ends.join(names.select(F.col("candidate").alias("right")), "right", "left_semi").groupBy(F.col("left").alias("candidate")).agg(F.max("overlap").alias("near"))
    out = candidates.select("candidate").distinct().join(to, "candidate", "left").join(names.withColumn("same", F.lit(1.0)), "candidate", "left")
    like = F.greatest("near", "same")
    return out.select("candidate", like.alias("likeness"), F.coalesce(like >= least, F.lit(False)).alias("known"))


def weaknesses(rules: Mapping[str, Column]) -> Column:
    """The names of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
