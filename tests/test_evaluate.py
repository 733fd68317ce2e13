import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, folds, selection

D0 = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def perfect(spark):
    rows = [(s, D0 + dt.timedelta(days=t), float(k), 100 * (1 + k / 100) ** t) for k, s in enumerate("ABCDE", 1) for t in range(20)]
    return evaluate.with_forward(spark.createDataFrame(rows, "symbol string, timestamp date, signal double, close double"))


@pytest.fixture(scope="module")
def noisy(spark):
    g = np.random.default_rng(7)
    rows = []
    for k in range(12):
        price = 100.0
        for t in range(80):
            price *= 1 + g.normal(0, 0.02)
            rows.append((f"S{k}", D0 + dt.timedelta(days=t), None if g.random() < 0.05 else float(g.normal()), price, "x" if k % 2 else None))
    return evaluate.with_forward(spark.createDataFrame(rows, "symbol string, timestamp date, signal double, close double, sector string"))


def test_a_perfect_signal_and_a_flat_one(perfect):
    assert evaluate.mean_rank_ic(perfect).first()["rank_ic"] == pytest.approx(1.0)
    spread = evaluate.quantile_spread(perfect).first()["quantile_spread"]
    assert spread == pytest.approx(0.04)
    assert evaluate.turnover(perfect).first()["turnover"] == pytest.approx(0.0)
    flat = perfect.withColumn("signal", F.lit(1.0))
    assert evaluate.mean_rank_ic(flat).first()["rank_ic"] is None and evaluate.quantile_spread(flat).first()["quantile_spread"] is None


def _pandas(df):
    p = df.toPandas()
    return p.dropna(subset=["signal", "fwd"])


def test_statistics_against_pandas(noisy):
    p = _pandas(noisy)
    ic = p.groupby("timestamp")[["signal", "fwd"]].apply(lambda x: x["signal"].corr(x["fwd"]))
    rank = p.groupby("timestamp")[["signal", "fwd"]].apply(lambda x: x["signal"].rank().corr(x["fwd"].rank()))
    assert evaluate.mean_ic(noisy).first()["ic"] == pytest.approx(ic.mean())
    assert evaluate.mean_rank_ic(noisy).first()["rank_ic"] == pytest.approx(rank.mean())

    def spread(x):
        b = pd.qcut(x["signal"], 5, labels=False, duplicates="drop")
        return x["fwd"][b == b.max()].mean() - x["fwd"][b == 0].mean()

    want = p.groupby("timestamp")[["signal", "fwd"]].apply(spread)
    got = evaluate.long_short(noisy).toPandas().set_index("timestamp")["ret"].sort_index()
    assert np.allclose(got.values, want.sort_index().values)


def test_neutral_returns(noisy):
    by = evaluate.sector_neutral(noisy).groupBy("timestamp", "sector").agg(F.abs(F.avg("fwd")).alias("m")).agg(F.max("m")).first()[0]
    assert by < 1e-12
    market = noisy.groupBy("timestamp").agg((F.avg("fwd")).alias("m"))
    pure = noisy.join(market, "timestamp").withColumn("fwd", F.col("m") * 1.5)
    left = evaluate.beta_neutral(pure, lookback=30, least=10).where("fwd is not null").agg(F.max(F.abs("fwd"))).first()[0]
    assert left < 1e-9
    assert evaluate.beta_neutral(noisy, lookback=30, least=10).where("timestamp < date '2026-01-08' and fwd is not null").count() == 0


def test_portfolio_metrics_on_a_known_path(spark):
    r = [0.1, -0.05, 0.02, -0.2, 0.3, 0.0]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(r)], "key string, timestamp int, ret double")
    m = evaluate.portfolio_metrics(df, ["key"]).first()
    cum = np.cumsum(r)
    assert m["mean_return"] == pytest.approx(np.mean(r)) and m["vol"] == pytest.approx(np.std(r, ddof=1)) and m["hit_rate"] == pytest.approx(0.5)
    assert m["max_drawdown"] == pytest.approx((np.maximum.accumulate(cum) - cum).max())
    assert m["tail_concentration"] == pytest.approx((0.3 + 0.1 + 0.02) / sum(r)) and m["sharpe"] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * math.sqrt(252))
    losing = evaluate.portfolio_metrics(df.withColumn("ret", F.lit(-0.1)), ["key"]).first()
    assert losing["tail_concentration"] is None and losing["sharpe"] is None
    assert evaluate.portfolio_metrics(df.limit(0), ["key"]).count() == 0
    e = evaluate.episode_shares(df, 2, ["key"]).first()
    assert e["phases"] == 1 and e["least_gains"] == 0  # the second cohort has no gain, so no share
    assert e["max_share"] == pytest.approx(1.0)


def test_combinations_and_correlations(noisy):
    df = noisy.withColumns({"a": F.col("signal"), "b": -F.col("signal"), "c": F.when(F.col("symbol") < "S5", F.col("close"))})
    got = {(r["left"], r["right"]): r["rank_corr"] for r in evaluate.pairwise_rank_correlation(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(-1) and got["a", "a"] == pytest.approx(1) and got["a", "c"] == got["c", "a"] and len(got) == 9
    one = df.select("timestamp", "a", "c", evaluate.combine(["a", "c"], "equal_weight").alias("e"), evaluate.combine(["a", "b"], "zscore_average").alias("z")).where("a is null and c is null or a is not null and c is null").collect()
    assert all((r["e"] is None) == (r["a"] is None) and (r["a"] is None or r["e"] == pytest.approx(r["a"])) and (r["z"] is None or abs(r["z"]) < 1e-9) for r in one)
    with pytest.raises(ValueError):
        evaluate.combine(["a"], "no such method")


def test_folds_give_what_single_runs_give(noisy):
    rule = folds.Folds(count=4, size=30, step=15, embargo=3, least=10)
    spans = folds.windows(D0, D0 + dt.timedelta(days=79), rule)
    got = {r["fold"]: r for r in folds.walk_forward(noisy, spans).collect()}
    assert [s[0] for s in spans] == sorted(got)
    for k, a, b in spans:
        part = evaluate.with_forward(noisy.drop("fwd").where(F.col("timestamp").between(a, b)))
        alone = evaluate.evaluation(part).first()
        for c in ("ic", "rank_ic", "quantile_spread", "turnover", "sharpe", "max_drawdown", "n_periods"):
            assert got[k][c] == pytest.approx(alone[c], abs=1e-9), c
    summary = folds.summarise(folds.walk_forward(noisy, spans)).first()
    assert summary["rank_ic_deviation"] == pytest.approx(np.std([r["rank_ic"] for r in got.values()]))


def test_spans():
    assert folds.windows(D0, D0 + dt.timedelta(days=10), folds.Folds(size=20)) == []
    inside, out = folds.holdout_span(D0, D0 + dt.timedelta(days=9), 0.25)
    assert (out[1] - out[0]).days + 1 == 2 and inside[1] + dt.timedelta(days=1) == out[0]
    assert folds.holdout_span(D0, D0 + dt.timedelta(days=1), 0.99)[0] == (D0, D0)
    assert folds.add_months(dt.date(2026, 1, 31), 1) == dt.date(2026, 2, 28) and folds.add_months(dt.date(2025, 11, 30), 3) == dt.date(2026, 2, 28)
    assert folds.month_splits(dt.date(2026, 1, 1), dt.date(2026, 6, 30), 2, 1, 1)[0] == (dt.date(2026, 1, 1), dt.date(2026, 2, 28), dt.date(2026, 3, 1), dt.date(2026, 3, 31))


def test_selection(spark):
    assert selection.bonferroni_multiplier(1) == 1 and selection.bonferroni_multiplier(20) == pytest.approx(1.707, abs=2e-3)
    assert selection.sign_test_p(5, 0) == pytest.approx(2 / 32) and selection.sign_test_p(0, 0) == 1 and selection.sign_test_p(3, 3) == 1
    assert selection.sign_test_p(5, 0, 5, count_zeros=True) > selection.sign_test_p(5, 0, 5)
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.1), ("b", 1, 0.2), ("b", 2, -0.1), ("c", 1, None), ("d", 1, 0.3), ("d", 2, 0.1)], "k string, fold int, rank_ic double")
    order = [r["k"] for r in selection.persistence(df, ["k"]).orderBy("place").collect()]
    assert order == ["a", "d", "b", "c"]
    rules = [("small", "reject", F.col("rank_ic") < 0), ("weak", "refine", F.col("rank_ic") < 0.15)]
    got = {(r["k"], r["fold"]): (r["gate"], r["decision"]) for r in selection.decide(df, rules, "keep").collect()}
    assert got["b", 2] == ("small", "reject") and got["a", 1] == ("weak", "refine") and got["c", 1] == ("none", "keep")
    all_ = [r for r in selection.tally(df, ["k"], "rank_ic").collect() if r["level"] == 1][0]
    assert (all_["n"], all_["positive"]) == (6, 5)
