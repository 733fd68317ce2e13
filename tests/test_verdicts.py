"""Gates, plans of folds, novelty, exact tests, audits, batches, tables that expire."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import expression
from tessera.operators import evaluate, events, folds, selection
from tessera.plans import research
from tessera.sources import readers

GOOD = dict(
    n_periods=100, n_assets=50, ic=0.05, rank_ic=0.06, quantile_spread=0.01, horizons=3, same_sign=3, folds=4, positive_share=0.75, complemented=True, max_correlation=0.2, lift_share=0.8, holdout_lift=0.01,
    tail_concentration=0.2, holdout_rank_ic=0.05, likeness=0.1, trials=1,
)
CASES = {
    "insufficient data": [dict(n_periods=59), dict(n_assets=9)], "weak": [dict(ic=0.019), dict(rank_ic=None), dict(quantile_spread=0.004), dict(trials=1000, ic=0.03)], "signs differ": [dict(same_sign=1)], "unstable": [dict(positive_share=0.59)],
    "no complement": [dict(max_correlation=0.51), dict(max_correlation=None), dict(lift_share=0.5), dict(lift_share=None), dict(holdout_lift=0.0), dict(holdout_lift=None)], "concentrated": [dict(tail_concentration=0.51)],
    "decayed": [dict(holdout_rank_ic=-0.01), dict(holdout_rank_ic=0.02), dict(holdout_rank_ic=0.0)], "known": [dict(likeness=0.85)], "margin": [dict(ic=0.0239), dict(quantile_spread=0.0059)],
    "none": [{}, dict(horizons=1, same_sign=0), dict(folds=1, positive_share=0.0), dict(complemented=False, max_correlation=0.9), dict(complemented=None, lift_share=None), dict(tail_concentration=None), dict(holdout_rank_ic=None), dict(n_periods=None, likeness=None)],
}


def _plain(m, rules):
    """The gate of one candidate, in plain Python."""
    z = selection.bonferroni_multiplier(m["trials"], rules.alpha)
    levels = {"ic": rules.ic * z, "rank_ic": rules.rank_ic * z, "quantile_spread": rules.quantile_spread}
    below = lambda k, x: m[k] is not None and m[k] < x
    above = lambda k, x: m[k] is not None and m[k] > x
    if below("n_periods", rules.min_periods) or below("n_assets", rules.min_assets):
        return "insufficient data"
    if any(m[k] is None or m[k] < x for k, x in levels.items()):
        return "weak"
    if (m["horizons"] or 0) >= 2 and below("same_sign", 2):
        return "signs differ"
    if (m["folds"] or 0) >= 2 and below("positive_share", rules.positive_folds):
        return "unstable"
    if m["complemented"] and (m["max_correlation"] is None or m["max_correlation"] > 0.5 or m["lift_share"] is None or m["lift_share"] < 0.6 or m["holdout_lift"] is None or m["holdout_lift"] <= 0):
        return "no complement"
    if above("tail_concentration", rules.tail):
        return "concentrated"
    held = m["holdout_rank_ic"]
    if held is not None and m["rank_ic"] != 0 and ((held > 0) != (m["rank_ic"] > 0) or held / m["rank_ic"] < rules.holdout_ratio):
        return "decayed"
    if m["likeness"] is not None and m["likeness"] >= rules.novelty:
        return "known"
    return "margin" if any(x > 0 and (m[k] - x) / x < rules.margin for k, x in levels.items()) else "none"


def _frame(spark, rows):
    schema = ", ".join(f"{k} {t}" for k, t in {"id": "int", **selection.METRICS}.items())
    return spark.createDataFrame([(i, *[r[k] for k in selection.METRICS]) for i, r in enumerate(rows)], schema)


def test_every_gate_is_reached_in_order(spark):
    rows = [(gate, {**GOOD, **change}) for gate, changes in CASES.items() for change in changes]
    got = {r["id"]: (r["gate"], r["decision"]) for r in selection.judged(_frame(spark, [m for _, m in rows])).collect()}
    for i, (gate, m) in enumerate(rows):
        assert got[i] == (gate, {"margin": "refine", "none": "promote"}.get(gate, "reject")) and _plain(m, selection.STRICT) == gate


@pytest.mark.parametrize("rules", [selection.STRICT, selection.LENIENT])
def test_gates_against_plain_python(spark, rules):
    g = random.Random(4)
    pool = {k: [GOOD[k]] * 6 + [c[k] for changes in CASES.values() for c in changes if k in c] + ([None] if k != "trials" else [1, 5]) for k in GOOD}
    rows = [{k: g.choice(v) for k, v in pool.items()} for _ in range(400)]
    got = {r["id"]: r["gate"] for r in selection.judged(_frame(spark, rows), rules).collect()}
    assert [got[i] for i in range(len(rows))] == [_plain(m, rules) for m in rows] and len(set(got.values())) >= 8


def test_metrics_that_are_missing_or_empty_pass_or_stop(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.5)], "id int, ic double, rank_ic double, quantile_spread double")
    assert selection.judged(df, trials=3).first()["decision"] == "promote"
    assert selection.judged(df.select("id", "ic"), trials=3).first()["gate"] == "weak"
    assert selection.judged(df.limit(0)).count() == 0


def test_plans_of_folds():
    a, b = dt.date(2026, 1, 1), dt.date(2026, 6, 30)
    p = folds.plan(a, b, folds.Folds(count=9, size=60, step=30, embargo=None, least=20, lag=1, horizon=5))
    assert (p.attempted, len(p.folds), p.purged, p.embargo, p.skipped) == (5, 5, 0, 6, None) and p.folds[0] == (0, a, a + dt.timedelta(days=53))
    p = folds.plan(a, b, folds.Folds(count=3, size=30, step=30, embargo=15, least=20))
    assert (p.attempted, len(p.folds), p.purged, p.skipped) == (3, 0, 3, "span too short")


def test_exact_sign_test_against_the_driver(spark):
    pairs = list(itertools.product(range(9), range(9))) + [(200, 150), (400, 600)]
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("p", selection.sign_p(F.col("a"), F.col("b")))
    assert all(r["p"] == pytest.approx(selection.sign_test_p(r["a"], r["b"]), rel=1e-9) for r in df.collect())


def test_canonical_forms_features_and_likeness_by_hand():
    form = lambda t: expression.canonical(expression.parse(t))
    assert form("close + open") == ("+", ("field", "close"), ("field", "open")) == form("open + (close)")
    assert form("open - -close") == form("close + open") and form("-(-3)") == ("num", 3.0) and form("2 * close * 3") == form("3 * (2 * close)")
    assert form("close - open") == ("+", ("field", "close"), ("neg", ("field", "open"))) != form("open - close")
    assert expression.features(form("rank(close) / 20")) == {(0, "/", ""): 1, (1, "fn", "rank"): 1, (2, "field", "close"): 1, (1, "num", 3): 1}
    like = lambda a, b: expression.similarity(expression.parse(a), expression.parse(b))
    assert like("close + open", "open + close") == 1.0 and like("rank(close)", "rank(open)") == pytest.approx(1 / 3) and like("close", "rank(close)") == 0.0


def test_novelty_against_all_pairs(spark):
    g = random.Random(2)
    make = lambda p, n: [(f"{p}{i}", f, g.randrange(1, 3)) for i in range(n) for f in g.sample("abcdefgh", g.randrange(3, 7))]
    cands, corpus = make("c", 25), make("k", 25)
    cands += [("k3", f, n) for k, f, n in corpus if k == "k3"]
    sets = lambda rows: {k: {f: n for c, f, n in rows if c == k} for k in {r[0] for r in rows}}
    of = lambda a, b: sum(min(a.get(f, 0), b.get(f, 0)) for f in {*a, *b}) / sum(max(a.get(f, 0), b.get(f, 0)) for f in {*a, *b})
    schema = "candidate string, feature string, n int"
    got = {r["candidate"]: (r["likeness"], r["known"]) for r in selection.novelty(spark.createDataFrame(cands, schema), spark.createDataFrame(corpus, schema), 0.6).collect()}
    for c, a in sets(cands).items():
        best = max(of(a, b) for b in sets(corpus).values())
        assert got[c][1] is (best >= 0.6) and (got[c][0] == pytest.approx(best) if best >= 0.6 else got[c][0] is None)


def test_audits_have_four_states(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    count = lambda c: lambda: df.agg(F.count_if(F.expr(c)).alias("failed"))
    status = lambda checks: {r["check_name"]: (r["failed"], r["status"]) for r in events.audit(spark, checks).collect()}
    assert status({"a": (True, count("x > 5")), "b": (False, count("x > 5"))})["all"] == (0, "PASSED")
    assert status({"a": (True, count("x > 5")), "b": (False, count("x > 1"))}) == {"a": (0, "PASSED"), "b": (1, "REVIEW_REQUIRED"), "all": (1, "REVIEW_REQUIRED")}
    assert status({"a": (True, count("x > 0")), "b": (False, count("x > 1"))})["all"] == (3, "BLOCKED")
    assert status({"a": (True, count("gone > 0")), "b": (True, count("x > 1"))}) == {"a": (None, "FAILED"), "b": (1, "BLOCKED"), "all": (1, "FAILED")}


def test_batches_grow_their_family_and_know_what_was_tried(spark):
    bars = readers.synthetic_bars(spark, [f"S{i}" for i in range(12)], 90, start="2026-01-01")
    spans = folds.windows(dt.date(2026, 1, 1), dt.date(2026, 5, 1), folds.Folds(count=3, size=40, step=30, embargo=2, least=10))
    loose = selection.replace(selection.STRICT, ic=-1.0, rank_ic=-1.0, quantile_spread=-1.0, min_periods=1, min_assets=1, positive_folds=0.0, tail=1e9)
    out = research.run_batch(bars, [["rank(close)", "close - open"], ["-open + close", "ts_mean(volume, 3)"], []], spans, loose)
    got = {(r["cycle"], r["expression"]): r for r in out.collect()}
    assert {k: r["trials"] for k, r in got.items()} == {(0, "rank(close)"): 2, (0, "close - open"): 2, (1, "-open + close"): 3, (1, "ts_mean(volume, 3)"): 3}
    assert got[1, "-open + close"]["gate"] == "known" and got[1, "-open + close"]["decision"] == "reject" and got[0, "rank(close)"]["decision"] == "promote" and got[0, "rank(close)"]["folds"] == 3
    reports = {r["cycle"]: r for r in research.cycle_reports(out).collect()}
    assert (reports[1]["n"], reports[1]["n_promote"], reports[1]["n_reject"], reports[1]["promoted"], reports[1]["by_gate"]) == (2, 1, 1, ["ts_mean(volume, 3)"], {"known": 1, "none": 1})


def test_an_empty_stream_has_one_row_of_nothing(spark):
    empty = spark.createDataFrame([], "timestamp date, ret double, turnover double")
    r = evaluate.portfolio_metrics(empty).first()
    assert r["n"] == 0 and all(r[c] is None for c in ("mean_return", "vol", "sharpe", "hit_rate", "max_drawdown", "tail_concentration"))
    r = evaluate.long_only_net(empty, F.lit(0.001)).first()
    assert r["days"] == 0 and r["net"] is None


def test_components_by_three_modes(spark):
    df = spark.createDataFrame([("a", 0, 0.1, 0.5, 1.0, 0.1), ("b", 1, None, 0.9, 0.5, 0.2), ("c", 2, 0.3, 0.5, 2.0, 0.0)], "factor string, position int, rank_ic double, positive_share double, score double, mean double")
    names = lambda *a: [r["factor"] for r in selection.components(df, *a).collect()]
    assert names("input_order") == ["a", "b", "c"] and names("rank_ic", 2) == ["c", "a"] and names("persistence", 3) == ["b", "c", "a"]
    with pytest.raises(ValueError):
        names("rank_ic")
    with pytest.raises(ValueError):
        names("persistence", 1)


def test_tables_expire(spark):
    df = spark.range(3)
    readers.write_table(df, "keeps")
    readers.write_table(df, "goes", days=7)
    assert readers.drop_expired(spark, ["keeps", "goes"]) == []
    assert readers.drop_expired(spark, ["keeps", "goes"], today="2999-01-01") == ["goes"] and spark.catalog.tableExists("keeps") and not spark.catalog.tableExists("goes")
    spark.sql("drop table keeps")
