import datetime as dt

import numpy as np
import pytest

from tessera.functions import expression
from tessera.operators import folds, selection
from tessera.plans import research

D0 = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    g = np.random.default_rng(3)
    rows = []
    for k in range(8):
        price = 50.0 + k
        for t in range(70):
            price *= 1 + g.normal(0, 0.02)
            rows.append((f"S{k}", D0 + dt.timedelta(days=t), price, price * 1.01, price * 0.99, price, float(g.integers(100, 1000)), price))
    return spark.createDataFrame(rows, "symbol string, timestamp date, open double, high double, low double, close double, volume double, vwap double")


SPANS = folds.windows(D0, D0 + dt.timedelta(days=69), folds.Folds(count=3, size=30, step=20, embargo=2, least=10))


def test_a_batch_scores_as_single_runs_do(panel):
    texts = {"a": "rank(volume)", "b": "-ts_delta(close, 5)"}
    both = {(r["factor"], r["fold"]): r["rank_ic"] for r in research.score(panel, texts, SPANS).collect()}
    for k, t in texts.items():
        alone = {r["fold"]: r["rank_ic"] for r in research.score(panel, {k: t}, SPANS).collect()}
        assert alone == {f: pytest.approx(v) for (n, f), v in both.items() if n == k}


def test_refinement_tries_each_form_once_and_keeps_lineage(panel):
    tried = research.refine(panel, ["rank(ts_mean(volume, 4))", "rank(ts_mean(volume, 4))"], SPANS, depth=1, keep=lambda c: True)
    forms = [expression.canonical(expression.parse(c.text)) for c in tried]
    assert len(set(forms)) == len(forms) and [c.depth for c in tried] == [0, 1, 1, 1]
    assert all(c.parent == tried[0].text for c in tried[1:]) and {c.change for c in tried[1:]} == {"unwrap_outer", "window_halve", "window_double"}
    assert len(research.refine(panel, ["volume"], SPANS, keep=lambda c: False)) == 1


def test_settings():
    assert research.settings_id({"a": 1, "b": 2}) == research.settings_id({"b": 2, "a": 1}) != research.settings_id({"a": 1})
    assert research.settings_diff({"a": 1, "b": 2}, {"a": 1, "c": 3}) == {"b": (2, None), "c": (None, 3)}


def test_guarded_materialisation(spark, panel):
    panel.createOrReplaceTempView("panel_view")
    text = "select symbol, timestamp, close from panel_view where timestamp <= :day -- drop nothing"
    sha = research.check_select(text, must=["panel_view"], must_not=["secret"])
    spark.sql("drop table if exists made")
    assert research.materialise(spark, text, "made", sha, {"day": D0}, keys=["symbol", "timestamp"]) == 8
    with pytest.raises(ValueError):
        research.materialise(spark, text + " ", "made", sha, {"day": D0})
    with pytest.raises(ValueError):
        research.materialise(spark, "select symbol from panel_view", "made2", research.check_select("select symbol from panel_view"), keys=["symbol"])
    assert not spark.catalog.tableExists("made2")
    for bad in ("drop table x", "select 1; drop table x", "with a as (select 1) insert into b select * from a", "delete from x"):
        with pytest.raises(ValueError):
            research.check_select(bad)
    with pytest.raises(ValueError):
        research.materialise(spark, text, "made; drop", sha, {"day": D0})
    assert research.size_estimate(panel) > 0
    spark.sql("drop table made")


def test_links_against_all_pairs(spark):
    texts = ["rank(ts_mean(close, 20))", "rank(ts_mean(close, 21))", "rank(ts_mean(close, 40))", "zscore(volume)", "zscore(volume) + close", "close + zscore(volume)", "rank(ts_mean(close, 20)) * 2", "(high - low) / close", "(high - low) / open"]
    trees = {f"e{i}": expression.parse(t) for i, t in enumerate(texts)}
    rows = [(k, repr(f), n) for k, t in trees.items() for f, n in expression.features(expression.canonical(t)).items()]
    for theta in (0.5, 0.7, 0.85):
        got = {r["candidate"]: r["links"] for r in selection.links(spark.createDataFrame(rows, "candidate string, feature string, n int"), theta).collect()}
        feats = {k: expression.features(expression.canonical(t)) for k, t in trees.items()}
        want = {k: sum(sum((feats[k] & feats[o]).values()) / sum((feats[k] | feats[o]).values()) >= theta - 1e-9 for o in trees if o != k) for k in trees}
        assert got == want
