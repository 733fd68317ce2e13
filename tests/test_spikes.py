import numpy as np
import pandas as pd
import pytest

from tessera.operators import spikes
from tessera.operators.spikes import SpikeRules

BASE = pd.Timestamp("2026-01-05 01:30:00")
SCHEMA = "id bigint, stock string, day date, kind string, time timestamp_ntz, value double, size bigint, k0 string, flags int, at string"


def readings(n=400, seed=1, price=50.0, stock="A", kind="TRADE", first=0):
    g = np.random.default_rng(seed)
    value = (price * np.exp(np.cumsum(g.normal(0, 4e-4, n)))).round(2)
    size = (np.exp(g.normal(6, 0.9, n)).astype(int) + 1) * 100
    return pd.DataFrame({
        "id": first + np.arange(n), "stock": stock, "day": BASE.date(), "kind": kind, "time": BASE + pd.to_timedelta(np.arange(n) * 20, "s"), "value": value, "size": size, "k0": "x", "flags": 9, "at": "y",
    })


def flags(spark, pdf, rules=SpikeRules(), **kw):
    def plain(name, x):
        if x is None or x is pd.NaT or x != x:
            return None
        return int(x) if name in ("id", "size", "flags") else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x

    rows = [tuple(plain(n, x) for n, x in zip(pdf.columns, r, strict=True)) for r in pdf.astype(object).itertuples(index=False)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = spikes.flag_readings(df, id="id", source=["stock"], block=["day"], channel=["kind"], time="time", value="value", size="size", rules=rules, **kw)
    return {r["id"]: r["flags"] for r in out.collect()}


def test_clean_series_has_no_cases(spark):
    assert flags(spark, readings()) == {}


def test_each_kind_of_case(spark):
    p = readings()
    p.loc[40, "value"] *= 10
    p.loc[[100, 101, 102], "value"] *= 0.6  # a short burst
    p.loc[150, "value"] = 0
    p.loc[151, "size"] = -100
    p.loc[200:215, ["value", "size"]] = [51.0, 700]
    p.loc[300, "size"] = 2147483647
    p.loc[320, "value"] = np.nan
    got = flags(spark, p)
    assert got[40] == spikes.SPIKE and all(got[i] & spikes.SPIKE for i in (100, 101, 102))
    assert got[150] == spikes.LIMIT and got[151] == spikes.LIMIT and got[300] == spikes.SIZE
    assert all(got[i] & spikes.STUCK for i in range(200, 216))
    assert set(got) == {40, 100, 101, 102, 150, 151, 300, *range(200, 216)}


def test_level_shift_and_block_trade_are_no_cases_but_a_spike_beside_a_shift_is(spark):
    p = readings()
    p.loc[200:, "value"] = (p.loc[200:, "value"] * 0.85).round(2)
    p.loc[50, "size"] = int(p["size"].median() * 200)
    assert flags(spark, p) == {}
    p.loc[197, "value"] = round(p.loc[197, "value"] * 0.86, 2)
    assert set(flags(spark, p)) == {197}


def test_repeated_rows_are_judged_alike_and_channels_ignore_case(spark):
    p = readings()
    p.loc[40, "value"] *= 10
    again = p.loc[[40]].assign(id=9040)
    p.loc[100:115, ["value", "size"]] = [51.0, 700]
    p.loc[105, "kind"] = " trade"
    got = flags(spark, pd.concat([p, again], ignore_index=True))
    assert got[40] == got[9040] == spikes.SPIKE
    assert all(got[i] & spikes.STUCK for i in range(100, 116))


def test_missing_columns_and_small_groups(spark):
    p = readings(3)
    p["stock"] = None
    p.loc[1, ["value", "size"]] = np.nan
    p.loc[2, "kind"] = None
    assert flags(spark, p) == {}
    assert flags(spark, readings(0)) == {}
    p["time"] = pd.NaT
    assert flags(spark, p) == {}


def _mixed(n=9000):
    """Two volatilities, shifts, stuck runs and spikes, ordinary sizes and one that is not, over several days."""
    g = np.random.default_rng(11)
    p = readings(n, seed=3)
    noise = np.where(np.arange(n) < n // 2, 4e-4, 3e-3)
    p["value"] = (50 * np.exp(np.cumsum(g.normal(0, noise)))).round(3)
    p.loc[n // 3 :, "value"] = (p.loc[n // 3 :, "value"] * 1.2).round(3)
    for i in g.integers(0, n, 60):
        p.loc[i, "value"] = round(p.loc[i, "value"] * float(np.exp(g.choice([-1, 1]) * g.uniform(0.03, 1))), 3)
    for i in (480, 990, 2995, 4998, 7100):
        p.loc[i : i + 14, ["value", "size"]] = [p.loc[i, "value"], 700]
    p.loc[[1000, 5500], "size"] = 2147483647
    p["time"] = BASE + pd.to_timedelta(np.arange(n) * 4, "s")
    return p


def test_where_a_hot_source_is_cut_changes_no_verdict(spark, monkeypatch):
    p = _mixed()
    whole = flags(spark, p, SpikeRules(window=1_000_000))
    monkeypatch.setattr(spikes, "SLOTS", (3_600_000_000, 60_000_000, 1_000_000))
    assert len(whole) > 100 and {spikes.STUCK, spikes.SPIKE, spikes.SIZE} <= set(whole.values())
    for window in (700, 3000):
        assert flags(spark, p, SpikeRules(window=window, context=2500)) == whole


def test_windows_hold_each_row_once_and_the_context_around(spark):
    g = np.random.default_rng(0)
    rows = [(s, int(t), i) for i, (s, t) in enumerate(zip(g.choice(["a", "a", "a", "b"], 4000), g.integers(0, 500_000, 4000)))]
    df = spark.createDataFrame(rows, "src string, at bigint, rid bigint")
    out = spikes.windows_of(df, (100_000, 1000), 300, 200).toPandas()
    own = out[out.own]
    assert sorted(own.rid) == list(range(4000)) and own.groupby(["src", "win"]).size().max() < 700
    for s in "ab":
        at = np.sort(np.array([t for k, t, _ in rows if k == s]))
        for _, w in out[out.src == s].groupby("win"):
            low, high = w[w.own]["at"].min(), w[w.own]["at"].max()
            need = np.concatenate([at[at < low][-200:], at[at > high][:200]])
            assert set(need) <= set(w["at"])


def test_sparse_and_quiet_sources_are_judged_by_themselves(spark):
    g = np.random.default_rng(4)
    sparse = readings(60, seed=9)  # two readings a day
    sparse["time"] = BASE + pd.to_timedelta(np.arange(60) * 12, "h")
    sparse["day"] = sparse["time"].dt.date
    sparse.loc[31, "value"] *= 100
    quiet = readings(400, stock="Q", first=1000)
    quiet["value"] = (50 * np.exp(g.normal(0, 5e-4, 400))).round(3)
    quiet.loc[200, "value"] = round(quiet.loc[200, "value"] * 1.025, 3)  # 50 of its deviations
    wild = readings(400, stock="W", first=2000)
    wild["value"] = (50 * np.exp(g.normal(0, 1e-2, 400))).round(3)
    wild.loc[200, "value"] = round(wild.loc[199, "value"] * 1.025, 3)
    assert set(flags(spark, pd.concat([sparse, quiet, wild], ignore_index=True))) == {31, 1200}


def test_level_shifts_are_told_by_their_statistic():
    g = np.random.default_rng(6)
    y = g.normal(0, 1e-3, 300)
    y[120:] += 0.1
    y[200:] -= 0.25
    y[[118, 121, 250]] += 0.5
    out, shifts = spikes.additive_outliers(y, SpikeRules())
    assert list(np.flatnonzero(shifts)) == [120, 200] and set(np.flatnonzero(out)) == {118, 121, 250}


def test_rows_without_a_time_are_only_held_to_limits(spark):
    p = readings(50)
    p["time"] = pd.NaT
    p.loc[3, "value"] = -1
    p.loc[4, "size"] = -1
    p.loc[5, "value"] *= 100
    assert flags(spark, p) == {3: spikes.LIMIT, 4: spikes.LIMIT}


def test_robust_ar1_finds_the_coefficient_despite_outliers():
    g = np.random.default_rng(0)
    x = np.zeros(4000)
    for i in range(1, len(x)):
        x[i] = 0.6 * x[i - 1] + g.normal()
    x[::97] += 40
    phi, scale = spikes.robust_ar1(x, 500)
    assert 0.5 < np.median(phi) < 0.7 and 0.8 < np.median(scale) < 1.3


def test_additive_outliers_against_brute_force():
    g = np.random.default_rng(5)
    y = np.log(20 * np.exp(np.cumsum(g.normal(0, 3e-4, 500))))
    at = [30, 31, 250, 499]
    y[at] += 0.2
    found = set(np.flatnonzero(spikes.additive_outliers(y, SpikeRules())[0]))
    brute = {i for i in range(500) if abs(y[i] - np.median(np.delete(y[max(0, i - 10) : i + 11], min(i, 10)))) > 0.1}
    assert found == brute == set(at)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_too_short_series(n):
    assert not any(x.any() for x in spikes.additive_outliers(np.ones(n), SpikeRules()))


def test_counts_by_load(spark):
    g = np.random.default_rng(2)
    rows = [(i, "A", i, int(g.poisson(200)), 50_000) for i in range(1, 39)]
    rows[4] = (5, "A", 5, 7000, 50_000)
    rows[9] = (10, "A", 10, -1, 50_000)
    rows[14] = (15, "A", 15, 60_000, 50_000)
    for i in range(20, 29):
        rows[i] = (i + 1, "A", i + 1, 211, 50_000)
    rows.append((99, "A", 5, 7000, 50_000))
    rows.append((100, None, None, None, None))
    df = spark.createDataFrame(rows, "id bigint, s string, load bigint, n bigint, total bigint")
    out = spikes.flag_counts(df, id="id", source=["s"], order="load", count="n", total="total").collect()
    got = {r["id"]: r["flags"] for r in out}
    assert got == {5: spikes.SPIKE, 99: spikes.SPIKE, 10: spikes.LIMIT, 15: spikes.LIMIT, **{i: spikes.STUCK for i in range(21, 30)}}


def test_a_spike_delivered_again_many_times_is_found_with_all_its_copies(spark):
    p = readings()
    p.loc[40, "value"] *= 10
    p.loc[300, "value"] = round(p.loc[300, "value"] * 0.8, 2)
    again = pd.concat([p.loc[[i]].assign(id=9000 + 100 * i + k) for i in (40, 300) for k in range(12)])
    assert set(flags(spark, pd.concat([p, again], ignore_index=True))) == {40, 300, *again["id"]}


@pytest.mark.parametrize("length", [9, 10, 12, 40, 90])
def test_a_long_burst_that_returns_is_found_whole_and_a_shift_is_not(length):
    g = np.random.default_rng(length)
    y = np.log(20 * np.exp(np.cumsum(g.normal(0, 3e-4, 400))))
    y[200 : 200 + length] += 0.2
    y[60] -= 0.3
    assert set(np.flatnonzero(spikes.additive_outliers(y, SpikeRules())[0])) == {60, *range(200, 200 + length)}
    y[200 + length :] += 0.4  # the stretch is now a step of a stair
    assert set(np.flatnonzero(spikes.additive_outliers(y, SpikeRules())[0])) - set(range(200, 209)) == {60}


def test_rounds_end_on_series_that_are_half_bursts():
    g = np.random.default_rng(0)
    for _ in range(200):
        y = np.cumsum(g.normal(0, 3e-4, 120)) + 0.2 * (g.random(120) < 0.4)
        assert len(spikes.additive_outliers(y, SpikeRules())[0]) == 120


def test_a_count_rebuilt_many_times_is_found_with_all_its_copies(spark):
    g = np.random.default_rng(2)
    rows = [(i, "A", i, int(g.poisson(200)), 50_000) for i in range(1, 39)]
    rows[4] = (5, "A", 5, 7000, 50_000)
    rows += [(100 + k, "A", 5, 7000, 50_000) for k in range(12)]
    df = spark.createDataFrame(rows, "id bigint, s string, load bigint, n bigint, total bigint")
    out = spikes.flag_counts(df, id="id", source=["s"], order="load", count="n", total="total").collect()
    assert {r["id"]: r["flags"] for r in out} == {i: spikes.SPIKE for i in (5, *range(100, 112))}
