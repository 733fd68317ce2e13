"""Orphans, profiles and trailing totals on small tables, against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import orphans, profile, rolling

T = dt.datetime


def _orphans(spark, parents, children):
    p = spark.createDataFrame(parents, "code string, s timestamp_ntz, e timestamp_ntz, key string")
    c = spark.createDataFrame(children, "id bigint, code string, at timestamp_ntz, key string, n bigint")
    parent = orphans.Parent("p", p, orphans.number_key(F.col("code")), "s", "e")
    child = orphans.Child("c", c, orphans.number_key(F.col("code")), "at", "id")
    return parent, [child]


def test_orphans_by_time_and_notation(spark):
    parents = [("00427", T(2026, 1, 1), T(2026, 3, 15, 12), "x"), ("00427", T(2026, 4, 1), None, "x"), ("00005", None, None, "x"), ("00006", T(2026, 5, 2), T(2026, 5, 1), "x"), (None, T(2020, 1, 1), None, "x")]
    children = [
        (1, "427 HK Equity", T(2026, 2, 1), "y", 1), (2, "HK00427", T(2026, 3, 15, 12), "y", 1), (3, "427", T(2026, 3, 15, 11), "y", 1), (4, "0427.HK", T(2026, 4, 1), "y", 1), (5, "427", T(2025, 12, 31), "y", 1),
        (6, "5", T(2026, 2, 1), "y", 1), (7, "6", T(2026, 5, 3), "y", 1), (8, None, T(2026, 2, 1), "y", 1), (9, "none", T(2026, 2, 1), "y", 1), (10, "427", None, "y", 1), (11, "777", T(2026, 2, 1), "y", 1), (11, "777", T(2026, 2, 1), "y", 1),
    ]
    parent, child = _orphans(spark, parents, children)
    rows = [(r["row_id"], r["period"]) for r in orphans.orphan_rows(parent, child).collect()]
    assert sorted(rows, key=str) == sorted([(2, "2026-03"), (5, "2025-12"), (6, "2026-02"), (7, "2026-05"), (8, "2026-02"), (9, "2026-02"), (10, None), (11, "2026-02"), (11, "2026-02")], key=str)
    report = {r["period"]: (r["orphan_rows"], r["orphan_keys"]) for r in orphans.orphan_report(parent, child).collect()}
    assert report["2026-02"] == (5, 3) and report[None] == (1, 1)


def test_orphans_against_brute_force(spark):
    g = random.Random(4)
    day = lambda: T(2025, 10, 1) + dt.timedelta(hours=g.randrange(6000))
    parents = []
    for _ in range(60):
        s, e = day(), day()
        parents.append((f"{g.randrange(12):05d}", s, e if g.random() < 0.7 else None, "x"))
    children = [(i, str(g.randrange(15)), day(), "y", 1) for i in range(500)]
    parent, child = _orphans(spark, parents, children)
    got = {r["row_id"] for r in orphans.orphan_rows(parent, child).collect()}
    want = {i for i, c, at, _, _ in children if not any(int(p) == int(c) and s <= at and (e is None or (at < e and e > s)) for p, s, e, _ in parents)}
    assert got == want


@pytest.mark.parametrize("which", ["children", "parents", "both"])
def test_orphans_of_empty_tables(spark, which):
    parents = [] if which != "children" else [("1", T(2026, 1, 1), None, "x")]
    children = [] if which != "parents" else [(1, "1", T(2026, 1, 2), "y", 1)]
    parent, child = _orphans(spark, parents, children)
    assert orphans.orphan_rows(parent, child).count() == len(children)


def test_trailing_totals_against_brute_force(spark):
    g = random.Random(2)
    d0 = dt.date(2026, 1, 1)
    rows, n = [], 0
    for stock in ("A", "B", None):
        for k in range(120):
            for _ in range(g.choice([0, 0, 1, 1, 2])):
                n += 1
                rows.append((n, stock, d0 + dt.timedelta(days=k) if g.random() < 0.98 else None, g.choice([None, float("nan"), 0.0, float(g.randrange(1000))]), T(2026, 6, 1) + dt.timedelta(days=g.randrange(2)), "s1", 5))
    df = spark.createDataFrame(rows, "row_id bigint, stock string, date date, v double, loaded timestamp_ntz, s1_v string, n_v int")
    got = {(r["stock"], r["date"]): r for r in rolling.trailing_totals(df, entity="stock", day="date", values=["v"], order=["loaded", "row_id"], windows=(7, 30, 5)).collect()}
    want = {}
    for i, s, d, v, at, _, _ in rows:
        if s is not None and d is not None:
            want.setdefault((s, d), []).append((at, i, None if v is None or math.isnan(v) else v))
    last = {k: max(x)[2] for k, x in want.items()}
    for stock in ("A", "B"):
        days = [d for s, d in last if s == stock]
        for k in range((max(days) - min(days)).days + 1):
            day = min(days) + dt.timedelta(days=k)
            r = got.pop((stock, day))
            for w in (7, 30, 5):
                values = [x for i in range(w) if (x := last.get((stock, day - dt.timedelta(days=i)))) is not None]
                assert r[f"v_sum_{w}"] == pytest.approx(sum(values)) and r[f"v_avg_{w}"] == pytest.approx(sum(values) / w)
                assert r[f"v_mean_{w}"] == (pytest.approx(sum(values) / len(values)) if values else None)
    assert not got
    assert rolling.trailing_totals(df.limit(0), entity="stock", day="date", values=["v"], order=["loaded"]).count() == 0


SPEC = profile.Profiled("t", "load", "at", ("n",))


def _loads(spark, loads=12, rows=40, seed=0, change=None):
    g = random.Random(seed)
    out = []
    for load in range(loads):
        for i in range(rows):
            r = {"load": load, "n": int(math.exp(g.gauss(8, 1))), "day": dt.date(2026, 1, 2) + dt.timedelta(days=7 * load - g.randrange(5)), "s": g.choice(["ab1", "cd2", None]), "at": T(2026, 1, 3) + dt.timedelta(days=7 * load)}
            if change:
                change(r, i)
            out.append(tuple(r.values()))
    return spark.createDataFrame(out, "load bigint, n bigint, day date, s string, at timestamp_ntz")


def test_profile_is_exact(spark, tmp_path):
    df = _loads(spark, 3)
    store = profile.ValueCounts(spark, str(tmp_path / "store"))
    assert store.counts().count() == 0 and store.loads().count() == 0
    assert store.refresh(df, SPEC) == {"added": 3, "taken back": 0}
    got = {(r["column_name"], r["load_id"]): r for r in profile.profile(store.counts()).collect()}
    rows = df.collect()
    for load in range(3):
        own = [r for r in rows if r["load"] == load]
        r = got["n", load]
        assert (r["rows"], r["nulls"], r["distinct_values"]) == (40, 0, len({x["n"] for x in own}))
        assert (r["value_min"], r["value_max"]) == (min(x["n"] for x in own), max(x["n"] for x in own))
        s = got["s", load]
        counts = {}
        for x in own:
            counts[x["s"]] = counts.get(x["s"], 0) + 1
        m = 40 - counts.get(None, 0)
        assert s["nulls"] == counts.get(None, 0) and s["entropy"] == pytest.approx(-sum(c / m * math.log2(c / m) for v, c in counts.items() if v), abs=1e-6)


def _counted(df):
    return sorted(map(tuple, profile.value_counts(df, SPEC).collect()), key=repr)


def test_deltas_follow_new_changed_and_withdrawn_loads(spark, tmp_path):
    df = _loads(spark, 6).cache()
    store = profile.ValueCounts(spark, str(tmp_path / "store"), most_deltas=3)
    kept = lambda: sorted(map(tuple, store.counts().select(*profile.value_counts(df, SPEC).columns).collect()), key=repr)
    first = df.where("load < 4")
    assert store.refresh(first, SPEC) == {"added": 4, "taken back": 0} and kept() == _counted(first)
    declared = store.counts()
    assert store.refresh(first, SPEC) == {"added": 0, "taken back": 0} and len(store.deltas("gen-000000")) == 1
    more = df.where("load < 5")
    assert store.refresh(more, SPEC) == {"added": 1, "taken back": 0} and kept() == _counted(more)
    delta = spark.read.parquet(f"{tmp_path}/store/gen-000000/{store.deltas('gen-000000')[1]}/counts")
    assert [r[0] for r in delta.select("load_id").distinct().collect()] == [4]  # the delta of load 4 has load 4 only
    changed = more.where("load <> 1").unionByName(df.where("load = 1").withColumn("n", F.col("n") + 1)).unionByName(df.where("load = 5"))
    assert store.refresh(changed, SPEC) == {"added": 2, "taken back": 1} and kept() == _counted(changed)
    less = changed.where("load <> 3").unionByName(df.limit(5).withColumn("load", F.lit(None).cast("bigint")))
    assert store.refresh(less, SPEC) == {"added": 1, "taken back": 1} and kept() == _counted(less)  # and is compacted now
    assert store._base() == "gen-000001" and len(store.deltas("gen-000001")) == 1
    assert store.refresh(less.where("load is not null"), SPEC) == {"added": 0, "taken back": 1} and kept() == _counted(less.where("load is not null"))
    assert declared.count() == len(_counted(first))  # what was declared before still reads what it was declared over


def test_a_load_is_added_with_a_filter_on_the_scan(spark, tmp_path):
    _loads(spark, 3).write.partitionBy("load").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    one = profile._of_loads(df, F.col("load").cast("bigint"), spark.range(2, 3), 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load" in plan and one.count() == 40
    many = profile._of_loads(df, F.col("load").cast("bigint"), spark.range(2, 3), profile.NAMED_LOADS + 1)
    assert many.count() == 40


def test_all_rows_of_a_short_week_on_one_date_are_found_and_a_week_of_one_day_is_not(spark):
    def crowd(r, i):
        if r["load"] == 7:
            r["day"] = dt.date(2026, 2, 20)

    df = _loads(spark, rows=60, change=crowd)
    short = df.where("load <> 7 or dayofweek(at) > 0").withColumn("k", F.monotonically_increasing_id())
    two_days = short.where("load <> 7").unionByName(short.where("load = 7").limit(24)).drop("k")
    one_day = short.where("load <> 7").unionByName(short.where("load = 7").limit(12)).drop("k")
    found = lambda d: [r["load_id"] for r in profile.differing_loads(profile.value_counts(d, SPEC), {"t": "at"}).where("column_name = 'day'").collect()]
    assert found(two_days) == [7] and found(one_day) == []


@pytest.mark.parametrize(
    ("column", "what"),
    [
        ("n", lambda r, i: r.update(n=None) if i % 3 == 0 else None), ("n", lambda r, i: r.update(n=-r["n"]) if i % 4 == 0 else None), ("n", lambda r, i: r.update(n=65535) if i % 2 else None),
        ("n", lambda r, i: r.update(n=r["n"] * 100)), ("n", lambda r, i: r.update(n=0)), ("day", lambda r, i: r.update(day=r["day"].replace(year=1926)) if i % 2 else None),
        ("day", lambda r, i: r.update(day=dt.date(2026, 2, 10))), ("day", lambda r, i: r.update(day=None) if i % 3 == 0 else None), ("s", lambda r, i: r.update(s="##") if i % 2 else None),
    ],
)
def test_the_changed_load_is_found_and_no_other(spark, column, what):
    df = _loads(spark, change=lambda r, i: what(r, i) if r["load"] == 6 else None)
    found = profile.differing_loads(profile.value_counts(df, SPEC), {"t": "at"}).where(F.col("column_name") == column).collect()
    assert [r["load_id"] for r in found] == [6]


@pytest.mark.parametrize("ids", ["in turn", "side by side"])
def test_faults_that_loads_of_other_copies_share_are_found_in_each(spark, ids):
    def change(r, i):
        if r["load"] == 3 and i % 2:
            r["day"] = r["day"].replace(year=1926)
        if r["load"] == 6 and i % 3:
            r["day"] = r["at"].date() + dt.timedelta(days=i % 2)
        if r["load"] == 9:
            r["day"] = dt.date(2026, 3, 3)

    one = _loads(spark, 38, change=change)
    copies, load = 10, F.col("load")
    df = one.crossJoin(spark.range(copies)).withColumn("load", load + 38 * F.col("id") if ids == "in turn" else load * 100 + F.col("id")).drop("id")
    found = [r["load_id"] for r in profile.differing_loads(profile.value_counts(df, SPEC), {"t": "at"}).where("column_name = 'day'").collect()]
    assert sorted(found) == sorted(x + 38 * k if ids == "in turn" else x * 100 + k for x in (3, 6, 9) for k in range(copies))


def test_a_surge_a_late_row_and_a_short_week_are_no_differences(spark):
    def change(r, i):
        if r["load"] == 4 and i == 0:
            r["n"] *= 5000
        if r["load"] == 5 and i < 2:
            r["day"] -= dt.timedelta(days=21)

    df = _loads(spark, change=change)
    df = df.where("load <> 7 or dayofweek(day) in (2, 3)")
    assert profile.differing_loads(profile.value_counts(df, SPEC), {"t": "at"}).where("column_name in ('n', 'day')").count() == 0


def test_profiles_of_one_load_and_of_nothing(spark):
    df = _loads(spark, 1)
    assert profile.differing_loads(profile.value_counts(df, SPEC), {"t": "at"}).count() == 0
    assert profile.profile(profile.value_counts(df.limit(0), SPEC)).count() == 0
