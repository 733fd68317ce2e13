import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import events, panel, registry, ticks
from tessera.sources import readers
from tessera.streaming import bars as streams

T = dt.datetime(2026, 1, 5, 1, 30)
DAY = T.date()
TICK = "tick_id bigint, stock_code string, scope string, event_type string, time timestamp_ntz, trading_date date, value double, size bigint"


def _ticks(spark, rows):
    return spark.createDataFrame([(i, "A", "target", k, T + dt.timedelta(seconds=s), DAY, v, z) for i, (s, k, v, z) in enumerate(rows)], TICK)


def test_trades_are_signed_by_quote_then_tick(spark):
    rows = [(0, "TRADE", 10.0, 5), (1, "BID", 9.9, 1), (2, "ASK", 10.1, 1), (3, "TRADE", 10.1, 7), (4, "TRADE", 9.9, 3), (5, "TRADE", 10.0, 2), (6, "TRADE", 10.0, None), (7, "BID", 10.3, 1), (8, "TRADE", 10.2, 4), (9, "TRADE", -1.0, 9), (10, "TRADE", None, 9)]
    got = [r["signed_size"] for r in ticks.signed(ticks.quoted(_ticks(spark, rows))).where("trade").orderBy("time").collect()]
    assert got == [0.0, 7.0, -3.0, 2.0, None, 4.0]
    f = ticks.daily_features(_ticks(spark, rows), spark.createDataFrame([("A", DAY), ("B", DAY)], "stock_code string, trading_date date")).orderBy("stock_code").collect()
    assert f[0]["n_trades"] == 6 and f[0]["tick_volume"] == 21 and f[0]["ofi"] == pytest.approx(10 / 21) and f[0]["n_quotes"] == 3 and f[1]["n_trades"] is None
    assert ticks.manifest(_ticks(spark, rows)).first()["nonpositive_value_rows"] == 2
    with pytest.raises(ValueError):
        ticks.load_ticks(_ticks(spark, rows), [])


def test_nearest_events_and_windows(spark):
    days = spark.createDataFrame([("A", DAY + dt.timedelta(days=i)) for i in range(10)] + [("B", DAY)], "stock_code string, date date")
    ev = spark.createDataFrame([("A", "x", DAY + dt.timedelta(days=4)), ("A", "x", DAY + dt.timedelta(days=4)), ("A", "y", DAY + dt.timedelta(days=-1)), ("A", "x", None)], "stock_code string, kind string, day date")
    got = panel.nearest_events(days, ev, ["stock_code"], "date", "day", ["x", "y"], "kind").orderBy("stock_code", "date").collect()
    assert len(got) == 11 and [r["next_x"] for r in got[:6]] == [DAY + dt.timedelta(days=4)] * 5 + [None] and got[4]["prev_x"] == DAY + dt.timedelta(days=4) and got[0]["prev_y"] == DAY + dt.timedelta(days=-1)
    rows = spark.createDataFrame([("A", DAY + dt.timedelta(days=2 * i), float(i)) for i in range(10)], "symbol string, timestamp date, ar double")
    e = spark.createDataFrame([("A", 1, DAY + dt.timedelta(days=7)), ("A", 2, DAY + dt.timedelta(days=60)), ("A", 3, DAY)], "symbol string, event_id int, event_date date")
    w = events.event_window(rows, e, 2, 2)
    assert sorted((r["event_id"], r["tau"], r["ar"]) for r in w.collect()) == [(1, t, 4.0 + t) for t in range(-2, 3)] + [(3, t, float(t)) for t in range(3)]
    assert {r["event_id"] for r in events.event_window(rows, e, 2, 2, whole=True).collect()} == {1}
    assert events.cumulated(w, -1, 1).where("event_id = 1").first()["car"] == 12.0


def test_small_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 0.0), (4.0, None)], "v double, g double")
    t = events.t_statistic(df, "v").first()
    assert t["mean"] == 2.5 and t["t"] == pytest.approx(2.5 / (1.2909944487358056 / 2))
    assert events.safe_correlation(df.withColumn("c", F.lit(1.0)), "v", "c").first()["corr"] is None
    assert {r["side"]: r["n"] for r in events.median_split(df, "v", "v").collect()} == {"low": 2, "high": 2}
    both = events.unmatched_keys(df.select("v"), df.where("v > 1").select("v"), ["v"])
    assert [tuple(r) for r in both.collect()] == [(1.0, "left")]


def test_facts_as_of_a_day(spark):
    d = dt.date
    rows = [("A", "eps", 1.0, d(2025, 3, 31), dt.datetime(2025, 5, 1)), ("A", "eps", 2.0, d(2025, 6, 30), dt.datetime(2025, 8, 1)), ("A", "eps", 3.0, d(2025, 6, 30), dt.datetime(2025, 8, 15)), ("A", "eps", 9.0, d(2025, 9, 30), dt.datetime(2025, 11, 1))]
    f = spark.createDataFrame(rows, "symbol string, field_name string, value double, period_end date, published_at timestamp_ntz")
    assert panel.as_of(f, "2025-08-20").first()["value"] == 2.0 and panel.as_of(f, "2025-07-01").first()["value"] == 1.0 and panel.as_of(f, "2025-01-01").count() == 0
    assert readers.read_facts(f, ["A"], ["eps"], "2025-06-30", "2025-09-29").count() == 2


def test_records(spark):
    df = spark.createDataFrame([(1, None, 1, "a"), (2, 1, 2, "b"), (3, 2, 3, "c"), (4, 99, 4, "d"), (5, 6, 5, "e"), (6, 5, 6, "f")], "id int, parent_id int, at int, name string")
    tree = {r["id"]: (r["root"], r["depth"]) for r in registry.lineage(df).collect()}
    assert tree == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0)}
    new = spark.createDataFrame([(3, 2, 9, "C"), (7, 1, 9, "g")], df.schema)
    up = {r["id"]: r["name"] for r in registry.upsert(df, new, ["id"]).collect()}
    assert up[3] == "C" and up[7] == "g" and len(up) == 7
    assert registry.last_version(df.unionAll(new), ["id"], ["at"]).where("id = 3").first()["name"] == "C"
    a, b = registry.fingerprint(df).first(), registry.fingerprint(df.select("name", "at", "parent_id", "id").orderBy(F.desc("id"))).first()
    assert a == b and registry.fingerprint(df.where("id > 1")).first() != a and registry.fingerprint(df.unionAll(df)).first() != a
    assert registry.search(df, name="b", id=2).count() == 1 and registry.new_rows(df, new, "id").count() == 1
    r = registry.related(df.withColumn("tags", F.array("name")), F.lit(0.5), F.col("tags"), ["a"], F.col("at"), 2.0, 2, ["id"]).collect()
    assert r[0]["id"] == 1 and r[0]["score"] == pytest.approx(0.3 + 0.3 + 0.1 * 0.5**0.5, abs=1e-6)


def test_lineage_has_no_greatest_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    tree = [(1000 + i, 1000 + (i - 1) // 2 if i else 5000) for i in range(60)]  # its root's parent is not there
    cycle = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(2100, 2003), (2101, 2100), (2200, 2200)]
    df = spark.createDataFrame([*cycle, *chain, *tree], "id int, parent_id int")
    got = {r["id"]: (r["root"], r["depth"]) for r in registry.lineage(df).collect()}
    assert got == {i: (0, i) for i in range(300)} | {1000 + i: (1000, (i + 1).bit_length() - 1) for i in range(60)}
    assert registry.lineage(df.where("id < 0")).count() == 0 and registry.lineage(df.where("id between 2000 and 2999")).count() == 0
    twice = spark.createDataFrame([(1, None), (2, None), (3, 1), (3, 2), (4, 3)], df.schema)
    assert sorted(map(tuple, registry.lineage(twice).collect())) == [(1, 1, 0), (2, 2, 0), (3, 1, 1), (3, 2, 1), (4, 1, 2), (4, 2, 2)]
    with pytest.raises(ValueError):
        registry.lineage(spark.createDataFrame([(1, None), (2, 1), (2, 3), (3, 2)], df.schema))


def test_readers_and_writers(spark, tmp_path):
    bars = readers.synthetic_bars(spark, ["A", "B/EUR", "C"], 30)
    assert bars.count() == 90 and bars.where("high < low").count() == 0
    again = readers.synthetic_bars(spark, ["A"], 30)
    assert again.exceptAll(bars).count() == 0
    out = str(tmp_path / "bars")
    readers.write_bars(bars, out)
    readers.write_bars(bars.where("symbol = 'A'").limit(5), out)
    got = readers.read_bars(spark, out, ["A", "B/EUR", "Z"], "2024-01-01", "2024-01-10")
    assert {r["symbol"]: r["count"] for r in got.groupBy("symbol").count().collect()}["A"] <= 5
    wanted = spark.createDataFrame([("A",), ("C",), ("Z",)], "symbol string")
    assert {r[0] for r in panel.missing_ranges(readers.read_bars(spark, out), wanted, "2024-01-03", "2024-02-09").collect()} == {"A", "Z"}
    crypto = str(tmp_path / "crypto")
    readers.write_bars(bars, crypto + "/exchange=e1")
    assert {r[0] for r in readers.read_crypto(spark, crypto, "e1").select("quote_currency").distinct().collect()} == {"EUR", "USDT"}
    names = tmp_path / "universe.txt"
    names.write_text("# all\nA  # first\n\nC\n")
    assert {r[0] for r in readers.read_universe(spark, str(names)).collect()} == {"A", "C"}
    (tmp_path / "s.csv").write_text("symbol,sector\n# note\nA, Tech\n")
    assert readers.read_sectors(spark, str(tmp_path / "s.csv")).first()["sector"] == "Tech"
    for i in range(2):
        readers.write_json(spark, str(tmp_path / "d" / "x.json"), {"v": i}, str(tmp_path / "d" / "index.jsonl"), {"key": "x", "at": i}, key="key")
    assert readers.read_index(spark, str(tmp_path / "d" / "index.jsonl"), "key", "at").first()["at"] == 1
    readers.write_json(spark, str(tmp_path / "d" / "y.json"), {"v": 5}, str(tmp_path / "d" / "index.jsonl"), {"key": "y", "at": 0}, key="key")
    assert [x.split('"key": ')[1][:3] for x in (tmp_path / "d" / "index.jsonl").read_text().splitlines()] == ['"x"', '"y"'] and '"v": 1' in (tmp_path / "d" / "x.json").read_text()
    done = []
    n = readers.backfill(readers.read_bars(spark, out), wanted, "2024-01-03", "2024-02-09", lambda s: done.append(s) or bars.where(F.col("symbol").isin(*s)), out)
    assert n == 2 and sorted(sum(done, [])) == ["A", "Z"]
    with pytest.raises(ValueError):
        readers.open_source("none", spark)


def test_rate_limits_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = readers.RateLimiter(2, 60, lambda: now[0], sleep)
    for _ in range(3):
        limiter.acquire()
    assert slept == [60.0]
    import urllib.error

    answers = [urllib.error.HTTPError("u", 429, "", {"Retry-After": "3"}, None), b'{"ok": 1}']

    def opener(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert readers.get_json("u", limiter, opener=opener) == {"ok": 1} and 3.0 in slept


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(i * 7, "TRADE", 10.0 + i % 5, 100) for i in range(200)]
    df = _ticks(spark, rows)
    src = str(tmp_path / "src")
    df.where("tick_id < 120").coalesce(1).write.parquet(src)
    stream = streams.minute_bars(streams.tick_stream(spark, src), "1 minute")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.run_to_end(stream, out, state)
    df.where("tick_id >= 120").coalesce(1).write.mode("append").parquet(src)
    streams.run_to_end(streams.minute_bars(streams.tick_stream(spark, src), "1 minute"), out, state)
    got = {r["minute"].isoformat(): (r["open"], r["close"], r["trades"]) for r in spark.read.parquet(out).withColumn("minute", F.col("minute").cast("timestamp_ntz")).collect()}
    want = {r["minute"].isoformat(): (r["open"], r["close"], r["trades"]) for r in ticks.minute_bars(df).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 3
    counts = str(tmp_path / "counts")
    streams.keep_daily_counts(streams.tick_stream(spark, src), counts, str(tmp_path / "s2"))
    assert streams.daily_counts(spark, counts).first()["n"] == 200
    twice = _ticks(spark, [rows[0], rows[0], rows[1]])
    again = str(tmp_path / "again")
    twice.coalesce(1).write.parquet(again)
    streams.run_to_end(streams.without_redelivered(streams.tick_stream(spark, again)), str(tmp_path / "o3"), str(tmp_path / "s3"))
    assert spark.read.parquet(str(tmp_path / "o3")).count() == 2
