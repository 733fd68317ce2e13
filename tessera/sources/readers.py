"""Readers and writers: bars, crypto bars, fundamentals, universes, JSON indexes; a registry of sources; a REST source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.panel import between, missing_ranges

BAR = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "vwap")],
    T.StructField("trade_count", T.LongType()), T.StructField("source", T.StringType()), T.StructField("frequency", T.StringType()),
])
FACT = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("field_name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("period_end", T.DateType()),
    T.StructField("published_at", T.TimestampType()), T.StructField("fiscal_quarter", T.StringType()), T.StructField("source", T.StringType()),
])


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None, adjustment: str = "split", source: str = "parquet", frequency: str = "1d") -> DataFrame:
    """Bars written by write_bars: partitions of other symbols are not read, days outside the range are skipped in the scan."""
    bars = spark.read.parquet(path)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(*symbols))
    return between(bars, start, end).withColumns({"adjustment": F.lit(adjustment), "source": F.lit(source), "frequency": F.lit(frequency)})


def read_crypto(spark: SparkSession, path: str, exchange: str, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one exchange, with the quote currency from the symbol (USDT where it names none)."""
    bars = read_bars(spark, f"{path}/exchange={exchange}", symbols, start, end, "none", exchange)
    return bars.withColumns({"exchange": F.lit(exchange), "quote_currency": quote_currency(F.col("symbol"))})


def quote_currency(symbol: Column) -> Column:
    parts = F.split(symbol, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.lit("USDT"))


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder per symbol, sorted by time; only the symbols written are replaced. A hot symbol is spread over several files by month."""
    spread = bars.repartition("symbol", F.date_trunc("month", "timestamp")).sortWithinPartitions("symbol", "timestamp")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def backfill(stored: DataFrame, wanted: DataFrame, start: str, end: str, fetch: Callable[[list[str]], DataFrame], path: str, batch: int = 500) -> int:
    """Fetch and write the symbols whose stored bars do not cover a range, in batches; how many there were."""
    done, todo = 0, missing_ranges(stored, wanted, start, end).select("symbol").toLocalIterator()
    names: list[str] = []
    for row in todo:
        names.append(row[0])
        if len(names) == batch:
            write_bars(fetch(names), path)
            done, names = done + len(names), []
    if names:
        write_bars(fetch(names), path)
    return done + len(names)


def read_facts(facts: DataFrame, symbols: Sequence[str] | DataFrame, fields: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Facts of some symbols (a list, or a table with a column `symbol`) and fields whose period ends in a range, both days included; None does not restrict."""
    out = facts.join(symbols.select("symbol").distinct(), "symbol", "left_semi") if isinstance(symbols, DataFrame) else facts.where(F.col("symbol").isin(*symbols))
    if fields is not None:
        out = out.where(F.col("field_name").isin(*fields))
    if start is not None:
        out = out.where(F.col("period_end") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("period_end") <= F.lit(end).cast("date"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text file, one a line; '#' begins a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("symbol")).where("symbol <> ''").distinct()


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    """symbol and sector of a CSV file with '#' comments."""
    return spark.read.csv(path, header=True, comment="#", schema="symbol string, sector string").select(F.trim("symbol").alias("symbol"), F.trim("sector").alias("sector"))


def write_json(spark: SparkSession, path: str, document: dict, index: str | None = None, entry: dict | None = None, key: str = "id") -> None:
    """A JSON document on any file system, and its line in an index of such documents, replaced if the index has the key.

    Both are written whole to a new name and then renamed, so a reader sees the old or the new one. One writer at a time.
    """
    _replace_text(spark, path, json.dumps(document, indent=2, sort_keys=True))
    if index is not None:
        line = entry or {}
        old = [json.loads(x) for x in (_text(spark, index) or "").splitlines() if x.strip()]
        kept = [x for x in old if x.get(key) != line.get(key)]
        _replace_text(spark, index, "".join(json.dumps(x, sort_keys=True) + "\n" for x in [*kept, line]))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _text(spark: SparkSession, path: str) -> str | None:
    at, fs = _file(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _file(spark, path)
    new, _ = _file(spark, f"{path}.new")
    fs.mkdirs(at.getParent())
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{path} could not be replaced")


def read_index(spark: SparkSession, path: str, key: str, order: str, schema: str | None = None) -> DataFrame:
    """The last line of each key of a JSON-lines index."""
    from tessera.operators.registry import last_version

    rows = spark.read.json(path, schema=schema)
    return last_version(rows, [key], [order, F.to_json(F.struct(*rows.columns))])


def write_table(df: DataFrame, name: str, replace: bool = True, days: int | None = None) -> None:
    """A managed table, replaced or refused if it is there; `days` notes when it may be dropped."""
    df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)
    if days is not None:
        expires = df.sparkSession.range(1).select(F.date_add(F.current_date(), days)).first()[0]
        df.sparkSession.sql(f"alter table {name} set tblproperties ('expires_on' = '{expires}')")


def drop_expired(spark: SparkSession, names: Sequence[str], today: str | None = None) -> list[str]:
    """Drop those of the tables whose `expires_on` (see write_table) has passed; their names."""
    day = today or str(spark.range(1).select(F.current_date()).first()[0])
    gone = []
    for name in names:
        at = {r["key"]: r["value"] for r in spark.sql(f"show tblproperties {name}").collect()}.get("expires_on")
        if at is not None and at < day:
            spark.sql(f"drop table {name}")
            gone.append(name)
    return gone


def synthetic_bars(spark: SparkSession, symbols: Sequence[str], days: int, seed: int = 42, start: str = "2024-01-01", price: float = 100.0, vol: float = 0.02) -> DataFrame:
    """Weekday bars of geometric random walks, one stream of random numbers per symbol, so any subset of symbols gives the same rows."""
    stamps = np.busday_offset(np.datetime64(start), np.arange(days), roll="forward")
    drift = np.linspace(-0.0008, 0.0012, max(1, len(symbols)))
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(symbols)], "i int, symbol string")
    schema = "symbol string, timestamp date, open double, high double, low double, close double, volume double"

    def make(batches):
        import pandas as pd

        for pdf in batches:
            for i, s in zip(pdf["i"], pdf["symbol"], strict=True):
                g = np.random.default_rng([seed, int(i)])
                close = price * np.exp(np.cumsum(drift[i] + vol * g.standard_normal(days)))
                open_ = np.concatenate([[price], close[:-1]])
                up, down = 1 + np.abs(g.standard_normal((2, days))) * vol / 2
                yield pd.DataFrame({
                    "symbol": s, "timestamp": stamps.astype("O"), "open": open_.round(4), "high": (np.maximum(open_, close) * up).round(4),
                    "low": (np.minimum(open_, close) / down).round(4), "close": close.round(4), "volume": g.integers(1_000, 1_000_000, days).astype(float),
                })

    return frame.repartition(min(len(symbols), 64) or 1).mapInPandas(make, schema)


class RateLimiter:
    """At most `calls` in any `seconds`; acquire() waits until one more is allowed."""

    def __init__(self, calls: int = 5, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.times: deque[float] = deque()

    def acquire(self) -> None:
        while True:
            now = self.clock()
            while self.times and now - self.times[0] >= self.seconds:
                self.times.popleft()
            if len(self.times) < self.calls:
                self.times.append(now)
                return
            self.sleep(self.seconds - (now - self.times[0]))


def get_json(url: str, limiter: RateLimiter, tries: int = 5, opener: Callable[[str], bytes] | None = None) -> dict:
    """A JSON answer; 'too many requests' is tried again after the time the answer names, or twice the last wait."""
    fetch = opener or (lambda u: urllib.request.urlopen(u, timeout=30).read())  # noqa: S310
    wait = 1.0
    for attempt in range(tries):
        limiter.acquire()
        try:
            return json.loads(fetch(url))
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == tries - 1:
                raise
            limiter.sleep(float(e.headers.get("Retry-After") or wait))
            wait *= 2
    raise AssertionError("unreachable")


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class _RestReader(DataSourceReader):
    """One partition per symbol; each follows the links from page to page."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [_Symbol(s.strip()) for s in self.options.get("symbols", "").split(",") if s.strip()]

    def read(self, partition: _Symbol) -> Iterator[tuple]:
        limiter = RateLimiter(int(self.options.get("calls", "5")))
        url = self.options["url"].format(symbol=partition.symbol, start=self.options.get("start", ""), end=self.options.get("end", ""))
        while url:
            page = get_json(url, limiter)
            for r in page.get("results", []):
                yield (partition.symbol, int(r["t"]), *[float(r[k]) if r.get(k) is not None else None for k in ("o", "h", "l", "c", "v", "vw")])
            url = page.get("next_url")


class RestBars(DataSource):
    """Bars from a paged REST service: options url (with {symbol}, {start}, {end}), symbols, start, end, calls (a minute)."""

    @classmethod
    def name(cls) -> str:
        return "rest_bars"

    def schema(self) -> str:
        return "symbol string, time_ms bigint, open double, high double, low double, close double, volume double, vwap double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RestReader(dict(self.options))


#: Sources by name: each opens a table of bars.
SOURCES: dict[str, Callable[..., DataFrame]] = {"parquet": read_bars, "local": read_bars, "crypto": read_crypto}


def open_source(name: str, spark: SparkSession, **options) -> DataFrame:
    """Bars from a named source."""
    if name == "rest":
        spark.dataSource.register(RestBars)
        return spark.read.format("rest_bars").options(**options).load()
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; there are {sorted([*SOURCES, 'rest'])}")
    return SOURCES[name](spark, **options)
