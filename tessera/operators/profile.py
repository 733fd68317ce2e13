"""Column profiles from maintained value counts.

A store keeps, for every column of a table, how often each value occurs in each load, as signed deltas. Bringing a table
up to date counts only the loads that are new (sign 1), takes back those that are gone from what is stored (sign -1) and
replaces those that have changed (both). Every metric is derived from these counts alone, exactly: null rate, distinct
values, range, entropy, violations, and how far a load's values lie from those of all other loads together (whose
counts are the column's total less the load's own).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut

KEYS = ["table_name", "column_name", "load_id"]


@dataclass(frozen=True)
class Profiled:
    """How a table is profiled: the column that names the load, the time of a load, columns that may not be negative, the columns (all, if none are named)."""

    name: str
    load: str
    loaded_at: str
    not_negative: Sequence[str] = ()
    columns: Sequence[str] = field(default_factory=tuple)

    def taken(self, df: DataFrame) -> list[T.StructField]:
        """The columns to profile, without the one that names the load."""
        return [f for f in df.schema.fields if f.name != self.load and (f.name in self.columns or not self.columns)]


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "number" if isinstance(t, T.NumericType) else "text"


def _as_number(c: Column, t: T.DataType) -> Column:
    """Numbers as they are, days since 1970 for dates, seconds for timestamps, NULL for texts."""
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return c.cast("double") if isinstance(t, T.NumericType) else F.lit(None).cast("double")


def value_counts(df: DataFrame, spec: Profiled) -> DataFrame:
    """Counts of one table's values by load: KEYS, kind, value (text), number, rule, n.

    `number` is the value on a line (see _as_number); `rule` says whether the column may not be negative. The
    unpivoted rows are combined on the map side, so what is shuffled is the distinct values of each load.
    """
    columns = spec.taken(df)
    entries = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(_kind(f.dataType)).alias("kind"), F.lit(f.name in spec.not_negative).alias("rule"),
            F.col(f"`{f.name}`").cast("string").alias("value"), _as_number(F.col(f"`{f.name}`"), f.dataType).alias("number"),
        )
        for f in columns
    ])
    long = df.select(F.col(spec.load).cast("bigint").alias("load_id"), F.explode(entries).alias("e_"))
    return long.select(F.lit(spec.name).alias("table_name"), "load_id", "e_.*").groupBy(*KEYS, "kind", "rule", "value", "number").agg(F.count(F.lit(1)).alias("n"))


COUNTS = "table_name string, column_name string, load_id bigint, kind string, rule boolean, value string, number double, n bigint"
LOG = "table_name string, load_id bigint, mark string, sign int"
#: Loads up to which a delta names them in a filter that reaches the scan; more are joined.
NAMED_LOADS = 1000


class ValueCounts:
    """The persistent counts in a folder that all executors share.

    Every delta is a folder of its own that is written once and never changed, so a reader that has been declared stays
    valid. A delta is counts and, written after them, a log of the loads they add or take back; without its log it does
    not count, so a delta that broke off is as if it had not been. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, most_deltas: int = 32):
        self.spark, self.path, self.most_deltas = spark, path.rstrip("/"), most_deltas

    def _folders(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _base(self) -> str:
        """The latest complete generation: compaction begins a new one."""
        whole = [g for g in self._folders(self.path) if g.startswith("gen-") and self.deltas(g)]
        return whole[-1] if whole else "gen-000000"

    def deltas(self, base: str) -> list[str]:
        """The complete deltas of a generation, in order."""
        return [d for d in self._folders(f"{self.path}/{base}") if self._exists(f"{self.path}/{base}/{d}/log/_SUCCESS")]

    def _read(self, what: str, schema: str) -> DataFrame:
        base = self._base()
        paths = [f"{self.path}/{base}/{d}/{what}" for d in self.deltas(base)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, base: str, counts: DataFrame, log: DataFrame) -> None:
        to = f"{self.path}/{base}/delta-{len(self._folders(f'{self.path}/{base}')):06d}-{uuid.uuid4().hex[:8]}"
        counts.sortWithinPartitions("table_name", "column_name").write.parquet(f"{to}/counts")
        log.coalesce(1).write.parquet(f"{to}/log")

    def loads(self) -> DataFrame:
        """The loads that are in the counts: table_name, load_id, mark (what their rows were)."""
        return self._read("log", LOG).groupBy("table_name", "load_id", "mark").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def counts(self) -> DataFrame:
        """What all deltas come to; values whose count is 0 are gone. Nothing stored gives no rows."""
        return self._read("counts", COUNTS).groupBy(*KEYS, "kind", "rule", "value", "number").agg(F.sum("n").alias("n")).where("n <> 0")

    def refresh(self, df: DataFrame, spec: Profiled) -> dict[str, int]:
        """Bring one table up to date; how many loads were added and taken back (a changed one is both).

        Loads are compared by their number of rows and the sum of their rows' hashes, combined on the map side. Only new
        and changed loads are counted. A NULL load is a load like any other.
        """
        taken = [f.name for f in spec.taken(df)]
        rows = df.select(F.col(spec.load).cast("bigint").alias("load_id"), *[F.col(f"`{c}`") for c in taken])
        mark = F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in taken]).cast("decimal(38,0)")))
        now = cut(rows.groupBy("load_id").agg(mark.alias("mark")))
        had = cut(self.loads().where(F.col("table_name") == spec.name).select(F.col("load_id").alias("l_"), F.col("mark").alias("m_")))
        same = now["load_id"].eqNullSafe(had["l_"]) & (now["mark"] == had["m_"])
        new, gone = cut(now.join(had, same, "left_anti")), cut(had.join(now, same, "left_anti"))
        added, taken_back = new.count(), gone.count()
        if not added and not taken_back:
            return {"added": 0, "taken back": 0}
        parts = []
        if added:
            parts.append(value_counts(_of_loads(df, F.col(spec.load).cast("bigint"), new.select("load_id"), added), spec))
        if taken_back:
            stored = self.counts().where(F.col("table_name") == spec.name)
            parts.append(_of_loads(stored, F.col("load_id"), gone.select("l_"), taken_back).withColumn("n", -F.col("n")))
        counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        entry = lambda d, sign: d.toDF("load_id", "mark").select(F.lit(spec.name).alias("table_name"), "load_id", "mark", F.lit(sign).alias("sign"))
        base = self._base()
        self._write(base, counts, entry(new, 1).unionAll(entry(gone, -1)))
        if len(self.deltas(base)) > self.most_deltas:
            self.compact()
        return {"added": added, "taken back": taken_back}

    def compact(self) -> None:
        """Begin a new generation with all deltas as one. The old one stays for its readers until the next compaction."""
        base = self._base()
        following = f"gen-{int(base[4:]) + 1:06d}"
        self._write(following, self.counts(), self.loads().withColumn("sign", F.lit(1)))
        for old in self._folders(self.path):
            if old < base:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _of_loads(df: DataFrame, load: Column, loads: DataFrame, n: int) -> DataFrame:
    """Rows of some loads: named in a filter, so that the scan can leave out the others, or joined if they are many."""
    if n <= NAMED_LOADS:
        names = [r[0] for r in loads.collect()]
        some = load.isin([x for x in names if x is not None])
        return df.where(some | load.isNull() if None in names else some)
    one = loads.toDF("only_")
    return df.join(one, load.eqNullSafe(one["only_"]), "left_semi")


def profile(counts: DataFrame) -> DataFrame:
    """Exact metrics per table, column and load from value counts.

    rows, nulls, null_rate, distinct_values, value_min and value_max (as numbers, NULL for texts), negatives (only
    where the column may not be negative), entropy (bits, NULLs left out; NULL if there are only NULLs).
    NaN counts as a value but not in the range. No counts give no rows.
    """
    n = F.col("n")
    given = F.col("value").isNotNull()
    ranged = F.when(~F.isnan("number"), F.col("number"))
    m = F.sum(F.when(given, n).otherwise(0))
    entropy = F.log2(m) - F.sum(F.when(given, n * F.log2(n.cast("double")))) / m
    return counts.groupBy(*KEYS).agg(
        F.sum("n").alias("rows"), F.sum(F.when(given, 0).otherwise(n)).alias("nulls"), F.count("value").alias("distinct_values"),
        F.min(ranged).alias("value_min"), F.max(ranged).alias("value_max"),
        F.sum(F.when(F.col("rule") & (F.col("number") < 0), n).otherwise(0)).alias("negatives"),
        F.when(m > 0, F.round(F.greatest(entropy, F.lit(0.0)), 6)).alias("entropy"),
    ).withColumn("null_rate", F.round(F.col("nulls") / F.col("rows"), 6))


@dataclass(frozen=True)
class DriftRules:
    """When a load differs clearly; shares are of the load's rows, so one entity's surge does not reach them.

    share: excess of NULLs, violations or values in bins the other loads hardly have (less than `rare` of theirs: all of them;
    else what lies above `times` their share, so that other loads with the same fault do not make it usual).
    z: the same in binomial standard deviations. ks and ks_z: greatest gap between the cumulative distributions,
    and that gap times the root of the rows. top: excess share of the commonest value over twice the usual one. crowd: for
    dates, how many times the rows of the commonest date that loads of the days near by have (a short week has fewer dates, not fuller ones).
    """

    share: float = 0.12
    rare: float = 0.002
    times: float = 8.0
    z: float = 5.0
    ks: float = 0.25
    ks_z: float = 2.6
    top: float = 0.15
    crowd: float = 1.5
    least_rows: int = 8


def _bins(counts: DataFrame, loads: Mapping[str, str]) -> DataFrame:
    """Value counts with a bin on a line: half octaves for numbers, days before the load for dates, the form for texts."""
    anchor = None
    for name, column in loads.items():
        part = counts.where((F.col("table_name") == name) & (F.col("column_name") == column)).groupBy("table_name", "load_id").agg(F.min(F.floor(F.col("number") / 86400)).alias("day_"))
        anchor = part if anchor is None else anchor.unionAll(part)
    joined = counts.join(anchor, ["table_name", "load_id"], "left")
    x = F.col("number")
    half_octave = F.signum(x) * F.floor(2 * F.log2(F.abs(x) + 1))
    ago = F.col("day_") - F.when(F.col("value").contains(":"), F.floor(x / 86400)).otherwise(x)
    days = F.when(F.abs(ago) <= 35, ago).otherwise(F.signum(ago) * F.floor(35 + F.log2(F.abs(ago) / 35) * 2))
    form = F.xxhash64(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), "\\p{L}+", "A")).cast("double")
    bin_ = F.when(F.col("kind") == "number", F.when(F.isnan(x), F.lit(float("inf"))).otherwise(half_octave)).when(F.col("kind") == "time", days).otherwise(form)
    return joined.withColumn("bin", F.when(F.col("value").isNotNull(), bin_))


def drift(counts: DataFrame, loads: Mapping[str, str]) -> DataFrame:
    """How each load's column differs from the same column in the other loads as a whole.

    loads: the column of each table that holds the time of a load. Gives KEYS, kind, rows, and for the load (p) and the others
    (q): null and violation rates; the shares of each bin, ks (greatest cumulative gap), top_share and top_rows of the
    commonest value, with the usual ones of the other loads (rows: of the four days of loads before and after). A column's bins are
    few (half octaves, days, forms), so the tables here are bins times loads.
    """
    binned = _bins(counts, loads)
    n = F.col("n")
    per = binned.groupBy(*KEYS, "kind").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("rule") & (F.col("number") < 0), n).otherwise(0)).alias("bad"),
        F.max(F.when(F.col("value").isNotNull(), n)).alias("top_rows"), F.count("value").alias("distinct_values"),
        F.min("day_").alias("day_"),
    )
    column = Window.partitionBy("table_name", "column_name")
    # loads of one day share a place, as ids say nothing about time; loads without a day have places of their own
    per = per.withColumn("place", F.dense_rank().over(column.orderBy("day_", F.when(F.col("day_").isNull(), F.col("load_id")))))
    beside = column.orderBy("place").rangeBetween(-4, 4)
    per = per.withColumns({f"all_{c}": F.sum(c).over(column) for c in ("rows", "nulls", "bad")})
    per = per.withColumn("top_share", F.col("top_rows") / (F.col("rows") - F.col("nulls")))
    per = per.withColumns({"usual_top_share": F.expr("percentile(top_share, 0.5)").over(column), "usual_top_rows": F.expr("percentile(top_rows, 0.5)").over(beside)})
    own = binned.where("bin is not null").groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))
    pooled = own.groupBy("table_name", "column_name", "bin").agg(F.sum("n").alias("all_n"))
    grid = per.select(*KEYS, (F.col("rows") - F.col("nulls")).alias("m"), (F.col("all_rows") - F.col("all_nulls")).alias("all_m")).join(pooled, ["table_name", "column_name"])
    grid = grid.join(own, [*KEYS, "bin"], "left").na.fill(0, ["n"])
    p, q = F.try_divide(n, F.col("m")), F.try_divide(F.col("all_n") - n, F.col("all_m") - F.col("m"))
    run = Window.partitionBy(*KEYS).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({"p": p, "q": q}).withColumn("gap", F.abs(F.sum("p").over(run) - F.sum("q").over(run)))
    far = grid.groupBy(*KEYS).agg(F.max("gap").alias("ks"), F.collect_list(F.struct("p", "q")).alias("pq"))
    return per.join(far, KEYS, "left")


def differing_loads(counts: DataFrame, loads: Mapping[str, str], rules: DriftRules = DriftRules()) -> DataFrame:
    """Loads in which a column clearly differs from the other loads: KEYS and the reasons, see DriftRules.

    Loads with fewer rows than `least_rows` are not judged; a table with one load has none that differs.
    """
    d = drift(counts, loads)
    rate = lambda c: F.try_divide(F.col(c), F.col("rows"))
    rest = lambda c: F.try_divide(F.col(f"all_{c}") - F.col(c), F.col("all_rows") - F.col("rows"))

    def excess(c: str) -> Column:
        gap, q = rate(c) - rest(c), F.greatest(rest(c), F.lit(0.002))
        return F.coalesce((gap > rules.share) & (gap > rules.z * F.sqrt(q * (1 - q) / F.col("rows"))), F.lit(False))

    m = F.col("rows") - F.col("nulls")
    beyond = lambda x: F.when(x["q"] < rules.rare, x["p"]).otherwise(F.greatest(x["p"] - rules.times * x["q"], F.lit(0.0)))
    novelty = F.aggregate("pq", F.lit(0.0), lambda a, x: a + F.coalesce(beyond(x), F.lit(0.0)))
    number, time = F.col("kind") == "number", F.col("kind") == "time"
    reasons = {
        "nulls": excess("nulls"),
        "violations": excess("bad"),
        "novel values": (novelty > rules.share) & (novelty * F.sqrt(m) > 1.0),
        "distribution": number & (F.col("ks") > rules.ks) & (F.col("ks") * F.sqrt(m) > rules.ks_z),
        "one value": number & (F.col("top_share") > rules.top + 2 * F.col("usual_top_share")) & (F.col("top_rows") >= 5),
        "one date": time & (F.col("top_share") > 0.8) & (F.col("top_rows") > rules.crowd * F.col("usual_top_rows")),
    }
    said = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]), lambda x: x.isNotNull())
    judged = d.withColumn("novelty", novelty).withColumn("reasons", F.when(F.col("rows") >= rules.least_rows, said).otherwise(F.array().cast("array<string>")))
    return judged.where((F.size("reasons") > 0) & (F.col("all_rows") > F.col("rows"))).select(*KEYS, "reasons")
