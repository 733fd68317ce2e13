"""Research as batches: many expressions in one job, refined level by level; identities of settings; guarded materialisation."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expression
from tessera.operators import evaluate, folds, selection


def settings_id(settings: Mapping) -> str:
    """Sixteen hexadecimal digits that name a set of settings, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def settings_diff(a: Mapping, b: Mapping) -> dict[str, tuple]:
    """The settings in which two sets differ, with both values (None where one has none)."""
    return {k: (a.get(k), b.get(k)) for k in sorted({*a, *b}) if a.get(k) != b.get(k)}


def score(panel: DataFrame, expressions: Mapping[str, str], spans: Sequence[tuple], extra_fields: Sequence[str] = ()) -> DataFrame:
    """Mean rank-IC per factor and fold for all expressions in one job: factor, fold, rank_ic.

    Signals are made once over the whole panel as columns, returns once per fold; only then are the factors laid out long. Folds
    and factors are keys of one aggregation, so the number of jobs does not depend on the number of candidates.
    """
    long = labelled(panel, expressions, spans, extra_fields)
    return evaluate.mean_rank_ic(long, ["factor", "fold"]).select("factor", "fold", "rank_ic")


def labelled(panel: DataFrame, expressions: Mapping[str, str], spans: Sequence[tuple], extra_fields: Sequence[str] = ()) -> DataFrame:
    """factor, fold, symbol, timestamp, signal and fwd, the return made inside the fold."""
    wide = expression.with_factors(panel, expressions, extra_fields=extra_fields).select("symbol", "timestamp", "close", *expressions)
    inside = evaluate.with_forward(folds.assign(wide, spans), ["fold", "symbol"])
    entries = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(k).alias("signal")) for k in expressions])
    return inside.select("fold", "symbol", "timestamp", "fwd", F.explode(entries).alias("e")).select("e.factor", "fold", "symbol", "timestamp", "e.signal", "fwd")


def run_batch(panel: DataFrame, cycles: Sequence[Sequence[str]], spans: Sequence[tuple], rules: selection.Regime = selection.STRICT, extra_fields: Sequence[str] = ()) -> DataFrame:
    """Judge several cycles of expressions in one job: cycle, expression, trials, folds, metrics, gate, decision.

    A cycle's levels are raised for all expressions tried up to and with it, so the family grows as the batch goes on. An expression whose
    canonical form was tried before is known and not tried again (it has the gate 'known').
    """
    rows, texts, seen = [], {}, set()
    for i, cycle in enumerate(cycles):
        fresh = []
        for text in cycle:
            form = expression.canonical(expression.parse(text))
            name = f"x{len(rows) + len(fresh)}"
            fresh.append((name, i, text, form in seen))
            if form not in seen:
                texts[name] = text
            seen.add(form)
        rows += [(*r, len(seen)) for r in fresh]
    asked = panel.sparkSession.createDataFrame(rows, "factor string, cycle int, expression string, repeated boolean, trials int")
    if not texts:
        return selection.judged(asked.withColumn("likeness", F.lit(1.0)), rules).drop("factor", "likeness", "repeated")
    long = labelled(panel, texts, spans, extra_fields)
    metrics = folds.summarise(evaluate.evaluation(long, ["factor", "fold"]), ["factor"])
    both = asked.join(metrics, "factor", "left").withColumn("likeness", F.when(F.col("repeated"), 1.0))
    out = selection.judged(both, rules)
    first = F.when(F.col("repeated"), "known").otherwise(F.col("gate"))
    return out.withColumn("gate", first).select("cycle", "expression", "trials", "folds", "ic", "rank_ic", "quantile_spread", "gate", "decision")


def cycle_reports(judged: DataFrame) -> DataFrame:
    """One row per cycle of a batch: expressions, trials, how many of each decision, those promoted, and counts by gate."""
    counts = judged.groupBy("cycle", "gate").agg(F.count(F.lit(1)).alias("n")).groupBy("cycle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "n")))).alias("by_gate"))
    of = lambda d: F.count_if(F.col("decision") == d).alias(f"n_{d}")
    promoted = F.array_sort(F.collect_list(F.when(F.col("decision") == "promote", F.col("expression")))).alias("promoted")  # bounded by the cycle's expressions
    return judged.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.max("trials").alias("trials"), of("promote"), of("refine"), of("reject"), promoted).join(counts, "cycle")


@dataclass
class Candidate:
    """An expression with where it came from and how it did."""

    text: str
    parent: str | None = None
    change: str = "start"
    depth: int = 0
    mean: float | None = None
    positive_share: float | None = None
    weak: list[str] = field(default_factory=list)


def refine(
    panel: DataFrame, start: Sequence[str], spans: Sequence[tuple], depth: int = 2, per_parent: int = 3, most: int = 24, keep: Callable[[Candidate], bool] = lambda c: (c.mean or 0) > 0,
) -> list[Candidate]:
    """Start with some expressions, then try changes of those that `keep` accepts, level by level; each level is one job.

    Expressions with equal canonical forms are tried once; at most `per_parent` changes of each and `most` in a level are
    (a bound on the search, in order of merit). The result has every candidate tried, in order.
    """
    seen: set[tuple] = set()
    level = [Candidate(t) for t in start]
    tried: list[Candidate] = []
    for at in range(depth + 1):
        fresh = []
        for c in level:
            form = expression.canonical(expression.parse(c.text))
            if form not in seen and len(fresh) < most:
                seen.add(form)
                fresh.append(c)
        if not fresh:
            break
        names = {f"c{i}": c.text for i, c in enumerate(fresh)}
        per = score(panel, names, spans).groupBy("factor").agg(F.avg("rank_ic").alias("mean"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("share"))
        got = {r["factor"]: r for r in per.collect()}  # one row per candidate, at most `most`
        for i, c in enumerate(fresh):
            r = got.get(f"c{i}")
            c.mean, c.positive_share = (r["mean"], r["share"]) if r else (None, None)
            c.weak = [w for w, bad in (("weak_cross_sectional", abs(c.mean or 0) < 0.02), ("sign_inconsistent", 0.3 <= (c.positive_share or 0) <= 0.7)) if bad]
        tried += fresh
        level = [Candidate(t, c.text, n, at + 1) for c in sorted(fresh, key=lambda c: -(c.mean or 0)) if keep(c) for t, n in expression.variations(c.text, c.weak)[:per_parent]]
    return tried


_WRITES = re.compile(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|grant|call|set|use|refresh|cache|load)\b")
_NAME = re.compile(r"^[A-Za-z_][\w]*(\.[A-Za-z_]\w*){0,2}$")


def check_select(text: str, must: Sequence[str] = (), must_not: Sequence[str] = ()) -> str:
    """A text that may be run: one SELECT (or WITH) without writing words, with all of `must` and none of `must_not`; gives its SHA-256."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", text, flags=re.S)
    if not re.match(r"(?is)^\s*(with|select)\b", bare) or ";" in bare.strip().rstrip(";") or _WRITES.search(bare):
        raise ValueError("only a single reading statement may be materialised")
    lacking, banned = [m for m in must if m not in text], [m for m in must_not if m in text]
    if lacking or banned:
        raise ValueError(f"lacking {lacking}, banned {banned}")
    return hashlib.sha256(text.encode()).hexdigest()


def materialise(spark: SparkSession, text: str, table: str, approved: str, args: Mapping | None = None, keys: Sequence[str] = (), replace: bool = False) -> int:
    """Run an approved text (by its SHA-256) with parameters and write it to a table; keys must be unique, else the table is dropped. The rows written."""
    if check_select(text) != approved:
        raise ValueError("this text has not been approved")
    if not _NAME.match(table):
        raise ValueError(f"{table!r} is no table name")
    df = spark.sql(text, args=dict(args or {}))
    df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(table)
    written = spark.table(table)
    n = written.count()
    if keys and written.groupBy(*keys).count().where("count > 1").limit(1).count():
        spark.sql(f"drop table {table}")
        raise ValueError(f"{keys} are not unique")
    return n


def size_estimate(df: DataFrame) -> int:
    """Bytes the optimiser expects a plan to read and make: what a dry run would tell."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
