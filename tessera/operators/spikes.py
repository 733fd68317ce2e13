"""Implausible readings per source: limits, stuck runs, and spikes against a robust autoregression.

What is normal for a source is taken from its nearest readings, so a verdict depends on a bounded stretch of the source
around the reading. Rows alike in source, channel, time, value and size are one reading that was delivered again: they are
combined first, on the map side, judged once, and the verdict holds for all of them. The readings of a source are then
cut, at times, into windows of about `window` readings that know at least `context` readings on either side, whatever
days these lie on; a source with a third of all rows is many windows, a sparse one a part of one. A window is worked
on as arrays in one Arrow call, without a Python loop over readings. Where the cuts fall changes no verdict, unless more than
`context` readings in a row give no evidence (one stuck run, or values that are missing).

1. *Limits*: a value that is not above 0, or a negative size, is impossible.
2. *Stuck runs*: the same reading repeated by one channel of one block (a trading day) far more often than chance gives. The
   chance of a repeat is that among the channel's nearest readings on either side, and a run counts when the expected number
   of such runs among them is below `run_chance`.
3. *Spikes*: a robust autoregression on the logarithm with iterative tests for additive outliers and level shifts. The levels
   before and after a reading are medians of the nearest clean readings; the deviation from the level follows a
   first-order autoregression whose coefficient and scale come from the readings around, with bounded (Huber) weights.
   AO statistic: the distance from the nearer level, less what the autoregression expects; beyond the limit the reading is an
   outlier and is replaced by its level. When no more are found, LS statistic: the distance between the levels after and
   before; where it is beyond the limit and both readings agree with their side, the level has shifted, which is no
   case: the shift is taken out of the series, so that it hides no outlier. Both are repeated until nothing changes.
   Stretches too long for these levels that jump off the level and return to it are bursts (see returning_bursts).
4. *Sizes*: a size far above what the channel shows around, against the spread of its logarithms there, and larger than
   hundreds of readings there together, so that an ordinary block trade is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut
from tessera.skew import heavy_groups, may_match

LIMIT, STUCK, SPIKE, SIZE = 1, 2, 4, 8
#: Widths of time slots (microseconds: a day, an hour, a minute, a second); only crowded slots are cut finer.
SLOTS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000)


@dataclass(frozen=True)
class SpikeRules:
    """Thresholds, all relative to what the source shows around a reading.

    half: clean readings on either side that make a level; near: the same close to another outlier. around: readings on either
    side from which scales and chances are taken. cut: robust standard deviations of the autoregression for an outlier.
    move_cut: the same in usual moves (the quantile `usual` of the moves that are not 0, so of the source's own spread and price step).
    few, unknown: with fewer moves than `few` around, a source has no usual one, and the limit is `unknown` (in logarithms).
    longest: readings in the longest burst. run_chance: expected number of equally long runs by chance, below which a run is
    stuck; min_run: least length. size_cut: robust standard deviations of the logarithm of sizes; size_sum: how many readings around
    (of log-normal sizes with the level and spread found there) a single one must outweigh. rounds: of the iteration, at most.
    window, context: readings of a window and around it; neither changes a verdict (see above).
    """

    half: int = 8
    near: int = 3
    around: int = 128
    cut: float = 9.0
    move_cut: float = 8.0
    usual: float = 0.5
    few: int = 8
    unknown: float = 0.05
    longest: int = 512
    run_chance: float = 1e-4
    min_run: int = 8
    size_cut: float = 6.0
    size_sum: int = 512
    rounds: int = 24
    window: int = 16_384
    context: int = 4096


def _side_median(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the k readings (no NaN) before and after each position, of fewer near the ends; NaN where a side has none."""
    n = len(x)
    pad = np.full(k, np.inf)
    ordered = np.sort(sliding_window_view(np.concatenate([pad, x, pad]), k), axis=1)  # window i holds x[i - k : i]
    held = np.minimum(np.minimum(np.arange(n + k + 1), k), n + k - np.arange(n + k + 1))
    at = np.arange(n + k + 1)
    medians = 0.5 * (ordered[at, np.maximum(held - 1, 0) // 2] + ordered[at, np.minimum(held // 2, k - 1)])
    medians[held == 0] = np.nan
    return medians[:n], medians[k + 1 :]


def _around(x: np.ndarray, reach: int) -> np.ndarray:
    """The median of the values (no NaN) among each position and the `reach` positions on either side; NaN where there is none."""
    return pd.Series(x).rolling(2 * reach + 1, center=True, min_periods=1).median().to_numpy()


def robust_ar1(x: np.ndarray, reach: int, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Coefficient and scale, at each position, of x[t] = phi * x[t-1] + e among the readings around, with Huber weights on both sides."""
    past = np.concatenate([[0.0], x[:-1]])
    wide = 1.4826 * _around(np.abs(x), reach) + 1e-12
    w_past = np.minimum(1.0, 2.0 * wide / np.maximum(np.abs(past), 1e-12))
    mean = lambda v: pd.Series(v).rolling(2 * reach + 1, center=True, min_periods=1).mean().to_numpy()
    phi, scale = np.zeros(len(x)), wide
    for _ in range(steps):
        w = w_past * np.minimum(1.0, 1.5 * scale / np.maximum(np.abs(x - phi * past), 1e-12))
        phi = np.clip(mean(w * past * x) / (np.maximum(mean(w * past * past), 0.0) + 1e-24), -0.95, 0.95)
        scale = 1.4826 * _around(np.abs(x - phi * past), reach) + 1e-12
    return phi, scale


def additive_outliers(y: np.ndarray, rules: SpikeRules, least: np.ndarray | float = 0.0, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a series (in order, no NaN) that are additive outliers, and those at which its level shifts.

    block: of each reading; bursts begin and end in one. `least` is a distance below which nothing is told apart, for each reading. A series of fewer than 3 readings has neither.
    """
    n = len(y)
    out, shifts, burst = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    if n < 3:
        return out, shifts
    move = np.abs(np.diff(y, prepend=y[0]))
    move[move < 1e-9] = np.nan
    usual = pd.Series(move).rolling(2 * rules.around + 1, center=True, min_periods=1).quantile(rules.usual).to_numpy()
    moves = pd.Series(move).rolling(2 * rules.around + 1, center=True, min_periods=1).count().to_numpy()
    floor = np.maximum(np.where(moves < rules.few, rules.unknown, rules.move_cut * np.nan_to_num(usual)), least)
    z, clean = y.astype(float), y.astype(float)  # the series less the shifts found, and also with outliers replaced
    seen: set[int] = set()
    circle = False
    for turn in range(rules.rounds):
        left, right = _side_median(clean, rules.half)
        left, right = np.where(np.isnan(left), right, left), np.where(np.isnan(right), left, right)
        to_left, to_right = np.abs(z - left), np.abs(z - right)
        near = np.where(to_left <= to_right, left, right)
        x = clean - near
        if turn < 2:  # medians: once the worst outliers are replaced, the others do not move them
            phi, scale = robust_ar1(x, rules.around)
            limit = np.maximum(rules.cut * scale, floor)
        before, after = (np.clip(v, -3 * scale, 3 * scale) for v in (np.concatenate([[0.0], x[:-1]]), np.concatenate([x[1:], [0.0]])))
        far = (np.abs(z - left - phi * before) > limit) & (np.abs(z - right - phi * after) > limit)
        # The same with the nearest few readings only, for outliers close to others. Medians of few readings are noisier.
        l3, r3 = _side_median(clean, rules.near)
        l3, r3 = np.where(np.isnan(l3), r3, l3), np.where(np.isnan(r3), l3, r3)
        wide = limit * np.sqrt(rules.half / rules.near)
        far |= (np.abs(z - l3) > wide) & (np.abs(z - r3) > wide)
        far |= burst
        state = hash(np.packbits(far).tobytes())
        circle |= state in seen and not np.array_equal(far, out)
        seen.add(state)
        if circle:  # from here on outliers are only added, so the rounds end
            far |= out
        if not np.array_equal(far, out):
            out = far
            clean = np.where(out, 0.5 * (left + right), z)
            continue
        new = _level_shifts(z, out, limit, rules) & ~shifts
        if new.any():
            shifts |= new
            z = y - _offsets(y, out, shifts, rules)
            clean = np.where(out, 0.5 * (left + right), z)
            left, right = _side_median(clean, rules.half)
            clean = np.where(out, np.where(np.isnan(left), right, left), z)
            seen.clear()
            continue
        more = returning_bursts(y, out, limit, rules, block) & ~out
        if not more.any():
            break
        # A burst is no pair of shifts.
        burst |= more
        out |= more
        shifts &= ~(more | np.concatenate([[False], more[:-1]]))
        z = y - _offsets(y, out, shifts, rules)
        clean = np.where(out, _filled(z, out), z)
        seen.clear()
    return out, shifts


def _filled(z: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Each reading's last clean value, or the next one at the start."""
    at = np.where(out, -1, np.arange(len(z)))
    back = np.maximum.accumulate(at)
    first = int(np.argmin(out)) if not out.all() else 0
    return z[np.where(back < 0, first, back)]


def _level_shifts(z: np.ndarray, out: np.ndarray, limit: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """Clean readings at which the level shifts: the medians from there on and before differ beyond the limit, and both readings agree with their side."""
    found = np.zeros(len(z), bool)
    at = np.flatnonzero(~out)
    if len(at) < 2 * rules.near:
        return found
    x, bound = z[at], limit[at]
    left, right = _side_median(x, rules.half)
    after = np.concatenate([right[:-1], [np.nan]])  # after the reading before: from this reading on
    jump = np.zeros(len(x))
    jump[1:] = np.abs(after[:-1] - left[1:])
    ok = np.zeros(len(x), bool)
    with np.errstate(invalid="ignore"):
        ok[1:] = (jump[1:] > bound[1:]) & (np.abs(x[1:] - after[:-1]) < 0.5 * jump[1:]) & (np.abs(x[:-1] - left[1:]) < 0.5 * jump[1:])
    ok[: rules.near] = False
    ok[len(x) - rules.near + 1 :] = False
    # Of several in a row the one with the greatest statistic.
    jump = np.where(ok, jump, 0.0)
    peak = ok & (jump >= np.concatenate([[0.0], jump[:-1]])) & (jump >= np.concatenate([jump[1:], [0.0]]))
    found[at[peak & ~np.concatenate([[False], peak[:-1]])]] = True
    return found


def _offsets(y: np.ndarray, out: np.ndarray, shifts: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """How far the shifts up to each reading have moved the level."""
    jump = np.zeros(len(y))
    at = np.flatnonzero(~out)
    left, right = _side_median(y[at], rules.half)
    level = np.zeros(len(y))
    level[at[1:]] = np.nan_to_num(right[:-1] - left[1:])
    jump[shifts] = level[shifts]
    return np.cumsum(jump)


def returning_bursts(y: np.ndarray, out: np.ndarray, limit: np.ndarray, rules: SpikeRules, block: np.ndarray | None = None) -> np.ndarray:
    """Readings, besides the outliers `out`, in stretches that jump off the level and jump back to it within a block.

    The levels around a stretch are medians of as many clean readings on either side as it has itself (at least `half`); it may
    have `longest` readings and must be shorter than what surrounds it; it returns if the levels differ by a tenth of its height at most. Stretches that end on another level are
    shifts. Where two stretches overlap, the shorter is taken, and the other is judged in the next round.
    """
    found = np.zeros(len(y), bool)
    at = np.flatnonzero(~out)
    x, bound = y[at], limit[at]
    n = len(x)
    move = np.diff(x)
    jumps = np.flatnonzero(np.abs(move) > np.maximum(bound[1:], bound[:-1])) + 1
    pairs = [(a, b) for a, b in zip(jumps[:-1], jumps[1:], strict=True) if move[a - 1] * move[b - 1] < 0 and b - a <= rules.longest and (block is None or block[at[a - 1]] == block[at[b]])]
    for a, b in sorted(pairs, key=lambda p: (p[1] - p[0], p[0])):
        length, width = b - a, max(rules.half, b - a)
        if min(a, n - b) < rules.near or min(a, width) + min(n - b, width) <= length or found[at[max(a - 1, 0) : b + 1]].any():
            continue
        before, after = np.median(x[max(0, a - width) : a]), np.median(x[b : b + width])
        up = np.sign(move[a - 1])
        if abs(after - before) <= max(bound[a], 0.1 * abs(np.median(x[a:b]) - before)) and (up * (x[a:b] - before) > bound[a:b]).all() and (up * (x[a:b] - after) > bound[a:b]).all():
            found[at[a:b]] = True
    return found


def stuck_runs(kind: np.ndarray, block: np.ndarray, value: np.ndarray, size: np.ndarray, time: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """Members of runs in which one channel (a kind within a block) repeats a reading too often. Rows are sorted by kind, then time.

    NaN readings neither end a run nor belong to it; a row that repeats its predecessor's time does not lengthen it.
    """
    flags = np.zeros(len(value), bool)
    at = np.flatnonzero(~(np.isnan(value) | np.isnan(size)))
    if len(at) < rules.min_run:
        return flags
    c, b, v, z, t = kind[at], block[at], value[at], size[at], time[at]
    same_channel = (c[1:] == c[:-1]) & (b[1:] == b[:-1])
    same = same_channel & (v[1:] == v[:-1]) & (z[1:] == z[:-1])
    fresh = np.concatenate([[True], ~same_channel | (t[1:] != t[:-1])])
    run = np.concatenate([[0], np.cumsum(~same)])
    length = np.bincount(run, weights=fresh).astype(np.int64)
    long = length >= rules.min_run
    if not long.any():
        return flags
    # Readings and repeats of short runs among the nearest of the kind, from running totals.
    begins = np.concatenate([[True], ~same])
    short = ~long[run] & fresh
    trials, repeats = (np.concatenate([[0], np.cumsum(w)]) for w in (short, short & ~begins))
    kinds = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
    for r in np.flatnonzero(long):
        i, j = np.searchsorted(run, r, "left"), np.searchsorted(run, r, "right")
        k = np.searchsorted(kinds, i, "right")
        low, high = max(kinds[k - 1], i - rules.around), min(kinds[k], j + rules.around)
        n, again = (w[i] - w[low] + w[high] - w[j] for w in (trials, repeats))
        p = min((again + 1.0) / (n + 10.0), 0.9)
        if np.log(n + length[r]) + (length[r] - 1) * np.log(p) < np.log(rules.run_chance):
            flags[at[i:j]] = True
    return flags


def size_outliers(kind: np.ndarray, size: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """Sizes far above what their kind shows around. Rows are sorted by kind, then time; NaN and sizes of 0 are left out."""
    flags = np.zeros(len(size), bool)
    with np.errstate(invalid="ignore"):
        ok = np.flatnonzero(size > 0)
    edges = np.flatnonzero(np.diff(kind[ok], prepend=np.nan, append=np.nan) != 0) if len(ok) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):  # kinds are few
        if b - a < rules.few:
            continue
        lz = np.log10(size[ok[a:b]])
        r = lz - _around(lz, rules.around)
        scale = 1.4826 * _around(np.abs(r), rules.around)
        flags[ok[a:b]] = (r > rules.size_cut * scale) & (r > np.log10(rules.size_sum) + 0.5 * np.log(10) * scale**2)
    return flags


def judge(kind: np.ndarray, block: np.ndarray, time: np.ndarray, value: np.ndarray, size: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """The flags of one source's readings, which are in order of time."""
    flags = np.zeros(len(value), np.int32)
    with np.errstate(invalid="ignore"):
        bad = (value <= 0) | np.isinf(value)
        flags[bad | (size < 0)] |= LIMIT
    order = np.argsort(kind, kind="stable")
    stuck = np.zeros(len(value), bool)
    stuck[order] = stuck_runs(kind[order], block[order], value[order], size[order], time[order], rules)
    flags[stuck] |= STUCK
    big = np.zeros(len(value), bool)
    big[order] = size_outliers(kind[order], np.where(stuck, np.nan, size)[order], rules)
    flags[big] |= SIZE
    use = np.flatnonzero(~np.isnan(value) & ~bad & ~stuck)
    if len(use):
        flags[use[additive_outliers(np.log(value[use]), rules, block=block[use])[0]]] |= SPIKE
    return flags


def _slotted(df: DataFrame, widths: tuple[int, ...], most: int) -> DataFrame:
    """Rows (src, at, ...) with `slot`, the start of the time slot they lie in; slots with more than `most` rows are cut finer."""
    start = lambda w: F.floor(F.col("at") / F.lit(w)) * F.lit(w)
    df = df.withColumn("slot", start(widths[0]))
    for w in widths[1:]:
        hot = heavy_groups(df, ["src", "slot"], most)
        if hot is None:
            break
        df = df.join(hot, ["src", "slot"], "left").withColumn("slot", F.when(F.col("rows_").isNull(), F.col("slot")).otherwise(start(w))).drop("rows_")
    return df


def windows_of(df: DataFrame, widths: tuple[int, ...], window: int, context: int) -> DataFrame:
    """Rows (src, at, ...) with `win` and `own`: each row once as the window's own, and again as context of windows near by.

    A window is a run of whole slots of one source with about `window` rows; it has all rows of the slots that hold the
    `context` rows before and after it. Only counts per slot are ordered, never the rows of a source.
    """
    df = _slotted(df, widths, window)
    along = Window.partitionBy("src").orderBy("slot")
    s = df.groupBy("src", "slot").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("b", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("n"))
    full = F.floor(F.col("a") / window)
    s = s.withColumn("new", (full != F.lag(full, 1, -1).over(along)).cast("bigint"))
    s = s.withColumn("win", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    by = Window.partitionBy("src").orderBy("win")
    reach = 2 + -(-2 * context // window)
    to = [F.col("win")]
    for j in range(1, reach + 1):
        # Windows ahead and behind, if fewer than `context` rows lie between.
        ahead, behind = F.max("b").over(by.rangeBetween(j - 1, j - 1)), F.min("a").over(by.rangeBetween(1 - j, 1 - j))
        exists = F.max("win").over(Window.partitionBy("src")) >= F.col("win") + j
        to += [F.when(exists & (ahead - F.col("b") < context), F.col("win") + j), F.when((F.col("win") > j) & (F.col("a") - behind < context), F.col("win") - j)]
    s = s.select("src", "slot", F.col("win").alias("home"), F.array_compact(F.array(*to)).alias("to"))
    out = df.join(s.hint("merge"), ["src", "slot"]).withColumn("win", F.explode("to"))
    return out.withColumn("own", F.col("win") == F.col("home")).drop("slot", "home", "to")


def _source(keys: list[str]) -> Column:
    """The keys of a source as one text; NULL is a key like any other."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])


def _flagged(rows: DataFrame, reading: list[str], widths: tuple[int, ...], rules: SpikeRules, judged) -> DataFrame:
    """`id` and `flags` of the rows (src, at, id, and the columns that make a reading) that `judged` flags.

    Equal rows are one reading. `judged` gets the columns of a window, in order of time, and gives flags.
    """
    key = ["src", "at", *reading]
    readings = cut(rows.groupBy(*key).agg(F.min("id").alias("rid"), F.count(F.lit(1)).cast("int").alias("copies")))
    cutted = windows_of(readings, widths, rules.window, rules.context)
    kept = [f for f in readings.schema.fields if f.name in (*key, "rid", "copies")]
    schema = T.StructType([*kept, T.StructField("flags", T.IntegerType())])

    def work(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy(zero_copy_only=False) for c in ("at", *reading, "rid")}
        order = np.lexsort((columns["rid"], *(columns[c] for c in reversed(reading)), columns["at"]))
        flags = np.empty(len(order), np.int32)
        flags[order] = judged({k: v[order] for k, v in columns.items()})
        keep = np.flatnonzero((flags > 0) & table["own"].to_numpy(zero_copy_only=False))
        return table.select([f.name for f in kept]).take(pa.array(keep)).append_column("flags", pa.array(flags[keep], pa.int32()))

    used = cutted.select("win", "own", *[f.name for f in kept])
    found = cut(used.groupBy("src", "win").applyInArrow(work, schema))
    # The copies of a flagged reading are found by its hash and time; rows that cannot have one stay out of the join.
    hashed = lambda df: df.withColumn("h", F.xxhash64(*key))
    many = hashed(found.where("copies > 1")).select("h", "at", "flags")
    copies = may_match(hashed(rows).select("id", "h", "at"), many, ["h"]).join(many, ["h", "at"]).select("id", "flags")
    return found.where("copies = 1").select(F.col("rid").alias("id"), "flags").unionAll(copies)


def flag_readings(
    df: DataFrame, *, id: str, source: list[str], block: list[str], channel: list[str], time: str, value: str, size: str,
    rules: SpikeRules = SpikeRules(),
) -> DataFrame:
    """Rows of `df` with an implausible value or size: columns `id` and `flags` (bits LIMIT, STUCK, SPIKE, SIZE).

    source: the keys whose normal behaviour counts. block: keys within which a run must lie (a trading day).
    channel: keys within the source (compared ignoring case and outer blanks) for stuck runs and sizes; they should be few.
    NULL or NaN readings are no cases; a NULL source or channel is a source or channel of its own; rows without a
    time have no neighbours, so only limits hold for them; ties in time go by channel, value and size; repeated rows are
    judged alike; an empty table gives none. Columns of `df` with other names, whatever they are called, are not touched.
    """
    kind = [F.upper(F.trim(F.col(c).cast("string"))) for c in channel]
    rows = df.select(
        _source(source).alias("src"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.xxhash64(F.lit(0), *kind).alias("kind"), F.xxhash64(F.lit(0), *block).alias("block"),
        F.col(value).cast("double").alias("value"), F.col(size).cast("double").alias("size"), F.col(id).cast("bigint").alias("id"),
    )

    def judged(c: dict) -> np.ndarray:
        return judge(c["kind"], c["block"], c["at"], c["value"].astype(float), c["size"].astype(float), rules)

    found = _flagged(rows.where("at is not null"), ["kind", "block", "value", "size"], SLOTS, rules, judged)
    lost = rows.where("at is null and ((value <= 0 or value = double('infinity')) or size < 0)").select("id", F.lit(LIMIT).alias("flags"))
    return found.unionAll(lost)


COUNT_RULES = SpikeRules(half=8, cut=6.0, move_cut=6.0, unknown=1.2, run_chance=1e-4, min_run=4)


def judge_counts(time: np.ndarray, count: np.ndarray, total: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """The flags of one source's counts, in order."""
    flags = np.zeros(len(count), np.int32)
    with np.errstate(invalid="ignore"):
        bad = (count < 0) | (count > total)
    flags[bad] |= LIMIT
    one = np.zeros(len(count))
    stuck = stuck_runs(one, one, count, one, time, rules)
    flags[stuck] |= STUCK
    with np.errstate(invalid="ignore"):
        use = np.flatnonzero(~bad & ~stuck & (total >= 0) & ~np.isnan(count))
    if len(use):
        y = np.log(count[use] + 0.5) - np.log(total[use] + 1.0)
        # Two Poisson standard deviations of the logarithm, at the count that the source's usual share gives.
        least = 2.0 / np.sqrt(np.exp(_around(y, rules.around)) * (total[use] + 1.0) + 0.5)
        flags[use[additive_outliers(y, rules, 3.0 * least)[0]]] |= SPIKE
    return flags


def flag_counts(
    df: DataFrame, *, id: str, source: list[str], order: str, count: str, total: str, rules: SpikeRules = COUNT_RULES
) -> DataFrame:
    """Rows whose `count`, as a share of `total`, is implausible for its source: columns `id` and `flags`.

    Impossible are counts below 0 or above the total. NULL counts are no cases; a NULL total leaves only the
    other tests; rows are taken in the order of `order` (NULL first), ties by count and total; an empty table gives none.
    """
    rows = df.select(
        _source(source).alias("src"), F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**62))).alias("at"),
        F.col(count).cast("double").alias("count"), F.col(total).cast("double").alias("total"), F.col(id).cast("bigint").alias("id"),
    )
    return _flagged(rows, ["count", "total"], (1,), rules, lambda c: judge_counts(c["at"], c["count"].astype(float), c["total"].astype(float), rules))
