"""Mixing sources to target shares of all tokens, with capped repetition, as a min-cost flow.

A document belongs to its own source and to those of its copies. Documents with the same membership form one pattern;
the flow sends tokens from patterns to the quotas of sources. Each further use of a pattern's documents costs more
than the one before (so repetition is spread evenly and comes last), and counting a document for a copy's source costs
a little. Within a mix only its own sources count, so patterns are the sets of these that occur, whatever the number of
documents and of other sources; the network has a node per pattern and source. Its solution says how many
tokens of each pattern go to each source; documents are then taken in a seeded order, found by prefix sums in two steps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns and targets the driver may hold; more are an error, never dropped. A mix of k sources has at most 2 ** k sets of members.
MOST_PATTERNS = 100_000
#: Documents of a pattern that are put in order by one task, on average.
BUCKET_ROWS = 50_000


class Network:
    """A small flow network solved by successive shortest paths (integer capacities and costs)."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, s: int, t: int, most: int) -> int:
        """Send up to `most` units at least cost; the units sent. The flow of an arc is the room of its reverse."""
        sent = 0
        while sent < most:
            dist, via, queued = {s: 0}, {}, {s}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and dist[a] + self.cost[e] < dist.get(b, 1 << 60):
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if t not in dist:
                break
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            step = min(most - sent, *(self.room[e] for e in path))
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            sent += step
        return sent


@dataclass(frozen=True)
class Pattern:
    """Documents alike in membership: their own source, the sources they may count for, and their tokens."""

    own: str
    members: tuple[str, ...]
    tokens: int


def route(patterns: Sequence[Pattern], quotas: Mapping[str, int], repeats: Mapping[str, int], whole: bool = True) -> dict[tuple[int, str], int] | None:
    """Tokens of each pattern (by its number) for each source, at least cost, or None if the quotas cannot be met.

    Without `whole` the quotas are upper bounds, and as many tokens as possible are sent.
    """
    net = Network()
    s, t = net.node(), net.node()
    sink = {q: net.node() for q in quotas}
    for q, n in quotas.items():
        net.arc(sink[q], t, n)
    arcs = {}
    for i, p in enumerate(patterns):
        to = [m for m in p.members if m in quotas]
        if not to or p.tokens <= 0:
            continue
        node = net.node()
        for k in range(max(repeats[m] for m in to)):
            net.arc(s, node, p.tokens, 10 * k)
        for m in to:
            arcs[i, m] = net.arc(node, sink[m], p.tokens * repeats[m], 0 if m == p.own else 1)
    want = sum(quotas.values())
    if net.send(s, t, want) < want and whole:
        return None
    return {k: net.room[e ^ 1] for k, e in arcs.items() if net.room[e ^ 1]}


def plan_mix(patterns: Sequence[Pattern], shares: Mapping[str, float], repeats: Mapping[str, int], least: float = 0.1) -> dict[tuple[int, str], int]:
    """The flow of the largest mix in which every source has its share.

    Sources without documents are left out and the other shares scaled up. A source so small that the mix would
    be less than `least` of all tokens gives what it has, and the others keep their shares among themselves. Several such
    sources give what they have together: a text that they share is supplied only once. If sources have documents
    and no plan can be made of them, it is an error.
    """
    reach = {m: sum(p.tokens for p in patterns if m in p.members) for m in shares}
    present = {m: w for m, w in shares.items() if w > 0 and reach[m] > 0}
    natural = sum(p.tokens for p in patterns if set(p.members) & set(present))
    scarce: dict[str, int] = {}
    while present:
        weight = sum(present.values())
        limit = {m: reach[m] * repeats[m] * weight / w for m, w in present.items()}
        tight = min(limit, key=lambda m: (limit[m], m))
        if limit[tight] >= least * natural or len(present) == 1:
            fixed = _given(route(patterns, {**dict.fromkeys(present, 0), **scarce}, repeats, whole=False), scarce)
            total, found = _largest(patterns, present, fixed, repeats, int(limit[tight]), max(1, natural // 100_000))
            if total + max(1, natural // 100_000) >= least * natural or len(present) == 1:
                if not found and any(reach[m] * repeats[m] for m in [*present, *scarce]):
                    raise ValueError(f"no mix of the sources {sorted([*present, *scarce])} can be made")
                return found
            # Shared texts leave a source less than its reach: what it can have beside the scarce ones decides.
            for m, w in present.items():
                beside = route(patterns, {**dict.fromkeys(present, 0), **fixed, m: reach[m] * repeats[m]}, repeats, whole=False)
                limit[m] = (sum(beside.values()) - sum(fixed.values())) * weight / w
            tight = min(limit, key=lambda m: (limit[m], m))
        scarce[tight] = reach[tight] * repeats[tight]
        del present[tight]
    return {}


def _given(flow: Mapping[tuple[int, str], int], sources: Mapping[str, int]) -> dict[str, int]:
    """The tokens of a flow that go to each of the sources."""
    return {m: sum(n for (_, s), n in flow.items() if s == m) for m in sources}


def _largest(
    patterns: Sequence[Pattern], present: Mapping[str, float], fixed: Mapping[str, int], repeats: Mapping[str, int], high: int, near: int,
) -> tuple[int, dict[tuple[int, str], int]]:
    """The largest total up to `high` (to within `near`) of which each present source has its share beside the fixed quotas, and its flow."""
    weight = sum(present.values())

    def attempt(total: int) -> dict[tuple[int, str], int] | None:
        return route(patterns, {**{m: int(total * w / weight) for m, w in present.items()}, **fixed}, repeats)

    # Almost always the tightest source's limit can be met; with much overlap the total is found by halving.
    found = attempt(high)
    if found is not None:
        return high, found
    low, best = 0, attempt(0)
    if best is None:
        raise ValueError("the quotas of the scarce sources cannot be met together")
    while low < high - near:
        middle = (low + high) // 2
        found = attempt(middle)
        if found is None:
            high = middle
        else:
            low, best = middle, found
    return low, best


def source_key(source: Column) -> Column:
    """A source's name without case, outer blanks, and the difference between hyphens, blanks and low lines; NULL if blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), "[-_\\s]+", "_"), F.lit(""))


def memberships(docs: DataFrame, id: str = "id", copy: str = "copy", own: str = "own", some: str = "some") -> DataFrame:
    """The rows of `docs` with `members`, the sorted sources of all copies of a text. Texts that are not `some` (NULL or empty) have no copies.

    `copy` identifies a text (see text_key). The sources of a text are combined on the map side, so a text that
    a third of all rows repeat is a few rows; only texts with several sources are joined back.
    """
    shared = docs.where(some).groupBy(copy).agg(F.sort_array(F.collect_set(own)).alias("members")).where(F.size("members") > 1)
    alone = F.when(F.col(own).isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
    return docs.join(shared, copy, "left").withColumn("members", F.coalesce("members", alone)).select(id, own, "members", *[c for c in docs.columns if c not in (id, own, copy, some)])


def text_key(text: Column) -> Column:
    """What identifies a text: a hash of 128 bits."""
    return F.md5(text.cast("binary"))


def goals_of(targets: DataFrame) -> DataFrame:
    """Targets by normalised source; rows whose sources become equal are one, with their shares together and the fewest repeats."""
    named = targets.select("mix_name", source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), "max_repeats")
    return named.groupBy("mix_name", "source").agg(F.sum("share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 7, least: float = 0.1) -> DataFrame:
    """Uses of documents per mix: mix_name, id, counted_as (a source), uses, tokens (of one use).

    docs: id, own, members (see memberships) and tokens. targets: mix_name, source, target_share, max_repeats. least: a source that
    would shrink the mix below this share of all tokens gives only what it has (0: every source has its share, however
    small the mix). A document is used at most max_repeats times for a source and, over all sources, at most the largest
    max_repeats of its own. Documents without tokens or source are never used; ids must be unique. Shares are met to
    within a document.
    """
    spark = docs.sparkSession
    goals = goals_of(targets).limit(MOST_PATTERNS + 1).collect()
    if len(goals) > MOST_PATTERNS:
        raise ValueError("more targets than the driver may hold")
    mixes = {name: {g["source"]: g for g in goals if g["mix_name"] == name and g["source"]} for name in sorted({g["mix_name"] for g in goals})}
    # Each document once for every mix that has one of its sources, with the mix's sources only.
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    offers = F.array(*[F.struct(F.lit(name).alias("mix_name"), F.array_intersect("members", texts(sorted(of))).alias("members")) for name, of in mixes.items()]) if mixes else F.array().cast("array<struct<mix_name: string, members: array<string>>>")
    docs = docs.where("tokens > 0 and size(members) > 0")
    rows = docs.select("id", "own", "tokens", F.explode(F.filter(offers, lambda o: F.size(o["members"]) > 0)).alias("o_")).select("id", "tokens", "own", "o_.mix_name", "o_.members")
    rows = rows.withColumn("own", F.when(F.array_contains("members", F.col("own")), F.col("own")).otherwise(F.lit("")))
    rows = rows.withColumn("pattern", F.concat_ws("|", "mix_name", "own", F.array_join("members", ",")))
    totals = rows.groupBy("pattern", "mix_name", "own", "members").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError("more membership patterns than the driver may hold")
    lines = []
    for name, of in mixes.items():
        own = sorted((t for t in totals if t["mix_name"] == name), key=lambda t: t["pattern"])
        patterns = [Pattern(t["own"], tuple(t["members"]), int(t["tokens"])) for t in own]
        flow = plan_mix(patterns, {s: float(g["target_share"] or 0) for s, g in of.items()}, {s: int(g["max_repeats"] or 0) for s, g in of.items()}, least)
        for i, (t, p) in enumerate(zip(own, patterns, strict=True)):
            at = 0
            for s in sorted(of):
                n = flow.get((i, s), 0)
                if n:
                    lines.append((t["pattern"], s, at, at + n, p.tokens))
                    at += n
    cuts = spark.createDataFrame(lines, "pattern string, counted_as string, low bigint, high bigint, all_tokens bigint")
    # A pattern's documents in a seeded order: that of a hash, whose upper bits make as many buckets as the largest pattern needs.
    bits = max(0, (max((t["n"] for t in totals), default=0) // BUCKET_ROWS)).bit_length()
    rows = rows.select("id", "pattern", "mix_name", "tokens", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1).alias("turn")).withColumn("bucket", F.shiftright("turn", 63 - bits))
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pattern", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("pattern", "bucket").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(sums, ["pattern", "bucket"])
    placed = placed.withColumn("offset", F.col("base") + F.col("inner"))
    # Every use of a document lies on the pattern's line; it counts for the source whose stretch holds its middle.
    # The cuts are at most sources times patterns rows, both checked above.
    joined = placed.join(F.broadcast(cuts), "pattern")
    middle = F.col("offset") + F.col("tokens") / 2
    turns = F.col("all_tokens")
    uses = F.floor((F.col("high") - middle - F.lit(1e-6)) / turns) - F.floor((F.col("low") - middle - F.lit(1e-6)) / turns)
    return joined.withColumn("uses", uses.cast("int")).where("uses > 0").select("mix_name", "id", "counted_as", "uses", "tokens")


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of all tokens, tokens, documents, the most uses of one document, and the tokens short of the target share."""
    got = uses.groupBy("mix_name", F.col("counted_as").alias("source")).agg(
        F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count_distinct("id").alias("documents"), F.max("uses").alias("most_uses")
    )
    all_ = F.sum("tokens").over(Window.partitionBy("mix_name"))
    out = goals_of(targets).join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_uses"])
    return out.withColumn("actual_share", F.round(F.try_divide(F.col("tokens").cast("double"), all_), 6)).withColumn(
        "missing_tokens", F.greatest(F.floor(F.col("target_share") * all_).cast("bigint") - F.col("tokens"), F.lit(0))
    )
