"""One surviving record for each group of duplicates, built from whole bundles of fields.

Fields that depend on each other form a bundle and are taken together from one record. Records are ordered by trust, and
each bundle lists the records in which it is complete and valid, the most trusted first. Functional dependencies between
bundles (a passage belongs to the chosen document, a document has one source class) exclude combinations, so the best
record of one bundle may not go with the best of another. Branch and bound finds the allowed combination that gives up least trust:
the places passed over in each bundle, times its weight, summed by level and compared level by level; an empty bundle costs
EMPTY places. A branch is given up when its cost, with the first record still allowed in every open bundle, is not
below that of the best combination found.

Groups are never collected. What a dependency can tell apart is the values of its fields, so records are first reduced, on the
map side, to the most trusted one per group, bundle and such values, and of these a group's search sees the first few of
each bundle. Whatever lies beyond costs at least as many places as were seen: where the best combination costs less than
that it is proved to be the best of all, and only groups without the proof are searched again with more records.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Places that an empty bundle counts for.
EMPTY = 1_000_000

#: Company forms at the end of a party's name.
COMPANY_FORMS = ("limited", "ltd", "company", "co", "incorporated", "inc", "corporation", "corp", "lp", "llp", "llc", "plc")


@dataclass(frozen=True)
class Bundle:
    """Fields that are taken together, when they may be taken from a record, and how much a place passed over costs.

    Costs at a lower level come before any at a higher one.
    """

    name: str
    fields: Sequence[str]
    valid: Column
    weight: int = 1
    level: int = 0


@dataclass(frozen=True)
class Dependency:
    """The value of `field` in the record of the `determinant` bundle, if not NULL, must be that in the record of the `dependent` bundle."""

    determinant: str
    dependent: str
    field: str


def party_key(name: Column) -> Column:
    """A party's name without case, spacing, punctuation and company forms at its end; NULL stays NULL."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[.'’]", ""), "[^\\p{L}\\p{N}]+", " ")
    forms = "|".join((*COMPANY_FORMS, "l p"))
    return F.regexp_replace(F.regexp_replace(F.trim(plain), f"( ({forms}))+$", ""), " ", "")


def choose_bundles(
    candidates: Sequence[Sequence[dict]], dependencies: Sequence[tuple[int, int, int]], weights: Sequence[int], levels: Sequence[int], more: Sequence[bool] = (),
) -> tuple[list[int], bool]:
    """The cheapest allowed choice, one candidate (its index) per bundle or -1 for none, and whether it is proved.

    candidates: for each bundle its candidates, most trusted first; each has `fixes` and `has`, the values it fixes and has
    for each dependency. dependencies: (determinant bundle, dependent bundle, number of the dependency). more: bundles that have
    candidates beyond those given; the choice is proved if it costs less than any that takes one of these. Of
    choices that cost the same the first in the order of levels and bundles is taken. An empty bundle constrains nothing.
    """
    depth = max(levels, default=0) + 1
    turn = sorted(range(len(candidates)), key=lambda b: (levels[b], b))
    best: tuple[list[int], list[int]] | None = None

    def cost(chosen: dict[int, int], open_: Sequence[Sequence[int]]) -> list[int]:
        """What has been chosen costs, with the first candidate still allowed for the rest."""
        out = [0] * depth
        for b in turn:
            place = chosen[b] if b in chosen else next(iter(open_[b]), -1)
            out[levels[b]] += weights[b] * (EMPTY if place < 0 else place)
        return out

    def allowed(a: dict, b: dict, k: int) -> bool:
        return a["fixes"][k] is None or a["fixes"][k] == b["has"][k]

    def search(chosen: dict[int, int], open_: list[list[int]]) -> None:
        nonlocal best
        bound = cost(chosen, open_)
        if best is not None and bound >= best[0]:
            return
        if len(chosen) == len(turn):
            best = bound, [chosen[b] for b in range(len(turn))]
            return
        at = turn[len(chosen)]
        for i in [*open_[at], -1]:
            left = list(open_)
            for a, b, k in dependencies if i >= 0 else ():
                if a == at and b not in chosen:
                    left[b] = [j for j in left[b] if allowed(candidates[a][i], candidates[b][j], k)]
                elif b == at and a not in chosen:
                    left[a] = [j for j in left[a] if allowed(candidates[a][j], candidates[b][i], k)]
            search({**chosen, at: i}, left)

    search({}, [list(range(len(c))) for c in candidates])
    price, choice = best
    beyond = [[weights[b] * len(candidates[b]) if levels[b] == k else 0 for k in range(depth)] for b, m in enumerate(more) if m]
    return choice, all(price < x for x in beyond)


def survivors(
    df: DataFrame, *, id: str, group: dict[str, Column], trust: Sequence[Column], bundles: Sequence[Bundle], dependencies: Sequence[Dependency] = (), least: int = 2, seen: int = 32,
) -> DataFrame:
    """One record per group: the group's columns, `group_id` (smallest id), `best_id`, `rows`, and per bundle its fields and `<name>_id`.

    trust: expressions that order records, smallest first (write NULL handling into them); ties go to the smallest id.
    seen: candidates of a bundle that a search begins with; it changes no result. A bundle that no record can give, or none
    that the others allow, has NULL fields and id -1. Groups of fewer than `least` rows are left out. NULL in
    a group column equals NULL. Repeated rows change only `rows`. An empty table gives no rows.
    """
    number = {b.name: i for i, b in enumerate(bundles)}
    fds = [(number[d.determinant], number[d.dependent], k) for k, d in enumerate(dependencies)]
    weights, levels = [b.weight for b in bundles], [b.level for b in bundles]
    parts = [F.col(d.field).cast("string") for d in dependencies]
    nothing = F.lit(None).cast("string")
    order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(trust)], F.col(id).cast("bigint").alias("rid"))
    texts = lambda side, i: F.array(*[parts[k] if fd[side] == i else nothing for k, fd in enumerate(fds)]).cast("array<string>")

    def entry(i: int) -> Column:
        """What a record offers to bundle i; -1 is the record itself."""
        values = [(F.struct(*b.fields) if j == i else F.when(F.lit(False), F.struct(*b.fields))).alias(b.name) for j, b in enumerate(bundles)]
        out = F.struct(F.lit(i).alias("b"), texts(0, i).alias("fixes"), texts(1, i).alias("has"), F.struct(*values).alias("v"))
        return out if i < 0 else F.when(bundles[i].valid, out)

    # From here on there are only columns named here, whatever else `df` has.
    keys = [f"g_{n}" for n in group]
    rows = df.select(*[c.alias(k) for k, c in zip(keys, group.values(), strict=True)], order.alias("order_"), F.array_compact(F.array(*map(entry, range(-1, len(bundles))))).alias("all_"))
    rows = rows.select(*keys, "order_", F.explode("all_").alias("e_"))
    reduced = rows.groupBy(*keys, "e_.b", "e_.fixes", "e_.has").agg(F.count(F.lit(1)).alias("n"), F.min("order_.rid").alias("first_id"), F.min(F.struct("order_", "e_.v")).alias("m"))

    def pick(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns, strict=True):
            cands = [[{"fixes": list(c["fixes"]), "has": list(c["has"])} for c in col] for col in row]
            out.append(choose_bundles([c[:seen_] for c in cands], fds, weights, levels, [len(c) > seen_ for c in cands]))
        return pd.DataFrame({"choice": [c for c, _ in out], "proved": [p for _, p in out]})

    def searched(reduced: DataFrame) -> DataFrame:
        """Groups with their candidates and the choice among the first `seen_`."""
        place = F.row_number().over(Window.partitionBy(*keys, "b").orderBy("m.order_"))
        first = reduced.withColumn("place", place).where(F.col("place") <= seen_ + 1)
        lists = [F.sort_array(F.collect_list(F.when(F.col("b") == i, F.struct("place", F.col("m.order_.rid").alias("rid"), "fixes", "has", F.col(f"m.v.{b.name}").alias("v"))))).alias(f"c_{b.name}") for b, i in zip(bundles, range(len(bundles)), strict=True)]
        own = lambda c: F.max(F.when(F.col("b") == -1, F.col(c)))
        whole = first.groupBy(*keys).agg(own("n").alias("rows"), own("first_id").alias("group_id"), own("m.order_.rid").alias("best_id"), *lists).where(F.col("rows") >= least)
        if not fds:
            every = F.array(*[F.when(F.size(f"c_{b.name}") > 0, 0).otherwise(-1) for b in bundles])
            return whole.withColumn("found", F.struct(every.alias("choice"), F.lit(True).alias("proved")))
        slim = [F.transform(f"c_{b.name}", lambda c: F.struct(c["fixes"].alias("fixes"), c["has"].alias("has"))) for b in bundles]
        return whole.withColumn("found", F.pandas_udf(pick, "choice array<int>, proved boolean")(*slim))

    def result(chosen: DataFrame) -> DataFrame:
        out = [F.col(k).alias(n) for k, n in zip(keys, group, strict=True)] + ["group_id", "best_id", "rows"]
        for i, b in enumerate(bundles):
            at = F.col("found.choice")[i]
            c = F.when(at >= 0, F.get(F.col(f"c_{b.name}"), at))
            out += [F.coalesce(c["rid"], F.lit(-1).cast("bigint")).alias(f"{b.name}_id"), *[c["v"][f].alias(f) for f in b.fields]]
        return chosen.select(*out)

    seen_, done = seen, None
    while True:
        found = searched(reduced)
        if not fds:
            return result(found)
        found = cut(found)
        good = result(found.where("found.proved"))
        done = good if done is None else done.unionAll(good)
        left = found.where("not found.proved").select(*[F.col(k).alias(f"l_{k}") for k in keys])
        if left.isEmpty():
            return done
        on = [reduced[k].eqNullSafe(left[f"l_{k}"]) for k in keys]
        reduced, seen_ = reduced.join(left, on, "left_semi"), seen_ * 16
