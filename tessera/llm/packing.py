"""Packing items into containers under simultaneous limits, by vector bin packing.

Every item has a size in several dimensions (tokens, segments, loss-bearing tokens) and every container a limit in each.
A container is filled by taking, again and again, the fitting item whose sizes have the greatest dot product with what
the container has left (all as shares of the limits); it begins with the largest item. Items are spread over groups of
bounded size by a hash, so no group grows with the data; containers that a group leaves poorly filled are emptied
again and their items packed in another round, in fewer groups. Only items longer than a container are split.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut


def fill_containers(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container of each item; sizes: items x dimensions, limits: one per dimension.

    An item beyond a limit gets a container of its own. Ties go to the earlier item. No items give no containers.
    """
    n = len(sizes)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    share = sizes / limits
    order = np.lexsort((np.arange(n), *(-share.T[::-1])))
    left, ids = np.ascontiguousarray(share[order].T), order
    alive = np.ones(n, bool)
    container, first, remaining, eps = -1, 0, n, 1e-9
    while remaining:
        first += int(np.argmax(alive[first:]))
        container += 1
        at, room = first, np.ones(len(limits))
        while True:
            alive[at] = False
            remaining -= 1
            out[ids[at]] = container
            room = room - left[:, at]
            # Items are in order of their first size, largest first: those that fit in it are the last ones.
            low = max(first, int(np.searchsorted(-left[0], -(room[0] + eps))))
            if (room < -eps).any() or low == len(ids):
                break
            fits, score = alive[low:].copy(), max(room[0], 0.0) * left[0, low:]
            for k in range(1, len(room)):
                fits &= left[k, low:] <= room[k] + eps
                score += max(room[k], 0.0) * left[k, low:]
            score[~fits] = -1.0
            best = int(np.argmax(score))
            if score[best] < 0:
                break
            at = low + best
        if 2 * remaining < len(ids) and len(ids) > 64:
            left, ids = np.ascontiguousarray(left[:, alive]), ids[alive]
            alive, first = np.ones(len(ids), bool), 0
    return out


def pieces(items: DataFrame, plans: Sequence[tuple[str, int]], carry: Sequence[str], tokens: str, lead: str) -> DataFrame:
    """Items cut to each plan's capacity: only longer ones are split, into full pieces and a rest.

    Gives plan, capacity, the columns `carry`, piece, start, size (tokens) and loss (tokens after the `lead` tokens of an
    item). Items without tokens give no piece.
    """
    if not plans:
        raise ValueError("there are no plans")
    offer = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(c).cast("bigint").alias("capacity")) for p, c in plans])
    rows = items.where(F.col(tokens) > 0).select(*carry, F.col(tokens).alias("n_"), F.col(lead).alias("lead_"), F.explode(offer).alias("p_"))
    rows = rows.select("*", "p_.plan", "p_.capacity").drop("p_")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_") / F.col("capacity")).cast("int") - 1)))
    start = F.col("piece") * F.col("capacity")
    end = F.least(start + F.col("capacity"), F.col("n_"))
    return rows.select("plan", "capacity", *carry, "piece", start.alias("start"), (end - start).alias("size"), F.greatest(end - F.greatest(start, F.col("lead_")), F.lit(0)).alias("loss"))


def pack(
    items: DataFrame, *, id: str, max_segments: Column, max_loss: Column, group_items: int = 4096, enough: float = 0.995, rounds: int = 3,
) -> DataFrame:
    """The rows of `items` (see pieces) with `sequence_id`, a text that names the container within its plan.

    max_segments, max_loss: limits per container as expressions over `capacity`. group_items: items packed together.
    enough: fill of the tightest dimension below which a container is packed again, in at most `rounds` rounds.
    Pieces as long as a container are containers already. Rows must be unique by plan, id and piece. An empty table
    gives no rows.
    """
    spec = items.withColumn("max_segments", max_segments.cast("bigint")).withColumn("max_loss", max_loss.cast("bigint"))
    full = (F.col("size") >= F.col("capacity")) | (F.col("max_segments") <= 1)
    single = spec.where(full).withColumn("sequence_id", F.concat_ws("-", F.lit("item"), F.col(id).cast("string"), F.col("piece").cast("string")))
    open_ = spec.where(~full)
    done, keep = single, [*items.columns, "sequence_id"]
    names = ["plan", "group", "capacity", "max_segments", "max_loss"]
    schema = T.StructType([*open_.schema.fields, T.StructField("group", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("fill", T.DoubleType())])

    def work(table: pa.Table) -> pa.Table:
        size, loss = (table[c].to_numpy(zero_copy_only=False).astype(float) for c in ("size", "loss"))
        limits = np.array([float(table[c][0].as_py()) for c in ("capacity", "max_segments", "max_loss")])
        sizes = np.stack([size, np.ones(len(size)), loss], axis=1)
        keys = np.lexsort((table["piece"].to_numpy(), np.asarray(table[id].to_pylist())))
        place = np.empty(len(size), np.int64)
        place[keys] = fill_containers(sizes[keys], limits)
        used = np.stack([np.bincount(place, weights=sizes[:, k]) / limits[k] for k in range(3)])
        fill = used.max(axis=0)[place]
        return table.append_column("bin", pa.array(place, pa.int64())).append_column("fill", pa.array(fill, pa.float64())).select(schema.names)

    for r in range(rounds):
        counts = {row[0]: row[1] for row in open_.groupBy("plan").count().collect()}  # one row per plan
        if not counts:
            break
        groups = F.create_map(*[x for p, n in counts.items() for x in (F.lit(p), F.lit(-(-n // group_items)))])
        grouped = open_.withColumn("group", F.pmod(F.xxhash64("plan", F.col(id), "piece", F.lit(r)), F.element_at(groups, F.col("plan"))).cast("bigint"))
        packed = cut(grouped.groupBy(*names).applyInArrow(work, schema))
        last = r == rounds - 1 or all(n <= group_items for n in counts.values())
        good = packed if last else packed.where(F.col("fill") >= enough)
        name = F.concat_ws("-", F.lit(f"round{r}"), F.col("group").cast("string"), F.col("bin").cast("string"))
        done = done.select(*keep).unionAll(good.withColumn("sequence_id", name).select(*keep))
        if last:
            break
        open_ = packed.where(F.col("fill") < enough).drop("group", "bin", "fill")
    return done.select(*keep)
