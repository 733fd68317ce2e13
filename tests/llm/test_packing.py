import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 100)), max_size=80), st.integers(2, 9), st.integers(40, 100))
def test_no_container_breaks_a_limit(items, segments, loss):
    sizes = np.array([(a, 1, min(a, b, loss)) for a, b in items], float).reshape(-1, 3)
    limits = np.array([100.0, segments, loss])
    place = packing.fill_containers(sizes, limits)
    assert len(place) == len(items) and (place >= 0).all()
    for k in range(3):
        assert (np.bincount(place, weights=sizes[:, k]) <= limits[k] + 1e-6).all() if len(place) else True
    if len(items):
        assert place.max() + 1 <= len(items)


def test_filling_is_tight_and_deterministic():
    g = np.random.default_rng(0)
    sizes = np.stack([g.integers(5, 400, 3000), np.ones(3000), np.zeros(3000)], axis=1).astype(float)
    limits = np.array([1000.0, 64, 1000])
    place = packing.fill_containers(sizes, limits)
    assert sizes[:, 0].sum() / ((place.max() + 1) * 1000) > 0.995
    assert (place == packing.fill_containers(sizes, limits)).all()


def test_an_item_beyond_a_limit_is_alone():
    place = packing.fill_containers(np.array([[10.0, 1, 0], [200.0, 1, 0], [10.0, 1, 0]]), np.array([100.0, 5, 100]))
    assert place[0] == place[2] != place[1]


def _items(spark, n=3000, seed=1):
    g = np.random.default_rng(seed)
    rows = [(i, int(g.integers(0, 700)), int(g.integers(0, 50)), "clash", 1) for i in range(n)] + [(n, 5000, 20, "clash", 1), (n + 1, 512, 0, "clash", 1), (n + 2, 0, 0, "clash", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, tokens bigint, lead bigint, plan string, piece int")


@pytest.mark.parametrize("group", [64, 4096])
def test_pieces_and_packing_cover_everything_within_the_limits(spark, group):
    docs = _items(spark)
    items = packing.pieces(docs, [("a", 512), ("b", 2048)], ["doc_id"], "tokens", "lead")
    packed = packing.pack(items, id="doc_id", max_segments=F.col("capacity") / 16, max_loss=F.col("capacity"), group_items=group).cache()
    for plan, cap in (("a", 512), ("b", 2048)):
        own = packed.where(F.col("plan") == plan)
        assert own.select("doc_id", "piece").distinct().count() == own.count()
        bad = own.groupBy("sequence_id").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("loss").alias("l")).where((F.col("s") > cap) | (F.col("n") > cap / 16) | (F.col("l") > cap))
        assert bad.count() == 0
        whole = {r["doc_id"]: (r["t"], r["n"]) for r in own.groupBy("doc_id").agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
        for r in docs.collect():
            assert whole.get(r["doc_id"], (0, 0)) == (r["tokens"], -(-r["tokens"] // cap))  # only longer texts are split
        used = own.agg(F.sum("size") / (F.count_distinct("sequence_id") * cap)).first()[0]
        assert used > 0.97
    assert packed.where("loss < 0 or loss > size").count() == 0


def test_empty_items_and_plans(spark):
    items = packing.pieces(_items(spark).limit(0), [("a", 512)], ["doc_id"], "tokens", "lead")
    assert packing.pack(items, id="doc_id", max_segments=F.lit(4), max_loss=F.col("capacity")).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(_items(spark), [], ["doc_id"], "tokens", "lead")
