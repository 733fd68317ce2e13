import datetime as dt
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import survivor
from tessera.llm.survivor import Bundle, Dependency, choose_bundles


def _cost(pick, weights, levels):
    out = [0] * (max(levels) + 1)
    for b, i in enumerate(pick):
        out[levels[b]] += weights[b] * (survivor.EMPTY if i < 0 else i)
    return out


def _brute(cands, fds, weights=None, levels=None):
    """The cheapest allowed choice of all combinations; of several the first, by levels and bundles."""
    weights, levels = weights or [1] * len(cands), levels or [0] * len(cands)
    turn = sorted(range(len(cands)), key=lambda b: (levels[b], b))
    ok = []
    for pick in itertools.product(*[[*range(len(c)), -1] for c in cands]):
        if all(pick[a] < 0 or pick[b] < 0 or cands[a][pick[a]]["fixes"][k] is None or cands[a][pick[a]]["fixes"][k] == cands[b][pick[b]]["has"][k] for a, b, k in fds):
            ok.append((_cost(pick, weights, levels), [pick[b] if pick[b] >= 0 else 99 for b in turn], list(pick)))
    return min(ok)[2]


_VALUE = st.sampled_from([None, "x", "y", "z"])
_CAND = st.fixed_dictionaries({"fixes": st.lists(_VALUE, min_size=2, max_size=2), "has": st.lists(_VALUE, min_size=2, max_size=2)})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(_CAND, max_size=5), min_size=3, max_size=3), st.permutations([0, 1, 2]), st.lists(st.integers(1, 4), min_size=3, max_size=3), st.lists(st.integers(0, 1), min_size=3, max_size=3), st.integers(1, 5))
def test_branch_and_bound_against_all_combinations(cands, order, weights, levels, seen):
    fds = [(order[0], order[1], 0), (order[2], order[0], 1)]
    want = _brute(cands, fds, weights, levels)
    assert choose_bundles(cands, fds, weights, levels) == (want, True)
    # What is proved with some of the candidates is the best with all of them.
    choice, proved = choose_bundles([c[:seen] for c in cands], fds, weights, levels, [len(c) > seen for c in cands])
    assert not proved or choice == want


def test_the_best_combination_is_not_the_best_of_each_nor_the_first_that_fits():
    # Bundle 0 fixes a class that bundle 1 has far down; giving up one place of bundle 0 saves three of bundle 1.
    cands = [[{"fixes": ["x"], "has": [None]}, {"fixes": ["y"], "has": [None]}], [{"fixes": [None], "has": [h]} for h in "yzzx"]]
    assert choose_bundles(cands, [(0, 1, 0)], [1, 1], [0, 0]) == ([1, 0], True)
    assert choose_bundles(cands, [(0, 1, 0)], [4, 1], [0, 0]) == ([0, 3], True)  # unless bundle 0 weighs more
    assert choose_bundles(cands, [(0, 1, 0)], [1, 1], [0, 1]) == ([0, 3], True)  # or comes first
    assert choose_bundles([cands[0][:1], cands[1][:3]], [(0, 1, 0)], [1, 1], [0, 0]) == ([0, -1], True)  # only what does not fit is empty


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Granite Harbour Capital Limited", "GRANITE  harbour-capital Ltd.", True), ("Alder Meridian Partners L.P.", "alder meridian partners lp", True), ("Cobalt Ridge Co., Ltd.", "Cobalt Ridge", True),
        ("Cobalt Ridge Inc", "Cobalt Ridge Holdings Inc", False), ("Tobacco", "Toba", False), ("Limited", "Ltd", False), ("恒遠 機械", "恒遠機械", True),
    ],
)
def test_party_keys(spark, a, b, same):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(survivor.party_key(F.col("a")), survivor.party_key(F.col("b"))).first()
    assert (x == y) is same


SCHEMA = "id bigint, grp string, rank int, date date, doc string, cls string, at timestamp, g_grp string, d0 string, order_ int, n int"


def _run(spark, rows, least=2, seen=32):
    df = spark.createDataFrame(rows, SCHEMA)
    return survivor.survivors(
        df, id="id", group={"grp": F.col("grp")}, trust=[F.coalesce("rank", F.lit(99))], least=least, seen=seen,
        bundles=[Bundle("date", ["date"], F.col("date").isNotNull()), Bundle("doc", ["doc"], F.col("doc").isNotNull()), Bundle("cls", ["cls", "rank"], F.col("cls").isNotNull())],
        dependencies=[Dependency("doc", "cls", "cls")],
    )


def test_bundles_dependencies_and_missing_values(spark):
    d = dt.date(2026, 1, 1)
    extra = (None, "clash", "clash", 7, 7)
    rows = [
        (5, "a", 1, None, None, "top", *extra), (3, "a", 2, d, None, "mid", *extra), (9, "a", 3, None, "D9", "low", *extra), (2, "b", None, None, None, None, *extra), (1, "b", None, None, None, None, *extra),
        (7, "c", 1, d, "D7", "top", *extra), (20, None, 1, d, "D1", "x", *extra), (21, None, 1, d, "D2", "x", *extra), (21, None, 1, d, "D2", "x", *extra),
    ]
    got = {r["grp"]: r for r in _run(spark, rows).collect()}
    a = got["a"]
    assert (a["group_id"], a["best_id"], a["date_id"], a["doc_id"], a["cls_id"], a["cls"], a["rank"]) == (3, 5, 3, 9, 9, "low", 3)  # the document fixes its class
    b = got["b"]
    assert (b["group_id"], b["best_id"], b["date_id"], b["doc_id"], b["cls_id"]) == (1, 1, -1, -1, -1)
    assert "c" not in got and got[None]["rows"] == 3 and got[None]["best_id"] == 20
    assert _run(spark, []).count() == 0


@pytest.mark.parametrize("seen", [1, 32])
def test_survivors_against_brute_force(spark, seen):
    g = random.Random(3)
    rows = []
    for i in range(400):
        rows.append((i, g.choice("abcdef"), g.choice([None, 1, 2, 3, 9]), g.choice([None, dt.date(2026, 1, g.randrange(1, 28))]), g.choice([None, f"D{g.randrange(9)}"]), g.choice([None, "p", "q", "r", f"s{g.randrange(9)}"]), None, "", "", 0, 0))
    got = {r["grp"]: r for r in _run(spark, rows, seen=seen).collect()}
    for k in "abcdef":
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (99 if r[2] is None else r[2], r[0]))
        cands = [[r for r in own if r[i] is not None] for i in (3, 4, 5)]
        for i in (1, 2):  # one candidate for each class
            cands[i] = [r for j, r in enumerate(cands[i]) if r[5] not in [x[5] for x in cands[i][:j]]]
        want = _brute([[{"fixes": [r[5] if i == 1 else None], "has": [r[5] if i == 2 else None]} for r in c] for i, c in enumerate([cands[0][:1], *cands[1:]])], [(1, 2, 0)])
        assert [got[k]["date_id"], got[k]["doc_id"], got[k]["cls_id"]] == [c[j][0] for c, j in zip(cands, want, strict=True)] and got[k]["best_id"] == own[0][0]
