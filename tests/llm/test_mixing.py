import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.mixing import Network, Pattern, plan_mix, route


def test_flow_takes_the_cheaper_way_first():
    net = Network()
    s, a, b, t = (net.node() for _ in range(4))
    cheap, dear = net.arc(s, a, 5, 1), net.arc(s, b, 5, 3)
    net.arc(a, t, 9)
    net.arc(b, t, 9)
    assert net.send(s, t, 7) == 7 and net.room[cheap ^ 1] == 5 and net.room[dear ^ 1] == 2
    assert net.send(s, t, 99) == 3


def test_flow_against_brute_force():
    g = random.Random(5)
    for _ in range(60):
        patterns = [Pattern(m[0], tuple(sorted(m)), g.randrange(1, 5)) for m in (g.sample("xyz", g.randrange(1, 4)) for _ in range(3))]
        quotas, repeats = {m: g.randrange(0, 7) for m in "xyz"}, {m: g.randrange(1, 3) for m in "xyz"}
        found = route(patterns, quotas, repeats)

        def feasible(i, left):
            if i == len(patterns):
                return not any(left.values())
            p = patterns[i]
            most = p.tokens * max(repeats[m] for m in p.members)

            def spread(ms, room, left):
                if not ms:
                    return feasible(i + 1, left)
                m = ms[0]
                return any(spread(ms[1:], room - n, {**left, m: left[m] - n}) for n in range(min(room, left[m], p.tokens * repeats[m]) + 1))

            return spread(list(p.members), most, left)

        assert (found is not None) == feasible(0, dict(quotas))
        if found is not None:
            assert all(sum(n for (_, m), n in found.items() if m == q) == quotas[q] for q in quotas)


def test_plans_scale_up_around_absent_and_tiny_sources():
    patterns = [Pattern("a", ("a",), 1000), Pattern("b", ("b",), 1000), Pattern("t", ("t",), 1)]
    flow = plan_mix(patterns, {"a": 0.6, "b": 0.2, "none": 0.2}, {"a": 1, "b": 3, "none": 3})
    got = {m: n for (_, m), n in flow.items()}
    assert got["a"] == pytest.approx(1000, abs=1) and got["b"] == pytest.approx(333, abs=1) and "none" not in got
    flow = plan_mix(patterns, {"a": 0.5, "b": 0.4, "t": 0.1}, {"a": 1, "b": 1, "t": 2})
    got = {m: n for (_, m), n in flow.items()}
    assert got["t"] == 2 and got["a"] == 1000 and got["b"] == 800
    assert plan_mix([], {"a": 1.0}, {"a": 1}) == {}


def _totals(flow):
    return {m: sum(n for (_, s), n in flow.items() if s == m) for m in {s for _, s in flow}}


def test_scarce_sources_that_share_a_text_do_not_empty_the_mix():
    patterns = [Pattern("c", ("c",), 1000), Pattern("a", ("a", "b"), 5)]
    once = dict.fromkeys("abc", 1)
    got = _totals(plan_mix(patterns, {"a": 0.2, "b": 0.2, "c": 0.6}, once))
    assert got["c"] == 1000 and got.get("a", 0) + got.get("b", 0) == 5
    # a alone is scarce by its reach; b's only text is a's, so b has nothing left and must not hold back c.
    got = _totals(plan_mix(patterns, {"a": 0.2, "b": 0.01, "c": 0.79}, once))
    assert got["c"] == 1000 and got.get("a", 0) + got.get("b", 0) == 5
    # A text of a third source's that may be repeated more often counts for both scarce ones.
    patterns = [Pattern("c", ("c",), 1000), Pattern("c", ("a", "b", "c"), 5)]
    got = _totals(plan_mix(patterns, {"a": 0.2, "b": 0.2, "c": 0.6}, {"a": 1, "b": 1, "c": 3}))
    assert got["a"] == got["b"] == 5 and got["c"] >= 3000


def test_a_mix_that_cannot_be_made_is_an_error():
    with pytest.raises(ValueError):
        plan_mix([Pattern("a", ("a", "b"), 1)], {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1})


DOCS = "doc_id bigint, text string, source string, tokens bigint, own string"


def _keyed(d):
    return d.select(d.doc_id.alias("id"), mixing.text_key(d.text).alias("copy"), mixing.source_key(d.source).alias("own"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("some"), "tokens")


def _mix(spark, docs, targets):
    d = spark.createDataFrame(docs, DOCS)
    members = mixing.memberships(_keyed(d))
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    uses = mixing.mix(members, t)
    return uses, mixing.shares(uses, t)


def test_uses_and_shares(spark):
    g = random.Random(2)
    docs = [(i, f"text {i}", g.choice(["Alpha", "alpha ", "BETA-one", "beta_one"]), g.randrange(1, 60), "clash") for i in range(800)]
    docs += [(900 + i, f"small {i}", "small", 10, "x") for i in range(30)] + [(990, None, None, 5, "x"), (991, "", "alpha", 0, "x"), (992, "lost", None, 9, "x")]
    targets = [("m", "alpha", 0.5, 2), ("m", "beta_one", 0.45, 2), ("m", "small", 0.05, 3), ("n", "beta one", 0.9, 1), ("n", "absent", 0.1, 5)]
    uses, shares = _mix(spark, docs, targets)
    rows, by = uses.collect(), {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert len({(r["mix_name"], r["id"], r["counted_as"]) for r in rows}) == len(rows)
    for m, s, share, cap in targets:
        r = by[m, s.replace(" ", "_")]
        assert r["most_uses"] <= cap
        if m == "m":
            assert r["actual_share"] == pytest.approx(share, abs=0.004)
    assert by["n", "absent"]["tokens"] == 0 and by["n", "beta_one"]["actual_share"] == 1.0
    again, _ = _mix(spark, docs, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_copies_belong_to_the_sources_of_all_copies(spark):
    docs = [(1, "same", "a", 10, ""), (2, "same", "B", 10, ""), (3, "same", None, 10, ""), (4, "own", "a", 10, ""), (5, None, "a", 0, ""), (6, "", "a", 0, "")]
    m = {r["id"]: r["members"] for r in mixing.memberships(_keyed(spark.createDataFrame(docs, DOCS))).collect()}
    assert m == {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b"], 4: ["a"], 5: ["a"], 6: ["a"]}


def test_empty_inputs(spark):
    uses, shares = _mix(spark, [(1, None, None, 0, "")], [("m", "a", 1.0, 2)])
    assert uses.count() == 0 and shares.first()["tokens"] == 0


def test_targets_with_equal_names_are_one_and_shortfalls_are_reported(spark):
    docs = [(i, f"text {i}", "a" if i < 100 else "b", 10, "") for i in range(200)] + [(900, "only", "tiny", 5, "")]
    targets = [("m", "A", 0.2, 2), ("m", " a", 0.2, 1), ("m", "b", 0.4, 1), ("m", "tiny", 0.2, 1)]
    uses, shares = _mix(spark, docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["a"]["target_share"] == pytest.approx(0.4) and got["a"]["max_repeats"] == 1 and len(got) == 3
    assert got["tiny"]["tokens"] == 5 and got["tiny"]["missing_tokens"] == int(0.2 * sum(r["tokens"] for r in got.values())) - 5
    assert got["a"]["tokens"] == got["b"]["tokens"] == 1000 and uses.where("uses > 1").count() == 0


def test_sources_outside_a_mix_make_no_patterns(spark):
    docs = [(i * 50 + k, f"text {i}", f"s{(i + k) % 60}", 10, "") for i in range(60) for k in range(20)]
    uses, shares = _mix(spark, docs, [("m", "s1", 0.5, 3), ("m", "s2", 0.5, 3)])
    got = {r["source"]: r["actual_share"] for r in shares.collect()}
    assert got == {"s1": pytest.approx(0.5, abs=0.02), "s2": pytest.approx(0.5, abs=0.02)}
