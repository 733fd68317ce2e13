import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import expression as ex

CLOSE = [10.0, 12.0, 11.0, 14.0, 13.0]


@pytest.fixture(scope="module")
def series(spark):
    rows = [("A", i, c, c * 10 if i < 4 else 0.0) for i, c in enumerate(CLOSE)]
    return spark.createDataFrame(rows, "symbol string, timestamp int, close double, volume double")


@pytest.fixture(scope="module")
def cross(spark):
    rows = [(s, t, c) for t, prices in enumerate([[10.0, 20.0, 30.0], [15.0, 25.0, 5.0], [7.0, 7.0, None]]) for s, c in zip("ABC", prices, strict=True)]
    return spark.createDataFrame(rows, "symbol string, timestamp int, close double")


def values(df, text, **kw):
    return [r["x"] for r in ex.with_factors(df, {"x": text}, **kw).orderBy("timestamp", "symbol").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("lag(close, 1)", [None, 10, 12, 11, 14]), ("ts_delta(close, 2)", [None, None, 1, 2, 2]), ("ts_mean(close, 3)", [10, 11, 11, 37 / 3, 38 / 3]), ("ts_sum(close, 2)", [10, 22, 23, 25, 27]),
        ("ts_min(close, 2)", [10, 10, 11, 11, 13]), ("ts_max(close, 2)", [10, 12, 12, 14, 14]), ("ts_std(close, 2)", [None, math.sqrt(2), math.sqrt(0.5), math.sqrt(4.5), math.sqrt(0.5)]),
        ("close / volume", [0.1, 0.1, 0.1, 0.1, None]), ("-close + 2 * 3", [-4, -6, -5, -8, -7]), ("3", [3] * 5), ("ts_mean(close, 2.9)", [10, 11, 11.5, 12.5, 13.5]), ("10 - 4 - 3", [3] * 5), ("12 / 2 / 3", [2] * 5),
    ],
)
def test_series_functions(series, text, want):
    assert values(series, text) == [None if w is None else pytest.approx(w) for w in want]


def test_cross_section(cross):
    assert values(cross, "rank(close)") == pytest.approx([1 / 3, 2 / 3, 1, 2 / 3, 1, 1 / 3, 0.75, 0.75, None])
    z = values(cross, "zscore(close)")
    assert z[:6] == pytest.approx([-1, 0, 1, 0, 1, -1]) and z[6:] == [None] * 3


def test_one_series_without_symbol(series):
    z = values(series.drop("symbol"), "zscore(close)", symbol=None)
    assert z[0] is None and z[1] == pytest.approx(1 / math.sqrt(2))
    assert values(series.drop("symbol"), "rank(close)", symbol=None) == pytest.approx([0.2, 0.6, 0.4, 1.0, 0.8])


def test_event_decay_and_extra_fields(spark):
    df = spark.createDataFrame([("A", 0, 5.0), ("A", 1, -5.0), ("A", 2, None)], "symbol string, timestamp int, distance double")
    assert values(df, "event_decay(distance, 5)", extra_fields=["distance"]) == pytest.approx([0.5, 0.5, 0.0])


def test_missing_values_are_null_in_windows(spark):
    df = spark.createDataFrame([("A", 0, None), ("A", 1, float("nan")), ("A", 2, 4.0), ("A", 3, float("inf"))], "symbol string, timestamp int, close double")
    assert values(df, "ts_mean(close, 2)") == [None, None, 4.0, 4.0]
    assert ex.with_factors(df.limit(0), {"x": "rank(close)"}).count() == 0


@pytest.mark.parametrize("text", ["", " ", "close +", "foo", "foo(close)", "close ^ 2", "(close", "ts_mean(close)", "ts_mean(close, -1)", "ts_mean(close, volume)", "rank(close, 2)", "close close", "1e3 + x", ".5"])
def test_bad_texts(text):
    assert ex.check(text)


def test_errors_when_compiled(series):
    for text in ("close / 0", "rank(3)", "ts_mean(close, 0.5)", "1 / (2 - 2)"):
        with pytest.raises(ex.ExpressionError):
            ex.with_factors(series, {"x": text})


def test_hypotheses_and_names():
    assert ex.hypothesis_expression("Volume leads.\nExpr: rank(volume)\n")[0] == "rank(volume)"
    assert ex.factor_name("Rank of (Volume)!" * 9) == ex.factor_name("Rank of (Volume)!" * 9)[:60]
    with pytest.raises(ex.ExpressionError):
        ex.hypothesis_expression("nothing here")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("open + close", "close + open", True), ("open - close", "-close + open", True), ("(open + high) + low", "low + (high + open)", True), ("-(-open)", "open", True), ("open * 2 * close", "close * (open * 2)", True), ("open / close", "close / open", False), ("open - close", "close - open", False)],
)
def test_canonical_forms(a, b, same):
    assert (ex.canonical(ex.parse(a)) == ex.canonical(ex.parse(b))) is same
    if same:
        assert ex.similarity(ex.parse(a), ex.parse(b)) == 1.0


def test_similarity_of_near_duplicates():
    a, b, c = (ex.parse(t) for t in ("rank(ts_mean(close, 20))", "rank(ts_mean(close, 21))", "zscore(volume)"))
    assert ex.similarity(a, b) == 1.0 or ex.similarity(a, b) > 0.9
    assert ex.similarity(a, c) < 0.2


_TREES = st.recursive(
    st.one_of(st.sampled_from([ex.Field("close"), ex.Field("volume")]), st.integers(0, 50).map(lambda n: ex.Num(float(n)))),
    lambda kids: st.one_of(
        kids.map(ex.Neg), st.tuples(st.sampled_from("+-*/"), kids, kids).map(lambda x: ex.Op(*x)), kids.map(lambda k: ex.Call("rank", (k,))), st.tuples(kids, st.integers(1, 60)).map(lambda x: ex.Call("ts_mean", (x[0], ex.Num(float(x[1]))))),
    ),
    max_leaves=8,
)


@settings(max_examples=150, deadline=None)
@given(_TREES)
def test_rendered_texts_parse_to_the_same_tree(tree):
    assert ex.parse(ex.render(tree)) == tree


def test_variations():
    names = [n for _, n in ex.variations("rank(ts_mean(close, 20))")]
    assert names == ["unwrap_outer", "window_halve", "window_double"]
    assert [n for _, n in ex.variations("ts_mean(close, 20)", ["turnover_high"])][0] == "window_double"
    assert ex.variations("not an expression (") == []
    baskets = ex.basket_variations("equal_weight", ["rank(close)", "volume"])
    assert len({ex.recipe_id("equal_weight", b) for b, _ in baskets}) == len(baskets)
    assert ex.recipe_id("m", ["open + close", "volume"]) == ex.recipe_id("m", ["volume", "close + open"])
