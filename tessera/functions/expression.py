"""The factor expression language: text to tree, tree to Spark columns.

Grammar, loosest first: sums (+ -), products (* /), a sign, and atoms (a number, a field, a call, brackets). Only
listed fields and functions are accepted; windows and half-lives are positive numbers written in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safe import divide, finite, mean_rank

#: Fixed values of the language: the fields of every panel, and the functions with their number of arguments.
FIELDS = frozenset(("open", "high", "low", "close", "volume", "vwap"))
FUNCTIONS = {
    "lag": 2, "ts_lag": 2, "ts_delta": 2, "ts_mean": 2, "ts_std": 2, "ts_sum": 2, "ts_min": 2, "ts_max": 2, "event_decay": 2, "rank": 1, "zscore": 1,
}


class ExpressionError(ValueError):
    """A text that is no expression; the message says where."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Neg:
    arg: object


@dataclass(frozen=True)
class Op:
    sign: str
    left: object
    right: object


_LEX = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d*)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>[-+*/(),])|(?P<bad>\S))")
_BINDING = {"+": 1, "-": 1, "*": 2, "/": 2}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, position) of each token. Numbers have no exponent and do not begin with a point."""
    out = []
    for m in _LEX.finditer(text):
        kind = m.lastgroup
        if kind == "bad":
            raise ExpressionError(f"unexpected {m[kind]!r} at {m.start(kind)}")
        if kind:
            out.append((kind, m[kind], m.start(kind)))
    return out


def parse(text: str, extra_fields: Iterable[str] = ()) -> object:
    """The tree of an expression; fields beyond the basic ones must be given."""
    if not text or not text.strip():
        raise ExpressionError("the expression is empty")
    known, items, at = FIELDS | set(extra_fields), tokens(text), 0

    def peek() -> tuple[str, str, int]:
        return items[at] if at < len(items) else ("end", "", len(text))

    def take(want: str | None = None) -> tuple[str, str, int]:
        nonlocal at
        token = peek()
        if token[0] == "end" or want is not None and token[1] != want:
            raise ExpressionError(f"expected {want or 'more'} at {token[2]}")
        at += 1
        return token

    def climb(least: int) -> object:
        left = signed()
        while (bind := _BINDING.get(peek()[1], 0)) >= least and peek()[0] == "sign" and bind:
            sign = take()[1]
            left = Op(sign, left, climb(bind + 1))
        return left

    def signed() -> object:
        if peek()[1] == "-":
            take()
            return Neg(signed())
        kind, word, where = take()
        if kind == "num":
            return Num(float(word))
        if word == "(":
            inner = climb(1)
            take(")")
            return inner
        if kind != "name":
            raise ExpressionError(f"unexpected {word!r} at {where}")
        if peek()[1] == "(":
            if word not in FUNCTIONS:
                raise ExpressionError(f"unknown function {word!r} at {where}")
            take("(")
            args = [climb(1)]
            while peek()[1] == ",":
                take(",")
                args.append(climb(1))
            take(")")
            return Call(word, tuple(args))
        if word not in known:
            raise ExpressionError(f"unknown field {word!r} at {where}")
        return Field(word)

    tree = climb(1)
    if at < len(items):
        raise ExpressionError(f"unexpected {peek()[1]!r} at {peek()[2]}")
    return tree


def children(node: object) -> tuple:
    if isinstance(node, Call):
        return node.args
    if isinstance(node, Op):
        return node.left, node.right
    return (node.arg,) if isinstance(node, Neg) else ()


def problems(node: object) -> list[str]:
    """What is wrong with a tree: numbers of arguments, windows that are no positive numbers."""
    out = []
    if isinstance(node, Call):
        want = FUNCTIONS.get(node.name)
        if want is not None and len(node.args) != want:
            out.append(f"{node.name} takes {want} argument(s), not {len(node.args)}")
        elif want == 2 and not (isinstance(node.args[1], Num) and node.args[1].value > 0):
            out.append(f"{node.name} needs a positive number as its second argument")
    for child in children(node):
        out += problems(child)
    return out


def check(text: str, extra_fields: Iterable[str] = ()) -> list[str]:
    """All problems of a text, empty if it is a valid expression."""
    try:
        return problems(parse(text, extra_fields))
    except ExpressionError as e:
        return [str(e)]


def hypothesis_expression(text: str) -> tuple[str, object]:
    """The expression behind 'expr:' or 'expression:' in a text, and its tree; an error if there is none or it is not valid."""
    m = re.search(r"(?im)\bexpr(?:ession)?\s*:\s*(.+)$", text)
    if not m:
        raise ExpressionError("no expression is given")
    source = m[1].strip()
    tree = parse(source)
    if bad := problems(tree):
        raise ExpressionError("; ".join(bad))
    return source, tree


def factor_name(text: str, longest: int = 60) -> str:
    """A short lower-case name with low lines."""
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")[:longest].rstrip("_")


def render(node: object) -> str:
    """A text that parses to the same tree, with all brackets."""
    if isinstance(node, Num):
        return str(int(node.value)) if node.value == int(node.value) else repr(node.value)
    if isinstance(node, Field):
        return node.name
    if isinstance(node, Call):
        return f"{node.name}({', '.join(map(render, node.args))})"
    if isinstance(node, Neg):
        return f"-{render(node.arg)}" if isinstance(node.arg, (Num, Field, Call)) else f"-({render(node.arg)})"
    return f"({render(node.left)} {node.sign} {render(node.right)})"


def canonical(node: object) -> tuple:
    """A form that is equal for expressions equal up to order, case and signs.

    Sums and products are flat and sorted; differences are sums of negated terms; two signs cancel and numbers
    take theirs; quotients stay as they are.
    """
    if isinstance(node, Num):
        return ("num", node.value + 0.0)
    if isinstance(node, Field):
        return ("field", node.name.lower())
    if isinstance(node, Call):
        return ("fn", node.name.lower(), *map(canonical, node.args))
    if isinstance(node, Neg):
        return _minus(canonical(node.arg))
    a, b = canonical(node.left), canonical(node.right)
    if node.sign == "/":
        return ("/", a, b)
    sign, b = ("+", _minus(b)) if node.sign == "-" else (node.sign, b)
    terms = [t for side in (a, b) for t in (side[1:] if side[0] == sign else (side,))]
    return (sign, *sorted(terms, key=repr))


def _minus(form: tuple) -> tuple:
    if form[0] == "neg":
        return form[1]
    return ("num", -form[1] + 0.0) if form[0] == "num" else ("neg", form)


def canonical_id(node: object) -> str:
    """Sixteen hexadecimal digits that name the canonical form."""
    return hashlib.sha256(repr(canonical(node)).encode()).hexdigest()[:16]


def recipe_id(method: str, expressions: Iterable[str]) -> str:
    """Sixteen hexadecimal digits that name a basket: its method and its members in any order."""
    members = sorted(canonical_id(parse(e)) for e in expressions)
    return hashlib.sha256("|".join([method, *members]).encode()).hexdigest()[:16]


def size_class(x: float) -> int:
    """A number's rounded natural logarithm; 0 below 1."""
    return round(math.log(abs(x))) if abs(x) >= 1 else 0


def features(form: tuple, depth: int = 0) -> Counter:
    """How often each (depth, kind, name) occurs in a canonical form; numbers by size class."""
    kind = form[0]
    name = size_class(form[1]) if kind == "num" else form[1] if kind in ("field", "fn") else ""
    out = Counter([(depth, kind, name)])
    for child in form[1:]:
        if isinstance(child, tuple):
            out += features(child, depth + 1)
    return out


def similarity(a: object, b: object) -> float:
    """1 for equal canonical forms, else the weighted overlap of their features."""
    x, y = canonical(a), canonical(b)
    if x == y:
        return 1.0
    fx, fy = features(x), features(y)
    return sum((fx & fy).values()) / sum((fx | fy).values())


def _scaled(node: object, factor: float) -> tuple[object, bool]:
    """The tree with its first window scaled (at least 1, whole), and whether there was one."""
    if isinstance(node, Call) and len(node.args) == 2 and isinstance(node.args[1], Num):
        new = float(max(1, int(node.args[1].value * factor)))
        if new != node.args[1].value:
            return Call(node.name, (node.args[0], Num(new))), True
    kids = list(children(node))
    for i, kid in enumerate(kids):
        new, done = _scaled(kid, factor)
        if done:
            kids[i] = new
            rebuilt = Call(node.name, tuple(kids)) if isinstance(node, Call) else Neg(kids[0]) if isinstance(node, Neg) else Op(node.sign, *kids)
            return rebuilt, True
    return node, False


#: How much each kind of change is favoured for each weakness.
FAVOURS = {
    "turnover_high": {"window_double": 3, "window_halve": -3, "unwrap_outer": -1},
    "sign_inconsistent": {"window_double": 2, "window_halve": -2},
    "cost_drag_large": {"window_double": 2, "window_halve": -1},
    "weak_cross_sectional": {"wrap_rank": 3, "wrap_zscore": 3, "unwrap_outer": -2},
}


def variations(text: str, weaknesses: Iterable[str] = ()) -> list[tuple[str, str]]:
    """Changed expressions with the name of the change, without repeats; none if the text is no expression.

    An outer rank or z-score is taken off, the first window halved and doubled, a rank or z-score put around.
    Weaknesses reorder them by how well each change treats them.
    """
    try:
        tree = parse(text)
    except ExpressionError:
        return []
    outer = tree.name if isinstance(tree, Call) and tree.name in ("rank", "zscore") else None
    made: list[tuple[str, object]] = [("unwrap_outer", tree.args[0])] if outer else []
    made += [(name, new) for name, f in (("window_halve", 0.5), ("window_double", 2.0)) for new, done in [_scaled(tree, f)] if done]
    made += [(f"wrap_{w}", Call(w, (tree,))) for w in ("rank", "zscore") if outer is None]
    seen, out = {render(tree)}, []
    for name, new in made:
        if (shown := render(new)) not in seen:
            seen.add(shown)
            out.append((shown, name))
    weak = list(weaknesses)
    return sorted(out, key=lambda x: -sum(FAVOURS.get(w, {}).get(x[1], 0) for w in weak))


def basket_variations(method: str, expressions: list[str], weaknesses: Iterable[str] = ()) -> list[tuple[list[str], str]]:
    """Baskets in which one member is changed, each basket once."""
    seen, out = {recipe_id(method, expressions)}, []
    for i, text in enumerate(expressions):
        for new, name in variations(text, weaknesses):
            basket = [*expressions[:i], new, *expressions[i + 1 :]]
            if (key := recipe_id(method, basket)) not in seen:
                seen.add(key)
                out.append((basket, f"component_{i}:{name}"))
    return out


# From trees to columns ------------------------------------------------------------------------------------------


def number(node: object) -> float | None:
    """The value of a tree without fields, or None. A division by 0 is an error."""
    if isinstance(node, Num):
        return node.value
    if isinstance(node, Neg):
        x = number(node.arg)
        return None if x is None else -x
    if isinstance(node, Op):
        a, b = number(node.left), number(node.right)
        if node.sign == "/" and b == 0:
            raise ExpressionError("division by 0")
        if a is None or b is None:
            return None
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else None}[node.sign]
    return None


def with_factors(panel: DataFrame, factors: Mapping[str, object | str], symbol: str | None = "symbol", time: str = "timestamp", extra_fields: Iterable[str] = ()) -> DataFrame:
    """The panel with one column per factor.

    Series functions run over the rows of a symbol in order of time, rank and zscore over the rows of a time. Functions
    of equal depth are added together and equal parts once, so windows with the same key share one shuffle. Missing
    values are NULL (also NaN and what is not finite); windows count rows, with or without a value, and need one
    value (two for ts_std). Without a symbol the panel is one series: zscore is then over the rows so far, and
    rank over all rows. Ties in time within a symbol are taken in any order, so keys should be unique.
    """
    trees = {k: parse(v, extra_fields) if isinstance(v, str) else v for k, v in factors.items()}
    for tree in trees.values():
        if bad := problems(tree):
            raise ExpressionError("; ".join(bad))
    base = list(panel.columns)
    names: dict[tuple, str] = {}
    levels: dict[int, dict[tuple, Call]] = {}

    def depth(node: object) -> int:
        below = max(map(depth, children(node)), default=0)
        if isinstance(node, Call) and node.name != "event_decay":
            levels.setdefault(below, {})[canonical(node)] = node
            return below + 1
        return below

    for tree in trees.values():
        depth(tree)

    def column(node: object) -> Column:
        value = number(node)
        if value is not None:
            return F.lit(float(value))
        if isinstance(node, Field):
            return finite(F.col(node.name))
        if isinstance(node, Neg):
            return -column(node.arg)
        if isinstance(node, Op):
            a, b = column(node.left), column(node.right)
            return {"+": a + b, "-": a - b, "*": a * b}[node.sign] if node.sign != "/" else divide(a, b)
        if node.name == "event_decay":
            return F.coalesce(F.exp(F.lit(-math.log(2)) * F.abs(column(node.args[0])) / F.lit(node.args[1].value)), F.lit(0.0))
        return F.col(names[canonical(node)])

    keys = [symbol] if symbol else []
    series = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(1)]).orderBy(time)
    cross = Window.partitionBy(F.col(time)) if symbol else Window.partitionBy(F.lit(1))

    def call(node: Call) -> Column:
        if number(node.args[0]) is not None:
            raise ExpressionError(f"{node.name} of a number")
        x = column(node.args[0])
        if node.name == "rank":
            return mean_rank(x, F.col(time) if symbol else F.lit(1)) / F.count(x).over(cross)
        if node.name == "zscore":
            over = cross if symbol else series.rowsBetween(Window.unboundedPreceding, 0)
            return F.try_divide(x - F.avg(x).over(over), F.stddev_samp(x).over(over))
        n = int(node.args[1].value)
        if n < 1:
            raise ExpressionError(f"{node.name} over less than one row")
        if node.name in ("lag", "ts_lag"):
            return F.lag(x, n).over(series)
        if node.name == "ts_delta":
            return x - F.lag(x, n).over(series)
        use = {"ts_mean": F.avg, "ts_std": F.stddev_samp, "ts_sum": F.sum, "ts_min": F.min, "ts_max": F.max}[node.name]
        return use(x).over(series.rowsBetween(1 - n, 0))

    for level in sorted(levels):
        added = {}
        for form, node in levels[level].items():
            if form not in names:
                # Arguments that are more than a column are put down first, so that windows see plain columns.
                name = f"_x{len(names)}"
                added[name], names[form] = call(node), name
        panel = panel.withColumns(added)
    return panel.select(*base, *[finite(column(t)).alias(k) for k, t in trees.items()])
