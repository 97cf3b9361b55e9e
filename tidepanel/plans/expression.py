"""Panel expressions: parser, analyser and lowering to staged window columns.

    Div(Mean($close, 5), Ref($close, 1)) - 1

``compile_panel`` turns expressions over (instrument, date) rows into a few
nested selects.  Operators over rows of one instrument become window functions;
as these can't nest, an argument that holds a window is first put into a column
of its own.  Equal sub-expressions are worked out once.  All windows share one
partitioning and, but for the blocks of EMA, one order, so the plan has one
exchange and one sort however many expressions it is given.

Missing values are NULL; aggregates skip them and need one value at least.
Division by zero, logs of non-positive numbers and undefined statistics are NULL.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ordered import Ordered, rolling_order


class ExpressionError(ValueError):
    """The text is no valid expression."""


@dataclass(frozen=True)
class Num:
    value: float

    def __str__(self) -> str:
        return repr(self.value)


@dataclass(frozen=True)
class Field:
    name: str

    def __str__(self) -> str:
        return f"${self.name}"


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.args))})"


Node = Num | Field | Call

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(\$\$?[A-Za-z_][A-Za-z_0-9]*)|([A-Za-z_][A-Za-z_0-9]*)|(>=|<=|==|!=|[-+*/^<>&|(),~])|('[^']*'))")
_BINARY = {"|": (1, "Or"), "&": (2, "And"), ">": (3, "Gt"), "<": (3, "Lt"), ">=": (3, "Ge"), "<=": (3, "Le"), "==": (3, "Eq"), "!=": (3, "Ne"), "+": (4, "Add"), "-": (4, "Sub"), "*": (5, "Mul"), "/": (5, "Div"), "^": (6, "Power")}


def parse(text: str) -> Node:
    """Prefix calls and infix operators; ``$name`` is a field."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at : at + 10]!r}")
        tokens.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos][1] if pos < len(tokens) else None

    def take(want: str | None = None) -> tuple[int, str]:
        nonlocal pos
        if pos >= len(tokens) or (want and tokens[pos][1] != want):
            raise ExpressionError(f"expected {want or 'more'} at token {pos} of {text!r}")
        pos += 1
        return tokens[pos - 1]

    def unary() -> Node:
        kind, tok = take()
        if tok == "-":
            inner = unary()
            return Num(-inner.value) if isinstance(inner, Num) else Call("Sub", (Num(0.0), inner))
        if tok == "~":
            return Call("Not", (unary(),))
        if tok == "(":
            inner = binary(1)
            take(")")
            return inner
        if kind == 1:
            return Num(float(tok))
        if kind == 2:
            return Field(tok.lstrip("$"))
        if kind == 5:
            return Field(tok)
        if kind == 3:
            take("(")
            args = [binary(1)]
            while peek() == ",":
                take()
                args.append(binary(1))
            take(")")
            return Call(tok, tuple(args))
        raise ExpressionError(f"unexpected {tok!r}")

    def binary(least: int) -> Node:
        left = unary()
        while (op := peek()) in _BINARY and _BINARY[op][0] >= least:
            take()
            level, name = _BINARY[op]
            left = Call(name, (left, binary(level + 1)))
        return left

    out = binary(1)
    if pos != len(tokens):
        raise ExpressionError(f"{text!r} goes on after its end: {peek()!r}")
    return out


#: operator -> (number of series arguments, number of literal arguments behind them)
ARITY = {
    **dict.fromkeys("Abs Log Sign Not".split(), (1, 0)),
    **dict.fromkeys("Add Sub Mul Div Power Greater Less Gt Lt Ge Le Eq Ne And Or".split(), (2, 0)),
    "If": (3, 0),
    **dict.fromkeys("Ref Mean Sum Std Var Skew Kurt Max IdxMax Min IdxMin Med Mad Rank Count Delta Slope Rsquare Resi WMA EMA".split(), (1, 1)),
    "Quantile": (1, 2),
    **dict.fromkeys("Corr Cov".split(), (2, 1)),
    **dict.fromkeys("CMean CStd LastValue".split(), (1, 0)),
}
_BOOL = {"Gt", "Lt", "Ge", "Le", "Eq", "Ne", "And", "Or", "Not"}


@dataclass(frozen=True)
class Operator:
    """A user's operator: so many series arguments and literal whole numbers or fractions behind them.

    ``lower(series, literals, duck)`` gives SQL over columns for Spark or, with ``duck``, DuckDB.  A
    ``windowed`` one is a window expression by instrument and date (``frame`` makes its OVER clause) and may not nest, a plain one is a scalar.
    ``back`` and ``ahead`` say from the literals how many rows before and behind the
    current one it reads (-1 back: all); ``condition``: it gives a truth value; ``conditions``: it takes them.
    """

    series: int
    literals: int
    lower: Callable[[list[str], list[float], bool], str]
    windowed: bool = True
    back: Callable[[list[float]], int] = lambda lits: 0
    ahead: Callable[[list[float]], int] = lambda lits: 0
    condition: bool = False
    conditions: bool = False


_OWN: dict[str, Operator] = {}


def frame(before: int | None, after: int = 0) -> str:
    """OVER clause of the rows from ``before`` rows back (None: the first) to ``after`` rows ahead, for windowed operators."""
    low = "UNBOUNDED PRECEDING" if before is None else f"{before} PRECEDING"
    return f"OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN {low} AND {f'{after} FOLLOWING' if after else 'CURRENT ROW'})"


@contextmanager
def operators(**own: Operator) -> Iterator[None]:
    """User's operators by name, known to parsing, checks, extents and both lowerings within the block."""
    taken = own.keys() & (ARITY.keys() | _OWN.keys())
    if taken:
        raise ExpressionError(f"operators are known already: {sorted(taken)}")
    _OWN.update(own)
    try:
        yield
    finally:
        for name in own:
            del _OWN[name]


def _arity(op: str) -> tuple[int, int]:
    return (_OWN[op].series, _OWN[op].literals) if op in _OWN else ARITY[op]


def check(node: Node, search: bool = False) -> None:
    """Arity, literals and types; with ``search`` also the rules for generated expressions.

    Search rules: windows are 1 or more, Ref looks back only, Power takes 0.5,
    2 or 3, Log needs a positive argument by form (Abs or a positive literal added).
    """
    if not isinstance(node, Call):
        return
    if node.op not in ARITY and node.op not in _OWN:
        raise ExpressionError(f"unknown operator {node.op}")
    series, literals = _arity(node.op)
    if len(node.args) != series + literals:
        raise ExpressionError(f"{node.op} takes {series + literals} arguments, not {len(node.args)}")
    tail = node.args[series:]
    if not all(isinstance(a, Num) for a in tail):
        raise ExpressionError(f"{node.op}: window and quantile must be numbers")
    if node.op in _OWN:
        if _OWN[node.op].conditions != all(map(is_bool, node.args[:series])) and _OWN[node.op].conditions:
            raise ExpressionError(f"{node.op} takes conditions")
    elif literals:
        n = tail[0].value
        if n != int(n) or (n < 0 and node.op != "Ref"):
            raise ExpressionError(f"{node.op}: window {n} must be a whole number of 0 or more")
        if search and n < 1:
            raise ExpressionError(f"{node.op}: window must be 1 or more")
    if node.op == "Quantile" and not 0 <= tail[1].value <= 1:
        raise ExpressionError("Quantile: q must lie in [0, 1]")
    if node.op == "If" and not is_bool(node.args[0]):
        raise ExpressionError("If: the first argument must be a condition")
    if node.op in ("And", "Or", "Not") and not all(map(is_bool, node.args)):
        raise ExpressionError(f"{node.op} takes conditions")
    if search and node.op == "Power" and not (isinstance(node.args[1], Num) and node.args[1].value in (0.5, 2.0, 3.0)):
        raise ExpressionError("Power: the exponent must be 0.5, 2 or 3")
    if search and node.op == "Log":
        a = node.args[0]
        if not (isinstance(a, Call) and (a.op == "Abs" or a.op == "Add" and any(isinstance(x, Num) and x.value > 0 for x in a.args))):
            raise ExpressionError("Log: the argument must be Abs(..) or have a positive number added")
    for a in node.args[:series]:
        check(a, search)


_ROW = "row_number() OVER (PARTITION BY instrument ORDER BY date)"


def is_bool(node: Node) -> bool:
    return isinstance(node, Call) and (node.op in _BOOL or node.op in _OWN and _OWN[node.op].condition)


def fields(node: Node) -> set[str]:
    if isinstance(node, Field):
        return {node.name}
    return set().union(*map(fields, node.args)) if isinstance(node, Call) else set()


def extent(node: Node) -> tuple[int, int]:
    """(rows back, rows ahead) that the value at a row depends on; back is -1 for all."""
    if not isinstance(node, Call):
        return 0, 0
    inner = [extent(a) for a in node.args if not isinstance(a, Num)] or [(0, 0)]
    back, ahead = (-1 if any(b < 0 for b, _ in inner) else max(b for b, _ in inner)), max(a for _, a in inner)
    if node.op in ("CMean", "CStd", "LastValue", "EMA"):
        return -1, ahead
    if node.op in _OWN:
        own = _OWN[node.op]
        lits = [a.value for a in node.args[own.series :]]
        more = own.back(lits)
        return (-1 if back < 0 or more < 0 else back + more), ahead + own.ahead(lits)
    series, literals = ARITY[node.op]
    if not literals:
        return back, ahead
    n = int(node.args[series].value)
    if node.op in ("Ref", "Delta"):
        return (back if back < 0 else max(0, back + n)), max(0, ahead - n)
    return (-1 if n == 0 or back < 0 else back + n - 1), ahead


@dataclass
class _Lowering:
    """Stages of named SQL columns; the texts hold in Spark SQL and, with ``duck``, in DuckDB.

    In Spark, order statistics over so many rows are no SQL but ``Ordered``.
    """

    duck: bool = False
    stages: list[dict[str, str | Ordered]] = field(default_factory=list)
    known: dict[str | Ordered, tuple[str, int]] = field(default_factory=dict)

    def put(self, sql: str | Ordered, stage: int) -> tuple[str, int]:
        """Name ``sql``, worked out in ``stage``; usable from the next one on."""
        if sql not in self.known or self.known[sql][1] > stage + 1:
            while len(self.stages) <= stage:
                self.stages.append({})
            name = f"w{sum(map(len, self.stages))}_"
            self.stages[stage][name] = sql
            self.known[sql] = name, stage + 1
        return self.known[sql]

    def over(self, n: int) -> str:
        frame = "UNBOUNDED PRECEDING" if n == 0 else f"{n - 1} PRECEDING"
        return f"OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN {frame} AND CURRENT ROW)"

    def lower(self, node: Node) -> tuple[str, int]:
        """(SQL over columns, first stage at which it can be worked out)."""
        if isinstance(node, Num):
            return f"CAST({node.value!r} AS DOUBLE)", 0
        if isinstance(node, Field):
            return node.name, 0
        series, literals = _arity(node.op)
        own = _OWN.get(node.op)
        parts = [self.lower(a) for a in node.args[:series]]
        stage = max(s for _, s in parts)
        x = [sql for sql, _ in parts]
        for i, a in enumerate(node.args[:series]):
            if is_bool(a) and node.op not in ("And", "Or", "Not") and not (own and own.conditions) and not (node.op == "If" and i == 0):
                x[i] = f"CAST({x[i]} AS DOUBLE)"
        if own and not own.windowed:
            return f"({own.lower(x, [a.value for a in node.args[series:]], self.duck)})", stage
        if not literals and not own and node.op not in ("CMean", "CStd", "LastValue"):
            return self.scalar(node.op, *x), stage
        lits = [a.value for a in node.args[series:]]
        if not all(isinstance(a, Field) for a in node.args[:series]):
            named = [self.put(sql, s) for sql, (_, s) in zip(x, parts)]
            x, stage = [n for n, _ in named], max(s for _, s in named)
        return self.put(own.lower(x, lits, self.duck), stage) if own else self.window(node.op, x, lits, stage)

    @staticmethod
    def scalar(op: str, x: str, y: str = "", z: str = "") -> str:
        both = lambda sql: f"(CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL ELSE {sql} END)"
        return {
            "Abs": lambda: f"abs({x})",
            "Log": lambda: f"(CASE WHEN {x} > 0 THEN ln({x}) END)",
            "Sign": lambda: f"CAST(sign({x}) AS DOUBLE)",
            "Not": lambda: f"(NOT {x})",
            "Add": lambda: f"({x} + {y})",
            "Sub": lambda: f"({x} - {y})",
            "Mul": lambda: f"({x} * {y})",
            "Div": lambda: f"({x} / nullif({y}, 0))",
            "Power": lambda: f"(CASE WHEN {x} > 0 OR {x} = 0 AND {y} >= 0 OR {y} = floor({y}) AND {x} < 0 THEN power({x}, {y}) END)",
            "Greater": lambda: both(f"greatest({x}, {y})"),
            "Less": lambda: both(f"least({x}, {y})"),
            "Gt": lambda: f"({x} > {y})",
            "Lt": lambda: f"({x} < {y})",
            "Ge": lambda: f"({x} >= {y})",
            "Le": lambda: f"({x} <= {y})",
            "Eq": lambda: f"({x} = {y})",
            "Ne": lambda: f"({x} <> {y})",
            "And": lambda: f"({x} AND {y})",
            "Or": lambda: f"({x} OR {y})",
            "If": lambda: f"(CASE WHEN {x} THEN {y} ELSE {z} END)",
        }[op]()

    def window(self, op: str, x: list[str], lits: list[float], stage: int) -> tuple[str, int]:
        a = x[0]
        if op in ("CMean", "CStd", "LastValue"):
            whole = "OVER (PARTITION BY instrument)" if op != "LastValue" else "OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            return self.put(f"{ {'CMean': 'avg', 'CStd': 'stddev_samp', 'LastValue': 'last_value'}[op] }({a}) {whole}", stage)
        n = int(lits[0])
        w = self.over(n)
        if op in ("Ref", "Delta"):
            past = f"lag({a}, {n})" if n >= 0 else f"lead({a}, {-n})"
            name, s = self.put(f"{past} OVER (PARTITION BY instrument ORDER BY date)", stage)
            return (name if op == "Ref" else f"({a} - {name})"), s
        plain = {"Mean": "avg", "Sum": "sum", "Std": "stddev_samp", "Var": "var_samp", "Max": "max", "Min": "min", "Count": "count"}
        if op in plain:
            sql = f"{plain[op]}({a}) {w}"
            return self.put(f"CAST({sql} AS DOUBLE)" if op == "Count" else sql, stage)
        if op in ("Med", "Quantile", "Mad", "Rank") and n and not self.duck:
            _, s0 = self.put(_ROW, 0)
            return self.put(Ordered(op, a, n, lits[1] if op == "Quantile" else 0.5), max(stage, s0))
        if op in ("Med", "Quantile"):
            q = 0.5 if op == "Med" else lits[1]
            return self.put(f"quantile_cont({a}, {q}) {w}" if self.duck else f"percentile({a}, {q}D) {w}", stage)
        if op in ("Skew", "Kurt"):
            m, s = self.put(f"count({a}) {w}", stage)
            v, _ = self.put(f"{'skewness' if op == 'Skew' else 'kurtosis'}({a}) {w}", stage)
            d, _ = self.put(f"var_samp({a}) {w}", stage)
            if op == "Skew":
                body = v if self.duck else f"{v} * sqrt(CAST({m} AS DOUBLE) * ({m} - 1)) / nullif({m} - 2, 0)"
                return f"(CASE WHEN {m} > 2 AND {d} > 1e-14 THEN {body} END)", s
            body = v if self.duck else f"({m} - 1) / nullif(CAST(({m} - 2) * ({m} - 3) AS DOUBLE), 0) * (({m} + 1) * {v} + 6)"
            return f"(CASE WHEN {m} > 3 AND {d} > 1e-14 THEN {body} END)", s
        if op in ("Corr", "Cov"):
            b = x[1]
            cov, s = self.put(f"covar_samp({a}, {b}) {w}", stage)
            if op == "Cov":
                return cov, s
            sa, _ = self.put(f"stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) {w}", stage)
            sb, _ = self.put(f"stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) {w}", stage)
            return f"(CASE WHEN {sa} * {sb} > 1e-12 THEN {cov} / nullif({sa} * {sb}, 0) END)", s
        rn, s0 = self.put(_ROW, 0)
        at, s = self.put(f"(CASE WHEN {a} IS NOT NULL THEN CAST({rn} AS DOUBLE) END)", max(stage, s0))
        if op in ("IdxMax", "IdxMin"):
            if op == "IdxMax":
                pair = f"{{'x': {a}, 'r': {at}}}" if self.duck else f"named_struct('x', {a}, 'r', {at})"
            else:
                pair = f"{{'x': {a}, 'r': -{at}}}" if self.duck else f"named_struct('x', {a}, 'r', -{at})"
            best, t = self.put(f"{'max' if op == 'IdxMax' else 'min'}(CASE WHEN {a} IS NOT NULL THEN {pair} END) {w}", s)
            where = f"{best}.r" if op == "IdxMax" else f"-{best}.r"
            return f"({rn} - ({where}) + 1)", t
        if op in ("Slope", "Rsquare", "Resi"):
            cov, t = self.put(f"covar_samp({a}, {at}) {w}", s)
            vr, _ = self.put(f"var_samp({at}) {w}", s)
            if op == "Slope":
                return f"({cov} / nullif({vr}, 0))", t
            if op == "Rsquare":
                vx, _ = self.put(f"var_samp({a}) {w}", s)
                return f"(CASE WHEN {vx} * {vr} > 1e-14 THEN {cov} * {cov} / nullif({vx} * {vr}, 0) END)", t
            mx, _ = self.put(f"avg({a}) {w}", s)
            mr, _ = self.put(f"avg({at}) {w}", s)
            return f"({a} - {mx} - {cov} / nullif({vr}, 0) * ({rn} - {mr}))", t
        if op == "WMA":
            sxr, t = self.put(f"sum({a} * {at}) {w}", s)
            sx, _ = self.put(f"sum({a}) {w}", s)
            sr, _ = self.put(f"sum({at}) {w}", s)
            m, _ = self.put(f"count({a}) {w}", s)
            back = f"({n} - {rn})" if n else "0"
            return f"(({sxr} + {back} * {sx}) / nullif({sr} + {back} * {m}, 0))", t
        if op in ("Mad", "Rank"):
            xs, t = self.put(f"list({a}) FILTER ({a} IS NOT NULL) {w}" if self.duck else f"collect_list({a}) {w}", s)
            if op == "Mad":
                mx, _ = self.put(f"avg({a}) {w}", s)
                sql = f"list_avg(list_transform({xs}, lambda v: abs(v - {mx})))" if self.duck else f"aggregate({xs}, 0D, (acc, v) -> acc + abs(v - {mx}), acc -> acc / nullif(size({xs}), 0))"
                return self.put(f"({sql})", t)
            size = "len" if self.duck else "size"
            kept = lambda test: f"{size}(list_filter({xs}, lambda v: v {test} {a}))" if self.duck else f"{size}(filter({xs}, v -> v {test} {a}))"
            return self.put(f"(CASE WHEN {a} IS NOT NULL THEN ({kept('<')} + ({kept('=')} + 1) / 2.0D) / nullif({size}({xs}), 0) END)".replace("2.0D", "2.0" if self.duck else "2.0D"), t)
        if op == "EMA":
            return self.ema(a, n, rn, s)
        raise ExpressionError(f"no lowering of {op}")

    def ema(self, a: str, span: int, rn: str, s: int) -> tuple[str, int]:
        """Adjusted exponential mean, weights q^age, q = 1 - 2 / (span + 1); missing rows age too.

        Weights are taken relative to blocks of so many rows that q^rows falls
        below 1e-17: running sums stay in range for any length, and
        only the block before can still count.
        """
        q = 1 - 2 / (span + 1)
        if q <= 0:
            return a, s
        block = max(2, math.ceil(-17 * math.log(10) / math.log(q)))
        i, t = self.put(f"CAST(({rn} - 1) % {block} AS DOUBLE)", s)
        b, _ = self.put(f"floor(({rn} - 1) / {float(block)!r})", s)
        t = max(t, s + 1)  # the block may be known from an earlier stage than the values
        inner = f"OVER (PARTITION BY instrument, {b} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        num, u = self.put(f"sum({a} * power({q!r}, -{i})) {inner}", t)
        den, _ = self.put(f"sum(CASE WHEN {a} IS NOT NULL THEN power({q!r}, -{i}) END) {inner}", t)
        before = "OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ends = [f"CASE WHEN {i} = {block - 1} THEN coalesce({c}, 0) END" for c in (num, den)]
        last = [f"last_value({e} IGNORE NULLS)" if self.duck else f"last_value({e}) IGNORE NULLS" for e in ends]
        pn, v = self.put(f"{last[0]} {before}", u)
        pd, _ = self.put(f"{last[1]} {before}", u)
        far = q**block
        return f"((coalesce({num}, 0) + coalesce({pn}, 0) * {far!r}) / nullif(coalesce({den}, 0) + coalesce({pd}, 0) * {far!r}, 0))", v


def _compiled(exprs: dict[str, str], duck: bool) -> tuple[_Lowering, dict[str, str]]:
    low = _Lowering(duck)
    final = {}
    for name, text in exprs.items():
        node = parse(text)
        check(node)
        sql, _ = low.lower(node)
        final[name] = f"CAST({sql} AS DOUBLE)" if is_bool(node) else sql
    return low, final


def compile_panel(panel: DataFrame, exprs: dict[str, str], keep: tuple[str, ...] = ("instrument", "date")) -> DataFrame:
    """``keep`` columns of ``panel`` and one column per named expression.

    Only the fields that the expressions name are read.
    """
    low, final = _compiled(exprs, False)
    used = sorted(set().union(*(fields(parse(t)) for t in exprs.values())))
    missing = [f for f in used if f not in panel.columns]
    if missing:
        raise ExpressionError(f"no such fields: {missing}")
    df = panel.select(*dict.fromkeys(["instrument", "date", *keep, *used]))
    # order statistics wait until a window reads one: the windows before share the exchange that they need
    waiting: dict[str, Ordered] = {}
    for stage in low.stages:
        columns = {n: x for n, x in stage.items() if isinstance(x, str)}
        asked = {n: x for n, x in stage.items() if isinstance(x, Ordered)}
        read = set(re.findall(r"\bw\d+_\b", " ".join([*columns.values(), *(x.column for x in asked.values())])))
        if read & waiting.keys():
            df, waiting = rolling_order(df, waiting, low.known[_ROW][0]), {}
        if columns:
            df = df.select("*", *(F.expr(sql).alias(name) for name, sql in columns.items()))
        waiting |= asked
    if waiting:
        df = rolling_order(df, waiting, low.known[_ROW][0])
    return df.select(*keep, *(F.expr(sql).alias(name) for name, sql in final.items()))


def panel_sql(source: str, exprs: dict[str, str], digits: int | None = None, keep: tuple[str, ...] = ("instrument", "date")) -> str:
    """The same as DuckDB SQL over the query ``source``, for checks."""
    low, final = _compiled(exprs, True)
    sql = f"({source})"
    for stage in low.stages:
        sql = f"(select *, {', '.join(f'{s} as {n}' for n, s in stage.items())} from {sql})"
    out = [f"round({s}, {digits}) as {n}" if digits is not None else f"{s} as {n}" for n, s in final.items()]
    return f"select {', '.join([*keep, *out])} from {sql}"
