"""Genetic search over panel expressions.

Trees are bred on the driver; a whole generation is scored by Spark in one
pass: all new expressions become columns of one plan (sharing their common
parts), are turned long, and get their rank correlations from one grouping.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.cross import information_coefficients
from tidepanel.operators.gram import correlation_pairs
from tidepanel.plans.expression import Call, ExpressionError, Field, Node, Num, check, compile_panel, parse
from tidepanel.sources.files import written

_UNARY = ("Abs", "Sign")
_BINARY = ("Add", "Sub", "Mul", "Div", "Greater", "Less")
_WINDOW = ("Ref", "Mean", "Sum", "Std", "Max", "Min", "Delta", "WMA", "EMA", "Rank", "Slope")
_PAIR = ("Corr", "Cov")
WINDOWS = (3, 5, 10, 20)


def depth(node: Node) -> int:
    return 1 + max((depth(a) for a in node.args), default=0) if isinstance(node, Call) else 0


def complexity(node: Node) -> str:
    """``simple``: one field at most, two levels of operators at most and one window at most; ``compound``: anything else."""

    def parts(n: Node) -> tuple[set[str], int]:
        if not isinstance(n, Call):
            return ({n.name} if isinstance(n, Field) else set()), 0
        fields, windows = set(), int(n.op in (*_WINDOW, *_PAIR, "Var", "Skew", "Kurt", "Quantile", "Med", "Mad", "Count", "Rsquare", "Resi"))
        for arg in n.args:
            f, w = parts(arg)
            fields, windows = fields | f, windows + w
        return fields, windows

    fields, windows = parts(node)
    return "simple" if len(fields) <= 1 and depth(node) <= 2 and windows <= 1 else "compound"


def grow(r: random.Random, terminals: list[Node], levels: int) -> Node:
    """A random expression that passes the rules for generated ones."""
    if levels == 0 or r.random() < 0.15:
        return r.choice(terminals)
    kind = r.random()
    sub = lambda: grow(r, terminals, levels - 1)
    if kind < 0.12:
        return Call(r.choice(_UNARY), (sub(),))
    if kind < 0.5:
        return Call(r.choice(_BINARY), (sub(), sub()))
    if kind < 0.88:
        return Call(r.choice(_WINDOW), (sub(), Num(float(r.choice(WINDOWS)))))
    return Call(r.choice(_PAIR), (sub(), sub(), Num(float(r.choice(WINDOWS[1:])))))


def _places(node: Node, at: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    out = [at]
    if isinstance(node, Call):
        for i, a in enumerate(node.args):
            if not isinstance(a, Num):
                out += _places(a, (*at, i))
    return out


def _get(node: Node, at: tuple[int, ...]) -> Node:
    return _get(node.args[at[0]], at[1:]) if at else node


def _put(node: Node, at: tuple[int, ...], new: Node) -> Node:
    if not at:
        return new
    return Call(node.op, tuple(_put(a, at[1:], new) if i == at[0] else a for i, a in enumerate(node.args)))


def cross(r: random.Random, a: Node, b: Node) -> Node:
    return _put(a, r.choice(_places(a)), _get(b, r.choice(_places(b))))


def mutate(r: random.Random, a: Node, terminals: list[Node]) -> Node:
    return _put(a, r.choice(_places(a)), grow(r, terminals, 2))


def score_batch(panel: DataFrame, exprs: list[str], label: str, most_missing: float = 0.5) -> dict[str, float]:
    """|mean rank correlation with the label| of each expression, from one scan, written once; 0 where too much is missing."""
    if not exprs:
        return {}
    named = {f"e{i}": e for i, e in enumerate(exprs)}
    p = written(compile_panel(panel, named | {"label": label}), "generation")
    long = p.unpivot(["date", "label"], list(named), "expr", "f")
    seen = long.groupBy("expr").agg(F.avg(F.col("f").isNull().cast("double")).alias("gone"), F.stddev_samp("f").alias("sd"))
    ic = information_coefficients(long, "f", "label", ["expr", "date"]).groupBy("expr").agg(F.abs(F.avg("ric")).alias("fit"))
    rows = seen.join(ic, "expr", "left").collect()  # one row per expression of the generation
    return {named[r["expr"]]: (r["fit"] or 0.0) if r["gone"] <= most_missing and (r["sd"] or 0) > 1e-5 else 0.0 for r in rows}


@dataclass
class Search:
    """Islands of expressions that breed, compete and pass their best along a ring."""

    panel: DataFrame
    label: str
    terminals: list[str]
    islands: int = 3
    size: int = 20
    height: int = 6
    penalty: float = 0.005
    seed: int = 0
    known: dict[str, float] = field(default_factory=dict)
    generation: int = 0

    def __post_init__(self) -> None:
        self.random = random.Random(self.seed)
        self.leaves = [parse(t) if not t.startswith("$") else Field(t[1:]) for t in self.terminals]
        self.people = [[grow(self.random, self.leaves, 3) for _ in range(self.size)] for _ in range(self.islands)]

    def valid(self, node: Node) -> bool:
        try:
            check(node, search=True)
        except ExpressionError:
            return False
        return depth(node) <= self.height

    def score(self) -> None:
        """Work out the fitness of all expressions not seen before, in one batch."""
        todo = sorted({str(n) for own in self.people for n in own if self.valid(n)} - set(self.known))
        fit = score_batch(self.panel, todo, self.label)
        self.known |= {e: fit[e] - self.penalty * depth(parse(e)) if fit.get(e) else 0.0 for e in todo}

    def fitness(self, node: Node) -> float:
        return self.known.get(str(node), 0.0)

    def step(self) -> None:
        r = self.random
        for i, own in enumerate(self.people):
            pick = lambda own=own: max(r.sample(own, 3), key=self.fitness)
            best = max(own, key=self.fitness)
            young = [best]
            while len(young) < self.size:
                child = cross(r, pick(), pick()) if r.random() < 0.6 else mutate(r, pick(), self.leaves)
                young.append(child if self.valid(child) else pick())
            self.people[i] = young
        self.score()

    def migrate(self, n: int = 2) -> None:
        """The best of each island replace the worst of the next."""
        best = [sorted(own, key=self.fitness, reverse=True)[:n] for own in self.people]
        for i, own in enumerate(self.people):
            self.people[i] = sorted(own, key=self.fitness, reverse=True)[: self.size - n] + best[i - 1]

    def save(self, path: str) -> None:
        """Write the search's state, one line of text, where any later driver can read it."""
        state = {"people": [[str(n) for n in own] for own in self.people], "known": self.known, "random": [self.random.getstate()[0], list(self.random.getstate()[1]), self.random.getstate()[2]], "generation": self.generation}
        self.panel.sparkSession.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def load(self, path: str) -> None:
        """Go on from what ``save`` wrote."""
        state = json.loads(self.panel.sparkSession.read.text(path).first()[0])
        self.people = [[parse(e) for e in own] for own in state["people"]]
        self.known, self.generation = state["known"], state["generation"]
        kind, numbers, rest = state["random"]
        self.random.setstate((kind, tuple(numbers), rest))

    def run(self, generations: int = 5, migrate_every: int = 2) -> list[tuple[str, float]]:
        """(expression, fitness), best first; a loaded search makes the generations that are left."""
        self.score()
        for g in range(self.generation + 1, generations + 1):
            self.generation = g
            self.step()
            if g % migrate_every == 0:
                self.migrate()
        return sorted(((e, f) for e, f in self.known.items() if f > 0), key=lambda x: -x[1])


def correlations(panel: DataFrame, exprs: list[str], where: Column | None = None) -> np.ndarray:
    """|correlation| of all pairs of expressions, from one pass over the panel; 0 where there is none.  A number for each pair is the driver's."""
    out = np.zeros((len(exprs), len(exprs)))
    if len(exprs) > 1:
        p = compile_panel(panel, {f"e{i}": e for i, e in enumerate(exprs)})
        told = correlation_pairs(p if where is None else p.where(where), [f"e{i}" for i in range(len(exprs))]).where("corr is not null").toPandas()
        out[told["a"], told["b"]] = out[told["b"], told["a"]] = told["corr"].abs()
    return out


def uncorrelated(panel: DataFrame, ranked: list[str], most: float = 0.7, where: Column | None = None) -> list[str]:
    """Go down the ranking and keep what correlates below ``most`` with all kept so far."""
    c = correlations(panel, ranked, where)
    kept: list[int] = []
    for i in range(len(ranked)):
        if all(c[i, j] < most for j in kept):
            kept.append(i)
    return [ranked[i] for i in kept]
