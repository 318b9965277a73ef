"""Means and co-moments of numbers by configurations of states: linear Gaussians and their scores without a pass over the data for each."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import quoted, state
from .cpd import COLLINEAR, ConditionalLinearGaussianCPD, LinearGaussianCPD

#: Types of columns that hold states, and families and numbers that one job brings to the driver.
WHOLE, BATCH, ENTRIES = ("tinyint", "smallint", "int", "bigint"), 500, 1 << 22


class Moments:
    """Of a set of discrete variables: for each configuration with rows (`cell`, from 0, the first variable fastest) its number of
    rows, the means of all numbers and the sums of their centred products."""

    def __init__(self, states: Sequence[str], numbers: Sequence[str], sizes: Mapping[str, int], cell, n, mean, co):
        self.states, self.numbers, self.sizes = tuple(states), list(numbers), dict(sizes)
        self.cell, self.n, self.mean, self.co = cell, n, mean, co

    @property
    def whole(self) -> bool:
        """Whether every configuration has rows."""
        return len(self.cell) == prod(self.sizes[s] for s in self.states)

    def over(self, states: Sequence[str]) -> Moments:
        """By fewer variables: groups are merged."""
        digit, step = {}, 1
        for s in self.states:
            digit[s], step = self.cell // step % self.sizes[s], step * self.sizes[s]
        to, step = np.zeros(len(self.cell), np.int64), 1
        for s in states:
            to, step = to + digit[s] * step, step * self.sizes[s]
        cell, own = np.unique(to, return_inverse=True)
        k = len(self.numbers)
        n, mean, co = np.zeros(len(cell)), np.zeros((len(cell), k)), np.zeros((len(cell), k, k))
        np.add.at(n, own, self.n)
        np.add.at(mean, own, self.n[:, None] * self.mean)
        mean /= n[:, None]
        far = self.mean - mean[own]
        np.add.at(co, own, self.co + self.n[:, None, None] * far[:, :, None] * far[:, None, :])
        return Moments(states, self.numbers, self.sizes, cell, n, mean, co)

    def solved(self, name: str, xs: Sequence[str]):
        """(slopes, intercepts, own deviations, squared residuals) by configuration; None where a configuration has no rows or
        collinear predictors."""
        at, y = [self.numbers.index(x) for x in xs], self.numbers.index(name)
        if not self.whole or not len(self.cell):
            return None
        cxx, cxy, cyy = self.co[:, at][:, :, at], self.co[:, at, y], self.co[:, y, y]
        scale = np.sqrt(np.diagonal(cxx, axis1=1, axis2=2))
        if not (scale > 0).all():
            return None
        r = cxx / scale[:, :, None] / scale[:, None, :]
        if at and not (np.linalg.eigvalsh(r) > COLLINEAR).all():
            return None
        slopes = np.linalg.solve(r, (cxy / scale)[:, :, None])[:, :, 0] / scale if at else np.zeros((len(self.n), 0))
        left = np.maximum(0.0, cyy - (slopes * cxy).sum(1))
        return slopes, self.mean[:, y] - (slopes * self.mean[:, at]).sum(1), np.sqrt(np.maximum(0.0, cyy) / np.maximum(1, self.n - 1)), left

    def bic(self, name: str, xs: Sequence[str]) -> float:
        """Negative BIC of a linear Gaussian for each configuration, each with the target's own deviation; -inf where one can't be
        fitted or has a constant target."""
        found = self.solved(name, xs)
        if found is None or not (found[2] > 0).all():
            return float("-inf")
        _, _, sd, left = found
        logs = -self.n * (math.log(2 * math.pi) / 2 + np.log(sd)) - left / (2 * sd * sd)
        return float(2 * logs.sum() - len(self.n) * (len(xs) + 2) * math.log(self.n.sum()))

    def cpd(self, name: str, xs: Sequence[str], conditional: bool, min_stdev: float = 0.0, residual_sigma: bool = False):
        """The fitted distribution; ValueError where `solved` has none."""
        found = self.solved(name, xs)
        if found is None:
            seen = set(self.cell.tolist())
            missing = [q + 1 for q in range(prod(self.sizes[s] for s in self.states)) if q not in seen][:20]
            raise ValueError(f"{name}: no rows for configurations {missing} of {list(self.states)}" if missing else f"{name}: {list(xs)} are collinear")
        slopes, b, sd, left = found
        if residual_sigma and not conditional:
            sd = np.sqrt(left / np.maximum(1, self.n - len(xs) - 1))
        models = [LinearGaussianCPD(name, xs, slopes[g].tolist(), float(b[g]), max(min_stdev, float(sd[g]))) for g in range(len(self.n))]
        return ConditionalLinearGaussianCPD(name, self.states, [self.sizes[s] for s in self.states], xs, models) if conditional else models[0]


def moments(df: DataFrame, numbers: Sequence[str], wanted: Sequence[tuple[Sequence[str], Sequence[str]]], sizes: Mapping[str, int]) -> Iterator[Moments]:
    """For each pair (states, own) the moments of all numbers by those states, over rows with no null in the states or in `own`.

    Each row is dealt out to its configuration in every set, and tasks merge moments before anything is shuffled. One job serves
    as many sets as bring ENTRIES numbers to the driver, and BATCH sets at most; those of one job are held at a time.
    """
    cols, states = list(numbers), sorted({s for ss, _ in wanted for s in ss})
    x, s = {c: f"x{i}" for i, c in enumerate(cols)}, {c: f"s{i}" for i, c in enumerate(states)}
    rows = df.select(*(F.col(quoted(c)).cast("double").alias(a) for c, a in x.items()), *(state(c, sizes[c]).cast("long").alias(a) for c, a in s.items()))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    aggs = [F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(len(cols))), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs)]

    def number(ss, own) -> str:
        step, terms = 1, ["0L"]
        for c in ss:
            terms, step = [*terms, f"({s[c]} - 1) * {step}L"], step * sizes[c]
        held = " AND ".join(f"{x[c]} IS NOT NULL" for c in own) or "TRUE"
        return f"CASE WHEN {held} THEN {' + '.join(terms)} END"

    todo = list(wanted)
    while todo:
        batch, entries = [], 0
        while todo and len(batch) < BATCH:
            entries += prod(sizes[c] for c in todo[0][0]) * len(aggs)
            if batch and entries > ENTRIES:
                break
            batch.append(todo.pop(0))
        dealt = rows.select(*x.values(), F.posexplode(F.expr(f"array({', '.join(number(*w) for w in batch)})")).alias("at", "cell")).filter("cell IS NOT NULL")
        found = dealt.groupBy("at", "cell").agg(*aggs).toPandas().sort_values(["at", "cell"])
        for i, (ss, _) in enumerate(batch):
            own = found[found["at"] == i]
            n, co = own["n"].to_numpy(float), np.zeros((len(own), len(cols), len(cols)))
            for a, b in pairs:
                co[:, a, b] = co[:, b, a] = own[f"c{a}_{b}"].to_numpy(float) * n
            mean = own[[f"m{a}" for a in range(len(cols))]].to_numpy(float)
            yield Moments(ss, cols, {c: sizes[c] for c in ss}, own["cell"].to_numpy(np.int64), n, mean, co)


def split(df: DataFrame, parents: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(states, numbers) by the columns' types; other types raise TypeError."""
    kinds = dict(df.dtypes)
    if other := [p for p in parents if kinds[p] not in WHOLE and kinds[p] not in ("float", "double") and not kinds[p].startswith("decimal")]:
        raise TypeError(f"{other}: parents are whole numbers or floating-point ones")
    return tuple(p for p in parents if kinds[p] in WHOLE), tuple(p for p in parents if kinds[p] not in WHOLE)
