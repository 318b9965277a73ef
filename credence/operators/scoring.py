"""Scores of structures. Each is a sum over families, and a batch of families is scored in one pass over the data."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.math import lgamma
from ..plans.graph import DAG
from .counts import Contingency, Family, cardinalities, cells, counted, families
from .cpd import CPD
from .factor import BROADCAST_CELLS


class DirichletPrior(ABC):
    """Pseudo-counts of a family's cells, equal in all unless `cells` gives others."""

    @abstractmethod
    def for_table(self, r: int) -> float:
        """Of each state of a target with r states, whatever its parents."""

    @abstractmethod
    def for_family(self, r: int, q: int) -> float:
        """Of each cell of a family with q configurations."""

    def cells(self, r: int, q: int) -> Sequence[Sequence[float]] | None:
        """A row of r pseudo-counts for each of q configurations, where they differ; None where the number of for_family holds in all."""
        return None


class CellPrior(DirichletPrior):
    """Pseudo-counts given cell by cell: a function of (r, q), or one table of q rows for families of its shape."""

    def __init__(self, cells):
        self.given = cells

    def for_table(self, r):
        raise ValueError("pseudo-counts differ by cell: ask for cells(r, q)")

    def for_family(self, r, q):
        raise ValueError("pseudo-counts differ by cell: ask for cells(r, q)")

    def cells(self, r, q):
        rows = self.given(r, q) if callable(self.given) else self.given
        if len(rows) != q or any(len(x) != r for x in rows):
            raise ValueError(f"{q} rows of {r} pseudo-counts are needed")
        return rows


class UniformPrior(DirichletPrior):
    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def __repr__(self):
        return f"UniformPrior({self.alpha:g})"

    def for_table(self, r):
        return self.alpha

    def for_family(self, r, q):
        return self.alpha


class BDeuPrior(DirichletPrior):
    """A sample of x rows spread over all cells of a family."""

    def __init__(self, x: float = 1.0):
        self.x = x

    def __repr__(self):
        return f"BDeuPrior({self.x:g})"

    def for_table(self, r):
        return self.x / r

    def for_family(self, r, q):
        return self.x / (r * q)


class ScoringFunction(ABC):
    """Scores a fitted distribution on data."""

    @abstractmethod
    def component(self, cpd: CPD, df: DataFrame) -> float: ...

    def components(self, cpds: Sequence[CPD], df: DataFrame) -> list[float]:
        """Of several distributions; one by one unless a score knows better."""
        return [self.component(c, df) for c in cpds]


class NegativeBIC(ScoringFunction):
    """Twice the log likelihood less ln(rows) for each parameter."""

    def component(self, cpd, df):
        return self.components([cpd], df)[0]

    def components(self, cpds, df):
        """All in one pass over the data."""
        *logs, n = df.agg(*(F.sum(c.log_col()).alias(f"l{i}") for i, c in enumerate(cpds)), F.count("*").alias("n")).first()
        return [2 * s - c.nparams * math.log(n) for c, s in zip(cpds, logs, strict=True)]


def _batched(joint: DataFrame, wanted: Sequence[Family], sizes: Mapping[str, int], params, term) -> dict[Family, float]:
    """For each family the sum of a term over its cells, less that over its configurations. params(family) gives a number for each of
    the two, which the term gets with the count. Observed cells alone are visited: absent ones add nothing. All in one job."""
    if not wanted:
        return {}
    rows = []
    for i, (t, ps) in enumerate(wanted):
        cell, conf = params((t, ps))
        rows.append((i, max(1, sizes[t]), float(cell), math.lgamma(cell) if cell else 0.0, float(conf), math.lgamma(conf) if conf else 0.0))
    roles = joint.sparkSession.createDataFrame(rows, "family int, r long, x double, gx double, y double, gy double")  # a row a family
    at = cells(joint, wanted, sizes).withColumn("n", F.col("n").cast("double")).join(F.broadcast(roles), "family")
    by = at.groupBy("family", F.expr("cell div r").alias("q")).agg(F.sum(term(F.col("n"), F.col("x"), F.col("gx"))).alias("s"), F.sum("n").alias("n"), F.first("y").alias("y"), F.first("gy").alias("gy"))
    summed = by.groupBy("family").agg(F.sum(F.col("s") - term(F.col("n"), F.col("y"), F.col("gy"))).alias("s"))
    found = {r["family"]: r["s"] for r in summed.collect()}
    return {f: found.get(i, 0.0) for i, f in enumerate(wanted)}


def _by_cells(joint: DataFrame, wanted: Mapping[Family, Sequence[Sequence[float]]], sizes: Mapping[str, int]) -> dict[Family, float]:
    """The same for families with a pseudo-count of its own in each cell, all in one job. The counts meet a table of pseudo-counts."""
    rows = [(i, q * len(row) + k, q, float(a), float(sum(row))) for i, table in enumerate(wanted.values()) for q, row in enumerate(table) for k, a in enumerate(row)]
    alphas = joint.sparkSession.createDataFrame(rows, "family int, cell long, q int, a double, total double")
    met = cells(joint, list(wanted), sizes).withColumn("n", F.col("n").cast("double")).join(F.broadcast(alphas) if len(rows) <= BROADCAST_CELLS else alphas, ["family", "cell"])
    by = met.groupBy("family", "q").agg(F.sum(lgamma(F.col("n") + F.col("a")) - lgamma(F.col("a"))).alias("s"), F.sum("n").alias("n"), F.first("total").alias("total"))
    found = by.groupBy("family").agg(F.sum(F.col("s") + lgamma(F.col("total")) - lgamma(F.col("n") + F.col("total"))).alias("s"))
    found = {r["family"]: r["s"] for r in found.collect()}
    return {f: found.get(i, 0.0) for i, f in enumerate(wanted)}


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _marginal(n: np.ndarray, prior: DirichletPrior) -> float:
    """Log marginal likelihood of one family's counts, states by configuration."""
    q, r = n.shape
    given = prior.cells(r, q)
    a = np.array(given, float) if given is not None else np.full((q, r), prior.for_family(r, q))
    seen = n.sum(1) > 0
    n, a = n[seen], a[seen]
    return float((_lgamma(n + a) - _lgamma(a)).sum() + (_lgamma(a.sum(1)) - _lgamma((n + a).sum(1))).sum()) if len(n) else 0.0


def bayesian_components(joint: DataFrame | Contingency, wanted: Sequence[Family], sizes: Mapping[str, int], prior: DirichletPrior) -> dict[Family, float]:
    """Log marginal likelihoods of families, from rows with their number `n` or from a table on the driver."""
    if isinstance(joint, Contingency):
        return {f: _marginal(joint.counts(f), prior) for f in wanted}
    uneven = {f: a for f in wanted if (a := prior.cells(sizes[f[0]], prod(sizes[p] for p in f[1]))) is not None}
    if uneven:
        even = [f for f in wanted if f not in uneven]
        return _by_cells(joint, uneven, sizes) | (bayesian_components(joint, even, sizes, prior) if even else {})

    def alphas(f: Family) -> tuple[float, float]:
        r, q = sizes[f[0]], prod(sizes[p] for p in f[1])
        a = prior.for_family(r, q)
        return a, r * a

    return _batched(joint, wanted, sizes, alphas, lambda n, x, gx: lgamma(n + x) - gx)


def bic_components(joint: DataFrame | Contingency, wanted: Sequence[Family], sizes: Mapping[str, int], rows: int) -> dict[Family, float]:
    """Negative BIC of discrete families: counts alone decide. A category of each configuration counts as a parameter, the last one too."""
    if isinstance(joint, Contingency):
        spread = lambda n: float((n[n > 0] * np.log(n[n > 0])).sum())
        fit = {f: spread(n) - spread(n.sum(1)) for f in wanted for n in [joint.counts(f)]}
    else:
        fit = _batched(joint, wanted, sizes, lambda f: (0.0, 0.0), lambda n, x, gx: n * F.ln(n))
    return {f: 2 * s - math.log(rows) * sizes[f[0]] * prod(sizes[p] for p in f[1]) for f, s in fit.items()}


class ScoreCache:
    """Scores of families that were asked for before; a batch computes the others in one job."""

    def __init__(self, compute):
        self.compute, self.known = compute, {}

    def __call__(self, wanted: Sequence[Family]) -> list[float]:
        key = lambda f: (f[0], tuple(sorted(f[1])))
        new = list(dict.fromkeys(key(f) for f in wanted if key(f) not in self.known))
        if new:  # most lookups are of known families: they build no expressions
            self.known |= self.compute(new)
        return [self.known[key(f)] for f in wanted]


def bayesian_score(df: DataFrame, dag: DAG, prior: DirichletPrior | None = None, sizes: Mapping[str, int] | None = None) -> float:
    """Of a structure over the data's columns of those names."""
    sizes = sizes or cardinalities(df, dag.names)
    joint = counted(df, dag.names, sizes).persist()
    try:
        return sum(bayesian_components(joint, [(c, tuple(ps)) for c, ps in families(dag).items()], sizes, prior or UniformPrior()).values())
    finally:
        joint.unpersist()


def score_components(scoring: ScoringFunction, cpds: Sequence[CPD], df: DataFrame) -> list[float]:
    return scoring.components(cpds, df)
