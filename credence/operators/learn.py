"""Parameters and structures learned from data. Searches run on the driver over scores of counts; the data is read once."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import DAG
from .counts import Contingency, cardinalities, config, counted, family_counts, quoted
from .cpd import CategoricalCPD, ConditionalLinearGaussianCPD, CPD, DiscreteCPD, LinearGaussianCPD, StaticCPD
from .distributions import Distribution, Normal
from .moments import ENTRIES, moments, split
from .network import BayesNet
from .scoring import DirichletPrior, NegativeBIC, ScoreCache, ScoringFunction, UniformPrior, bayesian_components, bic_components

#: Gains below this are ties: the first candidate stays.
TIE = 1e-9
#: Static and categorical nodes that one job fits.
NODES = 500


def _tables(rows: DataFrame, dag: DAG, sizes: Mapping[str, int], prior: DirichletPrior | None) -> BayesNet:
    """Every node's table from rows with their number `n`, all in one job; cells without rows aren't sent."""
    return fit_counts(family_counts(rows, dag, sizes), dag, sizes, prior)


def fit_counts(found: DataFrame, dag: DAG, sizes: Mapping[str, int], prior: DirichletPrior | None = None) -> BayesNet:
    """Every node's table from counts of cells (target, q, k, n), as counts.family_counts gives them."""
    tables = {n: np.zeros((prod(sizes[p] for p in dag.parents(n)), sizes[n])) for n in dag.names}
    for r in found.collect():
        tables[r["target"]][r["q"] - 1, r["k"] - 1] = r["n"]
    return BayesNet(DiscreteCPD.of_counts(n, tables[n], dag.parents(n), [sizes[p] for p in dag.parents(n)], prior) for n in dag.topological())


def fit_network(df: DataFrame, dag: DAG, kinds: type[CPD] | Mapping[str, type[CPD]] = DiscreteCPD, prior: DirichletPrior | None = None, **options) -> BayesNet:
    """Fit every node of the DAG by name; kinds: one for all, or one by name. Tables are counted in one job, linear Gaussians solved
    from the moments of another, static and categorical nodes of a family with moments fitted in a third; each other kind is fitted
    by itself. A row with a null among a node's variables isn't counted there."""
    if missing := set(dag.names) - set(df.columns):
        raise ValueError(f"the data lacks {sorted(missing)}")
    kind = (lambda n: kinds[n]) if isinstance(kinds, Mapping) else (lambda n: kinds)
    discrete = [n for n in dag.names if kind(n) is DiscreteCPD]
    if len(discrete) == len(dag.names):
        sizes = dict(options.get("ncategories") or cardinalities(df, dag.names))
        return _tables(counted(df, dag.names, sizes), dag, sizes, prior)
    linear = [n for n in dag.names if kind(n) in GAUSSIAN]
    found = _gaussians(df, {n: dag.parents(n) for n in linear}, kind, options.get("parent_sizes"), **{k: options[k] for k in ("min_stdev", "residual_sigma") if k in options})
    tabled = [n for n in discrete if set(dag.parents(n)) <= set(discrete)]
    if tabled:
        part = DAG(tabled, [(p, c) for c in tabled for p in dag.parents(c)])
        sizes = dict(options.get("ncategories") or cardinalities(df, part.names))
        found |= _tables(counted(df, part.names, sizes), part, sizes, prior).cpds
    family, parent_sizes = options.get("family", Normal), options.get("parent_sizes") or {}
    if family.fit.__func__ is Distribution.fit.__func__ and isinstance(parent_sizes, Mapping):
        found |= _by_configuration(df, {n: dag.parents(n) for n in dag.names if kind(n) in (StaticCPD, CategoricalCPD)}, kind, family, parent_sizes)
    return BayesNet(found.get(n) or kind(n).fit(df, n, dag.parents(n), prior=prior, **options) for n in dag.topological())


def _by_configuration(df: DataFrame, parents: Mapping[str, Sequence[str]], kind, family: type[Distribution], parent_sizes: Mapping[str, int]) -> dict[str, CPD]:
    """One family for the targets of several nodes, by configuration of their parents or, for static nodes, over all rows.

    Each row is dealt out to its configuration in every node, and tasks add up the family's moments before anything is shuffled:
    one job for NODES nodes. A configuration without a value raises ValueError.
    """
    out, nodes = {}, list(parents)
    own = {n: () if kind(n) is StaticCPD else tuple(parents[n]) for n in nodes}
    states = sorted({p for ps in own.values() for p in ps})
    sizes = dict(parent_sizes)
    sizes |= cardinalities(df, rest) if (rest := [p for p in states if p not in sizes]) else {}
    for begin in range(0, len(nodes), NODES):
        part = nodes[begin : begin + NODES]
        cells = F.array(*(F.struct(config(own[n], sizes).cast("long").alias("q"), F.col(quoted(n)).cast("double").alias("x")) for n in part))
        dealt = df.select(F.posexplode(cells).alias("at", "cell")).select("at", "cell.*").filter("q IS NOT NULL AND x IS NOT NULL")
        found = {(r["at"], r["q"]): r.asDict() for r in dealt.groupBy("at", "q").agg(*(v.alias(k) for k, v in family.moments(F.col("x")).items())).collect()}
        for i, n in enumerate(part):
            configs = prod(sizes[p] for p in own[n])
            if missing := [q for q in range(1, configs + 1) if (i, q) not in found]:
                raise ValueError(f"{n}: no rows for configurations {missing[:20]} of {list(own[n])}" if own[n] else f"{n}: no values")
            dists = [family.of(found[i, q]) for q in range(1, configs + 1)]
            out[n] = StaticCPD(n, dists[0], parents[n]) if kind(n) is StaticCPD else CategoricalCPD(n, own[n], [sizes[p] for p in own[n]], dists)
    return out


#: Kinds that moments decide.
GAUSSIAN = (LinearGaussianCPD, ConditionalLinearGaussianCPD)


def _gaussians(df: DataFrame, parents: Mapping[str, Sequence[str]], kind, parent_sizes: Mapping[str, int] | None = None, **options) -> dict[str, CPD]:
    """Linear Gaussians of several nodes in one job. A plain one takes its parents as numbers, whatever their type."""
    if not parents:
        return {}
    parts = {n: ((), tuple(ps)) if kind(n) is LinearGaussianCPD else split(df, ps) for n, ps in parents.items()}
    states = sorted({s for ss, _ in parts.values() for s in ss})
    sizes = dict(parent_sizes or {})
    sizes |= cardinalities(df, rest) if (rest := [s for s in states if s not in sizes]) else {}
    numbers = sorted({x for n, (_, xs) in parts.items() for x in (n, *xs)})
    found = moments(df, numbers, [(ss, (n, *xs)) for n, (ss, xs) in parts.items()], sizes)
    return {n: m.cpd(n, xs, kind(n) is ConditionalLinearGaussianCPD, **options) for (n, (_, xs)), m in zip(parts.items(), found, strict=True)}


def fit_edges(df: DataFrame, edges: Sequence[tuple[str, str]] | tuple[str, str], kinds=DiscreteCPD, names: Sequence[str] | None = None, **options) -> BayesNet:
    """The same from pairs (parent, child), or from a single pair."""
    pairs = [edges] if edges and isinstance(edges[0], str) else list(edges)
    return fit_network(df, DAG(names or df.columns, pairs), kinds, **options)


class GraphSearch(ABC):
    """Finds a structure and fits it. New strategies subclass this."""

    @abstractmethod
    def fit(self, df: DataFrame, **options) -> BayesNet: ...


def search(df: DataFrame, strategy: GraphSearch, **options) -> BayesNet:
    if not isinstance(strategy, GraphSearch):
        raise NotImplementedError(f"{type(strategy).__name__} is no search strategy")
    return strategy.fit(df, **options)


@dataclass
class K2GraphSearch(GraphSearch):
    """For each node of an order the best set of up to max_parents predecessors, small sets first; a larger one must score better.

    Discrete nodes are scored from counts, all candidates of a node in one job; linear Gaussians from means and co-moments by
    configuration of the discrete predecessors, all candidates of all nodes in one job, over rows without a null in any of the
    order's variables. A set with an unseen configuration or collinear numbers can't win. Other kinds are fitted one by one.
    """

    order: Sequence[str]
    kinds: type[CPD] | Mapping[str, type[CPD]] = DiscreteCPD
    max_parents: int = 3
    scoring: ScoringFunction = field(default_factory=NegativeBIC)

    def __post_init__(self):
        kinds = self.kinds.values() if isinstance(self.kinds, Mapping) else [self.kinds]
        if bad := [k.__name__ for k in kinds if k in (CategoricalCPD, StaticCPD)]:
            raise ValueError(f"{bad} need a family of distributions; use a kind that names one")

    def fit(self, df, **options):
        kind = (lambda n: self.kinds[n]) if isinstance(self.kinds, Mapping) else (lambda n: self.kinds)
        numbers = [n for n in self.order if kind(n) is DiscreteCPD]
        sizes = (options.get("ncategories") or cardinalities(df, numbers)) if numbers else {}
        joint = counted(df, numbers, sizes).persist() if numbers else None
        try:
            rows = df.count()
            table = Contingency(joint, numbers, sizes) if numbers and Contingency.fits(numbers, sizes) else joint
            dag, fitted, sets = DAG(self.order), {}, {}
            for i, n in enumerate(self.order):
                may = [p for p in self.order[:i] if kind(n) is not DiscreteCPD or p in numbers]
                sets[n] = [ps for k in range(min(self.max_parents, len(may)) + 1) for ps in combinations(may, k)]
            linear = {n: sets[n] for n in self.order if kind(n) in GAUSSIAN and type(self.scoring) is NegativeBIC}
            known, chosen = self._from_moments(df.dropna(subset=list(self.order)), linear, kind, sizes) if linear else ({}, None)
            for n in self.order:
                if kind(n) is DiscreteCPD and type(self.scoring) is NegativeBIC:
                    found = bic_components(table, [(n, ps) for ps in sets[n]], sizes, rows)
                    scores = [found[n, ps] for ps in sets[n]]
                elif n in linear:
                    scores = [known[n, ps] for ps in sets[n]]
                else:
                    scores = []
                    for ps in sets[n]:
                        cpd = self._fit(kind(n), df, n, ps, sizes)
                        fitted[n, ps] = cpd
                        scores.append(self.scoring.component(cpd, df) if cpd else float("-inf"))
                best = 0
                for k, s in enumerate(scores):
                    best = k if s > scores[best] + TIE else best
                for p in sets[n][best]:
                    dag.add_edge(p, n)
            if linear:
                fitted |= chosen({n: tuple(dag.parents(n)) for n in linear})
            return BayesNet(fitted.get((n, tuple(dag.parents(n)))) or self._fit(kind(n), df, n, dag.parents(n), sizes) for n in dag.topological())
        finally:
            if joint is not None:
                joint.unpersist()

    @staticmethod
    def _from_moments(df, linear, kind, sizes):
        """Scores of all candidates, and a function that fits those chosen. Where all discrete predecessors together have few
        configurations, their moments are merged for each candidate; else each set of discrete parents has its own."""
        parts = {ps: split(df, ps) for sets in linear.values() for ps in sets}
        states = tuple(sorted({s for ss, _ in parts.values() for s in ss}))
        numbers = sorted({x for n, sets in linear.items() for ps in sets for x in (n, *parts[ps][1])})
        sizes = {s: sizes[s] for s in states if s in sizes}
        sizes |= cardinalities(df, rest) if (rest := [s for s in states if s not in sizes]) else {}
        if prod(sizes.values()) * (len(numbers) + 1) ** 2 <= ENTRIES:
            (joint,) = moments(df, numbers, [(states, ())], sizes)
            by = {ss: joint.over(ss) for ss in dict.fromkeys(ss for ss, _ in parts.values())}
            groups = lambda wanted: ((ss, by[ss]) for ss in wanted)
        else:
            groups = lambda wanted: zip(wanted, moments(df, numbers, [(ss, ()) for ss in wanted], sizes), strict=True)

        scores = {}
        for ss, m in groups(list(dict.fromkeys(ss for ss, _ in parts.values()))):
            scores |= {(n, ps): m.bic(n, parts[ps][1]) for n, sets in linear.items() for ps in sets if parts[ps][0] == ss}

        def chosen(parents):
            out = {}
            for ss, m in groups(list(dict.fromkeys(parts[ps][0] for ps in parents.values()))):
                mine = {n: ps for n, ps in parents.items() if parts[ps][0] == ss}
                out |= {(n, ps): m.cpd(n, parts[ps][1], bool(ss) or kind(n) is ConditionalLinearGaussianCPD) for n, ps in mine.items()}
            return out

        return scores, chosen

    @staticmethod
    def _fit(kind, df, n, ps, sizes):
        if kind is DiscreteCPD:
            return DiscreteCPD.fit(df, n, ps, sizes[n], [sizes[p] for p in ps])
        if kind is LinearGaussianCPD and any(dict(df.dtypes)[p] in ("int", "bigint") for p in ps):
            kind = ConditionalLinearGaussianCPD
        return kind.fit(df, n, list(ps))


def reachable(names: Sequence[str], parents: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """For each node the set of nodes that it reaches, itself included, as a number with a bit for each place in names."""
    bit = {n: 1 << i for i, n in enumerate(names)}
    below = dict(bit)
    for n in reversed(DAG(names, [(p, c) for c in names for p in parents[c]]).topological()):
        for p in parents[n]:
            below[p] |= below[n]
    return below


@dataclass
class _Greedy(GraphSearch):
    """Shared: scores of families by Dirichlet priors, moves one edge at a time."""

    max_parents: int = 3
    prior: DirichletPrior = field(default_factory=UniformPrior)
    names: Sequence[str] | None = None

    flips = True
    capped_flips = False

    def fit(self, df, ncategories: Mapping[str, int] | None = None, **options):
        names = list(self.names or df.columns)
        sizes = dict(ncategories or cardinalities(df, names))
        joint = counted(df, names, sizes).persist()
        try:
            table = Contingency(joint, names, sizes) if Contingency.fits(names, sizes) else joint
            parents = self.searched(names, ScoreCache(lambda wanted: bayesian_components(table, wanted, sizes, self.prior)))
            return _tables(joint, DAG(names, [(p, c) for c in names for p in parents[c]]), sizes, self.prior)
        finally:
            joint.unpersist()

    def searched(self, names, cache) -> dict[str, list[str]]:
        return self.climb(names, {n: [] for n in names}, cache)

    def moves(self, names: list[str], parents: dict[str, list[str]]) -> list[dict[str, list[str]]]:
        """Changed parents of each legal move, by child and then parent, in the order of names."""
        out, by, below = [], {n: i for i, n in enumerate(names)}, reachable(names, parents)
        children: dict[str, list[str]] = {n: [] for n in names}
        for c in names:
            for p in parents[c]:
                children[p].append(c)
        for c in names:
            for p in names:
                if p == c:
                    continue
                if p not in parents[c]:
                    if len(parents[c]) < self.max_parents and not below[c] >> by[p] & 1:
                        out.append({c: sorted([*parents[c], p], key=by.get)})
                    continue
                less = [x for x in parents[c] if x != p]
                out.append({c: less})
                if self.flips and (not self.capped_flips or len(parents[p]) < self.max_parents):
                    if not any(below[x] >> by[c] & 1 for x in children[p] if x != c):  # no other way from p to c
                        out.append({c: less, p: sorted([*parents[p], c], key=by.get)})
        return out

    def climb(self, names, parents, cache):
        """The best single move again and again while it gains; each step's unknown families are scored in one job."""
        parents = {n: list(ps) for n, ps in parents.items()}
        while True:
            moves = self.moves(names, parents)
            cache([(c, tuple(ps)) for m in moves for c, ps in m.items()] + [(n, tuple(ps)) for n, ps in parents.items()])
            gain = lambda m: sum(cache([(c, tuple(ps))])[0] - cache([(c, tuple(parents[c]))])[0] for c, ps in m.items())
            best, most = None, 0.0
            for m in moves:
                if (g := gain(m)) > most + TIE:
                    best, most = m, g
            if best is None:
                return parents
            parents |= best

    @staticmethod
    def total(parents, cache) -> float:
        return sum(cache([(n, tuple(ps)) for n, ps in parents.items()]))


@dataclass
class GreedyHillClimbing(_Greedy):
    """Add, remove or flip an edge. A flip may exceed the cap on parents, unless strict."""

    strict_max_parents: bool = False

    @property
    def capped_flips(self):
        return self.strict_max_parents


@dataclass
class ScanGreedyHillClimbing(_Greedy):
    """Climb; then, for up to max_depth rounds, climb from the found graph with each legal edge added first, and keep the best."""

    max_depth: int = 1
    capped_flips = True

    def searched(self, names, cache):
        best = self.climb(names, {n: [] for n in names}, cache)
        for _ in range(self.max_depth):
            top, found, below = self.total(best, cache), None, reachable(names, best)
            for c in names:
                for i, p in enumerate(names):
                    if p == c or p in best[c] or len(best[c]) >= self.max_parents or below[c] >> i & 1:
                        continue
                    tried = self.climb(names, {**best, c: sorted([*best[c], p], key=names.index)}, cache)
                    if (s := self.total(tried, cache)) > top + TIE:
                        top, found = s, tried
            if found is None:
                break
            best = found
        return best


@dataclass
class GreedyThickThinning(_Greedy):
    """Add edges while they gain, then remove edges while that gains."""

    flips = False

    def searched(self, names, cache):
        parents = {n: [] for n in names}
        for grow in (True, False):
            while True:
                moves = [m for m in self.moves(names, parents) if all((len(ps) > len(parents[c])) == grow for c, ps in m.items())]
                cache([(c, tuple(ps)) for m in moves for c, ps in m.items()] + [(n, tuple(ps)) for n, ps in parents.items()])
                best, most = None, 0.0
                for m in moves:
                    ((c, ps),) = m.items()
                    g = cache([(c, tuple(ps))])[0] - cache([(c, tuple(parents[c]))])[0]
                    if g > most + TIE:
                        best, most = m, g
                if best is None:
                    break
                parents |= best
        return parents
