"""Posterior distributions in discrete networks: exact, by weighted and by Gibbs samples, and by loopy belief."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import repeat
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.elimination import elimination_order, relevant
from .factor import BROADCAST_CELLS, Factor
from .network import BayesNet
from .chains import Chains
from .sampling import SIDE_BY_SIDE, keys, weighted
from .table import POTENTIAL


@dataclass(frozen=True)
class InferenceState:
    """A validated question: names to ask about, each once, and evidence about others."""

    bn: BayesNet
    query: tuple[str, ...]
    evidence: Mapping[str, int]

    @classmethod
    def of(cls, bn: BayesNet, query: str | Sequence[str], evidence: Mapping[str, int] | None = None) -> InferenceState:
        query = (query,) if isinstance(query, str) else tuple(dict.fromkeys(query))
        evidence = dict(evidence or {})
        if not bn.discrete:
            raise TypeError("inference is for discrete networks")
        if bad := [n for n in (*query, *evidence) if n not in bn.cpds]:
            raise ValueError(f"not in the network: {bad}")
        if both := [n for n in query if n in evidence]:
            raise ValueError(f"asked for and given: {both}")
        return cls(bn, query, evidence)

    def __str__(self):
        given = ", ".join(f"{k}={v}" for k, v in self.evidence.items())
        return f"P({', '.join(self.query)}{' | ' + given if given else ''})"


class InferenceMethod(ABC):
    """Answers questions with a factor over the query, in its order. New methods subclass this."""

    @abstractmethod
    def infer(self, spark: SparkSession, state: InferenceState) -> Factor: ...


class ExactInference(InferenceMethod):
    """Variable elimination: factors cut down by the evidence, hidden names multiplied together and summed out one by one."""

    def infer(self, spark, state):
        bn, names = state.bn, relevant(state.bn.dag, list(state.query), set(state.evidence))
        factors = [bn.factor(spark, n, state.evidence) for n in names]
        for h in elimination_order(bn.dag, list(state.query), set(state.evidence), names):
            own = [f for f in factors if h in f]
            factors = [f for f in factors if h not in f] + [reduce(lambda a, b: a * b, own).sum(h)]
        return reduce(lambda a, b: a * b, factors).permute(state.query).normalize()


def posteriors(bn: BayesNet, df: DataFrame, query: str, given: Sequence[str]) -> DataFrame:
    """The posterior of the query for each distinct combination of `given` in the data: (given..., query, potential).

    One elimination keeps the evidence names as dimensions; its result is as large as their states allow and joins the data's
    distinct combinations.
    """
    spark = df.sparkSession
    names = relevant(bn.dag, [query, *given], set())
    factors = [bn.factor(spark, n) for n in names]
    for h in elimination_order(bn.dag, [query, *given], set(), names):
        own = [f for f in factors if h in f]
        factors = [f for f in factors if h not in f] + [reduce(lambda a, b: a * b, own).sum(h)]
    f = reduce(lambda a, b: a * b, factors).permute([*given, query]).normalize([query])
    seen = df.select(*given).distinct()
    cells = prod(f.sizes.values())  # beyond some, both sides are shuffled
    return seen.join(F.broadcast(f.df) if cells <= BROADCAST_CELLS else f.df, list(given)).select(*given, query, POTENTIAL)


class LikelihoodWeightingInference(InferenceMethod):
    def __init__(self, nsamples: int = 500, seed: int = 0):
        self.nsamples, self.seed = nsamples, seed

    def infer(self, spark, state):
        rows = weighted(state.bn, keys(spark, self.nsamples), state.evidence, self.seed)
        table = rows.groupBy(*state.query).agg(F.sum(F.exp("log_weight")).alias(POTENTIAL))
        return Factor.of_table(table, {q: state.bn.sizes()[q] for q in state.query}).normalize()


class _GibbsInference(InferenceMethod):
    nodewise = True

    def __init__(self, nsamples: int = 2000, burn_in: int = 500, thin: int = 3, chains: int = 4, seed: int = 0):
        if burn_in >= nsamples:
            raise ValueError("burn_in must be less than nsamples")
        self.nsamples, self.burn_in, self.thin, self.chains, self.seed = nsamples, burn_in, thin, chains, seed

    def infer(self, spark, state):
        bn, evidence, me = state.bn, state.evidence, self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = np.sort(batch["id"].to_numpy())
                rng = np.random.default_rng([me.seed, *own[:1].tolist()])
                begun = {n: np.full(len(own), evidence[n]) if n in evidence else rng.integers(1, c.ncategories + 1, len(own)) for n, c in bn.cpds.items()}
                chains = Chains(bn, evidence, own, begun, me.seed)
                for step, _ in zip(range(1, me.nsamples + 1), chains.steps(me.nodewise) if chains.free else repeat(None)):
                    if step > me.burn_in and (step - me.burn_in) % me.thin == 0:
                        yield pd.DataFrame({q: chains.state[q] for q in state.query}).astype("int32")

        rows = spark.range(self.chains, numPartitions=-(-self.chains // SIDE_BY_SIDE)).mapInPandas(run, ", ".join(f"`{q}` int" for q in state.query))
        table = rows.groupBy(*state.query).agg(F.count("*").cast("double").alias(POTENTIAL))
        return Factor.of_table(table, {q: bn.sizes()[q] for q in state.query}).normalize()


class GibbsSamplingNodewise(_GibbsInference):
    """Each update of one node counts as an iteration. nsamples and burn_in are those of each chain."""


class GibbsSamplingFull(_GibbsInference):
    """Each sweep over all nodes counts as an iteration."""

    nodewise = False


class LoopyBelief(InferenceMethod):
    """Messages between neighbours until they settle; exact where the graph has no undirected cycle."""

    def __init__(self, nsamples: int = 500, tol: float = 1e-8, iters_for_convergence: int = 6):
        self.iterations, self.tol, self.window = nsamples, tol, iters_for_convergence

    def infer(self, spark, state):
        if len(state.query) != 1:
            raise ValueError("loopy belief answers for one variable")
        (q,) = state.query
        one = spark.createDataFrame([tuple(state.evidence.values()) or (0,)], ", ".join(f"`{n}` int" for n in state.evidence) or "_none int")
        return Factor(self.batch(state.bn, one, q, list(state.evidence)).select(q, POTENTIAL), (q,), {q: state.bn.sizes()[q]})

    def batch(self, bn: BayesNet, rows: DataFrame, query: str, given: Sequence[str]) -> DataFrame:
        """(given..., query, potential) for each row of evidence. The rows of an Arrow batch pass their messages together."""
        me, given = self, list(given)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                belief = me.beliefs(bn, {n: batch[n].to_numpy() for n in given}, len(batch))[query]
                r = belief.shape[1]
                out = {n: np.repeat(batch[n].to_numpy(), r).astype("int32") for n in given}
                yield pd.DataFrame({**out, query: np.tile(np.arange(1, r + 1, dtype="int32"), len(batch)), POTENTIAL: belief.ravel()})

        return rows.mapInPandas(run, ", ".join(f"`{n}` int" for n in [*given, query]) + f", {POTENTIAL} double")

    def beliefs(self, bn: BayesNet, evidence: Mapping[str, np.ndarray], rows: int) -> dict[str, np.ndarray]:
        """Beliefs (rows x states) of every node."""
        sizes = bn.sizes()
        norm = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1e-300)
        given = {n: np.eye(sizes[n])[np.asarray(v) - 1] for n, v in evidence.items()}
        cpts = {}
        for n, c in bn.cpds.items():  # axes: parents in order, then the node
            shape = [sizes[p] for p in reversed(c.parents)] + [sizes[n]]
            cpts[n] = np.array(c.probs).reshape(shape).transpose([*range(len(c.parents) - 1, -1, -1), len(c.parents)])
        edges = bn.dag.edges()
        up = {(c, p): np.full((rows, sizes[p]), 1 / sizes[p]) for p, c in edges}
        down = {(p, c): given.get(p, np.full((rows, sizes[p]), 1 / sizes[p])) for p, c in edges}
        kids = {n: bn.dag.children(n) for n in bn.names}

        def evidence_below(n, skip=None):
            out = np.array(given[n]) if n in given else np.ones((rows, sizes[n]))
            for c in kids[n]:
                if c != skip:
                    out = out * up[c, n]
            return out

        def contracted(n, x, skip=None):
            """Sum of the node's table times the parents' messages, and times x over the node where it is given; what is skipped stays."""
            ps = bn.cpds[n].parents
            operands, axes = [cpts[n]], [[*range(1, len(ps) + 2)]]
            for i, p in enumerate(ps):
                if p != skip:
                    operands.append(down[p, n])
                    axes.append([0, i + 1])
            if x is not None:
                operands.append(x)
                axes.append([0, len(ps) + 1])
            left = len(ps) + 1 if x is None else ps.index(skip) + 1
            if len(operands) == 1:
                return np.repeat(cpts[n][None], rows, 0)
            args = [y for pair in zip(operands, axes, strict=True) for y in pair]
            return np.einsum(*args, [0, left])

        settled = 0
        for _ in range(self.iterations):
            change = 0.0
            new_up, new_down = {}, {}
            lam = {n: evidence_below(n) for n in bn.names}
            for p, c in edges:
                new_up[c, p] = norm(contracted(c, lam[c], p))
                new_down[p, c] = given[p] if p in given else norm(contracted(p, None) * evidence_below(p, c))
                change = max(change, np.abs(new_up[c, p] - up[c, p]).max(), np.abs(new_down[p, c] - down[p, c]).max())
            up, down = new_up, new_down
            settled = settled + 1 if change <= self.tol else 0
            if settled >= self.window or not edges:
                break
        return {n: norm(evidence_below(n) * contracted(n, None)) for n in bn.names}


def infer(spark: SparkSession, bn: BayesNet, query: str | Sequence[str], evidence: Mapping[str, int] | None = None, method: InferenceMethod | None = None) -> Factor:
    """P(query | evidence), exactly unless a method is given."""
    return (method or ExactInference()).infer(spark, InferenceState.of(bn, query, evidence))
