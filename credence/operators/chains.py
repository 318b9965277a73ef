"""Gibbs chains side by side: the states of many chains are arrays, and a node is updated in all of them at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from math import prod

import numpy as np

from .network import BayesNet

#: Steps of the random walk in an update of a continuous node.
STEPS = 10


def uniforms(chains: np.ndarray, tag: str) -> np.ndarray:
    """The numbers of functions.math.uniform for each chain."""
    return np.array([(int(hashlib.md5(f"{c}|{tag}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0 for c in chains.tolist()])


def coded(values: Sequence, x: np.ndarray) -> np.ndarray:
    """Each entry's place among a node's values."""
    places = {v: i for i, v in enumerate(values)}
    return np.array([places[v] for v in x.tolist()], np.int64)


class Chains:
    """States by node, an entry for each chain. Nodes of finite support are drawn from their blanket's conditional, continuous ones walk.

    Where all of a blanket is finite and has at most `room` configurations, its conditionals are tabled once and looked up.
    """

    def __init__(self, bn: BayesNet, evidence: Mapping[str, object], chains: np.ndarray, state: Mapping[str, np.ndarray], seed: int, room: int = 100_000):
        self.bn, self.chains, self.seed, self.room = bn, chains, seed, room
        self.state = {n: np.asarray(state[n]) for n in bn.names}
        self.free = [n for n in bn.names if n not in evidence]
        self.rng = np.random.default_rng([seed, int(chains.min()) if len(chains) else 0])
        self.factors = {n: [bn.cpds[n], *(bn.cpds[c] for c in bn.dag.children(n))] for n in bn.names}
        self.fixed = {n: c.values() for n, c in bn.cpds.items()}
        self.tables = {n: t for n in self.free if (t := self.tabled(n)) is not None}

    def log_density(self, name: str, state: Mapping[str, np.ndarray]) -> np.ndarray:
        """Of a node given its blanket, up to a constant."""
        return sum(c.log_array(state) for c in self.factors[name])

    def cumulated(self, name: str, values: Sequence, state: Mapping[str, np.ndarray]) -> np.ndarray:
        """Cumulated conditional of each entry's values; equal shares where no value has a density."""
        m = len(next(iter(state.values())))
        kind = np.array(values).dtype
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.stack([self.log_density(name, {**state, name: np.full(m, v, object if kind.kind == "U" else kind)}) for v in values], 1)
            top = logs.max(1, keepdims=True)
            p = np.where(np.isfinite(top), np.exp(logs - np.where(np.isfinite(top), top, 0)), 1.0)
        return np.cumsum(p / p.sum(1, keepdims=True), 1)

    def tabled(self, name: str) -> tuple[list[str], list[Sequence], np.ndarray] | None:
        near = sorted(self.bn.dag.markov_blanket(name))
        values = [self.fixed[m] for m in near]
        if self.fixed[name] is None or any(v is None for v in values) or prod(map(len, values)) > self.room:
            return None
        grid = np.indices([len(v) for v in values]).reshape(len(near), -1) if near else np.zeros((0, 1), int)
        state = {m: np.array(v, object if isinstance(v[0], str) else None)[g] for m, v, g in zip(near, values, grid, strict=True)}
        state[name] = np.zeros(grid.shape[1])
        return near, values, self.cumulated(name, self.fixed[name], state)

    def update(self, name: str, tag: str) -> None:
        values = self.fixed[name] or self.bn.cpds[name].values(self.state)
        if values is None:
            return self.walk(name)
        if name in self.tables:
            near, known, table = self.tables[name]
            at = np.zeros(len(self.chains), np.int64)
            for m, v in zip(near, known, strict=True):
                at = at * len(v) + coded(v, self.state[m])
            upto = table[at]
        else:
            upto = self.cumulated(name, values, self.state)
        u = uniforms(self.chains, tag)
        at = np.minimum((upto < u[:, None]).sum(1), len(values) - 1)
        self.state[name] = np.array(values, object if isinstance(values[0], str) else None)[at]

    def walk(self, name: str) -> None:
        """A random walk as wide as ten deviations of the node's own distribution; a place outside its support is never taken."""
        width = 10 * self.bn.cpds[name].std_array(self.state)
        now = self.log_density(name, self.state)
        for _ in range(STEPS):
            was = self.state[name]
            self.state[name] = was + width * self.rng.normal(size=len(was))
            with np.errstate(invalid="ignore", divide="ignore"):
                new = self.log_density(name, self.state)
            take = np.log(self.rng.random(len(was))) < new - now
            self.state[name] = np.where(take, self.state[name], was)
            now = np.where(take, new, now)

    def order(self, sweep: int) -> list[str]:
        """The free nodes in the order of a sweep, the same for all chains."""
        return sorted(self.free, key=lambda n: hashlib.md5(f"{self.seed}|{sweep}|order|{n}".encode()).digest())

    def sweep(self, k: int, order: Sequence[str] | None = None) -> None:
        for n in order or self.order(k):
            if n in self.factors and n in self.free:
                self.update(n, f"{self.seed}|{k}|{n}")

    def steps(self, nodewise: bool) -> Iterator[None]:
        """One update at a time, or one sweep at a time, without end."""
        k = 0
        while True:
            if nodewise:
                for n in self.order(k):
                    self.update(n, f"{self.seed}|{k}|{n}")
                    yield
            else:
                self.sweep(k)
                yield
            k += 1
