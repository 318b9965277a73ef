"""Networks to begin with: random ones, and well-known small ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .cpd import DiscreteCPD
from .network import BayesNet


def random_cpd(rng: np.random.Generator, name: str, ncategories: int, parents: Sequence[str] = (), parent_sizes: Sequence[int] = (), alpha: float = 1.0) -> DiscreteCPD:
    """Rows from a symmetric Dirichlet distribution."""
    rows = rng.dirichlet([alpha] * ncategories, int(np.prod(parent_sizes)) if parents else 1)
    return DiscreteCPD(name, [list(map(float, r)) for r in rows] if parents else list(map(float, rows[0])), parents, parent_sizes)


def random_network(nodes: int = 16, max_parents: int = 3, max_states: int = 5, connected: bool = True, seed: int = 0) -> BayesNet:
    """Nodes N1, N2, ... of two to max_states states; parents are earlier nodes, one at least if connected."""
    if nodes < 1 or max_parents < 0 or max_states < 2:
        raise ValueError("at least one node, two states, and no negative number of parents")
    rng = np.random.default_rng(seed)
    sizes = {f"N{i + 1}": int(rng.integers(2, max_states + 1)) for i in range(nodes)}
    names, cpds = list(sizes), []
    for i, n in enumerate(names):
        least = min(1, i, max_parents) if connected else 0
        k = int(rng.integers(least, min(i, max_parents) + 1))
        parents = [names[j] for j in sorted(rng.choice(i, k, replace=False))] if k else []
        cpds.append(random_cpd(rng, n, sizes[n], parents, [sizes[p] for p in parents]))
    return BayesNet(cpds)


def random_question(bn: BayesNet, num_query: int = 2, num_evidence: int = 3, seed: int = 0) -> tuple[list[str], dict[str, int]]:
    rng = np.random.default_rng(seed)
    names = [str(n) for n in rng.permutation(bn.names)[: num_query + num_evidence]]
    return names[:num_query], {n: int(rng.integers(1, bn[n].ncategories + 1)) for n in names[num_query:]}


def sprinkler(seed: int = 0) -> BayesNet:
    rng = np.random.default_rng(seed)
    return BayesNet([random_cpd(rng, "Rain", 2), random_cpd(rng, "Sprinkler", 2, ["Rain"], [2]), random_cpd(rng, "WetGrass", 2, ["Sprinkler", "Rain"], [2, 2])])


def satellite(seed: int = 0) -> BayesNet:
    """Battery and solar panel, electrical failure, and what it does to trajectory and communication."""
    rng = np.random.default_rng(seed)
    return BayesNet([random_cpd(rng, "B", 2), random_cpd(rng, "S", 2), random_cpd(rng, "E", 2, ["B", "S"], [2, 2]), random_cpd(rng, "D", 2, ["E"], [2]), random_cpd(rng, "C", 2, ["E"], [2])])


#: The asia network without its deterministic node (Lauritzen and Spiegelhalter, 1988); rows by configuration, the first parent fastest.
ASIA = [
    ("A", (), [[0.99, 0.01]]),
    ("S", (), [[0.5, 0.5]]),
    ("T", ("A",), [[0.99, 0.01], [0.95, 0.05]]),
    ("L", ("S",), [[0.99, 0.01], [0.9, 0.1]]),
    ("B", ("S",), [[0.97, 0.03], [0.4, 0.6]]),
    ("X", ("T", "L"), [[0.95, 0.05], [0.02, 0.98], [0.02, 0.98], [0.02, 0.98]]),
    ("D", ("T", "L", "B"), [[0.9, 0.1], [0.2, 0.8], [0.3, 0.7], [0.1, 0.9], [0.3, 0.7], [0.1, 0.9], [0.3, 0.7], [0.1, 0.9]]),
]


def asia() -> BayesNet:
    return BayesNet(DiscreteCPD(n, rows if ps else rows[0], ps, [2] * len(ps)) for n, ps, rows in ASIA)
