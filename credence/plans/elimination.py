"""The order in which exact inference sums variables out."""

from __future__ import annotations

from .graph import DAG


def relevant(dag: DAG, query: list[str], evidence: set[str]) -> list[str]:
    """Names that bear on the query: ancestors of query and evidence that the evidence doesn't cut off. Others sum to one."""
    kept = {*query, *evidence} | dag.ancestors({*query, *evidence})
    sub = DAG([n for n in dag.names if n in kept], [(p, c) for p, c in dag.edges() if p in kept and c in kept])
    near = {n for n in kept if n in query or n in evidence or not sub.separated([n], query, evidence)}
    # the distribution of evidence matters only where a name that is kept is its parent or it has none that is cut off
    return [n for n in sub.topological() if n in near]


def moral_neighbors(dag: DAG, names: list[str]) -> dict[str, set[str]]:
    """Undirected neighbours among names once parents of a child are married."""
    out: dict[str, set[str]] = {n: set() for n in names}
    for n in names:
        clique = [n, *(p for p in dag.parents(n) if p in out)]
        for a in clique:
            out[a] |= set(clique) - {a}
    return out


def elimination_order(dag: DAG, query: list[str], evidence: set[str], names: list[str] | None = None) -> list[str]:
    """Hidden names, each time the one with the fewest neighbours left; the first by topological order among equals."""
    names = names or dag.topological()
    near = moral_neighbors(dag, names)
    for n in names:
        near[n] -= evidence
    hidden = [n for n in names if n not in query and n not in evidence]
    out = []
    while hidden:
        n = min(hidden, key=lambda x: len(near[x]))
        hidden.remove(n)
        out.append(n)
        for a in near[n]:
            near[a] |= near[n] - {a}
            near[a].discard(n)
        del near[n]
    return out
