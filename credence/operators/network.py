"""Bayesian networks: distributions on a DAG, with likelihoods as columns."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import DAG
from .counts import count
from .cpd import CPD, DiscreteCPD
from .factor import Factor
from .table import consistent


class BayesNet:
    """CPDs by name, parents before children. Every change is checked before it is made."""

    def __init__(self, cpds: Iterable[CPD] = ()):
        self.cpds: dict[str, CPD] = {}
        self.dag = DAG()
        self.extend(cpds)

    def extend(self, cpds: Iterable[CPD]) -> None:
        cpds = list(cpds)
        names = [c.name for c in cpds]
        if twice := [n for n in names if n in self.cpds or names.count(n) > 1]:
            raise ValueError(f"defined twice: {sorted(set(twice))}")
        known = {*self.cpds, *names}
        if missing := {p for c in cpds for p in c.parents} - known:
            raise ValueError(f"parents without a distribution: {sorted(missing)}")
        dag = DAG([*self.dag.names, *names], [*self.dag.edges(), *((p, c.name) for c in cpds for p in c.parents)])
        every = {**self.cpds, **{c.name: c for c in cpds}}
        self.dag, self.cpds = dag, {n: every[n] for n in dag.topological()}

    def add(self, cpd: CPD) -> None:
        self.extend([cpd])

    def remove(self, name: str) -> None:
        self.dag.remove_node(name)
        del self.cpds[name]

    def __len__(self) -> int:
        return len(self.cpds)

    def __getitem__(self, name: str | int) -> CPD:
        return self.cpds[name] if isinstance(name, str) else list(self.cpds.values())[name]

    @property
    def names(self) -> list[str]:
        return list(self.cpds)

    @property
    def discrete(self) -> bool:
        return all(isinstance(c, DiscreteCPD) for c in self.cpds.values())

    def sizes(self) -> dict[str, int]:
        if not self.discrete:
            raise TypeError("only a discrete network has states to count")
        return {n: c.ncategories for n, c in self.cpds.items()}

    # Likelihood

    def log_col(self) -> Column:
        return reduce(lambda a, b: a + b, (c.log_col() for c in self.cpds.values()))

    def logpdf(self, rows: DataFrame | Mapping[str, object]) -> float:
        """Of one assignment, or summed over all rows."""
        if isinstance(rows, DataFrame):
            return rows.agg(F.sum(self.log_col())).first()[0] or 0.0
        if missing := set(self.cpds) - set(rows):
            raise ValueError(f"no values for {sorted(missing)}")
        return sum(c(rows).logpdf(rows[n]) for n, c in self.cpds.items())

    def pdf(self, rows: DataFrame | Mapping[str, object]) -> float:
        return math.exp(self.logpdf(rows))

    def with_pdf(self, df: DataFrame, name: str = "pdf") -> DataFrame:
        return df.withColumn(name, F.exp(self.log_col()))

    # Discrete parts

    def table(self, spark: SparkSession, name: str, at: Mapping[str, object] | None = None) -> DataFrame:
        t = self.cpds[name].table(spark)
        return consistent(t, at) if at else t

    def factor(self, spark: SparkSession, name: str, evidence: Mapping[str, int] | None = None) -> Factor:
        return self.cpds[name].factor(spark, evidence)

    def counts(self, df: DataFrame, name: str) -> DataFrame:
        return count(df, name, self.cpds[name].parents)

    def all_counts(self, df: DataFrame) -> dict[str, DataFrame]:
        return {n: self.counts(df, n) for n in self.names}


def network(dag: DAG, cpds: Sequence[CPD]) -> BayesNet:
    bn = BayesNet(cpds)
    if set(bn.dag.edges()) != set(dag.edges()):
        raise ValueError("the distributions' parents aren't those of the graph")
    return bn
