"""Conditional distributions of a target given its parents, fitted by aggregations and evaluated as columns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import NEG_INF, normal, normal_logpdf, pick, uniform
from .counts import cardinalities, config, statistics
from .distributions import Categorical, Distribution, Normal, cumulative
from .factor import Factor

#: Predictors whose correlation matrix has a smaller eigenvalue count as collinear.
COLLINEAR = 1e-12
#: States up to which a draw adds up comparisons with the cumulated probabilities.
SUMMED = 16


class CPD(ABC):
    """Name of the target, parents in order, and what every kind can do. New kinds subclass this."""

    def __init__(self, name: str, parents: Sequence[str] = ()):
        self.name, self.parents = name, tuple(parents)

    @abstractmethod
    def __call__(self, assignment: Mapping[str, object] | None = None, **more) -> Distribution:
        """The target's distribution given the parents' values."""

    @abstractmethod
    def log_col(self) -> Column:
        """Log density of each row."""

    def sample_col(self, key: Column, tag: str) -> Column:
        raise NotImplementedError(f"{type(self).__name__} has no sampler")

    @property
    def nparams(self) -> int:
        raise NotImplementedError(f"{type(self).__name__} has no parameters to count")

    # What Markov chains ask for: arrays by name, an entry for each chain

    def by_distribution(self, state: Mapping[str, np.ndarray]) -> list[tuple[np.ndarray, Distribution]]:
        """The different distributions that the parents' values give, and the entries of each: one call for each combination of values."""
        n = len(next(iter(state.values())))
        if not self.parents:
            return [(np.arange(n), self({}))]
        rows = pd.DataFrame({i: state[p] for i, p in enumerate(self.parents)})
        groups = rows.groupby(list(rows.columns)).indices.items()
        return [(own, self(dict(zip(self.parents, at if isinstance(at, tuple) else (at,), strict=True)))) for at, own in groups]

    def values(self, state: Mapping[str, np.ndarray] | None = None) -> tuple | None:
        """All values that the target may take, where they are finitely many; without a state, None also where parents decide.
        A discrete target of unbounded support can't be enumerated: ValueError."""
        return None if state is None else enumerated(self.name, [d for _, d in self.by_distribution(state)])

    def log_array(self, state: Mapping[str, np.ndarray]) -> np.ndarray:
        """Log density of the target's entries."""
        x, out = state[self.name], np.empty(len(state[self.name]))
        for own, dist in self.by_distribution(state):
            out[own] = dist.log_array(x[own])
        return out

    def std_array(self, state: Mapping[str, np.ndarray]) -> np.ndarray:
        """Deviation of the target given its parents."""
        out = np.empty(len(state[self.name]))
        for own, dist in self.by_distribution(state):
            out[own] = dist.std
        return out

    @classmethod
    def fit(cls, df: DataFrame, name: str, parents: Sequence[str] = (), **options) -> CPD:
        raise NotImplementedError(f"{cls.__name__} can't be fitted")

    @property
    def parentless(self) -> bool:
        return not self.parents

    def logpdf(self, df: DataFrame) -> float:
        """Sum over all rows."""
        return df.agg(F.sum(self.log_col())).first()[0] or 0.0

    def pdf(self, df: DataFrame) -> float:
        return float(np.exp(self.logpdf(df)))


def enumerated(name: str, dists: Sequence[Distribution]) -> tuple | None:
    """The values of several distributions together; None if one is continuous."""
    if not all(d.discrete for d in dists):
        return None
    if any(d.support is None for d in dists):
        raise ValueError(f"{name} has infinitely many states")
    return tuple(dict.fromkeys(v for d in dists for v in d.support))


class StaticCPD(CPD):
    """One distribution whatever the parents are."""

    def __init__(self, name: str, dist: Distribution, parents: Sequence[str] = ()):
        super().__init__(name, parents)
        self.dist = dist

    def __call__(self, assignment=None, **more):
        return self.dist

    def by_distribution(self, state):
        return [(np.arange(len(next(iter(state.values())))), self.dist)]

    def values(self, state=None):
        return enumerated(self.name, [self.dist])

    def log_col(self):
        return self.dist.log_col(F.col(self.name))

    def sample_col(self, key, tag):
        return self.dist.sample_col(key, tag)

    @property
    def nparams(self):
        return self.dist.nparams

    @classmethod
    def fit(cls, df, name, parents=(), family: type[Distribution] = Normal, **options):
        return cls(name, family.fit(df, name), parents)


class CategoricalCPD(CPD):
    """A distribution of one family for each configuration of discrete parents."""

    def __init__(self, name: str, parents: Sequence[str], parent_sizes: Sequence[int], dists: Sequence[Distribution]):
        super().__init__(name, parents)
        if len(dists) != prod(parent_sizes):
            raise ValueError(f"{len(dists)} distributions for {prod(parent_sizes)} configurations")
        self.parent_sizes, self.dists = tuple(parent_sizes), list(dists)

    def row(self, assignment: Mapping[str, object]) -> int:
        """0-based configuration, the first parent fastest."""
        q, step = 0, 1
        for p, n in zip(self.parents, self.parent_sizes, strict=True):
            if not 1 <= assignment[p] <= n:
                raise IndexError(f"{p} has no state {assignment[p]}")
            q, step = q + (assignment[p] - 1) * step, step * n
        return q

    def __call__(self, assignment=None, **more):
        return self.dists[self.row({**(assignment or {}), **more})]

    def values(self, state=None):
        return enumerated(self.name, self.dists)

    def configs(self, state: Mapping[str, np.ndarray]) -> np.ndarray:
        """0-based configurations of the parents' entries."""
        q, step = np.zeros(len(next(iter(state.values()))), np.int64), 1
        for p, n in zip(self.parents, self.parent_sizes, strict=True):
            x = np.asarray(state[p]).astype(np.int64)
            if len(x) and (x.min() < 1 or x.max() > n):
                raise IndexError(f"{p} has a state out of 1..{n}")
            q, step = q + (x - 1) * step, step * n
        return q

    def by_distribution(self, state):
        q = self.configs(state)
        return [(np.flatnonzero(q == k), self.dists[k]) for k in np.unique(q)]

    def config_col(self) -> Column:
        return config(self.parents, dict(zip(self.parents, self.parent_sizes, strict=True)))

    def log_col(self):
        out = F.lit(None).cast("double")
        for q in range(len(self.dists) - 1, -1, -1):
            out = F.when(self.config_col() == q + 1, self.dists[q].log_col(F.col(self.name))).otherwise(out)
        return out

    def sample_col(self, key, tag):
        out = None
        for q in range(len(self.dists) - 1, -1, -1):
            x = self.dists[q].sample_col(key, tag)
            out = x if out is None else F.when(self.config_col() == q + 1, x).otherwise(out)
        return out

    @property
    def nparams(self):
        return sum(d.nparams for d in self.dists)

    @classmethod
    def fit(cls, df, name, parents=(), family: type[Distribution] = Normal, parent_sizes: Sequence[int] | None = None, **options):
        sizes = dict(zip(parents, parent_sizes, strict=True)) if parent_sizes else cardinalities(df, parents) if parents else {}
        if family is Categorical:
            return DiscreteCPD.fit(df, name, parents, parent_sizes=parent_sizes)
        m = family.moments(F.col(name))
        rows = {r["_q"]: r.asDict() for r in df.groupBy(config(parents, sizes).cast("int").alias("_q")).agg(*(v.alias(k) for k, v in m.items())).collect()}
        configs = prod(sizes[p] for p in parents)
        if missing := [q for q in range(1, configs + 1) if q not in rows]:
            raise ValueError(f"{name}: no rows for configurations {missing} of {list(parents)}")
        return cls(name, parents, [sizes[p] for p in parents], [family.of(rows[q]) for q in range(1, configs + 1)])


class DiscreteCPD(CategoricalCPD):
    """Categorical targets 1..n."""

    def __init__(self, name: str, probs: Sequence, parents: Sequence[str] = (), parent_sizes: Sequence[int] = ()):
        rows = [probs] if not parents and not isinstance(probs[0], (list, tuple)) else probs
        super().__init__(name, parents, parent_sizes, [Categorical(p) for p in rows])

    @property
    def ncategories(self) -> int:
        return self.dists[0].ncategories

    @property
    def probs(self) -> list[tuple[float, ...]]:
        return [d.probs for d in self.dists]

    def __str__(self) -> str:
        """A line for each configuration of the parents, the first parent fastest."""
        lines = []
        for q, row in enumerate(self.probs):
            states, rest = [], q
            for p, size in zip(self.parents, self.parent_sizes, strict=True):
                states.append(f"{p}={rest % size + 1}")
                rest //= size
            lines.append(f"P({self.name}{' | ' + ', '.join(states) if states else ''}) = {', '.join(f'{x:.6g}' for x in row)}")
        return "\n".join(lines)

    def log_array(self, state):
        with np.errstate(divide="ignore"):
            logs = np.log(np.array(self.probs))
        x = np.asarray(state[self.name]).astype(np.int64)
        inside = (x >= 1) & (x <= self.ncategories)
        return np.where(inside, logs[self.configs(state), np.where(inside, x, 1) - 1], NEG_INF)

    def sizes(self) -> dict[str, int]:
        return {self.name: self.ncategories, **dict(zip(self.parents, self.parent_sizes, strict=True))}

    def prob_col(self) -> Column:
        """Probability of each row; null where a state is out of range."""
        flat = F.array(*(F.lit(p) for row in self.probs for p in row))
        k = F.col(self.name)
        return F.when((k >= 1) & (k <= self.ncategories), F.get(flat, ((self.config_col() - 1) * self.ncategories + k - 1).cast("int")))

    def log_col(self):
        flat = F.array(*(F.lit(float(np.log(p)) if p > 0 else NEG_INF) for row in self.probs for p in row))
        k = F.col(self.name)
        return F.when((k >= 1) & (k <= self.ncategories), F.get(flat, ((self.config_col() - 1) * self.ncategories + k - 1).cast("int"))).otherwise(F.lit(NEG_INF))

    def sample_col(self, key, tag):
        if self.ncategories <= SUMMED:  # the same number, in code that is compiled
            u, at, sums = uniform(key, tag), (self.config_col() - 1).cast("int"), [cumulative(p) for p in self.probs]
            above = [(F.get(F.array(*(F.lit(c[k]) for c in sums)), at) if self.parents else F.lit(sums[0][k])) < u for k in range(self.ncategories - 1)]
            return reduce(lambda a, b: a + b, (x.cast("int") for x in above), F.lit(1))
        rows = F.array(*(F.array(*map(F.lit, cumulative(p))) for p in self.probs))
        return pick(F.get(rows, (self.config_col() - 1).cast("int")), uniform(key, tag))

    def frame(self, spark) -> DataFrame:
        """(target, q, k, p)."""
        return spark.createDataFrame([(self.name, q + 1, k + 1, p) for q, row in enumerate(self.probs) for k, p in enumerate(row)], "target string, q int, k int, p double")

    def table(self, spark, order: Sequence[str] | None = None) -> DataFrame:
        """Columns parents..., target, potential."""
        f = self.factor(spark)
        return f.permute(order or [*self.parents, self.name]).df

    def factor(self, spark, evidence: Mapping[str, int] | None = None) -> Factor:
        """Dimensions target, parents..., sliced at the evidence."""
        f = Factor.of_values(spark, self.sizes(), [p for row in self.probs for p in row])
        return f[{k: v for k, v in (evidence or {}).items() if k in f.dims}] if evidence else f

    @classmethod
    def fit(cls, df, name, parents=(), ncategories: int | None = None, parent_sizes: Sequence[int] | None = None, prior=None, weight: str | None = None, **options):
        """Shares of the counts in one aggregation; a configuration without rows is uniform. prior: a Dirichlet prior whose posterior mean is taken."""
        known = dict(zip(parents, parent_sizes, strict=True)) if parent_sizes else {}
        if ncategories:
            known[name] = ncategories
        known |= cardinalities(df, rest) if (rest := [x for x in (name, *parents) if x not in known]) else {}
        configs, r = prod(known[p] for p in parents), known[name]
        n = np.zeros((configs, r))
        for x in statistics(df, name, parents, known, weight).filter("n > 0").collect():
            n[x["q"] - 1, x["k"] - 1] = x["n"]
        return cls.of_counts(name, n, parents, [known[x] for x in parents], prior)

    @classmethod
    def of_counts(cls, name, n: np.ndarray, parents=(), parent_sizes=(), prior=None):
        """From counts of states by configuration."""
        r = n.shape[1]
        cells = prior.cells(r, n.shape[0]) if prior else None
        alpha = np.array(cells, float) if cells is not None else prior.for_table(r) if prior else 0.0
        total = (n + alpha).sum(1, keepdims=True)
        p = np.where(total > 0, (n + alpha) / np.where(total > 0, total, 1), 1 / r)
        return cls(name, [list(map(float, x)) for x in p], parents, parent_sizes) if parents else cls(name, list(map(float, p[0])))


def least_squares(df: DataFrame, name: str, parents: Sequence[str], by: Column | None = None) -> dict[int, dict]:
    """Slopes, intercept, deviation and squared residuals by group, over rows that are complete in target and parents.

    One aggregation of means and centred co-moments, which tasks merge: numbers far from 0 keep their digits. Collinear or constant
    parents raise LinAlgError, a ValueError.
    """
    cols = [name, *parents]
    held = df.select((by if by is not None else F.lit(1)).cast("int").alias("g"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)))
    held = held.filter(" AND ".join(["g IS NOT NULL", *(f"x{i} IS NOT NULL" for i in range(len(cols)))]))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    found = held.groupBy("g").agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(len(cols))), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs))
    out = {}
    for r in found.collect():
        n, mean = r["n"], np.array([r[f"m{i}"] for i in range(len(cols))])
        co = n * np.array([[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
        scale = np.sqrt(np.maximum(0.0, np.diag(co)[1:]))
        both = np.outer(scale, scale)
        unit = co[1:, 1:] / np.where(both > 0, both, 1.0)
        if parents and not ((scale > 0).all() and (np.linalg.eigvalsh(unit) > COLLINEAR).all()):
            raise np.linalg.LinAlgError(f"{name}: {list(parents)} are collinear")
        slopes = np.linalg.solve(unit, co[1:, 0] / scale) / scale if parents else np.zeros(0)
        out[r["g"]] = {"a": slopes.tolist(), "b": float(mean[0] - slopes @ mean[1:]), "sigma": float(np.sqrt(max(0.0, co[0, 0]) / max(1, n - 1))), "n": n, "left": max(0.0, float(co[0, 0] - slopes @ co[1:, 0]))}
    return out


class LinearGaussianCPD(CPD):
    """Normal with mean a . parents + b. sigma is the target's own sample deviation; residual_sigma takes that of the residuals."""

    def __init__(self, name: str, parents: Sequence[str] = (), a: Sequence[float] = (), b: float = 0.0, sigma: float = 1.0):
        super().__init__(name, parents)
        self.a, self.b, self.sigma = list(a), b, sigma

    def __call__(self, assignment=None, **more):
        at = {**(assignment or {}), **more}
        return Normal(self.b + sum(w * at[p] for w, p in zip(self.a, self.parents, strict=True)), self.sigma)

    def log_array(self, state):
        mean = sum((w * state[p].astype(float) for w, p in zip(self.a, self.parents, strict=True)), float(self.b))
        return Normal(0.0, self.sigma).log_array(state[self.name] - mean)

    def std_array(self, state):
        return np.full(len(state[self.name]), float(self.sigma))

    def values(self, state=None):
        return None

    def mean_col(self) -> Column:
        return sum((w * F.col(p) for w, p in zip(self.a, self.parents, strict=True)), F.lit(float(self.b)))

    def log_col(self):
        return normal_logpdf(self.name, self.mean_col(), self.sigma)

    def sample_col(self, key, tag):
        return self.mean_col() + self.sigma * normal(key, tag)

    @property
    def nparams(self):
        return len(self.a) + 2

    @classmethod
    def fit(cls, df, name, parents=(), min_stdev: float = 0.0, residual_sigma: bool = False, **options):
        m = least_squares(df, name, parents).get(1)
        if m is None:
            raise ValueError(f"{name}: no row is complete")
        return cls(name, parents, m["a"], m["b"], max(min_stdev, _sigma(m, residual_sigma)))


def _sigma(m: dict, residual: bool) -> float:
    if not residual:
        return m["sigma"]
    return float(np.sqrt(m["left"] / max(1, m["n"] - len(m["a"]) - 1)))


class ConditionalLinearGaussianCPD(CPD):
    """A linear Gaussian for each configuration of the discrete parents."""

    def __init__(self, name: str, discrete: Sequence[str], sizes: Sequence[int], continuous: Sequence[str], models: Sequence[LinearGaussianCPD]):
        super().__init__(name, [*discrete, *continuous])
        self.discrete, self.sizes, self.continuous, self.models = tuple(discrete), tuple(sizes), tuple(continuous), list(models)

    def __call__(self, assignment=None, **more):
        at = {**(assignment or {}), **more}
        q, step = 0, 1
        for p, n in zip(self.discrete, self.sizes, strict=True):
            q, step = q + (at[p] - 1) * step, step * n
        return self.models[q](at)

    def _each(self, state, of) -> np.ndarray:
        q, step, out = np.zeros(len(state[self.name]), np.int64), 1, np.empty(len(state[self.name]))
        for p, n in zip(self.discrete, self.sizes, strict=True):
            q, step = q + (state[p].astype(np.int64) - 1) * step, step * n
        for k in np.unique(q):
            own = q == k
            out[own] = of(self.models[k], {n: state[n][own] for n in (self.name, *self.continuous)})
        return out

    def log_array(self, state):
        return self._each(state, lambda m, s: m.log_array(s))

    def std_array(self, state):
        return self._each(state, lambda m, s: m.std_array(s))

    def values(self, state=None):
        return None

    def _choose(self, of) -> Column:
        q = config(self.discrete, dict(zip(self.discrete, self.sizes, strict=True)))
        out = F.lit(None).cast("double")
        for k in range(len(self.models) - 1, -1, -1):
            out = F.when(q == k + 1, of(self.models[k])).otherwise(out)
        return out

    def log_col(self):
        return self._choose(lambda m: m.log_col())

    def sample_col(self, key, tag):
        return self._choose(lambda m: m.sample_col(key, tag))

    @property
    def nparams(self):
        return sum(m.nparams for m in self.models)

    @classmethod
    def fit(cls, df, name, parents=(), min_stdev: float = 0.0, parent_sizes: Mapping[str, int] | None = None, **options):
        kinds = dict(df.dtypes)
        discrete = [p for p in parents if kinds[p] in ("tinyint", "smallint", "int", "bigint")]
        continuous = [p for p in parents if kinds[p] in ("float", "double")]
        if other := [p for p in parents if p not in discrete and p not in continuous]:
            raise TypeError(f"{other}: parents are whole numbers or floating-point ones")
        sizes = dict(parent_sizes or {}) or (cardinalities(df, discrete) if discrete else {})
        fits = least_squares(df, name, continuous, config(discrete, sizes))
        configs = prod(sizes[p] for p in discrete)
        if missing := [q for q in range(1, configs + 1) if q not in fits]:
            raise ValueError(f"{name}: no rows for configurations {missing} of {discrete}")
        models = [LinearGaussianCPD(name, continuous, fits[q]["a"], fits[q]["b"], max(min_stdev, fits[q]["sigma"])) for q in range(1, configs + 1)]
        return cls(name, discrete, [sizes[p] for p in discrete], continuous, models)


class FunctionalCPD(CPD):
    """A family whose parameters a function makes. `columns` gets the parents' columns by name and gives the log density
    of the target's column; `dist` gets an assignment and gives a distribution. returns: the SQL type of the target's draws."""

    def __init__(self, name: str, parents: Sequence[str], dist: Callable[[Mapping[str, object]], Distribution], columns: Callable[[dict[str, Column], Column], Column] | None = None, sampler: Callable[[dict[str, Column], Column, str], Column] | None = None, returns: str = "double"):
        super().__init__(name, parents)
        self.dist, self.columns, self.sampler, self.returns = dist, columns, sampler, returns

    def __call__(self, assignment=None, **more):
        return self.dist({**(assignment or {}), **more})

    def _cols(self) -> dict[str, Column]:
        return {p: F.col(p) for p in self.parents}

    def log_col(self):
        if self.columns is not None:
            return self.columns(self._cols(), F.col(self.name))
        dist, parents = self.dist, self.parents

        @F.pandas_udf("double")
        def log_density(rows):  # the function is called once for each combination of parents in an Arrow batch
            out = np.empty(len(rows))
            for at, own in rows.groupby(list(parents), dropna=False).indices.items() if parents else [((), np.arange(len(rows)))]:
                at = at if isinstance(at, tuple) else (at,)
                density = dist(dict(zip(parents, at, strict=True))).logpdf
                out[own] = [density(x) for x in rows["_x"].to_numpy()[own]]
            return pd.Series(out)

        return log_density(F.struct(*(F.col(p) for p in parents), F.col(self.name).alias("_x")))

    def sample_col(self, key, tag):
        """By the sampler of columns, else by quantiles of the function's distributions at the row's uniform number."""
        if self.sampler is not None:
            return self.sampler(self._cols(), key, tag)
        draw, parents = self, self.parents

        def drawn(rows: pd.DataFrame) -> pd.Series:  # one call for each combination of parents in an Arrow batch
            out = [None] * len(rows)
            for own, dist in CPD.by_distribution(draw, {p: rows[f"p{i}"].to_numpy() for i, p in enumerate(parents)} | {"_u": rows["u"].to_numpy()}):
                for i, v in zip(own.tolist(), dist.quantile(rows["u"].to_numpy()[own]).tolist(), strict=True):
                    out[i] = v
            return pd.Series(out)

        sample = F.pandas_udf(drawn, self.returns)
        return sample(F.struct(*(F.col(p).alias(f"p{i}") for i, p in enumerate(parents)), uniform(key, tag).alias("u")))


class ParentFunctionalCPD(FunctionalCPD):
    """The same with functions that also get the parents' names."""

    def __init__(self, name, parents, dist, columns=None, sampler=None, returns="double"):
        names = tuple(parents)
        bound = lambda f: f and (lambda at, *rest: f(at, names, *rest))
        super().__init__(name, parents, bound(dist), bound(columns), bound(sampler), returns)
