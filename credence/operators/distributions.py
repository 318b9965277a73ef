"""Distributions with their densities as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import NEG_INF, alias_pick, alias_table, lgamma, normal, normal_logpdf, safe_ln, uniform


def count_params(x) -> int:
    """Numbers, flags and labels count one, sequences their parts."""
    return sum(map(count_params, x)) if isinstance(x, tuple) else len(x) if isinstance(x, list) else 1


class Distribution:
    """A family with fixed parameters. Subclasses give params, log_col, sample_col and fit."""

    @property
    def params(self) -> tuple:
        raise NotImplementedError

    @property
    def nparams(self) -> int:
        return count_params(self.params)

    def log_col(self, x: Column) -> Column:
        """Log density of a column."""
        raise NotImplementedError

    def sample_col(self, key: Column, tag: str) -> Column:
        """A draw for each row, by quantiles at its uniform number."""
        draw = self.quantile
        return F.pandas_udf(lambda u: pd.Series(draw(u.to_numpy())), "int" if self.discrete else "double")(uniform(key, tag))

    def logpdf(self, x) -> float:
        """Minus infinity outside the support."""
        raise NotImplementedError

    def pdf(self, x) -> float:
        return math.exp(self.logpdf(x))

    # What Markov chains ask for

    #: Whether values are counted rather than measured.
    discrete = False

    @property
    def support(self) -> tuple | None:
        """All values with a place in the distribution, where they are finitely many."""
        return None

    def insupport(self, x) -> bool:
        return x in self.support if self.support is not None else self.logpdf(x) > NEG_INF

    @property
    def std(self) -> float:
        raise NotImplementedError(f"{type(self).__name__} has no deviation")

    def log_array(self, x: np.ndarray) -> np.ndarray:
        """Log density of each entry."""
        return np.array([self.logpdf(v) for v in x.tolist()], float)

    def quantile(self, u: np.ndarray) -> np.ndarray:
        """The smallest value whose share of values up to it reaches u: turns uniform numbers into draws."""
        if self.support is None:
            raise NotImplementedError(f"{type(self).__name__} has no quantiles")
        upto = np.array(cumulative([self.pdf(v) for v in self.support]))
        at = np.minimum(np.searchsorted(upto, u, side="left"), len(upto) - 1)
        return np.array(self.support, object if isinstance(self.support[0], str) else None)[at]

    @classmethod
    def moments(cls, x: Column) -> dict[str, Column]:
        """Aggregates that `of` makes the distribution from."""
        raise NotImplementedError

    @classmethod
    def of(cls, m: dict) -> Distribution:
        raise NotImplementedError

    @classmethod
    def fit(cls, df: DataFrame, name: str) -> Distribution:
        """Maximum likelihood in one aggregation."""
        return cls.of(df.agg(*(v.alias(k) for k, v in cls.moments(F.col(name)).items())).first().asDict())


@dataclass(frozen=True)
class Normal(Distribution):
    mu: float
    sigma: float

    @property
    def params(self):
        return (self.mu, self.sigma)

    def log_col(self, x):
        return normal_logpdf(x, self.mu, self.sigma)

    def logpdf(self, x):
        d = (x - self.mu) / self.sigma
        return -0.5 * math.log(2 * math.pi) - math.log(self.sigma) - 0.5 * d * d

    def log_array(self, x):
        d = (x.astype(float) - self.mu) / self.sigma
        return -0.5 * math.log(2 * math.pi) - math.log(self.sigma) - 0.5 * d * d

    @property
    def std(self):
        return self.sigma

    def quantile(self, u):
        standard = NormalDist()
        return self.mu + self.sigma * np.array([standard.inv_cdf(v) for v in u.tolist()])

    def sample_col(self, key, tag):
        return self.mu + self.sigma * normal(key, tag)

    @classmethod
    def moments(cls, x):
        return {"mu": F.avg(x), "sigma": F.stddev_pop(x)}

    @classmethod
    def of(cls, m):
        return cls(m["mu"], m["sigma"])


@dataclass(frozen=True)
class Bernoulli(Distribution):
    p: float

    @property
    def params(self):
        return (self.p,)

    def log_col(self, x):
        return F.when(x.cast("boolean"), safe_ln(F.lit(self.p))).otherwise(safe_ln(F.lit(1 - self.p)))

    def logpdf(self, x):
        p = self.p if x else 1 - self.p
        return math.log(p) if p > 0 else NEG_INF

    discrete, support = True, (False, True)

    @property
    def std(self):
        return math.sqrt(self.p * (1 - self.p))

    def sample_col(self, key, tag):
        return uniform(key, tag) < self.p

    @classmethod
    def moments(cls, x):
        return {"p": F.avg(x.cast("int"))}

    @classmethod
    def of(cls, m):
        return cls(m["p"])


def cumulative(probs: Sequence[float]) -> list[float]:
    out, total = [], 0.0
    for p in probs:
        out.append(total := total + p)
    out[-1] = max(1.0, out[-1])
    return out


@dataclass(frozen=True)
class Categorical(Distribution):
    """States 1..n."""

    probs: tuple[float, ...]

    def __init__(self, probs: Sequence[float]):
        total = sum(probs)
        object.__setattr__(self, "probs", tuple(p / total for p in probs))

    @property
    def params(self):
        return (list(self.probs),)

    discrete = True

    @property
    def support(self):
        return tuple(range(1, len(self.probs) + 1))

    @property
    def std(self):
        mean = sum(k * p for k, p in enumerate(self.probs, 1))
        return math.sqrt(sum((k - mean) ** 2 * p for k, p in enumerate(self.probs, 1)))

    @property
    def ncategories(self) -> int:
        return len(self.probs)

    def log_array(self, x):
        with np.errstate(divide="ignore"):
            logs = np.log(np.array([*self.probs, 0.0]))
        return logs[np.where((x >= 1) & (x <= len(self.probs)), x - 1, len(self.probs)).astype(int)]

    def pdf(self, x):
        return self.probs[x - 1] if 1 <= x <= len(self.probs) else 0.0

    def logpdf(self, x):
        return math.log(self.pdf(x)) if self.pdf(x) > 0 else NEG_INF

    def log_col(self, x):
        return F.coalesce(F.get(F.array(*(F.lit(self.logpdf(k + 1)) for k in range(len(self.probs)))), x - 1), F.lit(NEG_INF))

    def sample_col(self, key, tag):
        return alias_pick(*alias_table(self.probs), uniform(key, tag))

    @classmethod
    def moments(cls, x):
        return {"total": F.count(x), "states": F.max(x)}

    @classmethod
    def fit(cls, df, name, ncategories: int | None = None):
        counts = {r[0]: r[1] for r in df.groupBy(name).count().collect()}
        return cls([counts.get(k + 1, 0) for k in range(ncategories or max(counts))])


@dataclass(frozen=True)
class NamedCategorical(Distribution):
    """Labels instead of numbers."""

    items: tuple
    probs: tuple[float, ...]

    def __init__(self, items: Sequence, probs: Sequence[float]):
        if len(set(items)) != len(items) or len(items) != len(probs):
            raise ValueError("a label for each probability, none twice")
        total = sum(probs)
        object.__setattr__(self, "items", tuple(items))
        object.__setattr__(self, "probs", tuple(p / total for p in probs))

    def __str__(self) -> str:
        return "\n".join(f"{x}: {p:.6g}" for x, p in zip(self.items, self.probs, strict=True))

    @property
    def params(self):
        return (list(self.probs),)

    discrete = True

    @property
    def support(self):
        return self.items

    @property
    def ncategories(self) -> int:
        return len(self.items)

    def pdf(self, x):
        return self.probs[self.items.index(x)] if x in self.items else 0.0

    def logpdf(self, x):
        return math.log(self.pdf(x)) if self.pdf(x) > 0 else NEG_INF

    def pdf_col(self, x: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, self.items)), x)  # 0 where it is none of them
        return F.coalesce(F.get(F.expr(f"array({', '.join(f'{p!r}D' for p in (0.0, *self.probs))})"), at.cast("int")), F.lit(0.0))

    def log_col(self, x):
        return safe_ln(self.pdf_col(x))

    def sample_col(self, key, tag):
        return F.get(F.array(*map(F.lit, self.items)), alias_pick(*alias_table(self.probs), uniform(key, tag)) - 1)

    @classmethod
    def fit(cls, df, name):
        rows = df.filter(F.col(name).isNotNull()).groupBy(name).count().orderBy(name).collect()
        return cls([r[0] for r in rows], [r[1] for r in rows])


@dataclass(frozen=True)
class Uniform(Distribution):
    """Equal density from low to high."""

    low: float
    high: float

    @property
    def params(self):
        return (self.low, self.high)

    def log_col(self, x):
        return F.when((x >= self.low) & (x <= self.high), F.lit(-math.log(self.high - self.low))).otherwise(F.lit(NEG_INF))

    def logpdf(self, x):
        return -math.log(self.high - self.low) if self.low <= x <= self.high else NEG_INF

    def log_array(self, x):
        return np.where((x >= self.low) & (x <= self.high), -math.log(self.high - self.low), NEG_INF)

    @property
    def std(self):
        return (self.high - self.low) / math.sqrt(12)

    def quantile(self, u):
        return self.low + (self.high - self.low) * u

    def sample_col(self, key, tag):
        return self.low + (self.high - self.low) * uniform(key, tag)

    @classmethod
    def moments(cls, x):
        return {"low": F.min(x), "high": F.max(x)}

    @classmethod
    def of(cls, m):
        return cls(m["low"], m["high"])


@dataclass(frozen=True)
class Exponential(Distribution):
    """Waiting times of a mean `scale`."""

    scale: float

    @property
    def params(self):
        return (self.scale,)

    def log_col(self, x):
        return F.when(x >= 0, -x / self.scale - math.log(self.scale)).otherwise(F.lit(NEG_INF))

    def logpdf(self, x):
        return -x / self.scale - math.log(self.scale) if x >= 0 else NEG_INF

    def log_array(self, x):
        return np.where(x >= 0, -x / self.scale - math.log(self.scale), NEG_INF)

    @property
    def std(self):
        return self.scale

    def quantile(self, u):
        return -self.scale * np.log1p(-u)

    def sample_col(self, key, tag):
        return -self.scale * F.log1p(-uniform(key, tag))

    @classmethod
    def moments(cls, x):
        return {"scale": F.avg(x)}

    @classmethod
    def of(cls, m):
        return cls(m["scale"])


@dataclass(frozen=True)
class Poisson(Distribution):
    """Counts of a mean `rate`; no finite support."""

    rate: float
    discrete = True

    @property
    def params(self):
        return (self.rate,)

    def log_col(self, x):
        return F.when((x >= 0) & (x == F.floor(x)), x * math.log(self.rate) - self.rate - lgamma(x + 1)).otherwise(F.lit(NEG_INF))

    def logpdf(self, x):
        return x * math.log(self.rate) - self.rate - math.lgamma(x + 1) if x >= 0 and x == int(x) else NEG_INF

    @property
    def std(self):
        return math.sqrt(self.rate)

    def quantile(self, u):
        k, p = 0, math.exp(-self.rate)
        upto, most = [p], float(np.max(u, initial=0.0))
        while upto[-1] < most and k < 10 * self.rate + 100:
            k += 1
            p *= self.rate / k
            upto.append(upto[-1] + p)
        return np.minimum(np.searchsorted(np.array(upto), u, side="left"), k)

    @classmethod
    def moments(cls, x):
        return {"rate": F.avg(x)}

    @classmethod
    def of(cls, m):
        return cls(m["rate"])
