"""Factors: dense tables whose dimensions run over 1..n. The first dimension changes fastest."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.math import uniform

POTENTIAL = "potential"
#: Cells up to which a factor may be broadcast in a join.
BROADCAST_CELLS = 100_000
REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}
BINARY: dict[str, Callable[[Column, Column], Column]] = {"*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "/": lambda a, b: a / F.nullif(b, F.lit(0.0))}


class DimensionMismatch(ValueError):
    """Dimensions of one name differ in size, or values don't fit theirs."""


@dataclass(frozen=True)
class Factor:
    """A frame with columns dims and `potential`, and the size of each dimension. Every cell has a row."""

    df: DataFrame
    dims: tuple[str, ...]
    sizes: Mapping[str, int]

    def __post_init__(self):
        if len(set(self.dims)) != len(self.dims):
            raise ValueError("a dimension stands twice")
        if POTENTIAL in self.dims:
            raise ValueError("`potential` names the values")

    # Making

    @classmethod
    def filled(cls, spark: SparkSession, sizes: Mapping[str, int], value: float | None = 0.0) -> Factor:
        """All cells with one value."""
        df = spark.range(1).select(F.lit(value).cast("double").alias(POTENTIAL))
        for d, n in sizes.items():
            df = df.withColumn(d, F.explode(F.sequence(F.lit(1), F.lit(n))))
        return cls(df.select(*sizes, POTENTIAL), tuple(sizes), dict(sizes))

    @classmethod
    def of_values(cls, spark: SparkSession, sizes: Mapping[str, int], values: Iterable[float]) -> Factor:
        """Values in storage order."""
        values = np.array([float(v) for v in values])
        if len(values) != prod(sizes.values()):
            raise DimensionMismatch(f"{len(values)} values for {prod(sizes.values())} cells")
        columns, step = {}, 1
        for d, n in sizes.items():
            columns[d], step = (np.arange(len(values)) // step % n + 1).astype(np.int32), step * n
        cells = spark.createDataFrame(pa.table({**columns, POTENTIAL: values}))  # rows, not literals: a plan's size doesn't depend on them
        return cls(cells, tuple(sizes), dict(sizes))

    @classmethod
    def of_table(cls, table: DataFrame, sizes: Mapping[str, int]) -> Factor:
        """A table's rows, zero in the cells it lacks."""
        names = {d: f"_{d}" for d in sizes}
        rows = table.select(*(F.col(d).alias(n) for d, n in names.items()), F.col(POTENTIAL).alias("_p"))
        grid = cls.filled(table.sparkSession, sizes)
        joined = grid.df.join(rows, [F.col(d) == F.col(n) for d, n in names.items()], "left") if sizes else rows.withColumn(POTENTIAL, F.lit(0.0))
        return cls(joined.select(*sizes, F.coalesce("_p", F.lit(0.0)).alias(POTENTIAL)), tuple(sizes), dict(sizes))

    def _with(self, value: Column) -> Factor:
        return Factor(self.df.select(*self.dims, value.cast("double").alias(POTENTIAL)), self.dims, self.sizes)

    # What it is

    def __len__(self) -> int:
        return prod(self.sizes[d] for d in self.dims)

    def __contains__(self, name: str) -> bool:
        return name in self.dims

    @property
    def ndims(self) -> int:
        return len(self.dims)

    def shape(self, dims: Iterable[str] | None = None) -> tuple[int, ...]:
        return tuple(self.sizes[d] for d in self._known(self.dims if dims is None else dims))

    def index(self, names: Iterable[str]) -> list[int]:
        """1-based places of dimensions, 0 for unknown names."""
        return [self.dims.index(n) + 1 if n in self.dims else 0 for n in names]

    def _known(self, names: str | Iterable[str]) -> list[str]:
        names = [names] if isinstance(names, str) else list(names)
        if bad := [n for n in names if n not in self.dims]:
            raise ValueError(f"{bad} aren't dimensions of {list(self.dims)}")
        if len(set(names)) != len(names):
            raise ValueError("a dimension stands twice")
        return names

    def cell(self) -> Column:
        """1-based place in storage order."""
        place, step = F.lit(1), 1
        for d in self.dims:
            place, step = place + (F.col(d) - 1) * step, step * self.sizes[d]
        return place

    def values(self) -> list[float]:
        """All values in storage order, on the driver."""
        return [r[0] for r in self.df.select(POTENTIAL, self.cell().alias("_c")).orderBy("_c").collect()]

    def pattern(self, dims: Iterable[str] | None = None) -> DataFrame:
        """Combinations of states with their place, of the given dimensions as often as they come."""
        return self.df.select(*self._known(self.dims if dims is None else dims), self.cell().alias("cell"))

    # Cells

    def _checked(self, assignment: Mapping[str, object]) -> dict[str, int]:
        out = {}
        for d, v in assignment.items():
            if d not in self.dims or (isinstance(v, slice) and v == slice(None)):
                continue
            if not isinstance(v, int) or isinstance(v, bool):
                raise TypeError(f"{d}: states are integers, not {v!r}")
            if not 1 <= v <= self.sizes[d]:
                raise IndexError(f"{d} has no state {v}")
            out[d] = v
        return out

    def __getitem__(self, assignment: Mapping[str, object]) -> Factor:
        """The slice at the assignment, without its dimensions; slice(None) keeps one, unknown names are ignored."""
        at = self._checked(assignment)
        left = [d for d in self.dims if d not in at]
        df = self.df
        for d, v in at.items():
            df = df.filter(F.col(d) == v)
        return Factor(df.select(*left, POTENTIAL), tuple(left), {d: self.sizes[d] for d in left})

    def at(self, *place: int) -> float:
        """One value by its 1-based place, or by a state for each dimension."""
        if len(place) == 1:
            if not 1 <= place[0] <= len(self):
                raise IndexError(place[0])
            row = self.df.filter(self.cell() == place[0]).first()
        else:
            if len(place) != self.ndims:
                raise DimensionMismatch(f"{len(place)} states for {self.ndims} dimensions")
            row = self[dict(zip(self.dims, place, strict=True))].df.first()
        return row[POTENTIAL]

    def assign(self, assignment: Mapping[str, object], value: float) -> Factor:
        """The value in every cell that the assignment names."""
        hit = F.lit(True)
        for d, v in self._checked(assignment).items():
            hit = hit & (F.col(d) == v)
        return self._with(F.when(hit, F.lit(float(value))).otherwise(F.col(POTENTIAL)))

    def random(self, seed: int = 0) -> Factor:
        return self._with(uniform(self.cell(), f"factor|{seed}"))

    # Dimensions

    def push(self, name: str, size: int) -> Factor:
        """A new last dimension along which values repeat."""
        if name in self.dims:
            raise ValueError(f"{name} is a dimension already")
        df = self.df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(size))))
        return Factor(df.select(*self.dims, name, POTENTIAL), (*self.dims, name), {**self.sizes, name: size})

    def permute(self, dims: Iterable[str]) -> Factor:
        dims = self._known(dims)
        if len(dims) != self.ndims:
            raise DimensionMismatch("a permutation names every dimension")
        return Factor(self.df.select(*dims, POTENTIAL), tuple(dims), self.sizes)

    def normalize(self, dims: str | Iterable[str] | None = None, p: int = 1) -> Factor:
        """Divide by the sum of absolute values (p = 1) or of squares (p = 2): of all cells, or of each slice along dims."""
        if p not in (1, 2):
            raise ValueError("p is 1 or 2")
        along = None if dims is None else self._known(dims)
        rest = [] if along is None else [d for d in self.dims if d not in along]
        weight = F.abs(POTENTIAL) if p == 1 else F.col(POTENTIAL) * F.col(POTENTIAL)
        if rest:
            return self._with(F.col(POTENTIAL) / F.nullif(F.sum(weight).over(Window.partitionBy(*rest)), F.lit(0.0)))
        total = self.df.agg(F.sum(weight).alias("_t"))
        df = self.df.crossJoin(F.broadcast(total))
        return Factor(df.select(*self.dims, (F.col(POTENTIAL) / F.nullif("_t", F.lit(0.0))).alias(POTENTIAL)), self.dims, self.sizes)

    def reduce(self, op: str | Callable[[Column, Column], Column], dims: str | Iterable[str], start: float | None = None) -> Factor:
        """Drop dims, combining their cells: by a named reducer, or by a function of two columns from `start` in storage order."""
        gone = set(self._known(dims))
        rest = [d for d in self.dims if d not in gone]
        if callable(op):
            if start is None:
                raise ValueError("a function needs a start")
            cells = F.sort_array(F.collect_list(F.struct(self.cell().alias("c"), F.col(POTENTIAL).alias("p"))))  # one slice
            df = self.df.groupBy(*rest).agg(F.aggregate(cells, F.lit(float(start)), lambda s, x: op(s, x["p"])).alias(POTENTIAL))
        else:
            df = self.df.groupBy(*rest).agg(REDUCERS[op](F.col(POTENTIAL)).alias(POTENTIAL))
            if start is not None:
                folds = {"sum": lambda x: x + start, "prod": lambda x: x * start, "max": lambda x: F.greatest(x, F.lit(float(start))), "min": lambda x: F.least(x, F.lit(float(start)))}
                df = df.withColumn(POTENTIAL, folds[op](F.col(POTENTIAL)))
        return Factor(df.select(*rest, POTENTIAL), tuple(rest), {d: self.sizes[d] for d in rest})

    def sum(self, dims) -> Factor:
        return self.reduce("sum", dims)

    def prod(self, dims) -> Factor:
        return self.reduce("prod", dims)

    def max(self, dims) -> Factor:
        return self.reduce("max", dims)

    def min(self, dims) -> Factor:
        return self.reduce("min", dims)

    def broadcast(self, op: str | Callable, dims: str | Iterable[str], values) -> Factor:
        """Combine with a vector along each of dims, or with a number."""
        dims = self._known(dims)
        values = [values] if isinstance(dims, list) and len(dims) == 1 and not (isinstance(values, (list, tuple)) and values and isinstance(values[0], (list, tuple))) else list(values)
        if len(values) != len(dims):
            raise ValueError("as many values as dimensions")
        f = op if callable(op) else BINARY[op]
        out = F.col(POTENTIAL)
        for d, v in zip(dims, values, strict=True):
            if isinstance(v, (list, tuple)):
                if len(v) != self.sizes[d]:
                    raise DimensionMismatch(f"{len(v)} values along {d}, which has {self.sizes[d]}")
                out = f(out, F.element_at(F.array(*(F.lit(float(x)) for x in v)), F.col(d)))
            else:
                out = f(out, F.lit(float(v)))
        return self._with(out)

    # Pairs

    def join(self, op: str | Callable, other: Factor, how: str = "outer") -> Factor:
        """Combine cells that agree on shared dimensions. outer: over the union of dims; inner: over the shared ones, the rest summed out."""
        common = [d for d in self.dims if d in other.dims]
        for d in common:
            if self.sizes[d] != other.sizes[d]:
                raise DimensionMismatch(f"{d} has {self.sizes[d]} and {other.sizes[d]} states")
        a, b = self, other
        if how == "inner":
            a, b = (x.sum([d for d in x.dims if d not in common]) if len(common) < x.ndims else x for x in (a, b))
        elif how != "outer":
            raise ValueError(f"no join {how!r}")
        right = b.df.withColumnRenamed(POTENTIAL, "_b")
        right = F.broadcast(right) if len(b) <= BROADCAST_CELLS else right
        joined = a.df.withColumnRenamed(POTENTIAL, "_a")
        joined = joined.join(right, common) if common else joined.crossJoin(right)
        dims = (*a.dims, *(d for d in b.dims if d not in a.dims))
        value = (op if callable(op) else BINARY[op])(F.col("_a"), F.col("_b"))
        return Factor(joined.select(*dims, value.alias(POTENTIAL)), dims, {**a.sizes, **b.sizes})

    def __mul__(self, other: Factor) -> Factor:
        return self.join("*", other)

    def __truediv__(self, other: Factor) -> Factor:
        return self.join("/", other)

    def __add__(self, other: Factor) -> Factor:
        return self.join("+", other)

    def __sub__(self, other: Factor) -> Factor:
        return self.join("-", other)

    def to_frame(self) -> DataFrame:
        """Rows in storage order."""
        return self.df.orderBy(*(F.col(d) for d in reversed(self.dims)))

    def _repr_html_(self) -> str:
        cells = "".join(f"<tr>{''.join(f'<td>{x}</td>' for x in r)}</tr>" for r in self.to_frame().limit(100).collect())
        return f"<table><tr>{''.join(f'<th>{c}</th>' for c in self.df.columns)}</tr>{cells}</table>"
