"""Tables of potentials: frames with a column for each variable and `potential`. Absent combinations stay absent."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POTENTIAL = "potential"


def variables(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c != POTENTIAL]


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Natural full outer join that multiplies potentials (null where one side has no row); without shared variables every pair."""
    common = [v for v in variables(a) if v in variables(b)]
    left, right = a.withColumnRenamed(POTENTIAL, "_a"), b.withColumnRenamed(POTENTIAL, "_b")
    joined = left.join(right, common, "full_outer") if common else left.crossJoin(right)
    names = variables(a) + [v for v in variables(b) if v not in common]
    return joined.select(*names, (F.col("_a") * F.col("_b")).alias(POTENTIAL))


def sum_out(t: DataFrame, names: str | Iterable[str]) -> DataFrame:
    """Sum over variables; over all of them: one row."""
    gone = {names} if isinstance(names, str) else set(names)
    if missing := gone - set(variables(t)):
        raise ValueError(f"not in the table: {sorted(missing)}")
    return t.groupBy(*(v for v in variables(t) if v not in gone)).agg(F.sum(POTENTIAL).alias(POTENTIAL))


def normalize(t: DataFrame) -> DataFrame:
    """Potentials divided by their total. The total is one row, joined by broadcast, so rows need not meet in one task."""
    total = t.agg(F.sum(POTENTIAL).alias("_total"))
    return t.crossJoin(F.broadcast(total)).select(*variables(t), (F.col(POTENTIAL) / F.col("_total")).alias(POTENTIAL))


def consistent(df: DataFrame, assignment: Mapping[str, object]) -> DataFrame:
    """Rows that agree with the assignment on the names they have; other names are ignored."""
    tests = [F.col(k) == F.lit(v) for k, v in assignment.items() if k in df.columns]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


select_rows = consistent


def fit_table(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Relative frequency of each distinct row; a column `potential` weighs the rows."""
    names = names or [c for c in df.columns if c != POTENTIAL]
    weight = F.sum(POTENTIAL) if POTENTIAL in df.columns else F.count("*").cast("double")
    return normalize(df.groupBy(*names).agg(weight.alias(POTENTIAL)))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Equal columns and rows, in any order, repeated rows counted."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
