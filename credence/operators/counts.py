"""Contingency tables and sufficient statistics. The data is passed over once, whatever the number of variables: each row is dealt out to the cells of all families."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.graph import DAG
from ..storage import new_path


def joint_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct rows with their number `n`: at most as many as the variables have combinations, however large the data."""
    return df.groupBy(*names).agg(F.count("*").alias("n"))


def count(df: DataFrame, name: str, parents: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Observed combinations of parents and target with their `count`."""
    return df.groupBy(*parents, name).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("count"))


def families(dag: DAG) -> dict[str, list[str]]:
    """Parents by node, parents first."""
    return {n: dag.parents(n) for n in dag.topological()}


Family = tuple[str, tuple[str, ...]]
#: Families that are counted in one pass over the data, and combinations of states up to which rows are first joined to distinct ones.
BATCH, JOINT = 500, 1_000_000
#: Families above which rows go to NumPy with their states packed into whole numbers of PACK variables, and cells of a family up to which it adds up an array of them all.
NARROW, PACK, DENSE = 16, 12, 4096
#: Bytes of a generated method above which Java doesn't compile it.
METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def counted(df: DataFrame, names: Sequence[str], sizes: Mapping[str, int]) -> DataFrame:
    """Rows to count families from: names and their number `n`. Distinct rows where the variables have few combinations, else the rows as they are, which hardly repeat."""
    few = prod(max(1, sizes[n]) for n in names) <= JOINT
    rows = df.groupBy(*map(F.col, map(quoted, names))).agg(F.count("*").alias("n")) if few else df.select(*map(F.col, map(quoted, names)), F.lit(1).cast("long").alias("n"))
    return rows.select(*(state(n, sizes[n]).cast("int").alias(n) for n in names), "n")


def cell_number(target: str, parents: Sequence[str], sizes: Mapping[str, int]) -> str:
    """SQL of a row's 0-based cell in a family's table: the target's state fastest, then the parents' in order."""
    terms, step = [f"({quoted(target)} - 1)"], max(1, sizes[target])
    for p in parents:
        terms.append(f"({quoted(p)} - 1) * {step}L")
        step *= max(1, sizes[p])
    if step >= 1 << 62:
        raise ValueError(f"the table of {target} given {list(parents)} has more cells than numbers")
    return f"CAST({' + '.join(terms)} AS BIGINT)"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs within it split expressions of many columns into methods that Java compiles, instead of one that it interprets."""
    name, limit = METHOD
    before = spark.conf.get(name, None)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def packed(names: Sequence[str], sizes: Mapping[str, int]) -> list[list[tuple[str, int, int]]]:
    """Variables by the number that holds them: (name, lowest bit, bits) of each. At most PACK variables and 62 bits a number."""
    out, low = [], 63
    for n in names:
        bits = max(1, sizes[n]).bit_length()
        if low + bits > 62 or len(out[-1]) == PACK:
            out.append([])
            low = 0
        out[-1].append((n, low, bits))
        low += bits
    return out


def _wide_cells(rows: DataFrame, wanted: Sequence[Family], sizes: Mapping[str, int], path: str) -> DataFrame:
    """cells() of many families: a row goes to NumPy as a few numbers of packed states (0: null), and each task adds up its rows.

    Families of up to DENSE cells, nulls among them, have an array of counts in the task; of larger ones each batch's distinct cells
    are handed on. The counts are written.
    """
    for t, ps in wanted:
        cell_number(t, ps, sizes)  # more cells than numbers: ValueError
    names = list(dict.fromkeys(n for t, ps in wanted for n in (t, *ps)))
    numbers = packed(names, sizes)
    pack = lambda of: reduce(lambda a, b: a + b, (F.coalesce(F.col(quoted(n)), F.lit(0)).cast("long") * (1 << low) for n, low, _ in of))
    at = {n: i for i, n in enumerate(names)}
    members = [[at[n] for n in (t, *ps)] for t, ps in wanted]
    radix = [[max(1, sizes[n]) for n in (t, *ps)] for t, ps in wanted]
    fields = [(i, low, (1 << bits) - 1) for i, of in enumerate(numbers) for _, low, bits in of]
    schema = pa.schema([("at", pa.int32()), ("cell", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [prod(r + 1 for r in rs) for rs in radix]
        sums = {f: np.zeros(size, np.int64) for f, size in enumerate(full) if size <= DENSE}

        def rest(f: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), f, np.int32)), pa.array(cell), pa.array(n)], schema=schema)

        for b in batches:
            held = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(numbers))]
            n = b.column(len(numbers)).to_numpy(zero_copy_only=False)
            ones = bool((n == 1).all())
            states = [(held[i] >> low) & mask for i, low, mask in fields]
            for f, (own, rs) in enumerate(zip(members, radix, strict=True)):
                if f in sums:
                    cell, step = states[own[0]], rs[0] + 1
                    for i, r in zip(own[1:], rs[1:], strict=True):
                        cell, step = cell + states[i] * step, step * (r + 1)
                    if ones:
                        sums[f] += np.bincount(cell, minlength=step)
                    else:
                        np.add.at(sums[f], cell, n)
                    continue
                inside = np.logical_and.reduce([states[i] > 0 for i in own])
                cell, step = np.zeros(int(inside.sum()), np.int64), 1
                for i, r in zip(own, rs, strict=True):
                    cell, step = cell + (states[i][inside] - 1) * step, step * r
                found, where = np.unique(cell, return_inverse=True)
                own_n = np.zeros(len(found), np.int64)
                np.add.at(own_n, where, n[inside])
                yield rest(f, found, own_n)
        for f, total in sums.items():
            seen = np.flatnonzero(total)
            left, cell, step, inside = seen, np.zeros(len(seen), np.int64), 1, np.ones(len(seen), bool)
            for r in radix[f]:
                left, state = np.divmod(left, r + 1)
                cell, step, inside = cell + (state - 1) * step, step * r, inside & (state > 0)
            yield rest(f, cell[inside], total[seen][inside])

    parts = rows.select(*(pack(of).alias(f"p{i}") for i, of in enumerate(numbers)), F.col("n").cast("long").alias("n")).mapInArrow(count, "at int, cell long, n long")
    with compiled_methods(rows.sparkSession):
        parts.groupBy("at", "cell").agg(F.sum("n").cast("long").alias("n")).write.parquet(path)
    return rows.sparkSession.read.schema("at int, cell long, n long").parquet(path)


def cells(rows: DataFrame, wanted: Sequence[Family], sizes: Mapping[str, int]) -> DataFrame:
    """(family, cell, n) of observed cells; family: its place in `wanted`.

    Each row adds one to a cell of each family, and tasks add up before anything is shuffled: the data is read once for every BATCH
    families, and no limit holds on the number of variables. A row with a null in a family isn't counted there. Counts of more than
    NARROW families are written.
    """
    if len(wanted) > NARROW:
        path = new_path(rows.sparkSession, "cells")
        wide = [_wide_cells(rows, wanted[i : i + BATCH], sizes, f"{path}/{i}").select((F.col("at") + i).alias("family"), "cell", "n") for i in range(0, len(wanted), BATCH)]
        return reduce(DataFrame.unionByName, wide)
    parts = []
    for i in range(0, len(wanted), BATCH):
        numbers = ", ".join(cell_number(t, ps, sizes) for t, ps in wanted[i : i + BATCH])
        each = rows.select("n", F.posexplode(F.expr(f"array({numbers})")).alias("at", "cell")).filter("cell IS NOT NULL")
        parts.append(each.groupBy("at", "cell").agg(F.sum("n").cast("long").alias("n")).select((F.col("at") + i).alias("family"), "cell", "n"))
    return reduce(DataFrame.unionByName, parts)


class Contingency:
    """A table of counts on the driver, for variables with at most LOCAL combinations of states: a search asks it for one family after the other."""

    #: About half a megabyte of numbers.
    LOCAL = 1 << 16

    def __init__(self, rows: DataFrame, names: Sequence[str], sizes: Mapping[str, int]):
        self.names = list(names)
        self.table = np.zeros([max(1, sizes[n]) for n in names])
        for *at, n in rows.groupBy(*map(F.col, map(quoted, names))).agg(F.sum("n")).collect():
            if None not in at:
                self.table[tuple(x - 1 for x in at)] += n

    @classmethod
    def fits(cls, names: Sequence[str], sizes: Mapping[str, int]) -> bool:
        return prod(max(1, sizes[n]) for n in names) <= cls.LOCAL

    def counts(self, family: Family) -> np.ndarray:
        """Rows of the target's states by configuration, the first parent fastest."""
        own = [self.names.index(n) for n in (*reversed(family[1]), family[0])]
        summed = self.table.sum(axis=tuple(i for i in range(len(self.names)) if i not in own))
        kept = sorted(own)
        return summed.transpose([kept.index(i) for i in own]).reshape(-1, self.table.shape[own[-1]])


def count_families(joint: DataFrame, dag: DAG, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Long form of all nodes' counts: (target, q, k, n), in one pass over rows with their number `n`. q numbers the parents' states, the first fastest, k the target's state."""
    names = dag.topological()
    sizes = sizes or cardinalities(joint, names)
    return family_counts(joint.select(*(state(n, sizes[n]).cast("int").alias(n) for n in names), "n"), dag, sizes)


def family_counts(rows: DataFrame, dag: DAG, sizes: Mapping[str, int]) -> DataFrame:
    """The same from rows whose states were checked, as counted() gives them."""
    wanted = [(c, tuple(ps)) for c, ps in families(dag).items()]
    named = rows.sparkSession.createDataFrame([(i, c, max(1, sizes[c])) for i, (c, _) in enumerate(wanted)], "family int, target string, r long")  # a row a family
    long = cells(rows, wanted, sizes).join(F.broadcast(named), "family")
    whole = "int" if all(prod(max(1, sizes[p]) for p in ps) < 1 << 31 for _, ps in wanted) else "long"
    return long.select("target", (F.expr("cell div r") + 1).cast(whole).alias("q"), (F.col("cell") % F.col("r") + 1).cast("int").alias("k"), "n")


def cardinalities(df: DataFrame, names: Iterable[str]) -> dict[str, int]:
    """Largest state of each variable; all in one aggregation. States begin at 1."""
    names = list(names)
    row = df.agg(*(f(quoted(n)).alias(f"x{i}") for i, n in enumerate(names) for f in (F.min, F.max))).first()
    if bad := [n for i, n in enumerate(names) if row[2 * i] is not None and row[2 * i] < 1]:
        raise ValueError(f"states below 1 in {bad}")
    return {n: row[2 * i + 1] or 0 for i, n in enumerate(names)}


def state(name: str, size: int) -> Column:
    """The column, which must lie within 1..size: another state fails the query. Nulls pass."""
    x = F.col(quoted(name))
    told = F.concat(F.lit(f"{name} has a state out of 1..{size}: "), x.cast("string"))
    return F.when((x < 1) | (x > size), F.raise_error(told).cast("int")).otherwise(x)


def config(parents: Sequence[str], sizes: Mapping[str, int]) -> Column:
    """1-based number of the parents' states, the first parent fastest; a state beyond its parent's size fails the query."""
    q, step = F.lit(1), 1
    for p in parents:
        q, step = q + (state(p, sizes[p]) - 1) * step, step * sizes[p]
    return q


def statistics(df: DataFrame, target: str, parents: Sequence[str], sizes: Mapping[str, int] | None = None, weight: str | None = None) -> DataFrame:
    """(q, k, n) for every configuration q and state k, zeros included."""
    sizes = sizes or cardinalities(df, [target, *parents])
    found = df.groupBy(config(parents, sizes).cast("int").alias("_q"), state(target, sizes[target]).cast("int").alias("_k")).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("_n"))
    configs = reduce(lambda a, p: a * sizes[p], parents, 1)
    grid = df.sparkSession.range(configs).select((F.col("id") + 1).cast("int").alias("q"), F.explode(F.sequence(F.lit(1), F.lit(sizes[target]))).alias("k"))
    joined = grid.join(found, (F.col("q") == F.col("_q")) & (F.col("k") == F.col("_k")), "left")
    return joined.select("q", "k", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def statistics_matrix(df: DataFrame, target: str, parents: Sequence[str], sizes: Mapping[str, int] | None = None) -> list[list[int]]:
    """The same as rows of states by configurations, on the driver."""
    sizes = sizes or cardinalities(df, [target, *parents])
    configs = reduce(lambda a, p: a * sizes[p], parents, 1)
    out = [[0] * configs for _ in range(sizes[target])]
    for r in statistics(df, target, parents, sizes).collect():
        out[r["k"] - 1][r["q"] - 1] = r["n"]
    return out


def statistics_all(df: DataFrame, dag: DAG, sizes: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """A3 for each node, from the joint table."""
    if missing := set(dag.names) - set(df.columns):
        raise ValueError(f"the data lacks {sorted(missing)}")
    joint = joint_counts(df, dag.names)
    sizes = sizes or cardinalities(joint, dag.names)
    return {c: statistics(joint, c, ps, sizes, "n") for c, ps in families(dag).items()}


def pivoted(stats: DataFrame, states: int) -> DataFrame:
    """Statistics with a column s1..sr for each state."""
    wide = stats.groupBy("q").pivot("k", list(range(1, states + 1))).agg(F.sum("n"))
    return wide.select("q", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"s{k}") for k in range(1, states + 1)))


def encoded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Labels as codes 1..n by their order. The dictionary is made of distinct values, ranked apart from the data: by ranges of labels, then within each."""
    for n in names:
        codes = df.select(F.col(n).alias("_label")).distinct().filter(F.col(n).isNotNull()).repartitionByRange("_label")
        path = new_path(df.sparkSession, "labels")
        codes.withColumn("_range", F.spark_partition_id()).write.parquet(path)
        codes = df.sparkSession.read.parquet(path)
        ranges = codes.groupBy("_range").agg(F.count("*").alias("_m"))  # a row a task
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy("_range").orderBy("_label"))
        codes = codes.withColumn("_own", own).join(F.broadcast(ranges), F.col("_range") == F.col("_of"))
        codes = codes.select("_label", (F.col("_before") + F.col("_own")).cast("int").alias("_code"))
        df = df.join(F.broadcast(codes) if codes.count() <= 100_000 else codes, F.col(n) == F.col("_label"), "left").withColumn(n, F.col("_code")).drop("_label", "_code")
    return df
