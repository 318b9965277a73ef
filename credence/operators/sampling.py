"""Rows drawn from a network. Uniform numbers depend on a row's key and a tag, so any task may draw any row, twice with the same result."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.math import uniform
from ..storage import new_path
from .chains import Chains
from .network import BayesNet
from .table import POTENTIAL, consistent


#: Attempts for each key in the first round of rejection, and rows of a few numbers up to which a counted side of a pick is broadcast.
FIRST_TRIES, PICK_BROADCAST = 4, 100_000


def keys(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "key")


def drawn(bn: BayesNet, at: DataFrame, seed: int = 0, evidence: Mapping[str, object] | None = None, attempt: Column | None = None) -> DataFrame:
    """One row of the network for each row of `at` (column key), node by node from the roots; evidence is set, not drawn."""
    key = F.concat_ws("|", F.col("key").cast("string"), *([attempt.cast("string")] if attempt is not None else []))
    for n, cpd in bn.cpds.items():
        value = F.lit(evidence[n]) if evidence and n in evidence else cpd.sample_col(key, f"{seed}|{n}")
        at = at.withColumn(n, value)
    return at


class Sampler(ABC):
    """Draws n rows. New samplers subclass this."""

    @abstractmethod
    def sample(self, spark: SparkSession, bn: BayesNet, n: int, seed: int = 0) -> DataFrame: ...


class DirectSampler(Sampler):
    def sample(self, spark, bn, n, seed=0):
        return drawn(bn, keys(spark, n), seed).select(*bn.names)


class RejectionSampler(Sampler):
    """Draws until the evidence holds, at most max_tries times a row; rows that never agree are left out.

    Attempts come in rounds, each of four times as many as the one before: keys that agree in one aren't drawn for again, so
    there are as many draws as the evidence's odds ask for, not max_tries for every key. A round draws the evidence and its ancestors
    alone and keeps the number of a key's first attempt that agrees; rows are drawn anew from these numbers. Each round is written.
    """

    def __init__(self, evidence: Mapping[str, object], max_tries: int = 100):
        self.evidence, self.max_tries = dict(evidence), max_tries

    def draw(self, bn: BayesNet, at: DataFrame, seed: int = 0) -> DataFrame:
        """(key, names) of the first attempt that agrees, for each key of at."""
        spark, held = at.sparkSession, {n: v for n, v in self.evidence.items() if n in bn.cpds}
        path, left, found, begin, many = new_path(spark, "rejection"), at.select("key"), None, 0, FIRST_TRIES
        needed = bn.dag.ancestors(set(held)) | set(held)
        roots = {n: v for n, v in held.items() if not bn.cpds[n].parents}
        first, rest = BayesNet(bn.cpds[n] for n in roots), BayesNet(bn.cpds[n] for n in bn.names if n in needed)
        # not a filter, which Spark would move below the draws with a copy of each wherever it is mentioned
        agrees = reduce(lambda a, b: a & b, (F.col(n) == F.lit(v) for n, v in held.items() if n not in roots), F.lit(True))
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # keys are few bytes, draws take long
        while begin < self.max_tries:
            end = min(self.max_tries, begin + many)
            tries = left.repartition(tasks, "key").select("key", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))).alias("_try"))
            tries = consistent(drawn(first, tries, seed, attempt=F.col("_try")), roots).select("key", "_try")
            hits = drawn(rest, tries, seed, attempt=F.col("_try")).groupBy("key").agg(F.min(F.when(agrees, F.col("_try"))).alias("_try")).filter("_try IS NOT NULL")
            hits.write.parquet(f"{path}/hits-{begin}")
            hits = spark.read.schema(hits.schema).parquet(f"{path}/hits-{begin}")
            found = hits if found is None else found.unionByName(hits)
            if end < self.max_tries:
                agreed = hits.select(F.col("key").alias("_agreed"))
                left.join(agreed, F.col("key").eqNullSafe(F.col("_agreed")), "left_anti").write.parquet(f"{path}/left-{begin}")
                left = spark.read.schema(left.schema).parquet(f"{path}/left-{begin}")
                if not left.limit(1).count():
                    break
            begin, many = end, 4 * many
        return drawn(bn, found, seed, attempt=F.col("_try")).select("key", *bn.names)

    def sample(self, spark, bn, n, seed=0):
        return self.draw(bn, keys(spark, n), seed).select(*bn.names)


def weighted(bn: BayesNet, at: DataFrame, evidence: Mapping[str, object], seed: int = 0) -> DataFrame:
    """(key, names, log_weight): evidence set, other nodes drawn, weighed by the evidence's density."""
    rows = drawn(bn, at, seed, evidence)
    log = sum((bn.cpds[n].log_col() for n in evidence), F.lit(0.0))
    return rows.select("key", *bn.names, log.alias("log_weight"))


class LikelihoodWeightedSampler(Sampler):
    def __init__(self, evidence: Mapping[str, object]):
        self.evidence = dict(evidence)

    def draw(self, bn: BayesNet, at: DataFrame, seed: int = 0) -> DataFrame:
        """(key, names, potential): weights divided by their sum; null if all are zero."""
        rows = weighted(bn, at, self.evidence, seed).withColumn(POTENTIAL, F.exp("log_weight")).drop("log_weight")
        total = rows.agg(F.sum(POTENTIAL).alias("_total"))
        return rows.crossJoin(F.broadcast(total)).withColumn(POTENTIAL, F.col(POTENTIAL) / F.nullif("_total", F.lit(0.0))).drop("_total")

    def sample(self, spark, bn, n, seed=0):
        return self.draw(bn, keys(spark, n), seed).select(*bn.names, POTENTIAL)

    def one(self, bn: BayesNet, spark: SparkSession, seed: int = 0) -> tuple[dict, float]:
        """An assignment and its weight."""
        r = weighted(bn, keys(spark, 1), self.evidence, seed).first().asDict()
        return {n: r[n] for n in bn.names}, float(np.exp(r["log_weight"]))


def _placed(parts: DataFrame) -> DataFrame:
    """Each part's stretch (_lo, _hi] of its bucket's weight, in the order of _k: adjoining ones, the last of which ends at 1."""
    own = Window.partitionBy("_b")
    parts = parts.withColumn("_at", F.sum(POTENTIAL).over(own.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("_hi", F.col("_at") / F.max("_at").over(own))
    return parts.withColumn("_lo", F.lag("_hi", 1, 0.0).over(own.orderBy("_k"))).drop("_at")


def weighted_pick(rows: DataFrame, picks: int = 1, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """`picks` rows by weight, with replacement: (pick, columns of rows). Weights that are null, NaN, infinite or not above 0 count as 0;
    if there are no others, there are no picks. `key` is a whole number that names a row; null keys are never picked.

    Prefix sums by levels: keys are parted into at most `buckets` ranges of equal width, a pick finds its range by the ranges' sums, and
    ranges that picks fell into are parted again until none has more than four times `buckets` rows. So a window holds as many
    rows at most, however unevenly the keys lie, and no level but the first passes over rows that no pick is near to.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "picks")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= PICK_BROADCAST else df

    rows = stored(rows, "rows").filter(F.col("key").isNotNull() & (F.col(POTENTIAL) > 0) & (F.col(POTENTIAL) < float("inf")))
    span = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    goals = keys(spark, picks).select(F.col("key").alias("pick"), uniform(F.col("key"), f"{seed}|pick").alias("_u"), F.lit(0).cast("long").alias("_b"))
    if span["lo"] is None:
        return goals.limit(0).select("pick").crossJoin(rows.limit(0))
    shift, level, part = 0, 0, F.lit(0).cast("long")
    while (span["hi"] >> shift) - (span["lo"] >> shift) >= buckets:
        shift += 1
    at = rows
    while shift:
        small = F.shiftright(F.col("key").cast("long"), shift)
        parts = at.withColumn("_b", part).withColumn("_k", small).groupBy("_b", "_k").agg(F.sum(POTENTIAL).alias(POTENTIAL), F.count("*").alias("_n"))
        parts = near(stored(_placed(parts), f"sums-{level}"))
        inside = (F.col("_u") > F.col("_lo")) & (F.col("_u") <= F.col("_hi"))
        goals = goals.select("pick", "_u", "_b").join(parts, "_b").filter(inside).select("pick", F.greatest(F.lit(1e-300), F.least(F.lit(1.0), (F.col("_u") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).alias("_u"), F.col("_k").alias("_b"), "_n")
        goals = stored(goals, f"goals-{level}")
        part = small
        chosen = near(stored(goals.select(F.col("_b").alias("_chosen")).distinct(), f"chosen-{level}"))
        at = rows.join(chosen, small == F.col("_chosen"), "left_semi")
        if goals.agg(F.max("_n")).first()[0] <= 4 * buckets:
            break
        shift, level = max(0, shift - max(1, buckets.bit_length() - 1)), level + 1
    last = _placed(at.withColumn("_b", part).withColumn("_k", F.col("key"))).select("_b", "_lo", "_hi", *rows.columns)
    found = near(goals.select("pick", "_u", "_b")).join(last, "_b").filter((F.col("_u") > F.col("_lo")) & (F.col("_u") <= F.col("_hi")))
    return found.select("pick", *rows.columns)


# Gibbs

#: Weighted draws for each chain's start, and rounds of eight times as many for chains that found none; rows that a chain gives unless
#: chains are counted out, and chains whose states are one array.
START_DRAWS, START_ROUNDS, CHAIN_ROWS, SIDE_BY_SIDE = 50, 4, 100, 1_000


class GibbsSampler(Sampler):
    """Markov chains that run side by side, each with a burn-in of its own.

    thinning sweeps are discarded before each kept one. Chains start from `initial`, or each from one of its own weighted draws.
    Nodes of finite support are drawn from their conditional, whatever kind of distribution they have; continuous ones walk inside
    their support; a discrete node of infinite support raises ValueError. Unless given, the number of chains grows with the rows asked
    for, four at least. Up to SIDE_BY_SIDE chains are updated together in a task, which hands its rows on sweep by sweep.
    time_limit (ms) bounds these; with error_if_time_out an expired one fails, else it returns what it has.
    """

    def __init__(self, burn_in: int = 100, thinning: int = 0, evidence: Mapping[str, object] | None = None, order: Sequence[str] | None = None, time_limit: int | None = None, error_if_time_out: bool = True, initial: Mapping[str, object] | None = None, max_cache_size: int = 100_000, chains: int | None = None):
        self.burn_in, self.thinning, self.evidence, self.order = burn_in, thinning, dict(evidence or {}), order
        self.time_limit, self.error_if_time_out, self.initial, self.cache, self.chains = time_limit, error_if_time_out, initial, max_cache_size, chains

    def checked(self, bn: BayesNet, n: int) -> None:
        if n <= 0:
            raise ValueError("nsamples must be positive")
        if self.burn_in < 0:
            raise ValueError("burn_in must not be negative")
        if self.thinning < 0:
            raise ValueError("thinning must not be negative")
        if self.order is not None and (set(self.order) != set(bn.names) or len(self.order) != len(bn.names)):
            raise ValueError("the order must name every variable once")
        if self.time_limit is not None and self.time_limit <= 0:
            raise ValueError("time_limit must be positive")
        if bad := set(self.evidence) - set(bn.names):
            raise ValueError(f"unknown variables {sorted(bad)}")
        if self.initial is not None:
            if missing := set(bn.names) - set(self.initial):
                raise ValueError(f"the initial sample lacks {sorted(missing)}")
            if any(self.initial[k] != v for k, v in self.evidence.items()):
                raise ValueError("the initial sample contradicts the evidence")
            if bn.pdf(self.initial) <= 0:
                raise ValueError("the initial sample has no density")

    def starts(self, spark: SparkSession, bn: BayesNet, chains: int, seed: int) -> DataFrame:
        """(chain, names) that chains start from: the initial sample, or one of the chain's weighted draws by its weight.

        A draw is picked by the largest log weight plus Gumbel noise, one mergeable maximum. Chains all of whose draws are
        impossible try again with more of them; ValueError if the last round leaves some.
        """
        every = spark.range(chains).select(F.col("id").alias("chain"))
        if self.initial is not None:
            return every.select("chain", *(F.lit(self.initial[n]).alias(n) for n in bn.names))
        path, found, left, base, draws = new_path(spark, "starts"), None, every, 0, START_DRAWS
        for r in range(START_ROUNDS):
            tries = left.select(F.expr(f"explode(sequence(chain * {draws} + {base}, chain * {draws} + {base + draws - 1}))").alias("key"))
            rows = weighted(bn, tries, self.evidence, seed).filter(F.col("log_weight") > float("-inf"))
            noise = -F.ln(-F.ln(uniform(F.col("key"), f"{seed}|start")))
            rows = rows.groupBy(F.expr(f"(key - {base}) div {draws}").alias("chain")).agg(F.max_by(F.struct(*bn.names), F.col("log_weight") + noise).alias("s"))
            rows.select("chain", "s.*").write.parquet(f"{path}/{r}")
            now = spark.read.parquet(f"{path}/{r}")
            found = now if found is None else found.unionByName(now)
            left = left.join(now.select("chain"), "chain", "left_anti")
            if not left.limit(1).count():
                return found
            base, draws = base + chains * draws, 8 * draws
        raise ValueError("no draw agrees with the evidence")

    def sample(self, spark, bn, n, seed=0):
        self.checked(bn, n)
        for name in set(bn.names) - set(self.evidence):
            bn.cpds[name].values()  # infinitely many states raise
        chains = min(n, self.chains or max(4, -(-n // CHAIN_ROWS)))
        starts = self.starts(spark, bn, chains, seed)
        types = {c: {"boolean": "boolean", "string": "string", "double": "double", "float": "double"}.get(t, "int") for c, t in starts.dtypes if c != "chain"}
        me, names = self, bn.names

        def run(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
            batch = batch.sort_values("chain")
            own, began = batch["chain"].to_numpy(), time.time()
            side = Chains(bn, me.evidence, own, {c: batch[c].to_numpy() for c in names}, seed, me.cache)
            wanted = n // chains + (own < n % chains)
            k = 0
            for i in range(me.burn_in + int(wanted.max())):
                if me.time_limit is not None and (time.time() - began) * 1000 > me.time_limit:
                    if me.error_if_time_out:
                        raise TimeoutError("a chain exceeded its time limit")
                    return
                for _ in range(1 + (me.thinning if i >= me.burn_in else 0)):
                    side.sweep(k, me.order)
                    k += 1
                if i >= me.burn_in:
                    yield pd.DataFrame({c: side.state[c][wanted > i - me.burn_in] for c in names})

        schema = ", ".join(f"`{c}` {types[c]}" for c in names)

        def whole(batch: pd.DataFrame) -> pd.DataFrame:
            parts = list(run(batch))
            return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in names})

        sides = starts.withColumn("_side", F.expr(f"chain div {SIDE_BY_SIDE}"))
        return sides.repartition(-(-chains // SIDE_BY_SIDE), "_side").groupBy("_side").applyInPandas(whole, schema)  # small rows, long work: not to be coalesced
