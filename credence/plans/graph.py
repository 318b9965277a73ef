"""Directed acyclic graphs: a driver-side object for networks, and the same queries over edge tables of any size."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path


class CycleError(ValueError):
    """An edge closes a cycle."""


class DAG:
    """Names in the order in which they came, and the ordered parents of each."""

    def __init__(self, names: Iterable[str] = (), edges: Iterable[tuple[str, str]] = ()):
        self._parents: dict[str, list[str]] = {n: [] for n in names}
        for p, c in edges:
            self.add_edge(p, c)

    @property
    def names(self) -> list[str]:
        return list(self._parents)

    def add_node(self, name: str) -> None:
        self._parents.setdefault(name, [])

    def add_edge(self, parent: str, child: str) -> None:
        for n in (parent, child):
            self.add_node(n)
        if parent in self._parents[child]:
            return
        if parent == child or child in self.ancestors({parent}):
            raise CycleError(f"{parent} -> {child} closes a cycle")
        self._parents[child].append(parent)

    def remove_edge(self, parent: str, child: str) -> None:
        self._parents[child].remove(parent)

    def remove_node(self, name: str) -> None:
        """Remove a node without children; its parents stay."""
        if kids := self.children(name):
            raise ValueError(f"{name} has children: {kids}")
        del self._parents[name]

    def edges(self) -> list[tuple[str, str]]:
        return [(p, c) for c, ps in self._parents.items() for p in ps]

    def parents(self, name: str) -> list[str]:
        return list(self._parents[name])

    def children(self, name: str) -> list[str]:
        return [c for c, ps in self._parents.items() if name in ps]

    def neighbors(self, name: str) -> list[str]:
        return self.parents(name) + self.children(name)

    def has_edge(self, parent: str, child: str) -> bool:
        """False also where a name is unknown."""
        return parent in self._parents.get(child, ())

    def _closed(self, start: set[str], step) -> set[str]:
        seen, todo = set(), list(start)
        while todo:
            for m in step(todo.pop()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    def ancestors(self, names: set[str]) -> set[str]:
        return self._closed(names, self.parents)

    def descendants(self, name: str) -> list[str]:
        below = self._closed({name}, self.children)
        return [n for n in self.topological() if n in below]

    def markov_blanket(self, name: str) -> set[str]:
        kids = self.children(name)
        return {*self.parents(name), *kids, *(p for c in kids for p in self.parents(c))} - {name}

    def topological(self) -> list[str]:
        """Parents before children, otherwise in the order of names."""
        out: list[str] = []
        while len(out) < len(self._parents):
            ready = [n for n, ps in self._parents.items() if n not in out and all(p in out for p in ps)]
            if not ready:
                raise CycleError("the graph has a cycle")
            out.append(ready[0])
        return out

    def stays_acyclic(self, parent: str, child: str) -> bool:
        """Whether parent -> child could be added."""
        return parent != child and child not in self.ancestors({parent})

    def separated(self, xs: Iterable[str], ys: Iterable[str], given: Iterable[str] = ()) -> bool:
        """d-separation of two sets: no active trail leads from one to the other. Adjacent nodes never are separated."""
        xs, ys, given = set(xs), set(ys), set(given)
        opened = given | self.ancestors(given)
        todo, seen = [(x, "up") for x in xs - given], set()
        while todo:
            n, way = todo.pop()
            if (n, way) in seen:
                continue
            seen.add((n, way))
            if n in ys and n not in given:
                return False
            if way == "up" and n not in given:
                todo += [(p, "up") for p in self.parents(n)] + [(c, "down") for c in self.children(n)]
            elif way == "down":
                if n not in given:
                    todo += [(c, "down") for c in self.children(n)]
                if n in opened:  # a collider, seen itself or by a descendant
                    todo += [(p, "up") for p in self.parents(n)]
        return True

    def edge_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, c, i) for c in self.names for i, p in enumerate(self.parents(c))]
        return spark.createDataFrame(rows, "parent string, child string, pos int")


# Over edge tables (parent, child)


def parents_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n_parents"))


def children_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))


def neighbor_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("near")).union(edges.select("parent", "child")).distinct()


def blanket_pairs(edges: DataFrame) -> DataFrame:
    """(node, other): parents, children and the children's other parents. A pair is made and told apart once, then given both ways."""
    e = edges.select("parent", "child").distinct()
    turned = F.coalesce(F.col("parent") > F.col("child"), F.col("child").isNull())  # nulls first
    near = e.select(F.when(turned, F.col("child")).otherwise(F.col("parent")).alias("low"), F.when(turned, F.col("parent")).otherwise(F.col("child")).alias("high"))
    mates = e.select(F.col("parent").alias("low"), "child").join(e.select(F.col("parent").alias("high"), "child"), "child").filter("low < high").select("low", "high")
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    both = F.when(F.col("low").eqNullSafe(F.col("high")), F.array(way("low", "high"))).otherwise(F.array(way("low", "high"), way("high", "low")))
    return near.union(mates).distinct().select(F.inline(both))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def descendant_pairs(edges: DataFrame) -> DataFrame:
    """(node, below): every node that another one reaches. Only new pairs that end in a node with children (goes) go a step on, until
    none is left; each round is written. Steps are the edges of nodes that have parents too, and new pairs are held against those of
    nodes that reach further than their children alone."""
    path = new_path(edges.sparkSession, "descendants")
    near = lambda df: F.broadcast(df) if df.count() <= 100_000 else df
    e = edges.select("parent", "child").distinct()
    goes = e.select(F.col("parent").alias("child")).distinct().withColumn("goes", F.lit(True))
    e = _written(e.join(goes, "child", "left").select("parent", "child", F.coalesce("goes", F.lit(False)).alias("goes")), f"{path}/edges")
    inner = _written(e.filter("goes").select(F.col("child").alias("parent")).distinct(), f"{path}/inner")
    step = _written(e.join(near(inner), "parent", "left_semi").select(F.col("parent").alias("below"), F.col("child").alias("next"), F.col("goes").alias("on")), f"{path}/steps")
    far = _written(e.filter("goes").select("parent").distinct(), f"{path}/far")
    found = level = e.select(F.col("parent").alias("node"), F.col("child").alias("below"), "goes")
    old, k = _written(e.join(near(far), "parent", "left_semi").select(F.col("parent").alias("node"), F.col("child").alias("below")), f"{path}/old"), 0
    while level.filter("goes").limit(1).count():
        k += 1
        new = level.filter("goes").join(step, "below").select("node", F.col("next").alias("below"), F.col("on").alias("goes")).distinct()
        level = _written(new.join(old, ["node", "below"], "left_anti"), f"{path}/{k}")
        found, old = found.unionByName(level.select(*found.columns)), old.union(level.select("node", "below"))
    return found.select("node", "below")


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest way from a root; ordered by depth, parents come before children. A cycle raises ValueError.

    Round by round the nodes without a parent are peeled off with their edges. A cycle shows in the first round that peels
    nothing: after as many rounds as the part before it is deep, however many nodes there are.
    """
    path = new_path(edges.sparkSession, "depths")
    e = _written(edges.select("parent", "child").distinct(), f"{path}/edges")
    left = _written(e.select(F.col("parent").alias("node")).union(e.select("child")).distinct(), f"{path}/nodes")
    out, k = left.withColumn("depth", F.lit(0)).limit(0), 0
    while left.limit(1).count():
        ready = _written(left.join(e.select(F.col("child").alias("node")), "node", "left_anti"), f"{path}/{k}/ready")
        if not ready.limit(1).count():
            raise ValueError("the edges have a cycle")
        out = out.union(ready.withColumn("depth", F.lit(k)))
        e = _written(e.join(ready.select(F.col("node").alias("parent")), "parent", "left_anti"), f"{path}/{k}/edges")
        left = _written(left.join(ready, "node", "left_anti"), f"{path}/{k}/nodes")
        k += 1
    return out


def _asked(path: str, *parts: DataFrame) -> DataFrame:
    """(_asked, part, bit): the different questions, numbered; 64 of one part have a bit each of a whole number."""
    every = _written(reduce(DataFrame.union, (df.select(F.col("question").alias("_asked")) for df in parts)).distinct(), f"{path}/questions")
    dealt = every.repartition(1 + every.count() // 1_000_000).withColumn("id", F.monotonically_increasing_id())
    return _written(dealt.select("_asked", F.shiftright("id", 6).alias("part"), F.expr("shiftleft(1L, CAST(id & 63 AS INT))").alias("bit")), f"{path}/asked")


@contextmanager
def _moves(e: DataFrame, path: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(node, next) to parents and to children, laid down in buckets by node: joins with them deal out the other side alone."""
    spark, made = e.sparkSession, []
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        for way, (at, to) in {"up": ("child", "parent"), "down": ("parent", "child")}.items():
            made.append(f"credence_{way}_{uuid.uuid4().hex}")
            e.select(F.col(at).alias("node"), F.col(to).alias("next")).repartition(n, "node").write.bucketBy(n, "node").option("path", f"{path}/{way}").saveAsTable(made[-1])
        yield tuple(map(spark.table, made))
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def connected(edges: DataFrame, starts: DataFrame, given: DataFrame) -> DataFrame:
    """(question, node): all nodes that an active trail joins to one of a question's starts, its evidence left out.

    starts, given: (question, node); the starts themselves are in the answer unless they are evidence. A node's row has a bit for each of
    64 questions, for trails that came up to it and down to it. Only new bits go a step on, until there are none, and each round is
    written. Evidence and its ancestors, which open colliders, are marked first. The edges are dealt out by node once.
    """
    path = new_path(edges.sparkSession, "connected")
    e = _written(edges.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL").distinct(), f"{path}/edges")
    asked = _asked(path, starts, given)

    def bits(df: DataFrame) -> DataFrame:
        few = df.select("question", "node").filter("node IS NOT NULL").join(asked, F.col("question").eqNullSafe(F.col("_asked")))
        return few.groupBy("part", "node").agg(F.bit_or("bit").alias("m"))

    def step(level: DataFrame, moves: DataFrame, m: str) -> DataFrame:
        return level.filter(f"{m} <> 0").select("part", "node", F.col(m).alias("m")).hint("shuffle_hash").join(moves, "node").select("part", F.col("next").alias("node"), "m")

    def merged(**parts: tuple[DataFrame, list[str]]) -> DataFrame:
        """Rows of several tables by node, in one pass: no table is sorted to be joined."""
        names = [f"{k}_{c}" for k, (_, cs) in parts.items() for c in cs]
        rows = [df.select("part", "node", *(F.col(n.split("_")[1]).alias(n) if n in {f"{k}_{c}" for c in cs} else F.lit(0).cast("long").alias(n) for n in names)) for k, (df, cs) in parts.items()]
        return reduce(DataFrame.union, rows).groupBy("part", "node").agg(*(F.bit_or(n).alias(n) for n in names))

    with _moves(e, path) as (up, down):
        held = level = opened = _written(bits(given), f"{path}/held")
        k = 0
        while level.limit(1).count():
            k += 1
            new = merged(new=(step(level, up, "m"), ["m"]), old=(opened, ["m"])).select("part", "node", F.expr("new_m & ~old_m").alias("m")).filter("m <> 0")
            level = _written(new, f"{path}/opened/{k}")
            opened = opened.union(level)
        marks = _written(merged(held=(held, ["m"]), open=(opened, ["m"])).select("part", "node", F.col("held_m").alias("h"), F.col("open_m").alias("o")), f"{path}/marks")

        def onward(u: str, d: str) -> list[Column]:
            """Trails that came up go on both ways unless the node is evidence, those that came down go on down then, and up from an open collider."""
            return ["part", "node", F.expr(u).alias("u"), F.expr(d).alias("d"), F.col("mark_h").alias("h"), F.expr(f"({u} & ~mark_h) | ({d} & mark_o)").alias("up"), F.expr(f"({u} | {d}) & ~mark_h").alias("down")]

        first = merged(new=(bits(starts), ["m"]), mark=(marks, ["h", "o"])).filter("new_m & ~mark_h <> 0")
        level, k = _written(first.select(*onward("(new_m & ~mark_h)", "0L")), f"{path}/0"), 0
        found = level
        while level.limit(1).count():
            k += 1
            above, below = step(level, up, "up"), step(level, down, "down")
            new = merged(up=(above, ["m"]), down=(below, ["m"]), old=(found, ["u", "d"]), mark=(marks, ["h", "o"]))
            new = new.filter("(up_m & ~old_u) <> 0 OR (down_m & ~old_d) <> 0")
            level = _written(new.select(*onward("(up_m & ~old_u)", "(down_m & ~old_d)")), f"{path}/{k}")
            found = found.union(level)
    met = found.groupBy("part", "node").agg(F.bit_or(F.expr("(u | d) & ~h")).alias("m")).filter("m <> 0")
    return met.join(F.broadcast(asked) if asked.count() <= 100_000 else asked, "part").filter("m & bit <> 0").select(F.col("_asked").alias("question"), "node")


def separated(edges: DataFrame, xs: DataFrame, ys: DataFrame, given: DataFrame) -> DataFrame:
    """(question, separated): d-separation of two sets in each question; all frames but edges are (question, node). As DAG.separated."""
    asked = xs.select("question").union(ys.select("question")).distinct()
    met = connected(edges, xs, given).join(ys.select("question", "node").distinct(), ["question", "node"], "left_semi").select("question").distinct()
    return asked.join(met.withColumn("met", F.lit(True)), "question", "left").select("question", F.col("met").isNull().alias("separated"))
