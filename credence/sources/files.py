"""Readers and writers of networks. Files are read through Spark, so any file system that it knows will do."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import SparkSession

from ..operators.cpd import DiscreteCPD
from ..operators.network import BayesNet
from ..plans.graph import DAG


def _text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: {len(rows)} files")
    return rows[0][0]


def read_xdsl(spark: SparkSession, path: str) -> BayesNet:
    """GeNIe's .xdsl: states are counted, parents stand with the slowest first, before their children."""
    if not path.endswith(".xdsl"):
        raise ValueError(f"{path} is no .xdsl file")
    return parse_xdsl(_text(spark, path))


def parse_xdsl(text: str) -> BayesNet:
    bn = BayesNet()
    for node in ET.fromstring(text.encode()).find("nodes"):
        states = len(node.findall("state"))
        parents = (node.findtext("parents") or "").split()[::-1]
        if missing := [p for p in parents if p not in bn.cpds]:
            raise ValueError(f"{node.get('id')}: parents {missing} come later or not at all")
        p = [float(x) for x in node.findtext("probabilities").split()]
        rows = [p[i : i + states] for i in range(0, len(p), states)]
        bn.add(DiscreteCPD(node.get("id"), rows if parents else rows[0], parents, [bn[x].ncategories for x in parents]))
    return bn


def to_text(bn: BayesNet) -> str:
    """Labels; adjacency rows; numbers of states; all probabilities but each row's last. Rows vary parents in the order of labels, the first fastest."""
    names, sizes = bn.names, bn.sizes()
    lines = [" ".join(names), *("".join("1" if bn.dag.has_edge(p, c) else "0" for c in names) for p in names), " ".join(str(sizes[n]) for n in names)]
    flat = []
    for n in names:
        cpd = bn[n]
        order = [p for p in names if p in cpd.parents]
        for q in range(len(cpd.dists)):
            at, rest = {}, q
            for p in order:
                rest, k = divmod(rest, sizes[p])
                at[p] = k + 1
            flat += cpd(at).probs[:-1]
    return "\n".join([*lines, " ".join(f"{x:.16g}" for x in flat)]) + "\n"


def parse_text(text: str) -> BayesNet:
    """The inverse of to_text; a last probability that comes out negative is zero and its row is scaled to one."""
    lines = text.strip("\n").split("\n")
    names = lines[0].split()
    n = len(names)
    sizes = dict(zip(names, map(int, lines[n + 1].split()), strict=True))
    numbers = iter(map(float, " ".join(lines[n + 2 :]).split()))
    cpds = []
    for j, name in enumerate(names):
        parents = [p for i, p in enumerate(names) if lines[i + 1][j] == "1"]
        configs = 1
        for p in parents:
            configs *= sizes[p]
        rows = []
        for _ in range(configs):
            row = [next(numbers) for _ in range(sizes[name] - 1)]
            rows.append([*row, max(0.0, 1 - sum(row))])
        cpds.append(DiscreteCPD(name, rows if parents else rows[0], parents, [sizes[p] for p in parents]))
    return BayesNet(cpds)


def write_text(spark: SparkSession, bn: BayesNet, path: str) -> None:
    """A folder with one text file."""
    spark.createDataFrame([(to_text(bn).rstrip("\n"),)], "value string").coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str) -> BayesNet:
    return parse_text("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def to_dot(dag: DAG, title: str = "network") -> str:
    """Graphviz source."""
    quoted = lambda s: '"' + s.replace('"', r"\"") + '"'
    return "\n".join([f"digraph {quoted(title)} {{", *(f"  {quoted(n)};" for n in dag.names), *(f"  {quoted(p)} -> {quoted(c)};" for p, c in dag.edges()), "}"]) + "\n"
