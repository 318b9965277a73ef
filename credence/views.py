"""Tables seen as variables of a model: states 1..n, or numbers. The expressions are valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.graph import DAG

#: View: (table, columns).
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "line": ("lineitem", {
        "qb": "CAST(least(5, 1 + floor((l_quantity - 1) / 10)) AS INT)",
        "pb": "CASE WHEN l_extendedprice > 50000 THEN 2 ELSE 1 END",
        "db": "CASE WHEN l_discount >= 0.05 THEN 2 ELSE 1 END",
        "nb": "CASE WHEN l_extendedprice * (1 - l_discount) > 50000 THEN 2 ELSE 1 END",
        "ub": "CASE WHEN l_extendedprice / l_quantity > 2000 THEN 2 ELSE 1 END",
    }),
    "flags": ("lineitem", {
        "rf": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END",
        "ls": "CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END",
        "ln": "CAST(l_linenumber AS INT)",
    }),
    "money": ("lineitem", {
        "rf": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END",
        "qty": "CAST(l_quantity AS DOUBLE)", "price": "l_extendedprice / 1000", "revenue": "l_extendedprice * (1 - l_discount) / 1000",
    }),
    "event": ("events", {
        "kind": "event_type", "value": "CAST(value AS DOUBLE)", "vb": "CASE WHEN value > 20 THEN 2 ELSE 1 END", "vc": "CASE WHEN value > 60 THEN 2 ELSE 1 END", "high": "value > 40",
    }),
    "talk": ("conversations", {
        "role": "CASE role WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 ELSE 3 END", "tn": "CAST(least(5, turn + 1) AS INT)", "lt": "CASE WHEN length(text) > 200 THEN 2 ELSE 1 END",
    }),
}

#: 84 variables of two to four states: multiples of a line's keys, cut into sevenths.
WIDE = {f"w{i}": f"CAST(1 + floor({('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')[i % 4]} * {i // 4 + 1} / 7) % {2 + i % 3} AS INT)" for i in range(84)}
VIEWS["wide"] = ("lineitem", WIDE)

SIZES = {**{f"w{i}": 2 + i % 3 for i in range(84)}, "qb": 5, "pb": 2, "db": 2, "nb": 2, "ub": 2, "rf": 3, "ls": 2, "ln": 7, "vb": 2, "vc": 2, "role": 3, "tn": 5, "lt": 2}


def line_dag() -> DAG:
    """Net price by price and discount, unit price by quantity and price."""
    return DAG(["pb", "db", "qb", "nb", "ub"], [("pb", "nb"), ("db", "nb"), ("qb", "ub"), ("pb", "ub")])


def wide_dag() -> DAG:
    """Each of the wide view's variables by those one and nine before it."""
    return DAG(WIDE, [(f"w{i - k}", f"w{i}") for i in range(84) for k in (1, 9) if i >= k])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).select(*(F.expr(e).alias(c) for c, e in columns.items()))


def view_sql(name: str) -> str:
    """The view as a subquery."""
    source, columns = VIEWS[name]
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


def cpt_sql(of: str, target: str, parents: list[str], alpha: float = 0) -> str:
    """A subquery with the fitted table: parents, target, p; uniform where a configuration has no rows."""
    r, names = SIZES[target], [*parents, target]
    grid = " CROSS JOIN ".join(f"(SELECT CAST(range AS INT) AS {n} FROM range(1, {SIZES[n] + 1}))" for n in names)
    inner = f"SELECT {', '.join(f'g.{n}' for n in names)}, coalesce(c.n, 0) AS n FROM (SELECT * FROM {grid}) g LEFT JOIN (SELECT {', '.join(names)}, count(*) AS n FROM {view_sql(of)} GROUP BY ALL) c ON " + " AND ".join(f"g.{n} = c.{n}" for n in names)
    over = f"OVER (PARTITION BY {', '.join(parents)})" if parents else "OVER ()"
    return f"(SELECT {', '.join(names)}, CASE WHEN sum(n) {over} + {r * alpha} > 0 THEN (n + {alpha}) / (sum(n) {over} + {r * alpha}) ELSE 1.0 / {r} END AS p FROM ({inner}))"
