"""Registered queries of the network operators, over models of whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grids
from .functions.math import alias_table, safe_ln
from .operators import counts, inference, learn, sampling, scoring
from .operators import table as T
from .operators.cpd import CategoricalCPD, ConditionalLinearGaussianCPD, DiscreteCPD, FunctionalCPD, LinearGaussianCPD, ParentFunctionalCPD, StaticCPD
from .operators.distributions import Bernoulli, Categorical, Exponential, NamedCategorical, Normal
from .operators.factor import Factor
from .operators.generate import random_network
from .operators.network import BayesNet
from .plans import graph
from .plans.graph import DAG
from .search_sql import greedy_sql
from .sources import files
from .storage import new_path
from .streaming.counts import running_counts
from .views import SIZES, VIEWS, WIDE, cpt_sql, line_dag, table, view, view_sql, wide_dag

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def line_net(spark: SparkSession, sf_dir: str, alpha: float = 1.0) -> BayesNet:
    return learn.fit_network(view(spark, sf_dir, "line"), line_dag(), prior=scoring.UniformPrior(alpha) if alpha else None, ncategories=SIZES)


def line_factor(spark: SparkSession, sf_dir: str, name: str = "ub") -> Factor:
    """The fitted table of a node, dimensions parents..., node."""
    f = line_net(spark, sf_dir).factor(spark, name)
    return f.permute([*f.dims[1:], f.dims[0]])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for n in names or ("potential",):
        df = df.withColumn(n, F.round(F.col(n), digits))
    return df


def numbers(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    return rounded(spark.createDataFrame(rows, "name string, value double"), "value")


LINE = view_sql("line")
UB = cpt_sql("line", "ub", ["qb", "pb"], 1)
NB = cpt_sql("line", "nb", ["pb", "db"], 1)
PB, DB, QB = (cpt_sql("line", n, [], 1) for n in ("pb", "db", "qb"))
JOINT = f"""(SELECT pb, db, qb, nb, ub, pp.p * dd.p * qq.p * nn.p * uu.p AS p
  FROM {PB} pp CROSS JOIN {DB} dd CROSS JOIN {QB} qq JOIN {NB} nn USING (pb, db) JOIN {UB} uu USING (qb, pb))"""
FAMILIES = {"pb": [], "db": [], "qb": [], "nb": ["pb", "db"], "ub": ["qb", "pb"]}


def q_sql(parents: list[str]) -> str:
    out, step = "1", 1
    for p in parents:
        out, step = f"{out} + ({p} - 1) * {step}", step * SIZES[p]
    return f"CAST({out} AS INT)"


# Counts

@query("SELECT name, min(v)::INT AS lo, max(v)::INT AS hi FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v FROM {LINE}" for c in VIEWS["line"][1]) + ") GROUP BY name")
def encode_cardinality(spark, sf_dir):
    df = view(spark, sf_dir, "line")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in df.columns))).alias("x"))
    return long.groupBy("x.name").agg(F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))


@query("SELECT o_orderpriority AS label, dense_rank() OVER (ORDER BY o_orderpriority)::INT AS code, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def encode_labels(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderpriority").alias("label"))
    return counts.encoded(df, ["o_orderpriority"]).groupBy("label", F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"))


@query(f"SELECT pb, db, nb, count(*) AS count FROM {LINE} GROUP BY ALL")
def count_family(spark, sf_dir):
    return counts.count(view(spark, sf_dir, "line"), "nb", ["pb", "db"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS target, {q_sql(ps)} AS q, {c} AS k, count(*) AS n FROM {LINE} GROUP BY ALL" for c, ps in FAMILIES.items()))
def count_all_families(spark, sf_dir):
    dag = line_dag()
    return counts.count_families(counts.joint_counts(view(spark, sf_dir, "line"), dag.names), dag)


def _stats_sql(c: str, ps: list[str]) -> str:
    names = [*ps, c]
    grid = " CROSS JOIN ".join(f"(SELECT CAST(range AS INT) AS {n} FROM range(1, {SIZES[n] + 1}))" for n in names)
    return f"SELECT {q_sql(ps)} AS q, {c} AS k, coalesce(n, 0)::BIGINT AS n FROM (SELECT * FROM {grid}) LEFT JOIN (SELECT {', '.join(names)}, count(*) AS n FROM {LINE} GROUP BY ALL) USING ({', '.join(names)})"


@query(_stats_sql("ub", ["qb", "pb"]))
def statistics_dense(spark, sf_dir):
    return counts.statistics(view(spark, sf_dir, "line"), "ub", ["qb", "pb"], SIZES)


@query(f"SELECT q, sum(CASE WHEN k = 1 THEN n ELSE 0 END)::BIGINT AS s1, sum(CASE WHEN k = 2 THEN n ELSE 0 END)::BIGINT AS s2 FROM ({_stats_sql('ub', ['qb', 'pb'])}) GROUP BY q")
def statistics_pivot(spark, sf_dir):
    return counts.pivoted(statistics_dense(spark, sf_dir), 2)


@query(" UNION ALL ".join(f"SELECT '{c}' AS target, q, k, n FROM ({_stats_sql(c, ps)})" for c, ps in FAMILIES.items()))
def statistics_all(spark, sf_dir):
    parts = counts.statistics_all(view(spark, sf_dir, "line"), line_dag(), SIZES)
    return reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("target"), "q", "k", "n") for c, df in parts.items()))


# Fits

def _cpt(cpd: DiscreteCPD, spark) -> DataFrame:
    return rounded(cpd.frame(spark).drop("target"), "p")


@query(f"SELECT {q_sql(['rf', 'ln'])} AS q, ls AS k, round(p, 6) AS p FROM {cpt_sql('flags', 'ls', ['rf', 'ln'])}")
def fit_discrete_cpd(spark, sf_dir):
    return _cpt(DiscreteCPD.fit(view(spark, sf_dir, "flags"), "ls", ["rf", "ln"], SIZES["ls"], [SIZES["rf"], SIZES["ln"]]), spark)


@query(f"SELECT {q_sql(['role', 'tn'])} AS q, lt AS k, round(p, 6) AS p FROM {cpt_sql('talk', 'lt', ['role', 'tn'], 0.5)}")
def fit_discrete_cpd_prior(spark, sf_dir):
    return _cpt(DiscreteCPD.fit(view(spark, sf_dir, "talk"), "lt", ["role", "tn"], 2, [3, 5], scoring.BDeuPrior(1.0)), spark)


@query(f"SELECT 'normal mu' AS name, round(avg(revenue), 6) AS value FROM {view_sql('money')} UNION ALL SELECT 'normal sigma', round(stddev_pop(revenue), 6) FROM {view_sql('money')} UNION ALL SELECT 'bernoulli p', round(avg(high::INT), 6) FROM {view_sql('event')} UNION ALL SELECT 'state ' || rf, round(count(*) / sum(count(*)) OVER (), 6) FROM {view_sql('money')} GROUP BY rf")
def fit_static(spark, sf_dir):
    money, event = view(spark, sf_dir, "money"), view(spark, sf_dir, "event")
    n, b, c = StaticCPD.fit(money, "revenue", family=Normal).dist, StaticCPD.fit(event, "high", family=Bernoulli).dist, StaticCPD.fit(money, "rf", family=Categorical).dist
    return numbers(spark, [("normal mu", n.mu), ("normal sigma", n.sigma), ("bernoulli p", b.p), *((f"state {k + 1}", p) for k, p in enumerate(c.probs))])


@query(f"SELECT rf, round(avg(revenue), 6) AS mu, round(stddev_pop(revenue), 6) AS sigma FROM {view_sql('money')} GROUP BY rf")
def fit_categorical_normal(spark, sf_dir):
    cpd = CategoricalCPD.fit(view(spark, sf_dir, "money"), "revenue", ["rf"], Normal)
    return rounded(spark.createDataFrame([(q + 1, d.mu, d.sigma) for q, d in enumerate(cpd.dists)], "rf int, mu double, sigma double"), "mu", "sigma")


@query(f"""SELECT 'price' AS name, rf AS q, round(avg(price), 6) AS mu, round(stddev_pop(price), 6) AS sigma FROM {view_sql('money')} GROUP BY rf
 UNION ALL SELECT 'revenue', rf, round(avg(revenue), 6), round(stddev_pop(revenue), 6) FROM {view_sql('money')} GROUP BY rf UNION ALL SELECT 'rf', 1, round(avg(rf), 6), round(stddev_pop(rf), 6) FROM {view_sql('money')}""")
def fit_network_normals(spark, sf_dir):
    """A static node and two by its states, all from one job over the rows."""
    dag = DAG(["rf", "price", "revenue"], [("rf", "price"), ("rf", "revenue")])
    bn = learn.fit_network(view(spark, sf_dir, "money"), dag, {"rf": StaticCPD, "price": CategoricalCPD, "revenue": CategoricalCPD})
    found = [("rf", 1, bn["rf"].dist), *((n, q + 1, d) for n in ("price", "revenue") for q, d in enumerate(bn[n].dists))]
    return rounded(spark.createDataFrame([(n, q, d.mu, d.sigma) for n, q, d in found], "name string, q int, mu double, sigma double"), "mu", "sigma")


@query(f"SELECT unnest(['slope', 'intercept', 'sigma']) AS name, unnest([round(regr_slope(revenue, price), 6), round(regr_intercept(revenue, price), 6), round(stddev_samp(revenue), 6)]) AS value FROM {view_sql('money')}")
def fit_linear_gaussian(spark, sf_dir):
    m = LinearGaussianCPD.fit(view(spark, sf_dir, "money"), "revenue", ["price"])
    return numbers(spark, [("slope", m.a[0]), ("intercept", m.b), ("sigma", m.sigma)])


@query(f"""WITH m AS (SELECT covar_pop(qty, revenue) AS cy1, covar_pop(price, revenue) AS cy2, covar_pop(qty, price) AS c12, var_pop(qty) AS v1, var_pop(price) AS v2, avg(qty) AS m1, avg(price) AS m2, avg(revenue) AS my FROM {view_sql('money')}),
 s AS (SELECT *, (cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) AS a1, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) AS a2 FROM m)
 SELECT unnest(['a qty', 'a price', 'b']) AS name, unnest([round(a1, 6), round(a2, 6), round(my - a1 * m1 - a2 * m2, 6)]) AS value FROM s""")
def fit_linear_gaussian_two(spark, sf_dir):
    m = LinearGaussianCPD.fit(view(spark, sf_dir, "money"), "revenue", ["qty", "price"])
    return numbers(spark, [("a qty", m.a[0]), ("a price", m.a[1]), ("b", m.b)])


@query(f"SELECT rf, round(regr_slope(revenue, price), 6) AS slope, round(regr_intercept(revenue, price), 6) AS intercept, round(stddev_samp(revenue), 6) AS sigma FROM {view_sql('money')} GROUP BY rf")
def fit_conditional_linear_gaussian(spark, sf_dir):
    cpd = ConditionalLinearGaussianCPD.fit(view(spark, sf_dir, "money"), "revenue", ["rf", "price"])
    rows = [(q + 1, m.a[0], m.b, m.sigma) for q, m in enumerate(cpd.models)]
    return rounded(spark.createDataFrame(rows, "rf int, slope double, intercept double, sigma double"), "slope", "intercept", "sigma")


@query("SELECT o_orderpriority AS label, round(count(*) / sum(count(*)) OVER (), 6) AS pdf, count(*) AS n FROM orders GROUP BY 1")
def named_categorical_pdf(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"))
    dist = NamedCategorical.fit(orders, "label")
    return rounded(orders.groupBy("label").agg(F.count("*").alias("n")).withColumn("pdf", dist.pdf_col(F.col("label"))), "pdf")


_PAIR = "CASE WHEN vb = 2 THEN 0.8 ELSE 0.2 END"


@query(f"SELECT 'functional' AS name, round(sum(ln(CASE WHEN vc = 2 THEN {_PAIR} ELSE 1 - {_PAIR} END)), 4) AS value FROM {view_sql('event')} UNION ALL SELECT 'by parents', round(sum(ln(CASE WHEN vc = 2 THEN (vb + 1) / 5.0 ELSE 1 - (vb + 1) / 5.0 END)), 4) FROM {view_sql('event')}")
def functional_cpd_logpdf(spark, sf_dir):
    df = view(spark, sf_dir, "event")
    two = lambda p, x: F.when(x == 2, safe_ln(p)).otherwise(safe_ln(1 - p))
    f = FunctionalCPD("vc", ["vb"], lambda at: Bernoulli(0.8 if at["vb"] == 2 else 0.2), lambda at, x: two(F.when(at["vb"] == 2, 0.8).otherwise(0.2), x))
    g = ParentFunctionalCPD("vc", ["vb"], lambda at, ps: Bernoulli((at[ps[0]] + 1) / 5), lambda at, ps, x: two((at[ps[0]] + 1) / 5, x))
    return rounded(spark.createDataFrame([("functional", f.logpdf(df)), ("by parents", g.logpdf(df))], "name string, value double"), "value", digits=4)


# Likelihood

@query(f"SELECT pb, db, qb, nb, ub, count(*) AS n, round(any_value(p), 9) AS pdf FROM {LINE} JOIN {JOINT} USING (pb, db, qb, nb, ub) GROUP BY ALL".replace(", round(any_value(p), 9)", ", round(max(p), 9)"))
def bn_row_pdf(spark, sf_dir):
    bn = line_net(spark, sf_dir)
    return rounded(bn.with_pdf(counts.joint_counts(view(spark, sf_dir, "line"), bn.names)).select(*bn.names, "n", "pdf"), "pdf", digits=9)


@query(f"SELECT 'logpdf' AS name, round(sum(ln(p)), 3) AS value FROM {LINE} JOIN {JOINT} USING (pb, db, qb, nb, ub) UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', round(sum(ln(p)), 3) FROM {LINE} JOIN {cpt_sql('line', c, ps, 1)} USING ({', '.join([*ps, c])})" for c, ps in FAMILIES.items()))
def bn_logpdf_total(spark, sf_dir):
    bn, df = line_net(spark, sf_dir), view(spark, sf_dir, "line")
    row = df.agg(F.sum(bn.log_col()).alias("logpdf"), *(F.sum(c.log_col()).alias(n) for n, c in bn.cpds.items()))
    return rounded(row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("logpdf", *bn.names)))).alias("x")).select("x.*"), "value", digits=3)


# Tables

@query(f"SELECT qb, pb, ub, round(p, 6) AS potential FROM {UB}")
def table_node(spark, sf_dir):
    return rounded(line_net(spark, sf_dir).table(spark, "ub"))


@query(f"SELECT qb, pb, ub, round(p, 6) AS potential FROM {UB} WHERE pb = 2")
def table_node_filtered(spark, sf_dir):
    return rounded(line_net(spark, sf_dir).table(spark, "ub", {"pb": 2, "unknown": 1}))


@query(f"SELECT pb, db, nb, qb, ub, round(a.p * b.p, 6) AS potential FROM {NB} a JOIN {UB} b USING (pb)")
def table_product(spark, sf_dir):
    bn = line_net(spark, sf_dir)
    return rounded(T.product(bn.table(spark, "nb"), bn.table(spark, "ub")))


@query(f"SELECT db, qb, round(a.p * b.p, 6) AS potential FROM {DB} a CROSS JOIN {QB} b")
def table_product_cross(spark, sf_dir):
    bn = line_net(spark, sf_dir)
    return rounded(T.product(bn.table(spark, "db"), bn.table(spark, "qb")))


_SPARSE = f"(SELECT role, tn, count(*) / (SELECT count(*) FROM {view_sql('talk')}) AS p FROM {view_sql('talk')} GROUP BY ALL)"


@query(f"SELECT tn, a.role, lt, round(a.p * b.p, 6) AS potential FROM {_SPARSE} a FULL JOIN (SELECT tn, lt, count(*) / sum(count(*)) OVER () AS p FROM {view_sql('talk')} WHERE tn > 2 GROUP BY ALL) b USING (tn)")
def table_product_outer_nulls(spark, sf_dir):
    df = view(spark, sf_dir, "talk")
    return rounded(T.product(T.fit_table(df.select("role", "tn")), T.fit_table(df.filter("tn > 2").select("tn", "lt"))).select("tn", "role", "lt", "potential"))


@query(f"SELECT tn, round(sum(p), 6) AS potential FROM {_SPARSE} GROUP BY tn")
def table_sumout(spark, sf_dir):
    return rounded(T.sum_out(table_fit_raw(spark, sf_dir), "role"))


@query(f"SELECT round(sum(p), 6) AS potential FROM {_SPARSE}")
def table_sumout_all(spark, sf_dir):
    return rounded(T.sum_out(table_fit_raw(spark, sf_dir), ["role", "tn"]))


def table_fit_raw(spark, sf_dir):
    return T.fit_table(view(spark, sf_dir, "talk").select("role", "tn"))


@query(f"SELECT role, tn, round(p, 6) AS potential FROM {_SPARSE}")
def table_fit(spark, sf_dir):
    return rounded(table_fit_raw(spark, sf_dir))


@query(f"SELECT rf, ls, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS potential FROM (SELECT {VIEWS['flags'][1]['rf']} AS rf, {VIEWS['flags'][1]['ls']} AS ls, l_quantity FROM lineitem) GROUP BY rf, ls")
def table_fit_weighted(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.expr(VIEWS["flags"][1]["rf"]).alias("rf"), F.expr(VIEWS["flags"][1]["ls"]).alias("ls"), F.col("l_quantity").alias("potential"))
    return rounded(T.fit_table(df))


@query(f"SELECT role, tn, round(p / sum(p) OVER (), 6) AS potential FROM {_SPARSE} WHERE role = 3")
def table_normalize(spark, sf_dir):
    return rounded(T.normalize(T.select_rows(table_fit_raw(spark, sf_dir), {"role": 3})))


@query(f"SELECT DISTINCT role, tn, lt FROM {view_sql('talk')}")
def table_unique(spark, sf_dir):
    return view(spark, sf_dir, "talk").distinct()


# Factors

def _fq(sql: str):
    return query(sql.replace("UB", UB).replace("NB", NB))


@_fq("SELECT qb, pb, ub, CAST(range AS INT) AS extra, round(p, 6) AS potential FROM UB CROSS JOIN range(1, 4)")
def factor_push_dim(spark, sf_dir):
    return rounded(line_factor(spark, sf_dir).push("extra", 3).df)


@_fq("SELECT ub, qb, pb, CAST(ub + (qb - 1) * 2 + (pb - 1) * 10 AS BIGINT) AS cell, round(p, 6) AS potential FROM UB")
def factor_permute_pattern(spark, sf_dir):
    f = line_factor(spark, sf_dir).permute(["ub", "qb", "pb"])
    return rounded(f.df.withColumn("cell", f.cell().cast("bigint")))


@_fq("SELECT qb, ub, round(p, 6) AS potential FROM UB WHERE pb = 2")
def factor_slice(spark, sf_dir):
    return rounded(line_factor(spark, sf_dir)[{"pb": 2, "qb": slice(None), "unknown": 9}].df)


@_fq("SELECT qb, pb, ub, round(CASE WHEN pb = 1 AND ub = 2 THEN 0.5 ELSE p END, 6) AS potential FROM UB")
def factor_assign(spark, sf_dir):
    return rounded(line_factor(spark, sf_dir).assign({"pb": 1, "ub": 2}, 0.5).df)


@_fq("SELECT qb, pb, ub, round(p / sum(p) OVER (), 6) AS potential FROM UB")
def factor_normalize_p1(spark, sf_dir):
    return rounded(line_factor(spark, sf_dir).normalize().df)


@_fq("SELECT qb, pb, ub, round(p / sum(p * p) OVER (), 6) AS potential FROM UB")
def factor_normalize_p2(spark, sf_dir):
    return rounded(line_factor(spark, sf_dir).normalize(p=2).df)


@_fq("SELECT qb, pb, ub, round(p / sum(p) OVER (PARTITION BY ub), 6) AS potential FROM UB")
def factor_normalize_dims(spark, sf_dir):
    return rounded(line_factor(spark, sf_dir).normalize(["qb", "pb"]).df)


@_fq("SELECT ub, round(sum(p), 6) AS s, round(product(p), 9) AS m, round(max(p), 6) AS hi, round(min(p), 6) AS lo FROM UB GROUP BY ub")
def factor_reduce(spark, sf_dir):
    f = line_factor(spark, sf_dir)
    parts = {"s": f.sum(["qb", "pb"]), "m": f.prod(["pb", "qb"]), "hi": f.max(["qb", "pb"]), "lo": f.min(["qb", "pb"])}
    out = reduce(lambda a, b: a.join(b, "ub"), (p.df.withColumnRenamed("potential", k) for k, p in parts.items()))
    return rounded(rounded(out, "s", "hi", "lo"), "m", digits=9)


@_fq("SELECT qb, pb, ub, round(p * CASE pb WHEN 1 THEN 10 ELSE 0.1 END * CASE ub WHEN 1 THEN 2 ELSE 3 END, 6) AS potential FROM UB")
def factor_broadcast(spark, sf_dir):
    return rounded(line_factor(spark, sf_dir).broadcast("*", ["pb", "ub"], [[10.0, 0.1], [2.0, 3.0]]).df)


@_fq("SELECT qb, pb, ub, db, nb, round(a.p * b.p, 6) AS mul, round(a.p / b.p, 6) AS div, round(a.p + b.p, 6) AS add, round(a.p - b.p, 6) AS sub FROM UB a JOIN NB b USING (pb)")
def factor_arithmetic(spark, sf_dir):
    a, b = line_factor(spark, sf_dir), line_factor(spark, sf_dir, "nb")
    parts = {"mul": a * b, "div": a / b, "add": a + b, "sub": a - b}
    out = reduce(lambda x, y: x.join(y, ["qb", "pb", "ub", "db", "nb"]), (p.df.withColumnRenamed("potential", k) for k, p in parts.items()))
    return rounded(out, "mul", "div", "add", "sub")


@_fq("SELECT pb, round(a.s * b.s, 6) AS potential FROM (SELECT pb, sum(p) AS s FROM UB GROUP BY pb) a JOIN (SELECT pb, sum(p * nb) AS s FROM NB GROUP BY pb) b USING (pb)")
def factor_inner_join(spark, sf_dir):
    a, b = line_factor(spark, sf_dir), line_factor(spark, sf_dir, "nb").broadcast("*", "nb", [1.0, 2.0])
    return rounded(a.join("*", b, "inner").df)


@query(f"SELECT qb, pb, CAST(range AS INT) AS copy, (qb + (pb - 1) * 5)::BIGINT AS cell, count(*) AS n FROM {LINE} CROSS JOIN range(1, 3) GROUP BY ALL")
def grid_counts(spark, sf_dir):
    grid = grids.duplicate(grids.ndgrid(spark, qb=[1, 2, 3, 4, 5], pb=[1, 2]), "copy", 2)
    found = counts.joint_counts(view(spark, sf_dir, "line"), ["qb", "pb"])
    return grid.join(found, ["qb", "pb"]).select("qb", "pb", "copy", "cell", "n")


# Graphs, as edge tables: region -> nation -> customer -> order, and part -> order

EDGES = """(SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem)"""


def edges(spark, sf_dir) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    pair = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(y).cast("string")).alias("child"))
    parts = [pair(t("nation"), "r", "n_regionkey", "n", "n_nationkey"), pair(t("customer"), "n", "c_nationkey", "c", "c_custkey"), pair(t("orders"), "c", "o_custkey", "o", "o_orderkey"), pair(t("lineitem"), "p", "l_partkey", "o", "l_orderkey")]
    return reduce(DataFrame.union, parts).distinct()


@query(f"SELECT coalesce(a.node, b.node) AS node, coalesce(n_parents, 0)::BIGINT AS n_parents, coalesce(n_children, 0)::BIGINT AS n_children FROM (SELECT child AS node, count(*) AS n_parents FROM {EDGES} GROUP BY 1) a FULL JOIN (SELECT parent AS node, count(*) AS n_children FROM {EDGES} GROUP BY 1) b ON a.node = b.node")
def graph_degrees(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.parents_of(e).join(graph.children_of(e), "node", "full_outer").select("node", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query(f"SELECT node, count(DISTINCT near) AS n FROM (SELECT child AS node, parent AS near FROM {EDGES} UNION ALL SELECT parent, child FROM {EDGES}) GROUP BY node")
def graph_neighbors(spark, sf_dir):
    return graph.neighbor_pairs(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), d(node, below) AS (SELECT parent, child FROM e UNION SELECT d.node, e.child FROM d JOIN e ON e.parent = d.below) SELECT node, count(*) AS n FROM d GROUP BY node")
def graph_descendants(spark, sf_dir):
    return graph.descendant_pairs(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n"))


@query(f"WITH e AS (SELECT * FROM {EDGES}) SELECT node, count(DISTINCT other) AS n FROM (SELECT child AS node, parent AS other FROM e UNION ALL SELECT parent, child FROM e UNION ALL SELECT a.parent, b.parent FROM e a JOIN e b ON a.child = b.child AND a.parent <> b.parent) GROUP BY node")
def graph_markov_blanket(spark, sf_dir):
    return graph.blanket_pairs(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), d(node, depth) AS (SELECT parent, 0 FROM e UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.node) SELECT node, max(depth)::INT AS depth FROM d GROUP BY node")
def graph_topological_depth(spark, sf_dir):
    return graph.depths(edges(spark, sf_dir))


_MOVES = f"e AS MATERIALIZED (SELECT * FROM {EDGES}), moves AS MATERIALIZED (SELECT child AS node, parent AS next, TRUE AS up FROM e UNION ALL SELECT parent, child, FALSE FROM e)"


@query(f"""WITH RECURSIVE {_MOVES}, starts AS (SELECT 'r' || r_regionkey AS node FROM region),
 held AS MATERIALIZED (SELECT s.node AS question, g.node FROM starts s, (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'P' UNION SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') g),
 open AS (SELECT question, node FROM held UNION SELECT o.question, m.next FROM open o JOIN moves m ON m.node = o.node AND m.up),
 marks AS MATERIALIZED (SELECT o.question, o.node, h.node IS NOT NULL AS held FROM open o LEFT JOIN held h ON h.question = o.question AND h.node = o.node),
 walk AS (SELECT node AS question, node, TRUE AS up FROM starts UNION
  SELECT w.question, m.next, m.up FROM walk w JOIN moves m ON m.node = w.node LEFT JOIN marks k ON k.question = w.question AND k.node = w.node
  WHERE CASE WHEN m.up AND NOT w.up THEN k.held IS NOT NULL ELSE NOT coalesce(k.held, FALSE) END),
 met AS (SELECT DISTINCT w.question, w.node FROM walk w LEFT JOIN held h ON h.question = w.question AND h.node = w.node WHERE h.node IS NULL)
 SELECT question, substring(node, 1, 1) AS kind, count(*) AS n FROM met GROUP BY ALL""")
def graph_connected(spark, sf_dir):
    """For each region how many nodes of each kind a trail joins to it, given all orders underway and the customers of one segment."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    starts = regions.select(F.col("node").alias("question"), "node")
    given = starts.select("question").join(orders.union(customers))  # evidence of each question
    return graph.connected(edges(spark, sf_dir), starts, given).groupBy("question", F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


def separated_sql(x: str, y: str, *given: str) -> str:
    """Whether no way joins x and y in the moral graph of their ancestors and those of `given`, without `given`: from the edges alone."""
    listed = ", ".join(f"('{a}', '{b}')" for a, b in line_dag().edges())
    z = ", ".join(f"'{g}'" for g in given) or "NULL"
    held = f"coalesce({{0}} IN ({z}), FALSE)"
    return f"""(WITH RECURSIVE g(a, b) AS (VALUES {listed}), up(n) AS (SELECT unnest(['{x}', '{y}'{"".join(f", '{g}'" for g in given)}]) UNION SELECT g.a FROM g JOIN up ON g.b = up.n),
  own AS (SELECT a, b FROM g WHERE b IN (SELECT n FROM up)), moral AS (SELECT a, b FROM own UNION SELECT b, a FROM own UNION SELECT p.a, q.a FROM own p JOIN own q ON p.b = q.b AND p.a <> q.a),
  way(n) AS (SELECT '{x}' UNION SELECT m.b FROM way JOIN moral m ON m.a = way.n WHERE NOT {held.format("m.b")})
  SELECT count(*) = 0 FROM way WHERE n = '{y}')"""


@query(f"""WITH c AS (SELECT pb, db, nb, count(*)::DOUBLE AS n FROM {LINE} GROUP BY ALL), t AS (SELECT sum(n) AS n FROM c)
 SELECT 'pb db' AS pair, {separated_sql('pb', 'db')} AS separated, round(sum(x.n * ln(x.n * t.n / (a.n * b.n))), 4) AS g FROM (SELECT pb, db, sum(n) AS n FROM c GROUP BY ALL) x JOIN (SELECT pb, sum(n) AS n FROM c GROUP BY pb) a USING (pb) JOIN (SELECT db, sum(n) AS n FROM c GROUP BY db) b USING (db), t
 UNION ALL SELECT 'pb db | nb', {separated_sql('pb', 'db', 'nb')}, round(sum(x.n * ln(x.n * z.n / (a.n * b.n))), 4) FROM c x JOIN (SELECT nb, sum(n) AS n FROM c GROUP BY nb) z USING (nb) JOIN (SELECT pb, nb, sum(n) AS n FROM c GROUP BY ALL) a USING (pb, nb) JOIN (SELECT db, nb, sum(n) AS n FROM c GROUP BY ALL) b USING (db, nb)""")
def d_separation(spark, sf_dir):
    """Two claims of the graph, with the dependence that the data shows (half the G statistic)."""
    dag, joint = line_dag(), counts.joint_counts(view(spark, sf_dir, "line"), ["pb", "db", "nb"])

    def shown(x, y, z):
        n = lambda *by: joint.groupBy(*by).agg(F.sum("n").cast("double").alias("_".join(["n", *by])))
        full = n(x, y, *z).withColumnRenamed("_".join(["n", x, y, *z]), "nxy")
        out = full.join(n(x, *z), [x, *z]).join(n(y, *z), [y, *z])
        out = out.join(n(*z), z) if z else out.crossJoin(n())
        total = F.col("_".join(["n", *z]))
        g = F.sum(F.col("nxy") * F.ln(F.col("nxy") * total / (F.col("_".join(["n", x, *z])) * F.col("_".join(["n", y, *z])))))
        return out.agg(F.round(g, 4).alias("g")).select(F.lit(f"{x} {y}" + (f" | {' '.join(z)}" if z else "")).alias("pair"), F.lit(dag.separated([x], [y], z)).alias("separated"), "g")

    return shown("pb", "db", []).unionByName(shown("pb", "db", ["nb"]))


# Scores

def _score_sql(c: str, ps: list[str], alpha: float) -> str:
    r, by = SIZES[c], ", ".join(ps)
    cells = f"(SELECT {', '.join([*ps, c])}, count(*) AS n FROM {LINE} GROUP BY ALL)"
    groups = f"(SELECT {by}, count(*) AS n FROM {LINE} GROUP BY ALL)" if ps else f"(SELECT count(*) AS n FROM {LINE})"
    return f"SELECT '{c}' AS name, round((SELECT sum(lgamma({alpha} + n) - lgamma({alpha})) FROM {cells}) + (SELECT sum(lgamma({r * alpha}) - lgamma({r * alpha} + n)) FROM {groups}), 3) AS value"


def _scores(spark, sf_dir, prior):
    dag = line_dag()
    joint = counts.joint_counts(view(spark, sf_dir, "line"), dag.names)
    found = scoring.bayesian_components(joint, [(c, tuple(ps)) for c, ps in counts.families(dag).items()], SIZES, prior)
    return rounded(spark.createDataFrame([(c, s) for (c, _), s in found.items()], "name string, value double"), "value", digits=3)


@query(" UNION ALL ".join(_score_sql(c, ps, 1.0) for c, ps in FAMILIES.items()))
def bayes_score_uniform(spark, sf_dir):
    return _scores(spark, sf_dir, scoring.UniformPrior())


@query(" UNION ALL ".join(_score_sql(c, ps, 2.0 / (SIZES[c] * math.prod(SIZES[p] for p in ps))) for c, ps in FAMILIES.items()))
def bayes_score_bdeu(spark, sf_dir):
    return _scores(spark, sf_dir, scoring.BDeuPrior(2.0))


def _cell_score_sql(c: str, ps: list[str]) -> str:
    """State k of configuration q has a pseudo-count of q + k / 2."""
    r = SIZES[c]
    total = f"({r} * q + {r * (r + 1) / 4})"
    cells = f"SELECT {q_sql(ps)} AS q, {c} AS k, count(*) AS n FROM {LINE} GROUP BY ALL"
    by = f"SELECT sum(lgamma(q + k / 2.0 + n) - lgamma(q + k / 2.0)) + lgamma({total}) - lgamma({total} + sum(n)) AS s FROM ({cells}) GROUP BY q"
    return f"SELECT '{c}' AS name, round(sum(s), 3) AS value FROM ({by})"


UNEVEN = scoring.CellPrior(lambda r, q: [[i + 1 + (k + 1) / 2 for k in range(r)] for i in range(q)])


@query(" UNION ALL ".join(_cell_score_sql(c, ps) for c, ps in FAMILIES.items()))
def bayes_score_cells(spark, sf_dir):
    """With a pseudo-count of its own for each cell."""
    return _scores(spark, sf_dir, UNEVEN)


@query(f"""WITH c AS (SELECT q.range AS q, k.range AS k, q.range + k.range / 2.0 + coalesce(n, 0) AS n FROM range(1, 11) q CROSS JOIN range(1, 3) k
 LEFT JOIN (SELECT {q_sql(['qb', 'pb'])} AS q, ub AS k, count(*) AS n FROM {LINE} GROUP BY ALL) f ON f.q = q.range AND f.k = k.range)
 SELECT 'ub' AS target, CAST(q AS INT) AS q, CAST(k AS INT) AS k, round(n / sum(n) OVER (PARTITION BY q), 6) AS p FROM c""")
def fit_discrete_cpd_cells(spark, sf_dir):
    fitted = DiscreteCPD.fit(view(spark, sf_dir, "line"), "ub", ["qb", "pb"], SIZES["ub"], [SIZES["qb"], SIZES["pb"]], prior=UNEVEN)
    return rounded(fitted.frame(spark), "p")


@query(f"SELECT 'uniform' AS name, round(sum(value), 2) AS value FROM ({' UNION ALL '.join(_score_sql(c, ps, 1.0) for c, ps in FAMILIES.items())})")
def bayes_score_total(spark, sf_dir):
    """Of a whole structure."""
    return rounded(spark.createDataFrame([("uniform", scoring.bayesian_score(view(spark, sf_dir, "line"), line_dag(), scoring.UniformPrior(), SIZES))], "name string, value double"), "value", digits=2)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(2 * sum(n * ln(n / t)) - ln(sum(n)) * {SIZES[c] * math.prod(SIZES[p] for p in ps)}, 3) AS value FROM (SELECT *, sum(n) OVER ({'PARTITION BY ' + ', '.join(ps) if ps else ''}) AS t FROM (SELECT {', '.join([*ps, c])}, count(*) AS n FROM {LINE} GROUP BY ALL))" for c, ps in FAMILIES.items()))
def bic_discrete(spark, sf_dir):
    dag, df = line_dag(), view(spark, sf_dir, "line")
    bn = learn.fit_network(df, dag, ncategories=SIZES)
    found = scoring.score_components(scoring.NegativeBIC(), list(bn.cpds.values()), df)
    return rounded(spark.createDataFrame(list(zip(bn.names, found, strict=True)), "name string, value double"), "value", digits=3)


@query(f"""WITH m AS (SELECT regr_slope(revenue, price) AS a, regr_intercept(revenue, price) AS b, stddev_samp(revenue) AS s, count(*) AS n FROM {view_sql('money')})
 SELECT 'revenue' AS name, round(2 * sum(-0.5 * ln(2 * pi()) - ln(s) - 0.5 * ((revenue - a * price - b) / s) ^ 2) - 3 * ln(max(n)), 2) AS value FROM {view_sql('money')}, m""")
def bic_gaussian(spark, sf_dir):
    df = view(spark, sf_dir, "money")
    s = scoring.NegativeBIC().component(LinearGaussianCPD.fit(df, "revenue", ["price"]), df)
    return rounded(spark.createDataFrame([("revenue", s)], "name string, value double"), "value", digits=2)


# Learning

@query(" UNION ALL ".join(f"SELECT '{c}' AS target, {q_sql(ps)} AS q, {c} AS k, round(p, 6) AS p FROM {cpt_sql('line', c, ps, 1)}" for c, ps in FAMILIES.items()))
def fit_network(spark, sf_dir):
    bn = line_net(spark, sf_dir)
    return rounded(reduce(DataFrame.union, (c.frame(spark) for c in bn.cpds.values())), "p")


_WIDE_FAMILIES = {n: wide_dag().parents(n) for n in WIDE}
_WIDE_COUNTS = "WITH w AS MATERIALIZED " + view_sql("wide") + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS target, {SIZES[c]} AS r, {math.prod(SIZES[p] for p in ps)} AS configs, {q_sql(ps)} AS q, {c} AS k, count(*) AS n FROM w GROUP BY ALL" for c, ps in _WIDE_FAMILIES.items()) + ")"


@query(f"{_WIDE_COUNTS} SELECT target, q, k, round((n + 1.0) / (sum(n) OVER (PARTITION BY target, q) + r), 6) AS p FROM c")
def fit_wide_network(spark, sf_dir):
    """84 variables fitted in one job; cells that have rows."""
    df, dag = view(spark, sf_dir, "wide"), wide_dag()
    seen = counts.family_counts(counts.counted(df, dag.names, SIZES), dag, SIZES)
    bn = learn.fit_counts(seen, dag, SIZES, scoring.UniformPrior(1))
    fitted = spark.createDataFrame([(n, q + 1, k + 1, float(p)) for n, c in bn.cpds.items() for q, row in enumerate(c.probs) for k, p in enumerate(row)], "target string, q int, k int, p double")
    return rounded(fitted.join(seen.select("target", "q", "k"), ["target", "q", "k"]), "p")


@query(f"""{_WIDE_COUNTS}, s AS (SELECT target, q, any_value(r) AS r, any_value(2.0 / (r * configs)) AS a, sum(lgamma(n + 2.0 / (r * configs)) - lgamma(2.0 / (r * configs))) AS s, sum(n) AS n FROM c GROUP BY target, q)
 SELECT target AS name, round(sum(s + lgamma(r * a) - lgamma(n + r * a)), 2) AS value FROM s GROUP BY target""")
def score_wide_network(spark, sf_dir):
    """The same 84 families scored in one job."""
    df, dag = view(spark, sf_dir, "wide"), wide_dag()
    found = scoring.bayesian_components(counts.counted(df, dag.names, SIZES), [(c, tuple(ps)) for c, ps in counts.families(dag).items()], SIZES, scoring.BDeuPrior(2.0))
    return rounded(spark.createDataFrame([(c, s) for (c, _), s in found.items()], "name string, value double"), "value", digits=2)


def _found(spark, bn: BayesNet) -> DataFrame:
    rows = [(p, c) for p, c in bn.dag.edges()] or [("", "")]
    return spark.createDataFrame(rows, "parent string, child string").filter("parent <> ''")


K2_ORDER = ["pb", "db", "qb", "nb", "ub"]


def k2_sql(order: list[str], most: int = 3) -> str:
    """Every set of up to `most` predecessors scored by BIC from its counts; of the best the first, small sets first."""
    scored = []
    for i, c in enumerate(order):
        for k, ps in enumerate(ps for size in range(min(most, i) + 1) for ps in combinations(order[:i], size)):
            cells = f"SELECT {', '.join([*ps, c])}, sum(n) AS n FROM joint GROUP BY ALL"
            over = f"PARTITION BY {', '.join(ps)}" if ps else ""
            listed = ", ".join(f"'{p}'" for p in ps)
            scored.append(f"SELECT '{c}' AS child, {k} AS k, [{listed}]::VARCHAR[] AS parents, 2 * sum(n * ln(n / t)) - ln(sum(n)) * {SIZES[c] * math.prod(SIZES[p] for p in ps)} AS value FROM (SELECT *, sum(n) OVER ({over}) AS t FROM ({cells}))")
    return f"""WITH joint AS (SELECT {', '.join(order)}, count(*)::DOUBLE AS n FROM {LINE} GROUP BY ALL), s AS ({' UNION ALL '.join(scored)}),
 best AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY round(value, 6) DESC, k) AS place FROM s)
 SELECT unnest(parents) AS parent, child FROM best WHERE place = 1"""


@query(k2_sql(K2_ORDER))
def k2_search(spark, sf_dir):
    return _found(spark, learn.search(view(spark, sf_dir, "line"), learn.K2GraphSearch(K2_ORDER), ncategories=SIZES))


MONEY = {"rf": DiscreteCPD, "qty": LinearGaussianCPD, "price": LinearGaussianCPD, "revenue": LinearGaussianCPD}


def _moments_sql(y: str, xs: list[str], by: list[str]) -> str:
    """Of a linear Gaussian with up to two predictors: rows n, slopes b1, b2, intercept b0, deviation sd and squared residuals, by configuration."""
    over = " GROUP BY ALL" if by else ""
    keys = "".join(f"{k}, " for k in by)
    names = [y, *xs]
    co = ", ".join(f"covar_pop({a}, {b}) * count(*) AS c{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)
    mean = ", ".join(f"avg({a}) AS m{i}" for i, a in enumerate(names))
    slopes = ["0.0", "0.0"]
    if len(xs) == 1:
        slopes[0] = "c01 / c11"
    if len(xs) == 2:
        slopes = [f"({a} * {d} - {b} * c12) / (c11 * c22 - c12 * c12)" for a, b, d in (("c01", "c02", "c22"), ("c02", "c01", "c11"))]
    left = "c00" + "".join(f" - b{i + 1} * c0{i + 1}" for i in range(len(xs)))
    b0 = "m0" + "".join(f" - b{i + 1} * m{i + 1}" for i in range(len(xs)))
    return f"(SELECT *, {b0} AS b0, sqrt(c00 / (n - 1)) AS sd, {left} AS ssr FROM (SELECT *, {slopes[0]} AS b1, {slopes[1]} AS b2 FROM (SELECT {keys}count(*) AS n, {co}, {mean} FROM money{over})))"


def k2_mixed_sql(order: list[str], most: int = 2) -> str:
    """Every set of up to `most` predecessors of the numbers after the first, which has states; of the best by BIC the first, small sets first."""
    scored = []
    for i, c in enumerate(order[1:], 1):
        for k, ps in enumerate(ps for size in range(min(most, i) + 1) for ps in combinations(order[:i], size)):
            by, xs = [p for p in ps if p == order[0]], [p for p in ps if p != order[0]]
            listed = ", ".join(f"'{p}'" for p in ps)
            scored.append(f"SELECT '{c}' AS child, {k} AS k, [{listed}]::VARCHAR[] AS parents, 2 * sum(-n * (ln(2 * pi()) / 2 + ln(sd)) - ssr / (2 * sd * sd)) - ln(sum(n)) * count(*) * {len(xs) + 2} AS value FROM {_moments_sql(c, xs, by)}")
    return f"""WITH money AS MATERIALIZED (SELECT * FROM {view_sql('money')}), s AS ({' UNION ALL '.join(scored)}),
 best AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY round(value, 3) DESC, k) AS place FROM s)
 SELECT unnest(parents) AS parent, child FROM best WHERE place = 1"""


@query(k2_mixed_sql(list(MONEY)))
def k2_search_mixed(spark, sf_dir):
    return _found(spark, learn.search(view(spark, sf_dir, "money"), learn.K2GraphSearch(list(MONEY), MONEY, 2)))


@query(f"""WITH money AS MATERIALIZED (SELECT * FROM {view_sql('money')}), m AS (
  SELECT 'qty' AS name, rf AS q, b0, NULL::DOUBLE AS b1, NULL::DOUBLE AS b2, sd FROM {_moments_sql('qty', [], ['rf'])}
  UNION ALL SELECT 'price', rf, b0, b1, NULL, sd FROM {_moments_sql('price', ['qty'], ['rf'])} UNION ALL SELECT 'revenue', 1, b0, b1, b2, sd FROM {_moments_sql('revenue', ['qty', 'price'], [])})
 SELECT name, q, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(sd, 6) AS sd FROM m""")
def fit_mixed_network(spark, sf_dir):
    """Linear Gaussians of three nodes, two of them by a discrete parent, from the moments of one job."""
    dag = graph.DAG(MONEY, [("rf", "qty"), ("rf", "price"), ("qty", "price"), ("qty", "revenue"), ("price", "revenue")])
    kinds = {**MONEY, "qty": ConditionalLinearGaussianCPD, "price": ConditionalLinearGaussianCPD}
    bn, rows = learn.fit_network(view(spark, sf_dir, "money"), dag, kinds), []
    for n in ("qty", "price", "revenue"):
        for q, m in enumerate(bn[n].models if kinds[n] is ConditionalLinearGaussianCPD else [bn[n]]):
            rows.append((n, q + 1, round(m.b, 6), *(round(x, 6) for x in m.a), *[None] * (2 - len(m.a)), round(m.sigma, 6)))
    return spark.createDataFrame(rows, "name string, q int, b0 double, b1 double, b2 double, sd double")


@query(greedy_sql("line", ["qb", "pb", "db", "nb", "ub"]))
def greedy_hill_climbing(spark, sf_dir):
    return _found(spark, learn.search(view(spark, sf_dir, "line"), learn.GreedyHillClimbing(), ncategories=SIZES))


@query(greedy_sql("talk", ["role", "tn", "lt"], capped=True, scan=True))
def scan_greedy_hill_climbing(spark, sf_dir):
    return _found(spark, learn.search(view(spark, sf_dir, "talk"), learn.ScanGreedyHillClimbing(), ncategories=SIZES))


@query(greedy_sql("line", ["qb", "pb", "db", "nb", "ub"], ess=1.0, flips=False, phased=True))
def greedy_thick_thinning(spark, sf_dir):
    return _found(spark, learn.search(view(spark, sf_dir, "line"), learn.GreedyThickThinning(prior=scoring.BDeuPrior(1.0)), ncategories=SIZES))


# Sampling: a synthetic row for each order

def u_sql(key: str, tag: str) -> str:
    return f"((('0x' || substr(md5({key} || '|{tag}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def pick_sql(name: str, key: str, at: str, seed: int = 0) -> str:
    """The state of a node: one more than the number of running sums below the uniform."""
    ps, r = FAMILIES[name], SIZES[name]
    match = " AND ".join(f"c.{p} = {at}.{p}" for p in ps) or "TRUE"
    return f"least({r}, 1 + (SELECT count(*) FROM (SELECT *, sum(p) OVER ({'PARTITION BY ' + ', '.join(ps) if ps else ''} ORDER BY {name}) AS cum FROM {cpt_sql('line', name, ps, 1)}) c WHERE {match} AND c.cum < {u_sql(key, f'{seed}|{name}')} AND c.{name} < {r}))::INT"


_DRAWN = "SELECT *, {nb} AS nb, {ub} AS ub FROM (SELECT key, {pb} AS pb, {db} AS db, {qb} AS qb FROM (SELECT o_orderkey AS key FROM orders)) d".format(**{n: pick_sql(n, "key::VARCHAR", "d") for n in FAMILIES})


def _order_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))


@query(_DRAWN)
def sample_direct(spark, sf_dir):
    return sampling.drawn(line_net(spark, sf_dir), _order_keys(spark, sf_dir))


_TRIES = "SELECT *, {ub} AS ub FROM (SELECT *, {nb} AS nb FROM (SELECT key, try, {pb} AS pb, {db} AS db, {qb} AS qb FROM (SELECT c_custkey AS key, range AS try FROM customer, range(0, 100))) d) d".format(**{n: pick_sql(n, "key::VARCHAR || '|' || try", "d") for n in FAMILIES})


@query(f"SELECT key, pb, db, qb, nb, ub FROM ({_TRIES}) WHERE ub = 2 AND db = 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY try) = 1")
def sample_rejection(spark, sf_dir):
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return sampling.RejectionSampler({"ub": 2, "db": 2}).draw(line_net(spark, sf_dir), at)


_WEIGHTED = "SELECT d.*, 2 AS ub, u.p / sum(u.p) OVER () AS potential FROM (SELECT *, {nb} AS nb FROM (SELECT key, {pb} AS pb, 1 AS db, {qb} AS qb FROM (SELECT o_orderkey AS key FROM orders)) d) d JOIN UB u ON u.qb = d.qb AND u.pb = d.pb AND u.ub = 2".replace("UB", UB).format(**{n: pick_sql(n, "key::VARCHAR", "d") for n in FAMILIES})


@query(f"SELECT key, pb, db, qb, nb, ub, round(potential, 9) AS potential FROM ({_WEIGHTED.replace('/ sum(u.p) OVER ()', '* dd.p / sum(u.p * dd.p) OVER ()').replace(' AND u.ub = 2', f' AND u.ub = 2 JOIN {DB} dd ON dd.db = 1')})")
def sample_weighted(spark, sf_dir):
    rows = sampling.LikelihoodWeightedSampler({"ub": 2, "db": 1}).draw(line_net(spark, sf_dir), _order_keys(spark, sf_dir))
    return rounded(rows.select("key", "pb", "db", "qb", "nb", "ub", "potential"), digits=9)


_UB_SEEN = _WEIGHTED.replace("1 AS db", pick_sql("db", "key::VARCHAR", "d") + " AS db")


@query(f"""WITH r AS (SELECT *, sum(potential) OVER (ORDER BY key) AS upto FROM ({_UB_SEEN})), g AS (SELECT range AS pick, {u_sql("range", "0|pick")} * (SELECT max(upto) FROM r) AS u FROM range(0, 50))
 SELECT pick, key, pb, db, qb, nb, ub, round(potential, 9) AS potential FROM g JOIN r ON upto >= u QUALIFY row_number() OVER (PARTITION BY pick ORDER BY upto, key) = 1""")
def sample_weighted_pick(spark, sf_dir):
    rows = sampling.LikelihoodWeightedSampler({"ub": 2}).draw(line_net(spark, sf_dir), _order_keys(spark, sf_dir))
    picked = sampling.weighted_pick(rows, 50)
    return rounded(picked.select("pick", "key", "pb", "db", "qb", "nb", "ub", "potential"), digits=9)


@query()
def gibbs_sample(spark, sf_dir):
    """As many rows as there are suppliers, given two observations."""
    n = table(spark, sf_dir, "supplier").count()
    return sampling.GibbsSampler(thinning=1, evidence={"ub": 2, "db": 1}).sample(spark, line_net(spark, sf_dir), n)


@query()
def gibbs_sample_mixed(spark, sf_dir):
    df = view(spark, sf_dir, "money")
    bn = BayesNet([DiscreteCPD.fit(df, "rf", ncategories=3), LinearGaussianCPD.fit(df, "price"), ConditionalLinearGaussianCPD.fit(df, "revenue", ["rf", "price"])])
    return sampling.GibbsSampler().sample(spark, bn, table(spark, sf_dir, "supplier").count())


#: A thousand labels of uneven odds.
LOADED = NamedCategorical([f"s{k}" for k in range(1000)], [1 + k * 7919 % 101 for k in range(1000)])
_KEEP, _OTHER = alias_table(LOADED.probs)
_PLACE = "(CAST('0x' || substr(md5(o_orderkey || '|0|s'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 * 1000"


@query(f"""WITH t AS (SELECT {_KEEP} AS keep, {_OTHER} AS other), v AS (SELECT o_orderkey AS key, {_PLACE} AS v FROM orders),
 i AS (SELECT key, v, CAST(least(floor(v), 999) AS INT) AS i FROM v)
 SELECT key, 's' || (CASE WHEN v - i < keep[i + 1] THEN i ELSE other[i + 1] - 1 END) AS s FROM i, t""")
def sample_alias(spark, sf_dir):
    """A label for each order, in two lookups."""
    return sampling.drawn(BayesNet([StaticCPD("s", LOADED)]), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))).select("key", "s")


@query("SELECT o_orderkey AS key, CASE WHEN o_totalprice > 150000 THEN 2 ELSE 1 END AS big, -(CASE WHEN o_totalprice > 150000 THEN 2.0 ELSE 1.0 END) * ln(1 - (CAST('0x' || substr(md5(o_orderkey || '|0|wait'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296) AS wait FROM orders")
def sample_functional(spark, sf_dir):
    """A waiting time for each order from a closure's distribution given the order's size, by quantiles in Arrow batches."""
    at = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_totalprice") > 150000, 2).otherwise(1).alias("big"))
    wait = FunctionalCPD("wait", ["big"], lambda at: Exponential(float(at["big"])))
    return at.withColumn("wait", wait.sample_col(F.col("key").cast("string"), "0|wait"))


# Inference

def _posterior_sql(names: list[str], where: str) -> str:
    return f"SELECT {', '.join(names)}, round(sum(p) / sum(sum(p)) OVER (), 6) AS potential FROM {JOINT} WHERE {where} GROUP BY ALL"


@query(_posterior_sql(["nb"], "ub = 2 AND db = 1"))
def infer_exact(spark, sf_dir):
    return rounded(inference.infer(spark, line_net(spark, sf_dir), "nb", {"ub": 2, "db": 1}).df)


@query(_posterior_sql(["ub"], "TRUE"))
def infer_exact_prior(spark, sf_dir):
    return rounded(inference.infer(spark, line_net(spark, sf_dir), "ub").df)


@query(_posterior_sql(["qb", "db"], "nb = 2 AND ub = 1"))
def infer_exact_joint(spark, sf_dir):
    return rounded(inference.infer(spark, line_net(spark, sf_dir), ["qb", "db"], {"nb": 2, "ub": 1}).df)


@query(f"SELECT ub, db, nb, round(sum(p) / sum(sum(p)) OVER (PARTITION BY ub, db), 6) AS potential FROM {JOINT} JOIN (SELECT DISTINCT ub, db FROM {LINE}) USING (ub, db) GROUP BY ub, db, nb")
def infer_posterior_by_evidence(spark, sf_dir):
    return rounded(inference.posteriors(line_net(spark, sf_dir), view(spark, sf_dir, "line"), "nb", ["ub", "db"]))


@query(f"SELECT nb, round(sum(potential), 6) AS potential FROM ({_WEIGHTED.replace('/ sum(u.p) OVER ()', '* dd.p / sum(u.p * dd.p) OVER ()').replace(' AND u.ub = 2', f' AND u.ub = 2 JOIN {DB} dd ON dd.db = 1')}) GROUP BY nb".replace("o_orderkey AS key FROM orders", "range AS key FROM range(0, 2000)"))
def infer_likelihood_weighting(spark, sf_dir):
    return rounded(inference.infer(spark, line_net(spark, sf_dir), "nb", {"ub": 2, "db": 1}, inference.LikelihoodWeightingInference(2000)).df)


@query()
def infer_gibbs_nodewise(spark, sf_dir):
    return rounded(inference.infer(spark, line_net(spark, sf_dir), "nb", {"ub": 2, "db": 1}, inference.GibbsSamplingNodewise()).df, digits=3)


@query()
def infer_gibbs_full(spark, sf_dir):
    return rounded(inference.infer(spark, line_net(spark, sf_dir), "nb", {"ub": 2, "db": 1}, inference.GibbsSamplingFull()).df, digits=3)


@query(f"SELECT ub, db, nb, round(sum(p) / sum(sum(p)) OVER (PARTITION BY ub, db), 6) AS potential FROM {JOINT} JOIN (SELECT DISTINCT ub, db FROM {LINE}) USING (ub, db) GROUP BY ub, db, nb")
def infer_loopy_by_evidence(spark, sf_dir):
    seen = view(spark, sf_dir, "line").select("ub", "db").distinct()
    return rounded(inference.LoopyBelief().batch(line_net(spark, sf_dir), seen, "nb", ["ub", "db"]))


# Files and streams

@query(" UNION ALL ".join(f"SELECT '{c}' AS target, {q_sql(ps)} AS q, {c} AS k, round(p, 6) AS p FROM {cpt_sql('line', c, ps, 1)}" for c, ps in {**FAMILIES, "ub": ["pb", "qb"]}.items()))
def text_roundtrip(spark, sf_dir):
    path = new_path(spark, "network")
    files.write_text(spark, line_net(spark, sf_dir), path)
    return rounded(reduce(DataFrame.union, (c.frame(spark) for c in files.read_text(spark, path).cpds.values())), "p")


@query(f"SELECT vb, vc, count(*) AS n FROM {view_sql('event')} GROUP BY ALL")
def stream_counts(spark, sf_dir):
    path = new_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select(*(F.expr(VIEWS["event"][1][c]).alias(c) for c in ("vb", "vc")))
    keep = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/counts")
    running_counts(stream, ["vb", "vc"]).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{path}/counts")


@query()
def random_network_samples(spark, sf_dir):
    """A row of a random network for each supplier."""
    bn = random_network(8, 3, 4, seed=7)
    return sampling.drawn(bn, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")))
