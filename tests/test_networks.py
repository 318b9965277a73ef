import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.functions.math import uniform
from credence.operators import counts, generate, inference, learn, sampling, scoring
from credence.operators.cpd import CategoricalCPD, ConditionalLinearGaussianCPD, DiscreteCPD, FunctionalCPD, LinearGaussianCPD, ParentFunctionalCPD, StaticCPD
from credence.operators.distributions import Bernoulli, Categorical, NamedCategorical, Normal, count_params
from credence.operators.network import BayesNet
from credence.plans.elimination import elimination_order
from credence.plans.graph import DAG, CycleError
from credence.sources import files


def frame(spark, **cols):
    kinds = {bool: "boolean", float: "double", int: "int", str: "string"}
    return spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{k} {kinds[type(v[0])]}" for k, v in cols.items()))


@pytest.fixture(scope="module")
def counts8(spark):
    return frame(spark, a=[1, 1, 1, 1, 2, 2, 2, 2], b=[1, 2, 1, 2, 1, 1, 1, 2])


@pytest.fixture(scope="module")
def learn12(spark):
    return frame(spark, A=[1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3], B=[1, 1, 1, 2, 2, 2, 2, 1, 1, 2, 1, 1], C=[1, 1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1])


@pytest.fixture(scope="module")
def search32(spark):
    return frame(spark, a=[1] * 16 + [2] * 16, b=[1] * 8 + [2] * 8 + [1] * 4 + [2] * 12, c=[1] * 6 + [2] * 2 + [2] * 6 + [1] * 2 + [1, 1, 2, 2, 1, 1, 2, 2] + [1] * 8)


@pytest.fixture(scope="module")
def collider():
    return BayesNet([DiscreteCPD("a", [1.0, 0.0]), DiscreteCPD("b", [0.0, 1.0]), DiscreteCPD("c", [[0.1, 0.9], [0.2, 0.8], [1.0, 0.0], [0.4, 0.6]], ["a", "b"], [2, 2])])


@pytest.fixture(scope="module")
def student():
    return BayesNet([
        DiscreteCPD("D", [0.6, 0.4]), DiscreteCPD("I", [0.7, 0.3]),
        DiscreteCPD("G", [[0.3, 0.4, 0.3], [0.9, 0.08, 0.02], [0.05, 0.25, 0.7], [0.5, 0.3, 0.2]], ["I", "D"], [2, 2]),
        DiscreteCPD("L", [[0.1, 0.9], [0.4, 0.6], [0.99, 0.01]], ["G"], [3]), DiscreteCPD("S", [[0.95, 0.05], [0.2, 0.8]], ["I"], [2]),
    ])


# Graphs


def test_graph():
    g = DAG("ABCDFE", [("A", "B"), ("A", "D"), ("A", "C"), ("B", "C"), ("D", "C"), ("F", "E")])
    assert g.parents("C") == ["A", "B", "D"] and g.children("A") == ["B", "C", "D"] and g.neighbors("B") == ["A", "C"]
    assert set(g.descendants("A")) == {"B", "C", "D"} and g.markov_blanket("B") == {"A", "C", "D"}
    assert g.has_edge("A", "B") and not g.has_edge("B", "A") and not g.has_edge("A", "Z")
    assert g.separated("B", "D", "A") and not g.separated("B", "D", "C") and not g.separated("B", "D", "E") and not g.separated("B", "C", "A")
    assert not g.stays_acyclic("C", "A") and not g.stays_acyclic("A", "A") and g.stays_acyclic("B", "D")
    with pytest.raises(CycleError):
        g.add_edge("C", "A")
    e = DAG("BSEDC", [("B", "E"), ("S", "E"), ("E", "D"), ("E", "C")])
    assert e.separated("B", "S") and not e.separated("B", "S", "ED") and not e.separated("B", "S", "C")
    assert elimination_order(g, ["C"], {"A"}) and "digraph" in files.to_dot(g)


def test_network_changes():
    bn = generate.asia()
    with pytest.raises(ValueError):
        bn.add(DiscreteCPD("A", [0.5, 0.5]))
    with pytest.raises(ValueError):
        bn.add(DiscreteCPD("Q", [[0.5, 0.5]] * 2, ["Z"], [2]))
    with pytest.raises(ValueError):
        bn.remove("S")
    bn.remove("D")
    assert len(bn) == 6 and bn[0].name == "A" and bn.names.index("S") < bn.names.index("L")


# Counts and scores


def test_counts(spark, counts8, learn12):
    assert sorted(map(tuple, counts.count(counts8, "b", ["a"]).collect())) == [(1, 1, 2), (1, 2, 2), (2, 1, 3), (2, 2, 1)]
    assert counts.statistics_matrix(learn12, "A", []) == [[4], [4], [4]]
    assert counts.statistics_matrix(learn12, "C", ["A", "B"]) == [[3, 1, 3, 0, 2, 0], [0, 0, 0, 1, 1, 1]]
    dag = DAG("ABC", [("A", "B"), ("A", "C"), ("B", "C")])
    long = counts.count_families(counts.joint_counts(learn12, "ABC"), dag)
    assert sorted(tuple(r)[1:] for r in long.filter("target = 'A'").collect()) == [(1, 1, 4), (1, 2, 4), (1, 3, 4)]
    assert long.agg(F.sum("n")).first()[0] == 36
    with pytest.raises(ValueError):
        counts.cardinalities(frame(spark, x=[0, 1]), ["x"])
    assert [r[0] for r in counts.encoded(frame(spark, x=["b", "a", "c", "a"]), ["x"]).collect()] == [2, 1, 3, 1]


def test_scores(spark, counts8, learn12, search32):
    joint = counts.joint_counts(counts8, ["a", "b"])
    sizes = {"a": 2, "b": 2}
    score = lambda f, prior: scoring.bayesian_components(joint, [f], sizes, prior)[f]
    assert score(("a", ()), scoring.UniformPrior(1)) == pytest.approx(-6.445719819385579)
    assert score(("a", ()), scoring.UniformPrior(2)) == pytest.approx(-6.13556489108174)
    assert score(("a", ()), scoring.BDeuPrior(1)) == pytest.approx(-6.841859646909766)
    assert score(("a", ()), scoring.BDeuPrior(2)) == pytest.approx(-6.445719819385579)
    assert score(("b", ("a",)), scoring.UniformPrior(1)) == pytest.approx(-6.396929655216146)
    assert scoring.bayesian_score(counts8, DAG("ab", [("a", "b")])) == pytest.approx(-6.445719819385579 - 6.396929655216146)
    assert scoring.bayesian_score(search32, DAG("abc", [("b", "a"), ("c", "a")])) == pytest.approx(-66.677932, abs=1e-5)
    bic = scoring.NegativeBIC()
    assert bic.component(StaticCPD.fit(learn12, "A", family=Categorical), learn12) == pytest.approx(-33.82141487739863)
    assert bic.component(LinearGaussianCPD("B", ["A"], [0.0], 1.5, 1.0), learn12) == pytest.approx(-32.50924474627614)
    joint = counts.joint_counts(learn12, "ABC")
    found = scoring.bic_components(joint, [("C", ("A", "B"))], {"A": 3, "B": 2, "C": 2}, 12)["C", ("A", "B")]
    assert found == pytest.approx(bic.component(DiscreteCPD.fit(learn12, "C", ["A", "B"]), learn12))


# Distributions


def test_discrete_fits(spark):
    cpd = DiscreteCPD.fit(frame(spark, a=[1, 2, 1, 2, 3]), "a")
    assert cpd().probs == pytest.approx((0.4, 0.4, 0.2)) and cpd.nparams == 3
    assert DiscreteCPD.fit(frame(spark, a=[1, 2, 1, 2, 2]), "a", ncategories=3)().probs == pytest.approx((0.4, 0.6, 0))
    df = frame(spark, a=[1, 2, 1, 2, 3], b=[1, 1, 2, 1, 2])
    cpd = DiscreteCPD.fit(df, "b", ["a"])
    assert [p for p in cpd.probs] == [pytest.approx((0.5, 0.5)), pytest.approx((1, 0)), pytest.approx((0, 1))] and cpd.nparams == 6
    assert DiscreteCPD.fit(df, "b", ["a"], 3, [5]).nparams == 15
    assert DiscreteCPD.fit(df, "b", ["a"], 3, [5])(a=5).probs == pytest.approx((1 / 3,) * 3)
    assert DiscreteCPD.fit(df, "a", prior=scoring.UniformPrior(1)).probs[0] == pytest.approx((3 / 8, 3 / 8, 2 / 8))
    c = frame(spark, a=[1, 1, 1, 1, 2, 2, 2, 2], b=[1, 1, 2, 2, 1, 1, 2, 2], c=[True, True, False, False, True, False, False, True])
    got = CategoricalCPD.fit(c, "c", ["a", "b"], Bernoulli)
    assert [got(a=x, b=y).p for x, y in ((1, 1), (1, 2), (2, 1), (2, 2))] == [1, 0, 0.5, 0.5]
    with pytest.raises(ValueError):
        CategoricalCPD.fit(c.filter("a = 1 or b = 1"), "c", ["a", "b"], Bernoulli)
    assert count_params((1, [1, 2], True)) == 4


def test_gaussian_fits(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    df = frame(spark, a=x.tolist(), b=(2 * x + 1 + 0.01 * rng.normal(size=400)).tolist())
    m = LinearGaussianCPD.fit(df, "b", ["a"])
    assert m(a=0.0).mu == pytest.approx(1, abs=0.01) and m(a=1.0).mu == pytest.approx(3, abs=0.01) and m.sigma == pytest.approx(2, rel=0.2) and m.nparams == 3
    assert LinearGaussianCPD.fit(df, "b", ["a"], residual_sigma=True).sigma == pytest.approx(0.01, rel=0.2)
    df = frame(spark, a=[1] * 4 + [2] * 4, b=[0.5, 1.0, 1.5, 1.0, 2.5, 3.0, 3.5, 3.0], c=[0.55, 1.05, 1.53, 1.02, 2.52, 3.01, 3.55, 3.03])
    m = ConditionalLinearGaussianCPD.fit(df, "c", ["a", "b"])
    assert (m(a=1, b=0.5).mu, m(a=1, b=0.5).sigma) == (pytest.approx(0.5475), pytest.approx(0.4003, abs=1e-3))
    assert (m(a=2, b=3.0).mu, m(a=2, b=3.0).sigma) == (pytest.approx(3.0275, abs=1e-3), pytest.approx(0.421, abs=1e-3)) and m.nparams == 6
    with pytest.raises(TypeError):
        ConditionalLinearGaussianCPD.fit(df.withColumn("b", F.col("b") > 1), "c", ["b"])


def test_other_kinds(spark):
    d = NamedCategorical(["bird", "plane", "superman"], [0.4, 0.55, 0.05])
    assert d.pdf("bird") == 0.4 and d.pdf("kite") == 0 and d.ncategories == 3
    df = frame(spark, a=[1, 1, 2], b=[1, 2, 1], c=[1, 1, 2])
    f = ParentFunctionalCPD("c", ["a", "b"], lambda at, ps: Categorical([sum(at[p] for p in ps), 1]))
    assert f(a=1, b=1).probs == pytest.approx((2 / 3, 1 / 3))
    assert f.logpdf(df) == pytest.approx(math.log(2 / 3) + math.log(3 / 4) + math.log(1 / 4))
    g = FunctionalCPD("c", ["a"], lambda at: Normal(at["a"], 1.0), lambda at, x: -((x - at["a"]) ** 2))
    assert g.logpdf(df) == 0
    with pytest.raises(NotImplementedError):
        g.nparams


def test_likelihood(spark):
    bn = BayesNet([StaticCPD("a", Normal(1.0, 1.0)), LinearGaussianCPD("b", ["a"], [2.0], 3.0, 1.0)])
    df = frame(spark, a=[0.5, 1.0, 2.0], b=[4.0, 5.0, 7.0])
    assert bn.logpdf(df) == pytest.approx(-6.1386, abs=1e-4) and bn.pdf(df) == pytest.approx(0.00215, abs=1e-5)
    assert bn.logpdf({"a": 0.5, "b": 4.0}) == pytest.approx(bn.logpdf(df.limit(1)))
    with pytest.raises(ValueError):
        bn.pdf({"a": 1.0})
    table = BayesNet([DiscreteCPD("a", [0.4, 0.6]), DiscreteCPD("b", [[0.5, 0.5], [0.2, 0.8]], ["a"], [2])]).table(spark, "b")
    assert sorted(map(tuple, table.collect())) == [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.2), (2, 2, 0.8)]


# Learning


@pytest.mark.parametrize("strategy", [learn.GreedyHillClimbing(), learn.ScanGreedyHillClimbing(), learn.GreedyThickThinning()])
def test_searches(search32, strategy):
    bn = learn.search(search32, strategy)
    assert set(bn.dag.edges()) == {("b", "a"), ("c", "a")}
    assert bn["c"]().probs[0] == pytest.approx(0.61765, abs=1e-4) and bn["b"]().probs[0] == pytest.approx(0.38235, abs=1e-4)
    assert [round(bn["a"](b=x, c=y).probs[0], 4) for x, y in ((1, 1), (2, 1), (1, 2), (2, 2))] == [0.7, 0.2143, 0.5, 0.7]


def test_k2_and_fit(learn12):
    bn = learn.search(learn12, learn.K2GraphSearch(["A", "B", "C"]))
    assert bn.names == ["A", "B", "C"]
    mixed = learn.search(learn12.withColumn("C", F.col("C").cast("double")), learn.K2GraphSearch(["A", "B", "C"], {"A": DiscreteCPD, "B": DiscreteCPD, "C": LinearGaussianCPD}))
    assert set(mixed.names) == {"A", "B", "C"}
    with pytest.raises(ValueError):
        learn.K2GraphSearch(["A"], CategoricalCPD)
    with pytest.raises(NotImplementedError):
        learn.search(learn12, object())
    fitted = learn.fit_edges(learn12, ("A", "B"), names=["A", "B"])
    assert fitted["B"](A=1).probs == pytest.approx((0.75, 0.25))
    with pytest.raises(ValueError):
        learn.fit_network(learn12, DAG("AZ"))


# Sampling


def test_sampling(spark, collider):
    assert {tuple(r) for r in sampling.DirectSampler().sample(spark, collider, 50).collect()} == {(1, 2, 1)}
    bn = BayesNet([DiscreteCPD("a", [0.5, 0.5]), DiscreteCPD("b", [[0.9, 0.1], [0.2, 0.8]], ["a"], [2])])
    rows = sampling.DirectSampler().sample(spark, bn, 4000, seed=1)
    assert rows.filter("a = 1 and b = 1").count() == pytest.approx(1800, abs=120)
    kept = sampling.RejectionSampler({"b": 2}).sample(spark, bn, 500).collect()
    assert len(kept) == 500 and all(r["b"] == 2 for r in kept) and sum(r["a"] == 2 for r in kept) / 500 == pytest.approx(8 / 9, abs=0.06)
    weighted = sampling.LikelihoodWeightedSampler({"b": 2}).draw(bn, sampling.keys(spark, 1000))
    assert weighted.agg(F.sum("potential")).first()[0] == pytest.approx(1)
    picks = sampling.weighted_pick(weighted, 400, buckets=16)
    assert picks.count() == 400 and picks.filter("a = 2").count() / 400 == pytest.approx(8 / 9, abs=0.06)
    assert sampling.LikelihoodWeightedSampler({"a": 1, "b": 2}).one(bn, spark)[1] == pytest.approx(0.05)


@pytest.mark.parametrize("buckets", [100, 1024])
def test_picks_by_levels(spark, buckets):
    """Against sums in one array: keys in a dense block, far apart and negative, weights of all kinds."""
    made = np.random.default_rng(5)
    at = np.unique(np.concatenate([np.arange(3000), made.integers(-(2**62), 2**62, 200), [2**63 - 1, -(2**63)]]))
    w = np.where(made.random(len(at)) < 0.2, 0.0, made.random(len(at)) ** 4)
    w[:3], w[50:53] = np.nan, np.inf
    w[1500] = w[np.isfinite(w)].sum()  # half of all
    odd = spark.createDataFrame([(None, 5.0, 0), (7_000, None, 0), (7_001, -1.0, 0)], "key long, potential double, x int")
    rows = spark.createDataFrame(pd.DataFrame({"key": at, "potential": w, "x": np.arange(len(at), dtype=np.int32)}), "key long, potential double, x int").unionByName(odd)
    got = sampling.weighted_pick(rows, 1500, seed=3, buckets=buckets).orderBy("pick").toPandas()
    u = [r[0] for r in sampling.keys(spark, 1500).select(uniform(F.col("key"), "3|pick")).collect()]
    upto = np.cumsum(np.where(np.isfinite(w), w, 0.0))
    assert got["pick"].tolist() == list(range(1500))
    assert got["key"].tolist() == at[np.searchsorted(upto, np.array(u) * upto[-1], "left")].tolist()
    assert not sampling.weighted_pick(odd, 5).count() and sampling.weighted_pick(odd, 5).columns == ["pick", "key", "potential", "x"]


@pytest.mark.parametrize("tries", [1, 4, 5, 100])
def test_rejection_in_rounds(spark, tries):
    """The first attempt that agrees, as if all were drawn at once; a key that repeats gives one row, so does a null."""
    bn = BayesNet([DiscreteCPD("a", [0.9, 0.1]), DiscreteCPD("b", [[0.9, 0.1], [0.2, 0.8]], ["a"], [2])])
    at = spark.createDataFrame([(k,) for k in [*range(150), 3, 3, None, None]], "key long")
    got = sampling.RejectionSampler({"b": 2}, tries).draw(bn, at)
    every = at.distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"))
    every = sampling.drawn(bn, every, attempt=F.col("t")).filter("b = 2").groupBy("key").agg(F.min_by(F.struct("a", "b"), "t").alias("s")).select("key", "s.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert got.count() < 151 if tries < 10 else got.count() == 151
    assert not sampling.RejectionSampler({"b": 2}).draw(bn, at.limit(0)).count()


def test_linear_gaussian_far_from_zero(spark):
    made = np.random.default_rng(2)
    x = 1e8 + made.normal(size=400)
    df = pd.DataFrame({"x": x, "z": made.normal(size=400), "y": 3 * (x - 1e8) + 5})
    df["y"] += 2 * df["z"]
    rows = spark.createDataFrame(df).unionByName(spark.createDataFrame([(None, 1.0, 9e9), (1.0, None, 9e9), (1.0, 1.0, None)], "x double, z double, y double"))
    cpd = LinearGaussianCPD.fit(rows, "y", ["x", "z"], residual_sigma=True)
    assert cpd.a == pytest.approx([3, 2], abs=1e-6) and cpd.sigma == pytest.approx(0, abs=1e-5)
    assert LinearGaussianCPD.fit(rows.filter("z IS NOT NULL AND x > 2"), "y").sigma == pytest.approx(df["y"].std(), rel=1e-9)
    for bad in (rows.withColumn("z", F.col("x") * 2), rows.withColumn("z", F.lit(1.0)), rows.limit(0)):
        with pytest.raises(ValueError):
            LinearGaussianCPD.fit(bad, "y", ["x", "z"])


def test_static_and_categorical_nodes_in_one_job(spark, monkeypatch):
    """The same as each node fitted by itself, in batches too; nulls aren't counted, a configuration without a value fails."""
    made = np.random.default_rng(4)
    df = pd.DataFrame({"a": made.integers(1, 3, 300), "b": made.integers(1, 4, 300), "x": made.normal(5, 2, 300), "k": made.random(300) < 0.3}).astype({"a": "int32", "b": "int32"})
    rows = spark.createDataFrame(df).unionByName(spark.createDataFrame([(None, 1, 50.0, True), (1, None, None, None)], "a int, b int, x double, k boolean"))
    dag = DAG(["a", "b", "x"], [("a", "x"), ("b", "x"), ("a", "b")])
    kinds = {"a": DiscreteCPD, "b": StaticCPD, "x": CategoricalCPD}
    for batch in (1, 500):
        monkeypatch.setattr(learn, "NODES", batch)
        bn = learn.fit_network(rows, dag, kinds)
        assert bn["b"].parents == ("a",) and bn["b"].dist.mu == pytest.approx(np.append(df["b"], 1).mean())
        for (b, a), group in df.groupby(["b", "a"]):
            d = bn["x"](a=a, b=b)
            assert (d.mu, d.sigma) == (pytest.approx(group["x"].mean()), pytest.approx(group["x"].std(ddof=0)))
    coin = learn.fit_network(rows, DAG(["k"]), StaticCPD, family=Bernoulli)
    assert coin["k"].dist.p == pytest.approx(np.append(df["k"], True).mean())
    with pytest.raises(ValueError, match="configurations"):
        learn.fit_network(rows.withColumn("x", F.when(F.col("a") == 1, F.col("x"))), dag, kinds)
    with pytest.raises(ValueError, match="no values"):
        learn.fit_network(rows.limit(0), DAG(["x"]), StaticCPD)


def test_gibbs(spark, collider):
    assert {tuple(r) for r in sampling.GibbsSampler(burn_in=5).sample(spark, collider, 20).collect()} == {(1, 2, 1)}
    one_hot = [[float(k == q) for k in range(4)] for q in range(4)]
    bn = BayesNet([DiscreteCPD("a", [0.5, 0.5]), DiscreteCPD("b", [0.5, 0.5]), DiscreteCPD("c", one_hot, ["a", "b"], [2, 2])])
    assert {tuple(r) for r in sampling.GibbsSampler(burn_in=5, thinning=1, evidence={"c": 2}).sample(spark, bn, 10).collect()} == {(2, 1, 2)}
    mixed = BayesNet([StaticCPD("a", Normal(2.5, 1.5)), DiscreteCPD("b", [0.3, 0.3, 0.4]), LinearGaussianCPD("c", ["a", "b"], [0.5, 0.5], 1.0, 0.5)])
    rows = sampling.GibbsSampler(burn_in=10, evidence={"b": 2}).sample(spark, mixed, 5)
    assert rows.count() == 5 and {r["b"] for r in rows.collect()} == {2}


@pytest.mark.parametrize("options, n", [({}, 0), ({"burn_in": -1}, 5), ({"thinning": -1}, 5), ({"order": ["a"]}, 5), ({"order": ["a", "b", "c", "d"]}, 5), ({"time_limit": 0}, 5), ({"initial": {"a": 1}}, 5), ({"initial": {"a": 1, "b": 2, "c": 1}, "evidence": {"c": 2}}, 5), ({"initial": {"a": 2, "b": 2, "c": 1}}, 5), ({"evidence": {"z": 1}}, 5)])
def test_gibbs_arguments(spark, collider, options, n):
    with pytest.raises(ValueError):
        sampling.GibbsSampler(**options).sample(spark, collider, n)


def test_gibbs_time(spark, collider):
    slow = sampling.GibbsSampler(burn_in=10**6, time_limit=50, error_if_time_out=False, chains=1)
    assert slow.sample(spark, collider, 3).count() == 0


# Inference


@pytest.mark.parametrize("method", [inference.ExactInference(), inference.LikelihoodWeightingInference(), inference.LoopyBelief(), inference.GibbsSamplingNodewise(), inference.GibbsSamplingFull()])
def test_inference(spark, collider, student, method):
    assert inference.infer(spark, collider, "c", {"a": 1, "b": 2}, method).values() == pytest.approx([1, 0], abs=0.02)
    assert inference.infer(spark, student, "D", method=method).values() == pytest.approx([0.6, 0.4], abs=0.05)
    assert inference.infer(spark, student, "G", {"D": 1, "I": 1}, method).values() == pytest.approx([0.3, 0.4, 0.3], abs=0.05)


def brute(bn, query, evidence):
    sizes, total = bn.sizes(), np.zeros([bn.sizes()[q] for q in query])
    for at in np.ndindex(*sizes.values()):
        x = {n: k + 1 for n, k in zip(sizes, at, strict=True)}
        if all(x[k] == v for k, v in evidence.items()):
            total[tuple(x[q] - 1 for q in query)] += bn.pdf(x)
    return (total / total.sum()).ravel(order="F")


@pytest.mark.parametrize("query, evidence", [(["D"], {"X": 2}), (["L", "B"], {"D": 1, "A": 2}), (["S"], {}), (["A", "X"], {"D": 2, "B": 1})])
def test_exact_on_asia(spark, query, evidence):
    bn = generate.asia()
    assert inference.infer(spark, bn, query, evidence).values() == pytest.approx(list(brute(bn, query, evidence)), abs=1e-9)


def test_exact_on_random(spark):
    for seed in range(3):
        bn = generate.random_network(6, 3, 3, seed=seed)
        query, evidence = generate.random_question(bn, 2, 2, seed)
        assert inference.infer(spark, bn, query, evidence).values() == pytest.approx(list(brute(bn, query, evidence)), abs=1e-9)


def test_loopy_is_exact_on_trees(spark):
    bn = BayesNet([DiscreteCPD("a", [0.3, 0.7]), DiscreteCPD("b", [0.6, 0.4]), DiscreteCPD("c", [[0.1, 0.9], [0.8, 0.2], [0.5, 0.5], [0.3, 0.7]], ["a", "b"], [2, 2]), DiscreteCPD("d", [[0.9, 0.1], [0.2, 0.8]], ["c"], [2]), DiscreteCPD("e", [[0.4, 0.6], [0.7, 0.3]], ["c"], [2])])
    for q, given in (("a", {"d": 1, "e": 2}), ("c", {"a": 2}), ("d", {"e": 1})):
        assert inference.infer(spark, bn, q, given, inference.LoopyBelief()).values() == pytest.approx(list(brute(bn, [q], given)), abs=1e-7)


def test_posteriors(spark, student):
    df = frame(spark, D=[1, 2, 2], S=[1, 1, 2])
    for r in inference.posteriors(student, df, "G", ["D", "S"]).collect():
        assert r["potential"] == pytest.approx(brute(student, ["G"], {"D": r["D"], "S": r["S"]})[r["G"] - 1])


def test_questions(collider):
    for query, given in (("z", {}), ("a", {"z": 1}), ("a", {"a": 1})):
        with pytest.raises(ValueError):
            inference.InferenceState.of(collider, query, given)
    assert str(inference.InferenceState.of(collider, ["a", "a"], {"c": 1})) == "P(a | c=1)"
    with pytest.raises(ValueError):
        inference.GibbsSamplingFull(10, 10)


# Generators and files


def test_generators():
    bn = generate.random_network(10, 4, 5, seed=2)
    assert bn.names == [f"N{i}" for i in range(1, 11)] and all(len(c.parents) <= 4 and 2 <= c.ncategories <= 5 for c in bn.cpds.values())
    assert generate.sprinkler().names[0] == "Rain" and set(generate.satellite().dag.children("E")) == {"D", "C"}


XDSL = """<?xml version="1.0" encoding="ISO-8859-1"?><smile version="1.0"><nodes>
<cpt id="Success"><state id="1" /><state id="2" /><probabilities>0.2 0.8</probabilities></cpt>
<cpt id="Forecast"><state id="1" /><state id="2" /><state id="3" /><parents>Success</parents><probabilities>0.4 0.4 0.2 0.1 0.3 0.6</probabilities></cpt>
</nodes></smile>"""


def test_files(spark, tmp_path):
    (tmp_path / "net.xdsl").write_text(XDSL)
    bn = files.read_xdsl(spark, f"file://{tmp_path}/net.xdsl")
    assert [round(bn.pdf({"Success": s, "Forecast": f}), 9) for s in (1, 2) for f in (1, 2, 3)] == [0.08, 0.08, 0.04, 0.08, 0.24, 0.48]
    with pytest.raises(ValueError):
        files.read_xdsl(spark, "net.txt")
    bn.add(DiscreteCPD("Test", [[1.0, 0.0], [0.0, 1.0], [0.1234569, 0.8765431]], ["Forecast"], [3]))
    text = files.to_text(bn)
    assert text == "Success Forecast Test\n010\n001\n000\n2 3 2\n0.2 0.4 0.4 0.1 0.3 1 0 0.1234569\n"
    files.write_text(spark, bn, f"file://{tmp_path}/net")
    again = files.read_text(spark, f"file://{tmp_path}/net")
    assert again.dag.edges() == bn.dag.edges() and again["Test"].probs == [pytest.approx(p) for p in bn["Test"].probs]


def test_streams(spark, tmp_path):
    from credence.streaming.counts import windowed_counts

    frame(spark, x=[1, 2, 2]).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x int, ts timestamp").parquet(f"file://{tmp_path}/in")
    keep = lambda df, epoch: df.write.mode("overwrite").parquet(f"{tmp_path}/out")
    windowed_counts(stream, "ts", ["x"]).writeStream.outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert sorted((r["x"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 1), (2, 2)]


def test_states_beyond_their_size_fail(spark):
    """A parent's state out of range must not count as another configuration."""
    from credence.operators import counts
    from credence.operators.cpd import DiscreteCPD

    df = spark.createDataFrame([(3, 1, 1), (1, 2, 2)], "a int, b int, c int")
    cpd = DiscreteCPD("c", [[0.1, 0.9], [0.2, 0.8], [0.3, 0.7], [0.4, 0.6]], ["a", "b"], [2, 2])
    sizes = {"a": 2, "b": 2, "c": 2}
    for bad in (df.select(cpd.prob_col()), df.select(cpd.log_col()), counts.statistics(df, "c", ["a", "b"], sizes), counts.statistics(df, "a", [], {"a": 2})):
        with pytest.raises(Exception, match="out of 1..2"):
            bad.collect()
    inside = df.filter("a < 3").union(spark.createDataFrame([(None, 1, 1)], "a int, b int, c int"))
    assert [r[0] for r in inside.select(cpd.prob_col()).collect()] == [0.7, None]


def test_closures_run_to_the_end(spark):
    from credence.plans import graph

    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n0", "n9")], "parent string, child string")
    assert graph.descendant_pairs(chain).count() == 45
    assert {r["node"]: r["depth"] for r in graph.depths(chain).collect()} == {f"n{i}": i for i in range(10)}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert graph.descendant_pairs(ring).count() == 4
    with pytest.raises(ValueError, match="cycle"):
        graph.depths(ring)


def test_label_codes_over_ranges(spark):
    from credence.operators import counts

    names = [f"x{i:04}" for i in range(500)] + [None]
    got = {r["label"]: r["code"] for r in counts.encoded(spark.createDataFrame([(n, n) for n in names * 2], "label string, code string"), ["code"]).collect()}
    assert got == {n: i + 1 for i, n in enumerate(names[:-1])} | {None: None}


def test_priors_by_cell(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (1, 1)], "a int, b int")
    joint, sizes = counts.joint_counts(df, ["a", "b"]), {"a": 2, "b": 2}
    prior = scoring.CellPrior([[1.0, 2.0], [0.5, 3.0]])
    found = scoring.bayesian_components(joint, [("b", ("a",))], sizes, prior)["b", ("a",)]
    g = math.lgamma
    by_hand = g(3) - g(1) + g(3) - g(2) + g(3) - g(6) + g(5) - g(3) + g(3.5) - g(5.5)
    assert found == pytest.approx(by_hand)
    even = scoring.CellPrior(lambda r, q: [[1.0] * r] * q)
    wanted = [("a", ()), ("b", ("a",)), ("a", ("b",))]
    assert scoring.bayesian_components(joint, wanted, sizes, even) == pytest.approx(scoring.bayesian_components(joint, wanted, sizes, scoring.UniformPrior()))
    fitted = DiscreteCPD.fit(df, "b", ["a"], 2, [2], prior=prior)
    assert fitted.probs[0] == pytest.approx((3 / 6, 3 / 6)) and fitted.probs[1] == pytest.approx((0.5 / 5.5, 5 / 5.5))
    assert str(fitted).splitlines()[0] == "P(b | a=1) = 0.5, 0.5" and repr(scoring.BDeuPrior(2.0)) == "BDeuPrior(2)"
    with pytest.raises(ValueError):
        scoring.bayesian_components(joint, [("b", ())], sizes, prior)


def test_chains_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHAIN_ROWS", 10)
    monkeypatch.setattr(sampling, "SIDE_BY_SIDE", 1)  # a task for each chain
    bn = BayesNet([DiscreteCPD("a", [0.25, 0.75]), DiscreteCPD("b", [[0.9, 0.1], [0.2, 0.8]], ["a"], [2])])
    rows = sampling.GibbsSampler(burn_in=2, evidence={"b": 1}).sample(spark, bn, 73)
    assert rows.rdd.getNumPartitions() == 8 and rows.count() == 73
    assert {r["b"] for r in rows.collect()} == {1}


# Wide tables


def test_two_hundred_columns(spark):
    """No limit on the number of variables: fitted, scored and searched."""
    rng = np.random.default_rng(1)
    x = rng.integers(1, 4, (400, 200))
    x[:, 7] = x[:, 3]
    names = [f"v.{i}" if i % 50 == 0 else f"v{i}" for i in range(200)]
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"`{n}` int" for n in names))
    dag = DAG(names, [(names[i - 1], names[i]) for i in range(1, 200)] + [(names[3], names[7])])
    bn = learn.fit_network(df, dag, prior=scoring.UniformPrior(1))
    for i in (0, 1, 7, 199):
        ps = [names.index(p) for p in dag.parents(names[i])]
        for q, row in enumerate(bn[names[i]].probs):
            at = np.all([x[:, p] == q // 3**j % 3 + 1 for j, p in enumerate(ps)], axis=0) if ps else np.ones(400, bool)
            assert row == pytest.approx([(np.sum(at & (x[:, i] == k)) + 1) / (at.sum() + 3) for k in (1, 2, 3)])
    rows = {n: [int(v) for v in x[:, i]] for i, n in enumerate(names)}
    total = 0.0
    for n in names:
        table = {}
        for i in range(400):
            table.setdefault(tuple(rows[p][i] for p in dag.parents(n)), [0, 0, 0])[rows[n][i] - 1] += 1
        total += sum(sum(math.lgamma(c + 1) for c in t) + math.lgamma(3) - math.lgamma(sum(t) + 3) for t in table.values())
    assert scoring.bayesian_score(df, dag) == pytest.approx(total)


def test_counts_on_the_driver_and_in_spark_agree(spark):
    rng = np.random.default_rng(2)
    names, sizes = list("abcd"), dict(zip("abcd", (2, 3, 2, 4), strict=True))
    df = spark.createDataFrame([tuple(int(rng.integers(1, sizes[n] + 1)) for n in names) for _ in range(60)], ", ".join(f"{n} int" for n in names))
    wanted = [(c, ps) for c in names for ps in [(), *((p,) for p in names if p != c), tuple(p for p in names if p != c)]]
    rows = counts.counted(df, names, sizes)
    table = counts.Contingency(rows, names, sizes)
    uneven = scoring.CellPrior(lambda r, q: [[1 + i + k / 2 for k in range(r)] for i in range(q)])
    for prior in (scoring.UniformPrior(1), scoring.BDeuPrior(3), uneven):
        assert scoring.bayesian_components(table, wanted, sizes, prior) == pytest.approx(scoring.bayesian_components(rows, wanted, sizes, prior))
    assert scoring.bic_components(table, wanted, sizes, 60) == pytest.approx(scoring.bic_components(rows, wanted, sizes, 60))


def test_search_is_the_same_without_a_table_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(1, 3, 300)
    b, d = np.where(rng.random(300) < 0.9, a, 3 - a), rng.integers(1, 3, 300)
    df = frame(spark, a=a.tolist(), b=b.tolist(), c=np.where(b == d, 1, 2).tolist(), d=d.tolist())
    kinds = [learn.GreedyHillClimbing(), learn.ScanGreedyHillClimbing(), learn.GreedyThickThinning(), learn.K2GraphSearch(list("abdc"))]
    want = [sorted(learn.search(df, s).dag.edges()) for s in kinds]
    monkeypatch.setattr(counts.Contingency, "LOCAL", 0)
    assert [sorted(learn.search(df, s).dag.edges()) for s in kinds] == want and want[0]


def test_reachable():
    below = learn.reachable(list("abc"), {"a": [], "b": ["a"], "c": ["b"]})
    assert below == {"a": 7, "b": 6, "c": 4}


# Gibbs over any kind of node


def test_gibbs_by_support(spark):
    """Finite nodes of any family, as in the definition's own examples."""
    a, b = StaticCPD("a", Categorical([1.0, 0.0])), StaticCPD("b", Categorical([0.0, 1.0]))
    bn = BayesNet([a, b, CategoricalCPD("c", ["a", "b"], [2, 2], [Bernoulli(0.1), Bernoulli(0.2), Bernoulli(1.0), Bernoulli(0.4)])])
    assert {tuple(r) for r in sampling.GibbsSampler(burn_in=100, thinning=5).sample(spark, bn, 5).collect()} == {(1, 2, True)}
    one_hot = [Categorical([float(k == q) for k in range(4)]) for q in range(4)]
    bn = BayesNet([StaticCPD("a", Categorical([0.5, 0.5])), StaticCPD("b", Categorical([0.5, 0.5])), CategoricalCPD("c", ["a", "b"], [2, 2], one_hot)])
    for c, want in ((1, (1, 1, 1)), (2, (2, 1, 2))):
        got = sampling.GibbsSampler(burn_in=20, thinning=5, evidence={"c": c}).sample(spark, bn, 5).collect()
        assert len(got) == 5 and {tuple(r) for r in got} == {want}


def test_gibbs_marginals_of_labels_and_flags(spark):
    """Shares of many chains' rows against exact ones: a label given its parent, and flags and labels given a flag."""
    labels = CategoricalCPD("b", ["a"], [2], [NamedCategorical(["x", "y", "z"], [0.6, 0.3, 0.1]), NamedCategorical(["y", "z"], [0.5, 0.5])])
    bn = BayesNet([StaticCPD("a", Categorical([0.3, 0.7])), labels, FunctionalCPD("f", ["b"], lambda at: Bernoulli({"x": 0.9, "y": 0.4, "z": 0.2}[at["b"]]), lambda c, x: F.when(x, F.when(c["b"] == "x", F.ln(F.lit(0.9))).when(c["b"] == "y", F.ln(F.lit(0.4))).otherwise(F.ln(F.lit(0.2)))).otherwise(F.lit(-99.0)), returns="boolean")])
    rows = sampling.GibbsSampler(burn_in=10, evidence={"f": True}, chains=300).sample(spark, bn, 6000)
    assert rows.dtypes == [("a", "int"), ("b", "string"), ("f", "boolean")]
    joint = {(a, x): pa * bn["b"].dists[a - 1].pdf(x) * p for a, pa in ((1, 0.3), (2, 0.7)) for x, p in (("x", 0.9), ("y", 0.4), ("z", 0.2))}
    total = sum(joint.values())
    got = {(r["a"], r["b"]): r["count"] / 6000 for r in rows.groupBy("a", "b").count().collect()}
    assert all(got.get(k, 0) == pytest.approx(v / total, abs=0.03) for k, v in joint.items()) and rows.filter("NOT f").count() == 0


def test_gibbs_stays_inside_the_support(spark):
    """Bounded and positive targets by their means; infinitely many states raise."""
    from credence.operators.distributions import Exponential, Poisson, Uniform

    bn = BayesNet([StaticCPD("u", Uniform(1.0, 3.0)), StaticCPD("e", Exponential(2.0)), LinearGaussianCPD("y", ["u"], [1.0], 0.0, 1.0)])
    rows = sampling.GibbsSampler(burn_in=20, evidence={"y": 3.0}, chains=400).sample(spark, bn, 8000)
    grid = np.linspace(1, 3, 20_001)
    weight = np.exp(-0.5 * (3 - grid) ** 2)
    r = rows.agg(F.min("u"), F.max("u"), F.avg("u"), F.min("e"), F.avg("e")).first()
    assert r[0] >= 1 and r[1] <= 3 and r[3] >= 0
    assert r[2] == pytest.approx(float((grid * weight).sum() / weight.sum()), abs=0.04) and r[4] == pytest.approx(2.0, abs=0.15)
    with pytest.raises(Exception, match="infinitely many states"):
        sampling.GibbsSampler(burn_in=1).sample(spark, BayesNet([StaticCPD("n", Poisson(3.0)), LinearGaussianCPD("y", ["n"], [1.0])]), 5, 0).collect()


def test_gibbs_starts_under_rare_evidence(spark):
    bn = BayesNet([DiscreteCPD("a", [0.999, 0.001]), DiscreteCPD("b", [[1.0, 0.0], [0.0, 1.0]], ["a"], [2])])
    assert {tuple(r) for r in sampling.GibbsSampler(burn_in=1, evidence={"b": 2}).sample(spark, bn, 8).collect()} == {(2, 2)}
    never = BayesNet([DiscreteCPD("a", [1.0, 0.0]), DiscreteCPD("b", [[1.0, 0.0], [0.0, 1.0]], ["a"], [2])])
    with pytest.raises(ValueError, match="no draw agrees"):
        sampling.GibbsSampler(burn_in=1, evidence={"b": 2}).sample(spark, never, 4)


def test_draws_from_closures(spark):
    """By quantiles at the row's uniform numbers: the same rows each time, and those of a column form."""
    from credence.operators.distributions import Exponential, Poisson
    from credence.functions.math import uniform

    bn = BayesNet([DiscreteCPD("a", [0.5, 0.5]), FunctionalCPD("x", ["a"], lambda at: Exponential(float(at["a"]))), FunctionalCPD("n", ["a"], lambda at: Poisson(2.0 * at["a"]), returns="int")])
    rows = sampling.drawn(bn, sampling.keys(spark, 4000), seed=5).withColumn("want", -F.col("a") * F.log1p(-uniform(F.col("key"), "5|x")))
    assert rows.filter(F.abs(F.col("x") - F.col("want")) > 1e-9).count() == 0
    assert sorted(map(tuple, rows.repartition(7).collect())) == sorted(map(tuple, rows.collect()))
    assert {r["a"]: r["m"] for r in rows.groupBy("a").agg(F.avg("n").alias("m")).collect()} == pytest.approx({1: 2.0, 2: 4.0}, abs=0.2)


@pytest.mark.parametrize("name, u, want", [("Uniform", 0.25, 2.0), ("Exponential", 0.5, math.log(2) * 1.0), ("Normal", 0.5, 1.0), ("Bernoulli", 0.9, True), ("Categorical", 0.7, 2)])
def test_quantiles(name, u, want):
    from credence.operators import distributions as D

    dist = {"Uniform": D.Uniform(1.0, 5.0), "Exponential": D.Exponential(1.0), "Normal": Normal(1.0, 2.0), "Bernoulli": Bernoulli(0.4), "Categorical": Categorical([0.5, 0.3, 0.2])}[name]
    assert dist.quantile(np.array([u]))[0] == pytest.approx(want) and dist.insupport(want) and dist.std > 0


def test_alias_tables():
    from credence.functions.math import alias_table

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 1000):
        p = rng.dirichlet(np.full(n, 0.3))
        keep, other = alias_table(p.tolist())
        share = np.zeros(n)
        for i, (k, o) in enumerate(zip(keep, other, strict=True)):
            share[i] += k / n
            share[o - 1] += (1 - k) / n
        assert share == pytest.approx(p, abs=1e-12) and all(0 <= k <= 1 for k in keep)


def test_ten_thousand_labels(spark):
    d = NamedCategorical([f"s{k}" for k in range(10_000)], [1.0 + k % 3 for k in range(10_000)])
    rows = sampling.drawn(BayesNet([StaticCPD("s", d)]), sampling.keys(spark, 9000)).withColumn("p", d.pdf_col(F.col("s")))
    kind = F.substring("s", 2, 9).cast("int") % 3
    got = {r["k"]: (r["n"] / 9000, r["p"]) for r in rows.groupBy(kind.alias("k")).agg(F.count("*").alias("n"), F.max("p").alias("p")).collect()}
    for k in range(3):
        assert got[k][0] == pytest.approx((k + 1) / 6, abs=0.03) and got[k][1] == pytest.approx(d.pdf(f"s{k}"))
    assert spark.range(1).select(d.pdf_col(F.lit("none")).alias("p")).first()["p"] == 0


def test_a_cycle_shows_after_the_depth_before_it(spark):
    """Three nodes lead into a ring, among a thousand apart from it: found in four rounds, not after as many as there are nodes."""
    from credence.plans import graph

    far = [(f"x{i}", f"y{i}") for i in range(1000)]
    ring = [("a", "b"), ("b", "c"), ("c", "r0"), ("r0", "r1"), ("r1", "r0")]
    with pytest.raises(ValueError, match="cycle"):
        graph.depths(spark.createDataFrame(far + ring, "parent string, child string"))
    got = {r["node"]: r["depth"] for r in graph.depths(spark.createDataFrame(far + ring[:-1] + [("a", "r0")], "parent string, child string")).collect()}
    assert len(got) == 2005 and (got["c"], got["r0"], got["r1"], got["x7"], got["y7"]) == (2, 3, 4, 0, 1)


def test_separation_over_edge_tables(spark):
    """Random graphs, many questions at once, sets that share nodes with each other and the evidence, against the driver's object."""
    import random

    from credence.plans import graph

    rnd, names = random.Random(4), [f"v{i}" for i in range(11)]
    dag = graph.DAG(names, [(names[i], names[j]) for i in range(11) for j in range(i + 1, 11) if rnd.random() < 0.22])
    asked = {q: [rnd.sample(names, k) for k in (1 + q % 2, 1 + q % 3, q % 4)] for q in range(60)}
    parts = [spark.createDataFrame([(q, n) for q, sets in asked.items() for n in sets[i]], "question int, node string") for i in range(3)]
    got = {r["question"]: r["separated"] for r in graph.separated(dag.edge_frame(spark), *parts).collect()}
    want = {q: dag.separated(*sets) for q, sets in asked.items()}
    assert got == want and {True, False} == set(want.values())
    empty = spark.createDataFrame([], "question int, node string")
    assert graph.connected(dag.edge_frame(spark).limit(0), parts[0], empty).count() == parts[0].distinct().count()
    assert graph.connected(dag.edge_frame(spark), empty, parts[2]).count() == 0


@pytest.fixture(scope="module")
def blend(spark):
    rng = np.random.default_rng(3)
    n = 600
    s, t, x = rng.integers(1, 4, n), rng.integers(1, 3, n), rng.normal(1e6, 1.0, n)
    y = s * (x - 1e6) + 0.3 * rng.normal(size=n)
    z = 2 * y - (x - 1e6) + t + 0.5 * rng.normal(size=n)
    return frame(spark, s=s.tolist(), t=t.tolist(), x=x.tolist(), y=y.tolist(), z=z.tolist()).withColumn("copy", F.col("x") * 2).persist()


def test_mixed_search_from_moments(spark, blend, monkeypatch):
    """Scores equal those of CPDs that are fitted and scored one by one; merged moments equal those dealt out set by set."""
    order = ["s", "t", "x", "y", "z"]
    kinds = {"s": DiscreteCPD, "t": DiscreteCPD, **dict.fromkeys("xyz", LinearGaussianCPD)}
    strategy = learn.K2GraphSearch(order, kinds, 3)
    bn = learn.search(blend, strategy)
    assert bn.dag.parents("y") == ["s", "x"] and isinstance(bn["y"], ConditionalLinearGaussianCPD)
    sets = [ps for k in range(4) for ps in combinations("stxy", k)]
    scores, _ = strategy._from_moments(blend, {"z": sets}, kinds.get, {"s": 3, "t": 2})
    near = blend.withColumn("x", F.col("x") - 1e6).persist()  # one by one the sums are taken as they are, and lose digits far from 0
    for ps in sets:
        assert scores["z", ps] == pytest.approx(scoring.NegativeBIC().component(strategy._fit(LinearGaussianCPD, near, "z", ps, {}), near), rel=1e-6)
    assert tuple(bn.dag.parents("z")) == max(sets, key=lambda ps: scores["z", ps])
    monkeypatch.setattr(learn, "ENTRIES", 0)
    again = learn.search(blend, strategy)
    assert set(again.dag.edges()) == set(bn.dag.edges()) and again.logpdf(blend) == pytest.approx(bn.logpdf(blend))


def test_mixed_search_refuses_what_cannot_be_fitted(spark, blend):
    """Collinear numbers and configurations without rows don't win; rows with nulls aren't counted."""
    kinds = {"s": DiscreteCPD, **dict.fromkeys(["x", "copy", "y"], LinearGaussianCPD)}
    holes = blend.filter("s <> 2").unionByName(blend.limit(5).withColumn("y", F.lit(None).cast("double")))
    bn = learn.search(holes, learn.K2GraphSearch(["s", "x", "copy", "y"], kinds, 3))
    assert "s" not in bn.dag.parents("y") and not {"x", "copy"} <= set(bn.dag.parents("y")) and len(bn.dag.parents("y")) == 1
    with pytest.raises(ValueError, match="collinear"):
        learn.fit_network(blend, learn.DAG(["x", "copy", "y"], [("x", "y"), ("copy", "y")]), LinearGaussianCPD)
    with pytest.raises(ValueError, match=r"configurations \[2\]"):
        learn.fit_network(blend.filter("s <> 2"), learn.DAG(["s", "y"], [("s", "y")]), {"s": DiscreteCPD, "y": ConditionalLinearGaussianCPD})


def test_mixed_network_in_one_job(spark, blend):
    """Each node as fitted by itself, rows with a null in another node's variables counted; components in one pass."""
    dag = learn.DAG("stxyz", [("s", "t"), ("x", "y"), ("s", "y"), ("y", "z"), ("x", "z")])
    kinds = {"s": DiscreteCPD, "t": DiscreteCPD, "x": LinearGaussianCPD, "y": ConditionalLinearGaussianCPD, "z": LinearGaussianCPD}
    data = blend.withColumn("z", F.when(F.col("t") == 2, F.col("z")))
    bn = learn.fit_network(data, dag, kinds)
    near = data.withColumn("x", F.col("x") - 1e6)
    y, z = ConditionalLinearGaussianCPD.fit(near, "y", ["s", "x"]), LinearGaussianCPD.fit(near.filter("t = 2"), "z", ["y", "x"])
    for got, want in zip(bn["y"].models, y.models, strict=True):
        assert got.a == pytest.approx(want.a, rel=1e-5) and got.sigma == pytest.approx(want.sigma)
    assert bn["z"].a == pytest.approx(z.a, rel=1e-5) and bn["z"].sigma == pytest.approx(z.sigma) and bn["x"].sigma == pytest.approx(1, abs=0.1)
    assert bn["t"].probs[0] == pytest.approx(DiscreteCPD.fit(data, "t", ["s"]).probs[0])
    cpds = [bn["s"], bn["x"], bn["y"]]
    assert scoring.score_components(scoring.NegativeBIC(), cpds, data) == pytest.approx([scoring.NegativeBIC().component(c, data) for c in cpds])


def test_many_families_are_counted_in_packed_numbers(spark):
    """Rows aren't dealt out a row a family; nulls, large families and weights count as in plain Python, and the session keeps its settings."""
    rng = np.random.default_rng(8)
    names = [f"v{i}" for i in range(20)]
    sizes = {n: (2, 3, 70, 300)[i % 4] for i, n in enumerate(names)}
    data = [[None if rng.random() < 0.05 else int(rng.integers(1, sizes[n] + 1)) for n in names] + [int(rng.integers(1, 4))] for _ in range(300)]
    rows = spark.createDataFrame(data, ", ".join(f"{n} int" for n in names) + ", n long").repartition(3)
    wanted = [(n, tuple(names[max(0, i - i % 4) : i])) for i, n in enumerate(names)]
    before = spark.conf.get(counts.METHOD[0])
    got = counts.cells(rows, wanted, sizes)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString() and spark.conf.get(counts.METHOD[0]) == before
    want = {}
    for f, (t, ps) in enumerate(wanted):
        for row in data:
            states, cell, step = [row[names.index(n)] for n in (t, *ps)], 0, 1
            if None in states:
                continue
            for n, x in zip((t, *ps), states, strict=True):
                cell, step = cell + (x - 1) * step, step * sizes[n]
            want[f, cell] = want.get((f, cell), 0) + row[-1]
    assert {(r["family"], r["cell"]): r["n"] for r in got.collect()} == want
    bad = {f"v{i}": 2 for i in range(20)}
    with pytest.raises(Exception, match="out of 1..2"):
        counts.family_counts(counts.counted(rows.drop("n"), names, bad), DAG(names), bad).collect()


def test_draws_of_few_states_are_compiled(spark):
    """Sums of comparisons, without a function called for each entry; the same states as by search."""
    from credence.functions.math import pick
    from credence.operators.distributions import cumulative

    bn = BayesNet([DiscreteCPD("a", [0.25, 0.0, 0.75]), DiscreteCPD("b", [[0.5, 0.5], [0.0, 1.0], [1.0, 0.0]], ["a"], [3]), DiscreteCPD("c", [1 / 20] * 20), DiscreteCPD("d", [1.0])])
    rows = sampling.drawn(bn, sampling.keys(spark, 500), 4)
    for n in "ab":
        flat = F.array(*(F.array(*map(F.lit, cumulative(p))) for p in bn[n].probs))
        rows = rows.withColumn(f"{n}_want", pick(F.get(flat, F.lit(0) if n == "a" else F.col("a") - 1), uniform(F.col("key"), f"4|{n}")))
    assert rows.filter("a <> a_want OR b <> b_want OR d <> 1 OR a = 2 OR a IS NULL OR b IS NULL").count() == 0
    assert "lambdafunction" not in sampling.drawn(BayesNet([bn["a"], bn["b"]]), sampling.keys(spark, 5))._jdf.queryExecution().executedPlan().toString()


def test_rejection_tests_its_evidence_once_a_draw(spark, monkeypatch):
    """Keys are dealt out before attempts are drawn, evidence and ancestors alone are drawn for each, the rest for rows that are kept."""
    drawn, seen = sampling.drawn, []
    monkeypatch.setattr(sampling, "drawn", lambda bn, at, *a, **k: seen.append((bn.names, at.rdd.getNumPartitions())) or drawn(bn, at, *a, **k))
    bn = BayesNet([DiscreteCPD("a", [0.5, 0.5]), DiscreteCPD("b", [[0.9, 0.1], [0.2, 0.8]], ["a"], [2]), DiscreteCPD("c", [[0.9, 0.1], [0.2, 0.8]], ["b"], [2])])
    assert sampling.RejectionSampler({"b": 2}, 4).draw(bn, sampling.keys(spark, 50).coalesce(1)).filter("b = 2").count() > 10
    assert [names for names, _ in seen] == [[], ["a", "b"], ["a", "b", "c"]] and seen[1][1] >= 4


def test_picks_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda k: made.add(1) or 1.0, "double").asNondeterministic()
    rows = sampling.keys(spark, 300).withColumn("potential", mark("key"))
    assert sampling.weighted_pick(rows, 20, buckets=4).count() == 20 and made.value == 300


def _random_dag(seed: int, nodes: int = 14) -> DAG:
    made = np.random.default_rng(seed)
    return DAG([f"n{i}" for i in range(nodes)], [(f"n{a}", f"n{b}") for a, b in combinations(range(nodes), 2) if made.random() < 0.2])


def test_connected_keeps_a_row_a_node_for_many_questions(spark, monkeypatch, tmp_path):
    from credence.plans import graph

    monkeypatch.setattr(graph, "new_path", lambda spark, label: f"file://{tmp_path}/{label}")
    dag, made = _random_dag(4), np.random.default_rng(6)
    starts = [(q, str(made.choice(dag.names))) for q in range(70)]
    given = [(q, str(n)) for q in range(70) for n in made.choice(dag.names, 3, replace=False)]
    got = graph.connected(dag.edge_frame(spark), spark.createDataFrame(starts, "question int, node string"), spark.createDataFrame(given, "question int, node string"))
    held = {q: {n for p, n in given if p == q} for q in range(70)}
    want = {(q, n) for q, s in starts for n in dag.names if s not in held[q] and n not in held[q] and not dag.separated([s], [n], held[q])}
    assert sorted((r["question"], r["node"]) for r in got.collect()) == sorted(want)
    assert max(spark.read.parquet(f"file://{tmp_path}/connected/{k}").count() for k in (0, 1, 2)) <= 2 * len(dag.names)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("credence_")]


def test_blankets_tell_pairs_apart_once(spark):
    from credence.plans import graph

    dag = _random_dag(7)
    got = graph.blanket_pairs(dag.edge_frame(spark))
    assert sorted(map(tuple, got.collect())) == sorted((n, m) for n in dag.names for m in dag.markov_blanket(n))
    assert "inline" in got._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([("a", None), (None, "a"), ("b", "b"), ("b", "a")], "parent string, child string")
    assert sorted(map(str, graph.blanket_pairs(odd).collect())) == sorted(map(str, [*odd.selectExpr("parent node", "child other").filter("node IS NULL OR other IS NULL OR node <> other").collect(), *spark.createDataFrame([("a", "b"), ("b", "b"), ], "node string, other string").collect()]))


def test_descendants_step_along_inner_edges_alone(spark, monkeypatch, tmp_path):
    from credence.plans import graph

    monkeypatch.setattr(graph, "new_path", lambda spark, label: f"file://{tmp_path}/{label}")
    dag = _random_dag(9)
    got = graph.descendant_pairs(dag.edge_frame(spark))
    assert sorted(map(tuple, got.collect())) == sorted((n, m) for n in dag.names for m in dag.descendants(n) if m != n)
    inner = {n for n in dag.names if dag.parents(n) and dag.children(n)}
    assert {r["below"] for r in spark.read.parquet(f"file://{tmp_path}/descendants/steps").collect()} == inner
