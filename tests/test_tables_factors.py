import pytest
from pyspark.sql import functions as F

from credence.functions import grids
from credence.functions.math import lgamma, pick, safe_ln, uniform
from credence.operators import table as T
from credence.operators.factor import DimensionMismatch, Factor


def rows(df, *cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def f1(spark):
    return spark.createDataFrame([(False, False, 0.75), (True, False, 0.60), (False, True, 0.25), (True, True, 0.40)], "A boolean, B boolean, potential double")


@pytest.fixture(scope="module")
def f2(spark):
    return spark.createDataFrame([(False, 0.9), (True, 0.1)], "A boolean, potential double")


def test_values_are_rows(spark):
    """A factor of many values is a table, not an expression of so many literals."""
    many = [k * 0.5 for k in range(60_000)]
    f = Factor.of_values(spark, {"X": 300, "Y": 20, "Z": 10}, many)
    assert f.values() == many and f.df.filter("X = 2 and Y = 3 and Z = 4").first()["potential"] == many[1 + 2 * 300 + 3 * 6000]
    assert Factor.of_values(spark, {}, [2.5]).values() == [2.5] and [t for _, t in f.df.dtypes] == ["int", "int", "int", "double"]


def test_product(f1, f2):
    assert rows(T.product(f1, f2)) == [(False, False, 0.675), (False, True, 0.225), (True, False, 0.06), (True, True, 0.04)]
    cross = T.product(f2, f2.withColumnRenamed("A", "C"))
    assert cross.count() == 4 and cross.columns == ["A", "C", "potential"]
    assert T.product(f1, f2.filter("A")).filter("potential is null").count() == 2


def test_sums(f1):
    assert rows(T.sum_out(f1, "B")) == [(False, 1.0), (True, 1.0)]
    assert rows(T.sum_out(f1, ["A"])) == [(False, 1.35), (True, 0.65)]
    assert rows(T.sum_out(f1, ["A", "B"])) == [(2.0,)]
    with pytest.raises(ValueError):
        T.sum_out(f1, "C")


def test_table_rows(spark, f1):
    assert rows(T.normalize(spark.createDataFrame([(1, 1.0), (2, 3.0)], "x int, potential double"))) == [(1, 0.25), (2, 0.75)]
    seen = spark.createDataFrame([(x,) for x in (False, False, True, True, True)], "A boolean")
    assert rows(T.fit_table(seen)) == [(False, 0.4), (True, 0.6)]
    assert rows(T.fit_table(seen.withColumn("potential", F.when(F.col("A"), 1.0).otherwise(3.0)))) == [(False, 6 / 9 and round(6 / 9, 9)), (True, round(3 / 9, 9))]
    assert rows(T.select_rows(f1, {"A": True, "Z": 1}), "B") == [(False,), (True,)]
    assert T.same(f1, f1.orderBy("potential")) and not T.same(f1, f1.limit(2))


@pytest.fixture(scope="module")
def cube(spark):
    return Factor.of_values(spark, {"X": 3, "Y": 2, "Z": 2}, [1, 2, 3, 2, 3, 4, 4, 6, 7, 8, 10, 16])


def test_factor_basics(spark, cube):
    assert len(cube) == 12 and cube.ndims == 3 and cube.shape() == (3, 2, 2) and "X" in cube and cube.index(["Y", "W"]) == [2, 0]
    pattern = Factor.filled(spark, {"l1": 2, "l2": 3}).pattern().orderBy("cell")
    assert [tuple(r)[:2] for r in pattern.collect()] == [(1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3)]
    with pytest.raises(ValueError):
        Factor(cube.df, ("X", "X"), {"X": 3})
    with pytest.raises(DimensionMismatch):
        Factor.of_values(spark, {"X": 2}, [1, 2, 3])
    assert cube.push("W", 2).sum("W").values() == [2 * v for v in cube.values()]
    assert cube.permute(["Z", "X", "Y"]).values()[:2] == [1.0, 4.0]
    assert 0 < min(cube.random(3).values()) and cube.random(3).values() == cube.random(3).values()
    assert "<td>16.0</td>" in cube._repr_html_()


def test_factor_slices(cube):
    assert cube[{"Y": 2, "Z": 1, "K": 3}].values() == [2, 3, 4]
    assert cube[{"X": slice(None), "Y": 1}].dims == ("X", "Z")
    with pytest.raises(TypeError):
        cube[{"Y": "waldo"}]
    with pytest.raises(IndexError):
        cube[{"Y": 16}]
    assert cube.at(12) == 16 and cube.at(3, 2, 2) == 16
    with pytest.raises(DimensionMismatch):
        cube.at(1, 1)
    assert cube.assign({"Y": 2, "Z": 1}, 0).values() == [1, 2, 3, 0, 0, 0, 4, 6, 7, 8, 10, 16]


def test_factor_normal(spark):
    square = Factor.of_values(spark, {"a": 2, "b": 2}, [1, 3, 2, 4])
    assert square.normalize().values() == [0.1, 0.3, 0.2, 0.4]
    assert square.normalize(p=2).values() == pytest.approx([x / 30 for x in (1, 3, 2, 4)])
    assert square.normalize("a").values() == pytest.approx([1 / 4, 3 / 4, 2 / 6, 4 / 6])
    with pytest.raises(ValueError):
        square.normalize("c")
    with pytest.raises(ValueError):
        square.normalize(p=3)


def test_factor_reduce(cube):
    f = cube.broadcast("*", "Z", [1.0, 10.0])
    assert f.sum(["Z", "Y"]).values() == [123, 165, 237]
    assert cube.max(["X", "Z"]).values() == [7, 16] and cube.min("X").values() == [1, 2, 4, 8] and cube.prod("Y").values() == [2, 6, 12, 32, 60, 112]
    assert cube.reduce("sum", "X", 100).values() == [106, 109, 117, 134]
    assert cube.reduce(lambda s, x: s * 2 + x, "X", 0.0).values() == [11, 18, 35, 68]
    with pytest.raises(ValueError):
        cube.sum("Q")


def test_factor_broadcast(spark, cube):
    f = Factor.of_values(spark, {"X": 3, "Y": 2}, [1, 3, 5, 2, 4, 6]).broadcast("*", ["Y", "X"], [[10.0, 0.1], 100.0])
    assert f.values() == pytest.approx([1000, 3000, 5000, 20, 40, 60])
    with pytest.raises(DimensionMismatch):
        cube.broadcast("*", "Z", [1.0, 2.0, 3.0])
    with pytest.raises(ValueError):
        cube.broadcast("*", ["X", "Y"], [1.0])


def test_factor_join(spark):
    a = Factor.of_values(spark, {"X": 3, "C": 2, "Y": 3, "A": 2, "Z": 3}, range(1, 109))
    b = Factor.of_values(spark, {"A": 2, "B": 3, "C": 2}, range(1, 13))
    both = a * b
    assert both.dims == ("X", "C", "Y", "A", "Z", "B") and len(both) == 324
    values = both.values()
    assert values[0] == 1 and values[-1] == 108 * 12 and len(values) == 324
    at = dict(X=2, C=2, Y=3, A=1, Z=2, B=3)
    assert both.at(*at.values()) == a[{k: at[k] for k in a.dims}].at(1) * b[{k: at[k] for k in b.dims}].at(1)
    assert (a / b).at(*at.values()) == a[{k: at[k] for k in a.dims}].at(1) / b[{k: at[k] for k in b.dims}].at(1)
    assert (b - a).dims[:3] == ("A", "B", "C")
    assert a.join("*", b, "inner").dims == ("C", "A")
    with pytest.raises(DimensionMismatch):
        Factor.filled(spark, {"X": 3, "Y": 3}) * Factor.filled(spark, {"X": 31, "Y": 3})
    with pytest.raises(ValueError):
        a.join("*", b, "left")


def test_grids(spark):
    assert [tuple(r)[:2] for r in grids.ndgrid(spark, a=[1, 2], b=[3, 4]).orderBy("cell").collect()] == [(1, 3), (2, 3), (1, 4), (2, 4)]
    assert [tuple(r)[:2] for r in grids.meshgrid(spark, [1, 2]).orderBy("cell").collect()] == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_expressions(spark):
    import math

    df = spark.createDataFrame([(x,) for x in (0.001, 0.5, 1.0, 3.7, 50.0, 1e6)], "x double")
    for x, y in df.select("x", lgamma(F.col("x"))).collect():
        assert y == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
    assert df.select(safe_ln(F.lit(0.0))).first()[0] == float("-inf")
    u = [r[0] for r in spark.range(2000).select(uniform(F.col("id"), "t")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03
    assert [r[0] for r in spark.createDataFrame([(0.05,), (0.2,), (0.9999,)], "u double").select(pick(F.array(*map(F.lit, (0.1, 0.3, 0.99))), F.col("u"))).collect()] == [1, 2, 3]
