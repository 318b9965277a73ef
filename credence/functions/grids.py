"""Grids of all combinations, as frames. The first variable changes fastest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ndgrid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the axes' values, and `cell`, their 1-based place with the first axis fastest."""
    df = spark.range(1).select(F.lit(0).cast("long").alias("cell"))
    step = 1
    for name, values in axes.items():
        df = df.select("*", F.posexplode(F.array(*(F.lit(v) for v in values))).alias("_p", name))
        df = df.withColumn("cell", F.col("cell") + F.col("_p") * step).drop("_p")
        step *= len(values)
    return df.select(*axes, (F.col("cell") + 1).alias("cell"))


def meshgrid(spark: SparkSession, x: list, y: list | None = None, z: list | None = None) -> DataFrame:
    """x along columns and y along rows: y changes fastest; with x alone, both axes are x."""
    y = x if y is None else y
    grid = ndgrid(spark, y=y, x=x, **({} if z is None else {"z": z}))
    return grid.select("x", "y", *(["z"] if z is not None else []), "cell")


def duplicate(df: DataFrame, name: str, n: int) -> DataFrame:
    """Each row once for every value 1..n of a new column."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))
