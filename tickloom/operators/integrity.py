"""Integrity checks: each is a DataFrame of (code, related_id), empty where all is well, so that checks add up by union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, code: str, bad: Column, key: str) -> DataFrame:
    """Rows for which the condition is true."""
    return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(code).alias("code"), F.col(key).cast("string").alias("related_id")).distinct()


def repeated(df: DataFrame, code: str, key: str) -> DataFrame:
    """Business ids that several (distinct) rows have."""
    return df.where(F.col(key).isNotNull()).distinct().groupBy(key).count().where("count > 1").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("related_id"))


def unmatched(df: DataFrame, code: str, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference (not null) has no parent."""
    p = parent.select(F.col(parent_key).alias("_p"))
    return df.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("_p"), "left_anti").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("related_id")).distinct()


def out_of_domain(df: DataFrame, code: str, key: str, domains: Mapping[str, Sequence[str]], not_null: Sequence[str] = ()) -> DataFrame:
    """Rows with a value outside its enumeration (null is inside), or null where that isn't allowed."""
    bad = F.lit(False)
    for c, values in domains.items():
        bad = bad | (F.col(c).isNotNull() & ~F.col(c).isin(list(values)))
    for c in not_null:
        bad = bad | F.col(c).isNull()
    return violations(df, code, bad, key)


def over_capacity(df: DataFrame, code: str, key: str, by: Sequence[str], order: Sequence[str], amount: str, capacity: Column) -> DataFrame:
    """Rows after which the running amount is below zero or above the capacity."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return violations(df.withColumn("_run", F.sum(amount).over(w)), code, (F.col("_run") < 0) | (F.col("_run") > capacity), key)


def unequal_totals(left: DataFrame, right: DataFrame, code: str, key: str, value: str) -> DataFrame:
    """Keys whose totals differ (null-safe) or that only one side has."""
    a = left.groupBy(F.col(key).alias("_a")).agg(F.sum(value).alias("_x"))
    b = right.groupBy(F.col(key).alias("_b")).agg(F.sum(value).alias("_y"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full").withColumn("_k", F.coalesce("_a", "_b"))
    return violations(both, code, ~F.col("_x").eqNullSafe(F.col("_y")), "_k")


def route_errors(df: DataFrame, code: str, key: str, route: str, grammar: Sequence[str]) -> DataFrame:
    """Routes (steps joined by ``>``) that don't begin with the grammar's first step, name a step outside it, or go back in it."""
    steps = F.split(F.col(route), ">")
    places = F.transform(steps, lambda s: F.array_position(F.array(*[F.lit(g) for g in grammar]), s))
    back = F.exists(F.sequence(F.lit(1), F.greatest(F.size(places) - 1, F.lit(1))), lambda i: F.coalesce(F.get(places, i) < F.get(places, i - 1), F.lit(False)))
    return violations(df, code, (F.get(places, F.lit(0)) != 1) | F.array_contains(places, 0) | back, key)


def all_checks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def summary(checks: DataFrame, codes: Sequence[str]) -> DataFrame:
    """(code, passed, n) of every check that was run."""
    spark = checks.sparkSession
    listed = spark.createDataFrame([(c,) for c in codes], "code string")
    return listed.join(checks.groupBy("code").agg(F.count("*").alias("n")), "code", "left").select("code", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).alias("n"))
