"""Data quality: duplicates, orphans, domains, limits, repairs and fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order): the smallest row of each key, aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in order])


def duplicate_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """(multiplicity, n_groups, n_extra) of the rows that share their keys."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("multiplicity"))
    return n.groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("multiplicity") - 1).alias("n_extra"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def childless(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    return parent.join(child.select(F.col(child_key).alias(key)), key, "left_anti")


def foreign_keys_hold(relations: list[tuple[DataFrame, str, DataFrame, str]], spark) -> DataFrame:
    """(relation, n_orphans) of each (child, key, parent, key)."""
    parts = [orphans(c, k, p, q).agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(f"{k}->{q}").alias("relation"), "n_orphans") for c, k, p, q in relations]
    return reduce(DataFrame.unionByName, parts)


def domain_report(df: DataFrame, domains: dict[str, list]) -> DataFrame:
    """(column, value, n): values outside the domains, nulls allowed."""
    parts = [df.filter(F.col(c).isNotNull() & ~F.col(c).isin(*v)).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), "value", "n") for c, v in domains.items()]
    return reduce(DataFrame.unionByName, parts)


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null) in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])).alias("x")).select("x.column", "x.n_null")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def fill_null(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """df with nulls of the column filled from updates (one row per key), and `conflict` where both are known and differ."""
    u = updates.groupBy(key).agg(F.min(column).alias("__new"))
    j = df.join(u, key, "left")
    conflict = F.coalesce(F.col(column) != F.col("__new"), F.lit(False))
    return j.withColumn("conflict", conflict).withColumn(column, F.coalesce(column, "__new")).drop("__new")


def majority_dictionary(names: DataFrame, high: float = 0.7, low: float = 0.3, least: int = 2) -> DataFrame:
    """(token, n, share_m, genero): M over `high`, F under `low`, else ambiguous; names has token and genero."""
    g = names.filter("token is not null and genero is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("genero") == "M").cast("double")), 6).alias("share_m")).filter(F.col("n") >= least)
    return g.withColumn("genero", F.when(F.col("share_m") > high, "M").when(F.col("share_m") < low, "F"))


def result_changes(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, old, new) where a recalculated column differs."""
    j = old.select(key, F.col(column).alias("old")).join(new.select(key, F.col(column).alias("new")), key)
    return j.filter(~F.col("old").eqNullSafe(F.col("new")))


def purge(tables: dict[str, DataFrame], dead: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table that has the key, without the rows whose key is dead."""
    return {n: t.join(dead.select(key).distinct(), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


def limit_report(votes: DataFrame, most_parties: int = 6, most_voters: int = 700) -> DataFrame:
    """(rule, subject, value): voters with more parties, and terms with more voters, than allowed."""
    p = votes.groupBy("voter_id").agg(F.countDistinct("grp").alias("v")).filter(F.col("v") > most_parties).select(F.lit("parties").alias("rule"), F.col("voter_id").cast("string").alias("subject"), F.col("v").alias("value"))
    t = votes.groupBy("leg").agg(F.countDistinct("voter_id").alias("v")).filter(F.col("v") > most_voters).select(F.lit("voters").alias("rule"), F.col("leg").cast("string").alias("subject"), F.col("v").alias("value"))
    return p.unionByName(t)
