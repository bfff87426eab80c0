"""Members against a partition, paths over terms, and sides compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_community(parties: DataFrame, partition: DataFrame) -> DataFrame:
    """(voter_id, party, part): vertices with their community; those without one keep a null."""
    return parties.join(partition, "voter_id", "left").select("voter_id", "party", "part")


def _composition(parties: DataFrame, partition: DataFrame) -> DataFrame:
    n = parties.join(partition, "voter_id").groupBy("part", "party").agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("part").agg(F.sum("n").alias("size"), F.min_by("party", F.struct(-F.col("n"), F.col("party"))).alias("dominant"), F.max("n").alias("top"))
    return n.join(size, "part")


def off_dominant(parties: DataFrame, partition: DataFrame) -> DataFrame:
    """(voter_id, part, party, dominant, purity) of the members whose party is not their community's."""
    dom = _composition(parties, partition).select("part", "dominant", F.round(F.col("top") / F.col("size"), 6).alias("purity")).distinct()
    return parties.join(partition, "voter_id").join(dom, "part").filter("party <> dominant").select("voter_id", "part", "party", "dominant", "purity")


def sub_blocks(parties: DataFrame, partition: DataFrame, party, least: int = 5) -> DataFrame:
    """(part, n, share) of the communities with at least so many members of the party."""
    c = _composition(parties, partition).filter((F.col("party") == party) & (F.col("n") >= least))
    return c.select("part", "n", F.round(F.col("n") / F.col("size"), 6).alias("share"))


def party_paths(coordinates: DataFrame, least: int = 3) -> DataFrame:
    """(party, n_terms, move_1, move_2): displacement of a party's centroid from its first to its last term."""
    c = coordinates.groupBy("party", "leg").agg(F.avg("d1").alias("c1"), F.avg("d2").alias("c2"))
    move = lambda x: F.round(F.max_by(x, "leg") - F.min_by(x, "leg"), 5)
    return c.groupBy("party").agg(F.count(F.lit(1)).alias("n_terms"), move("c1").alias("move_1"), move("c2").alias("move_2")).filter(F.col("n_terms") >= least)


def voter_paths(coordinates: DataFrame, top: int = 100) -> DataFrame:
    """(voter_id, n_terms, party): the longest paths of two terms or more, with the modal party."""
    n = coordinates.groupBy("voter_id", "party").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("voter_id").agg(F.sum("n").alias("n_terms"), F.min_by("party", F.struct(-F.col("n"), F.col("party"))).alias("party"))
    return m.filter("n_terms >= 2").orderBy(F.desc("n_terms"), "voter_id").limit(top)


def compared_centroids(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """(party, n_left, n_right, sd_left, sd_right, distance) of the parties with enough members on both sides."""
    def side(c: DataFrame, tag: str) -> DataFrame:
        return c.groupBy("party").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.avg("d1").alias(f"x_{tag}"), F.avg("d2").alias(f"y_{tag}"), F.round(F.stddev_pop("d1"), 5).alias(f"sd_{tag}")).filter(F.col(f"n_{tag}") >= least)

    j = side(left, "left").join(side(right, "right"), "party")
    return j.select("party", "n_left", "n_right", "sd_left", "sd_right", F.round(F.sqrt(F.pow(F.col("x_left") - F.col("x_right"), 2) + F.pow(F.col("y_left") - F.col("y_right"), 2)), 5).alias("distance"))


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value_left, value_right, delta) of the keys that both sides have."""
    j = left.select(*keys, F.col(value).alias(f"{value}_left")).join(right.select(*keys, F.col(value).alias(f"{value}_right")), keys)
    return j.withColumn("delta", F.col(f"{value}_right") - F.col(f"{value}_left"))


def in_order(rows: DataFrame, column: str, first: list) -> DataFrame:
    """rows of a short list with their place: the given values first, in that order, then the others by value."""
    at = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(column))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(len(first) + 1), column)).cast("long"))
