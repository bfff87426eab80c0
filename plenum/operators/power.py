"""Seats, coalitions and power indices. Parties are few (at most 16): their coalitions are rows, all terms in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import stored

MAX_PARTIES = 16


def seats_by_headcount(votes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, grp, seats): the largest number of a party's voters in one event."""
    n = votes.groupBy(*by, "vote_event_id", "grp").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by, "grp").agg(F.max("n").alias("seats"))


def seats_by_member(votes: DataFrame) -> DataFrame:
    """(grp, seats): one party per voter: most votes, then latest, then the smallest."""
    n = votes.groupBy("voter_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("start_date").alias("last"))
    best = Window.partitionBy("voter_id").orderBy(F.desc("n"), F.desc("last"), "grp")
    return n.withColumn("rn", F.row_number().over(best)).filter("rn = 1").groupBy("grp").agg(F.count(F.lit(1)).alias("seats"))


def quotas(seats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quota_kind, quota): simple, two thirds and three quarters of all seats."""
    s = seats.groupBy(*by).agg(F.sum("seats").alias("total"))
    kinds = F.array(*[F.struct(F.lit(k).alias("quota_kind"), q.cast("long").alias("quota")) for k, q in (("simple", F.floor(F.col("total") / 2) + 1), ("two_thirds", F.floor((2 * F.col("total") + 2) / 3)), ("three_quarters", F.floor((3 * F.col("total") + 3) / 4)))])
    return s.select(*by, "total", F.explode(kinds).alias("k")).select(*by, "total", "k.quota_kind", "k.quota")


def indices(seats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quota_kind, grp, seats, nominal, shapley, banzhaf) in percent, 2 decimals.

    Each coalition is a bit mask, exploded per game; a party swings a losing
    coalition without it that wins with it. Games of more parties raise.
    """
    seats = stored(seats)  # a few rows, read several times
    game = seats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("grp", "seats"))).alias("parties"))
    game = game.withColumn("n", F.size("parties")).withColumn("n", F.when(F.col("n") <= MAX_PARTIES, F.col("n")).otherwise(F.raise_error(F.lit(f"more than {MAX_PARTIES} parties"))))
    game = game.join(quotas(seats, by), list(by)) if by else game.crossJoin(quotas(seats))  # three rows
    masks = game.withColumn("mask", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("n")).cast("int") - 1)))
    masks = masks.withColumn("weight", F.expr("aggregate(transform(parties, (x, i) -> case when (mask & shiftleft(1, i)) <> 0 then x.seats else 0L end), 0L, (a, x) -> a + x)")).filter("weight < quota")
    swing = masks.select(*by, "quota_kind", "quota", "total", "n", "mask", "weight", F.posexplode("parties").alias("i", "party"))
    swing = swing.filter("(mask & shiftleft(1, i)) = 0 and weight + party.seats >= quota").withColumn("s", F.bit_count("mask"))
    worth = F.factorial("s") * F.factorial(F.col("n") - 1 - F.col("s")) / F.factorial("n")
    won = swing.groupBy(*by, "quota_kind", F.col("party.grp").alias("grp")).agg(F.sum(worth).alias("ss"), F.count(F.lit(1)).alias("swings"))
    every = game.select(*by, "quota_kind", "total", F.explode("parties").alias("p")).select(*by, "quota_kind", "total", "p.grp", "p.seats")
    j = every.join(won, [*by, "quota_kind", "grp"], "left").na.fill({"ss": 0.0, "swings": 0})
    all_swings = F.sum("swings").over(Window.partitionBy(*by, "quota_kind"))
    return j.select(*by, "quota_kind", "grp", "seats", F.round(100.0 * F.col("seats") / F.col("total"), 2).alias("nominal"), F.round(100.0 * F.col("ss"), 2).alias("shapley"), F.when(all_swings > 0, F.round(100.0 * F.col("swings") / all_swings, 2)).otherwise(F.lit(0.0)).alias("banzhaf"))


def coalition_seats(seats: DataFrame, coalitions: DataFrame) -> DataFrame:
    """(name, seats, share, reaches quota_kind...) of coalitions (name, grps array)."""
    q = quotas(seats).groupBy().pivot("quota_kind", ["simple", "two_thirds", "three_quarters"]).agg(F.first("quota"))
    total = seats.agg(F.sum("seats").alias("total"))
    c = coalitions.select("name", F.explode("grps").alias("grp")).join(seats, "grp", "left").groupBy("name").agg(F.sum(F.coalesce("seats", F.lit(0))).alias("seats"))
    j = c.crossJoin(q).crossJoin(total)  # one row each
    return j.select("name", "seats", F.round(100.0 * F.col("seats") / F.col("total"), 2).alias("share"), *[(F.col("seats") >= F.col(k)).alias(f"reaches_{k}") for k in ("simple", "two_thirds", "three_quarters")])
