"""Panels of voters and groups over terms: discipline, trajectories, switches, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def modal_option(votes: DataFrame) -> DataFrame:
    """(vote_event_id, grp, modal): each party's most frequent option, ties to the first by name."""
    n = votes.groupBy("vote_event_id", "grp", "option").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("vote_event_id", "grp").agg(F.min_by("option", F.struct(-F.col("n"), F.col("option"))).alias("modal"))


def discipline(votes: DataFrame, least: int = 10) -> DataFrame:
    """(voter_id, leg, grp, n_votes, discipline): share of a member's votes on the party's modal option."""
    j = votes.join(modal_option(votes), ["vote_event_id", "grp"])
    g = j.groupBy("voter_id", "leg", "grp").agg(F.count(F.lit(1)).alias("n_votes"), F.round(F.avg((F.col("option") == F.col("modal")).cast("double")), 4).alias("discipline"))
    return g.filter(F.col("n_votes") >= least)


def panel(disc: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per voter and term: the row with most votes (ties: the smallest party) and the voter's attributes."""
    best = Window.partitionBy("voter_id", "leg").orderBy(F.desc("n_votes"), "grp")
    return disc.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn").join(attributes, "voter_id", "left")


def group_panel(p: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """(keys, n_persons, mean, sd, votes): discipline of groups of at least `least` persons; a single person has sd 0."""
    g = p.groupBy(*keys).agg(F.countDistinct("voter_id").alias("n_persons"), F.round(F.avg("discipline"), 6).alias("mean_discipline"), F.round(F.coalesce(F.stddev_samp("discipline"), F.lit(0.0)), 6).alias("sd_discipline"), F.sum("n_votes").alias("votes"))
    return g.filter(F.col("n_persons") >= least)


def shares(p: DataFrame) -> DataFrame:
    """(leg, n_f, n_m, share_f, gap): women, men, their share and the gap of discipline."""
    f, m = F.col("genero") == "F", F.col("genero") == "M"
    g = p.groupBy("leg").agg(F.count_if(f).alias("n_f"), F.count_if(m).alias("n_m"), F.avg(F.when(f, F.col("discipline"))).alias("df"), F.avg(F.when(m, F.col("discipline"))).alias("dm"))
    return g.select("leg", "n_f", "n_m", F.round(F.col("n_f") / (F.col("n_f") + F.col("n_m")), 6).alias("share_f"), F.round(F.col("df") - F.col("dm"), 6).alias("gap"))


def group_covoting(votes: DataFrame, gender: DataFrame) -> DataFrame:
    """(leg, n_events, agreement): mean over events of 1 - |favour share of women - of men|; both must be present."""
    v = votes.filter("option in ('a_favor', 'en_contra')").join(gender, "voter_id")
    e = v.groupBy("leg", "vote_event_id").pivot("genero", ["F", "M"]).agg(F.avg((F.col("option") == "a_favor").cast("double"))).dropna()
    return e.groupBy("leg").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg(1 - F.abs(F.col("F") - F.col("M"))), 6).alias("agreement"))


def coverage(votes: DataFrame, attributes: DataFrame, column: str) -> DataFrame:
    """(leg, total, known, share): distinct voters of each term and those with the attribute."""
    v = votes.select("leg", "voter_id").distinct().join(attributes, "voter_id", "left")
    g = v.groupBy("leg").agg(F.count(F.lit(1)).alias("total"), F.count(column).alias("known"))
    return g.withColumn("share", F.round(100.0 * F.col("known") / F.col("total"), 2))


def within_person(p: DataFrame, column: str, one: str, two: str) -> DataFrame:
    """(voter_id, d_one, d_two, delta): persons seen under both values, their mean discipline under each."""
    g = p.groupBy("voter_id").pivot(column, [one, two]).agg(F.avg("discipline")).dropna()
    return g.select("voter_id", F.round(F.col(one), 6).alias("d_one"), F.round(F.col(two), 6).alias("d_two"), F.round(F.col(two) - F.col(one), 6).alias("delta"))


def trajectories(p: DataFrame) -> DataFrame:
    """Voters seen in two terms or more: terms, parties, first and last discipline, mean absolute step, switcher."""
    w = Window.partitionBy("voter_id").orderBy("leg")
    s = p.select("voter_id", "leg", "grp", "discipline", F.abs(F.col("discipline") - F.lag("discipline").over(w)).alias("step"))
    g = s.groupBy("voter_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.array_join(F.transform(F.array_sort(F.collect_set("leg")), lambda x: x.cast("string")), ";").alias("terms"),
        F.array_join(F.transform(F.array_sort(F.collect_set("grp")), lambda x: x.cast("string")), ";").alias("parties"), F.min_by("discipline", "leg").alias("first"), F.max_by("discipline", "leg").alias("last"),
        F.round(F.avg("step"), 6).alias("mean_step"), (F.countDistinct("grp") > 1).alias("switcher"))
    return g.filter("n_terms >= 2")


def switches(p: DataFrame) -> DataFrame:
    """(voter_id, leg, from_grp, to_grp, delta): changes of party between consecutive terms of a voter."""
    w = Window.partitionBy("voter_id").orderBy("leg")
    s = p.select("voter_id", "leg", F.lag("grp").over(w).alias("from_grp"), F.col("grp").alias("to_grp"), F.round(F.col("discipline") - F.lag("discipline").over(w), 6).alias("delta"))
    return s.filter("from_grp <> to_grp")


def party_slopes(p: DataFrame) -> DataFrame:
    """(grp, n_terms, slope, first, last): least-squares slope of mean discipline over a party's terms (three or more)."""
    g = p.groupBy("grp", "leg").agg(F.avg("discipline").alias("d")).withColumn("i", (F.row_number().over(Window.partitionBy("grp").orderBy("leg")) - 1).cast("double"))
    s = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.regr_slope("d", "i"), 6).alias("slope"), F.round(F.min_by("d", "leg"), 6).alias("first"), F.round(F.max_by("d", "leg"), 6).alias("last"))
    return s.filter("n_terms >= 3")


def dominant_term(votes: DataFrame) -> DataFrame:
    """(voter_id, leg, n): the term with most of a voter's votes, ties to the earliest."""
    n = votes.groupBy("voter_id", "leg").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("voter_id").agg(F.min_by("leg", F.struct(-F.col("n"), F.col("leg"))).alias("leg"), F.max("n").alias("n"))


def wide(p: DataFrame, terms: list[int]) -> DataFrame:
    """(grp, t0, t1, ...): mean discipline of each party by term."""
    return p.groupBy("grp").pivot("leg", terms).agg(F.round(F.avg("discipline"), 6)).select("grp", *[F.col(str(t)).alias(f"t{t}") for t in terms])


def weighted_power(seats: DataFrame, power: DataFrame) -> DataFrame:
    """(grp, seats, power): seats summed and power averaged with the seats as weights over the terms."""
    j = seats.join(power, ["leg", "grp"])
    return j.groupBy("grp").agg(F.sum("seats").alias("seats"), F.round(F.sum(F.col("power") * F.col("seats")) / F.sum("seats"), 6).alias("power"))
