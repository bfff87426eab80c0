"""Tallies of events: options by party, outcomes, positions, pivotal parties, empirical power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions.rules import OPTIONS, majority_needed, outcome, percent, position

from .graph import stored


def by_party(votes: DataFrame) -> DataFrame:
    """(vote_event_id, requirement, grp, a_favor, en_contra, abstencion, ausente, attending)."""
    n = votes.groupBy("vote_event_id", "requirement", "grp").agg(*[F.count_if(F.col("option") == o).alias(o) for o in OPTIONS])
    return n.withColumn("attending", F.col("a_favor") + F.col("en_contra") + F.col("abstencion"))


def by_event(votes: DataFrame, senate_rule: bool = False) -> DataFrame:
    """Totals of each event, its outcome, the majority it needed and the margin of the winning side."""
    n = votes.groupBy("vote_event_id", "requirement").agg(*[F.count_if(F.col("option") == o).alias(o) for o in OPTIONS], F.count(F.lit(1)).alias("seats"))
    n = n.withColumn("attending", F.col("a_favor") + F.col("en_contra") + F.col("abstencion"))
    n = n.withColumn("result", outcome(F.col("a_favor"), F.col("en_contra"), F.col("abstencion"), F.col("requirement"), senate_rule))
    n = n.withColumn("needed", majority_needed(F.col("requirement"), F.col("seats"), F.col("attending")))
    won = F.when(F.col("result") == "aprobada", F.col("a_favor")).otherwise(F.col("en_contra"))
    return n.withColumn("margin", won - F.col("needed"))


def positions(votes: DataFrame) -> DataFrame:
    """(vote_event_id, grp, position): each party's side in each event."""
    return by_party(votes).select("vote_event_id", "grp", position(F.col("a_favor"), F.col("en_contra"), F.col("attending")).alias("position"))


def judged(votes: DataFrame, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """by_party's rows with the totals of their event (e_ before the name), its result and needed majority, and more.

    From one pass over the votes: what an event has in all is summed over its
    parties' rows, of which there are few. side, total: the party's and all
    parties' votes on the winning side; critical; first: one row of each event.
    by: further keys; carry: columns of which an event's smallest value goes along.
    """
    n = votes.groupBy(*by, "vote_event_id", "requirement", "grp").agg(*[F.count_if(F.col("option") == o).alias(o) for o in OPTIONS], F.count(F.lit(1)).alias("seats"), *[F.min(c).alias(c) for c in carry])
    n = n.withColumn("attending", F.col("a_favor") + F.col("en_contra") + F.col("abstencion"))
    event = Window.partitionBy(*by, "vote_event_id", "requirement")
    n = n.withColumns({f"e_{c}": F.sum(c).over(event) for c in (*OPTIONS, "attending", "seats")} | {c: F.min(c).over(event) for c in carry} | {"first": F.row_number().over(event.orderBy("grp")) == 1})
    n = n.withColumn("result", outcome(F.col("e_a_favor"), F.col("e_en_contra"), F.col("e_abstencion"), F.col("requirement")))
    n = n.withColumn("needed", majority_needed(F.col("requirement"), F.col("e_seats"), F.col("e_attending")))
    won = lambda of: F.when(F.col("result") == "aprobada", F.col(f"{of}a_favor")).otherwise(F.col(f"{of}en_contra"))
    n = n.withColumns({"side": won(""), "total": won("e_")})
    critical = (F.col("side") > 0) & (F.col("total") >= F.col("needed")) & (F.col("total") - F.col("side") < F.col("needed"))
    return n.withColumn("critical", critical)


def critical_parties(votes: DataFrame) -> DataFrame:
    """(vote_event_id, requirement, result, grp, side, total, needed, critical): without the party the winning side has no majority."""
    return judged(votes).select("vote_event_id", "requirement", "result", "grp", "side", "total", "needed", "critical")


def empirical_power(votes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, grp, n_critical, n_events, power): in how many events each party was pivotal."""
    n = judged(votes, by).groupBy(*by, "grp").agg(F.count_if("critical").alias("n_critical"), F.count_if("first").alias("firsts"))
    n = n.withColumn("n_events", F.sum("firsts").over(Window.partitionBy(*by)))  # a row per party
    return n.select(*by, "grp", "n_critical", "n_events", percent(F.col("n_critical"), F.col("n_events"), 4).alias("power"))


def running_power(votes: DataFrame) -> DataFrame:
    """(grp, seq, vote_event_id, running): for every party and event in order of date, the share of all events so far in which the party was pivotal.

    Counts run within a month and go on from the months before, so that no task
    orders all events.
    """
    hits = stored(judged(votes, carry=("start_date",)).select("vote_event_id", "grp", "start_date", "first", F.col("critical").cast("long").alias("hit")))
    events = hits.filter("first").select("vote_event_id", "start_date", F.date_trunc("month", "start_date").alias("month"))
    parties = F.broadcast(hits.select("grp").distinct())  # the list of parties
    grid = events.crossJoin(parties).join(hits.select("vote_event_id", "grp", "hit"), ["vote_event_id", "grp"], "left").na.fill(0, ["hit"])
    by_month = Window.partitionBy("grp").orderBy("month")
    months = grid.groupBy("grp", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    before = months.select("grp", "month", (F.sum("n").over(by_month) - F.col("n")).alias("n0"), (F.sum("h").over(by_month) - F.col("h")).alias("h0"))
    inside = Window.partitionBy("grp", "month").orderBy("start_date", "vote_event_id")
    upto = grid.select("grp", "month", "vote_event_id", F.row_number().over(inside).alias("i"), F.sum("hit").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("c")).join(before, ["grp", "month"])
    seq = F.col("n0") + F.col("i")
    return upto.select("grp", "vote_event_id", seq.cast("long").alias("seq"), F.round((F.col("h0") + F.col("c")) / seq, 6).alias("running"))


def vote_detail(votes: DataFrame) -> DataFrame:
    """One row per event with its totals and the critical parties joined by a bar."""
    totals = (*OPTIONS, "seats", "attending")
    own = F.when(F.col("critical"), F.col("grp").cast("string"))
    e = judged(votes).groupBy("vote_event_id", "requirement").agg(*[F.max(f"e_{c}").alias(c) for c in totals], F.max("result").alias("result"), F.max("needed").alias("needed"), F.max(F.col("total") - F.col("needed")).alias("margin"), F.array_sort(F.collect_list(own)).alias("who"))
    return e.select("vote_event_id", "requirement", *OPTIONS, "seats", "attending", "result", "needed", "margin", F.array_join("who", "|").alias("critical_parties"), F.size("who").cast("long").alias("critical_count"))


def listed_criticals(detail: DataFrame) -> DataFrame:
    """(grp, n): critical parties of qualified votes, from the joined lists."""
    x = detail.filter("requirement = 'mayoria_calificada' and critical_parties <> ''").select(F.explode(F.split("critical_parties", r"\|")).alias("grp"))
    return x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def close_votes(votes: DataFrame, under: int = 10) -> DataFrame:
    return by_event(votes).filter(F.abs(F.col("a_favor") - F.col("en_contra")) < under)


def swing_voters(votes: DataFrame, under: int = 10) -> DataFrame:
    """(vote_event_id, voter_id, grp, option, position, could_flip): voters against their party's clear side in close votes."""
    side = position(F.col("a_favor"), F.col("en_contra"), F.col("attending"))
    close = judged(votes).filter(F.abs(F.col("e_a_favor") - F.col("e_en_contra")) < under).select("vote_event_id", "grp", "result", "needed", "total", side.alias("position"))
    close = close.filter("position in ('a_favor', 'en_contra')")
    v = votes.select("vote_event_id", "voter_id", "grp", "option").filter("option in ('a_favor', 'en_contra', 'abstencion')")
    j = v.join(close, ["vote_event_id", "grp"]).filter("option <> position")
    won = F.when(F.col("result") == "aprobada", F.lit("a_favor")).when(F.col("result") == "rechazada", F.lit("en_contra"))
    return j.select("vote_event_id", "voter_id", "grp", "option", "position", F.coalesce((F.col("option") == won) & (F.col("total") - 1 < F.col("needed")), F.lit(False)).alias("could_flip"))


def dissenters(votes: DataFrame, least: int = 10, n: int = 10) -> DataFrame:
    """The voters who most often voted against their party's clear side."""
    j = votes.filter("option in ('a_favor', 'en_contra')").select("vote_event_id", "voter_id", "grp", "option").join(positions(votes).filter("position in ('a_favor', 'en_contra')"), ["vote_event_id", "grp"])
    r = j.groupBy("voter_id").agg(F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("option") != F.col("position")).alias("n_dissent")).filter(F.col("n_votes") >= least)
    r = r.withColumn("rate", F.round(F.col("n_dissent") / F.col("n_votes"), 6))
    return r.orderBy(F.desc("rate"), F.desc("n_dissent"), "voter_id").limit(n)


def heat_states(votes: DataFrame) -> DataFrame:
    """(vote_event_id, grp, state) on the full grid of events and parties: 2 favour, 1 against, 0 absent, -1 split."""
    sides = stored(positions(votes))
    grid = sides.select("vote_event_id").distinct().crossJoin(F.broadcast(sides.select("grp").distinct()))  # a handful of parties
    s = F.when(F.col("position") == "a_favor", 2).when(F.col("position") == "en_contra", 1).when(F.col("position") == "dividido", -1).otherwise(0)
    return grid.join(sides, ["vote_event_id", "grp"], "left").select("vote_event_id", "grp", s.cast("long").alias("state"))


def grouped_counts(votes: DataFrame) -> DataFrame:
    """(vote_event_id, option, grp, n): counts by party, and the event's total with a null party."""
    return votes.rollup("vote_event_id", "option", "grp").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).filter("g <= 1").drop("g")


def most_critical(votes: DataFrame, n: int = 8) -> DataFrame:
    """(grp, n_critical): the n parties that are pivotal in most events, of those that ever are; ties by party."""
    hits = critical_parties(votes).filter("critical").groupBy("grp").agg(F.count(F.lit(1)).alias("n_critical"))
    return hits.orderBy(F.desc("n_critical"), "grp").limit(n)
