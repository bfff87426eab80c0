"""Repairs of loaded tables: counts, groups, keys, terms, requirements, dates, seats, genders, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import rules as ru
from plenum.operators import resolve


def rebuilt_counts(counts: DataFrame, votes: DataFrame) -> DataFrame:
    """(vote_event_id, option, grp, value): one count per event, option and party; totals (grp null) are the sums of the parties', or of the votes where an event has no counts."""
    parties = counts.filter("grp is not null").groupBy("vote_event_id", "option", "grp").agg(F.min("value").alias("value"))
    totals = parties.groupBy("vote_event_id", "option").agg(F.sum("value").alias("value"))
    bare = votes.join(counts.select("vote_event_id").distinct(), "vote_event_id", "left_anti").groupBy("vote_event_id", "option").agg(F.count(F.lit(1)).alias("value"))
    none = F.lit(None).cast(counts.schema["grp"].dataType).alias("grp")
    return parties.select("vote_event_id", "option", "grp", "value").unionByName(totals.unionByName(bare).select("vote_event_id", "option", none, "value"))


def standard_groups(rows: DataFrame, group: str, standard: Column) -> tuple[DataFrame, DataFrame]:
    """rows with the group column replaced by its standard value, and the values (value, n) that have none."""
    got = rows.withColumn("__new", standard)
    lost = got.filter(F.col("__new").isNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn(group, F.coalesce("__new", group)).drop("__new"), lost


def repaired_keys(rows: DataFrame, key: str, parents: DataFrame, parent: str, legacy: DataFrame | None = None) -> DataFrame:
    """rows with key and `action`: kept if a parent has it, mapped if legacy (old, new) leads to one, else null and cleared."""
    ids = parents.select(F.col(parent).alias("__p")).distinct()
    got = rows.join(ids, F.col(key) == F.col("__p"), "left")
    if legacy is not None:
        moved = legacy.groupBy(F.col("old").alias("__o")).agg(F.min("new").alias("__n")).join(ids.withColumnRenamed("__p", "__q"), F.col("__n") == F.col("__q"), "left_semi")
        got = got.join(moved, F.col(key) == F.col("__o"), "left")
    else:
        got = got.withColumn("__n", F.lit(None).cast(rows.schema[key].dataType)).withColumn("__o", F.col("__n"))
    action = F.when(F.col(key).isNull(), "empty").when(F.col("__p").isNotNull(), "kept").when(F.col("__n").isNotNull(), "mapped").otherwise("cleared")
    return got.withColumn("action", action).withColumn(key, F.coalesce("__p", "__n")).select(*rows.columns, "action")


def relabelled(rows: DataFrame, label: str, at: str, ranges: list[tuple[str, str, object]]) -> DataFrame:
    """rows with the label of the range (start, end, label; inclusive) that holds the date; others keep theirs."""
    out = F.col(label)
    for start, end, value in reversed(ranges):
        out = F.when(F.col(at).between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(value)).otherwise(out)
    return rows.withColumn(label, out.cast(rows.schema[label].dataType))


def with_requirement(events: DataFrame, motions: DataFrame) -> DataFrame:
    """events (.., motion_id, requirement) with missing requirements taken from the motion (id, requirement, title), else from its title."""
    m = motions.select(F.col("id").alias("motion_id"), F.col("requirement").alias("__r"), F.col("title").alias("__t"))
    return events.join(m, "motion_id", "left").withColumn("requirement", F.coalesce("requirement", "__r", ru.motion_requirement(F.coalesce("__t", F.lit(""))))).drop("__r", "__t")


def membership_dates(members: DataFrame, votes: DataFrame, terms: DataFrame) -> DataFrame:
    """members (person, start, end) with missing dates from the term (leg, start, end; the calendar) that the person voted in most, ties to the later."""
    n = votes.groupBy(F.col("voter_id").alias("person"), "leg").agg(F.count(F.lit(1)).alias("n")).groupBy("person").agg(F.max_by("leg", F.struct("n", "leg")).alias("leg"))
    cal = F.broadcast(terms.select("leg", F.col("start").alias("__s"), F.col("end").alias("__e")))
    j = members.join(n.join(cal, "leg"), "person", "left")
    return j.withColumns({"start": F.coalesce("start", "__s"), "end": F.coalesce("end", "__e")}).select(*members.columns)


def merged_dates(orgs: DataFrame, news: DataFrame, key: str, dates: list[str]) -> DataFrame:
    """orgs with missing dates from news, never overwritten, and `conflict`: a date that differs."""
    one = news.groupBy(key).agg(*[F.min(c).alias(f"__{c}") for c in dates])
    j = orgs.join(one, key, "left")
    conflict = F.lit(False)
    for c in dates:
        conflict = conflict | F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False))
    j = j.withColumn("conflict", conflict)
    for c in dates:
        j = j.withColumn(c, F.coalesce(c, f"__{c}"))
    return j.select(*orgs.columns, "conflict")


def seat_types(labels: DataFrame, person: str, label: str) -> DataFrame:
    """(person, seat): from all labels of a person: national list, else state, else substitute, else null."""
    listed, state, substitute = ru.label_flags(F.col(label))
    g = labels.groupBy(person).agg(F.bool_or(listed).alias("l"), F.bool_or(state).alias("s"), F.bool_or(substitute).alias("u"))
    return g.select(person, F.when(F.col("l"), "plurinominal").when(F.col("s"), "mayoria_relativa").when(F.col("u"), "suplente").alias("seat"))


def seeded_genders(people: DataFrame, seeds: DataFrame, person: str) -> DataFrame:
    """(person, gender, how): of the seed (name, gender) with the equal name key, else of the most similar one that shares the first token."""
    p = people.select(person, ru.name_key(F.col("name")).alias("name"))
    s = seeds.select(ru.name_key(F.col("name")).alias("name"), "gender").groupBy("name").agg(F.min("gender").alias("gender"))
    exact = p.join(s, "name").select(person, "gender", F.lit("exact").alias("how"))
    rest = p.join(exact.select(person), person, "left_anti")
    near = resolve.fuzzy(rest, s.withColumn("seed", F.col("name")), person, "seed")
    return exact.unionByName(near.join(s, near["seed"] == s["name"]).select(person, "gender", F.lit("similar").alias("how")))


def new_memberships(people: DataFrame, votes: DataFrame, members: DataFrame) -> DataFrame:
    """(person, leg): the terms in which people (person) voted and for which members (person, leg) has no row."""
    voted = votes.select(F.col("voter_id").alias("person"), "leg").distinct().join(people.select("person").distinct(), "person", "left_semi")
    return voted.join(members.select("person", "leg").distinct(), ["person", "leg"], "left_anti")
