"""Names and ids of parties and organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rules import name_key

# Party names in votes and their ids; long names and their short forms, in order of precedence; order of display.
ID_OF_NAME = {"Morena": "O01", "PT": "O02", "PVEM": "O03", "PAN": "O04", "PRI": "O05", "MC": "O06", "PRD": "O07", "Independientes": "O11", "CONV": "O12", "NA": "O13", "ALT": "O14", "PES": "O15", "SP": "O16"}
UNAFFILIATED = "O11"
SHORT_OF_LONG = {
    "MORENA": "MORENA", "MOVIMIENTO REGENERACION NACIONAL": "MORENA", "PAN": "PAN", "PARTIDO ACCION NACIONAL": "PAN", "PVEM": "PVEM", "PARTIDO VERDE ECOLOGISTA DE MEXICO": "PVEM", "PARTIDO VERDE": "PVEM",
    "PT": "PT", "PARTIDO DEL TRABAJO": "PT", "PRI": "PRI", "PARTIDO REVOLUCIONARIO INSTITUCIONAL": "PRI", "MC": "MC", "MOVIMIENTO CIUDADANO": "MC", "PRD": "PRD", "PARTIDO DE LA REVOLUCION DEMOCRATICA": "PRD",
    "CONV": "CONV", "CONVERGENCIA": "CONV", "CONVERGENCIA POR LA DEMOCRACIA": "CONV", "NA": "NA", "NUEVA ALIANZA": "NA", "ALT": "ALT", "ALTERNATIVA": "ALT", "ALTERNATIVA SOCIALDEMOCRATA": "ALT",
    "PES": "PES", "PARTIDO ENCUENTRO SOCIAL": "PES", "SP": "SP", "SIN PARTIDO": "SP", "INDEPENDIENTE": "IND",
}


def _known(value: Column) -> Column:
    """The id of a party name, or an id O01 to O16 itself; else null."""
    names = F.create_map(*[F.lit(x) for kv in ID_OF_NAME.items() for x in kv])
    return F.coalesce(F.when(value.rlike(r"^O(?:0[1-9]|1[0-6])$"), value), F.try_element_at(names, value))


def party_id(value: Column) -> Column:
    """Id of a vote's party value; unknown and null values are unaffiliated."""
    return F.coalesce(_known(value), F.lit(UNAFFILIATED))


def party_id_or_same(value: Column) -> Column:
    """Id of a party value; unknown values stay, null stays null."""
    return F.coalesce(_known(value), value)


def short_name(name: Column) -> Column:
    """Short form of a party's long name: by equal key, else by the first entry that the name contains, else the name in capitals."""
    key = name_key(name)
    exact = F.coalesce(*[F.when(key == long.lower(), short) for long, short in SHORT_OF_LONG.items()])
    inside = F.coalesce(*[F.when(key.contains(long.lower()), short) for long, short in SHORT_OF_LONG.items()])
    return F.coalesce(exact, inside, F.upper(F.trim(name)))


def dictionary(orgs: DataFrame) -> DataFrame:
    """(key, id) from organisations (id, abbr, name): ids, abbreviations, names and first words of more than two letters, as written and in capitals; earlier kinds win, then smaller ids."""
    first = F.get(F.split("name", " "), F.lit(0))
    long_first = F.when(F.length(first) > 2, first)
    keys = F.array(F.col("id"), F.col("abbr"), F.upper("abbr"), F.col("name"), long_first, F.upper(long_first))
    return orgs.select("id", F.posexplode(keys).alias("rank", "key")).filter("key is not null").groupBy("key").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def resolve(refs: DataFrame, orgs: DataFrame) -> DataFrame:
    """refs (ref, ...) plus org_id and created: by id, abbreviation, name, abbreviation in any case; others are new organisations numbered on by name.

    Blank references, TOTAL and dates give null. Distinct references are resolved, so repeated ones cost nothing.
    """
    ref = F.trim("ref")
    known = refs.select("ref").distinct().withColumn("r", F.when((ref != "") & (ref != "TOTAL") & ~ref.rlike(r"^\d{2}/\d{2}/\d{4}$"), ref))
    ways = [("id", F.col("id"), F.col("r")), ("abbr", F.col("abbr"), F.col("r")), ("name", F.col("name"), F.col("r")), ("any", F.upper("abbr"), F.upper("r"))]
    for tag, key, wanted in ways:
        table = orgs.groupBy(key.alias(f"k_{tag}")).agg(F.min("id").alias(f"by_{tag}"))
        known = known.join(table, wanted == F.col(f"k_{tag}"), "left").drop(f"k_{tag}")
    known = known.withColumn("found", F.coalesce("by_id", "by_abbr", "by_name", "by_any"))
    last = orgs.filter(F.col("id").rlike(r"^O\d+$")).agg(F.coalesce(F.max(F.substring("id", 2, 18).cast("long")), F.lit(0).cast("long")).alias("last"))
    new = known.filter("found is null and r is not null").groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    # numbered inside blocks of equal first letters, from the sizes of the blocks before
    new = new.withColumn("b", F.substring("r", 1, 2))
    base = new.groupBy("b").agg(F.count(F.lit(1)).alias("m")).select("b", (F.sum("m").over(Window.orderBy("b")) - F.col("m")).alias("before"))
    new = new.join(base, "b").join(F.broadcast(last), F.lit(True))  # one row
    number = F.col("last") + F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("r"))
    new = new.select("r", F.when(F.col("r").rlike(r"^O\d+$"), F.col("r")).otherwise(F.format_string("O%02d", number)).alias("made"))
    known = known.join(new, "r", "left").select("ref", F.coalesce("found", "made").alias("org_id"), F.col("made").isNotNull().alias("created"))
    return refs.join(known, "ref", "left")
