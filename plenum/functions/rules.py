"""Column rules of the roll-call domain: names, dates, votes, outcomes, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms; month names; options.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
OPTIONS = ("a_favor", "en_contra", "abstencion", "ausente")
QUALIFIED, SIMPLE = "mayoria_calificada", "mayoria_simple"


def name_key(name: Column) -> Column:
    """Lower case without marks, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(name, MARKED, PLAIN)), r"\s+", " "))


def bare_name(name: Column) -> Column:
    """name_key without titles, parentheses and points; commas part words."""
    n = F.regexp_replace(name, r"(?i)^\s*(?:dip|sen|lic|dr|dra|ing|c)\.\s*", "")
    n = F.regexp_replace(F.regexp_replace(n, r"\([^)]*\)", ""), r"\.", "")
    return name_key(F.regexp_replace(n, ",", " "))


def sort_key(name: Column) -> Column:
    """bare_name of "Surname, Given" turned to "Given Surname"."""
    parts = F.split(name, ",", 2)
    return bare_name(F.when(F.size(parts) == 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(name))


def given_name(name: Column) -> Column:
    """First token after a comma, else the last token; particles give null."""
    after = F.get(F.split(F.trim(F.regexp_extract(name, r",(.*)$", 1)), r"\s+"), F.lit(0))
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    got = F.lower(F.when(name.contains(","), after).otherwise(last))
    return F.when(got.isin("de", "del", "la", "las", "los", "y", "") | got.isNull(), F.lit(None)).otherwise(got)


def motion_requirement(title: Column) -> Column:
    return F.when(F.upper(title).contains("CONSTITUCI"), QUALIFIED).otherwise(SIMPLE)


def motion_class(title: Column) -> Column:
    t = F.upper(title)
    return (
        F.when(t.contains("CONSTITUCI"), "reforma_constitucional").when(t.contains("LEY"), "ley_secundaria").when(t.contains("PRESUPUESTO"), "ordinaria")
        .when(t.contains("DECRETO") & (t.contains("INGRESO") | t.contains("EGRESO")), "ordinaria").otherwise("otra")
    )


def spelled_date(text: Column) -> Column:
    """An ISO, `d Month yyyy` or d/m/yyyy beginning as ISO text; blank as ''; anything else unchanged."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    words = r"^(\d{1,2})[\s-]+([^\W\d]+)[\s-]+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name_key(F.regexp_extract(t, words, 2)))
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    def iso_of(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "").when(iso != "", iso)
        .when(t.rlike(words) & (month > 0), iso_of(F.regexp_extract(t, words, 3), month.cast("string"), F.regexp_extract(t, words, 1)))
        .when(t.rlike(slash), iso_of(F.regexp_extract(t, slash, 3), F.regexp_extract(t, slash, 2), F.regexp_extract(t, slash, 1))).otherwise(text)
    )


def numeric_date(text: Column) -> Column:
    """dd/mm/yyyy, dd-mm-yyyy, yyyy-mm-dd or dd/mm/yy as ISO text, else ''."""
    tried = [F.try_to_timestamp(F.when(text.rlike(p), text), F.lit(f)) for f, p in (("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("dd/MM/yy", r"^\d{2}/\d{2}/\d{2}$"))]
    return F.coalesce(F.date_format(F.coalesce(*tried), "yyyy-MM-dd"), F.lit(""))


def option_of_deputy(text: Column) -> Column:
    k = name_key(text)
    return F.when(k.contains("favor"), "a_favor").when(k.contains("contra"), "en_contra").when(k.contains("ausente"), "ausente").when(k.rlike("absten|asistencia|solo"), "abstencion").otherwise("ausente")


def option_of_senator(text: Column) -> Column:
    k = F.upper(F.translate(F.regexp_replace(text, r"(?i)&([aeiou])acute;", "$1"), MARKED, PLAIN))
    return F.when(k.contains("PRO") & ~k.contains("ABSTEN"), "a_favor").when(k.contains("CONTRA"), "en_contra").when(k.contains("ABSTEN"), "abstencion").when(k.contains("AUSENTE"), "ausente").otherwise("abstencion")


def outcome(favor: Column, contra: Column, abstention: Column, requirement: Column, abstention_free_is_simple: bool = False) -> Column:
    """Result of a vote, in whole numbers: two thirds of those present for a qualified majority, else the larger side."""
    present = favor + contra + abstention
    simple = F.when(favor > contra, "aprobada").when(favor < contra, "rechazada").otherwise("empate")
    qualified = F.when((present > 0) & (3 * favor >= 2 * present), "aprobada").otherwise("rechazada")
    strict = requirement == QUALIFIED
    if abstention_free_is_simple:
        strict = strict & (abstention > 0)
    return F.when(strict, qualified).otherwise(F.when(present == 0, "rechazada").otherwise(simple))


def majority_needed(requirement: Column, seats: Column, attending: Column) -> Column:
    return F.when(requirement == QUALIFIED, F.floor((2 * seats + 2) / 3)).otherwise(F.floor((attending + 1) / 2)).cast("long")


def position(favor: Column, contra: Column, attending: Column) -> Column:
    return F.when(attending == 0, "ausente").when(2 * favor > attending, "a_favor").when(2 * contra > attending, "en_contra").otherwise("dividido")


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """Share in percent; 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / total, digits))


def percent_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "%", "")).try_cast("double")


TITLE = r"(?i)^(?:Dip\.\s*|Sen\.\s*|Senadora\s+|Diputada\s+|Diputado\s+)"
PARTICLES = ("de", "del", "la", "las", "los", "el", "van", "von", "di", "da")
TERMS = ("LX", "LXI", "LXII", "LXIII", "LXIV", "LXV", "LXVI")


def plain_name(name: Column) -> Column:
    """The name as written, without title, leave or death notes, commas and points."""
    n = F.regexp_replace(F.regexp_replace(F.trim(name), TITLE, ""), r"(?i)\s*\((?:LICENCIA|DECESO)\)\s*", "")
    return F.trim(F.regexp_replace(F.translate(n, ",.", "  "), r"\s+", " "))


def third_token(name: Column) -> Column:
    """The token after two surnames, leading particles skipped; null for names with a comma, shorter ones, and particles."""
    n = F.regexp_replace(F.regexp_replace(F.trim(name), TITLE, ""), r"(?i)\s*\((?:LICENCIA|DECESO)\)\s*", "")
    tokens = F.filter(F.split(n, r"\s+"), lambda t: t != "")
    skipped = F.array_position(F.transform(tokens, lambda t: F.lower(t).isin(*PARTICLES)), False) - 1
    got = F.btrim(F.get(tokens, skipped + 2), F.lit(".,"))
    return F.when(n.contains(",") | (skipped < 0) | F.lower(got).isin(*PARTICLES), F.lit(None)).otherwise(got)


def clean_senator_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(name, r"(?i)^Sen\.\s*", "")), r"\s*,\s*", ", "), r"\s{2,}", " "))


def _month_number(name: Column) -> Column:
    return F.lpad(F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)), F.lit(0).cast("long")).cast("string"), 2, "0")


def natural_date(text: Column) -> Column:
    """`d de Month de yyyy` anywhere in the text as ISO text, an unknown month as 01; else ''."""
    p = r"(?i)(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})"
    part = lambda k: F.regexp_extract(text, p, k)
    return F.when(text.rlike(p), F.concat_ws("-", part(3), F.coalesce(_month_number(part(2)), F.lit("01")), F.lpad(part(1), 2, "0"))).otherwise("")


def profile_date(text: Column) -> Column:
    """`d-month - yyyy` as ISO text; null if it is none."""
    p = r"^(\d{1,2})\s*-\s*(\w+)\s*[- ]+\s*(\d{4})"
    part = lambda k: F.regexp_extract(F.trim(text), p, k)
    month = _month_number(part(2))
    return F.when(F.trim(text).rlike(p) & month.isNotNull(), F.concat_ws("-", part(3), month, F.lpad(part(1), 2, "0")))


def stamp_date(text: Column) -> Column:
    """The date of `+yyyy-mm-ddT...`; null if it is none."""
    day = F.get(F.split(F.regexp_replace(text, r"^\++", ""), "T"), F.lit(0))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)


def term_in_text(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?i)\b([LXVI]+)\s+LEGISLATURA\b", 1))


def session_year(text: Column) -> Column:
    t = F.upper(text)
    return F.when(t.contains("PRIMER"), 1).when(t.contains("SEGUNDO"), 2).when(t.contains("TERCER"), 3).otherwise(0)


def session_period(text: Column) -> Column:
    """The period named by ordinal and kind; else any `word PERIODO words` without AÑO; else ''."""
    named = F.upper(F.regexp_extract(text, r"(?i)((?:PRIMER|SEGUNDO|TERCER|CUARTO|QUINTO)\s+PERIODO\s+(?:ORDINARIO|EXTRAORDINARIO|PERMANENTE))", 1))
    loose = F.upper(F.regexp_extract(text, r"(?iU)(\w+\s+PERIODO\s+\w+(?:\s+\w+)?)", 1))
    return F.when(named != "", named).when(~loose.contains("AÑO"), loose).otherwise("")


def term_ordinal(term: Column, unknown: int = 0) -> Column:
    k = F.array_position(F.array(*[F.lit(t) for t in TERMS]), term)
    return F.when(k > 0, k + 59).otherwise(unknown).cast("int")


def gender_of_name(name: Column, female: list[str]) -> Column:
    """F if a token is in the list of female names, else null."""
    return F.when(F.arrays_overlap(F.split(F.lower(F.trim(name)), r"\s+"), F.array(*[F.lit(x) for x in female])), "F")


def gender_of_label(label: Column) -> Column:
    k = F.lower(F.trim(label))
    return F.when(k.isin("masculino", "male", "hombre"), "M").when(k.isin("femenino", "female", "mujer"), "F").when(k == "intersex", "NB")


def seat_of_principle(text: Column) -> Column:
    """Seat type of an election principle, also where letters with marks were lost."""
    k = F.lower(F.trim(text))
    return F.when(k.contains("mayor") & k.contains("relativa"), "mayoria_relativa").when(k.contains("representaci") & k.contains("proporcional"), "plurinominal").when(k.contains("primera minor"), "mayoria_relativa")


def label_flags(label: Column) -> tuple[Column, Column, Column]:
    """Whether a label names the national list, a state, a substitute."""
    k = F.coalesce(F.lower(label), F.lit(""))
    listed = k.contains("lista nacional")
    return listed, ~listed & F.coalesce(label, F.lit("")).rlike(r"por\s+[A-ZÁÉÍÓÚÑa-záéíóúñÃ]"), ~listed & k.contains("suplente")


def with_identifier(identifiers: Column, scheme: str, value: Column) -> Column:
    """JSON object of identifiers with one more; a list of {scheme, identifier} becomes an object, malformed text an empty one."""
    listed = F.from_json(identifiers, "array<struct<scheme:string,identifier:string>>")
    mapped = F.from_json(identifiers, "map<string,string>")
    of_list = F.map_from_entries(F.transform(F.filter(listed, lambda x: x["scheme"].isNotNull()), lambda x: F.struct(x["scheme"], F.coalesce(x["identifier"], F.lit("")))))
    known = F.coalesce(F.when(F.trim(identifiers).startswith("["), of_list).when(F.trim(identifiers).startswith("{"), mapped), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(known, lambda k, _: k != scheme), F.create_map(F.lit(scheme), value.cast("string"))))


# The year in which a term ends, and the term of all that comes later.
TERM_UNTIL = {"LX": 2009, "LXI": 2012, "LXII": 2015, "LXIII": 2018, "LXIV": 2021}
LAST_TERMS = ("LXV", "LXVI")


def term_by_cutoffs(date: Column) -> Column:
    """The term of a date by the years in which terms end; the last but one ends with August 2024. No date gives the last term."""
    year = F.year(date)
    out = F.when(date.isNull(), LAST_TERMS[1])
    for term, end in TERM_UNTIL.items():
        out = out.when(year < end, term)
    return out.when(date < F.lit("2024-09-01").cast("date"), LAST_TERMS[0]).otherwise(LAST_TERMS[1])


# Spellings of parties, and of periods, that are compared between chambers; periods that are compared as one.
COMPARED_PARTY = {
    "Morena": "MORENA", "Partido Accion Nacional (PAN)": "PAN", "Partido Acción Nacional (PAN)": "PAN", "Partido Revolucionario Institucional (PRI)": "PRI", "Partido Verde Ecologista de Mexico (PVEM)": "PVEM",
    "Partido Verde Ecologista de México (PVEM)": "PVEM", "Partido del Trabajo (PT)": "PT", "Movimiento Ciudadano (MC)": "MC", "Partido de la Revolucion Democratica (PRD)": "PRD", "Partido de la Revolución Democrática (PRD)": "PRD",
    "Convergencia": "CONV", "Nueva Alianza": "NA", "NUEVA ALIANZA": "NA",
}
COMPARED_PERIOD = {
    "LX (06-09)": "LX (2006-09)", "LX+ (2006-09-29 a 2010-04-29)": "LX/LXI (2006-10)", "LXI (09-12)": "LXI (2009-12)", "LXII (12-13)": "LXII (2012-15)", "LXII (12-15)": "LXII (2012-15)", "LXIII (15-18)": "LXIII (2015-18)",
    "LXIV (18-19)": "LXIV (2018-21)", "LXIV (18-21)": "LXIV (2018-21)", "LXV (21-23)": "LXV/LXVI (2021-26)", "LXV+ (2021-12-15 a 2026-03-25)": "LXV/LXVI (2021-26)", "LXVI (24-26)": "LXVI (2024-26)",
}
JOINT_PERIOD = {"LX/LXI (2006-10)": "LX-LXI (2006-12)", "LX (2006-09)": "LX-LXI (2006-12)", "LXI (2009-12)": "LX-LXI (2006-12)", "LXV/LXVI (2021-26)": "LXV+ (2021-26)", "LXVI (2024-26)": "LXV+ (2021-26)"}


def _spelled(value: Column, known: dict[str, str]) -> Column:
    """The known form of a value, else the value without outer spaces."""
    plain = F.trim(value)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), plain), plain)


def compared_party(name: Column) -> Column:
    """The short name under which both chambers' parties are compared; ??? without a name."""
    return F.when(name.isNull() | (name == ""), "???").otherwise(_spelled(name, COMPARED_PARTY))


def compared_period(label: Column, joint: bool = False) -> Column:
    """The label under which both chambers' periods are compared; joint: of the longer spans for which both have data."""
    out = _spelled(label, COMPARED_PERIOD)
    return _spelled(out, JOINT_PERIOD) if joint else out
