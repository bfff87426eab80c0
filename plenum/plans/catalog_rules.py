"""Column rules over tables of inputs: each row of a table gets one of the cases, and the SQL gives what the case asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions import parties as pa
from plenum.functions import rules as ru

from .base import query
from .views import table, votes


def text(value: str | int | None) -> str:
    """A value as SQL of either engine."""
    if value is None:
        return "cast(null as varchar)"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def case_of(key: str, values: list) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then {text(v)}" for k, v in enumerate(values)) + " end"


def rule(name: str, apply: Callable[[Column], Column], cases: list[tuple], source: str = "orders", key: str = "o_orderkey") -> None:
    """Register apply over all rows of a table, with inputs and expected results from the cases (input, result)."""
    inputs, results = [c[0] for c in cases], [c[1] for c in cases]
    given = case_of(key, inputs).replace("varchar", "string").replace("\\", "\\\\")
    query(name, f"select {key}, {case_of(key, results)} as result from {source}", view=False)(lambda s, d: table(s, d, source).select(key, apply(F.expr(given)).alias("result")))


rule("plain_names", ru.plain_name, [("Dip. Juan  Pérez", "Juan Pérez"), ("Senadora Ana Ruiz (LICENCIA)", "Ana Ruiz"), ("López, María J.", "López María J"), ("Diputado Luis Gil (deceso)", "Luis Gil"), ("  ", "")])
rule("bare_names", ru.bare_name, [("Dip. Juan (suplente) Pérez", "juan perez"), ("Ruiz, Ana", "ruiz ana"), ("Dra. Eva Ñu", "eva nu")])
rule("sort_keys", ru.sort_key, [("Pérez López, Juan", "juan perez lopez"), ("Ana Ruiz", "ana ruiz")])
rule("given_names", ru.given_name, [("Pérez López, Juan Carlos", "juan"), ("Pérez López Ana", "ana"), ("Juan de", None)])
rule("third_tokens", ru.third_token, [("Pérez López Ana María", "Ana"), ("De la Cruz Gil Eva", "Eva"), ("Pérez, Ana", None), ("Pérez López", None), ("Pérez López de Ana", None), ("Sen. Ruiz Gil Ana.", "Ana")])
rule("senator_names", ru.clean_senator_name, [("Sen. Adame Castillo , Marco Antonio", "Adame Castillo, Marco Antonio"), ("Gil  Ruiz,Ana", "Gil Ruiz, Ana")])
rule("spelled_dates", ru.spelled_date, [("10 Diciembre 2024", "2024-12-10"), ("2024-12-10", "2024-12-10"), ("10/12/2024", "2024-12-10"), ("5 Enero 2024", "2024-01-05"), ("5-Enero-2024 jueves", "2024-01-05"), ("2024-12-10T08:00", "2024-12-10"), (" ", ""), ("hoy", "hoy"), ("5 Brumario 2024", "5 Brumario 2024")])
rule("numeric_dates", ru.numeric_date, [("31/03/2026", "2026-03-31"), ("31-03-2026", "2026-03-31"), ("2026-03-31", "2026-03-31"), ("31/03/26", "2026-03-31"), ("no-es-fecha", ""), (None, "")])
rule("natural_dates", ru.natural_date, [("Martes 05 de septiembre de 2006", "2006-09-05"), ("5 de Enero de 2007, sesión", "2007-01-05"), ("7 de brumario de 2007", "2007-01-07"), ("2007", "")])
rule("profile_dates", ru.profile_date, [("28-marzo - 1976", "1976-03-28"), ("3-mayo-1980", "1980-05-03"), ("3-nada-1980", None), ("", None)])
rule("stamp_dates", ru.stamp_date, [("+1956-03-28T00:00:00Z", "1956-03-28"), ("1956-03-28", "1956-03-28"), ("+1956", None), (None, None)])
rule("deputy_options", ru.option_of_deputy, [("A favor", "a_favor"), ("En contra", "en_contra"), ("Ausente", "ausente"), ("Abstencion", "abstencion"), ("Abstención", "abstencion"), ("Solo asistencia", "abstencion"), ("???", "ausente")])
rule("senator_options", ru.option_of_senator, [("PRO", "a_favor"), ("Contra", "en_contra"), ("ABSTENCI&Oacute;N", "abstencion"), ("Abstención", "abstencion"), ("AUSENTE", "ausente"), ("?", "abstencion")])
rule("terms_in_text", ru.term_in_text, [("LXVI Legislatura", "LXVI"), ("de la lx legislatura, sesión", "LX"), ("Legislatura", "")])
rule("session_years", ru.session_year, [("Primer año de ejercicio", 1), ("SEGUNDO AÑO", 2), ("tercer año", 3), ("año", 0)])
rule("session_periods", ru.session_period, [("primer periodo ordinario", "PRIMER PERIODO ORDINARIO"), ("SEGUNDO PERIODO EXTRAORDINARIO de 2010", "SEGUNDO PERIODO EXTRAORDINARIO"), ("sexto periodo breve", "SEXTO PERIODO BREVE"), ("receso", "")])
rule("term_ordinals", ru.term_ordinal, [("LX", 60), ("LXIII", 63), ("LXVI", 66), ("XX", 0), (None, 0)])
rule("female_names", lambda c: ru.gender_of_name(c, ["maría", "ana", "eva"]), [("Ana Ruiz", "F"), ("José María Gil", "F"), ("Juan Gil", None)])
rule("gender_labels", ru.gender_of_label, [("masculino", "M"), (" Female ", "F"), ("intersex", "NB"), ("?", None), (None, None)])
rule("seat_principles", ru.seat_of_principle, [("Mayoría Relativa", "mayoria_relativa"), ("Mayor a Relativa", "mayoria_relativa"), ("Representaci n proporcional", "plurinominal"), ("Primera minoría", "mayoria_relativa"), ("otro", None)])
rule("percent_texts", lambda c: F.floor(ru.percent_text(c) * 100).cast("int"), [("12.5%", 1250), (" 7 % ", 700), ("100%", 10000)])
rule("identifiers", lambda c: ru.with_identifier(c, "perfil", F.lit(7)), [('{"a":"1"}', '{"a":"1","perfil":"7"}'), ('[{"scheme":"a","identifier":"1"}]', '{"a":"1","perfil":"7"}'), ("not json", '{"perfil":"7"}'), (None, '{"perfil":"7"}'), ('{"perfil":"3"}', '{"perfil":"7"}')])
rule("half_even", lambda c: F.bround(c.cast("decimal(10,3)"), 2).cast("string"), [("0.125", "0.12"), ("0.135", "0.14"), ("0.145", "0.14"), ("2.675", "2.68")])
rule("party_ids", pa.party_id, [("Morena", "O01"), ("O07", "O07"), ("PT", "O02"), ("Verde", "O11"), (None, "O11"), ("SP", "O16"), ("O99", "O11")])
rule("party_ids_or_same", pa.party_id_or_same, [("PAN", "O04"), ("O05", "O05"), ("Verde", "Verde"), (None, None)])
rule("party_short_names", pa.short_name, [("Movimiento Regeneración Nacional", "MORENA"), ("pan", "PAN"), ("Partido Verde Ecologista de México", "PVEM"), ("Grupo del Partido del Trabajo", "PT"), ("Independiente", "IND"), ("Otro", "OTRO")])

# --- organisations --------------------------------------------------------------------

ORGS = "orgs as (select 'O'||right('0'||cast(n_nationkey+1 as varchar(2)),2) as id, substr(n_name,1,4) as abbr, n_name as name from nation)"
REFS = "refs as (select c_custkey, case c_custkey % 7 when 0 then 'O'||right('0'||cast(c_nationkey+1 as varchar(2)),2) when 1 then (select min(abbr) from orgs) when 2 then n_name when 3 then lower(substr(n_name,1,4)) when 4 then 'TOTAL' when 5 then '01/02/2024' else 'New '||cast(c_nationkey as varchar(2)) end as ref from customer join nation on n_nationkey=c_nationkey)"


def _orgs(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("O"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("id"), F.substring("n_name", 1, 4).alias("abbr"), F.col("n_name").alias("name"))


@query("organisation_keys", f"with {ORGS}, k as (select id, abbr as key, 1 as r from orgs union all select id, id, 0 from orgs union all select id, upper(abbr), 2 from orgs union all select id, name, 3 from orgs union all select id, string_split(name,' ')[1], 4 from orgs where length(string_split(name,' ')[1])>2 union all select id, upper(string_split(name,' ')[1]), 5 from orgs where length(string_split(name,' ')[1])>2) select key, id from (select key, id, row_number() over (partition by key order by r, id) as n from k) where n=1", view=False)
def organisation_keys(s, d):
    return pa.dictionary(_orgs(s, d)).select("key", "id")


@query("resolved_organisations", f"""with {ORGS}, {REFS}, n as (select ref, 'O'||cast(25+row_number() over (order by ref) as varchar) as made from (select distinct ref from refs where ref like 'New %'))
 select c_custkey, refs.ref, case when refs.ref='TOTAL' or refs.ref like '01/%' then null else coalesce((select min(id) from orgs where id=refs.ref), (select min(id) from orgs where abbr=refs.ref), (select min(id) from orgs where name=refs.ref), (select min(id) from orgs where upper(abbr)=upper(refs.ref)), made) end as org_id, made is not null as created from refs left join n using (ref)""", view=False)
def resolved_organisations(s, d):
    orgs = _orgs(s, d)
    first = F.lit(orgs.agg(F.min("abbr")).first()[0])
    name = F.col("n_name")
    refs = table(s, d, "customer").join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", (
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("O"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"))).when(F.col("c_custkey") % 7 == 1, first).when(F.col("c_custkey") % 7 == 2, name)
        .when(F.col("c_custkey") % 7 == 3, F.lower(F.substring(name, 1, 4))).when(F.col("c_custkey") % 7 == 4, "TOTAL").when(F.col("c_custkey") % 7 == 5, "01/02/2024").otherwise(F.concat(F.lit("New "), F.col("c_nationkey").cast("string")))
    ).alias("ref"))
    return pa.resolve(refs, orgs).select("c_custkey", "ref", "org_id", "created")
rule("compared_parties", ru.compared_party, [("Morena", "MORENA"), ("Partido Acción Nacional (PAN)", "PAN"), (" Nueva Alianza ", "NA"), ("Otro ", "Otro"), ("", "???"), (None, "???"), ("PRD", "PRD")])
rule("compared_periods", ru.compared_period, [("LXII (12-13)", "LXII (2012-15)"), ("LXV (21-23)", "LXV/LXVI (2021-26)"), (" LX (06-09)", "LX (2006-09)"), ("LXX", "LXX"), (None, None)])
rule("joint_periods", lambda c: ru.compared_period(c, joint=True), [("LXI (09-12)", "LX-LXI (2006-12)"), ("LXVI (24-26)", "LXV+ (2021-26)"), ("LXIII (15-18)", "LXIII (2015-18)"), ("LX+ (2006-09-29 a 2010-04-29)", "LX-LXI (2006-12)")])
query("cutoff_terms", "select vote_event_id, start_date, case when year(start_date)<2009 then 'LX' when year(start_date)<2012 then 'LXI' when year(start_date)<2015 then 'LXII' when year(start_date)<2018 then 'LXIII' when year(start_date)<2021 then 'LXIV' when year(start_date)*100+month(start_date)<202409 then 'LXV' else 'LXVI' end as term from (select distinct vote_event_id, start_date from votes)")(
    lambda s, d: votes(s, d).select("vote_event_id", "start_date").distinct().withColumn("term", ru.term_by_cutoffs(F.col("start_date"))))
