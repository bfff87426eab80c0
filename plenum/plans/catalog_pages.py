"""Page jobs: pages are made from the votes and tables, read back by the extractors, and compared with what they were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.sources import pages as pg

from .base import query
from .views import table, votes

TEXT_OF_OPTION = {"a_favor": "A favor", "en_contra": "En contra", "abstencion": "Abstenci&oacute;n", "ausente": "Ausente"}


def _tag(name: str, *parts) -> F.Column:
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def _cells(*values) -> F.Column:
    return _tag("tr", *[_tag("td", F.lit(" "), v.cast("string")) for v in values])


def _breakdowns(s, d):
    """Breakdown pages; those of odd events have a row of totals."""
    count = lambda o: F.count_if(F.col("option") == o)
    n = votes(s, d).groupBy("vote_event_id", "grp").agg(count("a_favor").alias("f"), count("en_contra").alias("c"), count("abstencion").alias("a"), count("ausente").alias("x"), F.count(F.lit(1)).alias("t"))
    row = _cells(F.concat(F.lit("<b>party</b> "), F.col("grp").cast("string")), F.col("f"), F.col("c"), F.col("a"), F.lit(0), F.col("x"), F.col("t"))
    p = n.groupBy("vote_event_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"), *[F.sum(k).alias(k) for k in "fcaxt"])
    total = F.when(F.col("vote_event_id") % 2 == 1, _cells(F.lit("Total"), F.col("f"), F.col("c"), F.col("a"), F.lit(0), F.col("x"), F.col("t"))).otherwise("")
    head = F.lit("<tr><th>Partido</th><th>A favor</th></tr>")
    return p.select(F.col("vote_event_id").alias("page_id"), _tag("table", head, F.col("rows"), total).alias("html"))


PER_PARTY = " select vote_event_id as page_id, 'party '||cast(grp as varchar) as party, cast(count(*) filter (option='a_favor') as int) as a_favor, cast(count(*) filter (option='en_contra') as int) as en_contra, cast(count(*) filter (option='abstencion') as int) as abstencion, 0 as asistencia, cast(count(*) filter (option='ausente') as int) as ausente, cast(count(*) as int) as total from votes group by 1,2"
query("breakdown_rows", PER_PARTY)(lambda s, d: pg.breakdown(_breakdowns(s, d)).filter("not startswith(lower(party), 'total')"))
query("breakdown_totals", " select vote_event_id as page_id, count(*) filter (option='a_favor') as a_favor, count(*) filter (option='en_contra') as en_contra, count(*) filter (option='abstencion') as abstencion, cast(0 as bigint) as asistencia, count(*) filter (option='ausente') as ausente, count(*) as total from votes group by 1")(lambda s, d: pg.breakdown_totals(_breakdowns(s, d)))


def _nominals(s, d):
    option = F.coalesce(*[F.when(F.col("option") == o, t) for o, t in TEXT_OF_OPTION.items()])
    who = F.concat(F.lit('<a href="x.php?iddipt='), F.col("voter_id").cast("string"), F.lit('&pert=1">DIP  '), F.col("voter_id").cast("string"), F.lit("</a>"))
    v = votes(s, d).select("vote_event_id", "option", _cells(F.col("voter_id"), who, option).alias("row"))
    count = lambda o: F.count_if(F.col("option") == o).cast("string")
    p = v.groupBy("vote_event_id").agg(F.array_join(F.collect_list("row"), "").alias("rows"), count("a_favor").alias("f"), count("en_contra").alias("c"))
    return p.select(F.col("vote_event_id").alias("page_id"), F.concat(F.lit("<p>A favor: "), "f", F.lit("</p><p>En contra: "), "c", F.lit("</p>"), _tag("table", F.lit("<tr><th>No</th></tr>"), F.col("rows"))).alias("html"))


query("nominal_rows", " select vote_event_id as page_id, cast(voter_id as int) as number, 'DIP '||cast(voter_id as varchar) as name, voter_id as member_id, option from votes")(lambda s, d: pg.nominal_votes(_nominals(s, d).withColumn("html", F.regexp_replace("html", "&oacute;", "ó"))))
query("nominal_summaries", " select vote_event_id as page_id, 'a_favor' as option, count(*) filter (option='a_favor') as value from votes group by 1 union all select vote_event_id, 'en_contra', count(*) filter (option='en_contra') from votes group by 1")(lambda s, d: pg.nominal_summary(_nominals(s, d).withColumn("html", F.regexp_extract("html", "^(.*?)<table>", 1))))


def _senate(s, d):
    option = F.when(F.col("option") == "a_favor", "PRO").when(F.col("option") == "en_contra", "CONTRA").when(F.col("option") == "abstencion", "ABSTENCI&Oacute;N").otherwise("AUSENTE")
    v = votes(s, d).filter("chamber = 'S'").withColumn("row", _cells(F.col("voter_id"), F.concat(F.lit("<a>Sen. Apellido "), F.col("voter_id").cast("string"), F.lit(" , Ana</a>")), F.concat(F.lit("<a>g"), F.col("grp").cast("string"), F.lit("</a>")), option))
    count = lambda o: F.count_if(F.col("option") == o).cast("string")
    p = v.groupBy("vote_event_id", "start_date").agg(F.array_join(F.collect_list("row"), "").alias("rows"), count("a_favor").alias("f"), count("en_contra").alias("c"), count("abstencion").alias("a"))
    months = F.array(*[F.lit(m) for m in pg.rules.MONTHS])
    day = F.concat_ws(" de ", F.date_format("start_date", "d"), F.get(months, F.month("start_date") - 1), F.date_format("start_date", "yyyy"))
    foot = F.concat(F.lit("<tfoot><tr><td>PRO <span>"), "f", F.lit("</span></td><td>CONTRA <span>"), "c", F.lit("</span></td><td>ABSTENCI&Oacute;N <span>"), "a", F.lit("</span></td></tr></tfoot>"))
    head = F.concat(F.when(F.col("vote_event_id") % 8 == 0, "<h3>LXIV LEGISLATURA</h3>").otherwise("<h3>Primer periodo</h3><p>de la LXV Legislatura</p>"), F.lit('<div class="col-sm-12 x">Martes '), day, F.lit('</div><p class="descripcion">Asunto <i>'), F.col("vote_event_id").cast("string"), F.lit("</i></p>"))
    return p.select(F.col("vote_event_id").alias("page_id"), F.concat(head, _tag("table", F.col("rows"), foot)).alias("html"))


query("senate_events", " select vote_event_id as page_id, case when vote_event_id%8=0 then 'LXIV' else 'LXV' end as term, strftime(min(start_date),'%Y-%m-%d') as day, 'Asunto '||cast(vote_event_id as varchar) as description, count(*) filter (option='a_favor') as pro, count(*) filter (option='en_contra') as contra, count(*) filter (option='abstencion') as abstention from votes where chamber='S' group by 1")(lambda s, d: pg.senate_events(_senate(s, d)))
query("senate_votes", " select vote_event_id as page_id, cast(voter_id as int) as number, 'Apellido '||cast(voter_id as varchar)||', Ana' as name, 'G'||cast(grp as varchar) as party, option from votes where chamber='S'")(lambda s, d: pg.senate_votes(_senate(s, d)))
query("senate_counts", " select vote_event_id as page_id, 'G'||cast(grp as varchar) as party, count(*) filter (option='a_favor') as a_favor, count(*) filter (option='en_contra') as en_contra, count(*) filter (option='abstencion') as abstencion from votes where chamber='S' group by 1,2")(lambda s, d: pg.senate_counts(_senate(s, d)))


def _composition(s, d):
    link = F.concat(F.lit('<a href="listado_diputados_gpnp.php?tipot='), F.col("c_nationkey").cast("string"), F.lit('">x</a>'))
    p = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("page_id")).agg(F.array_join(F.collect_list(link), "").alias("links"), F.count(F.lit(1)).cast("string").alias("n"))
    return p.select("page_id", F.concat("links", F.lit('<figure><figcaption>Total <span class="numero"> '), "n", F.lit("</span></figcaption></figure>")).alias("html"))


query("compositions", "select distinct c_mktsegment as page_id, cast(c_nationkey as bigint) as party_code, n as members from customer join (select c_mktsegment, count(*) as n from customer group by 1) using (c_mktsegment)", view=False)(lambda s, d: pg.composition(_composition(s, d)))


def _listing(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    row = F.concat(F.lit("<tr><td>"), F.date_format("day", "dd/MM/yyyy"), F.lit('</td></tr><tr><td>7</td><td><a href="v.php?votaciont='), F.col("o_orderkey").cast("string"), F.lit('">Dictamen <b>'), F.col("o_orderkey").cast("string"), F.lit("</b></a></td></tr>"))
    return o.groupBy(F.col("o_custkey").alias("page_id")).agg(_tag("table", F.array_join(F.collect_list(row), "")).alias("html"))


query("listed_events", "select o_custkey as page_id, o_orderkey as event_code, 7 as number, 'Dictamen '||cast(o_orderkey as varchar) as title, strftime(cast(o_orderdate as date),'%Y-%m-%d') as day from orders", view=False)(lambda s, d: pg.listed_events(_listing(s, d)))


def _customers(s, d):
    """Dealt out before pages are made of them: a file that one task reads makes pages for many."""
    return table(s, d, "customer").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def _profiles(s, d):
    c = _customers(s, d).select("c_custkey", "c_nationkey", F.col("c_custkey").cast("string").alias("k"))
    return c.select(F.col("c_custkey").alias("page_id"), F.concat(
        F.lit('<h1 class="header-name">Dip. Ana  <i>'), "k", F.lit('</i></h1><p>Principio de elección: <b>Mayoría Relativa</b></p><p>Entidad: <b> Colima</b></p><p>Distrito : <b>'), F.col("c_nationkey").cast("string"), F.lit('</b></p><p>Nacimiento: <b>28-marzo - 1976</b></p>'),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('<a href="mailto:A'), "k", F.lit('@X.mx">m</a>'))).otherwise(""), F.lit('<p>Suplente: <b>Eva Ruiz</b></p><img class="header-gp" src="img/logos/PT.png">')).alias("html"))


query("deputy_profiles", "select c_custkey as page_id, 'Ana '||cast(c_custkey as varchar) as name, 'Mayoría Relativa' as principle, 'Colima' as state, cast(c_nationkey as int) as district, '1976-03-28' as birth, case when c_custkey%2=0 then 'a'||cast(c_custkey as varchar)||'@x.mx' end as email, 'Eva Ruiz' as substitute, 'pt' as party from customer", view=False)(lambda s, d: pg.deputy_profiles(_profiles(s, d)))


def _senators(s, d):
    k = F.col("c_custkey").cast("string")
    return _customers(s, d).select(F.col("c_custkey").alias("page_id"), F.concat(
        F.when(F.col("c_custkey") % 2 == 0, '<h2 class="nSenador">Senadora Eva ').otherwise('<h2 class="nSenador">Senador Luis '), k, F.lit("</h2>"),
        F.when(F.col("c_custkey") % 3 == 0, '<h3 class="tipoEleccion">Lista Nacional</h3>').when(F.col("c_custkey") % 3 == 1, '<h3 class="tipoEleccion">Primera Minoría</h3>').otherwise(""),
        F.lit('<img src="/img/estados/Colima.png"><img src="/img/partidos/PAN.svg">'), F.rpad(F.lit(""), F.when(F.col("c_custkey") % 5 == 0, 10).otherwise(5000), F.lit("."))).alias("html"))


query("senator_profiles", "select c_custkey as page_id, case when c_custkey%2=0 then 'Eva ' else 'Luis ' end||cast(c_custkey as varchar) as name, case when c_custkey%2=0 then 'F' else 'M' end as gender, case c_custkey%3 when 0 then 'plurinominal' when 1 then 'mayoria_relativa' end as seat, 'colima' as state, 'pan' as party from customer where c_custkey%5<>0", view=False)(lambda s, d: pg.senator_profiles(_senators(s, d)))
query("labelled_cells", "select c_custkey as page_id, case when c_custkey%2=0 then '1976-03-28' end as birth, case when c_custkey%3=0 then 'Mayoría relativa' end as principle from customer", view=False)(lambda s, d: pg.labelled_cells(_customers(s, d).select(F.col("c_custkey").alias("page_id"), F.concat(
    F.lit("<table><tr>"), F.when(F.col("c_custkey") % 2 == 0, "<td><font>Fecha Nacimiento: </font></td> <td><b>28-marzo - 1976</b></td>").otherwise("<td>Nombre</td><td>x</td>"), F.lit("</tr><tr>"), F.when(F.col("c_custkey") % 3 == 0, "<td>Tipo de elección</td><td><strong>Mayoría relativa</strong></td>").otherwise(""), F.lit("</tr></table>")).alias("html"))))
