"""Repairs, selections, loads, communities of a given partition, paths of parties and voters, chambers compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import agreement as ag
from plenum.operators import compare as co
from plenum.operators import repair as rp
from plenum.sources import store as st

from .base import query
from .views import table, votes

# --- repairs ----------------------------------------------------------------------


def _counts(s, d):
    v = votes(s, d).filter("leg < 5")
    once = v.groupBy("vote_event_id", "option", "grp").agg(F.count(F.lit(1)).alias("value"))
    return once.unionByName(once.filter("vote_event_id % 2 = 0"))  # with repeated rows


query("rebuilt_counts", " select vote_event_id, option, grp, count(*) as value from votes where leg<5 group by 1,2,3 union all select vote_event_id, option, null, count(*) from votes group by 1,2")(lambda s, d: rp.rebuilt_counts(_counts(s, d), votes(s, d)))


def _groups(s, d):
    v = votes(s, d).select("vote_event_id", "voter_id", F.concat(F.lit("party "), F.col("grp").cast("string")).alias("grp"))
    return rp.standard_groups(v, "grp", F.when(F.col("grp") != "party 4", F.concat(F.lit("O0"), F.substring("grp", 7, 1))))


query("standard_groups", " select vote_event_id, voter_id, case when grp<>4 then 'O0'||cast(grp as varchar) else 'party 4' end as grp from votes")(lambda s, d: _groups(s, d)[0])
query("unmapped_groups", " select 'party 4' as value, count(*) as n from votes where grp=4")(lambda s, d: _groups(s, d)[1])
query("repaired_keys", "select o_orderkey, case when o_custkey%3=0 then o_custkey when o_custkey%3=1 then o_custkey-1 end as o_custkey, case when o_custkey%3=0 then 'kept' when o_custkey%3=1 then 'mapped' else 'cleared' end as action from orders", view=False)(
    lambda s, d: rp.repaired_keys(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(s, d, "customer").filter("c_custkey % 3 = 0"), "c_custkey", table(s, d, "customer").filter("c_custkey % 3 = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 1).alias("new"))))
query("relabelled_terms", " select distinct vote_event_id, case when start_date between date '2009-01-01' and date '2010-12-31' then 90 else leg end as leg from votes")(lambda s, d: rp.relabelled(votes(s, d).select("vote_event_id", "leg", "start_date").distinct(), "leg", "start_date", [("2009-01-01", "2010-12-31", 90)]).select("vote_event_id", "leg"))


def _requirements(s, d):
    events = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("motion_id"), F.when(F.col("o_orderkey") % 4 == 0, "mayoria_simple").alias("requirement"))
    motions = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "mayoria_calificada").alias("requirement"), F.when(F.col("c_custkey") % 3 == 1, "Reforma constitucional").otherwise("Ley").alias("title"))
    return rp.with_requirement(events, motions).select("o_orderkey", "requirement")


query("requirements_filled", "select o_orderkey, case when o_orderkey%4=0 then 'mayoria_simple' when o_custkey%3 in (0,1) then 'mayoria_calificada' else 'mayoria_simple' end as requirement from orders", view=False)(_requirements)


def _calendar(s):
    return s.range(7).select(F.col("id").alias("leg"), F.date_add(F.lit("2006-09-01").cast("date"), (F.col("id") * 1096).cast("int")).alias("start"), F.date_add(F.lit("2006-09-01").cast("date"), (F.col("id") * 1096 + 1094).cast("int")).alias("end"))


query("membership_dates", """#
 n as (select voter_id, leg, count(*) as n from votes group by 1,2), t as (select voter_id, leg from (select *, row_number() over (partition by voter_id order by n desc, leg desc) as k from n) where k=1)
 select s_suppkey as person, case when s_suppkey%3=0 then date '2000-01-01' else cast(date '2006-09-01' + cast(leg*1096 as int) as date) end as start, cast(date '2006-09-01' + cast(leg*1096+1094 as int) as date) as "end" from supplier left join t on voter_id=s_suppkey""")(
    lambda s, d: rp.membership_dates(table(s, d, "supplier").select(F.col("s_suppkey").alias("person"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("2000-01-01").cast("date")).alias("start"), F.lit(None).cast("date").alias("end")), votes(s, d), _calendar(s)))
query("merged_dates", "with n as (select o_custkey, min(cast(o_orderdate as date)) as d from orders group by 1) select c_custkey, coalesce(case when c_custkey%2=0 then date '1995-01-01' end, d) as founded, coalesce(case when c_custkey%2=0 then date '1995-01-01' end <> d, false) as conflict from customer left join n on o_custkey=c_custkey", view=False)(
    lambda s, d: rp.merged_dates(table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("1995-01-01").cast("date")).alias("founded")), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("founded")), "c_custkey", ["founded"]))
query("seat_types", "with f as (select o_custkey, bool_or(o_orderkey%7=0) as l, bool_or(o_orderkey%7=1) as s, bool_or(o_orderkey%7 in (2,3)) as u from orders group by 1) select o_custkey, case when l then 'plurinominal' when s then 'mayoria_relativa' when u then 'suplente' end as seat from f", view=False)(
    lambda s, d: rp.seat_types(table(s, d, "orders").select("o_custkey", F.expr("case o_orderkey % 7 when 0 then 'Senadora de Lista Nacional por turno' when 1 then 'Senador por Colima' when 2 then 'Suplente' when 3 then 'senador suplente' when 4 then 'Senador' end").alias("label")), "o_custkey", "label"))
query("seeded_genders", """with p as (select c_custkey, lower(n_name)||' x'||cast(c_custkey%4 as varchar) as name from customer join nation on n_nationkey=c_nationkey), s as (select lower(n_name)||' x'||cast(n_nationkey%4 as varchar) as name, case when n_nationkey%2=0 then 'F' else 'M' end as gender from nation),
 e as (select c_custkey, gender, 'exact' as how from p join s using (name)), j as (select c_custkey, s.name as seed, gender, round(1-levenshtein(p.name,s.name)/greatest(length(p.name),length(s.name)),6) as score from p join s on string_split(p.name,' ')[1]=string_split(s.name,' ')[1] where c_custkey not in (select c_custkey from e))
 select * from e union all select c_custkey, gender, 'similar' from (select *, row_number() over (partition by c_custkey order by score desc, seed) as k from j where score>=0.85) where k=1""", view=False)(
    lambda s, d: rp.seeded_genders(table(s, d, "customer").join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat_ws(" ", "n_name", F.concat(F.lit("x"), (F.col("c_custkey") % 4).cast("string"))).alias("name")), table(s, d, "nation").select(F.concat_ws(" ", "n_name", F.concat(F.lit("x"), (F.col("n_nationkey") % 4).cast("string"))).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "F").otherwise("M").alias("gender")), "c_custkey"))
query("new_memberships", " select distinct voter_id as person, leg from votes where not (voter_id%2=0 and leg<3)")(lambda s, d: rp.new_memberships(table(s, d, "supplier").select(F.col("s_suppkey").alias("person")), votes(s, d), votes(s, d).filter("voter_id % 2 = 0 and leg < 3").select(F.col("voter_id").alias("person"), "leg")))

# --- selections and loads ------------------------------------------------------------

query("selected_votes", " select vote_event_id, voter_id, option, start_date from votes where vote_event_id%10=3 and voter_id%3=1")(lambda s, d: st.select_votes(votes(s, d).select("vote_event_id", "voter_id", "option"), votes(s, d).select("vote_event_id", "start_date").distinct(), F.col("vote_event_id") % 10 == 3, F.col("voter_id") % 3 == 1))
query("selected_memberships", "select o_orderkey, o_custkey, o_orderpriority from orders where o_custkey%5=1 and o_orderpriority in (select min(o_orderpriority) from orders)", view=False)(lambda s, d: st.select_where(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("o_custkey") % 5 == 1, F.col("o_orderpriority") == table(s, d, "orders").agg(F.min("o_orderpriority")).first()[0]))
query("window_of_votes", " select vote_event_id, voter_id from votes where start_date between date '2010-01-01' and date '2012-12-31'")(lambda s, d: st.select_window(votes(s, d), "dates", ("2010-01-01", "2012-12-31")).select("vote_event_id", "voter_id"))


def _load(s, d):
    v = votes(s, d)
    return st.new_events(v.select("vote_event_id", "voter_id", "option", F.concat(F.lit("src"), F.col("vote_event_id").cast("string")).alias("source_id")), v.filter("leg < 3").select(F.concat(F.lit("src"), F.col("vote_event_id").cast("string")).alias("source_id")), table(s, d, "supplier").filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("voter_id")))


query("loaded_votes", " select vote_event_id, voter_id, option from votes where leg>=3 and voter_id%5<>0")(lambda s, d: _load(s, d).select("vote_event_id", "voter_id", "option"))
query("unpivoted_counts", " select vote_event_id, grp, option, count(*) as value from votes group by 1,2,3 union all select vote_event_id, null, option, count(*) from votes group by 1,3")(lambda s, d: st.unpivot_counts(votes(s, d).groupBy("vote_event_id", "grp").pivot("option", ["a_favor", "en_contra", "abstencion", "ausente"]).agg(F.count(F.lit(1))).na.fill(0), "grp"))
query("recorded_events", " select distinct vote_event_id, chamber, leg from votes where requirement='mayoria_calificada' and chamber='S'")(lambda s, d: st.select_where(votes(s, d).select("vote_event_id", "chamber", "leg", "requirement").distinct(), F.col("requirement") == "mayoria_calificada", F.col("chamber") == "S").drop("requirement"))
query("union_of_chambers", " select vote_event_id, voter_id, chamber from votes")(lambda s, d: votes(s, d).filter("chamber = 'S'").select("vote_event_id", "voter_id", "chamber").unionByName(votes(s, d).filter("chamber = 'D'").select("voter_id", "chamber", "vote_event_id")))
query("party_keys", " select distinct grp from votes")(lambda s, d: votes(s, d).filter("leg < 4").select("grp").union(votes(s, d).filter("leg >= 4").select("grp")).distinct())

# --- a given partition ----------------------------------------------------------------

PART = "# pp as (select voter_id, grp as party from (select *, row_number() over (partition by voter_id order by n desc, grp) as k from (select voter_id, grp, count(*) as n from votes group by 1,2)) where k=1), cm as (select voter_id, party, voter_id%4 as part from pp), cn as (select part, party, count(*) as n, sum(count(*)) over (partition by part) as size from cm group by 1,2), dom as (select part, party as dominant, round(n/size,6) as purity from (select *, row_number() over (partition by part order by n desc, party) as k from cn) where k=1)"


def _partition(s, d):
    parties = ag.primary_party(votes(s, d))
    return parties, parties.select("voter_id", (F.col("voter_id") % 4).alias("part"))


query("cross_party_members", PART + " select voter_id, part, party, dominant, purity from cm join dom using (part) where party<>dominant")(lambda s, d: co.off_dominant(*_partition(s, d)))
query("sub_blocks", PART + " select part, n, round(n/size,6) as share from cn where party=1 and n>=2")(lambda s, d: co.sub_blocks(*_partition(s, d), 1, 2))
query("vertices_with_community", PART + " select voter_id, party, part from cm")(lambda s, d: co.with_community(*_partition(s, d)))

# --- paths and chambers ----------------------------------------------------------------

COORD = "# co as (select voter_id, leg, min(grp) as party, round(avg(case when option='a_favor' then 1.0 else 0 end),6) as d1, round(avg(case when option='en_contra' then 1.0 else 0 end),6) as d2 from votes group by 1,2)"


def _coordinates(s, d):
    share = lambda o: F.round(F.avg(F.when(F.col("option") == o, 1.0).otherwise(0.0)), 6)
    return votes(s, d).groupBy("voter_id", "leg").agg(F.min("grp").alias("party"), share("a_favor").alias("d1"), share("en_contra").alias("d2"))


query("party_paths", COORD + ", c as (select party, leg, avg(d1) as c1, avg(d2) as c2 from co group by 1,2) select party, count(*) as n_terms, round(arg_max(c1,leg)-arg_min(c1,leg),5) as move_1, round(arg_max(c2,leg)-arg_min(c2,leg),5) as move_2 from c group by 1 having count(*)>=3")(lambda s, d: co.party_paths(_coordinates(s, d), 3))
query("voter_paths", COORD + ", n as (select voter_id, party, count(*) as n from co group by 1,2), m as (select voter_id, sum(n) as n_terms, arg_min(party, -n*1000+party) as party from n group by 1 having sum(n)>=2) select voter_id, cast(n_terms as bigint) as n_terms, party from m order by n_terms desc, voter_id limit 100")(lambda s, d: co.voter_paths(_coordinates(s, d), 100))
query("chamber_centroids", COORD + """, x as (select c.*, case when voter_id%2=0 then 'S' else 'D' end as side from co c), g as (select side, party, count(*) as n, avg(d1) as m1, avg(d2) as m2, stddev_pop(d1) as s1, stddev_pop(d2) as s2 from x group by 1,2 having count(*)>=3)
 select a.party, a.n as n_left, b.n as n_right, round(a.s1,5) as sd_left, round(b.s1,5) as sd_right, round(sqrt((a.m1-b.m1)*(a.m1-b.m1)+(a.m2-b.m2)*(a.m2-b.m2)),5) as distance from g a join g b on a.party=b.party and a.side='S' and b.side='D'""")(lambda s, d: (lambda c: co.compared_centroids(c.filter("voter_id % 2 = 0"), c.filter("voter_id % 2 = 1"), 3))(_coordinates(s, d)))
query("compared_terms", " select a.leg, a.n as n_left, b.n as n_right, b.n-a.n as delta from (select leg, count(distinct vote_event_id) as n from votes where chamber='D' group by 1) a join (select leg, count(distinct vote_event_id) as n from votes where chamber='S' group by 1) b using (leg)")(lambda s, d: (lambda n: co.side_by_side(n("D"), n("S"), ["leg"], "n"))(lambda c: votes(s, d).filter(F.col("chamber") == c).groupBy("leg").agg(F.countDistinct("vote_event_id").alias("n"))))
query("parties_in_order", " select grp, row_number() over (order by case grp when 3 then 0 when 0 then 1 when 1 then 2 else 9 end, grp) as place from (select distinct grp from votes)")(lambda s, d: co.in_order(votes(s, d).select("grp").distinct(), "grp", [3, 0, 1]))
