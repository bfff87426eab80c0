"""Queries of the roll-call operators over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import agreement as ag
from plenum.operators import power as pw
from plenum.operators import tally as ta

from .base import QUERIES, SQL, query  # noqa: F401
from .views import votes

EDGES = """#
 att as (select *, case when option='a_favor' then 0 when option='en_contra' then 1 else 2 end as x from votes where option <> 'ausente'),
 agr as (select p.voter_id as a, q.voter_id as b, count(*) as n_shared, cast(sum(case when p.x=q.x then 1 else 0 end) as bigint) as n_agree from att p join att q on p.vote_event_id=q.vote_event_id and p.voter_id<q.voter_id group by 1,2),
 edges as (select *, n_agree / n_shared as weight from agr where n_agree > 0),
 pc as (select voter_id, grp, count(*) as n from votes group by 1,2),
 party as (select voter_id, grp as party from (select *, row_number() over (partition by voter_id order by n desc, grp) as r from pc) where r = 1),
 pe as (select e.*, p.party as party_a, q.party as party_b from edges e join party p on p.voter_id=a join party q on q.voter_id=b)"""
LEG_EDGES = """#
 att as (select *, case when option='a_favor' then 0 when option='en_contra' then 1 else 2 end as x from votes where option <> 'ausente'),
 agr as (select p.leg, p.voter_id as a, q.voter_id as b, count(*) as n_shared, cast(sum(case when p.x=q.x then 1 else 0 end) as bigint) as n_agree from att p join att q on p.vote_event_id=q.vote_event_id and p.voter_id<q.voter_id group by 1,2,3),
 edges as (select *, n_agree / n_shared as weight from agr where n_agree > 0),
 pc as (select leg, voter_id, grp, count(*) as n from votes group by 1,2,3),
 party as (select leg, voter_id, grp as party from (select *, row_number() over (partition by leg, voter_id order by n desc, grp) as r from pc) where r = 1),
 pe as (select e.*, p.party as party_a, q.party as party_b from edges e join party p on p.voter_id=a and p.leg=e.leg join party q on q.voter_id=b and q.leg=e.leg)"""
TALLY = """#
 bp as (select vote_event_id, requirement, grp, count(*) filter (option='a_favor') as a_favor, count(*) filter (option='en_contra') as en_contra, count(*) filter (option='abstencion') as abstencion, count(*) filter (option='ausente') as ausente, count(*) filter (option<>'ausente') as attending from votes group by 1,2,3),
 be0 as (select vote_event_id, requirement, cast(sum(a_favor) as bigint) as a_favor, cast(sum(en_contra) as bigint) as en_contra, cast(sum(abstencion) as bigint) as abstencion, cast(sum(ausente) as bigint) as ausente, cast(sum(a_favor+en_contra+abstencion+ausente) as bigint) as seats, cast(sum(attending) as bigint) as attending from bp group by 1,2),
 be1 as (select *, case when requirement='mayoria_calificada' then case when attending>0 and 3*a_favor>=2*attending then 'aprobada' else 'rechazada' end when attending=0 then 'rechazada' when a_favor>en_contra then 'aprobada' when a_favor<en_contra then 'rechazada' else 'empate' end as result,
   cast(case when requirement='mayoria_calificada' then (2*seats+2)//3 else (attending+1)//2 end as bigint) as needed from be0),
 be as (select *, case when result='aprobada' then a_favor else en_contra end - needed as margin from be1),
 pos as (select vote_event_id, grp, case when attending=0 then 'ausente' when 2*a_favor>attending then 'a_favor' when 2*en_contra>attending then 'en_contra' else 'dividido' end as position from bp),
 cr0 as (select bp.vote_event_id, bp.requirement, result, grp, case when result='aprobada' then bp.a_favor else bp.en_contra end as side, needed from bp join be using (vote_event_id)),
 cr as (select *, cast(sum(side) over (partition by vote_event_id) as bigint) as total from cr0),
 crit as (select vote_event_id, requirement, result, grp, side, total, needed, side>0 and total>=needed and total-side<needed as critical from cr)"""

# --- agreement ---------------------------------------------------------------

query("party_agreement", EDGES + " select least(party_a,party_b) as p, greatest(party_a,party_b) as q, count(*) as n_edges, round(avg(weight),6) as mean_weight from pe group by 1,2")(lambda s, d: ag.party_agreement(votes(s, d)))
query("primary_party", EDGES + " select voter_id, party from party")(lambda s, d: ag.primary_party(votes(s, d)))
query("agreement_edges", EDGES + " select a, b, n_shared, n_agree, round(weight,6) as weight from edges")(lambda s, d: ag.edges(votes(s, d)).withColumn("weight", F.round("weight", 6)))
query("party_matrix", EDGES + ", m as (select least(party_a,party_b) as p, greatest(party_a,party_b) as q, round(avg(weight),6) as w from pe group by 1,2), b as (select p,q,w from m union all select q,p,w from m where p<>q) select p as party, " + ", ".join(f"coalesce(max(case when q={k} then w end),0) as with_{k}" for k in range(5)) + " from b group by 1")(lambda s, d: ag.party_matrix(votes(s, d), list(range(5))))
query("party_graph", EDGES + ", m as (select least(party_a,party_b) as p, greatest(party_a,party_b) as q, round(avg(weight),6) as mean_weight from pe where party_a<>party_b group by 1,2) select *, case when (select max(mean_weight) from m)>(select min(mean_weight) from m) then round((mean_weight-(select min(mean_weight) from m))/((select max(mean_weight) from m)-(select min(mean_weight) from m)),5) else 0.5 end as scaled from m")(lambda s, d: ag.party_graph(votes(s, d)))
query("graph_size", EDGES + " select n_nodes, n_edges, round(2.0*n_edges/(n_nodes*(n_nodes-1)),6) as density, w as mean_weight from (select count(distinct voter_id) as n_nodes from votes), (select count(*) as n_edges, round(avg(weight),6) as w from edges)")(lambda s, d: ag.graph_size(votes(s, d)))
query("graph_size_by_term", LEG_EDGES + " select n.leg, n_nodes, n_edges, round(2.0*n_edges/(n_nodes*(n_nodes-1)),6) as density, w as mean_weight from (select leg, count(distinct voter_id) as n_nodes from votes group by 1) n join (select leg, count(*) as n_edges, round(avg(weight),6) as w from edges group by 1) using (leg)")(lambda s, d: ag.graph_size(votes(s, d), ("leg",)))
query("party_agreement_by_term", LEG_EDGES + " select leg, least(party_a,party_b) as p, greatest(party_a,party_b) as q, count(*) as n_edges, round(avg(weight),6) as mean_weight from pe group by 1,2,3")(lambda s, d: ag.party_agreement(votes(s, d), ("leg",)))
query("degree_centrality", EDGES + ", s as (select v as voter_id, round(sum(weight),6) as strength from (select a as v, weight from edges union all select b, weight from edges) group by 1) select voter_id, strength, round(strength/(select max(strength) from s),6) as centrality from s")(lambda s, d: ag.degree(ag.edges(votes(s, d))))
query("backbone", EDGES + " select count(*) as n_edges, round(min(weight),6) as least_weight from edges where weight >= (select quantile_cont(weight,0.75) from edges)")(lambda s, d: ag.backbone(ag.edges(votes(s, d))).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.min("weight"), 6).alias("least_weight")))
query("weight_histogram", EDGES + " select cast(least(floor(weight*20),19) as bigint) as bin, count(*) as n from edges group by 1")(lambda s, d: ag.weight_histogram(ag.edges(votes(s, d))))
query("cross_party_top", EDGES + " select a, b, party_a, party_b, n_shared, round(weight,6) as weight from pe where party_a<>party_b order by weight desc, a, b limit 20")(lambda s, d: ag.cross_party_top(votes(s, d)))
query("same_party_bottom", EDGES + " select a, b, party_a, n_shared, round(weight,6) as weight from pe where party_a=party_b order by weight, a, b limit 20")(lambda s, d: ag.same_party_bottom(votes(s, d)))
ENDS = ", ends as (select a as voter_id, party_a as party, party_a=party_b as own, weight {0} from pe union all select b, party_b, party_a=party_b, weight {0} from pe)"
query("voter_means", EDGES + ENDS.format("") + " select voter_id, party, round(avg(weight) filter (own),6) as intra, round(avg(weight) filter (not own),6) as inter from ends group by 1,2")(lambda s, d: ag.voter_means(votes(s, d)))
query("dissidents_by_term", LEG_EDGES + ENDS.format(", leg") + ", m as (select leg, voter_id, party, coalesce(round(avg(weight) filter (own),6),0) as intra from ends group by 1,2,3) select leg, rank, voter_id, party, intra from (select *, row_number() over (partition by leg order by intra, voter_id) as rank from m) where rank<=3")(lambda s, d: ag.dissidents(votes(s, d), ("leg",)))


def _party_parts(s, d):
    return ag.primary_party(votes(s, d)).select("voter_id", F.col("party").alias("part"))


query("party_modularity", EDGES + ", per as (select part, sum(weight) as degree, sum(own) as own from (select party_a as part, weight, case when party_a=party_b then weight/2 else 0 end as own from pe union all select party_b, weight, case when party_a=party_b then weight/2 else 0 end from pe) group by 1) select round(sum(own/m - power(degree/(2*m),2)),6) as modularity from per, (select sum(degree)/2 as m from per)")(lambda s, d: ag.modularity(ag.edges(votes(s, d)), _party_parts(s, d)))
query("coalition_frontier", EDGES + ", t as (select party as top from party group by 1 order by count(*) desc, 1 limit 1) select count(*) as n_edges, round(avg(weight),6) as frontier from pe, t where (party_a=top)<>(party_b=top)")(lambda s, d: ag.frontier(ag.edges(votes(s, d)), _party_parts(s, d)))


def _stability(s, d):
    p = ag.primary_party(votes(s, d), ("leg",)).withColumnRenamed("party", "part")
    return ag.adjusted_rand(p, p.withColumn("leg", F.col("leg") - 1), ("leg",))


query("partition_stability", LEG_EDGES + """, b as (select p.leg, p.voter_id, p.party as p, q.party as q from party p join party q on q.voter_id=p.voter_id and q.leg=p.leg+1),
 c as (select leg,p,q,count(*) as n from b group by 1,2,3), s as (select leg,sum(n) as n,sum(n*(n-1)/2) as bo from c group by 1),
 r as (select leg,sum(n*(n-1)/2) as ro from (select leg,p,sum(n) as n from c group by 1,2) group by 1), k as (select leg,sum(n*(n-1)/2) as co from (select leg,q,sum(n) as n from c group by 1,2) group by 1)
 select leg, cast(n as bigint) as n_common, round(case when n<2 then 0 when (ro+co)/2=ro*co/(n*(n-1)/2) then 1 else greatest(least((bo-ro*co/(n*(n-1)/2))/((ro+co)/2-ro*co/(n*(n-1)/2)),1),-1) end,4) as ari from s join r using(leg) join k using(leg)""")(_stability)


def _composition(s, d):
    v = votes(s, d)
    parts = v.groupBy("voter_id").agg((F.max("grp") % 2).alias("part"))
    return ag.composition(parts, ag.primary_party(v))


query("community_composition", EDGES + ", pt as (select voter_id, max(grp)%2 as part from votes group by 1), n as (select part, party, count(*) as n from pt join party using (voter_id) group by 1,2) select part, cast(sum(n) as bigint) as size, arg_min(party, (-n, party)) as dominant, round(max(n)/sum(n),6) as purity from n group by 1")(_composition)

# --- tallies -------------------------------------------------------------------

query("party_tally", TALLY + " select * from bp")(lambda s, d: ta.by_party(votes(s, d)))
query("event_outcome", TALLY + " select * from be")(lambda s, d: ta.by_event(votes(s, d)))
SENATE = "select vote_event_id, case when requirement='mayoria_calificada' and abstencion>0 then case when attending>0 and 3*a_favor>=2*attending then 'aprobada' else 'rechazada' end when attending=0 then 'rechazada' when a_favor>en_contra then 'aprobada' when a_favor<en_contra then 'rechazada' else 'empate' end as result from be0"
query("event_outcome_senate", TALLY + " " + SENATE)(lambda s, d: ta.by_event(votes(s, d), True).select("vote_event_id", "result"))
query("party_position", TALLY + " select * from pos")(lambda s, d: ta.positions(votes(s, d)))
query("critical_parties", TALLY + " select * from crit")(lambda s, d: ta.critical_parties(votes(s, d)))
query("empirical_power", TALLY + " select grp, count(*) filter (critical) as n_critical, n_events, round(100.0*count(*) filter (critical)/n_events,4) as power from crit, (select count(distinct vote_event_id) as n_events from crit) group by grp, n_events")(lambda s, d: ta.empirical_power(votes(s, d)))
EMPIRICAL_BY_TERM = TALLY + ", k as (select distinct vote_event_id, leg from votes), c as (select * from crit join k using (vote_event_id)), e as (select leg, count(distinct vote_event_id) as n_events from c group by 1), em as (select c.leg, grp, count(*) filter (critical) as n_critical, n_events, round(100.0*count(*) filter (critical)/n_events,4) as power from c join e using (leg) group by c.leg, grp, n_events)"
query("empirical_power_by_term", EMPIRICAL_BY_TERM + " select * from em")(lambda s, d: ta.empirical_power(votes(s, d), ("leg",)))
query("running_power", TALLY + ", w as (select vote_event_id, min(start_date) as sd from votes group by 1), g as (select p.grp, w.vote_event_id, sd, case when critical then 1.0 else 0 end as hit from (select distinct grp from votes) p cross join w left join crit c on c.vote_event_id=w.vote_event_id and c.grp=p.grp) select grp, vote_event_id, row_number() over (partition by grp order by sd, vote_event_id) as seq, round(avg(hit) over (partition by grp order by sd, vote_event_id rows unbounded preceding),6) as running from g")(lambda s, d: ta.running_power(votes(s, d)))
DETAIL = TALLY + ", cl as (select vote_event_id, array_to_string(list_sort(list(cast(grp as varchar))),'|') as critical_parties, count(*) as critical_count from crit where critical group by 1), det as (select be.*, coalesce(critical_parties,'') as critical_parties, coalesce(critical_count,0) as critical_count from be left join cl using (vote_event_id))"
query("vote_detail", DETAIL + " select * from det")(lambda s, d: ta.vote_detail(votes(s, d)))
query("qualified_criticals", DETAIL + " select grp, count(*) as n from (select unnest(string_split(critical_parties,'|')) as grp from det where requirement='mayoria_calificada' and critical_parties<>'') group by 1")(lambda s, d: ta.listed_criticals(ta.vote_detail(votes(s, d))))
query("close_votes", TALLY + " select * from be where abs(a_favor-en_contra)<3")(lambda s, d: ta.close_votes(votes(s, d), 3))
query("swing_voters", TALLY + " select v.vote_event_id, v.voter_id, v.grp, v.option, p.position, coalesce(v.option = (case when result='aprobada' then 'a_favor' when result='rechazada' then 'en_contra' end) and (case when result='aprobada' then a_favor else en_contra end)-1<needed, false) as could_flip from votes v join be using (vote_event_id) join pos p on p.vote_event_id=v.vote_event_id and p.grp=v.grp where v.option<>'ausente' and p.position in ('a_favor','en_contra') and v.option<>p.position and abs(a_favor-en_contra)<10")(lambda s, d: ta.swing_voters(votes(s, d)))
query("top_dissenters", TALLY + " select voter_id, count(*) as n_votes, count(*) filter (v.option<>p.position) as n_dissent, round(count(*) filter (v.option<>p.position)/count(*),6) as rate from votes v join pos p on p.vote_event_id=v.vote_event_id and p.grp=v.grp where v.option in ('a_favor','en_contra') and p.position in ('a_favor','en_contra') group by 1 having count(*)>=10 order by rate desc, n_dissent desc, voter_id limit 10")(lambda s, d: ta.dissenters(votes(s, d)))
query("heat_states", TALLY + " select e.vote_event_id, g.grp, cast(case position when 'a_favor' then 2 when 'en_contra' then 1 when 'dividido' then -1 else 0 end as bigint) as state from (select distinct vote_event_id from votes) e cross join (select distinct grp from votes) g left join pos on pos.vote_event_id=e.vote_event_id and pos.grp=g.grp")(lambda s, d: ta.heat_states(votes(s, d)))
query("grouped_counts", " select vote_event_id, option, grp, count(*) as n from votes group by 1,2,3 union all select vote_event_id, option, null, count(*) from votes group by 1,2")(lambda s, d: ta.grouped_counts(votes(s, d)))

# --- power ---------------------------------------------------------------------

SEATS = """#
 seats as (select leg, grp, max(n) as seats from (select leg, vote_event_id, grp, count(*) as n from votes group by 1,2,3) group by 1,2),
 tot as (select leg, cast(sum(seats) as bigint) as total from seats group by 1),
 quo as (select leg, total, 'simple' as quota_kind, total//2+1 as quota from tot union all select leg, total, 'two_thirds', (2*total+2)//3 from tot union all select leg, total, 'three_quarters', (3*total+3)//4 from tot)"""
query("seats_by_headcount", SEATS + " select * from seats")(lambda s, d: pw.seats_by_headcount(votes(s, d), ("leg",)))
query("seats_by_member", " select grp, count(*) as seats from (select voter_id, grp, row_number() over (partition by voter_id order by count(*) desc, max(start_date) desc, grp) as rn from votes group by 1,2) where rn=1 group by 1")(lambda s, d: pw.seats_by_member(votes(s, d)))
query("total_seats", " select chamber, count(distinct voter_id) as seats from votes group by 1")(lambda s, d: votes(s, d).groupBy("chamber").agg(F.countDistinct("voter_id").alias("seats")))
query("quotas", SEATS + " select * from quo")(lambda s, d: pw.quotas(pw.seats_by_headcount(votes(s, d), ("leg",)), ("leg",)))
INDICES = SEATS + """, pl as (select leg, list(struct_pack(g := grp, s := seats) order by grp) as ps, count(*) as n from seats group by 1),
 mk as (select leg, quota_kind, quota, total, ps, n, m from pl join quo using (leg), unnest(range(0, cast(power(2, n) as bigint))) as u(m)),
 wt as (select *, list_sum(list_transform(ps, lambda x, i: case when (m & (1 << (i-1)))<>0 then x.s else 0 end)) as w, bit_count(m) as sz from mk),
 sw as (select leg, quota_kind, ps[i].g as grp, factorial(cast(sz as int))*factorial(cast(n-1-sz as int))/factorial(cast(n as int)) as worth from wt, unnest(range(1, n+1)) as u(i) where w<quota and (m & (1 << cast(i-1 as bigint)))=0 and w+ps[i].s>=quota),
 g as (select leg, quota_kind, grp, sum(worth) as ss, count(*) as swings from sw group by 1,2,3),
 j as (select q.leg, q.quota_kind, s.grp, seats, total, coalesce(ss,0) as ss, coalesce(swings,0) as swings from quo q join seats s using (leg) left join g on g.leg=q.leg and g.quota_kind=q.quota_kind and g.grp=s.grp),
 pi as (select leg, quota_kind, grp, seats, round(100.0*seats/total,2) as nominal, round(100.0*ss,2) as shapley, case when sum(swings) over w>0 then round(100.0*swings/sum(swings) over w,2) else 0.0 end as banzhaf from j window w as (partition by leg, quota_kind))"""
query("power_indices", INDICES + " select * from pi")(lambda s, d: pw.indices(pw.seats_by_headcount(votes(s, d), ("leg",)), ("leg",)))


def _coalitions(s, d):
    v = votes(s, d)
    c = v.select("grp").distinct().select(F.concat(F.lit("with_"), F.col("grp")).alias("name"), F.array("grp", (F.col("grp") + 1) % 5).alias("grps"))
    return pw.coalition_seats(pw.seats_by_headcount(v), c)


query("coalition_seats", """#
 se as (select grp, max(n) as seats from (select vote_event_id, grp, count(*) as n from votes group by 1,2) group by 1), t as (select cast(sum(seats) as bigint) as total from se),
 c as (select 'with_'||g.grp as name, unnest([g.grp,(g.grp+1)%5]) as grp from (select distinct grp from votes) g), x as (select name, cast(sum(coalesce(seats,0)) as bigint) as seats from c left join se using (grp) group by 1)
 select name, seats, round(100.0*seats/total,2) as share, seats>=total//2+1 as reaches_simple, seats>=(2*total+2)//3 as reaches_two_thirds, seats>=(3*total+3)//4 as reaches_three_quarters from x, t""")(_coalitions)


def _comparison(s, d):
    v = votes(s, d)
    i = pw.indices(pw.seats_by_headcount(v)).filter("quota_kind = 'simple'").drop("quota_kind")
    return i.join(ta.empirical_power(v).select("grp", "power"), "grp").withColumnRenamed("power", "empirical").orderBy(F.desc("seats"), "grp")


# all terms as one game
ALL_TERMS = INDICES.replace("select leg, vote_event_id, grp", "select 0 as leg, vote_event_id, grp").lstrip("#\n ")
query("power_comparison", TALLY + ", " + ALL_TERMS + ", em as (select grp, round(100.0*count(*) filter (critical)/(select count(distinct vote_event_id) from crit),4) as empirical from crit group by 1) select grp, seats, nominal, shapley, banzhaf, empirical from pi join em using (grp) where quota_kind='simple'")(_comparison)


def _power_by_term(s, d):
    v = votes(s, d)
    i = pw.indices(pw.seats_by_headcount(v, ("leg",)), ("leg",)).filter("quota_kind = 'simple'").drop("quota_kind")
    return i.join(ta.empirical_power(v, ("leg",)), ["leg", "grp"])


query("power_by_term", EMPIRICAL_BY_TERM + ", " + INDICES.lstrip("#\n ") + " select leg, grp, seats, nominal, shapley, banzhaf, n_critical, n_events, power from pi join em using (leg, grp) where quota_kind='simple'")(_power_by_term)

query("most_critical_parties", TALLY + " select grp, count(*) as n_critical from crit where critical group by 1 order by 2 desc, 1 limit 8")(lambda s, d: ta.most_critical(votes(s, d)))
query("vertex_centralities", EDGES + ", ends as (select a as v, weight from edges union all select b, weight from edges), s as (select v as voter_id, count(*) as n_neighbours, round(sum(weight),6) as strength from ends group by 1) select p.voter_id, p.party, coalesce(n_neighbours,0) as n_neighbours, coalesce(strength,0) as strength, coalesce(round(strength/(select max(strength) from s),6),0) as centrality from party p left join s using (voter_id)")(lambda s, d: ag.centralities(ag.edges(votes(s, d)), ag.primary_party(votes(s, d))))

from . import catalog_evolution, catalog_graph, catalog_pages, catalog_people, catalog_quality, catalog_repair, catalog_rules, catalog_text  # noqa: E402, F401
