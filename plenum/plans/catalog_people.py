"""Panels, statistics and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import panel as pa
from plenum.operators import power as pw
from plenum.operators import stats as st
from plenum.operators import tally as ta
from plenum.operators import windows as wi

from .base import query
from .catalog import EMPIRICAL_BY_TERM, SEATS, TALLY
from .views import VOTES_SQL, table, votes


def attributes(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("voter_id"), F.when(k % 2 == 0, "F").otherwise("M").alias("genero"), F.when(k % 3 == 0, "plurinominal").when(k % 3 == 1, "mayoria_relativa").alias("curul_tipo"))


DISC = """#
 mo as (select vote_event_id, grp, option as modal from (select vote_event_id, grp, option, row_number() over (partition by vote_event_id, grp order by count(*) desc, option) as r from votes group by 1,2,3) where r=1),
 disc as (select v.voter_id, v.leg, v.grp, count(*) as n_votes, round(avg(case when v.option=mo.modal then 1.0 else 0.0 end),4) as discipline from votes v join mo on mo.vote_event_id=v.vote_event_id and mo.grp=v.grp group by 1,2,3 having count(*)>=3),
 attr as (select s_suppkey as voter_id, case when s_suppkey%2=0 then 'F' else 'M' end as genero, case when s_suppkey%3=0 then 'plurinominal' when s_suppkey%3=1 then 'mayoria_relativa' end as curul_tipo from supplier),
 pan as (select p.*, genero, curul_tipo from (select *, row_number() over (partition by voter_id, leg order by n_votes desc, grp) as rn from disc) p left join attr using (voter_id) where rn=1)"""


def disc(s, d):
    return pa.discipline(votes(s, d), 3)


def pan(s, d):
    return pa.panel(disc(s, d), attributes(s, d))


def gp(keys, least=1):
    k = ", ".join(keys)
    return DISC + f" select {k}, count(distinct voter_id) as n_persons, round(avg(discipline),6) as mean_discipline, round(coalesce(stddev_samp(discipline),0),6) as sd_discipline, cast(sum(n_votes) as bigint) as votes from pan group by {k} having count(distinct voter_id)>={least}"


query("modal_option", DISC + " select * from mo")(lambda s, d: pa.modal_option(votes(s, d)))
query("discipline", DISC + " select * from disc")(disc)
query("panel", DISC + " select voter_id, leg, grp, n_votes, discipline, genero, curul_tipo from pan")(pan)
query("party_panel", gp(["leg", "grp"]))(lambda s, d: pa.group_panel(pan(s, d), ["leg", "grp"]))
query("gender_panel", gp(["leg", "grp", "genero"], 2))(lambda s, d: pa.group_panel(pan(s, d), ["leg", "grp", "genero"], 2))
query("seat_type_panel", gp(["leg", "curul_tipo"], 2))(lambda s, d: pa.group_panel(pan(s, d), ["leg", "curul_tipo"], 2))
query("events_per_term", " select leg, count(distinct vote_event_id) as n_events from votes group by 1")(lambda s, d: votes(s, d).groupBy("leg").agg(F.countDistinct("vote_event_id").alias("n_events")))
SHARES = DISC + ", sh as (select leg, count(*) filter (genero='F') as n_f, count(*) filter (genero='M') as n_m, round(count(*) filter (genero='F')/count(*),6) as share_f, round(avg(discipline) filter (genero='F')-avg(discipline) filter (genero='M'),6) as gap from pan group by 1)"
query("feminisation", SHARES + " select * from sh")(lambda s, d: pa.shares(pan(s, d)))
query("gender_covoting", DISC + ", e as (select leg, vote_event_id, avg(case when option='a_favor' then 1.0 else 0.0 end) filter (genero='F') as f, avg(case when option='a_favor' then 1.0 else 0.0 end) filter (genero='M') as m from votes join attr using (voter_id) where option in ('a_favor','en_contra') group by 1,2) select leg, count(*) as n_events, round(avg(1-abs(f-m)),6) as agreement from e where f is not null and m is not null group by 1")(lambda s, d: pa.group_covoting(votes(s, d), attributes(s, d)))
query("attribute_coverage", DISC + " select leg, count(*) as total, count(curul_tipo) as known, round(100.0*count(curul_tipo)/count(*),2) as share from (select distinct leg, voter_id from votes) left join attr using (voter_id) group by 1")(lambda s, d: pa.coverage(votes(s, d), attributes(s, d), "curul_tipo"))


def terms_as_types(s, d):
    return pan(s, d).withColumn("kind", F.when(F.col("leg") % 2 == 0, "even").otherwise("odd"))


WITHIN = DISC + ", wp as (select voter_id, avg(discipline) filter (leg%2=0) as a, avg(discipline) filter (leg%2=1) as b from pan group by 1), wi as (select voter_id, round(a,6) as d_one, round(b,6) as d_two, round(b-a,6) as delta from wp where a is not null and b is not null)"
query("within_person", WITHIN + " select * from wi")(lambda s, d: pa.within_person(terms_as_types(s, d), "kind", "even", "odd"))
query("wilcoxon_within_person", WITHIN + """, z as (select abs(delta) as x, delta>0 as up, delta as v from wi where delta<>0), r as (select *, rank() over (order by x) + (count(*) over (partition by x)-1)/2.0 as k from z),
 t as (select sum(c*c*c-c) as ties from (select count(*) as c from z group by x)), g as (select count(*) as n, round(avg(v),6) as mean_delta, coalesce(sum(k) filter (up),0.0) as w_plus, coalesce(sum(k) filter (not up),0.0) as w_minus from r)
 select n, mean_delta, cast(w_plus as double) as w_plus, cast(w_minus as double) as w_minus, round((w_plus-n*(n+1)/4.0)/sqrt(n*(n+1)*(2*n+1)/24.0-ties/48.0),5) as z from g, t""")(lambda s, d: st.wilcoxon(pa.within_person(terms_as_types(s, d), "kind", "even", "odd"), "delta"))
query("trajectories", DISC + """, st as (select *, abs(discipline-lag(discipline) over (partition by voter_id order by leg)) as step from pan)
 select voter_id, count(*) as n_terms, array_to_string(list_sort(list(distinct leg)),';') as terms, array_to_string(list_sort(list(distinct grp)),';') as parties, arg_min(discipline,leg) as first, arg_max(discipline,leg) as last, round(avg(step),6) as mean_step, count(distinct grp)>1 as switcher from st group by 1 having count(*)>=2""")(lambda s, d: pa.trajectories(pan(s, d)))
query("switches", DISC + " select * from (select voter_id, leg, lag(grp) over w as from_grp, grp as to_grp, round(discipline-lag(discipline) over w,6) as delta from pan window w as (partition by voter_id order by leg)) where from_grp<>to_grp")(lambda s, d: pa.switches(pan(s, d)))
query("dealignment", DISC + ", g as (select grp, leg, avg(discipline) as d from pan group by 1,2), o as (select *, row_number() over (partition by grp order by leg)-1 as i from g) select grp, count(*) as n_terms, round(regr_slope(d,i),6) as slope, round(arg_min(d,leg),6) as first, round(arg_max(d,leg),6) as last from o group by 1 having count(*)>=3")(lambda s, d: pa.party_slopes(pan(s, d)))
query("dominant_term", " select voter_id, leg, n from (select voter_id, leg, count(*) as n, row_number() over (partition by voter_id order by count(*) desc, leg) as r from votes group by 1,2) where r=1")(lambda s, d: pa.dominant_term(votes(s, d)))
query("discipline_by_term_wide", DISC + " select grp, " + ", ".join(f"round(avg(discipline) filter (leg={t}),6) as t{t}" for t in range(7)) + " from pan group by 1")(lambda s, d: pa.wide(pan(s, d), list(range(7))))
query("top_parties", DISC + " select grp, count(*) as n from pan group by 1 order by n desc, grp limit 3")(lambda s, d: pan(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grp").limit(3))
query("all_types_seen", DISC + " select voter_id from pan group by 1 having count(distinct leg%3)=3")(lambda s, d: pan(s, d).groupBy("voter_id").agg(F.collect_set((F.col("leg") % 3).cast("int")).alias("k")).filter(F.size(F.array_except(F.array(F.lit(0), F.lit(1), F.lit(2)), "k")) == 0).select("voter_id"))
query("gender_gap_welch", DISC + """, g as (select leg, count(*) filter (genero='F') as n_a, count(*) filter (genero='M') as n_b, avg(discipline) filter (genero='F') as ma, avg(discipline) filter (genero='M') as mb, var_samp(discipline) filter (genero='F') as va, var_samp(discipline) filter (genero='M') as vb from pan group by 1)
 select leg, n_a, n_b, round(ma-mb,6) as gap, round((ma-mb)/sqrt(va/n_a+vb/n_b),5) as t, round(power(va/n_a+vb/n_b,2)/((va/n_a)*(va/n_a)/(n_a-1)+(vb/n_b)*(vb/n_b)/(n_b-1)),4) as df, round((ma-mb)/sqrt((va+vb)/2),5) as cohen_d from g where n_a>=2 and n_b>=2""")(lambda s, d: st.welch(pan(s, d), ["leg"], "genero", "F", "M", "discipline", 2))
query("gender_gap_mann_whitney", DISC + """, x as (select leg, genero, discipline as v from pan), r as (select *, rank() over (partition by leg order by v)+(count(*) over (partition by leg, v)-1)/2.0 as k from x),
 t as (select leg, sum(c*c*c-c) as ties from (select leg, v, count(*) as c from x group by 1,2) group by 1), g as (select leg, count(*) filter (genero='F') as n_a, count(*) filter (genero='M') as n_b, sum(k) filter (genero='F') as ra from r group by 1)
 select leg, n_a, n_b, round(cast(ra-n_a*(n_a+1)/2 as double),2) as u, round((ra-n_a*(n_a+1)/2-n_a*n_b/2.0)/sqrt(n_a*n_b/12.0*((n_a+n_b+1)-ties/((n_a+n_b)*(n_a+n_b-1)))),5) as z from g join t using (leg) where n_a>0 and n_b>0""")(lambda s, d: st.mann_whitney(pan(s, d), ["leg"], "genero", "F", "M", "discipline"))


def _p_values(s, d):
    w = st.welch(pan(s, d), ["leg"], "genero", "F", "M", "discipline", 2)
    return w.select("leg", "t", "df", F.round(st.p_of_t("t", "df"), 6).alias("p"), (st.p_of_t("t", "df") < 0.05).alias("significant"))


query("gender_gap_p")(_p_values)
query("share_gap_spearman", SHARES + ", r as (select rank() over (order by share_f)+(count(*) over (partition by share_f)-1)/2.0 as rx, rank() over (order by gap)+(count(*) over (partition by gap)-1)/2.0 as ry from sh where gap is not null) select count(*) as n, case when count(*)>=3 then round(case when stddev_samp(rx)>0 and stddev_samp(ry)>0 then corr(rx,ry) end,6) end as rho from r")(lambda s, d: st.spearman(pa.shares(pan(s, d)), "share_f", "gap"))
query("ellipse", DISC + ", p as (select grp, discipline as x, cast(n_votes as double) as y from pan), g as (select grp, count(*) as n, avg(x) as mx, avg(y) as my, stddev_samp(x) as sx, stddev_samp(y) as sy, case when stddev_samp(x)>0 and stddev_samp(y)>0 then corr(x,y) end as r from p group by 1 having count(*)>=3) select grp, n, round(mx,6) as cx, round(my,6) as cy, round(r,6) as pearson, round(sqrt(1+r)*sx,6) as radius_x, round(sqrt(1-r)*sy,6) as radius_y from g")(lambda s, d: st.ellipse(pan(s, d).withColumn("y", F.col("n_votes").cast("double")), ["grp"], "discipline", "y"))


def _weighted(s, d):
    v = votes(s, d)
    return pa.weighted_power(pw.seats_by_headcount(v, ("leg",)), ta.empirical_power(v, ("leg",)).select("leg", "grp", "power"))


query("weighted_power", EMPIRICAL_BY_TERM + ", " + SEATS.lstrip("#\n ") + " select grp, cast(sum(seats) as bigint) as seats, round(sum(power*seats)/sum(seats),6) as power from seats join em using (leg, grp) group by 1")(_weighted)


def _chambers(s, d):
    """Discipline by party and term in both chambers, and the senate's difference."""
    v = votes(s, d)
    x = v.join(pa.modal_option(v), ["vote_event_id", "grp"]).groupBy("grp", "leg").pivot("chamber", ["S", "D"]).agg(F.round(F.avg((F.col("option") == F.col("modal")).cast("double")), 6)).dropna()
    return x.select("grp", "leg", F.col("S").alias("senate"), F.col("D").alias("deputies"), F.round(F.col("S") - F.col("D"), 6).alias("delta"))


query("chambers_discipline", DISC + ", x as (select v.grp, leg, round(avg(case when option=modal then 1.0 else 0.0 end) filter (chamber='S'),6) as senate, round(avg(case when option=modal then 1.0 else 0.0 end) filter (chamber='D'),6) as deputies from votes v join mo on mo.vote_event_id=v.vote_event_id and mo.grp=v.grp group by 1,2) select *, round(senate-deputies,6) as delta from x where senate is not null and deputies is not null")(_chambers)
query("chambers_correlation", DISC + ", x as (select v.grp, leg, round(avg(case when option=modal then 1.0 else 0.0 end) filter (chamber='S'),6) as a, round(avg(case when option=modal then 1.0 else 0.0 end) filter (chamber='D'),6) as b from votes v join mo on mo.vote_event_id=v.vote_event_id and mo.grp=v.grp group by 1,2) select count(*) as n, round(corr(a,b),6) as r from x where a is not null and b is not null")(lambda s, d: _chambers(s, d).agg(F.count(F.lit(1)).alias("n"), F.round(st.correlation("senate", "deputies"), 6).alias("r")))


def _criticals_of_chambers(s, d):
    v = votes(s, d)
    c = ta.critical_parties(v).filter("critical").select("vote_event_id", "grp").join(v.select("vote_event_id", "chamber").distinct(), "vote_event_id")
    one = lambda k, n: c.filter(F.col("chamber") == k).groupBy("grp").agg(F.count(F.lit(1)).alias(n))
    j = one("S", "n_s").join(one("D", "n_d"), "grp", "full").na.fill(0)
    return j.withColumn("ratio", F.when(F.col("n_d") > 0, F.round(F.col("n_s") / F.col("n_d"), 6)))


query("chambers_criticals", TALLY + ", k as (select distinct vote_event_id, chamber from votes) select grp, count(*) filter (chamber='S') as n_s, count(*) filter (chamber='D') as n_d, round(count(*) filter (chamber='S')/nullif(count(*) filter (chamber='D'),0),6) as ratio from crit join k using (vote_event_id) where critical group by 1")(_criticals_of_chambers)

# --- windows -------------------------------------------------------------------

EV = "# ev as (select vote_event_id, min(leg) as leg, min(start_date) as start_date, min(chamber) as chamber from votes group by 1)"
query("windows_by_term", EV + " select leg as window_id, min(start_date) as first, max(start_date) as last, count(*) as n_events from ev group by 1")(lambda s, d: wi.windows_of(wi.build(wi.events(votes(s, d)), "legislatura")))
query("windows_by_biennium", EV + " select cast(year(start_date)-year(start_date)%2 as bigint) as window_id, min(start_date) as first, max(start_date) as last, count(*) as n_events from ev where chamber='D' and leg not in (6) group by 1")(lambda s, d: wi.windows_of(wi.build(wi.events(votes(s, d)), "biennium", "D", (6,))))
query("sliding_windows", EV + ", i as (select *, row_number() over (partition by leg order by start_date, vote_event_id)-1 as i from ev), k as (select *, unnest(range(cast(greatest(ceil((i-20+1)/15),0) as bigint), i//15+1)) as k from i) select leg||'/'||k as window_id, min(start_date) as first, max(start_date) as last, count(*) as n_events from k group by 1")(lambda s, d: wi.windows_of(wi.build(wi.events(votes(s, d)), "sliding", size=20, overlap=5)))
MERGED = VOTES_SQL.replace("with v0", "with recursive v0", 1) + """, ev as (select vote_event_id, min(leg) as leg, min(start_date) as start_date from votes group by 1),
i as (select *, row_number() over (partition by leg order by start_date, vote_event_id)-1 as i from ev), k as (select *, unnest(range(cast(greatest(ceil((i-20+1)/15),0) as bigint), i//15+1)) as k from i), b as (select leg||'/'||k as window_id, * from k),
o as (select window_id, count(*) as n, row_number() over (order by min(start_date), window_id) as j from b group by 1),
r as (select j, n as acc, 1 as g from o where j=1 union all select o.j, case when r.acc>=30 then o.n else r.acc+o.n end, case when r.acc>=30 then r.g+1 else r.g end from r join o on o.j=r.j+1),
t as (select max(g) as top, arg_max(acc, j) as rest from r), m as (select j, case when g=top and rest<30 and top>1 then g-1 else g end as g from r, t),
l as (select g, left(string_agg(window_id, '+' order by j), 80) as merged from m join o using (j) group by 1), n as (select window_id, merged from m join o using (j) join l using (g))
select merged as window_id, min(start_date) as first, max(start_date) as last, count(distinct vote_event_id) as n_events from b join n using (window_id) group by 1"""
query("merged_windows", MERGED, view=False)(lambda s, d: wi.windows_of(wi.merge_small(wi.build(wi.events(votes(s, d)), "sliding", size=20, overlap=5), 30)))
query("merged_terms", EV + " select cast(year(start_date)-year(start_date)%2 as bigint) as window_id, array_to_string(list_sort(list(distinct leg)),'+') as terms from ev group by 1")(lambda s, d: wi.by_biennium(wi.events(votes(s, d))).groupBy("window_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("leg")), lambda x: x.cast("string")), "+").alias("terms")))
