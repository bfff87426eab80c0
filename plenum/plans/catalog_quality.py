"""Sources, filters, joins that resolve, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.operators import agreement as ag
from plenum.operators import graph as gr
from plenum.operators import quality as qu
from plenum.operators import resolve as re_
from plenum.operators import tally as ta

from .base import query
from .catalog import SENATE, TALLY
from .views import table, votes

# --- sources and filters ---------------------------------------------------------

query("filtered_events", " select distinct vote_event_id, start_date from votes where leg=3 and chamber='D' and start_date between date '2015-01-01' and date '2018-12-31'")(lambda s, d: votes(s, d).filter("leg = 3 and chamber = 'D' and start_date between date '2015-01-01' and date '2018-12-31'").select("vote_event_id", "start_date").distinct())
query("terms", " select distinct leg, chamber from votes")(lambda s, d: votes(s, d).select("leg", "chamber").distinct())
query("latest_full_term", " select chamber, max(leg) as leg from (select chamber, leg from votes group by 1,2 having count(*)>100) group by 1")(lambda s, d: votes(s, d).groupBy("chamber", "leg").agg(F.count(F.lit(1)).alias("n")).filter("n > 100").groupBy("chamber").agg(F.max("leg").alias("leg")))
query("table_counts", "select 'supplier' as name, count(*) as n from supplier union all select 'part', count(*) from part union all select 'nation', count(*) from nation", view=False)(lambda s, d: table(s, d, "supplier").agg(F.count(F.lit(1)).alias("n")).select(F.lit("supplier").alias("name"), "n").union(table(s, d, "part").agg(F.count(F.lit(1)).alias("n")).select(F.lit("part").alias("name"), "n")).union(table(s, d, "nation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nation").alias("name"), "n")))
query("catalogue_names", "select r_name, count(*) as n, string_agg(n_name, ', ' order by n_name) as names from nation join region on n_regionkey=r_regionkey group by 1", view=False)(lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names")))
query("longest_texts", "select doc_id, length(text) as n from documents order by n desc, doc_id limit 5", view=False)(lambda s, d: table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).orderBy(F.desc("n"), "doc_id").limit(5))


def _active(s, d):
    v = votes(s, d).filter("option <> 'ausente'")
    return v.groupBy("voter_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


query("active_voters", " select voter_id, count(*) as n from votes where option<>'ausente' group by 1 having count(*)>=10")(_active)


def _pruned(s, d):
    """Binary votes of events that are not lopsided, after two rounds of least participation; counts only."""
    b = votes(s, d).filter("option in ('a_favor', 'en_contra')").withColumn("y", (F.col("option") == "a_favor").cast("int"))
    ev = b.groupBy("vote_event_id").agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("n"))
    b = b.join(ev.filter(F.greatest("yes", F.col("n") - F.col("yes")) <= 0.975 * F.col("n")).select("vote_event_id"), "vote_event_id", "left_semi")
    b = gr.stored(b.select("leg", "voter_id", "vote_event_id", "y"))
    for _ in range(2):
        for key in ("voter_id", "vote_event_id"):
            enough = b.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select(key)
            b = gr.stored(b.join(enough, key, "left_semi"))
    return b.groupBy("leg").agg(F.countDistinct("voter_id").alias("n_voters"), F.countDistinct("vote_event_id").alias("n_events"), F.count(F.lit(1)).alias("n_votes"), F.sum("y").cast("long").alias("n_yes"))


query("pruned_matrix", """#
 b0 as (select *, case when option='a_favor' then 1 else 0 end as y from votes where option in ('a_favor','en_contra')),
 b1 as (select * from b0 where vote_event_id in (select vote_event_id from b0 group by 1 having greatest(sum(y), count(*)-sum(y)) <= 0.975*count(*))),
 b2 as (select * from b1 where voter_id in (select voter_id from b1 group by 1 having count(*)>=5)), b3 as (select * from b2 where vote_event_id in (select vote_event_id from b2 group by 1 having count(*)>=5)),
 b4 as (select * from b3 where voter_id in (select voter_id from b3 group by 1 having count(*)>=5)), b5 as (select * from b4 where vote_event_id in (select vote_event_id from b4 group by 1 having count(*)>=5))
 select leg, count(distinct voter_id) as n_voters, count(distinct vote_event_id) as n_events, count(*) as n_votes, cast(sum(y) as bigint) as n_yes from b5 group by 1""")(_pruned)
query("common_voters", " select distinct a.leg, a.voter_id from votes a join votes b on a.voter_id=b.voter_id and b.leg=a.leg+1")(lambda s, d: (lambda v: v.intersect(v.select((F.col("leg") - 1).alias("leg"), "voter_id")))(votes(s, d).select("leg", "voter_id").distinct()))
query("absent_from_next_term", " select distinct leg, voter_id from votes a where leg<6 and not exists (select 1 from votes b where b.voter_id=a.voter_id and b.leg=a.leg+1)")(lambda s, d: (lambda v: v.filter("leg < 6").join(v.select((F.col("leg") - 1).alias("leg"), "voter_id"), ["leg", "voter_id"], "left_anti"))(votes(s, d).select("leg", "voter_id").distinct()))

# --- resolving joins ----------------------------------------------------------------


def _people(s, d):
    return table(s, d, "customer").select("c_custkey", F.lower(F.concat_ws(" ", F.element_at(F.split("c_name", "#"), 1), F.lit("of"), F.substring("c_name", -3, 3))).alias("name"))


def _others(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.lower(F.concat_ws(" ", F.lit("customer"), F.lit("of"), F.substring("s_name", -3, 3))).alias("name"))


PEOPLE = "with l as (select c_custkey, lower(string_split(c_name,'#')[1]||' of '||right(c_name,3)) as name from customer), r as (select s_suppkey, 'customer of '||right(s_name,3) as name from supplier)"
query("exact_names", PEOPLE + " select c_custkey, l.name, m.s_suppkey from l left join (select name, min(s_suppkey) as s_suppkey from r group by 1) m on m.name=l.name", view=False)(lambda s, d: re_.exact(_people(s, d), _others(s, d), "name", "s_suppkey").select("c_custkey", "name", "s_suppkey"))
query("fuzzy_names", PEOPLE + """, j as (select c_custkey, s_suppkey, round(1-levenshtein(l.name,r.name)/greatest(length(l.name),length(r.name),1),6) as score from l join r on string_split(l.name,' ')[1]=string_split(r.name,' ')[1])
 select c_custkey, s_suppkey, score from (select *, row_number() over (partition by c_custkey order by score desc, s_suppkey) as k from j where score>=0.85) where k=1""", view=False)(lambda s, d: re_.fuzzy(_people(s, d), _others(s, d), "c_custkey", "s_suppkey"))


def _titles(s, d, mod):
    return table(s, d, "benchmark").filter(F.col("item_id") % 2 == mod).select(F.col("item_id").alias("a" if mod else "b"), F.regexp_replace(F.lower("text"), "[^a-z ]", "").alias("name"))


query("word_overlap", """with l as (select item_id as a, regexp_replace(lower(text),'[^a-z ]','','g') as name from benchmark where item_id%2=1), r as (select item_id as b, regexp_replace(lower(text),'[^a-z ]','','g') as name from benchmark where item_id%2=0),
 lw as (select distinct a, unnest(string_split(name,' ')) as w from l), rw as (select distinct b, unnest(string_split(name,' ')) as w from r),
 j as (select a, b, count(*)+0.5*count(*) filter (length(w)>=5) as score, count(*) as shared from lw join rw using (w) where length(w)>=3 group by 1,2)
 select a, b, cast(score as double) as score from (select *, row_number() over (partition by a order by score desc, b) as k from j where score>=3 and shared>=2) where k=1""", view=False)(lambda s, d: re_.overlap(_titles(s, d, 1), _titles(s, d, 0), "a", "b").withColumn("score", F.col("score").cast("double")))


def _spans(s, d):
    o = table(s, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_custkey").alias("who"), day.alias("start"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 400)).alias("end"), F.col("o_orderkey").alias("org"))


query("membership_as_of", """with p as (select o_orderkey, o_custkey as who, cast(o_orderdate as date) as day from orders),
 sp as (select o_custkey as who, cast(o_orderdate as date) as st, case when o_orderkey%3=0 then cast(o_orderdate as date)+400 end as en, o_orderkey as org from orders),
 j as (select o_orderkey, p.who, day, org, case when org is null then 2 when st<=day and day<=coalesce(en, date '9999-12-31') then 0 else 1 end as c, case when st<=day and day<=coalesce(en, date '9999-12-31') then -date_diff('day', date '1970-01-01', st) else abs(date_diff('day', day, st)) end as dist from p left join sp on sp.who=p.who)
 select o_orderkey, who, day, org, case c when 0 then 'inside' when 1 then 'nearest' else 'none' end as how from (select *, row_number() over (partition by o_orderkey order by c, dist, org) as k from j) where k=1""", view=False)(
    lambda s, d: re_.as_of(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("date").alias("day")), _spans(s, d), "who", "day"))


def _calendar(s):
    return s.range(7).select(F.col("id").alias("leg"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") * 365).cast("int")).alias("start"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") * 365 + 364).cast("int")).alias("end"))


query("term_of_date", "select o_orderkey, case when k between 0 and 6 then k end as term from (select o_orderkey, cast(floor(date_diff('day', date '1992-01-01', cast(o_orderdate as date))/365) as bigint) as k from orders)", view=False)(lambda s, d: re_.term_of(table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), _calendar(s), "day").select("o_orderkey", "term"))
query("new_ids", "select n_nationkey, 'O'||lpad(cast(row_number() over (order by n_name)+40 as varchar),5,'0') as id from nation", view=False)(lambda s, d: re_.numbered(table(s, d, "nation").select("n_nationkey", "n_name"), "O", ["n_name"], 40).select("n_nationkey", "id"))

# --- quality ----------------------------------------------------------------------

query("duplicate_histogram", "with n as (select l_partkey, l_suppkey, count(*) as m from lineitem group by 1,2) select m as multiplicity, count(*) as n_groups, cast(sum(m-1) as bigint) as n_extra from n group by 1", view=False)(lambda s, d: qu.duplicate_histogram(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"]))
query("deduplicated_votes", "select l_partkey, l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) as k from lineitem) where k=1", view=False)(lambda s, d: qu.keep_first(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]))
query("orphans", "select o_orderkey, o_custkey from orders where o_custkey not in (select s_suppkey from supplier)", view=False)(lambda s, d: qu.orphans(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(s, d, "supplier"), "s_suppkey").select("o_orderkey", "o_custkey"))
query("phantom_events", "select doc_id from documents where doc_id not in (select doc_id from labels)", view=False)(lambda s, d: qu.childless(table(s, d, "documents").select("doc_id"), "doc_id", table(s, d, "labels"), "doc_id"))
query("foreign_keys", "select 's_nationkey->n_nationkey' as relation, count(*) as n_orphans from supplier where s_nationkey not in (select n_nationkey from nation) union all select 'o_custkey->c_custkey', count(*) from orders where o_custkey not in (select c_custkey from customer)", view=False)(lambda s, d: qu.foreign_keys_hold([(table(s, d, "supplier"), "s_nationkey", table(s, d, "nation"), "n_nationkey"), (table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey")], s))
query("domain_report", "select 'l_returnflag' as \"column\", l_returnflag as value, count(*) as n from lineitem where l_returnflag not in ('A','N') group by 2 union all select 'l_linestatus', l_linestatus, count(*) from lineitem where l_linestatus not in ('O') group by 2", view=False)(lambda s, d: qu.domain_report(table(s, d, "lineitem"), {"l_returnflag": ["A", "N"], "l_linestatus": ["O"]}))
query("null_report", "select 'doc_id' as \"column\", count(*) filter (doc_id is null) as n_null from documents union all select 'lang', count(*) filter (lang is null) from documents", view=False)(lambda s, d: qu.null_report(table(s, d, "documents"), ["doc_id", "lang"]))
query("unique_violations", "select l_orderkey, l_partkey, count(*) as n from lineitem group by 1,2 having count(*)>1", view=False)(lambda s, d: qu.unique_violations(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]))
query("limit_report", " select 'parties' as rule, cast(voter_id as varchar) as subject, count(distinct grp) as value from votes group by 2 having count(distinct grp)>1 union all select 'voters', cast(leg as varchar), count(distinct voter_id) from votes group by 2 having count(distinct voter_id)>5")(lambda s, d: qu.limit_report(votes(s, d), 1, 5))


def _fill(s, d):
    people = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 2).alias("flag"))
    return qu.fill_null(people, table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 2).alias("flag")), "c_custkey", "flag")


query("filled_attributes", "with p as (select c_custkey, case when c_custkey%3>0 then c_custkey%2 end as flag from customer), u as (select o_custkey, min(o_orderkey%2) as nw from orders group by 1) select c_custkey, coalesce(flag,nw) as flag, coalesce(flag<>nw,false) as conflict from p left join u on o_custkey=c_custkey", view=False)(_fill)


def _tokens(s, d):
    return table(s, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("token"), F.when(F.col("doc_id") % 2 == 0, "M").otherwise("F").alias("genero"))


query("majority_dictionary", "with n as (select unnest(string_split(lower(text),' ')) as token, case when doc_id%2=0 then 1.0 else 0.0 end as m from documents), g as (select token, count(*) as n, round(avg(m),6) as share_m from n group by 1 having count(*)>=3) select *, case when share_m>0.7 then 'M' when share_m<0.3 then 'F' end as genero from g", view=False)(lambda s, d: qu.majority_dictionary(_tokens(s, d), least=3))
query("result_changes", TALLY + ", se as (" + SENATE + ") select vote_event_id, be.result as old, se.result as new from be join se using (vote_event_id) where be.result is distinct from se.result")(lambda s, d: qu.result_changes(ta.by_event(votes(s, d)), ta.by_event(votes(s, d), True), "vote_event_id", "result"))


def _purged(s, d):
    v = votes(s, d)
    dead = v.filter("leg = 2 and chamber = 'S'").select("vote_event_id").distinct()
    left = qu.purge({"votes": v, "events": v.select("vote_event_id", "leg").distinct()}, dead, "vote_event_id")
    return left["votes"].groupBy("leg").agg(F.count(F.lit(1)).alias("n")).join(left["events"].groupBy("leg").agg(F.count(F.lit(1)).alias("n_events")), "leg")


query("purged", " select leg, count(*) as n, count(distinct vote_event_id) as n_events from votes where not (leg=2 and chamber='S') group by 1")(_purged)
query("event_totals", " select vote_event_id, count(*) as voter_count from votes where option<>'ausente' group by 1")(lambda s, d: votes(s, d).filter("option <> 'ausente'").groupBy("vote_event_id").agg(F.count(F.lit(1)).alias("voter_count")))
query("voter_rank", " select voter_id, n, row_number() over (order by n desc, voter_id) as rank from (select voter_id, count(*) as n from votes group by 1) qualify rank<=20")(lambda s, d: votes(s, d).groupBy("voter_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "voter_id").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "voter_id")).cast("long")))
