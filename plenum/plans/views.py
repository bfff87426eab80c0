"""The roll-call view of the test tables: suppliers vote on parts, regions are parties, a part's number gives its term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote per event and voter: vote_event_id, voter_id, option, grp, leg, start_date, chamber, requirement."""
    c = F.col
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    # the first line of each pair as one number (order, line, both flags), so that it is found by hash aggregation before the shuffle
    number = (c("l_orderkey") * 16 + c("l_linenumber")) * 65536 + F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")
    line = line.groupBy("l_partkey", "l_suppkey").agg(F.min(number.cast("long")).alias("m"))
    line = line.select("l_partkey", "l_suppkey", F.chr(F.shiftright("m", 8).bitwiseAND(255)).alias("l_returnflag"), F.chr(c("m").bitwiseAND(255)).alias("l_linestatus"))
    who = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), c("s_nationkey") == c("n_nationkey"))
    what = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    e = c("l_partkey")
    leg = e % 7
    return line.join(who, c("l_suppkey") == c("s_suppkey")).join(what, e == c("p_partkey")).select(
        e.alias("vote_event_id"), c("l_suppkey").alias("voter_id"),
        F.when(c("l_returnflag") == "A", "a_favor").when(c("l_returnflag") == "R", "en_contra").when(c("l_linestatus") == "F", "abstencion").otherwise("ausente").alias("option"),
        F.when((c("l_suppkey") % 10 == 0) & (leg % 2 == 1), (c("n_regionkey") + 1) % 5).otherwise(c("n_regionkey")).cast("long").alias("grp"),
        leg.cast("long").alias("leg"), F.date_add(F.lit("2006-09-01").cast("date"), (leg * 1096 + (e * 37) % 1095).cast("int")).alias("start_date"),
        F.when(e % 4 == 0, "S").otherwise("D").alias("chamber"), F.when(c("p_size") <= 10, "mayoria_calificada").otherwise("mayoria_simple").alias("requirement"),
    )


#: The same view for an SQL engine; queries of the catalogue go on from `votes`.
VOTES_SQL = """with v0 as (
 select l_partkey e, l_suppkey u, l_returnflag rf, l_linestatus ls,
        row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber, l_returnflag, l_linestatus) rn from lineitem),
votes as (
select e as vote_event_id, u as voter_id,
       case when rf='A' then 'a_favor' when rf='R' then 'en_contra' when ls='F' then 'abstencion' else 'ausente' end as option,
       cast(case when u%10=0 and (e%7)%2=1 then (n_regionkey+1)%5 else n_regionkey end as bigint) as grp,
       cast(e%7 as bigint) as leg, cast(date '2006-09-01' + cast((e%7)*1096 + (e*37)%1095 as int) as date) as start_date,
       case when e%4=0 then 'S' else 'D' end as chamber,
       case when p_size<=10 then 'mayoria_calificada' else 'mayoria_simple' end as requirement
from v0 join supplier on u=s_suppkey join nation on s_nationkey=n_nationkey join part on p_partkey=e where rn=1)"""
