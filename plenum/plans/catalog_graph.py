"""Iterative graph operators, scaling and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from plenum.operators import agreement as ag
from plenum.operators import graph as gr
from plenum.operators import scaling as sc
from plenum.streaming import ingest as ing

from .base import query
from .views import table, votes


def _agreement(s, d):
    return gr.stored(ag.edges(votes(s, d)))


@query("communities")
def communities(s, d):
    return gr.communities(_agreement(s, d))


@query("community_modularity")
def community_modularity(s, d):
    e = _agreement(s, d)
    return ag.modularity(e, gr.communities(e).select(F.col("node").alias("voter_id"), F.col("community").alias("part")))


@query("betweenness")
def betweenness(s, d):
    """Over the shortest paths between all voters."""
    return gr.ranked(gr.betweenness(_agreement(s, d)), "betweenness", 20)




def _located(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("a"), (F.col("s_nationkey") + 1000000).cast("long").alias("b"))


# a nation and its suppliers are a component, as no supplier has two
query("components", "with g as (select s_nationkey, min(s_suppkey) as m from supplier group by 1) select s_suppkey as node, least(m, s_nationkey+1000000) as component from supplier join g using (s_nationkey) union all select s_nationkey+1000000, least(m, s_nationkey+1000000) from g", view=False)(lambda s, d: gr.components(_located(s, d)))
query("largest_component", "with g as (select s_nationkey, count(*) as n, min(s_suppkey) as m from supplier group by 1), t as (select s_nationkey from g order by n desc, m limit 1) select s_suppkey as node from supplier where s_nationkey in (select * from t) union all select s_nationkey+1000000 from t", view=False)(lambda s, d: gr.largest_component(_located(s, d)))
query("relation_degrees", "select node, cast(sum(o) as bigint) as out_weight, cast(sum(i) as bigint) as in_weight from (select o_custkey as node, o_orderkey%5+1 as o, 0 as i from orders union all select o_orderkey%100, 0, o_orderkey%5+1 from orders) group by 1", view=False)(lambda s, d: gr.weighted_degrees(table(s, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 100).alias("target"), (F.col("o_orderkey") % 5 + 1).alias("weight"))))
query("area_chain", "select n.n_name as id, r_name as up1, cast(null as varchar) as up2 from nation n join region on n_regionkey=r_regionkey union all select r_name, null, null from region", view=False)(lambda s, d: gr.ancestors(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id")).union(table(s, d, "region").select("r_name", F.lit(None).cast("string")))))


BINARY = {"least_votes": 5, "least_voters": 5}


@query("scaled_voters")
def scaled_voters(s, d):
    """All terms as one run, with the term in which a voter votes most."""
    b = sc.binary(votes(s, d), **BINARY)
    voters, _, how = sc.scale(b)
    return voters.join(sc.main_term(b), "voter_id").select("voter_id", "label", F.get("x", F.lit(0)).alias("dim_1"), F.get("x", F.lit(1)).alias("dim_2"), F.lit(how["converged"]).alias("converged"))


def _terms(s, d):
    """Votes of every term as a run; terms without enough votes are left out."""
    return sc.binary(votes(s, d), by=("leg",), **BINARY).withColumn("run", F.col("leg"))


@query("aligned_terms")
def aligned_terms(s, d):
    """Each term scaled by itself and turned onto the one before."""
    voters, _, how = sc.scale_runs(_terms(s, d))
    at = voters.select("run", "voter_id", F.get("x", F.lit(0)).alias("d1"), F.get("x", F.lit(1)).alias("d2"))
    converged = F.element_at(F.create_map(*[F.lit(x) for r, f in how.items() for x in (r, f["converged"])]), F.col("run").cast("int"))
    return sc.align_runs(at)[0].select("voter_id", "d1", "d2", F.col("run").alias("leg"), converged.alias("converged"))


@query("scaling_fit")
def scaling_fit(s, d):
    """How well the scaling of each term tells its votes."""
    b = _terms(s, d)
    voters, events, how = sc.scale_runs(b)
    fits = s.createDataFrame([(r, f["beta"], f["w"], f["iterations"], f["converged"]) for r, f in how.items()], "run long, beta double, w double, iterations int, converged boolean")
    return sc.fit_runs(b, voters, events, how).join(fits, "run").withColumnRenamed("run", "leg")


# --- streams ----------------------------------------------------------------------


def _events(s, d):
    # a stream reads folders and patterns, not single files
    got = ing.read(s, f"{d}/events.parque[t]", s.read.parquet(f"{d}/events.parquet").schema)
    return got.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(s, frame, mode: str):
    """Run the stream over what there is; its result as a stored table."""
    path = f"{gr.shared_folder(s)}/plenum/stream-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    q = frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return s.read.schema(frame.schema).parquet(f"{path}/out")


query("stream_buckets", "select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as start, event_type, count(*) as n from events group by 1, 2", view=False)(lambda s, d: _finished(s, ing.buckets(_events(s, d), "ts", "event_type", "1 day"), "complete"))
query("stream_tally", "select user_id % 10 as vote_event_id, count(*) filter (event_type='click') as a_favor, count(*) filter (event_type='view') as en_contra from events group by 1", view=False)(lambda s, d: _finished(s, ing.live_tally(_events(s, d).select((F.col("user_id") % 10).alias("vote_event_id"), F.lit("mayoria_simple").alias("requirement"), F.when(F.col("event_type") == "click", "a_favor").when(F.col("event_type") == "view", "en_contra").otherwise("ausente").alias("option"))), "complete").select("vote_event_id", "a_favor", "en_contra"))
query("stream_sliding", "with e as (select *, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as t from events) select t - interval (6 * k) hour as start, event_type, count(*) as n from e, range(4) r(k) group by 1, 2", view=False)(lambda s, d: _finished(s, ing.buckets(_events(s, d), "ts", "event_type", "24 hours", "6 hours"), "complete"))
query("stream_sessions", """with e as (select user_id % 50 as who, ts, lag(ts) over (partition by user_id % 50 order by ts) as before from events), f as (select who, ts, sum(case when before is null or ts - before >= interval 30 minute then 1 else 0 end) over (partition by who order by ts rows unbounded preceding) as k from e)
 select who, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from f group by who, k""", view=False)(lambda s, d: _finished(s, ing.sessions(_events(s, d).withColumn("who", F.col("user_id") % 50), "ts", "who", "30 minutes"), "complete"))


def _arriving(s, d, copies: int = 1):
    """The votes as a stream of three batches, voters of an event in each; further copies of them come after.

    A batch has one file, or as many of them as its votes ask for: a file is written and read by one task.
    """
    path = f"{gr.shared_folder(s)}/plenum/arriving-{uuid.uuid4().hex}"
    v = gr.stored(votes(s, d).select("vote_event_id", "voter_id", "option"))
    files = max(1, math.ceil(v.count() / 3 / ag.VOTES))
    for k in range(copies):
        v.repartition(3 * files, "voter_id").write.mode("append").parquet(path)
    return ing.read(s, path, v.schema, files), path


@query("stream_agreement", "select x.voter_id as a, y.voter_id as b, count(*) as n_shared, cast(sum(case when x.option=y.option then 1 else 0 end) as bigint) as n_agree from votes x join votes y on x.vote_event_id=y.vote_event_id and x.voter_id<y.voter_id where x.option<>'ausente' and y.option<>'ausente' group by 1, 2")
def stream_agreement(s, d):
    """Edges kept batch by batch; every vote arrives twice."""
    stream, path = _arriving(s, d, copies=2)
    q = ing.agreement_stream(stream, f"{path}-edges", f"{path}-state")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return ing.agreement_so_far(s, f"{path}-edges")


@query("stream_votes", "select vote_event_id, voter_id, option from votes")
def stream_votes(s, d):
    """Votes that arrive twice are loaded once."""
    stream, path = _arriving(s, d, copies=2)
    q = ing.append_new(stream, f"{path}-table", ["vote_event_id", "voter_id"], f"{path}-state")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return s.read.schema(stream.schema).parquet(f"{path}-table")
