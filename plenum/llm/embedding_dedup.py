"""Near-duplicate vectors by collision counting over sorted projections.

Unit vectors are projected on `PROJECTIONS` random directions. For every
projection one block of vectors is sorted, and each vector of the other block
is a query that collides with those in the window of +-`WINDOW` around its own
projection. A pair is verified by its exact cosine when it collides often
enough. That count is calibrated: for two vectors at the threshold the
difference of their projections is normal with a known deviation, so the count
is binomial, and the smallest count with a miss probability of at most `MISS`
is taken. Closer pairs collide more often.

Equal vectors of a label are first folded into one representative with a
multiplicity. The representatives of a (label, dimension) are dealt into
blocks of about `BLOCK`, and pairs of blocks are the units of work: a large
label is spread over as many tasks as its size asks for, and a task's memory
does not depend on it. A task returns per vector a sum of linked
multiplicities and one edge to the smallest vector of its linked group within
the task, never the pairs.

Nulls: vectors that are null, empty, zero or with null or non-finite
components, and those with a null label, link with nothing and are their own
component; so are rows with a null vec_id (component null, kept true).
Vectors of different dimension never link. Repeated rows are vectors of their
own and link with each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, table
from .components import components

PROJECTIONS = 48
WINDOW = 0.45
MISS = 1e-7
BLOCK = 1024


def needed_collisions(cosine: float, m: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """Largest count c for which a pair at the cosine has fewer than c collisions with probability at most miss."""
    p = math.erf(window / math.sqrt(2.0 - 2.0 * cosine) / math.sqrt(2.0)) if cosine < 1 else 1.0
    below = 0.0
    for c in range(m + 1):
        below += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if below > miss:
            return c
    return m


def _projected(unit: np.ndarray) -> np.ndarray:
    return unit @ np.random.default_rng(unit.shape[1]).standard_normal((unit.shape[1], PROJECTIONS))


def linked(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of unit vectors with the cosine or more; without i = j where a and b are the same."""
    pa, pb = _projected(a), _projected(b)
    count = np.zeros((len(a), len(b)), np.uint8)
    rank = np.empty(len(b), np.int32)
    for k in range(PROJECTIONS):
        order = np.argsort(pb[:, k])
        rank[order] = np.arange(len(b), dtype=np.int32)
        lo = np.searchsorted(pb[order, k], pa[:, k] - WINDOW).astype(np.int32)
        hi = np.searchsorted(pb[order, k], pa[:, k] + WINDOW, side="right").astype(np.int32)
        count += (rank[None, :] - lo[:, None]).view(np.uint32) < (hi - lo).astype(np.uint32)[:, None]
    i, j = np.nonzero(count >= needed_collisions(cosine))
    if same:
        i, j = i[i != j], j[i != j]
    near = np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        near[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]]) >= cosine
    return i[near], j[near]


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = pick(vectors, "vec_id", "embedding", "label")
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    valid = rows.filter("valid")
    # a vector's number, fixed by storing it; ids may repeat and so cannot name vectors
    reps = materialize(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    sizes = reps.groupBy("label", F.size("embedding").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = reps.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a block meets every block of its group; the pair of a block with itself comes once
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "rep", "copies", F.col("embedding").cast("array<double>").alias("embedding"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        x = np.array(pdf["embedding"].tolist(), np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        rep, copies, block = (pdf[c].to_numpy() for c in ("rep", "copies", "block"))
        left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
        ia, ib = np.flatnonzero(block == left), np.flatnonzero(block == right)
        i, j = linked(x[ia], x[ib], cosine, left == right)
        i, j = ia[i], ib[j]
        links = np.bincount(i, copies[j], len(rep)).astype(np.int64)
        if left != right:
            links += np.bincount(j, copies[i], len(rep)).astype(np.int64)
        root = smallest_reachable(len(rep), i, j)
        hit = links > 0
        return pd.DataFrame({"rep": rep[hit], "links": links[hit], "root": rep[root[hit]]})

    found = materialize(dealt.groupBy("label", "dim", "left", "right").applyInPandas(search, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    placed = reps.join(links, "rep", "left").join(parts, "rep", "left").withColumn("part", F.coalesce("component_id", "rep"))
    named = placed.groupBy("part").agg(F.min("first").alias("smallest"))
    known = placed.join(named, "part").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("smallest").alias("component_id"))
    linked_rows = valid.select("vec_id", "label", "embedding").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
w as (select * from v where label is not null and vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.r as r, b.vec_id as other, a.vec_id as own from w a join w b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
 where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(own, other) as (select own, other from l union select p.own, l.other from reach p join l on p.other = l.own)
select v.vec_id, coalesce(n.n, 0) as n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) as component_id, coalesce(v.vec_id <= m.m, true) as kept
from v left join (select r, count(*) as n from l group by r) n using (r) left join (select own, min(other) as m from reach group by own) m on m.own = v.vec_id
"""
