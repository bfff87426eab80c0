"""Windows over events: by term, by two years, by count with overlap, and merging of small ones.

Windows are a small table (one row per window) and a bridge (window, event);
analyses carry the window id as a grouping key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import forget, stored
from .order import neighbours, numbered_rows, sum_before


def events(votes: DataFrame) -> DataFrame:
    return votes.groupBy("vote_event_id").agg(F.min("leg").alias("leg"), F.min("start_date").alias("start_date"), F.min("chamber").alias("chamber")).filter("start_date is not null")


def _windows(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("window_id").agg(F.min("start_date").alias("first"), F.max("start_date").alias("last"), F.count(F.lit(1)).alias("n_events"))


def by_term(ev: DataFrame) -> DataFrame:
    return ev.withColumn("window_id", F.col("leg").cast("long"))


def by_biennium(ev: DataFrame) -> DataFrame:
    return ev.withColumn("window_id", (F.year("start_date") - F.year("start_date") % 2).cast("long"))


def sliding(ev: DataFrame, size: int, overlap: int, keys: tuple[str, ...] = ("leg",)) -> DataFrame:
    """Events of windows of `size` in date order within keys, each starting size - overlap after the last; partial tails stay."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    e = numbered_rows(ev, [*keys, "start_date", "vote_event_id"], "i")
    e = e.join(e.groupBy(*keys).agg(F.min("i").alias("i0")), list(keys)).withColumn("i", F.col("i") - F.col("i0")).drop("i0")
    first = F.greatest(F.ceil((F.col("i") - size + 1) / step), F.lit(0)).cast("long")
    return e.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("i") / step).cast("long")))).withColumn("window_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("k").cast("string"))).drop("i")


def build(ev: DataFrame, kind: str, chamber: str | None = None, exclude: tuple[int, ...] = (), **options) -> DataFrame:
    """Bridge of the windows of the kind: legislatura, biennium or sliding."""
    ev = ev.filter(F.col("chamber") == chamber) if chamber else ev
    ev = ev.filter(~F.col("leg").isin(*exclude)) if exclude else ev
    kinds = {"legislatura": by_term, "biennium": by_biennium, "sliding": lambda e: sliding(e, **options)}
    if kind not in kinds:
        raise ValueError(f"unknown kind of window: {kind}")
    return kinds[kind](ev)


def merge_small(bridge: DataFrame, least: int) -> DataFrame:
    """Bridge in which windows of fewer than `least` events join the next one, a small last one the one before.

    From each window the sums of events tell where a group that began there
    would end, and so where the next begins. The groups that do begin are those
    reached from the first window; hops of doubled length find them in as many
    rounds as the number of windows has binary digits.
    """
    w = stored(numbered_rows(sum_before(_windows(bridge).select("window_id", "first", "n_events"), ["first", "window_id"], "n_events", "s0"), ["first", "window_id"], "i"))
    ends = w.select((F.col("s0") + F.col("n_events")).alias("x"), F.lit(1).alias("kind"), "i", F.col("i").alias("end"))
    wanted = w.select((F.col("s0") + least).alias("x"), F.lit(0).alias("kind"), "i", F.lit(None).cast("long").alias("end"))
    hop = stored(neighbours(ends.unionByName(wanted), ["x", "kind", "i"], "end", "last", "end_at", "x", "most").filter("kind = 0 and end_at is not null").select("i", (F.col("end_at") + 1).alias("to")))
    closed = hop
    begun = stored(w.filter("i = 1").select("i"))
    while True:
        more = stored(begun.unionByName(begun.join(hop, "i").select(F.col("to").alias("i"))).distinct())
        grown = more.count() > begun.count()
        forget(begun)
        begun = more
        if not grown:
            break
        hop = stored(hop.join(hop.select(F.col("i").alias("to"), F.col("to").alias("further")), "to").select("i", F.col("further").alias("to")))
    # a last group that never fills goes to the one before, if there is one
    filled = begun.join(closed.select("i"), "i", "left_semi")
    starts = filled.unionByName(begun.filter("i = 1")).distinct()
    groups = neighbours(w.join(starts.withColumn("start", F.col("i")), "i", "left"), ["i"], "start", "group", "next", "i", "most").select("window_id", "i", "group")
    names = groups.groupBy("group").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("window_id").cast("string").alias("w")))), lambda x: x["w"]), "+"), 1, 80).alias("merged"))
    named = groups.join(names, "group").select("window_id", "merged")
    return bridge.join(named, "window_id").select("vote_event_id", "leg", "start_date", "chamber", F.col("merged").alias("window_id")).distinct()  # one name per window


windows_of = _windows
