"""Resolving names, groups and dates: exact, fuzzy, set-overlap, interval, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import stored
from .order import neighbours, numbered_rows


def exact(left: DataFrame, right: DataFrame, key: str, target: str) -> DataFrame:
    """left plus the smallest target among right rows of the same key."""
    return left.join(right.groupBy(key).agg(F.min(target).alias(target)), key, "left")


def similarity(a, b):
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def fuzzy(left: DataFrame, right: DataFrame, id_left: str, id_right: str, name: str = "name", least: float = 0.85, initial: bool = False) -> DataFrame:
    """(id_left, id_right, score): the most similar name that shares the first token; ties to the smaller id.

    Distinct names are compared. The left names of a block are dealt into parts
    of about a thousand, and each part gets all right names of the block. With
    `initial`, names must also share the initial of the last token.
    """
    tok = F.split(F.col(name), " ")
    first = F.get(tok, F.lit(0))
    block = F.concat_ws(" ", first, F.substring(F.element_at(tok, -1), 1, 1)) if initial else first
    l = left.select(F.col(name).alias("ln"), block.alias("block")).distinct()
    r = right.groupBy(F.col(name).alias("rn"), block.alias("block")).agg(F.min(id_right).alias(id_right))
    parts = l.groupBy("block").agg((F.floor(F.count(F.lit(1)) / 1000) + 1).alias("parts"))
    l = l.join(parts, "block").select("ln", "block", F.pmod(F.xxhash64("ln"), F.col("parts")).alias("part"))
    r = r.join(parts, "block").select("rn", id_right, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    j = l.join(r, ["block", "part"]).withColumn("score", F.round(similarity(F.col("ln"), F.col("rn")), 6)).filter(F.col("score") >= least)
    best = j.groupBy("ln").agg(F.min(F.struct((-F.col("score")).alias("far"), F.col(id_right))).alias("m"))
    return left.join(best, left[name] == best["ln"]).select(id_left, F.col(f"m.{id_right}").alias(id_right), (-F.col("m.far")).alias("score"))


def overlap(left: DataFrame, right: DataFrame, id_left: str, id_right: str, name: str = "name") -> DataFrame:
    """(id_left, id_right, score): best by shared words of 3 letters or more, those of 5 or more counting 1.5; 3 points and 2 words needed.

    Exact by prefixes: two names that share two words share one that is not the
    most frequent of either. So each name is indexed by all its words but that
    one, and no pair meets at a word that is the commonest of both; pairs that
    meet are compared on all words. Ids are unique.
    """
    words = lambda d, i: d.select(F.col(i).alias("id"), F.filter(F.array_distinct(F.split(name, " ")), lambda w: F.length(w) >= 3).alias("words"))
    sides = [stored(words(d, i)) for d, i in ((left, id_left), (right, id_right))]
    each = [d.select("id", F.explode("words").alias("w")) for d in sides]
    often = each[0].select("w").unionAll(each[1].select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(d: DataFrame, into: str) -> DataFrame:
        ranked = d.join(often, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("by"))
        return ranked.select(F.col("id").alias(into), F.explode(F.slice("by", F.lit(1), F.size("by") - 1)).alias("x")).select(into, F.col("x.w").alias("w"))

    met = prefixes(each[0], "l").join(prefixes(each[1], "r"), "w").select("l", "r").distinct()
    both = met.join(sides[0].toDF("l", "wl"), "l").join(sides[1].toDF("r", "wr"), "r")
    same = F.array_intersect("wl", "wr")
    j = both.select("l", "r", F.size(same).alias("shared"), (F.size(same) + 0.5 * F.size(F.filter(same, lambda w: F.length(w) >= 5))).alias("score")).filter("score >= 3 and shared >= 2")
    best = j.groupBy("l").agg(F.min_by(F.struct("r", "score"), F.struct((-F.col("score")).alias("s"), "r")).alias("m"))
    return best.select(F.col("l").alias(id_left), F.col("m.r").alias(id_right), "m.score")


def as_of(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """points plus the org of the span (key, start, end, org) that holds `at`, latest start first, then smallest org; else of the nearest start. How says which it was.

    Points and starts are merged in one order by key and date, dealt by ranges:
    a point sees the start before it, the one after it and the latest end so
    far, so that the work grows with points and spans, not with their product.
    Only points at which the last span is over but an earlier one may hold are
    joined with the spans of their key that can hold them.
    """
    never = F.lit("9999-12-31").cast("date")
    p = stored(points.withColumn("__row", F.monotonically_increasing_id()))
    known = spans.select(F.col(key).alias("k"), "start", F.coalesce("end", never).alias("end"), "org").filter("k is not null and start is not null and org is not null")
    # spans of one start are one row: the smallest org with its end, and the latest end of all
    starts = known.groupBy("k", "start").agg(F.min_by(F.struct("org", "end"), F.struct("org", (-F.unix_date("end")).alias("e"))).alias("m"), F.max("end").alias("most"))
    starts = starts.select("k", F.col("start").alias("d"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("__row"), F.struct("k", F.col("start").alias("s"), F.col("m.org").alias("org"), F.col("m.end").alias("e")).alias("span"), F.struct("k", F.col("most").alias("e")).alias("far"))
    asks = p.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).cast("date").alias("d"), F.lit(1).alias("kind"), "__row")
    both = neighbours(starts.unionByName(asks, allowMissingColumns=True), ["k", "d", "kind", "__row"], "span", "prev", "next", "far", "far_so_far").filter("kind = 1")
    own = lambda c: F.when(F.col(f"{c}.k") == F.col("k"), F.col(c))
    both = both.select("__row", "k", "d", own("prev").alias("prev"), own("next").alias("next"), own("far_so_far").alias("far"))
    both = stored(both.withColumn("holds", F.coalesce(F.col("prev.e") >= F.col("d"), F.lit(False))).withColumn("hidden", ~F.col("holds") & F.coalesce(F.col("far.e") >= F.col("d"), F.lit(False))))
    near = F.least(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.datediff(f"{c}.s", "d")).alias("away"), F.col(f"{c}.org").alias("org"))) for c in ("prev", "next")])
    plain = both.filter("not hidden").select("__row", F.when(F.col("holds"), F.col("prev.org")).otherwise(near["org"]).alias("org"), F.when(F.col("holds"), "inside").when(near.isNotNull(), "nearest").alias("how"))
    j = both.filter("hidden").select("__row", "k", "d").join(known, "k").filter("start <= d and d <= end")
    earlier = j.groupBy("__row").agg(F.min_by("org", F.struct((-F.unix_date("start")).alias("s"), F.col("org"))).alias("org")).withColumn("how", F.lit("inside"))
    found = plain.unionByName(earlier)
    return p.join(found, "__row", "left").select(*points.columns, "org", F.coalesce("how", F.lit("none")).alias("how"))


def term_of(rows: DataFrame, terms: DataFrame, at: str) -> DataFrame:
    """rows plus the term (leg, start, end; both ends inclusive) that holds the date. terms is the calendar: a few rows."""
    t = F.broadcast(terms.select(F.col("leg").alias("term"), F.col("start").alias("__s"), F.col("end").alias("__e")))
    return rows.join(t, (F.col(at) >= F.col("__s")) & (F.col(at) <= F.col("__e")), "left").drop("__s", "__e")


def numbered(new: DataFrame, prefix: str, order: list[str], start: int = 0, width: int = 5) -> DataFrame:
    """new plus `id`: prefix and running number, filled with zeros to a width and longer beyond it."""
    rows = numbered_rows(new, order, "__n")
    n = (F.col("__n") + start).cast("string")
    return rows.withColumn("id", F.concat(F.lit(prefix), F.lpad(n, F.greatest(F.length(n), F.lit(width)), F.lit("0")))).drop("__n")
