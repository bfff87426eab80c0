"""Iterative graph operators: components, communities, betweenness. State lives in stored tables, not on the driver."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plenum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share and read back; cuts the lineage of a loop."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plenum/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what stored has written for these, once nothing reads them any more; frames of other origin are left alone."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each reaches over edges (a, b).

    In each round every node points to its smallest neighbour. The trees that
    this makes have one pair that point to each other, which holds the tree's
    smallest node, the root. Pointers are doubled until all point to roots, and
    the edges between different roots are the next round's. Each root with an
    edge left merges with another one, so that n nodes take log2(n) rounds of
    log2(n) doublings at most, whatever the shape; there is no other limit.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a is not null").distinct())
    maps = []
    while not maps or not both.isEmpty():
        # a node with no other neighbour is its own root
        first = both.groupBy("a").agg(F.coalesce(F.min(F.when(F.col("a") != F.col("b"), F.col("b"))), F.first("a")).alias("to"))
        back = first.select(F.col("a").alias("to"), F.col("to").alias("back"))
        up = stored(first.join(back, "to", "left").select(F.col("a").alias("node"), F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("to")))
        while True:
            new = stored(up.select("node", F.col("to").alias("old")).join(up.select(F.col("node").alias("old"), "to"), "old").select("node", "old", "to"))
            forget(up)
            up = new
            if new.filter("old <> to").isEmpty():
                break
        maps.append(up)
        a, b = up.select(F.col("node").alias("a"), F.col("to").alias("ra")), up.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        last, both = both, stored(both.join(a, "a").join(b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        forget(last)
    forget(both)
    label = maps.pop()
    while maps:
        last, up = label, maps.pop()
        label = stored(up.join(last.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left").select("node", F.coalesce("further", "to").alias("to")))
        forget(last, up)
    return label.select("node", F.col("to").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """(node) of the component with most nodes, ties to the smallest label."""
    c = components(edges)
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(top), "component", "left_semi").select("node")  # one row


#: Edge ends in one block of nodes, about; passes over a block in one round; blocks at least.
BLOCK = 1_000_000
PASSES = 4
LEAST_BLOCKS = 8
#: Edges of a component, or of a level, that one task works on by itself; components of fewer than a hundredth share tasks.
HELD = 2_000_000
#: Further climbs of such a component.
AGAIN = 8


def _moves(resolution: float, total: float):
    """A task's work on a block: its nodes move one after another, what is outside stays as it was."""
    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "to"], kind="stable")
        nodes, first = np.unique(pdf["x"].to_numpy(), return_index=True)
        names, code = np.unique(np.concatenate([pdf["to"].to_numpy(), pdf["c"].to_numpy()[first]]), return_inverse=True)
        tot = np.zeros(len(names))
        tot[code[len(pdf):]] = pdf["own_tot"].to_numpy()[first]
        tot[code[:len(pdf)]] = pdf["tot"].to_numpy()
        at, k = code[len(pdf):].copy(), pdf["k"].to_numpy()[first]
        begun, weight = at.copy(), pdf["w"].to_numpy()
        inner = pdf["y"].notna().to_numpy()
        # ends inside the block follow their node, others keep their community
        follows = np.where(inner, np.searchsorted(nodes, pdf["y"].fillna(0).to_numpy().astype("int64")), 0)
        bounds = np.append(first, len(pdf))
        more = 0.0
        for _ in range(PASSES):
            moved = False
            for v in range(len(nodes)):
                rows = slice(bounds[v], bounds[v + 1])
                near = np.where(inner[rows], at[follows[rows]], code[rows])
                to, back = np.unique(near, return_inverse=True)
                into = np.bincount(back, weight[rows])
                own, share = to == at[v], resolution * k[v] / (2.0 * total)
                gain = np.round(into - share * np.where(own, tot[to] - k[v], tot[to]), 9)
                stay = gain[own][0] if own.any() else -share * (tot[at[v]] - k[v])
                # the smallest label of those with the largest gain
                best = int(np.argmax(gain))
                if gain[best] > stay + 1e-8:
                    more += gain[best] - stay
                    tot[at[v]] -= k[v]
                    at[v] = to[best]
                    tot[at[v]] += k[v]
                    moved = True
            if not moved:
                break
        some = at != begun
        return pd.DataFrame({"x": nodes[some], "to": names[at[some]], "block": pdf["block"].iloc[0], "more": more})

    return move


def _settled(i: np.ndarray, j: np.ndarray, w: np.ndarray, at: np.ndarray, resolution: float, total: float) -> bool:
    """Move nodes 0.. of edges (i, j, w) between the communities `at`, one after another until none gains; whether one has moved."""
    n, out = len(at), np.flatnonzero(i != j)
    # a loop counts twice in the degree, as a community's inner weight does
    k = np.bincount(i, w, n) + np.bincount(j, w, n)
    x, y, v = np.concatenate([i[out], j[out]]), np.concatenate([j[out], i[out]]), np.concatenate([w[out], w[out]])
    by = np.argsort(x, kind="stable")
    y, v, bounds = y[by], v[by], np.append(0, np.cumsum(np.bincount(x, minlength=n)))
    tot, moved, going = np.bincount(at, k, n), False, True
    while going:
        going = False
        for u in np.flatnonzero(np.diff(bounds)):
            rows, mine, share = slice(bounds[u], bounds[u + 1]), at[u], resolution * k[u] / (2.0 * total)
            to, back = np.unique(at[y[rows]], return_inverse=True)
            own = to == mine
            gain = np.round(np.bincount(back, v[rows]) - share * (tot[to] - k[u] * own), 9)
            stay = gain[own][0] if own.any() else -share * (tot[mine] - k[u])
            # the smallest label of those with the largest gain
            best = int(np.argmax(gain))
            if gain[best] > stay + 1e-8:
                tot[mine] -= k[u]
                at[u] = to[best]
                tot[to[best]] += k[u]
                going = moved = True
    return moved


def _smallest(at: np.ndarray) -> np.ndarray:
    """The smallest node of each node's community."""
    first = np.full(int(at.max(initial=-1)) + 1, len(at))
    np.minimum.at(first, at, np.arange(len(at)))
    return first[at]


def _parted(a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, total: float, again: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of weighted edges and their communities: nodes move, then communities as the nodes of levels, and nodes again until none gains.

    `again`: so often a quarter of the nodes, by their hash, goes back to
    communities of its own, and all climb once more; what is higher stays.
    """
    order = np.lexsort((b, a))
    nodes, code = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    i, j, w, n = code[:len(a)], code[len(a):], w[order], len(nodes)

    def climbed(at: np.ndarray) -> np.ndarray:
        while _settled(i, j, w, at, resolution, total):
            while True:
                _, member = np.unique(_smallest(at), return_inverse=True)
                m = int(member.max()) + 1
                pair, back = np.unique(np.minimum(member[i], member[j]) * m + np.maximum(member[i], member[j]), return_inverse=True)
                level = np.arange(m)
                moved = _settled(pair // m, pair % m, np.bincount(back, w), level, resolution, total)
                at = _smallest(level[member])
                if not moved:
                    break
        return at

    def height(at: np.ndarray) -> float:
        """Modularity times the edges' total weight."""
        k = np.bincount(at[i], w, n) + np.bincount(at[j], w, n)
        return float(w[at[i] == at[j]].sum() - resolution * (k * k).sum() / (4.0 * total))

    best = climbed(np.arange(n))
    for r in range(again):
        back = np.flatnonzero(((nodes.astype(np.int64) * 2654435761 + r * 320742357) % 2**32 >> 8) % 4 == 0)
        at = best.copy()
        # a node of its own takes its own name, so others' communities are named by those that stay
        at[back] = n + back
        at = climbed(_smallest(at))
        if height(at) > height(best) + 1e-9 * total:
            best = at
    return nodes, nodes[_smallest(best)]


def _held(edges: DataFrame, resolution: float, total: float) -> DataFrame:
    """(node, community) of edges (own, deal, a, b, w), in which components of one (own, deal) are together."""
    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # not where components share a task, as what stays would depend on how they are dealt
        again = 0 if pd.isna(key[0]) else AGAIN
        node, community = _parted(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), resolution, total, again)
        return pd.DataFrame({"node": node, "community": community})

    # a number, as few bytes here are much work
    width = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.select("own", "deal", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w").repartition(width, "own", "deal").groupBy("own", "deal").applyInPandas(work, "node long, community long")


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) by local moving and aggregation on modularity.

    What a node gains depends on its own component and the total weight alone.
    So a component of up to `HELD` edges is worked on in one task, where nodes
    move one after another; larger ones are dealt into blocks of nodes, until
    a level of theirs has few enough edges for one task.
    """
    level_edges = stored(edges.select("a", "b", F.col("weight").cast("double").alias("w")))
    total = level_edges.agg(F.sum("w").alias("m")).collect()[0]["m"]
    if not total:
        return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("community"))
    of = components(level_edges).select(F.col("node").alias("a"), "component")
    placed = stored(level_edges.join(of, "a"))
    sizes = stored(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    most, small = sizes.agg(F.max("n"), F.sum(F.when(F.col("n") < HELD // 100, F.col("n")))).first()
    deals = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), (small or 0) * 20 // max(1, HELD))
    alone = F.col("n") >= HELD // 100
    few = placed.join(sizes.filter(F.col("n") <= HELD), "component").select(F.when(alone, F.col("component")).alias("own"), F.when(~alone, F.pmod(F.xxhash64("component"), F.lit(deals))).alias("deal"), "a", "b", "w")
    out = stored(_held(few, resolution, total))
    if most > HELD:
        out = out.unionByName(_blockwise(placed.join(sizes.filter(F.col("n") > HELD), "component").select("a", "b", "w"), resolution, total))
    forget(level_edges, placed, sizes)
    return out


def _blockwise(edges: DataFrame, resolution: float, total: float) -> DataFrame:
    """(node, community) of edges (a, b, w) that one task cannot hold; total: the weight of all edges there are.

    Nodes are dealt into blocks, by ranges that hold about as many edge ends
    each. In a round the nodes of a block look at the communities of their
    neighbours one after another and move to the one with the largest gain,
    ties to the smallest label; blocks do so side by side, and a task gets its
    block's inner edges and sums of the outer ones by community. Where the
    blocks' moves together do not raise the modularity, only the half of them
    that gains most moves, in the end one, whose gain is known by itself. So it
    rises with each round, and a level ends only when no node gains by moving.
    Communities become the nodes of the next level, until a level moves nothing
    or has few enough edges for one task.
    """
    level_edges = stored(edges)
    member = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("at")))
    while True:
        if level_edges.count() <= HELD:
            rest = _held(level_edges.select(F.lit(0).alias("own"), F.lit(0).alias("deal"), "a", "b", "w"), resolution, total)
            last, member = member, stored(member.join(rest.withColumnRenamed("node", "at"), "at").select("node", F.col("community").alias("at")))
            forget(last, level_edges)
            break
        # a loop (a = b) counts twice in the degree, as a community's inner weight does
        both = stored(level_edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(level_edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "w")))
        n, loops = both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("w"))), F.lit(0.0)).alias("loops")).collect()[0]
        blocks = max(LEAST_BLOCKS, n // BLOCK)
        limits = both.agg(F.percentile_approx("x", [i / blocks for i in range(1, blocks)], 100 * blocks).alias("limits")).collect()[0]["limits"]
        block = F.size(F.filter(F.array(*[F.lit(v) for v in sorted(set(limits))]), lambda v: v < F.col("x")))
        degree = stored(both.groupBy("x").agg(F.sum("w").alias("k")).withColumn("block", block))
        # by x, so that most of each round's sums are formed before its shuffle
        ends = stored(both.filter("x <> y").join(degree.select("x", "block"), "x").join(degree.select(F.col("x").alias("y"), F.col("block").alias("other")), "y").select("block", "x", F.when(F.col("block") == F.col("other"), F.col("y")).alias("inner"), "y", "w").repartition("x"))
        forget(both)

        def seen(place: DataFrame) -> tuple[DataFrame, float]:
            """What each block sees of the places (x, k, c), and their modularity times the edges' total weight."""
            size = place.groupBy("c").agg(F.sum("k").alias("tot"))
            near = ends.join(place.select(F.col("x").alias("y"), F.col("c").alias("to")), "y").groupBy("block", "x", F.col("inner").alias("y"), "to").agg(F.sum("w").alias("w"))
            own = place.join(size.withColumnRenamed("tot", "own_tot"), "c").select("x", "k", "c", "own_tot")
            near = stored(near.join(own, "x").join(size.withColumnRenamed("c", "to"), "to"))
            inside = near.agg(F.coalesce(F.sum(F.when(F.col("to") == F.col("c"), F.col("w"))), F.lit(0.0)).alias("inside"))
            got = inside.crossJoin(size.agg(F.sum(F.col("tot") * F.col("tot")).alias("square"))).collect()[0]  # one row each
            return near, (got["inside"] + loops) / 2 - resolution * got["square"] / (4 * total)

        place = stored(degree.select("x", "k", F.col("x").alias("c")))
        (near, height), moved_any, most = seen(place), False, blocks
        while True:
            # a number, as few bytes here are much work
            moves = stored(near.repartition(blocks, "block").groupBy("block").applyInPandas(_moves(resolution, total), "x long, to long, block int, more double"))
            chosen = [r["block"] for r in moves.groupBy("block").agg(F.first("more").alias("more")).orderBy(F.desc("more"), "block").collect()][:most]
            if not chosen:
                forget(moves, near)
                break
            while True:
                new = stored(place.join(moves.filter(F.col("block").isin(chosen)).select("x", "to"), "x", "left").select("x", "k", F.coalesce("to", "c").alias("c")))
                now, higher = seen(new)
                # also where one block's gain is too small to see in the sum
                if len(chosen) == 1 or higher > height + 1e-6:
                    break
                forget(new, now)
                chosen = chosen[:len(chosen) // 2]
            forget(place, near, moves)
            place, near, height, moved_any, most = new, now, higher, True, 2 * len(chosen)
        if not moved_any:
            break
        name = place.groupBy("c").agg(F.min("x").alias("name"))
        to = place.join(name, "c").select(F.col("x").alias("at"), "name")
        last, member = member, stored(member.join(to, "at").select("node", F.col("name").alias("at")))
        a, b = to.select(F.col("at").alias("a"), F.col("name").alias("na")), to.select(F.col("at").alias("b"), F.col("name").alias("nb"))
        before, level_edges = level_edges, stored(level_edges.join(a, "a").join(b, "b").groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.sum("w").alias("w")))
        forget(last, before, degree, ends, place)
    smallest = member.groupBy("at").agg(F.min("node").alias("community"))
    return member.join(smallest, "at").select("node", "community")


#: A component of at least so many nodes, of whose pairs one in `RARE` at least is linked, goes by blocks; nodes along a block's side.
THICK = 128
RARE = 256
SIDE = 512


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness) over unweighted shortest paths, normalised; sources (node) samples where paths begin.

    Breadth-first from all sources at once, then dependencies are summed back
    level by level. What a source cannot reach is not looked at: sources meet
    nodes of their own component only. Components with many links go by blocks
    of the matrix of links, others by rows.
    """
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    degree = both.groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    degree = stored(degree.join(components(both.toDF("a", "b")).withColumnRenamed("node", "x"), "x"))
    size = degree.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("ends"))
    size = stored(size.withColumn("thick", (F.col("n") >= THICK) & (F.col("ends") * RARE >= F.col("n").cast("double") * F.col("n"))))
    nodes = degree.select(F.col("x").alias("node"))
    n = degree.count()
    start = stored(sources.select("node").distinct()) if sources is not None else nodes
    begun = start.count()
    found = []
    for thick in [r["thick"] for r in size.select("thick").distinct().collect()]:
        of = size.filter(F.col("thick") == thick)
        all_of_them = size.filter(F.col("thick") != thick).isEmpty()
        inside = degree if all_of_them else stored(degree.join(of.select("component"), "component", "left_semi"))
        links = both if all_of_them else stored(both.join(inside.select("x"), "x", "left_semi"))
        home = stored(start.join(inside.select(F.col("x").alias("node"), "component"), "node"))
        pairs, ends = home.join(of, "component").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).collect()[0]
        found.append(_by_blocks(links, inside, home, pairs) if thick else _by_rows(links, inside, home, pairs, ends))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    found = [f for f in found if f is not None]
    dep = functools.reduce(DataFrame.unionByName, found).groupBy(F.col("v").alias("node")).agg(F.sum("dep").alias("dep")) if found else nodes.select("node", F.lit(0.0).alias("dep"))
    whole = n / max(1, begun) if sources is not None else 1.0
    return nodes.join(dep, "node", "left").select("node", F.round(F.coalesce("dep", F.lit(0.0)) * scale * whole, 6).alias("betweenness"))


def _by_rows(both: DataFrame, degree: DataFrame, home: DataFrame, pairs: int, ends: int) -> DataFrame | None:
    """Dependencies (v, dep) on nodes of paths from home (node, component) over links (x, y).

    A row per source and node with distance and number of paths, one join per
    level. Each step goes from the end with fewer edges: from the nodes just
    reached or from those not reached yet, and from the upper or the lower
    level. So a dense graph does not cost its edges for each source and node.
    pairs, ends: of each source the nodes of its component and their edges.
    """
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(level: DataFrame) -> int:
        """Edges that leave the level's nodes, over all sources."""
        return level.join(degree, level["v"] == degree["x"]).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).collect()[0]["k"]

    front = stored(home.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))
    seen, levels, wide = front, [front], [spread(front)]
    while True:
        unseen = ends - sum(wide)
        if pairs + unseen < wide[-1]:
            # nodes of a component are dealt into parts, as it may be all of the graph
            all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
            near = home.select(F.col("node").alias("s"), "component", all_parts.alias("part")).join(degree.select(F.col("x").alias("v"), "component", F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int").alias("part")), ["component", "part"])
            rest = near.select("s", "v").join(seen.select("s", "v"), ["s", "v"], "left_anti")
            nxt = rest.join(both, rest["v"] == both["x"]).select("s", "v", F.col("y").alias("u")).join(front.select("s", F.col("v").alias("u"), "paths"), ["s", "u"]).groupBy("s", "v").agg(F.sum("paths").alias("paths"))
        else:
            nxt = front.join(both, front["v"] == both["x"]).groupBy("s", F.col("y").alias("v")).agg(F.sum("paths").alias("paths")).join(seen.select("s", "v"), ["s", "v"], "left_anti")
        front = stored(nxt.select("s", "v", "paths"))
        if front.isEmpty():
            break
        levels.append(front)
        wide.append(spread(front))
        seen = seen.unionByName(front)
    below, out = None, None
    for d in range(len(levels) - 1, 0, -1):
        here = levels[d].withColumn("dep", F.lit(0.0)) if below is None else levels[d].join(below, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep"))
        here = stored(here)
        out = here.select("v", "dep") if out is None else out.unionByName(here.select("v", "dep"))
        up = levels[d - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("up"))
        if wide[d - 1] < wide[d]:
            links = up.join(both, F.col("u") == both["x"]).select("s", "u", "up", F.col("y").alias("v")).join(here, ["s", "v"])
        else:
            links = here.join(both, F.col("v") == both["x"]).select("s", "paths", "dep", F.col("y").alias("u")).join(up, ["s", "u"])
        below = stored(links.groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("up") / F.col("paths") * (1 + F.col("dep"))).alias("dep")))
    return out


def _entries(codes: np.ndarray) -> bytes:
    return codes.astype(np.int32).tobytes()


def _packed(df: DataFrame, row: str, column: str, value: str | None = None) -> DataFrame:
    """Entries at (row, column) in blocks (i, j): places in order in one binary, with a column of values theirs in another."""
    spots = df.select(*[F.expr(f"{c} div {SIDE}").cast("int").alias(b) for c, b in ((row, "i"), (column, "j"))], (F.col(row) % SIDE * SIDE + F.col(column) % SIDE).cast("int").alias("at"), *([F.col(value).alias("value")] if value else []))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "at": [_entries(pdf["at"].to_numpy())]} | ({"value": [pdf["value"].to_numpy().tobytes()]} if value else {}))

    return spots.groupBy("i", "j").applyInPandas(pack, "i int, j int, at binary" + (", value binary" if value else ""))


def _times(at: np.ndarray, value: np.ndarray, links: np.ndarray, side: int) -> np.ndarray:
    """A block times a block of links, flat; thin ones by their entries."""
    row, middle, first, last = at // side, at % side, links // side, links % side
    degree = np.bincount(first, minlength=side)
    many = degree[middle]
    if many.sum() > 2 * side * side:
        left, right = np.zeros((side, side)), np.zeros((side, side))
        left[row, middle], right[first, last] = value, 1.0
        return (left @ right).ravel()
    begin = np.cumsum(degree) - degree
    which = np.repeat(begin[middle] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.bincount(np.repeat(row * side, many) + last[which], np.repeat(value, many), side * side)


def _by_blocks(both: DataFrame, degree: DataFrame, home: DataFrame, pairs: int) -> DataFrame | None:
    """The same for components with many links, by blocks of `SIDE` sources and nodes.

    Nodes are numbered component by component. A level holds of each block of
    sources and block of nodes the places reached and their numbers of paths; a
    step multiplies these blocks with those of the links, tasks add up products
    of the same place one after another and leave out what is reached already.
    Going back, products are those of dependencies, kept where the level above is.
    """
    from .order import numbered_rows

    side, parts = SIDE, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = stored(numbered_rows(degree.select("x", "component"), ["component", "x"], "n").select("x", (F.col("n") - 1).alias("n")))
    rows = numbered_rows(home.join(ids, home["node"] == ids["x"]).select("n"), ["n"], "s").select((F.col("s") - 1).alias("s"), "n", F.lit(1.0).alias("paths"))
    linked = both.join(ids.withColumnRenamed("n", "from"), "x").join(ids.select(F.col("x").alias("y"), F.col("n").alias("to")), "y")
    links = stored(_packed(linked, "from", "to").select(F.col("i").alias("j"), F.col("j").alias("to"), F.col("at").alias("links")))
    front = stored(_packed(rows, "s", "n", "paths"))
    rank = links.select("j").distinct().count()
    # sources of a block of nodes are dealt out too, so that there is work for all tasks
    deals, width = max(1, 4 * parts // max(1, rank)), max(4 * parts, rank)
    dealt = stored(links.select("*", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")).repartition(width, "j", "deal")) if deals > 1 else links.withColumn("deal", F.lit(0))

    def product(left: DataFrame) -> DataFrame:
        """Of blocks (i, j, at, value) the products with all links, as (i, j, middle, at, value)."""
        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, j, to, at, value, link in zip(*[pdf[c] for c in ("i", "j", "to", "at", "value", "links")]):
                    got = _times(np.frombuffer(at, np.int32), np.frombuffer(value), np.frombuffer(link, np.int32), side)
                    places = np.flatnonzero(got)
                    if len(places):
                        yield pd.DataFrame({"i": [i], "j": [to], "middle": [j], "at": [_entries(places)], "value": [got[places].tobytes()]})

        spread = left.withColumn("deal", F.col("i") % deals).repartition(width, "j", "deal")
        return spread.join(dealt, ["j", "deal"]).select("i", "j", "to", "at", "value", "links").mapInPandas(multiply, "i int, j int, middle int, at binary, value binary")

    def added(products: DataFrame, known: DataFrame, back: bool) -> DataFrame:
        """Sums of products at each place: where nothing of `known` is yet, or, going back, at the places of `known` as (i, j, at, paths, dep)."""
        names = ["i", "j", "at", "paths", "dep"] if back else ["i", "j", "at", "value"]

        def done(key: tuple, total: np.ndarray, before: list) -> pd.DataFrame | None:
            if back:
                if not before:
                    return None
                at, paths = before[0]
                return pd.DataFrame([[*key, at, paths, (total[np.frombuffer(at, np.int32)] * np.frombuffer(paths)).tobytes()]], columns=names)
            for at, _ in before:
                total[np.frombuffer(at, np.int32)] = 0.0
            places = np.flatnonzero(total)
            return pd.DataFrame([[*key, _entries(places), total[places].tobytes()]], columns=names) if len(places) else None

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, total, before = None, None, []
            for pdf in batches:
                for i, j, middle, at, value in zip(*[pdf[c] for c in ("i", "j", "middle", "at", "value")]):
                    if (i, j) != key:
                        if key and (out := done(key, total, before)) is not None:
                            yield out
                        key, total, before = (i, j), np.zeros(side * side), []
                    if middle < 0:
                        before.append((at, value))
                    else:
                        total[np.frombuffer(at, np.int32)] += np.frombuffer(value)
            if key and (out := done(key, total, before)) is not None:
                yield out

        known = known.select("i", "j", F.lit(-1).alias("middle"), "at", F.col("value") if back else F.lit(None).cast("binary").alias("value"))
        dealt_out = products.unionByName(known).repartition(width, "i", "j").sortWithinPartitions("i", "j", "middle")
        return dealt_out.mapInPandas(add, "i int, j int, at binary, paths binary, dep binary" if back else "i int, j int, at binary, value binary")

    def reached(level: DataFrame) -> int:
        return level.agg(F.coalesce(F.sum(F.length("at") / 4), F.lit(0.0)).cast("long").alias("n")).first()["n"]

    levels, left = [front], pairs - reached(front)
    while left > 0:
        front = stored(added(product(levels[-1]), functools.reduce(DataFrame.unionByName, levels), False))
        got = reached(front)
        if not got:
            break
        levels.append(front)
        left -= got

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["i", "j", "at"]].assign(value=[((1.0 + np.frombuffer(d)) / np.frombuffer(p)).tobytes() for p, d in zip(pdf["paths"], pdf["dep"])])

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for j, at, dep in zip(pdf["j"], pdf["at"], pdf["dep"]):
                sums = np.bincount(np.frombuffer(at, np.int32) % side, np.frombuffer(dep), side)
                yield pd.DataFrame({"n": j * side + np.flatnonzero(sums), "dep": sums[np.flatnonzero(sums)]})

    last, held, out = None, [], []
    for level, above in zip(levels[:1:-1], levels[-2:0:-1]):
        share = last.mapInPandas(shares, "i int, j int, at binary, value binary") if last is not None else level.mapInPandas(lambda batches: (pdf.assign(value=[(1.0 / np.frombuffer(p)).tobytes() for p in pdf["value"]]) for pdf in batches), "i int, j int, at binary, value binary")
        last = stored(added(product(share), above, True))
        held.append(last)
        out.append(last.mapInPandas(columns, "n long, dep double"))
    found = stored(functools.reduce(DataFrame.unionByName, out).groupBy("n").agg(F.sum("dep").alias("dep")).join(ids, "n").select(F.col("x").alias("v"), "dep")) if out else None
    forget(links, dealt, *levels, *held)
    return found


def weighted_degrees(relations: DataFrame) -> DataFrame:
    """(node, out_weight, in_weight) of typed relations (source, target, weight)."""
    ends = relations.select(F.col("source").alias("node"), F.col("weight").alias("o"), F.lit(0).alias("i")).union(relations.select("target", F.lit(0), "weight"))
    return ends.groupBy("node").agg(F.sum("o").alias("out_weight"), F.sum("i").alias("in_weight"))


def ancestors(tree: DataFrame, levels: int = 2) -> DataFrame:
    """(id, parent, grandparent...): the chain above each node of (id, parent_id), one join per level."""
    out = tree.select("id", F.col("parent_id").alias("up1"))
    for k in range(2, levels + 1):
        out = out.join(tree.select(F.col("id").alias(f"up{k - 1}"), F.col("parent_id").alias(f"up{k}")), f"up{k - 1}", "left")
    return out.select("id", *[f"up{k}" for k in range(1, levels + 1)])


def ranked(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows with the largest value and their rank, ties by node."""
    top = df.orderBy(F.desc(by), "node").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "node")).cast("long"))
