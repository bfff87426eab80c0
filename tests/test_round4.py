"""Queries that did not end, or filled the disk, over larger tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import agreement, evolution, graph, scaling, windows


def test_pruning_goes_through_stored_votes(spark, monkeypatch):
    """No step of the pruning is worked out again for the next one."""
    rows = [(e, v, "a_favor" if (e * v) % 3 else "en_contra", e % 2) for e in range(12) for v in range(12)]
    votes = spark.createDataFrame(rows, "vote_event_id long, voter_id long, option string, leg long").filter("voter_id + vote_event_id < 17")
    reads, keep = [], scaling.stored
    monkeypatch.setattr(scaling, "stored", lambda df: reads.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size()) or keep(df))
    got = {(r["leg"], r["voter_id"], r["vote_event_id"], r["y"]) for r in scaling.binary(votes, least_votes=4, least_voters=5, by=("leg",)).collect()}
    assert max(reads) <= 2
    want = {(g, v, e, int(o == "a_favor")) for e, v, o, g in rows if v + e < 17}
    lopsided = {e for e in range(12) for ys in [[y for *_, x, y in want if x == e]] if ys and max(sum(ys), len(ys) - sum(ys)) > 0.975 * len(ys)}
    want = {x for x in want if x[2] not in lopsided}
    for _ in range(2):
        for at, least in ((1, 4), (2, 5)):
            key = [(x[0], x[at]) for x in want]
            want = {x for x in want if key.count((x[0], x[at])) >= least}
    assert got == want and got


def test_likelihoods_come_with_the_voters(spark, monkeypatch):
    """A turn's votes are not gone through once more for the pairs of beta and w, and these are judged as by the model."""
    rng = np.random.default_rng(2)
    x, q, y = rng.normal(size=(50, 2)) * 0.5, rng.normal(size=(50, 4)) * 0.5, rng.integers(0, 2, 50)
    pairs = [(b, w) for b in (2.0, 8.0) for w in (0.3, 0.9)]
    want = [scaling.log_likelihood(x, q[:, :2], q[:, 2:], y, b, w).sum() for b, w in pairs]
    assert scaling.likelihoods(list(x.T), list(q.T), y, pairs) == pytest.approx(want)
    rows = spark.createDataFrame([(e % 2, e, v, (e + v) % 2, 0.1 * v, -0.1, 0.01 * e, 0.1, 0.3, 0.2) for e in range(12) for v in range(8)], "run long, event long, voter long, y int, x0 double, x1 double, q0 double, q1 double, q2 double, q3 double")
    known = {0: (8.0, 0.5), 1: (5.0, 0.4)}
    tried = scaling._candidates(known, {0: 1.6, 1: 1.2})
    for most in (100_000, 4):
        monkeypatch.setattr(scaling, "HOT", most)
        judged = scaling.half_turn(rows, "voter", known, 2, scaling._hot(rows, "voter"), tried)
        judged = judged.persist()
        votes, got = judged.toPandas(), scaling._likelihoods(judged)
        for r in known:
            v = votes[votes["run"] == r]
            at = v[["x0", "x1"]].to_numpy(), v[["q0", "q1"]].to_numpy(), v[["q2", "q3"]].to_numpy(), v["y"].to_numpy()
            assert len(v) == 48 and got[r] == pytest.approx([scaling.log_likelihood(*at, b, w).sum() for b, w in tried[r]])
        judged.unpersist()


def noise(spark, parts, n, seed):
    """Components of n nodes, all linked with weights that hold no communities, and one of three nodes."""
    rng = np.random.default_rng(seed)
    pairs = [(100 * c + i, 100 * c + k, float(rng.random())) for c in range(parts) for i in range(n) for k in range(i + 1, n)] + [(9000, 9001, 0.5), (9001, 9002, 0.25)]
    return pairs, spark.createDataFrame(pairs, "a long, b long, weight double")


def gains(pairs, at):
    """The most that a node gains by moving to a neighbour's community."""
    near, k = {}, {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})
            near[x][y] = near[x].get(y, 0.0) + w
            k[x] = k.get(x, 0.0) + w
    total, most = sum(k.values()), 0.0
    size = {c: sum(k[x] for x in k if at[x] == c) for c in set(at.values())}
    for x in near:
        into = {}
        for y, w in near[x].items():
            into[at[y]] = into.get(at[y], 0.0) + w
        gain = {c: into.get(c, 0.0) - (size[c] - (k[x] if c == at[x] else 0.0)) * k[x] / total for c in {*into, at[x]}}
        most = max(most, max(gain.values()) - gain[at[x]])
    return most


@pytest.mark.parametrize("held", [2_000_000, 1000, 0])
def test_communities_of_components_take_one_job(spark, monkeypatch, held):
    """Components that a task can hold need no rounds; by rounds or not, no node gains by moving in the end."""
    pairs, edges = noise(spark, 2, 60, 4)
    made, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: made.append(1) or keep(df))
    monkeypatch.setattr(graph, "HELD", held, raising=False)
    at = {r["node"]: r["community"] for r in graph.communities(edges).collect()}
    assert set(at) == {x for a, b, _ in pairs for x in (a, b)} and all(at[at[x]] == at[x] <= x for x in at)
    assert all((x < 100) == (c < 100) and (x < 9000) == (c < 9000) for x, c in at.items())
    assert gains(pairs, at) < 1e-6
    assert held < 2_000_000 or len(made) < 20


@pytest.mark.parametrize("sampled", [False, True])
def test_betweenness_by_blocks(spark, monkeypatch, sampled):
    """Dense components, one of them over several blocks and with a tail, beside a thin one: as by rows, and no rows of pairs are made."""
    rng = np.random.default_rng(6)
    pairs = {(c * 100 + i, c * 100 + k) for c, n in ((0, 40), (1, 23)) for i in range(n) for k in range(i + 1, n) if rng.random() < 0.5} | {(39, 40), (40, 41), (41, 42), (500, 501), (501, 502), (7, 7)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    sources = spark.createDataFrame([(0,), (5,), (41,), (100,), (501,)], "node long") if sampled else None
    monkeypatch.setattr(graph, "THICK", 1000, raising=False)
    want = {r["node"]: r["betweenness"] for r in graph.betweenness(edges, sources).collect()}
    thin, keep = [], getattr(graph, "_by_rows", None)
    monkeypatch.setattr(graph, "THICK", 10, raising=False)
    monkeypatch.setattr(graph, "SIDE", 16, raising=False)
    monkeypatch.setattr(graph, "_by_rows", lambda both, *rest: thin.append({r["x"] for r in both.collect()}) or keep(both, *rest), raising=False)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edges, sources).collect()}
    assert got == pytest.approx(want, abs=2e-6) and max(want.values()) > 0 and thin == [{500, 501, 502}]


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_products_of_blocks(share):
    rng = np.random.default_rng(1)
    left, right = rng.random((24, 24)) * (rng.random((24, 24)) < share), rng.random((24, 24)) < share
    at, links = np.flatnonzero(left).astype(np.int32), np.flatnonzero(right).astype(np.int32)
    assert graph._times(at, left.ravel()[at], links, 24) == pytest.approx((left @ right).ravel())


@pytest.mark.parametrize("most", [2**25, 10])
def test_edges_of_windows_are_not_stored(spark, monkeypatch, most):
    """Measures of windows are those of their edges, by themselves or where a window's pairs are too many for a task; no table holds an edge."""
    rng = np.random.default_rng(8)
    day = datetime.date(2020, 1, 1)
    rows = [(e, v, str(rng.choice(["a_favor", "en_contra", "abstencion", "ausente"])), int(v % 3 if e < 12 else v % 2), e // 20, day + datetime.timedelta(e)) for e in range(40) for v in range(9) if rng.random() < 0.6]
    votes = spark.createDataFrame(rows, "vote_event_id long, voter_id long, option string, grp long, leg long, start_date date").cache()
    bridge = windows.sliding(votes.withColumn("chamber", F.lit("D")).transform(windows.events), 8, 2).select("window_id", "vote_event_id", "leg", "start_date")
    # voter 8 has no part
    parties = lambda v: agreement.primary_party(v, ("window_id",)).withColumnRenamed("party", "part").filter("voter_id <> 8")
    made, keep = [], evolution.stored
    monkeypatch.setattr(evolution, "stored", lambda df: made.append(df.columns) or keep(df))
    monkeypatch.setattr(evolution, "WINDOW", most, raising=False)
    got = {r["window_id"]: r for r in evolution.bundle(votes, bridge, parties).collect()}
    assert not any({"a", "b"} <= set(columns) for columns in made)
    v = votes.join(bridge.select("window_id", "vote_event_id"), "vote_event_id")
    edges, parts = agreement.edges(v, ("window_id",)).cache(), parties(v).cache()
    size = {r["window_id"]: (r["n"], r["w"]) for r in edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w")).collect()}
    heights = {r["window_id"]: r["modularity"] for r in evolution.modularity(edges, parts).collect()}
    fronts = {r["window_id"]: r["frontier"] for r in evolution.frontier(edges, parts).collect()}
    assert len(got) == 8 and {w: (r["n_edges"], r["mean_weight"]) for w, r in got.items()} == pytest.approx({w: pytest.approx(x, abs=2e-6) for w, x in size.items()})
    assert {w: r["modularity"] for w, r in got.items()} == pytest.approx(heights, abs=2e-6) and {w: r["frontier"] for w, r in got.items()} == pytest.approx(fronts, abs=2e-6)
    order = sorted(got.values(), key=lambda r: (r["first"], r["window_id"]))
    assert order[0]["ari"] is None
    for before, now in zip(order, order[1:]):
        x, y = (parts.filter(F.col("window_id") == r["window_id"]) for r in (now, before))
        assert agreement.adjusted_rand(x, y).first()["ari"] == now["ari"]


def test_climbing_again_gets_higher():
    """Of noise, on which a first climb ends early; no node gains by moving in the end, and communities are named by their smallest nodes."""
    rng = np.random.default_rng(9)
    pairs = [(i, k, float(rng.random())) for i in range(90) for k in range(i + 1, 90)]
    a, b, w = (np.array(c) for c in zip(*pairs))
    label = lambda again: dict(zip(*(x.tolist() for x in graph._parted(a, b, w, 1.0, w.sum(), again))))

    def modularity(at):
        k = {c: sum(w for x, y, w in pairs for v in (x, y) if at[v] == c) for c in set(at.values())}
        return sum(w for x, y, w in pairs if at[x] == at[y]) / w.sum() - sum(v * v for v in k.values()) / (4 * w.sum() ** 2)

    once, more = label(0), label(8)
    assert modularity(more) > modularity(once) and gains(pairs, more) < 1e-6 and all(more[more[x]] == more[x] <= x for x in more)
