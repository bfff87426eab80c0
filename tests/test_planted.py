"""Small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.functions import rules
from plenum.operators import agreement, graph, linear, panel, power, quality, resolve, scaling, stats, tally, windows
from plenum.plans import catalog, catalog_graph
from plenum.sources import pages, store
from plenum.streaming import ingest

VOTE = "vote_event_id long, voter_id long, option string, grp long, leg long, start_date date, chamber string, requirement string"


@pytest.fixture(scope="module")
def blocks(spark):
    """Two parties of six that always vote against each other."""
    import datetime

    rows = [(e, v, "a_favor" if (v < 6) == (e % 2 == 0) else "en_contra", 0 if v < 6 else 1, 0, datetime.date(2020, 1, 1) + datetime.timedelta(e), "D", "mayoria_simple") for e in range(20) for v in range(12)]
    return spark.createDataFrame(rows, VOTE).cache()


def test_two_blocks(spark, blocks):
    e = agreement.edges(blocks)
    assert e.count() == 30 and e.filter("weight <> 1").count() == 0
    found = {r["node"]: r["community"] for r in graph.communities(e).collect()}
    assert {found[v] for v in range(6)} == {0} and {found[v] for v in range(6, 12)} == {6}
    parts = agreement.primary_party(blocks).select("voter_id", F.col("party").alias("part"))
    assert agreement.modularity(e, parts).first()["modularity"] == 0.5
    assert agreement.adjusted_rand(parts, parts.withColumn("part", 1 - F.col("part"))).first()["ari"] == 1.0


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert got == {1: 0.0, 2: pytest.approx(4 / 6, abs=1e-6), 3: pytest.approx(4 / 6, abs=1e-6), 4: 0.0}
    assert {r["node"]: r["component"] for r in graph.components(e.union(spark.createDataFrame([(9, 8)], "a long, b long"))).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


@pytest.mark.parametrize("seats, shapley, banzhaf", [((3, 2, 2), (33.33, 33.33, 33.33), (33.33, 33.33, 33.33)), ((50, 49, 1), (66.67, 16.67, 16.67), (60.0, 20.0, 20.0))])
def test_power(spark, seats, shapley, banzhaf):
    df = spark.createDataFrame(list(enumerate(seats)), "grp long, seats long")
    got = {r["grp"]: r for r in power.indices(df).filter("quota_kind = 'simple'").collect()}
    assert tuple(got[i]["shapley"] for i in range(3)) == shapley and tuple(got[i]["banzhaf"] for i in range(3)) == banzhaf


def test_outcomes(spark):
    cases = [(2, 1, 0, "mayoria_simple", "aprobada"), (1, 1, 5, "mayoria_simple", "empate"), (0, 0, 0, "mayoria_simple", "rechazada"), (2, 1, 0, "mayoria_calificada", "aprobada"), (2, 1, 1, "mayoria_calificada", "rechazada"), (0, 0, 0, "mayoria_calificada", "rechazada"), (1, 2, 0, "otra", "rechazada")]
    df = spark.createDataFrame(cases, "f int, c int, a int, r string, want string")
    assert df.filter(rules.outcome(F.col("f"), F.col("c"), F.col("a"), F.col("r")) != F.col("want")).count() == 0


def test_texts(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(rules.name_key(F.lit("  Álvarez   Villaseñor "))) == "alvarez villasenor"
    assert [get(rules.spelled_date(F.lit(t))) for t in ("10 Diciembre 2024", "2024-12-10", "10/12/2024", "5 Enero 2024", "", "mañana")] == ["2024-12-10", "2024-12-10", "2024-12-10", "2024-01-05", "", "mañana"]
    assert [get(rules.numeric_date(F.lit(t))) for t in ("31/03/2026", "no-es-fecha", "31/02/2026")] == ["2026-03-31", "", ""]
    assert [get(rules.option_of_deputy(F.lit(t))) for t in ("A favor", "En contra", "Ausente", "Abstención", "Solo asistencia", "?")] == ["a_favor", "en_contra", "ausente", "abstencion", "abstencion", "ausente"]
    assert get(rules.sort_key(F.lit("Pérez López, Juan"))) == "juan perez lopez" and get(rules.given_name(F.lit("Pérez, Ana María"))) == "ana"


def test_pivotal_party(spark):
    import datetime

    rows = [(1, v, "a_favor" if v < 60 else "en_contra", 0 if v < 40 else 1 if v < 60 else 2, 0, datetime.date(2020, 1, 1), "D", "mayoria_simple") for v in range(100)]
    got = {r["grp"]: r["critical"] for r in tally.critical_parties(spark.createDataFrame(rows, VOTE)).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_windows(spark, blocks):
    ev = windows.events(blocks)
    got = sorted((r["window_id"], r["n_events"]) for r in windows.windows_of(windows.sliding(ev, 8, 3)).collect())
    assert got == [("0/0", 8), ("0/1", 8), ("0/2", 8), ("0/3", 5)]
    merged = windows.windows_of(windows.merge_small(windows.sliding(ev, 8, 3), 9)).collect()
    assert merged and all(r["n_events"] >= 9 for r in merged)
    with pytest.raises(ValueError):
        windows.build(ev, "other")


def test_as_of(spark):
    spans = spark.sql("select * from values (1, date '2020-01-01', date '2020-06-30', 'A'), (1, date '2020-06-01', date '2020-12-31', 'B'), (1, date '2022-01-01', null, 'C') as t(who, start, end, org)")
    points = spark.sql("select * from values (1, date '2019-01-01'), (1, date '2020-03-01'), (1, date '2020-06-15'), (1, date '2021-10-01'), (1, date '2030-01-01'), (2, date '2020-01-01') as t(who, day)")
    got = [(r["org"], r["how"]) for r in resolve.as_of(points, spans, "who", "day").orderBy("who", "day").collect()]
    assert got == [("A", "nearest"), ("A", "inside"), ("B", "inside"), ("C", "nearest"), ("C", "inside"), (None, "none")]


def test_statistics(spark):
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and stats.t_two_sided(0.0, 5) == pytest.approx(1.0)
    df = spark.createDataFrame([(0, "F", float(v)) for v in (1, 2, 3, 4)] + [(0, "M", float(v)) for v in (3, 5, 6)], "k int, g string, v double")
    r = stats.mann_whitney(df, ["k"], "g", "F", "M", "v").first()
    assert r["u"] == 1.5
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "x double, y double"), "x", "y").first()["rho"] == 1.0


def test_rotation_is_undone(spark):
    rng = np.random.default_rng(0)
    p = rng.standard_normal((30, 2))
    a = 0.7
    q = 2.5 * p @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]) + [3.0, -1.0]
    frame = lambda m: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(m)], "voter_id long, d1 double, d2 double")
    got, how = scaling.align(frame(q), frame(p))
    back = np.array([[r["d1"], r["d2"]] for r in got.orderBy("voter_id").collect()])
    assert np.abs(back - p).max() < 1e-9 and how["disparity"] < 1e-9


def test_chain_of_runs(spark):
    """Three runs turned and shifted, the third with the first alone by common voters of the second too few."""
    rng = np.random.default_rng(2)
    p = rng.standard_normal((30, 2))
    p -= p.mean(0)
    turn = lambda a: np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    runs = {0: (p, range(30)), 1: (p @ turn(1.0) * 3 + 5, range(30)), 2: (p @ turn(2.0) + 1, range(4)), 3: (p @ turn(-0.5) * 0.2, range(30))}
    rows = [(r, v, float(m[v, 0]), float(m[v, 1])) for r, (m, who) in runs.items() for v in who]
    got, how = scaling.align_runs(spark.createDataFrame(rows, "run long, voter_id long, d1 double, d2 double"))
    at = {(r["run"], r["voter_id"]): (r["d1"], r["d2"]) for r in got.collect()}
    for r in (1, 3):
        assert np.abs(np.array([at[r, v] for v in range(30)]) - p).max() < 1e-9 and how[r]["disparity"] < 1e-9
    assert how[3]["onto"] == 1 and how[2]["disparity"] is None
    assert np.abs(np.array([at[2, v] for v in range(4)]).mean(0) - p[:4].mean(0)).max() < 1e-9


def test_singular_vectors(spark):
    """Against a dense decomposition of the filled and centred matrix, two runs at once."""
    rng = np.random.default_rng(0)
    rows = [(r, v, e, int(rng.random() < 0.5 + 0.4 * ((v + e + r) % 2))) for r in (3, 5) for v in range(16) for e in range(25) if rng.random() < 0.7]
    u, values = linear.centred_svd(spark.createDataFrame(rows, "run long, voter_id long, vote_event_id long, y int"), rounds=40, tolerance=1e-9)
    got = {(r["run"], r["voter_id"]): (r["c0"], r["c1"]) for r in u.collect()}
    for run in (3, 5):
        m = np.full((16, 25), 0.5)
        for r, v, e, y in rows:
            if r == run:
                m[v, e] = y
        left, size, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
        assert values[run] == pytest.approx(size[:2], rel=1e-6)
        assert np.abs(np.abs([got[run, v] for v in range(16)]) - np.abs(left[:, :2] * size[:2])).max() < 1e-2


def drawn_votes(runs, n_voters, n_events, seed):
    """Places of voters, and votes drawn from the model."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-0.7, 0.7, (n_voters, 2))
    rows = []
    for run in runs:
        for e in range(n_events):
            o, p = (np.tile(rng.uniform(-0.5, 0.5, 2), (n_voters, 1)) for _ in range(2))
            yea = np.exp(scaling.log_likelihood(x, o, p, np.ones(n_voters), 8.0, 0.8))
            rows += [(run, v, 1000 * run + e, int(rng.random() < yea[v])) for v in range(n_voters) if rng.random() < 0.9]
    return x, rows


@pytest.mark.parametrize("hot", [100_000, 45])
def test_scaling_recovers_places(spark, monkeypatch, hot):
    """Places up to a linear map, for two runs in the same jobs; also where groups are spread over tasks."""
    monkeypatch.setattr(scaling, "HOT", hot)
    x, rows = drawn_votes((1, 2) if hot > 1000 else (1,), 50, 120, 3)
    b = spark.createDataFrame(rows, "run long, voter_id long, vote_event_id long, y int").cache()
    voters, events, how = scaling.scale_runs(b, **({} if hot > 1000 else {"iterations": 12}))
    assert hot < 1000 or all(f["converged"] for f in how.values())
    for run in how:
        got = {r["voter_id"]: r["x"] for r in voters.filter(F.col("run") == run).collect()}
        a = np.c_[np.array([got[v] for v in range(50)]), np.ones(50)]
        rest = x - a @ np.linalg.lstsq(a, x, rcond=None)[0]
        assert 1 - (rest**2).sum() / ((x - x.mean(0)) ** 2).sum() > 0.85
    fit = {r["run"]: r for r in scaling.fit_runs(b, voters, events, how).collect()}
    assert all(fit[r]["classified"] > 0.8 and (hot < 1000 or fit[r]["log_likelihood"] == pytest.approx(how[r]["log_likelihood"], rel=1e-6)) for r in how)


def test_slopes_of_the_model():
    rng = np.random.default_rng(6)
    x, o, p = (rng.standard_normal((40, 2)) * 0.5 for _ in range(3))
    y, beta, w = rng.integers(0, 2, 40), np.full(40, 5.0), np.full(40, 0.6)
    _, rise, _, in_x, in_p = scaling.slopes(x, o, p, y, beta, w)
    h = 1e-3
    for k in range(2):
        d = np.zeros(2)
        d[k] = h
        assert np.allclose((scaling.log_likelihood(x + d, o, p, y, beta, w) - scaling.log_likelihood(x - d, o, p, y, beta, w)) / (2 * h), rise * in_x[:, k], atol=2e-3)
        assert np.allclose((scaling.log_likelihood(x, o, p + d, y, beta, w) - scaling.log_likelihood(x, o, p - d, y, beta, w)) / (2 * h), rise * in_p[:, k], atol=2e-3)


def test_loading_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 1, "c")], "e long, v long, o string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        ingest.append_new(ingest.read(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), ["e", "v"], str(tmp_path / f"state{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert store.new_rows(rows, rows, ["e", "v"]).count() == 0


def test_pages(spark):
    html = '<table><tr><td>1</td><td><a href="p?iddipt=500&pert=1">ANA <b>RUIZ</b></a></td><td>A favor</td></tr><tr><td>2</td><td>JUAN</td><td>Ausente</td></tr></table>'
    got = [tuple(r) for r in pages.nominal_votes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()]
    assert got == [(1, 1, "ANA RUIZ", 500, "a_favor"), (1, 2, "JUAN", None, "ausente")]


def test_quality_and_panel(spark, blocks):
    assert quality.keep_first(blocks.union(blocks), ["vote_event_id", "voter_id"], ["option"]).count() == 240
    d = panel.discipline(blocks)
    assert d.filter("discipline <> 1").count() == 0 and d.count() == 12


def test_components_of_a_long_chain(spark):
    """A small id at each end: the smaller one must come all the way."""
    chain = [10, *range(1000, 1100), 5]
    pairs = list(zip(chain, chain[1:])) + [(2000, 2001), (3000, 3000)]
    e = spark.createDataFrame(pairs, "a long, b long")
    want = dict.fromkeys(chain, 5) | {2000: 2000, 2001: 2000}
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == want | {3000: 3000}


def all_betweenness(pairs):
    """By counting shortest paths through each node for each pair of ends."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far = {}
    for s in near:
        d, paths, line = {s: 0}, {s: 1}, [s]
        for v in line:
            for u in near[v]:
                if u not in d:
                    d[u], paths[u] = d[v] + 1, 0
                    line.append(u)
                if d[u] == d[v] + 1:
                    paths[u] += paths[v]
        far[s] = (d, paths)
    n, got = len(near), dict.fromkeys(near, 0.0)
    for s, (d, paths) in far.items():
        for t in d:
            for v in d:
                if s != t and v not in (s, t) and t in far[v][0] and d[v] + far[v][0][t] == d[t]:
                    got[v] += paths[v] * far[v][1][t] / paths[t]
    return {v: x / ((n - 1) * (n - 2)) for v, x in got.items()}


def test_betweenness_of_dense_and_thin_parts(spark):
    rng = np.random.default_rng(5)
    pairs = {(a, b) for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.8} | {(23, 24), (24, 25), (3, 24)}
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == pytest.approx(all_betweenness(pairs), abs=2e-6)


def test_graph_queries_use_all_agreement(spark, monkeypatch):
    """Two events that share voter 5, and voter 10 that agrees with voter 9 alone, in one event of two."""
    import datetime

    sides = [(0, v, "a_favor") for v in range(1, 6)] + [(1, v, "a_favor") for v in range(5, 10)] + [(2, 9, "a_favor"), (2, 10, "a_favor"), (3, 9, "a_favor"), (3, 10, "en_contra")]
    rows = [(e, v, o, 0, 0, datetime.date(2020, 1, 1), "D", "mayoria_simple") for e, v, o in sides]
    monkeypatch.setattr(catalog_graph, "votes", lambda s, d: spark.createDataFrame(rows, VOTE))
    pairs = [(a, b) for g in (range(1, 6), range(5, 10)) for a in g for b in g if a < b] + [(9, 10)]
    got = {r["node"]: r["betweenness"] for r in catalog.QUERIES["betweenness"](spark, "").collect()}
    assert got == pytest.approx(all_betweenness(pairs), abs=2e-6) and got[5] > 0.5
    parts = {r["node"]: r["community"] for r in catalog.QUERIES["communities"](spark, "").collect()}
    assert set(parts) == set(range(1, 11)) and len({parts[v] for v in range(1, 5)}) == len({parts[v] for v in range(6, 11)}) == 1 and parts[1] != parts[9]


def test_communities_rise_until_none_moves(spark):
    """Forty cliques in a ring."""
    pairs = [(5 * c + i, 5 * c + j, 1.0) for c in range(40) for i in range(5) for j in range(i + 1, 5)] + [(5 * c, (5 * c + 7) % 200, 1.0) for c in range(40)]
    e = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "a long, b long, weight double")
    parts = graph.communities(e).select(F.col("node").alias("voter_id"), F.col("community").alias("part"))
    assert agreement.modularity(e, parts).first()["modularity"] > 0.86


def test_scaling_queries(spark, monkeypatch):
    """Terms are runs of one scaling, and all terms one run with labels; as many turns as it takes."""
    import datetime

    rows = [(20 * g + e, v, "a_favor" if (v < 12) == (e % 2 == 0) else "en_contra", 0, g, datetime.date(2020, 1, 1), "D", "mayoria_simple") for g in (2, 3) for e in range(10 + g) for v in range(24)]
    monkeypatch.setattr(catalog_graph, "votes", lambda s, d: spark.createDataFrame(rows, VOTE))
    calls = []

    def scale_runs(b, dims=2, **options):
        runs = sorted(r["run"] for r in b.select("run").distinct().collect())
        calls.append((runs, options))
        side = F.when(F.col("run") == 3, -1.0).otherwise(1.0)
        x, y = (F.col("voter_id") - 11.5) * side, (F.col("voter_id") % 5) * side
        return b.select("run", "voter_id").distinct().select("run", "voter_id", F.array(x.cast("double"), y.cast("double")).alias("x")), b.select("run"), {r: {"converged": True} for r in runs}

    monkeypatch.setattr(scaling, "scale_runs", scale_runs)
    got = {(r["leg"], r["voter_id"]): (r["d1"], r["d2"]) for r in catalog.QUERIES["aligned_terms"](spark, "").collect()}
    assert calls == [([2, 3], {})] and len(got) == 48
    assert all(got[3, v] == pytest.approx(got[2, v]) for v in range(24))
    one = catalog.QUERIES["scaled_voters"](spark, "").collect()
    assert calls[1] == ([0], {}) and {r["label"] for r in one} == {3} and len(one) == 24


def test_fuzzy_names_of_other_initials(spark):
    """More names in a block than a part holds; the one of another last initial is the best."""
    left = spark.createDataFrame([(i, f"customer of {i:04d}") for i in range(2500)] + [(9000, "ana lopez r"), (9001, "customer of 0007")], "c long, name string")
    right = spark.createDataFrame([(1, "customer of 9007"), (2, "customer of 9007"), (3, "ana lopez q"), (4, "eva lopez r")], "k long, name string")
    got = {r["c"]: (r["k"], r["score"]) for r in resolve.fuzzy(left, right, "c", "k").collect()}
    assert got[7] == got[9001] == (1, 0.9375) and got[9000] == (3, round(10 / 11, 6))
    near = [i for i in range(2500) if sum(a != b for a, b in zip(f"{i:04d}", "9007")) <= 2]
    assert set(near) <= set(got)


def test_communities_of_each_window(spark):
    """Three windows in one loop: two cliques, three cliques, and one pair; and the measures of each."""
    from plenum.operators import evolution

    def cliques(w, groups):
        at = [(w, min(a, b), max(a, b), 1.0) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]]
        return at + [(w, min(g[0], h[1]), max(g[0], h[1]), 0.3) for g, h in zip(groups, groups[1:])]

    one, two = [list(range(6)), list(range(6, 12))], [list(range(0, 12, 3)), list(range(1, 12, 3)), list(range(2, 12, 3))]
    rows = cliques("a", one) + cliques("b", two) + [("c", 1, 2, 1.0), ("c", 3, 4, 0.5)]
    edges = spark.createDataFrame(rows, "window_id string, a long, b long, weight double").cache()
    parts = evolution.communities(edges)
    got = {(r["window_id"], r["voter_id"]): r["part"] for r in parts.collect()}
    assert got == {(w, v): min(g) for w, groups in (("a", one), ("b", two), ("c", [[1, 2], [3, 4]])) for g in groups for v in g}
    each = {r["window_id"]: r["modularity"] for r in evolution.modularity(edges, parts).collect()}
    for w in "abc":
        whole = agreement.modularity(edges.filter(F.col("window_id") == w), parts.filter(F.col("window_id") == w).select("voter_id", "part")).first()["modularity"]
        assert each[w] == pytest.approx(whole, abs=2e-6)


def test_communities_of_windows_as_of_one_graph(spark):
    """A ring of cliques as one window rises as high as by itself."""
    from plenum.operators import evolution

    pairs = [(5 * c + i, 5 * c + j, 1.0) for c in range(12) for i in range(5) for j in range(i + 1, 5)] + [(5 * c, (5 * c + 7) % 60, 1.0) for c in range(12)]
    e = spark.createDataFrame([("w", min(a, b), max(a, b), w) for a, b, w in pairs], "window_id string, a long, b long, weight double")
    assert evolution.modularity(e, evolution.communities(e)).first()["modularity"] > 0.8


def test_a_batch_given_again_changes_nothing(spark, tmp_path):
    """Edges by batches, one of them repeated and one repeated after a failure, equal those of all votes at once."""
    rng = np.random.default_rng(9)
    rows = [(e, v, ["a_favor", "en_contra", "abstencion", "ausente"][rng.integers(4)]) for e in range(6) for v in range(8)]
    frame = lambda r: spark.createDataFrame(r, ingest.VOTE)
    folder = str(tmp_path / "edges")
    first, second, third = rows[::3], rows[1::3] + rows[:6], rows[2::3]
    ingest.merge_agreement(frame(first), 0, folder)
    ingest.merge_agreement(frame(second), 1, folder)
    ingest.merge_agreement(frame(second), 1, folder)
    ingest.merge_agreement(frame(third), 2, folder)
    frame(third[:1]).write.mode("overwrite").parquet(f"{folder}/votes/batch=2")  # as left by a task that was lost
    ingest.merge_agreement(frame(third), 2, folder)
    got = {tuple(r) for r in ingest.agreement_so_far(spark, folder).collect()}
    want = {tuple(r) for r in agreement.agreement(frame(rows)).select("a", "b", "n_shared", "n_agree").collect()}
    assert got == want and ingest.agreement_so_far(spark, str(tmp_path / "none")).count() == 0


def test_order_over_ranges(spark):
    """Numbers, sums and ranks along an order that many partitions share."""
    from plenum.operators import order

    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 400), rng.integers(0, 25, 400))]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    got = [(r["k"], r["v"], r["n"]) for r in order.numbered_rows(df, ["k", "v"]).orderBy("n").collect()]
    assert [n for _, _, n in got] == list(range(1, 401)) and [g[:2] for g in got] == sorted(rows)
    sums = order.sum_before(df.distinct(), ["k", "v"], "v", "s").collect()
    assert all(r["s"] == sum(v for k, v in set(rows) if (k, v) < (r["k"], r["v"])) for r in sums)
    for keys in ([], ["k"]):
        for r in order.average_ranks(df, keys, "v").distinct().collect():
            own = [v for k, v in rows if not keys or k == r["k"]]
            assert r["rank"] == sum(v < r["v"] for v in own) + (own.count(r["v"]) + 1) / 2


def test_as_of_by_brute_force(spark):
    """Nested, overlapping, repeated and open spans of few keys, one of which has most rows."""
    import datetime

    rng = np.random.default_rng(11)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(int(n))
    spans = []
    for _ in range(120):
        s = rng.integers(0, 300)
        spans.append((int(rng.choice([1, 1, 1, 2, 3])), day(s), None if rng.random() < 0.05 else day(s + rng.integers(0, 40)), "ABCDEF"[rng.integers(6)]))
    points = [(int(rng.choice([1, 1, 2, 3, 4])), day(rng.integers(-20, 360)), i) for i in range(300)] + [(None, day(1), 300), (1, None, 301)]
    got = {r["i"]: (r["org"], r["how"]) for r in resolve.as_of(spark.createDataFrame(points, "who long, day date, i long").repartition(4), spark.createDataFrame(spans, "who long, start date, end date, org string").repartition(3), "who", "day").collect()}
    for who, at, i in points:
        own = [x for x in spans if x[0] == who] if at else []
        holds = [(-x[1].toordinal(), x[3]) for x in own if x[1] <= at <= (x[2] or datetime.date.max)]
        near = [(abs((x[1] - at).days), x[3]) for x in own]
        assert got[i] == ((min(holds)[1], "inside") if holds else (min(near)[1], "nearest") if near else (None, "none")), (who, at)
    assert len(got) == len(points)


def test_word_overlap_by_brute_force(spark):
    rng = np.random.default_rng(12)
    stock = ["ana", "de", "maria", "lopez", "garcia", "perez", "ruiz", "gil", "hernandez", "del", "cruz", "eva"]
    name = lambda: " ".join(["maria"] * (rng.random() < 0.8) + list(rng.choice(stock, rng.integers(1, 5))))
    left, right = [(i, name()) for i in range(40)] + [(40, None), (41, "")], [(100 + i, name()) for i in range(30)]
    words = lambda t: {w for w in (t or "").split(" ") if len(w) >= 3}
    want = {}
    for i, a in left:
        fits = [(-(len(s) + 0.5 * sum(len(w) >= 5 for w in s)), k) for k, b in right if len(s := words(a) & words(b)) >= 2]
        fits = [x for x in fits if -x[0] >= 3]
        if fits:
            want[i] = (min(fits)[1], -min(fits)[0])
    got = {r["l"]: (r["r"], r["score"]) for r in resolve.overlap(spark.createDataFrame(left, "l long, name string"), spark.createDataFrame(right, "r long, name string"), "l", "r").collect()}
    assert got == want and len(want) > 10


def test_neighbours_in_one_pass(spark):
    """No frame that shrinks from row to row, as each row would go through all rows after it; values as by hand."""
    from plenum.operators import order

    rng = np.random.default_rng(4)
    rows = [(i, int(v) if v > 3 else None) for i, v in enumerate(rng.integers(0, 9, 300))]
    got = order.neighbours(spark.createDataFrame(rows, "i long, v long").repartition(5), ["i"], "v", "prev", "next", "v", "most")
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    for r in got.collect():
        past, rest = [v for i, v in rows if i <= r["i"] and v is not None], [v for i, v in rows if i > r["i"] and v is not None]
        assert (r["prev"], r["next"], r["most"]) == (past[-1] if past else None, rest[0] if rest else None, max(past, default=None))


def test_profile_pages_are_dealt_out(spark, tiny):
    """One small file of customers makes many pages; more than one task reads them."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("senator_profiles", "deputy_profiles", "labelled_cells"):
        assert catalog.QUERIES[name](spark, tiny).rdd.getNumPartitions() == width > 1


@pytest.mark.parametrize("most", [3, 500])
def test_agreement_of_lists(spark, monkeypatch, most):
    """Pairs of large events go on over several lists; what is shuffled has no row per pair."""
    monkeypatch.setattr(agreement, "LIST", most)
    rng = np.random.default_rng(6)
    rows = [(g, e, v, ["a_favor", "en_contra", "abstencion", "ausente"][rng.integers(4)], bool(rng.random() < 0.3)) for g in (0, 1) for e in range(5) for v in range(e, 11) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "leg long, vote_event_id long, voter_id long, option string, late boolean").repartition(3)
    for fresh in (None, "late"):
        want = {}
        for g, e, a, x, f in rows:
            for h, i, b, y, k in rows:
                if (g, e) == (h, i) and a < b and "ausente" not in (x, y) and (not fresh or f or k):
                    n = want.get((g, a, b), (0, 0))
                    want[g, a, b] = (n[0] + 1, n[1] + (x == y))
        pairs = agreement.agreement(df, ("leg",), fresh)
        assert {tuple(r)[:3]: tuple(r)[3:] for r in pairs.collect()} == want
    plan = agreement.agreement(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and not any("hashpartitioning(a#" in s and ", b#" in s.split("hashpartitioning(a#")[1].split(")")[0] for s in plan.splitlines())


def test_betweenness_of_many_components(spark, monkeypatch):
    """Cliques that lack an edge: what other cliques hold does not make a source go through its own clique's edges once more."""
    pairs = {(20 * c + i, 20 * c + j) for c in range(6) for i in range(9) for j in range(i + 1, 9) if (i, j) != (0, 1)}
    plans, keep = [], graph.stored

    def stored(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "stored", stored)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == pytest.approx(all_betweenness(pairs), abs=2e-6)
    assert any("explode" in p and "LeftAnti" in p for p in plans) and not any("Cross" in p for p in plans)


def test_communities_of_noise_take_few_rounds(spark, monkeypatch):
    """All nodes linked with weights that hold no communities: blocks move as wholes, so rounds stay few, and no node gains by moving in the end."""
    n, made, stored = 120, [], graph.stored
    rng = np.random.default_rng(3)
    weight = np.triu(rng.random((n, n)), 1)
    e = spark.createDataFrame([(i, k, float(weight[i, k])) for i in range(n) for k in range(i + 1, n)], "a long, b long, weight double")
    monkeypatch.setattr(graph, "stored", lambda df: made.append(1) or stored(df))
    at = {r["node"]: r["community"] for r in graph.communities(e).collect()}
    assert len(made) < 100
    weight = weight + weight.T
    label, k = np.array([at[i] for i in range(n)]), weight.sum(1)
    for v in range(n):
        others = np.arange(n) != v
        gain = {c: weight[v, label == c].sum() - k[label == c][others[label == c]].sum() * k[v] / k.sum() for c in set(label)}
        assert gain[label[v]] >= max(gain.values()) - 1e-6


def test_agreement_of_ids_near_and_far(spark):
    """Lists hold distances in a narrow type, and ids that lie too far apart as they are."""
    ids = [-(2**63), -5, 0, 3, 4097, 4098, 2**28 + 2, 2**28 + 3, 2**62, 2**63 - 1]
    options = ["a_favor", "en_contra", "abstencion"]
    rows = [(e, v, options[(e * i + i * i) % 3], i % 2 == 0) for e in range(4) for i, v in enumerate(ids) if (e + i) % 4]
    for fresh in (None, "fresh"):
        want = {}
        for e, v, o, f in rows:
            for d, u, p, g in rows:
                if e == d and v < u and (not fresh or f or g):
                    shared, agree = want.get((v, u), (0, 0))
                    want[v, u] = (shared + 1, agree + (o == p))
        got = agreement.agreement(spark.createDataFrame(rows, "vote_event_id long, voter_id long, option string, fresh boolean"), fresh=fresh).collect()
        assert {(r["a"], r["b"]): (r["n_shared"], r["n_agree"]) for r in got} == want and len(got) == len(want)


def test_settled_groups_climb_no_further(monkeypatch):
    """A group whose steps gain nothing any more costs no further passes over its votes, and ends where it is best."""
    rng = np.random.default_rng(5)
    group, y = np.repeat(np.arange(50), 30), (rng.random(1500) < 0.5).astype(int)
    other, own, at = rng.normal(size=(1500, 4)) * 0.3, np.zeros((50, 2)), (np.full(50, 8.0), np.full(50, 0.5))
    best = scaling.climb("voter", own, group, other, y, *at, steps=60)
    passed, sums = [], scaling._sums
    monkeypatch.setattr(scaling, "_sums", lambda side, own, group, other, y, *rest: passed.append(len(y)) or sums(side, own, group, other, y, *rest))
    again = scaling.climb("voter", best, group, other, y, *at)
    assert sum(passed) < 5 * len(y)
    value = [sums("voter", v, group, other, y, *at)[0] + scaling._bounds("voter", v)[0] for v in (best, again)]
    assert (value[1] >= value[0]).all() and np.allclose(value[0], value[1], rtol=1e-4)
    z = np.linspace(-12, 12, 4001)
    assert np.allclose(scaling.normal_cdf(z), [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], atol=1e-8)


def _tasks(df):
    return df._jdf.queryExecution().executedPlan().execute().getNumPartitions()


def test_tasks_of_agreement_follow_the_pairs(spark, monkeypatch):
    """120 voters in each of 10 events: their 71,400 pairs are counted in more tasks than a shuffle has, also where an event has several lists."""
    rows = [(e, 3 * u, "a_favor" if (e + u) % 3 else "en_contra") for e in range(10) for u in range(120)]
    votes = spark.createDataFrame(rows, "vote_event_id long, voter_id long, option string").cache()
    want = {(3 * a, 3 * b): (10, sum(((e + a) % 3 == 0) == ((e + b) % 3 == 0) for e in range(10))) for a in range(120) for b in range(a + 1, 120)}
    monkeypatch.setattr(agreement, "PAIRS", 1000, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for size in (500, 50):
            monkeypatch.setattr(agreement, "LIST", size)
            got = agreement.agreement(votes)
            assert _tasks(got) == 72
            assert {(r["a"], r["b"]): (r["n_shared"], r["n_agree"]) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_edges_are_not_shuffled_for_parties(spark, monkeypatch):
    """Parties come along in the voters' numbers; without room for them edges are joined. A voter without party stays."""
    rows = [(1, u, "a_favor", g) for u, g in ((-7, 20), (2, None), (5, 30), (2**40, 20))] + [(2, u, "en_contra", g) for u, g in ((-7, 20), (5, 30))] + [(3, 9, "ausente", 30)]
    far = [(1, -(2**63), "a_favor", 20), (1, 2**63 - 1, "a_favor", 30)]
    schema = "vote_event_id long, voter_id long, option string, grp long"
    show = lambda df: {tuple(r) for r in df.select("a", "b", "party_a", "party_b", "n_shared").collect()}
    ends = {-7: 20, 2: None, 5: 30, 2**40: 20}
    want = {(a, b, ends[a], ends[b], 2 if (a, b) == (-7, 5) else 1) for a in ends for b in ends if a < b}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        e = agreement._between_parties(spark.createDataFrame(rows, schema))
        plan = e._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan[: plan.index("posexplode")]
        assert show(e) == want
        assert show(agreement._between_parties(spark.createDataFrame(far, schema))) == {(-(2**63), 2**63 - 1, 20, 30, 1)}
        monkeypatch.setattr(agreement, "PARTIES", 1)
        assert show(agreement._between_parties(spark.createDataFrame(rows, schema))) == want
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_batches_have_files_for_tasks(spark, tiny, monkeypatch):
    """A batch of the stream of votes is not one file that one task writes and reads; nothing is lost or doubled."""
    from plenum.plans import catalog_graph

    monkeypatch.setattr(agreement, "VOTES", 500, raising=False)
    stream, path = catalog_graph._arriving(spark, tiny, copies=2)
    n = spark.read.parquet(path).count() // 2
    files = -(-n // 1500)
    assert files > 1 and len(spark.read.parquet(path).inputFiles()) > 6
    got = catalog_graph.stream_votes(spark, tiny)
    assert got.count() == n == got.select("vote_event_id", "voter_id").distinct().count()
