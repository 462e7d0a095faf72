import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from duolist.config import AlsConfig, BiasedMfConfig, GraphConfig, PrepConfig
from duolist.operators import graph, models, strata
from duolist.schema import drop_table, shared_table

LIKES = [(1, 10), (1, 20), (2, 10), (2, 30), (3, 20), (3, 40)]
TOY = [(10, 100), (10, 200), (20, 200), (20, 300), (30, 100), (30, 400), (40, 300), (40, 500)]


def edges(spark, rows=LIKES):
    return spark.createDataFrame(rows, "userId long, movieId long")


def test_neighbours(spark):
    near = models.item_neighbours(edges(spark), 100, 0.0)
    sim = {(r.src, r.cand): r.similarity for r in near.collect()}
    assert sim[10, 20] == pytest.approx(0.5) and sim[10, 30] == pytest.approx(2**-0.5) and sim[20, 40] == pytest.approx(2**-0.5)
    assert [r.cand for r in near.where("src = 10").orderBy("rank").collect()] == [30, 20] and all(a != b for a, b in sim)
    scores = {r.movieId: r.score for r in models.neighbour_scores(edges(spark).where("userId = 1"), near, 100).collect()}
    assert scores[30] > 0 and scores[40] > 0
    profile = {r.movieId: r.score for r in models.profile_scores(spark.createDataFrame([(10,), (77,)], "movieId long"), near, 100).collect()}
    assert profile[30] > 0 and 40 not in profile
    assert max(r.similarity for r in models.item_neighbours(edges(spark), 100, 10.0).collect()) < max(sim.values())
    with pytest.raises(ValueError):
        models.profile_scores(spark.createDataFrame([(77,)], "movieId long"), near, 100)


def test_als_solves_the_normal_equations(spark):
    rows = [(1, 10), (1, 20), (2, 20), (2, 30), (3, 10), (3, 30)]
    config = AlsConfig(factors=3, iterations=2, alpha=5.0)
    fit = models.train_als(edges(spark, rows), config)
    movies = {r.movieId: np.array(r.vec) for r in fit["movies"].collect()}
    users = {r.userId: np.array(r.vec) for r in fit["users"].collect()}
    x = np.array(list(users.values()))
    liked = np.array([users[u] for u, m in rows if m == 10])
    want = np.linalg.solve(x.T @ x + 5.0 * liked.T @ liked + 0.1 * np.eye(3), 6.0 * liked.sum(axis=0))
    assert movies[10] == pytest.approx(want)
    again = {r.movieId: r.vec for r in models.train_als(edges(spark, rows), config)["movies"].collect()}
    assert again[10] == pytest.approx(movies[10].tolist())
    folded = models.fold_in_als(edges(spark, [(9, 10), (9, 20), (9, 99)]), fit["movies"], config).collect()
    assert len(folded) == 1 and len(folded[0].vec) == 3


def test_early_stopping():
    steps = lambda values, gap: [(i * gap, (v, v)) for i, v in enumerate(values)]
    assert models.stop_early(steps([0, 0.5, 0.4, 0.3], 5), 2) == (5, True)
    assert models.stop_early(steps([0, 0.5, 0.3, 0.35, 0.4], 5)[:4], 2, 1) == (5, True)
    # means of three: 0, 0.25, 0.267, 0.383, 0.35
    assert models.stop_early(steps([0, 0.5, 0.3, 0.35, 0.4], 5), 2, 3) == (15, False)


def test_als_keeps_the_best_validated_factors(spark):
    values = {1: 0.4, 2: 0.5, 3: 0.3, 4: 0.2}
    fit = models.train_als(edges(spark), AlsConfig(factors=2, iterations=6, patience=2), lambda u, m, i: (values[i], values[i]))
    assert (fit["best"], fit["stopped"], fit["early"]) == (2, 4, True)


def test_biased_mf_learns(spark):
    rows = spark.createDataFrame([(1, 10, 5.0), (1, 20, 1.0), (2, 10, 4.5), (2, 30, 2.0), (3, 20, 1.5), (3, 30, 5.0)], "userId long, movieId long, rating double")
    fit = models.train_biased_mf(rows, BiasedMfConfig(factors=2, epochs=4, learning_rate=0.1))
    assert fit["losses"][-1] < fit["losses"][0]
    scores = models.predict_biased_mf(rows.select("userId", "movieId"), fit).collect()
    assert len(scores) == 6 and all(np.isfinite(r.score) for r in scores)
    with pytest.raises(ValueError):
        models.train_biased_mf(rows.unionAll(rows), BiasedMfConfig())


def test_graph_training_learns_and_repeats(spark):
    configs = {"mf": GraphConfig(layers=0, steps=4, batch_size=None), "graph": GraphConfig(layers=2, steps=4, batch_size=32)}
    a, b = (sorted((r.run, r.kind, r.id, tuple(np.round(r.vec, 9)), round(r.loss_before, 9), round(r.loss_after, 9)) for r in models.train_graph_models(edges(spark, TOY), configs).collect()) for _ in range(2))
    assert a == b and len(a) == 18 and all(r[5] < r[4] for r in a)


def test_graph_training_stops_early_and_keeps_the_best(spark):
    values = iter([0.0, 0.1, 0.5, 0.2, 0.1, 0.9])
    seen = []

    def validate(users, movies, step):
        seen.append((step, users.count(), movies.count()))
        return (v := next(values)), v

    fit = models.train_graph_model(edges(spark, TOY), GraphConfig(layers=1, steps=5, width=4, validation_interval=1, patience=2, smoothing=1), validate)
    assert (fit["best"], fit["stopped"], fit["early"]) == (2, 4, True) and seen == [(i, 4, 5) for i in range(5)]


def plain_adam(state, grads, rate):
    """A step of some rows, one by one. state: row -> [x, m, v, n]."""
    for row, g in grads.items():
        x, m, v, n = state[row]
        m, v, n = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, n + 1
        state[row] = [x - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8), m, v, n]


def block_of(spark, seed, ids, blocks):
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks))).collect()
    return dict(map(tuple, rows))


@pytest.mark.parametrize("layers, block_nodes", [(0, 100), (0, 3), (2, 100), (2, 3)])
def test_strata_equal_a_plain_loop(spark, layers, block_nodes):
    """The same steps, one like after the other in memory, over dense matrices; several blocks are taken one after the other."""
    rng = np.random.default_rng(7)
    likes = sorted({(int(u), int(m)) for u, m in zip(rng.integers(0, 9, 30), rng.integers(100, 108, 30), strict=True)})
    config = GraphConfig(layers=layers, steps=6, batch_size=4, width=3, block_nodes=block_nodes, learning_rate=0.1, decay=0.01, random_seed=11)
    fit = models.train_graph_model(edges(spark, likes), config)
    users, movies = sorted({u for u, _ in likes}), sorted({m for _, m in likes})
    nodes = [(0, u) for u in users] + [(1, m) for m in movies]
    blocks, each = max(1, -(-max(len(users), len(movies)) // block_nodes)), -(-len(likes) // 4)
    assert blocks == (1 if block_nodes == 100 else 3)
    place = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for u, m in likes:
        a[place[0, u], place[1, m]] = a[place[1, m], place[0, u]] = 1 / np.sqrt(sum(x == u for x, _ in likes) * sum(y == m for _, y in likes))
    s = sum(np.linalg.matrix_power(a, k) for k in range(layers + 1)) / (layers + 1)
    x = s @ np.array([np.random.default_rng([11, k, i]).normal(0, 0.1, 3) for k, i in nodes])
    state = {n: [x[i], np.zeros(3), np.zeros(3), 0] for i, n in enumerate(nodes)}
    t = sweep = 0
    while t < 6:
        stop, sweep = min(6, t + each), sweep + 1
        seed, before = 11 + 1000 * sweep, {n: v[0] for n, v in state.items()}
        ub, mb = block_of(spark, 2 * seed, users, blocks), block_of(spark, 2 * seed + 1, movies, blocks)
        for stratum in range(blocks):
            for key in range(blocks):
                own = [m for m in movies if (mb[m] - stratum) % blocks == key]
                rows = [(u, m) for u, m in likes if ub[u] == key and m in own]
                if not rows:
                    continue
                r = np.random.default_rng([seed, stratum, key])
                order = r.permutation(len(rows))[: int(np.ceil((stop - t) / each * len(rows)))]
                inside = [u for u in users if ub[u] == key]
                codes = np.array(sorted(inside.index(u) * len(own) + own.index(m) for u, m in rows))
                for at in range(0, len(order), 4):
                    batch = [rows[o] for o in order[at : at + 4]]
                    drawn = strata.draw_unliked(np.array([inside.index(u) for u, _ in batch]), codes, len(own), r)
                    triples = [(u, i, own[j]) for (u, i), j in zip(batch, drawn, strict=True) if j >= 0]
                    assert all((u, j) not in likes for u, _, j in triples)
                    grads = {}
                    for u, i, j in triples:
                        xu, xi, xj = (state[n][0] for n in ((0, u), (1, i), (1, j)))
                        g = -1 / (1 + np.exp(xu @ (xi - xj))) / len(triples)
                        for n, d in (((0, u), g * (xi - xj)), ((1, i), g * xu), ((1, j), -g * xu)):
                            grads[n] = grads.get(n, 0) + d + 0.01 / len(triples) * state[n][0]
                    plain_adam(state, grads, 0.1)
        if layers:
            moved = s @ s @ np.array([state[n][0] - before[n] for n in nodes])
            for i, n in enumerate(nodes):
                state[n][0] = before[n] + moved[i]
        t = stop
    got = {(0, r.userId): r.vec for r in fit["users"].collect()} | {(1, r.movieId): r.vec for r in fit["movies"].collect()}
    assert got.keys() == state.keys() and all(np.allclose(got[n], state[n][0], atol=1e-9) for n in nodes)


def test_training_leaves_only_its_result(spark):
    from duolist.schema import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    fit = models.train_graph_model(edges(spark, TOY), GraphConfig(layers=1, steps=6, batch_size=4, width=4, validation_interval=2), lambda u, m, t: (float(t), 0.0))
    assert fit["best"] == 6 and len(set(os.listdir(folder)) - before) == 1 and fit["users"].count() == 4


def test_negatives_are_unliked_even_where_few_are_left():
    likes = np.array([0, 1, 2, 4, 5, 6, 8, 10, 11])  # of four movies users 0 and 1 lack the last, user 2 the second
    drawn = strata.draw_unliked(np.repeat([0, 1, 2], 50), likes, 4, np.random.default_rng(0), rounds=1)
    assert drawn.tolist() == [3] * 100 + [1] * 50
    assert strata.draw_unliked(np.array([0, 1]), np.array([0, 1, 2, 3, 5]), 4, np.random.default_rng(0), rounds=0)[0] == -1


def test_gradient_matches_differences(spark):
    g = graph.bipartite_graph(edges(spark, TOY))
    links = np.array([(r.source, r.target) for r in g["links"].collect()])
    n = int(links.max()) + 1
    degree = np.bincount(links[:, 0], minlength=n)
    adjacency = np.zeros((n, n))
    adjacency[links[:, 1], links[:, 0]] = 1 / np.sqrt(degree[links[:, 0]] * degree[links[:, 1]])
    p = (np.eye(n) + adjacency + adjacency @ adjacency) / 3
    e = np.random.default_rng(1).normal(0, 1, (n, 2))
    triples = [(0, 4, 7), (0, 5, 8), (1, 5, 4), (3, 6, 8), (0, 4, 7)]
    u, i, j = np.array(triples).T

    def loss(x):
        y = p @ x
        return np.logaddexp(0, (y[u] * (y[j] - y[i])).sum(axis=1)).mean()

    want = np.zeros_like(e)
    for a in range(n):
        for b in range(2):
            step = np.zeros_like(e)
            step[a, b] = 1e-6
            want[a, b] = (loss(e + step) - loss(e - step)) / 2e-6
    vectors = spark.createDataFrame([(a, (p @ e)[a].tolist()) for a in range(n)], "node long, vec array<double>")
    rows = models.pairwise_gradient(spark.createDataFrame(triples, "u long, i long, j long"), vectors, len(triples), lambda c: graph.propagate(c, g["links"], 2)).collect()
    got = np.zeros_like(e)
    for r in rows:
        got[r.node, r.pos] = r.value
    assert np.allclose(got, want, atol=1e-7)


def test_heavy_users_are_cut_into_blocks(spark):
    rows = [(1, m) for m in range(60)] + [(u, m) for u in range(2, 8) for m in range(u, 60, u)]
    whole = sorted(map(tuple, models.co_counts(edges(spark, rows)).collect()))
    assert whole == sorted(map(tuple, models.co_counts(edges(spark, rows), 7).collect()))
    likes = {u: {m for v, m in rows if v == u} for u, _ in rows}
    assert whole == sorted((a, b, n) for a in range(60) for b in range(a + 1, 60) if (n := sum(a in s and b in s for s in likes.values())))


def test_minibatches_reach_what_a_plain_loop_reaches(spark):
    """Held-out error of a few epochs is near that of the same steps taken one after the other in memory."""
    rng = np.random.default_rng(3)
    bu, bi = rng.normal(0, 0.7, 30), rng.normal(0, 0.7, 25)
    data = [(u, i, float(np.clip(3 + bu[u] + bi[i] + rng.normal(0, 0.2), 0.5, 5))) for u in range(30) for i in range(25)]
    held = [r for r in data if (r[0] * 7 + r[1] * 3) % 10 == 0]
    train = [r for r in data if (r[0] * 7 + r[1] * 3) % 10]
    df = spark.createDataFrame(train, "userId long, movieId long, rating double")
    fit = models.train_biased_mf(df, BiasedMfConfig(factors=2, epochs=4, batch_size=225, learning_rate=0.1))
    asked = spark.createDataFrame(held, "userId long, movieId long, rating double")
    error = np.sqrt(np.mean([(r.score - r.rating) ** 2 for r in models.predict_biased_mf(asked, fit).collect()]))
    plain = np.sqrt(np.mean([(r[2] - np.mean([x[2] for x in train])) ** 2 for r in held]))
    assert fit["losses"][-1] < 0.6 * fit["losses"][0] and error < 0.6 * plain


def test_configs():
    for bad in (lambda: AlsConfig(factors=0), lambda: AlsConfig(alpha=float("inf")), lambda: BiasedMfConfig(regularization=-1), lambda: GraphConfig(layers=-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        PrepConfig(unknown=1)


def test_bipartite_graph(spark):
    g = graph.bipartite_graph(edges(spark, [(20, 200), (10, 100), (10, 200), (20, 300), (30, 100), (30, 100)]))
    assert graph.graph_counts(g) == {"num_users": 3, "num_movies": 3, "num_nodes": 6, "num_positive_edges": 5}
    assert [(r.userId, r.node) for r in g["users"].orderBy("node").collect()] == [(10, 0), (20, 1), (30, 2)]
    assert [(r.movieId, r.node) for r in g["movies"].orderBy("node").collect()] == [(100, 3), (200, 4), (300, 5)]
    assert graph.check_links(g["links"], 6).count() == 10
    with pytest.raises(KeyError):
        graph.encode_ids(spark.createDataFrame([(99,)], "userId long"), g["users"], "userId")
    with pytest.raises(ValueError):
        graph.bipartite_graph(edges(spark, []))
    triples = graph.sample_triples(g, 50, 3).collect()
    likes = {(r.userId, r.movieId) for r in g["edges"].collect()}
    assert len(triples) == 50 and all((t.userId, t.positive) in likes and (t.userId, t.negative) not in likes for t in triples)


def test_propagation(spark):
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 0)], "source long, target long")
    weights = graph.edge_weights(links)
    assert all(r.weight == pytest.approx(2**-0.5) for r in weights.collect())
    v = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (2, 0, 4.0)], "node long, pos int, value double")
    once = {r.node: r.value for r in graph.propagate_once(v, weights).collect()}
    assert once == pytest.approx({0: 6 / 2**0.5, 1: 2**-0.5, 2: 2**-0.5})
    two = spark.createDataFrame([(0, 1), (1, 0)], "source long, target long")
    eye = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "node long, vec array<double>")
    mean = graph.as_vectors(graph.propagate(graph.as_components(eye), two, 1)).collect()
    assert all(r.vec == pytest.approx([0.5, 0.5]) for r in mean)
    nodes = spark.createDataFrame([(0,), (7,)], "node long")
    assert [r.node for r in graph.isolated_nodes(nodes, links).collect()] == [7]


def test_ranking_loss(spark):
    good = spark.createDataFrame([(2.0, 0.0), (0.5, 0.0)], "positive double, negative double")
    bad = good.selectExpr("negative as positive", "positive as negative")
    assert graph.ranking_loss(good).first().loss < np.log(2) < graph.ranking_loss(bad).first().loss


def test_least_squares_solves_many_rows_a_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = sorted({(int(u), int(m)) for u, m in zip(rng.integers(0, 60, 500), rng.integers(0, 20, 500), strict=True)})
    vectors = rng.normal(size=(20, 3))
    movies = spark.createDataFrame([(m, v.tolist()) for m, v in enumerate(vectors)], "movieId long, vec array<double>")
    config = AlsConfig(factors=3)
    likes = spark.createDataFrame(rows, "userId long, movieId long")
    for at_once in (4_000_000, 600):
        monkeypatch.setattr(models, "NUMBERS_AT_ONCE", at_once)
        got = {r.userId: r.vec for r in models.least_squares(likes, "userId", "movieId", movies, config).collect()}
        assert got.keys() == {u for u, _ in rows}
        for u, vec in got.items():
            x = vectors[[m for v, m in rows if v == u]]
            left = vectors.T @ vectors + config.regularization * np.eye(3) + config.alpha * x.T @ x
            assert np.allclose(vec, np.linalg.solve(left, (1 + config.alpha) * x.sum(axis=0)))
    groups = models.least_squares(likes, "userId", "movieId", movies, config)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [block" in groups  # blocks, not a group a user


def test_prediction_moves_no_vector_with_a_pair(spark):
    """Blocks meet blocks: no join; other columns and unknown ids are treated as by inner joins."""
    users = spark.createDataFrame([(1, 0.5, [1.0, 2.0]), (2, -0.5, [0.0, 1.0])], "userId long, bias double, vec array<double>")
    movies = spark.createDataFrame([(7, 0.25, [3.0, 1.0])], "movieId long, bias double, vec array<double>")
    pairs = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "c"), (1, 8, "d"), (None, 7, "e"), (1, 7, "a")], "userId int, movieId int, note string")
    got = models.predict_biased_mf(pairs, {"mean": 3.0, "users": users, "movies": movies})
    assert got.columns == ["userId", "movieId", "note", "score"]
    assert sorted(map(tuple, got.collect())) == [(1, 7, "a", 8.75), (1, 7, "a", 8.75), (2, 7, "b", 3.75)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sweeps_move_vectors_few_times():
    """Each block more is a shuffle of all vectors; a propagation has fewer blocks than a training."""
    assert strata.blocks_for(1_000_000, 1_100_000) == 9 and strata.blocks_for(100_000, 50_000) == 7
    assert strata.spread_blocks(9) == 4 and strata.spread_blocks(1) == 1 and strata.spread_blocks(80) == 10


def test_propagation_holds_one_sum_and_losses_write_nothing(spark, monkeypatch):
    made, dropped = [], []
    monkeypatch.setattr(strata, "shared_table", lambda df, name: made.append(name) or shared_table(df, name))
    monkeypatch.setattr(strata, "drop_table", lambda df: dropped.append(df) or drop_table(df))
    likes = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 9)], "a long, b long")
    sides = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 7), (1, 8), (1, 9)], "kind int, node long")
    nodes = shared_table(strata.start_nodes(sides, 2, 1, 0.1, lambda x: x), "nodes")
    strata.Spread(strata.weighted_edges(likes), 2).polynomial(nodes, [0.5, 0.25, 0.125]).count()
    assert made == ["spread", "spread"] and len(dropped) == 1
    rows = likes.withColumn("y", F.lit(0.0))
    met = strata.met_loss(nodes, rows, 2, 2, 5, strata.pairwise_loss(2))
    assert len(made) == 2  # no table
    assert np.isclose(met, strata.sweep(nodes, rows, 2, 5, strata.pairwise_loss(2))[1])


def test_tasks_of_neighbours_grow_with_what_meets(spark, monkeypatch):
    usual = sorted(map(tuple, models.item_neighbours(edges(spark, TOY), 2, 1.0).collect()))
    monkeypatch.setattr(models, "_met", lambda likes: 31)
    many = models.item_neighbours(edges(spark, TOY), 2, 1.0)
    assert sorted(map(tuple, many.collect())) == usual and many.rdd.getNumPartitions() == 62
