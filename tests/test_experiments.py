import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolist.config import AlsConfig, GraphConfig
from duolist.operators import cohorts, pairs
from duolist.plans import experiments
from duolist.schema import shared_table
from duolist.sources.tables import DEMO, DemoTables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def demo(spark):
    d = DemoTables(spark, DATA)
    few = pairs.disjoint_pairs(d.pairs, 6)
    return d, experiments.Context(few, d.split.cache(), d.catalog.cache(), "test")


def test_prepare(spark, tmp_path):
    d = DemoTables(spark, DATA)
    config = dataclasses.replace(DEMO, pair_similarity_quantile=0.5, pair_candidate_sample_size=500)
    manifest = experiments.prepare(d.ratings, d.movies, config, str(tmp_path / "prepared"))
    assert manifest["training_users"] == 115 and manifest["evaluation_users"] == 87 and manifest["pair_summary"]["selected_pairs"] > 0
    assert spark.read.parquet(str(tmp_path / "prepared" / "pairs")).count() == manifest["pair_summary"]["selected_pairs"]


def test_selection(demo):
    d, context = demo
    best, found = experiments.select_neighbours(context, d.warm_edges, [(5, 10.0), (50, 10.0)])
    assert best in found and len(found) == 2
    best, found = experiments.select_graph_model(context, d.warm_edges, {"mf": GraphConfig(layers=0, steps=5), "graph": GraphConfig(steps=5)}, (0.0, 1.0))
    assert best in found and len(found) == 4


def test_nested_counts_and_coverage(demo):
    d, context = demo
    lists = context.popular()
    got = experiments.nested_summaries(context, lists, [3, 6]).orderBy("pairs").collect()
    assert [r.pairs for r in got] == [3, 6] and got[0].evaluated_pairs <= got[1].evaluated_pairs
    assert 0 <= context.coverage().first().coverage <= 1


def test_als_selection(demo):
    d, context = demo
    best, _ = experiments.select_als(context, d.warm_edges, {"small": AlsConfig(factors=2, iterations=1)})
    assert best == "small"


def test_one_list_for_two(spark, demo):
    d, _ = demo
    items = d.table("embeddings").selectExpr("vec_id as movieId", "embedding as vec")
    a, b = (spark.createDataFrame([(m, 5.0)], "movieId long, rating double") for m in (1, 2))
    got = experiments.recommend_for_two(spark, a, b, d.movies, d.catalog, items, (0.0, 1.0), 3)
    assert got.count() == 6 and got.where("movieId in (1, 2)").isEmpty()


def test_holdout(demo):
    d, _ = demo
    made = experiments.prepare_holdout(d.statistics, d.train, d.movies, DEMO, d.evaluation_users.limit(0), 5, 5)
    a, b = ({u for r in made[k].collect() for u in (r.userA, r.userB)} for k in ("development", "holdout"))
    assert len(a) == len(b) == 10 and not a & b and made["rule"]["lower"] <= made["rule"]["upper"]
    assert cohorts.pair_members(made["holdout"]).count() == 10


@pytest.fixture(scope="module")
def with_vectors(spark, demo):
    d, _ = demo
    rng = np.random.default_rng(1)
    users, movies = (shared_table(df.distinct(), "ids") for df in (cohorts.pair_members(d.pairs).select("userId"), d.catalog.select("movieId")))
    users, movies = (spark.createDataFrame([(r[0], rng.normal(size=4).tolist()) for r in sorted(df.collect())], f"{df.columns[0]} long, vec array<double>") for df in (users, movies))
    return users, movies


def test_conflict_grid(spark, demo, with_vectors):
    _, context = demo
    users, movies = with_vectors
    got = experiments.conflict_grid(context, users, movies, [0.0, 0.65, 1.0], 5, "graph", 100)
    assert set(got["summaries"]) == {"popularity", "graph_average", "graph_conflict_0.65", "graph_conflict_1"}
    for w, name in ((0.0, "graph_average"), (0.65, "graph_conflict_0.65"), (1.0, "graph_conflict_1")):
        want = {(r.pairId, r.rank, r.movieId) for r in context.by_vectors(users, movies, "x", w, 5).collect()}
        assert {(r.pairId, r.rank, r.movieId) for r in got["lists"].where(F.col("method") == name).collect()} == want
    keys = {m: (s["mean_minimumNDCG"], s["mean_averageNDCG"]) for m, s in got["summaries"].items() if m != "popularity"}
    assert set(got["tied"]) == {m for m, key in keys.items() if key[0] == max(k[0] for k in keys.values())} and keys[got["selected"]] == max(keys.values())
    own = {r.method: r for r in got["diagnostics"].collect()}
    assert own["graph_average"].identicalTopKPairRate == 1 and own["popularity"].comparedPairs == 6
    compared = {(r.methodA, r.methodB) for r in got["bootstrap"].collect()}
    assert ("graph_average", "popularity") in compared and all(a != b for a, b in compared)
    for weights, prefix in (([0.5], "graph"), ([0.0], "Graph 1")):
        with pytest.raises(ValueError):
            experiments.conflict_grid(context, users, movies, weights, 5, prefix)
    with pytest.raises(ValueError, match="other|different"):
        experiments.conflict_grid(context, users, movies.limit(3), [0.0], 5)


@pytest.mark.parametrize("family, settings", [("neighbours", {"width": 10, "shrinkage": 5.0}), ("als", {"factors": 2, "iterations": 1}), ("biased", {"factors": 2, "epochs": 1}), ("graph", {"width": 4, "layers": 0, "steps": 5, "batch_size": 64})])
def test_each_family_has_a_frozen_test(spark, demo, tmp_path, family, settings):
    d, context = demo
    features = shared_table(pairs.pair_features(context.pairs, d.train, d.movies, d.config), "features")
    train = d.train.select("userId", "movieId", "rating")
    if family in ("als", "graph"):  # pairs whose members have training likes
        known = d.warm_edges.select("userId").distinct()
        both = context.pairs.join(known.withColumnRenamed("userId", "userA"), "userA", "left_semi").join(known.withColumnRenamed("userId", "userB"), "userB", "left_semi")
        context = experiments.Context(shared_table(both, "pairs"), d.split, d.catalog, "test")
    own = experiments.family_lists(context, family, d.warm_edges, train, settings, 0.65, 5)
    report = experiments.frozen_test(f"file://{tmp_path}/{family}", family, context, {family: own, "popularity": context.popular(5)}, features, pairs.band_rule(features), [3, 6], 5, 50, exploratory=True)
    assert report["status"] == "exploratory" and set(report["methods"]) == {family, "popularity"} and len(report["compared"]) == 2 and len(report["nested"]) == 4
    assert sum(b["pairs"] for b in report["bands"] if b["method"] == family) == report["methods"][family]["evaluated_pairs"]
    with pytest.raises(FileExistsError):
        experiments.frozen_test(f"file://{tmp_path}/{family}", family, context, {family: own}, features, pairs.band_rule(features), (), 5)


def test_a_frozen_test_needs_the_test_period(spark, demo, tmp_path):
    d, context = demo
    validation = experiments.Context(context.pairs, d.split, d.catalog, "validation")
    with pytest.raises(ValueError, match="test period"):
        experiments.frozen_test(f"file://{tmp_path}/x", "popularity", validation, {"popularity": validation.popular(5)}, context.pairs, {"lower": 0, "upper": 1})
    assert not (tmp_path / "x").exists()
