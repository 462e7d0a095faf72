"""Whole runs: preparation, selection on validation, frozen test, and one list for two exports."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolist.config import AlsConfig, BiasedMfConfig, GraphConfig, PrepConfig, check_nested_counts
from duolist.operators import cohorts, evaluation, models, pairs, ranking
from duolist.operators.graph import fold_in
from duolist.schema import shared_table
from duolist.sources import sinks
from duolist.sources.tables import exists


def prepare(ratings: DataFrame, movies: DataFrame, config: PrepConfig, path: str) -> dict[str, object]:
    """Split, cohorts, edges, catalogue and dissimilar pairs as tables below path, and a manifest of what they hold."""
    split = shared_table(cohorts.add_temporal_split(ratings, config), "split")
    stats = shared_table(cohorts.user_split_statistics(split), "statistics")
    training, evaluating = cohorts.training_users(stats, config), cohorts.evaluation_users(stats, config)
    edges = cohorts.training_edges(split, training)
    catalog = shared_table(cohorts.warm_catalog(edges, config), "catalog")
    train = split.where("split = 'train'").join(evaluating, "userId", "left_semi")
    drawn = shared_table(pairs.sample_pairs(evaluating, config), "drawn")
    chosen, summary = pairs.dissimilar_pairs(shared_table(pairs.pair_features(drawn, train, movies, config), "features"), config)
    events = cohorts.positive_events(split, "test", evaluating)
    tables = {"user_statistics": stats, "train_edges": cohorts.edges_of_catalog(edges, catalog), "warm_catalog": catalog, "pairs": pairs.joint_counts(chosen, events)}
    for n, df in tables.items():
        sinks.write_table(df, f"{path}/{n}")
    spark = ratings.sparkSession
    saved = {n: spark.read.parquet(f"{path}/{n}") for n in tables}
    return {
        "config": config.to_dict(),
        "split_summary": [r.asDict() for r in cohorts.split_summary(split).collect()],
        "training_users": training.count(),
        "evaluation_users": evaluating.count(),
        "warm_movies": saved["warm_catalog"].count(),
        "train_graph_edges": saved["train_edges"].count(),
        "warm_test_positive_coverage": cohorts.warm_coverage(events, catalog).first().coverage,
        "pair_summary": summary,
        "observable_joint_positive_rate": saved["pairs"].agg(F.coalesce(F.avg((F.col("jointTestPositiveCount") >= 1).cast("double")), F.lit(0.0))).first()[0],
        "digests": sinks.freeze(saved),
    }


class Context:
    """One period's pairs, history and targets. In the test period validation is history too, the models' data is not."""

    def __init__(self, pair_rows: DataFrame, split: DataFrame, catalog: DataFrame, period: str):
        if period not in ("validation", "test"):
            raise ValueError("the period is validation or test")
        members = cohorts.pair_members(pair_rows).select("userId").distinct()
        history = ("train",) if period == "validation" else ("train", "validation")
        self.pairs, self.catalog, self.period = pair_rows, catalog, period
        self.seen = shared_table(cohorts.seen_items(split, members, history), "seen")
        self.events = cohorts.positive_events(split, period, members)
        self.relevant = shared_table(evaluation.pair_relevant_items(pair_rows, self.events, catalog, self.seen), "relevant")
        self.size = catalog.count()

    def first(self, count: int) -> Context:
        """The same for the first pairs only; nothing is computed anew."""
        out = object.__new__(Context)
        out.__dict__.update(self.__dict__, pairs=self.pairs.where(F.col("pairId") < count), relevant=self.relevant.where(F.col("pairId") < count))
        return out

    def evaluate(self, lists: DataFrame, k: int = 10) -> DataFrame:
        return evaluation.method_summary(lists.join(self.pairs.select("pairId"), "pairId", "left_semi"), self.relevant, self.size, k)

    def coverage(self) -> DataFrame:
        return evaluation.target_coverage(self.pairs, self.events, self.catalog, self.relevant)

    def popular(self, k: int = 10) -> DataFrame:
        return models.recommend_popular(self.pairs, self.catalog, self.seen, k).withColumn("method", F.lit("popularity"))

    def by_scores(self, scores: DataFrame, method: str, weight: float | None, k: int = 10) -> DataFrame:
        return ranking.recommend_from_scores(self.pairs, scores, self.catalog, self.seen, weight, k).withColumn("method", F.lit(method))

    def by_vectors(self, users: DataFrame, movies: DataFrame, method: str, weight: float | None, k: int = 10) -> DataFrame:
        return ranking.recommend_from_vectors(self.pairs, users, movies, self.seen, weight, k).withColumn("method", F.lit(method))


def best_run(summaries: Iterable[tuple[str, dict]]) -> str:
    """The run with the greatest selection key; ties keep the first."""
    best = None
    for name, s in summaries:
        key = evaluation.selection_key(s)
        if best is None or key > best[0]:
            best = (key, name)
    return best[1]


def select_neighbours(context: Context, edges: DataFrame, grid: Iterable[tuple[int, float]], weight: float = 0.65, k: int = 10) -> tuple[str, dict[str, dict]]:
    """Best (width, shrinkage). Each shrinkage is fitted once at the greatest width and cut from there."""
    grid = list(grid)
    widest = max(w for w, _ in grid)
    fitted = {s: shared_table(models.item_neighbours(edges, widest, s), "neighbours") for s in {s for _, s in grid}}
    members = cohorts.pair_members(context.pairs).select("userId").distinct()
    likes = edges.join(members, "userId", "left_semi")
    found = {f"width {w}, shrinkage {s}": context.evaluate(context.by_scores(models.neighbour_scores(likes, fitted[s], w), "neighbours", weight, k), k).first().asDict() for w, s in grid}
    return best_run(found.items()), found


def select_graph_model(context: Context, edges: DataFrame, configs: dict[str, GraphConfig], weights: Iterable[float] = (0.0, 0.65, 1.0), k: int = 10) -> tuple[str, dict[str, dict]]:
    """Best of a grid of propagated models and conflict weights; the runs of the grid train side by side."""
    trained = shared_table(models.train_graph_models(edges, configs), "runs")
    found = {}
    for run in configs:
        own = trained.where(F.col("run") == run)
        users, movies = (own.where(F.col("kind") == kind).select(F.col("id").alias(name), "vec") for kind, name in (("user", "userId"), ("movie", "movieId")))
        for w in weights:
            found[f"{run}, weight {w}"] = context.evaluate(context.by_vectors(users, movies, run, w, k), k).first().asDict()
    return best_run(found.items()), found


def select_als(context: Context, edges: DataFrame, configs: dict[str, AlsConfig], weight: float = 0.65, k: int = 10) -> tuple[str, dict[str, dict]]:
    """Best of a grid of factorisations, each stopped by the validation lists."""

    def check(users: DataFrame, movies: DataFrame, _: int) -> tuple[float, float]:
        return evaluation.selection_key(context.evaluate(context.by_vectors(users, movies, "als", weight, k), k).first().asDict())

    found = {}
    for run, config in configs.items():
        fit = models.train_als(edges, config, check)
        found[run] = context.evaluate(context.by_vectors(fit["users"], fit["movies"], run, weight, k), k).first().asDict()
    return best_run(found.items()), found


def select_biased_mf(context: Context, ratings: DataFrame, configs: dict[str, BiasedMfConfig], weights: Iterable[float | None] = (0.0, 0.65, 1.0, None), k: int = 10) -> tuple[str, dict[str, dict]]:
    """Best of a grid of rating models and aggregations; a weight of None is the square root of the product."""
    members = cohorts.pair_members(context.pairs).select("userId").distinct()
    found = {}
    for run, config in configs.items():
        model = models.train_biased_mf(ratings, config)
        scores = shared_table(models.predict_biased_mf(cohorts.against_all(members, context.catalog.select("movieId"), "movieId"), model), "scores")
        for w in weights:
            found[f"{run}, {'nash' if w is None else w}"] = context.evaluate(context.by_scores(scores, run, w, k), k).first().asDict()
    return best_run(found.items()), found


RUN_NAME = re.compile("[a-z][a-z0-9_]*")


def conflict_grid(context: Context, users: DataFrame, movies: DataFrame, weights: Iterable[float], k: int = 10, prefix: str = "graph", resamples: int = 10_000, seed: int = 20_260_828) -> dict[str, object]:
    """Popularity and one model's lists at a grid of conflict weights, compared with each other.

    lists, metrics: of all methods. summaries: (method, ...). diagnostics: how far each method's lists are from those of the average
    (weight 0). tied: methods with the best mean minimum NDCG; selected: that of them with the best mean average NDCG, the first
    of several. bootstrap: average against popularity, selected against both, where they differ. coverage: share of liked movies that
    lists can hold. ValueError if the grid lacks weight 0, the prefix is no lower-case name, or vectors and catalogue hold other movies.
    """
    weights = [float(w) for w in weights]
    if 0.0 not in weights or not RUN_NAME.fullmatch(prefix):
        raise ValueError("the grid needs weight 0, and the prefix must be a name in lower case")
    cohorts.require_same(movies, context.catalog, "movieId", "vectors and catalogue")
    name = {w: f"{prefix}_average" if w == 0 else f"{prefix}_conflict_{w:g}" for w in weights}
    found = ranking.lists_from_vectors(context.pairs, users, movies, context.seen, weights, k)
    labelled = found.withColumn("method", F.element_at(F.create_map(*(F.lit(x) for w in weights for x in (w, name[w]))), F.col("conflictWeight")))
    columns = ["method", "pairId", "userA", "userB", "rank", "movieId"]
    lists = shared_table(labelled.select(*columns).unionByName(context.popular(k).select(*columns)), "lists")
    metrics, summaries = None, {}
    for method in ("popularity", *name.values()):
        own = lists.where(F.col("method") == method)
        summaries[method] = evaluation.require_evaluated(context.evaluate(own, k)).first().asDict()
        one = evaluation.pair_metrics(own, context.relevant, k).withColumn("method", F.lit(method))
        metrics = one if metrics is None else metrics.unionByName(one)
    metrics = shared_table(metrics, "metrics")
    keys = {m: evaluation.selection_key(summaries[m], k) for m in name.values()}
    best = max(key[0] for key in keys.values())
    tied = [m for m, key in keys.items() if key[0] == best]
    selected, average = max(tied, key=lambda m: keys[m][1]), name[0.0]
    compared = [c for c in dict.fromkeys([(average, "popularity"), (selected, average), (selected, "popularity")]) if c[0] != c[1]]
    return {
        "lists": lists,
        "metrics": metrics,
        "summaries": summaries,
        "diagnostics": evaluation.compare_rankings(lists, average, k),
        "tied": tied,
        "selected": selected,
        "bootstrap": compare_methods(metrics, compared, [f"minimumNDCG@{k}"], resamples, seed),
        "coverage": context.coverage().first().coverage,
    }


def family_lists(context: Context, family: str, edges: DataFrame, ratings: DataFrame, settings: dict, weight: float | None, k: int = 10) -> DataFrame:
    """A selected run, trained anew on the training data, and its lists for a context's pairs.

    family: neighbours (settings width, shrinkage), als, biased or graph (settings of their configs). edges: training likes inside the
    catalogue; ratings: training ratings, which only the biased family reads.
    """
    members = cohorts.pair_members(context.pairs).select("userId").distinct()
    if family == "neighbours":
        near = shared_table(models.item_neighbours(edges, settings["width"], settings.get("shrinkage", 0.0)), "neighbours")
        return context.by_scores(models.neighbour_scores(edges.join(members, "userId", "left_semi"), near, settings["width"]), family, weight, k)
    if family == "biased":
        model = models.train_biased_mf(ratings, BiasedMfConfig(**settings))
        asked = cohorts.against_all(members, context.catalog.select("movieId"), "movieId")
        return context.by_scores(models.predict_biased_mf(asked, model), family, weight, k)
    if family not in ("als", "graph"):
        raise ValueError(f"unknown family: {family}")
    fit = models.train_als(edges, AlsConfig(**settings)) if family == "als" else models.train_graph_model(edges, GraphConfig(**settings))
    return context.by_vectors(fit["users"], fit["movies"], family, weight, k)


def frozen_test(path: str, chosen: str, context: Context, lists: dict[str, DataFrame], features: DataFrame, rule: dict[str, float], counts: Iterable[int] = (), k: int = 10, resamples: int = 10_000, seed: int = 20_260_828, exploratory: bool = False) -> dict[str, object]:
    """A selected run's lists on the test period's pairs, saved below path, once.

    lists: of each method; the selected one is named `chosen` and compared with all others. The report has each method's summary,
    how much of what was liked lists can hold, means by similarity band (features, rule) and by the first so many pairs (counts), and
    paired bootstraps of minimum and average NDCG. exploratory: says in the report that the test period was looked at before.
    FileExistsError if the test was claimed before, even by a run that broke off.
    """
    if context.period != "test" or chosen not in lists:
        raise ValueError("a frozen test needs the test period's context and the lists of what was chosen")
    spark = context.pairs.sparkSession
    sinks.claim(spark, f"{path}/test-claim", chosen)
    both = None
    for method, own in lists.items():
        one = own.select(F.lit(method).alias("method"), "pairId", "userA", "userB", "rank", "movieId")
        both = one if both is None else both.unionByName(one)
    both = shared_table(both, "lists")
    metrics, summaries = None, {}
    for method in lists:
        own = both.where(F.col("method") == method)
        summaries[method] = evaluation.require_evaluated(context.evaluate(own, k)).first().asDict()
        one = evaluation.pair_metrics(own, context.relevant, k).withColumn("method", F.lit(method))
        metrics = one if metrics is None else metrics.unionByName(one)
    metrics = shared_table(metrics, "metrics")
    names = [f"minimumNDCG@{k}", f"averageNDCG@{k}"]
    others = [m for m in lists if m != chosen]
    report = {
        "status": "exploratory" if exploratory else "frozen",
        "chosen": chosen,
        "methods": summaries,
        "coverage": context.coverage().first().asDict(),
        "bands": [r.asDict() for r in evaluation.subgroup_summary(metrics, pairs.similarity_bands(features, rule), "similarityBand", k).collect()],
        "compared": [r.asDict() for r in compare_methods(metrics, [(chosen, m) for m in others], names, resamples, seed).collect()] if others else [],
        "nested": [r.asDict() | {"method": m} for m in lists for r in nested_summaries(context, both.where(F.col("method") == m), list(counts), k).collect()] if counts else [],
    }
    sinks.save_model({"lists": both, "metrics": metrics}, report, f"{path}/test")
    return report


def nested_summaries(context: Context, lists: DataFrame, counts: list[int], k: int = 10) -> DataFrame:
    """Summaries for the first 100, 250, ... pairs from lists that are made once."""
    check_nested_counts(counts, counts[-1])
    out = None
    for n in counts:
        one = context.first(n).evaluate(lists, k).withColumn("pairs", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def compare_methods(metrics: DataFrame, comparisons: Iterable[tuple[str, str]], names: Iterable[str], resamples: int = 10_000, seed: int = 20_260_828) -> DataFrame:
    """Paired bootstrap of each comparison and metric."""
    out = None
    for a, b in comparisons:
        for m in names:
            one = evaluation.paired_bootstrap(metrics, a, b, m, resamples, seed)
            out = one if out is None else out.unionByName(one)
    return out


def prepare_holdout(stats: DataFrame, train: DataFrame, movies: DataFrame, config: PrepConfig, excluded: DataFrame, development: int, holdout: int, known: DataFrame | None = None) -> dict[str, object]:
    """Pairs of users not evaluated before, the first for development and the rest held out, with their features and band rule.

    known: users whom models can have vectors for, if not all.
    """
    eligible = cohorts.pretest_users(stats, config.evaluation_min_train_ratings, config.evaluation_min_train_positives, config.evaluation_min_validation_positives, excluded)
    drawn = pairs.random_disjoint_pairs(cohorts.of_users(eligible, known), development + holdout, config.random_seed)
    featured = shared_table(pairs.pair_features(drawn, train, movies, config), "pairs")
    dev, held = featured.where(F.col("pairId") < development), featured.where(F.col("pairId") >= development).withColumn("pairId", F.col("pairId") - development)
    return {"development": dev, "holdout": held, "rule": pairs.band_rule(dev), "digests": sinks.freeze({"development": dev, "holdout": held})}


def collect_stages(spark: SparkSession, path: str, stages: Iterable[str]) -> DataFrame:
    """stage_rows of the stages below path that have both their notes; ValueError if none has.

    A stage is a folder with tables training and validation of one column settings, JSON with facts and with a list methods.
    """
    out = None
    for stage in stages:
        paths = [f"{path}/{stage}/{part}" for part in ("training", "validation")]
        if all(exists(spark, p) for p in paths):
            facts, found = (json.loads(spark.read.parquet(p).first().settings) for p in paths)
            one = evaluation.stage_rows(spark, stage, facts, found["methods"])
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no stage is complete")
    return out


def compare_stages(spark: SparkSession, path: str, comparisons: Iterable[dict], resamples: int = 10_000, seed: int = 20_260_828) -> DataFrame | None:
    """Paired bootstrap of two stages' methods by the tables metrics below their folders; None if no comparison has both.

    A comparison has name, metric, and a and b, each (stage, method).
    """
    out = None
    for c in comparisons:
        sides = [(f"{path}/{stage}/metrics", stage, method) for stage, method in (c["a"], c["b"])]
        if all(exists(spark, p) for p, _, _ in sides):
            a, b = (spark.read.parquet(p).where(F.col("method") == m).select(F.lit(label).alias("method"), "pairId", f"`{c['metric']}`") for (p, _, m), label in zip(sides, "ab", strict=True))
            one = evaluation.paired_bootstrap(a.unionByName(b), "a", "b", c["metric"], resamples, seed)
            named = {"name": c["name"], "stageA": sides[0][1], "stageB": sides[1][1], "methodA": sides[0][2], "methodB": sides[1][2]}
            one = one.withColumns({n: F.lit(v) for n, v in named.items()})
            out = one if out is None else out.unionByName(one)
    return out


def _two(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(F.lit(1).alias("userId"), "movieId", "rating").unionByName(b.select(F.lit(2).alias("userId"), "movieId", "rating"))


def _titled_lists(one_list: Callable[[DataFrame, float], DataFrame], spark: SparkSession, movies: DataFrame, catalog: DataFrame, weights: Iterable[float]) -> DataFrame:
    """The list of each weight for the pair of users 1 and 2, with titles, genres and counts."""
    pair = spark.createDataFrame([(0, 1, 2)], "pairId long, userA int, userB int")
    out = None
    for w in weights:
        one = one_list(pair, float(w)).withColumn("conflictWeight", F.lit(float(w)))
        out = one if out is None else out.unionByName(one)
    return out.join(movies.select("movieId", "title", "genres"), "movieId", "left").join(catalog, "movieId", "left")


def recommend_for_two(spark: SparkSession, a: DataFrame, b: DataFrame, movies: DataFrame, catalog: DataFrame, items: DataFrame, weights: Iterable[float] = (0.0, 0.65, 1.0), k: int = 10, als: AlsConfig | None = None, positive_threshold: float = 4.0) -> DataFrame:
    """Lists for two imported profiles (movieId, rating) with item vectors: one for each weight, with titles and counts.

    als: the settings that the item vectors were factorised with, whose equation then gives both members' vectors; else they
    are weighted means of what they like.
    """
    rated = _two(a, b)
    likes = rated.where(F.col("rating") >= positive_threshold)
    vectors = shared_table(fold_in(rated, items, positive_threshold) if als is None else models.fold_in_als(likes.join(items.select("movieId"), "movieId", "left_semi"), items, als), "members")
    if vectors.count() < 2:
        raise ValueError("a profile likes no known movie")
    return _titled_lists(lambda pair, w: ranking.recommend_from_vectors(pair, vectors, items, rated.select("userId", "movieId"), w, k), spark, movies, catalog, weights)


def recommend_for_two_by_neighbours(spark: SparkSession, a: DataFrame, b: DataFrame, movies: DataFrame, catalog: DataFrame, neighbours: DataFrame, width: int, weights: Iterable[float] = (0.0, 0.65, 1.0), k: int = 10, positive_threshold: float = 4.0) -> DataFrame:
    """The same from item neighbours; the candidates are the catalogue."""
    rated = _two(a, b)
    likes = rated.where(F.col("rating") >= positive_threshold)
    if likes.join(neighbours.select(F.col("src").alias("movieId")), "movieId", "left_semi").agg(F.count_distinct("userId")).first()[0] < 2:
        raise ValueError("a profile likes no known movie")
    scores = shared_table(models.neighbour_scores(likes, neighbours, width), "scores")
    return _titled_lists(lambda pair, w: ranking.recommend_from_scores(pair, scores, catalog, rated.select("userId", "movieId"), w, k), spark, movies, catalog, weights)
